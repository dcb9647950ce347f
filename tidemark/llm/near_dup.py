"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A text is the multiset of its 5-word shingles; a shingle weighs tf x idf. Two texts are linked if their weighted
Jaccard similarity is 0.8 or more, and a class is a connected component of links. Sampling only says where to look:
what becomes a class is decided on exact similarities.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, scratch, table

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Documents are counted by hashed feature, the first bits of a shingle's hash: a table of 2^20 counts, whatever the input.
FEATURE_BITS = 20
#: Features of this share of the documents or less have the full idf.
RARE = 1e-3
#: idf falls with the logarithm from 1 (RARE) to this (in every document). Unscaled, log(N / df) would give each shingle
#: that an edit makes several times the weight of those that a large group of copies shares, and tear the group apart.
IDF_FLOOR = 0.8
#: Estimated similarity from which a text joins the candidates of a bucket's hub, and from which it needs no other hub.
NEAR, CLOSE = 0.4, 0.9
ROUNDS = 3
#: Estimated similarity from which a hub is taken for one that will be verified.
SURE = 0.85
#: Shingles and texts of one block of a candidate group; a task compares two blocks.
BLOCK_SHINGLES = 400_000
BLOCK_TEXTS = 2_000
#: Features of one row of counts.
COUNTED = 1 << 12
#: Characters whose words are hashed at once, and of the texts (or the one text) that are worked on at once.
SECTION, PORTION = 1 << 16, 1 << 18

_WORD = re.compile(r"\w+")
_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_HASHES) > 300_000:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_POWERS = [pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(WORDS)]


_BASE = 0xD6E8FEB86659FD93
_THERE, _BACK = (np.multiply.accumulate(np.array([1, *[x] * (SECTION - 1)], dtype=np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


@functools.cache
def _letters() -> np.ndarray:
    """A random odd number for each code point of \\w, 0 for others."""
    codes = range(sys.maxunicode + 1)
    inside = np.fromiter((c.isalnum() or c == "_" for c in map(chr, codes)), bool, len(codes))
    return np.where(inside, _mixed(np.arange(1, len(codes) + 1, dtype=np.uint64)) | _U(1), _U(0))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the texts' bounds among them. A word's is the sum of its letters'
    numbers times powers of a base; two of V words share one with a probability of V^2 / 2^64."""
    low = [t.lower() if t else "" for t in texts]
    joined = "\n".join(low)
    codes = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letters, words, starts, inside = _letters(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], False
    for low_end in range(0, len(codes), SECTION):
        value = letters[codes[low_end : low_end + SECTION]]
        full = value != 0
        begins = full.copy()
        begins[1:] &= ~full[:-1]
        begins[0] &= not inside
        first = np.flatnonzero(begins)
        value *= _THERE[: len(value)]
        if inside and full[0]:  # the rest of a word that began in a section before
            rest = int(value[: first[0] if len(first) else None].sum()) * pow(_BASE, low_end - int(starts[-1][-1]), 1 << 64)
            words[-1][-1] = (int(words[-1][-1]) + rest) % (1 << 64)
        if len(first):
            words.append(np.add.reduceat(value, first) * _BACK[first])
            starts.append(first + low_end)
        inside = bool(full[-1])
    ends = np.cumsum([0] + [len(t) + 1 for t in low])
    return _mixed(np.concatenate(words)), np.searchsorted(np.concatenate(starts), ends)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of all texts in a row: their distinct shingles, sorted inside each text; how often each occurs; the texts' bounds
    among them; the texts' content keys. A text of 1 to 4 words is one shingle."""
    words, at = hashed_words(texts)
    n = np.diff(at)
    sizes = np.where(n < WORDS, np.minimum(n, 1), n - WORDS + 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    full = np.zeros(len(words), np.uint64)
    for j in range(WORDS):
        full[: max(0, len(words) - WORDS + 1)] += words[j : j + max(0, len(words) - WORDS + 1)] * _U(_POWERS[j])
    own = _mixed(full[np.repeat(at[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])])
    for i in np.flatnonzero((n > 0) & (n < WORDS)).tolist():
        own[bounds[i]] = _mixed((words[at[i] : at[i + 1]] * np.array(_POWERS[: n[i]], dtype=np.uint64)).sum(keepdims=True) + _U(n[i]))[0]
    for a, b in itertools.pairwise(bounds.tolist()):
        own[a:b].sort()
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    new[bounds[:-1][sizes > 0]] = True
    places = np.flatnonzero(new)
    keys = [xxhash.xxh128_digest(words[a:b].tobytes()) for a, b in itertools.pairwise(at.tolist())]
    return own[places], np.diff(np.append(places, len(own))), np.searchsorted(places, bounds), keys


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and how often each occurs."""
    return shingle_sets([text])[:2]


def content_key(text: str | None) -> bytes:
    return shingle_sets([text])[3][0]


def _portions(texts: pa.Array):
    """(begin, texts) of about PORTION characters each, or of one text."""
    held, size, begin = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= PORTION:
            yield begin, held
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, held


# --- document frequencies -------------------------------------------------------------------------------------------


def features_of(own: np.ndarray) -> np.ndarray:
    """The hashed feature of each shingle."""
    return (own >> _U(64 - FEATURE_BITS)).astype(np.int64)


def _counted(batches):
    """Rows (block, at, n) of a task: the number of its documents with each feature; block -1 has all its documents."""
    total, docs = np.zeros(1 << FEATURE_BITS, dtype=np.int64), 0
    for batch in batches:
        held = []
        for _, texts in _portions(batch.column(0)):
            own, _, bounds, _ = shingle_sets(texts)
            f = features_of(own)
            new = np.diff(f, prepend=-1) != 0  # shingles are sorted, so equal features are neighbours
            new[bounds[:-1][np.diff(bounds) > 0]] = True
            held.append(f[new])
        docs += batch.num_rows
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
    rows = [(-1, [0], [docs])]
    for k, part in enumerate(total.reshape(-1, COUNTED)):
        at = np.flatnonzero(part)
        if len(at):
            rows.append((k, at, part[at]))
    blocks, places, counts = zip(*rows, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["block", "at", "n"])


def _summed(batches):
    """The sum of all rows of a block; a task holds one array for each of its blocks, which FEATURE_BITS bounds."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        at, n = batch.column("at"), batch.column("n")
        for k, block in enumerate(batch.column("block").to_pylist()):
            np.add.at(total.setdefault(block, np.zeros(COUNTED, dtype=np.int64)), at[k].values.to_numpy(), n[k].values.to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "n"])


def idf_of(counts: np.ndarray, docs: int) -> np.ndarray:
    """idf by number of documents: IDF_FLOOR + (1 - IDF_FLOOR) log(N / df) / log(1 / RARE), 1 at most. A corpus of fewer
    than 1 / RARE documents has its single ones as rarest."""
    if docs < 2:
        return np.ones(len(counts), dtype=np.float32)
    share = np.log(docs / np.maximum(counts, 1)) / math.log(min(1 / RARE, docs))
    return (IDF_FLOOR + (1 - IDF_FLOOR) * np.minimum(share, 1)).astype(np.float32)


def document_idf(docs: DataFrame) -> np.ndarray:
    """The idf of each hashed feature, of the exact number of all documents that hold it.

    One pass over the texts; sums of counts don't depend on how rows are dealt out. What a task sends, what the driver
    gets and what is broadcast is one table of 2^FEATURE_BITS numbers at most, whatever the corpus. Shingles of one
    feature share its weight, so a rare one has a common one's idf with probability (common ones) / 2^FEATURE_BITS.
    """
    rows = docs.select("text").mapInArrow(_counted, "block int, at array<int>, n array<long>")
    total, n = np.zeros(((1 << FEATURE_BITS) // COUNTED, COUNTED), dtype=np.int64), 0
    for r in rows.repartition("block").mapInArrow(_summed, "block int, n binary").collect():
        got = np.frombuffer(r.n, dtype=np.int64)
        if r.block < 0:
            n = int(got[0])
        else:
            total[r.block] = got
    return idf_of(total.reshape(-1), n)


class Weights:
    """idf of any shingle by the table of its features."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def __call__(self, own: np.ndarray) -> np.ndarray:
        return self.idf[features_of(own)].astype(np.float64)


# --- improved consistent weighted sampling --------------------------------------------------------------------------


class Sampler:
    """Samples (shingle, t) with P(two texts agree) = their weighted Jaccard similarity.

    Of each shingle and sample number k, r and c ~ Gamma(2, 1) and beta ~ U(0, 1) are read by 16 hash bits from a
    fixed table; t = floor(ln w / r + beta), ln y = r (t - beta), and the smallest ln a = ln c - ln y - r wins. The
    table is sorted by ln a at w = 1, the weight of nearly all shingles, where a plain minimum of hashes so finds the
    winner; other weights are computed and ranked in the same order, as far as ln a >= ln c - r - ln w doesn't already
    lose to the plain minimum. Further hash bits break ties, the last 8 hold t.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 20):
        rng = np.random.default_rng(seed)
        r, c, beta = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
        order = np.argsort(np.log(c) + r * beta - r, kind="stable")
        self.r, self.log_c, self.beta = r[order], np.log(c)[order], beta[order]
        self.at_one = self.log_c + self.r * self.beta - self.r
        self.least, self.bar = self.log_c - self.r, np.append(self.at_one[:-1], np.inf) + 1e-9
        self.xors = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        self.factors = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * _U(2) + _U(1)

    def __call__(self, own: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of samples for each text; own and weight: shingles of all texts, one text after the other."""
        other = np.flatnonzero(weight != 1)
        text, log_w = np.searchsorted(starts, other, "right") - 1, np.log(weight[other])
        out, x, y = np.empty((len(starts), len(self.xors)), dtype=np.uint64), np.empty_like(own), np.empty_like(own)
        for k, (a, b) in enumerate(zip(self.xors, self.factors, strict=True)):
            np.bitwise_xor(own, a, out=x)
            x *= b
            x ^= np.right_shift(x, _U(31), out=y)
            x *= _U(0xD6E8FEB86659FD93)
            theirs = x[other]
            x[other] = _U(0xFFFFFFFFFFFFFFFF)
            key = (np.minimum.reduceat(x, starts) & _U(0xFFFFFFFFFFFFFF00)) | _U(128)
            if len(other):
                at, bar = (theirs >> _U(48)).astype(np.int64), self.bar[(key >> _U(48)).astype(np.int64)]
                may = np.flatnonzero(self.least[at] - log_w <= bar[text])
                at, z, w = at[may], theirs[may], log_w[may]
                r, beta = self.r[at], self.beta[at]
                t = np.floor(w / r + beta)
                rank = np.minimum(np.searchsorted(self.at_one, self.log_c[at] - r * (t - beta) - r), 65535).astype(np.uint64)
                np.minimum.at(key, text[may], (rank << _U(48)) | (z & _U(0x0000FFFFFFFFFF00)) | (np.clip(t, -127, 127) + 128).astype(np.uint64))
            out[:, k] = key
        return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of samples."""
    grouped = samples.reshape(len(samples), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for j in range(ROWS):
        h = _mixed(h * _U(_POWERS[1]) + grouped[:, :, j])
    return h


def _signed(weights):
    """Batches of (doc_id, text) to (doc_id, content, n, bands, samples in 16 bits each)."""

    def run(batches):
        sampler, idf = Sampler(), Weights(weights.value)

        for batch in batches:
            for begin, texts in _portions(batch.column(1)):
                own, n, bounds, keys = shingle_sets(texts)
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                bands, brief = [None] * len(texts), [None] * len(texts)
                if len(full):
                    got = sampler(own, idf(own) * n, bounds[:-1][full])
                    short = (got * _U(_POWERS[1]) >> _U(48)).astype("<u2")
                    for i, b, s in zip(full.tolist(), bands_of(got).view(np.int64).tolist(), short, strict=True):
                        bands[i], brief[i] = b, s.tobytes()
                columns = [batch.column(0).slice(begin, len(texts)), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(brief, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "n", "bands", "samples"])

    return run


# --- candidates and components --------------------------------------------------------------------------------------


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes of edges (a, b).

    Alternating large-star and small-star steps; each keeps, of every node's neighbours, only what still tells
    components apart. Minima combine on the map side, and the join that follows meets a plain table on its other side,
    so that a node with very many neighbours is split over tasks. Every step is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(large.distinct(), "large-star")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: no end after {most} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _agreement(batches):
    """Share of equal samples of each row (doc, hub, samples of the two)."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SAMPLES) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1))], ["doc", "hub", "alike"])


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b, alike): edges that connect all texts which share a band and may be alike. reps: doc, bands, samples.
    alike: the share of samples in which a and its hub b agree, -1 where it was not asked.

    In each bucket the text of the smallest hash is hub. A text whose samples say it is NEAR the hub gets an edge to
    it, and one that is CLOSE leaves the bucket. The rest elect the next hub, and what is left after ROUNDS gets edges
    to its hub unasked. As shares of differing samples obey the triangle inequality, two texts of a bucket are only
    lost to each other if one left and fewer than NEAR + 1 - CLOSE = 0.5 of their own samples agree: at a similarity
    of 0.8 with P(Binomial(64, 0.8) < 32) = 2e-8, on top of sharing no band. Exact verification comes later.
    """
    order = F.xxhash64(F.col("doc")).alias("order")
    members = reps.select("doc", order, F.explode("bands").alias("bucket"))
    brief = reps.select("doc", "samples")
    out = None
    for k in range(ROUNDS + 1):
        hubs = materialize(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("order", "doc")).alias("h")).where("n > 1").select("bucket", F.col("h.doc").alias("hub")), "hubs")
        met = materialize(members.join(hubs, "bucket").where("doc <> hub"), "bucket-members")
        pairs = met.select("doc", "hub").distinct()
        if k == ROUNDS:
            return out.union(pairs.select(F.col("doc").alias("a"), F.col("hub").alias("b"), F.lit(-1.0).alias("alike")))
        both = pairs.join(brief, "doc").join(brief.select(F.col("doc").alias("hub"), F.col("samples").alias("other")), "hub")
        judged = materialize(both.select("doc", "hub", "samples", "other").mapInArrow(_agreement, "doc long, hub long, alike double"), "agreement")
        edges = judged.where(F.col("alike") >= NEAR).select(F.col("doc").alias("a"), F.col("hub").alias("b"), "alike")
        out = edges if out is None else out.union(edges)
        far = judged.where(F.col("alike") < CLOSE).select("doc", "hub")
        members = materialize(met.join(far, ["doc", "hub"]).select("doc", "order", "bucket"), "bucket-rest")
        if members.isEmpty():
            break
    return out


# --- exact verification ---------------------------------------------------------------------------------------------


def similarities(left: list, right: list) -> np.ndarray:
    """Weighted Jaccard similarity of each of left with each of right; each is (shingles, counts, idf weights).

    A shingle that occurs t times is t features of its idf weight, so that the sum of minima is a dot product.
    """
    sets = left + right
    levels = [np.repeat(np.arange(len(n)), n) for _, n, _ in sets]
    tf = [np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) for x, (_, n, _) in zip(levels, sets, strict=True)]
    feature = np.concatenate([_mixed(s[x] + t.astype(np.uint64) * _U(_POWERS[1])) for (s, _, _), x, t in zip(sets, levels, tf, strict=True)] or [np.zeros(0, np.uint64)])
    weight = np.concatenate([w[x] for (_, _, w), x in zip(sets, levels, strict=True)] or [np.zeros(0)])
    row = np.repeat(np.arange(len(sets)), [len(x) for x in levels])
    total = np.bincount(row, weight, len(sets))
    _, at, inverse, n = np.unique(feature, return_index=True, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    use = n[inverse] > 1
    row, column, weight = row[use], shared[inverse[use]], weight[use]
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    common, width = np.zeros((len(left), len(right))), min(max(256, 4_000_000 // max(1, len(sets))), max(1, columns))
    for start in range(0, columns, width):
        a, b = np.searchsorted(column, [start, start + width])
        x = np.zeros((len(sets), width))
        x[row[a:b], column[a:b] - start] = np.sqrt(weight[a:b])
        common += x[: len(left)] @ x[len(left) :].T
    return common / np.maximum(total[: len(left), None] + total[None, len(left) :] - common, 1e-300)


def _weighed(group: pa.Table, idf: Weights) -> list:
    """(shingles, counts, idf weights) of each text of a group."""
    out = []
    for part in group.column("text").chunks:
        for _, texts in _portions(part):
            own, n, bounds, _ = shingle_sets(texts)
            out += zip(*[np.split(x, bounds[1:-1]) for x in (own, n, idf(own))], strict=True)
    return out


def _linked(weights, threshold: float):
    """Edges of each group of texts to the smallest id that verified links connect it with inside the group."""

    def run(group: pa.Table) -> pa.Table:
        idf = Weights(weights.value)
        one = bool(group.column("i")[0].as_py() == group.column("j")[0].as_py())
        ids, sides = group.column("doc").to_pylist(), group.column("side").to_pylist()
        sets = _weighed(group, idf)
        a = [k for k, s in enumerate(sides) if s == 0]
        b = a if one else [k for k, s in enumerate(sides) if s == 1]
        parent = list(range(len(ids)))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        if a and b:
            x, y = np.nonzero(similarities([sets[k] for k in a], [sets[k] for k in b]) >= threshold - 1e-9)
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p, q = root(a[p]), root(b[q])
                if p != q:
                    parent[q] = p
        low: dict[int, int] = {}
        for k, doc in enumerate(ids):
            low[root(k)] = min(doc, low.get(root(k), doc))
        edges = [(doc, low[root(k)]) for k, doc in enumerate(ids) if doc != low[root(k)]]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _blocks(total: str, members: str):
    return F.ceil(F.greatest(F.col(total) / BLOCK_SHINGLES, F.col(members) / BLOCK_TEXTS)).cast("int")


def _starred(weights, threshold: float):
    """(doc, hub) of the texts of a block whose similarity with the hub reaches threshold."""

    def run(group: pa.Table) -> pa.Table:
        idf, hub = Weights(weights.value), group.column("root")[0].as_py()
        ids, sides = group.column("doc").to_pylist(), group.column("side").to_pylist()
        sets = _weighed(group, idf)
        spokes, hubs = ([k for k, s in enumerate(sides) if s == x] for x in (1, 0))
        near = (similarities([sets[k] for k in spokes], [sets[k] for k in hubs]) >= threshold - 1e-9).any(axis=1) if spokes and hubs else []
        found = sorted({ids[k] for k, hit in zip(spokes, near, strict=True) if hit})
        return pa.table({"doc": pa.array(found, pa.int64()), "hub": pa.array([hub] * len(found), pa.int64())})

    return run


def star_links(texts: DataFrame, stars: DataFrame, weights, threshold: float) -> DataFrame:
    """(doc, hub) of the pairs of stars (doc, hub, n) whose similarity reaches threshold. The texts of a hub are dealt
    into blocks, each of which meets the hub's text in a task of its own, however many they are."""
    sizes = materialize(stars.groupBy("hub").agg(F.sum("n").alias("total"), F.count("*").alias("members")).select("hub", _blocks("total", "members").alias("blocks")), "star-sizes")
    spokes = stars.join(sizes, "hub").select("doc", F.col("hub").alias("root"), F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("i"), F.lit(1).alias("side"))
    hubs = sizes.select(F.col("hub").alias("doc"), F.col("hub").alias("root"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("side"))
    placed = materialize(spokes.union(hubs), "stars")
    return texts.join(placed, "doc").select("doc", "root", "i", "side", "text").groupBy("root", "i").applyInArrow(_starred(weights, threshold), "doc long, hub long")


def classes_of(docs: DataFrame, links: DataFrame, jumps: int = 3) -> DataFrame:
    """(doc, class) of docs (doc, n): the last hub on the way from hub to hub along links (doc, hub, one for a doc).

    Ways double at each jump; texts whose way is longer are in classes of their own, which costs comparisons and no
    link. Hubs come before their texts in order, so that no way returns.
    """
    now = materialize(docs.select("doc", "n").join(links, "doc", "left").select("doc", "n", F.coalesce("hub", "doc").alias("class")), "classes-0")
    for k in range(jumps):
        ahead = now.select(F.col("doc").alias("class"), F.col("class").alias("last"))
        now = materialize(now.join(ahead, "class").select("doc", "n", F.col("last").alias("class")), f"classes-{k + 1}")
    return now


def group_edges(texts: DataFrame, groups: DataFrame, weights, threshold: float) -> DataFrame:
    """(a, b): edges with the components of all pairs in one group whose similarity reaches threshold and that aren't of
    one class already.

    texts: doc, text; groups: doc, root (the group), n (shingles), class (of texts that are known to be connected).
    A group of one class needs nothing. Else a class larger than a block has blocks of its own, which are not compared
    with each other, and all others share blocks. A task holds two blocks at most, however large the group is.
    """
    of_class = groups.groupBy("root", "class").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    of_class = of_class.withColumn("own", F.when((F.col("total") > BLOCK_SHINGLES) | (F.col("members") > BLOCK_TEXTS), _blocks("total", "members")))
    of_class = materialize(of_class, "group-classes")
    small = F.col("own").isNull()
    pool = of_class.groupBy("root").agg(F.count("*").alias("classes"), F.coalesce(F.sum(F.when(small, F.col("total"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(small, F.col("members"))), F.lit(0)).alias("members"), F.coalesce(F.sum("own"), F.lit(0)).alias("large"))
    pool = materialize(pool.where("classes > 1").select("root", _blocks("total", "members").alias("pool"), "large"), "group-sizes")
    before = Window.partitionBy("root").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    large = of_class.where("own IS NOT NULL").withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int")).select("root", "class", "own", "first")
    dealt = groups.join(pool, "root").join(materialize(large, "large-classes"), ["root", "class"], "left")
    spread = lambda key, n: F.pmod(F.xxhash64(key, F.lit(1)), n).cast("int")
    first, own = F.col("pool") + F.col("first"), F.col("own")
    dealt = dealt.withColumn("block", F.when(own.isNull(), spread("class", F.col("pool"))).otherwise(first + spread("doc", own)))
    others = F.filter(F.sequence(F.lit(0), (F.col("pool") + F.col("large") - 1).cast("int")), lambda o: own.isNull() | (o < first) | (o >= first + own))
    turns = F.transform(others, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (o < F.col("block")).cast("int").alias("side")))
    placed = materialize(dealt.select("doc", "root", F.explode(turns).alias("t")).select("doc", "root", "t.*"), "blocks")
    rows = texts.join(placed, "doc").select("doc", "root", "i", "j", "side", "text")
    return rows.groupBy("root", "i", "j").applyInArrow(_linked(weights, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, kept of every row of docs (doc_id, text): class_id is the smallest doc_id of the class.

    Words are runs of letters, digits and underscores, in lower case; texts of the same words are copies and always
    one class, texts without words among them, null ones included. kept marks a class's smallest doc_id. A row whose
    doc_id is null stays by itself: class_id null, kept true. Rows that repeat a doc_id are one document: alike if any
    of their texts are, and all kept or none. Further columns of docs are not looked at.
    """
    rows = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as kept:
        found = kept(_classes(rows, threshold), "classes")
    alone = rows.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _classes(rows: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, class_id) of every row that has a doc_id.

    Every text is first compared with one candidate hub. What that links is a class already, so that a large group of
    near copies is not compared with itself, and only candidates of different classes count from then on: texts of
    classes that such candidates connect are compared all with all. Copies of a text follow it.
    """
    weights = rows.sparkSession.sparkContext.broadcast(document_idf(rows))
    known = materialize(rows.where("doc_id IS NOT NULL").mapInArrow(_signed(weights), "doc_id long, content binary, n long, bands array<long>, samples binary"), "samples")
    same = known.groupBy("content").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("samples").alias("samples"))
    reps = materialize(same, "texts")
    texts = rows.select(F.col("doc_id").alias("doc"), "text")
    size = materialize(reps.groupBy("doc").agg(F.sum("n").alias("n")), "sizes")
    edges = materialize(candidate_edges(reps.where("n > 0").select("doc", "bands", "samples")), "candidates")
    sure = F.col("alike") >= SURE  # of such hubs the first in order, which most of a large group share; else the most alike
    order = F.when(sure, F.bitwise_not(F.xxhash64("b"))).otherwise(F.lit(0).cast("long"))
    stars = edges.groupBy(F.col("a").alias("doc")).agg(F.max_by("b", F.struct(sure.alias("s"), order.alias("o"), F.col("alike"), F.col("b"))).alias("hub"))
    classes = classes_of(size, materialize(star_links(texts, stars.join(size, "doc"), weights, threshold), "star-links"))

    of = lambda c: classes.select(F.col("doc").alias(c), F.col("class").alias(f"class_{c}"))
    between = lambda e: e.join(of("a"), "a").join(of("b"), "b").where("class_a <> class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
    groups = components(materialize(between(edges.select("a", "b")), "open-candidates")).select(F.col("node").alias("class"), "root")
    members = materialize(classes.join(materialize(groups, "open-classes"), "class").where("n > 0"), "open-members")
    links = materialize(between(materialize(group_edges(texts, members, weights, threshold), "links")), "class-links")

    labelled = known.select("doc_id", "content").join(reps.select("content", "doc"), "content").join(classes.select("doc", "class"), "doc")
    labelled = materialize(labelled.select("doc_id", "class"), "labels")
    twice = materialize(labelled.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi"), "repeated-ids")
    repeats = labelled.join(twice, "doc_id").select(F.col("class").alias("a"), F.col("lo").alias("b"))
    joined = materialize(components(links.union(repeats)), "joined-classes")
    whole = labelled.join(joined, F.col("class") == F.col("node"), "left").select("doc_id", F.coalesce("root", "class").alias("label"))
    whole = materialize(whole, "whole-classes")
    least = materialize(whole.groupBy("label").agg(F.min("doc_id").alias("class_id")), "class-ids")
    return whole.join(least, "label").select("doc_id", "class_id")


def op3_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
