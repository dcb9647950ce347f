"""Language-model scores by a probabilistic suffix tree over words.

Contexts are runs of 1 to `longest` words. One is a state of the tree if its counts of next tokens diverge from those of
its suffix (the context without its first word) by more than their description costs; a token is scored at the longest
suffix of its history that is a state, whose distribution is smoothed by that of the next shorter state, down to
single tokens. Tokens and runs are 64-bit hashes: two of V share one with a probability of V^2 / 2^65.
"""

from __future__ import annotations

import contextlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialize, scratch, table

#: Bytes of text whose hashes are worked out at once, and tokens of a chunk.
SECTION, CHUNK = 1 << 20, 1 << 20
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


#: A random odd number for each byte (A-Z as a-z; none for blanks), and powers of the base for its place in the word.
_LETTER = _mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_LETTER[65:91], _LETTER[_BLANK] = _LETTER[97:123], 0
_POWER = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full((1 << 16) - 1, _BASE))])
END = _mix(np.array([0], dtype=np.uint64))[0]


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in a row, each text's words and its end, and the place where each text begins."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    full = ~_BLANK[data]
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = full[first]
    starts = np.flatnonzero(begins)
    words = np.zeros(len(starts), np.uint64)
    for low in range(0, len(data) if len(starts) else 0, SECTION):
        part = data[low : low + SECTION]
        at = max(0, int(np.searchsorted(starts, low, "right")) - 1)
        inner = starts[at : int(np.searchsorted(starts, low + len(part)))]
        cuts = np.maximum(inner, low) - low
        if not len(inner) or inner[0] > low:  # blanks before the first word count nothing
            if not len(inner):
                continue
            part, cuts, low = part[cuts[0] :], cuts - cuts[0], low + int(cuts[0])
        place = np.arange(low, low + len(part)) - np.repeat(inner, np.diff(np.append(cuts, len(part))))
        value = _LETTER[part] * _POWER[place & 0xFFFF]
        if place.max(initial=0) > 0xFFFF:
            value *= _mix((place >> 16).astype(np.uint64)) | np.uint64(1)
        words[at : at + len(inner)] += np.add.reduceat(value, cuts)
    counts = np.diff(np.searchsorted(starts, offsets))
    texts_before = np.arange(len(counts))
    ends = np.cumsum(counts) + texts_before
    out = np.full(len(words) + len(counts), END)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = _mix(words)
    return out, np.cumsum(counts) - counts + texts_before


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in the sorted keys, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """values at places, 0 where a place is -1."""
    return np.where(places >= 0, values[np.maximum(places, 0)], 0) if len(values) else np.zeros(len(places), values.dtype)


def _joined(runs: np.ndarray, words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose word and the run up to the word before have names, and their keys: run's name, then word's."""
    before = np.empty_like(runs)
    before[1:], before[begins] = runs[:-1], -1
    at = np.flatnonzero((before >= 0) & (words >= 0))
    return at, (before[at].astype(np.uint64) << np.uint64(32)) | words[at].astype(np.uint64)


def run_names(tokens: np.ndarray, begins: np.ndarray, grams: list[np.ndarray]) -> list[np.ndarray]:
    """For each length, the name (place in the sorted keys of that length) of the run that ends at each token, or -1."""
    names = [_place(grams[0], tokens)]
    for keys in grams[1:]:
        at, key = _joined(names[-1], names[0], begins)
        found = np.full(len(tokens), -1)
        found[at] = _place(keys, key)
        names.append(found)
    return names


def _slices(texts: pa.Array):
    """Cuts of texts of about SECTION bytes each, or of one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0), np.int64))
    cuts = np.unique(np.append(np.flatnonzero(np.diff(ends // SECTION)) + 1, [0, len(texts)]))
    return zip(cuts[:-1].tolist(), np.diff(cuts).tolist(), strict=True)


def _chunked(batches):
    """Chunks of whole texts, of about CHUNK tokens: their rows, sizes, and tokens as places in the chunk's vocabulary."""
    held, size = [], 0
    for batch in batches:
        for low, n in _slices(batch.column("text")) if batch.num_rows else ():
            part = batch.slice(low, n)
            tokens, begins = token_hashes(part.column("text"))
            held.append((part.column("row"), part.column("held_out"), tokens, np.diff(np.append(begins, len(tokens)))))
            size += len(tokens)
            if size >= CHUNK:
                yield _chunk(held)
                held, size = [], 0
    if held:
        yield _chunk(held)


def _chunk(held):
    rows, out, tokens, sizes = zip(*held, strict=True)
    rows, out = pa.concat_arrays(rows), pa.concat_arrays(out)
    words, codes = np.unique(np.concatenate(tokens), return_inverse=True)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    sizes = pa.array(np.concatenate(sizes), pa.int64())
    return pa.RecordBatch.from_arrays(
        [one(rows), one(out), one(sizes), pa.array([len(codes)], pa.int64()), pa.array([packed(words)], pa.binary()), pa.array([packed(None, codes)], pa.binary())],
        ["rows", "held_out", "sizes", "size", "words", "codes"],
    )


def packed(keys: np.ndarray | None, *values: np.ndarray) -> bytes:
    """Sorted keys, as differences, and values of 8 bytes each: byte planes, compressed."""
    columns = [*([] if keys is None else [np.diff(keys, prepend=np.uint64(0))]), *values]
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns)
    return np.array([len(columns[0]), len(columns)]).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, keyed: bool = True) -> np.ndarray:
    """The columns of packed, as unsigned integers."""
    n, m = np.frombuffer(data[:16], np.int64)
    planes = np.frombuffer(pa.decompress(data[16:], int(n * m * 8), codec="zstd", asbytes=True), np.uint8)
    out = planes.reshape(m, 8, n).transpose(0, 2, 1).copy().view(np.uint64).reshape(m, n)
    if keyed:
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


class _Runs:
    """The runs of a chunk: for each length (0: single tokens) its sorted keys, the name (place among them) of the run that
    ends at each token or -1, and, as far as they came back, counts in the whole corpus, ranks among the runs of a bucket that
    occur twice, and whether this chunk owns it.

    Single tokens and pairs are counted at once, then one length at a time: a longer run is asked for if both its parts that
    are one token shorter occur twice.
    """

    def __init__(self, chunk: dict, back: dict):
        words, codes = unpacked(chunk["words"])[0], unpacked(chunk["codes"], False)[0].astype(np.int64)
        self.tokens, sizes = words[codes], np.array(chunk["sizes"], np.int64)
        self.begins, held = np.cumsum(sizes) - sizes, np.array(chunk["held_out"], bool)
        self.train = ~np.repeat(held, sizes)
        self.place = np.arange(len(codes)) - np.repeat(self.begins, sizes)
        self.keys, self.names, self.ranks, self.counts, self.own, self.back = [words], [codes], [], [], [], back
        self.hash, self.asked = self.tokens, np.ones(len(codes), bool)
        self._known(0)

    def _known(self, k: int):
        if k in self.back:
            rank, got = np.concatenate(self.back[k], axis=1) if self.back[k] else np.zeros((2, 0), np.uint64)
            self.ranks.append(rank)
            self.counts.append((got >> np.uint64(1)).astype(np.int64)), self.own.append((got & np.uint64(1)).astype(bool))

    def longer(self):
        k = len(self.keys)
        if k > 1:
            self.asked = _at(self.counts[k - 1], self.names[k - 1]) >= 2
        asked, key = self.asked & (self.place >= k), self.tokens.copy()
        asked[1:] &= self.asked[:-1]
        key[1:] += self.hash[:-1] * _ODD
        self.asked, self.hash = asked, key
        at = np.flatnonzero(asked)
        keys, inverse = np.unique(key[at], return_inverse=True)
        names = np.full(len(key), -1)
        names[at] = inverse
        self.keys.append(keys), self.names.append(names)
        self._known(k)

    def counted(self, k: int) -> np.ndarray:
        named = self.names[k] >= 0
        return np.bincount(self.names[k][named], self.train[named], len(self.keys[k])).astype(np.int64)


def _sent(chunk: int, k: int, buckets: int, keys: np.ndarray, names: np.ndarray, *values: np.ndarray):
    """Rows that bring names (the keys, or their ranks) and values to the buckets of the keys, which are ranges."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    which, low = np.unique(bucket, return_index=True)
    cuts = [slice(*x) for x in itertools.pairwise([*low, len(keys)])]
    return [(k, int(b), chunk, packed(names[c], *[v[c] for v in values])) for b, c in zip(which, cuts, strict=True)]


_SENT = "k int, bucket long, chunk long, data binary"


def _batch(rows, names=("k", "bucket", "chunk", "data"), types=(pa.int32(), pa.int64(), pa.int64(), pa.binary())):
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def _read(chunk: pa.Table, back: pa.Table) -> tuple[dict, dict, dict]:
    """The chunk, and what came back to it, in the order of its keys: counts by length, and states."""
    counts, states = {}, {}
    for r in back.sort_by([("k", "ascending"), ("bucket", "ascending")]).to_pylist():
        if r["fit"]:
            states.setdefault(r["k"], []).append(unpacked(r["data"], False)[0])
        else:
            counts.setdefault(r["k"], []).append(unpacked(r["data"]))
    return {c: chunk.column(c)[0].as_py() for c in chunk.column_names if c != "rows"}, counts, states


def _asked(chunk: dict, counts: dict, buckets: int, lengths: range):
    """A chunk's runs of these lengths with their counts in training texts; those of shorter ones came back before."""
    runs, rows = _Runs(chunk, {k: counts.get(k, []) for k in range(lengths.start)}), []
    for k in range(lengths.stop):
        if k:
            runs.longer()
        if k in lengths:
            rows += _sent(chunk["chunk"], k, buckets, runs.keys[k], runs.keys[k], runs.counted(k))
    return _batch(rows)


def _asking_first(buckets: int, lengths: range):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _asked(batch.slice(i, 1).to_pylist()[0], {}, buckets, lengths).to_batches()

    return run


def _asking(buckets: int, lengths: range):
    return lambda chunk, back: _asked(*_read(chunk, back)[:2], buckets, lengths)


def _summed(data: pa.Table):
    """Of one bucket: distinct keys, the place of each sent key among them, the sizes of what was sent, and its values."""
    data = data.sort_by("chunk")
    got = [unpacked(x.as_py()) for x in data.column("data")]
    keys, inverse = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
    return data, keys, inverse, np.cumsum([x.shape[1] for x in got])[:-1], [np.concatenate(x) for x in zip(*[x[1:] for x in got], strict=True)]


def _returned(data: pa.Table, values: list[bytes], fit: bool, n: int = 0, v: int = 0):
    columns = [data.column(c).to_pylist() for c in ("k", "bucket", "chunk")]
    rows = [(k, b, c, x, fit, n * (i == 0), v * (i == 0)) for i, (k, b, c, x) in enumerate(zip(*columns, values, strict=True))]
    return _batch(rows, ("k", "bucket", "chunk", "data", "fit", "n", "v"), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()))


_RETURNED = _SENT + ", fit boolean, n long, v long"


def _totals(longest: int):
    """Ranks of runs that may be contexts, and twice each run's count, one more for the first chunk that asked: it owns the run."""

    def run(data):
        return _total(data, data.column("k")[0].as_py() < longest)

    return run


def _total(data, ranked: bool):
    data, keys, inverse, cuts, (n,) = _summed(data)
    total = np.bincount(inverse, n.astype(float), len(keys)).astype(np.int64)
    first = np.full(len(keys), len(inverse))
    np.minimum.at(first, inverse, np.arange(len(inverse)))
    out = total[inverse] * 2
    out[first] += 1
    if data.column("k")[0].as_py():  # runs that occur once are no contexts and no next tokens
        out[total[inverse] < 2] = 0
    ranks = np.cumsum((total >= 2) & ranked, dtype=np.uint64)[inverse]
    sent = [packed(r, x) for r, x in zip(np.split(ranks, cuts), np.split(out, cuts), strict=True)]
    return _returned(data, sent, False, int(total.sum()), int((total > 0).sum()))


def _weighing(buckets: int, longest: int, n: int):
    """Each chunk's contexts with their counts and with what the runs that it owns add to their sums."""

    def run(chunk, back):
        chunk, counts, _ = _read(chunk, back)
        runs, rows = _Runs(chunk, {k: counts.get(k, []) for k in range(longest + 1)}), []
        above = np.full(len(runs.keys[0]), n)
        for k in range(1, longest + 1):
            runs.longer()
            count, total, size = runs.counts[k], runs.counts[k - 1], len(runs.keys[k - 1])
            at = np.zeros(len(count), np.int64)
            named = np.flatnonzero(runs.names[k] >= 0)
            at[runs.names[k][named]] = named
            shorter = runs.counts[k - 1][runs.names[k - 1][at]]
            own = np.flatnonzero(runs.own[k] & (count >= 2))
            context, c, s = runs.names[k - 1][at[own] - 1], count[own], shorter[own]
            sums = [np.bincount(context, x, size).astype(np.int64) for x in (np.ones(len(own)), c, s)]
            values = [*[np.where(runs.own[k - 1], x, 0) for x in (total, above)], *sums, np.bincount(context, c * np.log(c / s), size).astype(float)]
            kept = total >= 2
            rows += _sent(chunk["chunk"], k - 1, buckets, *[x[kept] for x in (runs.keys[k - 1], runs.ranks[k - 1], *values)])
            above = shorter
        return _batch(rows)

    return run


def _states(data):
    """For each context the count left to tokens without their own, and one more; 0 if it is no state."""
    data, keys, inverse, cuts, values = _summed(data)
    values = [x.astype(float) for x in values[:-1]] + [values[-1].view(float)]
    total, above, kinds, own, shorter, gain = [np.bincount(inverse, x, len(keys)) for x in values]
    left = np.where(is_state(total, gain + own * np.log(above / total), kinds, own, shorter / above), total - own + 1, 0).astype(np.uint64)[inverse]
    return _returned(data, [packed(None, x) for x in np.split(left, cuts)], True)


def is_state(total, gain, kinds, own, share) -> np.ndarray:
    """Whether contexts of these counts are states, by sums over their counted next tokens: count times log of the
    probability's ratio to that after the suffix; one each; counts; probabilities after the suffix."""
    rest, rest_share = total - own, 1 - share
    # where rounding leaves no share to the rest, the shorter context has none either
    gain = gain + np.where((rest > 0) & (rest_share > 1e-12), rest * np.log(np.maximum(rest, 1) / total / np.maximum(rest_share, 1e-12)), 0)
    return (kinds > 0) & (gain > kinds * np.log(total) / 2)


def _scored(longest: int, n: int, v: int, prior: float):
    def run(chunk, back):
        rows = pc.list_flatten(chunk.column("rows"))
        chunk, counts, states = _read(chunk, back)
        runs = _Runs(chunk, {k: counts.get(k, []) for k in range(longest + 1)})
        for _ in range(longest):
            runs.longer()
        single = runs.counts[0][runs.names[0]]
        alone = (single + 1) / float(n + v + 1)
        m = {"counts": runs.counts, "states": [], "left": [], "prior": prior}
        for k in range(longest):
            left = np.zeros(len(runs.keys[k]))
            if k in states:
                left[runs.counts[k] >= 2] = np.concatenate(states[k])
            m["states"].append(left > 0), m["left"].append(left - 1)
        names = [np.where(_at(c, x) >= 2, x, -1) for c, x in zip(runs.counts, runs.names, strict=True)]
        p = state_probabilities(names, runs.begins, alone, m)
        total = lambda x: pa.array(np.add.reduceat(x, runs.begins))
        values = [pa.array(chunk["held_out"], pa.bool_()), pa.array(chunk["sizes"], pa.int64()), total((single > 0).astype(np.int64)), total(np.log10(alone)), total(np.log10(p))]
        return pa.table([rows, *values], names=["row", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def state_probabilities(names: list[np.ndarray], begins: np.ndarray, alone: np.ndarray, m: dict) -> np.ndarray:
    """Probability of each token at its state: from single tokens up, each state among its suffixes mixes its counts with
    the shorter state's distribution. A token without a count anywhere only gathers the factors of what is left to it."""
    p = alone.copy()
    for k in range(1, len(names)):
        before = np.empty_like(names[k - 1])
        before[1:], before[begins] = names[k - 1][:-1], -1
        at = np.flatnonzero(_at(m["states"][k - 1], before))
        context = before[at]
        p[at] = (_at(m["counts"][k], names[k][at]) + (m["prior"] + m["left"][k - 1][context]) * p[at]) / (m["counts"][k - 1][context] + m["prior"])
    return p


def fitted(grams: list[np.ndarray], counts: list[np.ndarray], n: int, v: int, prior: float) -> dict:
    """The tree of counted runs that one process holds, as score builds it of tables: for each context whether it is a state, and the count left to tokens without their own.

    The divergence of a context is its count times the Kullback-Leibler divergence of its next tokens from its suffix's,
    all those without counts of their own as one, so that it is never overstated; it must exceed ln(count) / 2 for each
    counted token.
    """
    states, left, suffix = [], [], np.zeros(len(grams[0]), np.int64)
    for k in range(1, len(grams)):
        keys = grams[k]
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # the run without its first word: for two words the second alone, else the same word behind the context's suffix
        shorter = word if k == 1 else _place(grams[k - 1], (suffix[context].astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))
        total = counts[k - 1].astype(float)
        above = np.full(len(total), float(n)) if k == 1 else counts[k - 2][suffix].astype(float)
        share = counts[k - 1][shorter] / above[context]
        size = len(total)
        own = np.bincount(context, counts[k], size)
        gain = np.bincount(context, counts[k] * np.log(counts[k] / total[context] / share), size).astype(float)
        states.append(is_state(total, gain, np.bincount(context, minlength=size), own, np.bincount(context, share, size)))
        left.append(total - own)
        suffix = shorter
    return {"grams": grams, "counts": counts, "states": states, "left": left, "below": float(n + v + 1), "prior": prior}


@contextlib.contextmanager
def _tidy(spark):
    """A block in which Spark drops a query's shuffle files as it ends: each step is written, none is needed again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def score(docs: DataFrame, mod: int = 7, fold: int = 2, longest: int = 3, prior: float = 1.0) -> DataFrame:
    """docs without text, with held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with crc32(doc_id as text) % mod = fold are held out, all others train. Tokens are words between ASCII blanks, A-Z
    lower-cased, and one end for each text; null texts have the end alone, a null doc_id counts as "". base_score adds
    log10((c + 1) / (N + V + 1)) over tokens, score the tree's log10 probabilities; both are 0 < p < 1 for tokens never
    seen. Rows that repeat train and are scored each; no rows at all or none to train give N = V = 0. Columns of docs
    beside these pass through, whatever they are called.

    Every run of up to longest + 1 tokens that occurs twice in training texts may be a context or a next token, however
    large the corpus: nothing of the model is broadcast or passes through the driver. Texts are cut into chunks; each
    sends its distinct runs to the buckets of their hashes and gets their counts in the corpus back, from three tokens on
    one length at a time, then contexts with what they gain, and gets back which are states.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept, _tidy(spark):
        added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        own = [c for c in docs.columns if c != "text" and c not in added]
        held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == fold
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), held_out.alias("held_out"), F.col("text"))
        shape = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), *T.StructType.fromDDL("held_out array<boolean>, sizes array<long>, size long, words binary, codes binary")])
        chunks = materialize(rows.mapInArrow(_chunked, shape).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
        buckets = max(1, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // CHUNK))
        bare, back = chunks.drop("rows", "size"), spark.createDataFrame([], _RETURNED)
        met = lambda left, f, to: left.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(f, to)
        n = v = 0
        for lengths in (range(min(2, longest + 1)), *(range(k, k + 1) for k in range(2, longest + 1))):
            k = lengths.start
            asked = met(bare, _asking(buckets, lengths), _SENT) if k else bare.mapInArrow(_asking_first(buckets, lengths), _SENT)
            counts = materialize(asked.groupBy("k", "bucket").applyInArrow(_totals(longest), _RETURNED), "run-counts")
            back = back.unionByName(counts) if k else counts
            if not k:
                n, v = (x or 0 for x in counts.where("k = 0").agg(F.sum("n"), F.sum("v")).first())
        weighed = met(bare, _weighing(buckets, longest, n), _SENT)
        back = back.unionByName(materialize(weighed.groupBy("k", "bucket").applyInArrow(_states, _RETURNED), "states"))
        shape = T.StructType([rows.schema["row"], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base_score double, score double")])
        out = met(chunks.drop("size"), _scored(longest, n, v, prior), shape)
        names = ["held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"]
        return kept(out.select(*[F.col("row").getField(c).alias(c) for c in own], *names), "lm-scores")


def op12_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
