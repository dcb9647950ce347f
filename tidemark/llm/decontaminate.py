"""Benchmark decontamination by greedy string tiling.

Documents and test items are joined on seeds, runs of min_match words, by their Karp-Rabin fingerprints. For each
document and item that share enough of them, the longest match of words that no tile covers yet becomes a tile, again
and again while one of min_match words is left. Tiles lie anywhere in either text, so reordered passages count in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, numbered, scratch, table
from .near_dup import word_hashes, words_of

MIN_MATCH = 5
COVERAGE = 0.5
#: Bits of the filter that documents' seeds pass before they are joined: its size is fixed, whatever the benchmark's.
FILTER_BITS = 27
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(0, n - 1), base, np.uint64))])[:n]


class Runs:
    """Karp-Rabin fingerprints, modulo 2^64, of all runs of any length of a sequence, from one running sum."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, self.n), dtype=np.uint64)])
        self.scale = _powers(_INVERSE, self.n)

    def of(self, k: int) -> np.ndarray:
        if k > self.n:
            return np.zeros(0, np.uint64)
        f = (self.sums[k:] - self.sums[:-k]) * self.scale[: self.n - k + 1]
        return f ^ (f >> np.uint64(32))


def tiles(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, words) of two sequences of word hashes: the longest match of words that
    no tile covers, of equal ones the first in doc, then in item, while it has k words.

    A length is searched by fingerprints of all its runs, in time and memory of the two lengths; a match of some length
    means one of every shorter length, so that the longest is found by halving, and it never grows from tile to tile.
    """
    runs, used, out = (Runs(doc), Runs(item)), (np.zeros(len(doc), bool), np.zeros(len(item), bool)), []

    def free(side: int, n: int) -> np.ndarray:
        covered = np.concatenate([[0], np.cumsum(used[side])])
        return np.flatnonzero(covered[n:] == covered[:-n]) if n < len(covered) else np.zeros(0, np.int64)

    def first(n: int) -> tuple[int, int] | None:
        at, there = free(0, n), free(1, n)
        if not len(at) or not len(there):
            return None
        known, places = np.unique(runs[1].of(n)[there], return_index=True)
        wanted = runs[0].of(n)[at]
        found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        for x in np.flatnonzero(known[found] == wanted):
            p, t = int(at[x]), int(there[places[found[x]]])
            if (doc[p : p + n] == item[t : t + n]).all():
                return p, t
        return None

    n = min(len(doc), len(item))
    while n >= k:
        match = first(n)
        if match is None:
            low, high = k - 1, n - 1  # a match of low words exists (or low < k), none of more than high
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if first(middle) else (low, middle - 1)
            n = low
            continue
        p, t = match
        out.append((p, t, n))
        used[0][p : p + n] = used[1][t : t + n] = True
    return out


def _seed_length(n_words: int, min_match: int) -> int:
    """Items of fewer than min_match words are one seed as a whole."""
    return min(min_match, n_words)


def _marked(f: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of runs of k words, told from those of other lengths."""
    return (f ^ np.uint64(k * 0x51)) * np.uint64(_BASE)


def _item_seeds(min_match: int):
    """(seed, item, times, k, words) of each distinct seed of items (item, text)."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    k = _seed_length(len(words), min_match)
                    seed, times = np.unique(_marked(Runs(word_hashes(words)).of(k), k), return_counts=True)
                    n = len(seed)
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array([item] * n, pa.int64()), pa.array(times, pa.int64()), pa.array([k] * n, pa.int64()), pa.array([len(words)] * n, pa.int64())], ["seed", "item", "times", "k", "words"])

    return run


def _doc_seeds(shared):
    """(digest, seeds): of each text the distinct seeds that pass the filter; texts with none give no row."""

    def run(batches):
        bits, lengths = shared.value
        for batch in batches:
            digests, seeds = [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if not words:
                    continue
                runs = Runs(word_hashes(words))
                f = np.concatenate([_marked(runs.of(k), k) for k in lengths])
                at = f >> np.uint64(64 - FILTER_BITS)
                f = f[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                if len(f):
                    digests.append(digest)
                    seeds.append(np.unique(f).view(np.int64))
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], ["digest", "seeds"])

    return run


def _tiled(coverage: float, min_match: int):
    """(digest, item_id, share, n_tiles) of the pairs (digest, text, item_id, item_text) with coverage or more."""

    def run(batches):
        for batch in batches:
            out = []
            for digest, text, item_id, item_text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                doc, item = word_hashes(words_of(text)), word_hashes(words_of(item_text))
                got = tiles(doc, item, _seed_length(len(item), min_match))
                share = sum(n for *_, n in got) / len(item)
                if share >= coverage:
                    out.append((digest, item_id, share, len(got)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["digest", "item_id", "share", "n_tiles"])

    return run


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """(digest, items, coverage, n_tiles) of each different text of docs that holds test items.

    Seeds of documents pass a filter of fixed size (2^FILTER_BITS bits, set by the benchmark's seeds) and are joined with
    those of items; pairs whose shared seeds can't cover enough drop out by a count, which combines before the shuffle,
    and only texts of the pairs that are left are read again, once for each different text, and tiled. The benchmark is
    neither collected nor broadcast; a larger one fills the filter and leaves more to the join.
    """
    spark = docs.sparkSession
    named, _ = numbered(benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct(), "items", "item")
    seeds = materialize(named.select("item", "text").mapInArrow(_item_seeds(min_match), "seed long, item long, times long, k long, words long"), "item-seeds")
    bit = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    filled = seeds.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in filled:
        bits[r["at"]] = r["bits"] % (1 << 64)
    lengths = sorted(r.k for r in seeds.select("k").distinct().collect())
    texts = docs.where("text IS NOT NULL").select(digest_of(F.col("text")).alias("digest"), "text")
    if lengths:
        passed = texts.mapInArrow(_doc_seeds(spark.sparkContext.broadcast((bits, lengths))), "digest binary, seeds array<long>")
    else:
        passed = spark.createDataFrame([], "digest binary, seeds array<long>")
    shared = passed.select("digest", F.explode("seeds").alias("seed")).distinct().join(seeds, "seed")
    enough = F.sum("times") * F.max("k") >= coverage * F.max("words")
    pairs = materialize(shared.groupBy("digest", "item").agg(enough.alias("enough")).where("enough").select("digest", "item"), "seeded-pairs")
    wanted = texts.join(pairs.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    whole = wanted.join(pairs, "digest").join(named.select("item", "item_id", F.col("text").alias("item_text")), "item")
    found = whole.select("digest", "text", "item_id", "item_text").mapInArrow(_tiled(coverage, min_match), "digest binary, item_id long, share double, n_tiles long")
    return found.groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("coverage"), F.sum("n_tiles").alias("n_tiles"))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """doc_id, contaminated, items (ids of the test items that the document holds), coverage (the largest share of one's
    words in tiles), n_tiles, of every row of docs.

    Null and empty texts hold nothing; items without words and rows of benchmark with a null are left out; rows that
    repeat an item's id are items each. Rows that repeat a doc_id, or have none, are judged each. Further columns of
    docs are not looked at, whatever they are called.
    """
    with scratch(docs.sparkSession) as kept:
        found = materialize(contaminated_texts(docs.select("text"), benchmark, coverage, min_match), "contaminated")
        out = docs.select("doc_id", digest_of(F.col("text")).alias("digest")).join(found, "digest", "left")
        none = F.array().cast("array<bigint>")
        return kept(out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_tiles", F.lit(0).cast("long")).alias("n_tiles")), "contamination")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns, whatever they are called."""
    with scratch(docs.sparkSession) as kept:
        found = kept(contaminated_texts(docs.select("text"), benchmark, coverage, min_match).select(F.col("digest").alias("__contaminated_text")), "contaminated")
    return docs.join(found, digest_of(docs["text"]) == F.col("__contaminated_text"), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
