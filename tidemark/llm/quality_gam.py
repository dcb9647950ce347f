"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree at a time, feature after feature and round after round, at a small rate; what the
trees add up to is one lookup table for each feature and, fitted after them on what remains, one for each chosen pair.
A score is the logistic of a sum of table entries: vectorised bin additions, with no tree left to walk.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import table

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 12_000
FEATURES = [
    "log_words", "word_length", "symbols", "digits", "capitals", "non_ascii", "punctuation", "exclaims", "pipes", "line_ends",
    "distinct_words", "dup_lines", "line_words", "longest_word", "other_controls", "top_word",
]
_SYMBOLS, _PUNCT = b"#*$%&<>@^~_=+{}[]\\/", b".,;:?'\"()-"


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars)] = 1
    return m


_DIGITS, _UPPER = bytes(range(48, 58)), bytes(range(65, 91))
_WEIGHTS = np.stack([_mask(x) for x in (_SYMBOLS, _DIGITS, _UPPER, bytes(range(128, 256)), _PUNCT, b"!", b"|", b"\n", bytes([*range(9), *range(14, 32), 127]))], axis=1)


def features(text: str | None) -> np.ndarray:
    """The features of one text; null and empty texts give zeros."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256) @ _WEIGHTS
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    chars = max(1, sum(map(len, words)))
    held: dict[str, int] = {}
    for w in words:
        held[w] = held.get(w, 0) + 1
    out[:] = (
        math.log1p(len(words)), chars / n, *(counts[:7] / chars), counts[7] / n, len(held) / n / (1 / (1 + math.log(n))),
        1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), math.log1p(max(map(len, words), default=0)),
        counts[8] / chars, max(held.values(), default=0) / n,
    )
    return out


@dataclass
class PairwiseGAM:
    """fit on features and 0/1 labels; score gives P(label 1). Constant, equal or empty labels give the base rate."""

    bins: int = 32
    pair_bins: int = 8
    rounds: int = 150
    pairs: int = 6
    pair_rounds: int = 60
    rate: float = 0.1
    leaves: int = 3
    smooth: float = 4.0
    base: float = 0.0
    cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    chosen: list = field(default_factory=list)
    pair_cuts: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    @staticmethod
    def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(column) else np.zeros(0)

    def _step(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One shallow tree over ordered bins: up to leaves - 1 best splits by gain, Newton values in its leaves."""
        gain = lambda a, b: (g[a:b].sum() ** 2) / (h[a:b].sum() + self.smooth)
        parts = [(0, len(g))]
        for _ in range(self.leaves - 1):
            best = (1e-9, None, None)
            for a, b in parts:
                if b - a < 2:
                    continue
                cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                tg, th = g[a:b].sum(), h[a:b].sum()
                gains = cg**2 / (ch + self.smooth) + (tg - cg) ** 2 / (th - ch + self.smooth) - gain(a, b)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], (a, b), a + k + 1)
            if best[1] is None:
                break
            parts.remove(best[1])
            parts += [(best[1][0], best[2]), (best[2], best[1][1])]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = self.rate * g[a:b].sum() / (h[a:b].sum() + self.smooth)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGAM:
        n, k = x.shape
        rate = min(max((y.sum() + 1) / (n + 2), 1e-6), 1 - 1e-6)
        self.base = math.log(rate / (1 - rate))
        self.cuts = [self._cuts(x[:, j], self.bins) for j in range(k)]
        at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        f = np.full(n, self.base)
        for _ in range(self.rounds if n else 0):
            for j in range(k):
                p = 1 / (1 + np.exp(-f))
                size = len(self.tables[j])
                step = self._step(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size))
                self.tables[j] += step
                f += step[at[j]]
        coarse = [self._cuts(x[:, j], self.pair_bins) for j in range(k)]
        cells = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]
        p = 1 / (1 + np.exp(-f))
        ranked = []
        for i in range(k):
            for j in range(i):
                width = len(coarse[j]) + 1
                cell, size = cells[i] * width + cells[j], (len(coarse[i]) + 1) * width
                g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
                ranked.append((float((g**2 / (h + self.smooth)).sum()), i, j, cell, size))
        self.chosen, self.pair_cuts, self.pair_tables = [], coarse, []
        best = sorted(ranked, key=lambda r: (-r[0], r[1], r[2]))[: self.pairs] if n else []
        self.chosen, self.pair_tables = [(i, j) for _, i, j, _, _ in best], [np.zeros(s) for *_, s in best]
        for _ in range(self.pair_rounds):
            for m, (_, _i, _j, cell, size) in enumerate(best):
                p = 1 / (1 + np.exp(-f))
                g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
                rank = np.argsort(g / (h + self.smooth), kind="stable")  # a shallow tree over the cells in order of their mean
                step = np.empty(size)
                step[rank] = self._step(g[rank], h[rank])
                self.pair_tables[m] += step
                f += step[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            f += t[np.searchsorted(c, x[:, j], "right")]
        for (i, j), t in zip(self.chosen, self.pair_tables, strict=True):
            f += t[np.searchsorted(self.pair_cuts[i], x[:, i], "right") * (len(self.pair_cuts[j]) + 1) + np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-f))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _held_out(c):
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featured(batches):
    for batch in batches:
        rows = [features(t.as_py()).tolist() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["good", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> PairwiseGAM:
    """A model fitted on at most sample labelled rows outside the held-out fold.

    Which ones, a hash of the id says, so that any size of input and any partitioning gives a fair draw; only their ids
    (bounded by sample) are broadcast to pick their texts, and only their features go to the driver. Where labels
    differ for one id, the smaller counts; null labels and ids are left out. Rows that repeat a doc_id count each. Of
    docs only doc_id and text, of labels only doc_id and quality are looked at.
    """
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("good"))
    picked = [(r.doc_id, r.good) for r in marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    spark = docs.sparkSession
    few = spark.createDataFrame(picked, "__id long, good int")
    mine = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("good", "text")
    rows = mine.mapInArrow(_featured, "good int, x array<double>").collect()
    rows.sort(key=lambda r: (r.good, r.x))  # the fit doesn't depend on the order in which rows arrive
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return PairwiseGAM().fit(x, np.array([float(r.good > 0) for r in rows]))


def _scored(model):
    def run(batches):
        gam = model.value
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gam.score(x), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: PairwiseGAM) -> DataFrame:
    """doc_id and score (0 to 1, null and empty texts too) of every row of docs (doc_id, text), repeated ones each.
    Further columns of docs are not looked at, whatever they are called."""
    return docs.select("doc_id", "text").mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def keep_good(docs: DataFrame, model: PairwiseGAM, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores threshold or more, with all their columns, whatever they are called. Null texts
    score as empty ones; rows that repeat a doc_id, or have none, are judged each by their own text."""
    at, cut, shared = docs.columns.index("text"), threshold, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(x) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_gam(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
