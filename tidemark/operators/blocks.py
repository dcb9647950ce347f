"""Cuts of time, so that a key with very many rows is many tasks: each block is a window of its own and starts from what
the blocks before it hand over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Blocks:
    """Blocks 0, 1, ... of numbers from first on, cut at bounds: block k holds what is at or over k bounds."""

    first: float
    bounds: tuple[float, ...]

    def of(self, at: Column) -> Column:
        """The block of a number, by halving; null for null."""

        def inside(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(at < self.bounds[middle], inside(low, middle)).otherwise(inside(middle + 1, high))

        return F.when(at.isNotNull(), inside(0, len(self.bounds)))

    def start(self, block: Column) -> Column:
        """The number at which a block begins."""
        return F.get(F.array(*[F.lit(float(x)) for x in (self.first, *self.bounds)]), block)


def number_of(df: DataFrame, at: str) -> Column:
    """A column as a number that keeps its order, for times as for numbers."""
    kind = df.schema[at].dataType.typeName()
    return F.unix_micros(F.col(at).cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else F.col(at).cast("double")


def blocks(df: DataFrame, at: str, n: int | None = None, widest: float | None = None) -> Blocks:
    """About n blocks with equally many rows of df (by an approximate quantile sketch), none wider than widest. The driver
    holds the bounds alone; equal numbers are never parted. Unless n is given, there are two for each core, 16 to 1,024:
    as many tasks as a key with all of the rows can use."""
    x, n = number_of(df, at), n or min(1024, max(16, 2 * df.sparkSession.sparkContext.defaultParallelism))
    low, high, cuts = df.agg(F.min(x), F.max(x), F.percentile_approx(x, [k / n for k in range(1, n)], 2000)).first()
    if low is None:
        return Blocks(0.0, ())
    ends = sorted({c for c in cuts if c > low})
    if widest is not None:
        edges, more = [low, *ends, high], []
        for a, b in zip(edges, edges[1:], strict=False):
            parts = int((b - a) // widest) + 1
            more += [a + (b - a) * k / parts for k in range(1, parts)]
        ends = sorted({*ends, *more})
    return Blocks(low, tuple(ends))
