"""Change-only histories of lines: change detection, tombstones, latest state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GONE = "gone"


def all_equal(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of all columns."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def changes(df: DataFrame, keys: list[str], order: list[str], tracked: list[str]) -> DataFrame:
    """Rows that start a line or differ from the line's row before in a tracked column (nulls equal nulls).

    Equal to comparing with the last row written: skipped rows equal it. One shuffle by the line's key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(*tracked)).over(w)
    out = df.withColumn("__before", before)
    same = all_equal([F.col(c) for c in tracked], [F.col(f"__before.{c}") for c in tracked])
    return out.where(F.col("__before").isNull() | ~same).drop("__before")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each line, as an aggregate that combines before the shuffle (a window would move all rows)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def of_source(prefix: str, source: str = "source") -> Column:
    """Whether a source begins with prefix, in upper or lower case of A-Z alike."""
    small = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.startswith(small(F.col(source)), small(F.lit(prefix)))


def open_lines(df: DataFrame, keys: list[str], order: list[str], status: str = "status", source_prefix: str = "") -> DataFrame:
    """Latest rows but tombstones; a null status is not one. A prefix takes the sources that begin with it, as those of
    an aggregator do that has one for each book."""
    mine = df.where(of_source(source_prefix)) if source_prefix else df
    return latest(mine, keys, order).where(~F.col(status).eqNullSafe(GONE))


def poll_index(polls: DataFrame, source: str = "source", at: str = "captured_at") -> DataFrame:
    """(source, at, pi): successful polls of each source, numbered from 1. A poll that failed isn't among them, so that
    what it didn't see isn't taken for pulled."""
    w = Window.partitionBy(source).orderBy(at)
    return polls.select(source, at).distinct().withColumn("pi", F.row_number().over(w).cast("long"))


def history(quotes: DataFrame, polls: DataFrame, key: str = "line_key", source: str = "source", at: str = "captured_at", tracked: list[str] | None = None, cleared: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """All rows that a recorder writes: changed quotes, and a tombstone in the first poll that no longer sees a line.

    quotes: one row for each line and poll, or several with a tie-break in order (the last counts); polls: (source,
    at) of successful polls. A tombstone carries the line's identity, nulls in cleared, and status gone; a line that
    returns is written even unchanged, as its row before is a tombstone.
    """
    tracked = tracked or ["price", "status"]
    cleared = cleared if cleared is not None else ["price"]
    order = order or [at]
    indexed = latest(quotes, [source, key, at], order).join(poll_index(polls, source, at), [source, at])
    line = Window.partitionBy(source, key).orderBy("pi")
    seen = indexed.withColumns({"__pp": F.lag("pi").over(line), "__nx": F.lead("pi").over(line), "__pv": F.lag(F.struct(*tracked)).over(line)})
    same = all_equal([F.col(c) for c in tracked], [F.col(f"__pv.{c}") for c in tracked])
    written = seen.where(F.col("__pp").isNull() | (F.col("pi") > F.col("__pp") + 1) | ~same).select(*quotes.columns)
    after = poll_index(polls, source, at).select(F.col(source), (F.col("pi") - 1).alias("pi"), F.col(at).alias("__at"))
    lost = seen.where(F.col("__nx").isNull() | (F.col("__nx") > F.col("pi") + 1)).join(after, [source, "pi"])
    value = {at: F.col("__at"), "status": F.lit(GONE), **{c: F.lit(None).cast(quotes.schema[c].dataType) for c in cleared}}
    return written.union(lost.select(*[value.get(c, F.col(c)).alias(c) for c in quotes.columns]))


def append_changes(stored: DataFrame, quotes: DataFrame, keys: list[str], tracked: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(written, skipped): rows of a poll that differ from the latest stored row of their line, and the others."""
    known = latest(stored, keys, order).select(*keys, F.struct(*tracked).alias("__last"))
    both = quotes.join(known, keys, "left")
    same = F.col("__last").isNotNull() & all_equal([F.col(c) for c in tracked], [F.col(f"__last.{c}") for c in tracked])
    return both.where(~same).drop("__last"), both.where(same).drop("__last")


def tombstones(stored: DataFrame, seen: DataFrame, keys: list[str], order: list[str], at: Column, cleared: list[str]) -> DataFrame:
    """Rows for the open lines of stored that seen, one whole successful poll, doesn't hold."""
    lost = open_lines(stored, keys, order).join(seen.select(*keys).distinct(), keys, "left_anti")
    value = {"captured_at": at, "status": F.lit(GONE), **{c: F.lit(None).cast(stored.schema[c].dataType) for c in cleared}}
    return lost.select(*[value.get(c, F.col(c)).alias(c) for c in stored.columns])


def consecutive_distinct(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, moves: how often the non-null value changed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.where(F.col(value).isNotNull()).select(*keys, *[c for c in order if c not in keys], value)
    moved = rows.withColumn("__was", F.lag(value).over(w))
    return moved.groupBy(*keys).agg(F.count_if(F.col("__was").isNotNull() & (F.col("__was") != F.col(value))).cast("long").alias("moves"))
