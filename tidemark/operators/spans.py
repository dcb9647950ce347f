"""Interval algebra on change-only histories. Spans are half-open [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def open_spans(df: DataFrame, keys: list[str], order: list[str], at: str, until: Column, status: str = "status", value: str = "open") -> DataFrame:
    """keys, start, end: spans over which a status holds. A row's status lasts until the next row; what is still open
    ends at until, if that is later than its start. Rows of one time can give spans of no length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    on = F.coalesce(F.col(status) == value, F.lit(False))
    rows = df.select(*keys, *[c for c in dict.fromkeys([at, *order]) if c not in keys], on.alias("__on")).withColumn("__was", F.lag("__on").over(w))
    edges = rows.where(F.col("__on") != F.coalesce("__was", F.lit(False)))  # only changes are left, so the next row is the end
    ends = edges.withColumn("__end", F.lead(at).over(w)).where("__on")
    last = F.when(until > F.col(at), until)
    return ends.select(*keys, F.col(at).alias("start"), F.coalesce("__end", last).alias("end")).where(F.col("end").isNotNull())


def merge_spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: the union of spans; those of no length go, touching ones join."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    top = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("__top").isNull() | (F.col("start") > F.col("__top")), 1).otherwise(0)
    islands = df.where("end > start").withColumn("__top", top).withColumn("__new", new).withColumn("__k", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__k")


def overlap(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(end, hi) - F.greatest(start, lo), F.lit(0))


def coverage(spans: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """windows' columns (keys, lo, hi) with overlap and coverage, the share of the window that spans cover: null for a
    window without length. Spans are merged first, so that nothing counts twice."""
    merged = merge_spans(spans, keys)
    both = windows.join(merged, keys, "left")
    got = F.sum(F.when(F.col("start").isNotNull(), overlap(F.col("start"), F.col("end"), F.col("lo"), F.col("hi"))).otherwise(0))  # least and greatest pass nulls over
    out = both.groupBy(*windows.columns).agg(got.alias("overlap"))
    return out.withColumn("coverage", F.when(F.col("hi") > F.col("lo"), F.col("overlap") / (F.col("hi") - F.col("lo"))))


def gaps(spans: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: what spans leave open of each window (keys, lo, hi)."""
    clipped = windows.join(merge_spans(spans, keys), keys).select(*keys, "lo", "hi", F.greatest("start", "lo").alias("s"), F.least("end", "hi").alias("e")).where("e > s")
    edge = clipped.select(*keys, "lo", "hi", "s", "e").union(windows.select(*keys, "lo", "hi", F.col("hi").alias("s"), F.col("hi").alias("e")))
    w = Window.partitionBy(*keys, "lo", "hi").orderBy("s", "e")
    return edge.withColumn("start", F.coalesce(F.lag("e").over(w), F.col("lo"))).select(*keys, "start", F.col("s").alias("end")).where("end > start")


def period_report(rows: DataFrame, periods: DataFrame, keys: list[str], draft_s: int = 600) -> DataFrame:
    """One row for each of periods (keys, lo, hi: the gap before a map and its start; until: the history's end) with the
    metrics of its line's rows (keys, at, seq, status, price, lim, cutoff).

    The draft window is the last draft_s seconds of the gap. pulls are open spans that end inside the gap, pulled the
    seconds from there to the next opening (or the start); values at the start are those of the last row before it.
    """
    bounded = rows.join(periods, keys).where("at < hi")
    facts = bounded.groupBy(*keys, "lo", "hi").agg(
        F.min("at").alias("first_seen"), F.max_by("cutoff", F.struct("at", "seq")).alias("cutoff_at_start"),
        F.max_by("price", F.struct("at", "seq")).alias("last_price"), F.max_by("lim", F.struct("at", "seq")).alias("last_limit"), F.count("*").cast("long").alias("observed"),
    )
    moves = _moves(bounded.where("at >= lo"), keys)
    spans = _spans(rows, periods, keys)
    wide = coverage(spans, periods.select(*keys, "lo", "hi"), keys).select(*keys, "lo", "hi", F.col("coverage").alias("gap_coverage"))
    draft = periods.select(*keys, "lo", "hi").withColumns({"dlo": F.greatest(F.col("hi") - draft_s, F.col("lo"))})
    near = coverage(spans, draft.select(*keys, F.col("dlo").alias("lo"), "hi"), keys).select(*keys, F.col("lo").alias("dlo"), "hi", F.col("coverage").alias("draft_coverage"))
    ends = periods.select(*keys, "lo", "hi").join(merge_spans(spans, keys), keys, "left")
    inside = (F.col("end") > F.col("lo")) & (F.col("end") < F.col("hi"))
    pulls = ends.groupBy(*keys, "lo", "hi").agg(
        F.count_if(inside).cast("long").alias("pulls"), F.coalesce(F.max((F.col("start") <= F.col("hi")) & (F.col("hi") < F.col("end"))), F.lit(False)).alias("open_at_start"),
        F.max(F.when(F.col("end") <= F.col("hi"), F.col("end"))).alias("last_close"),
    )
    pulled = gaps(spans, periods.select(*keys, "lo", "hi"), keys)
    after = pulled.join(periods.select(*keys, "lo", "hi"), keys).where("start > lo AND end <= hi").groupBy(*keys, "lo", "hi").agg(F.sum(F.col("end") - F.col("start")).alias("pulled_s"))
    out = draft.join(facts, [*keys, "lo", "hi"], "left").join(moves, keys, "left").join(wide, [*keys, "lo", "hi"], "left").join(near, [*keys, "dlo", "hi"], "left").join(pulls, [*keys, "lo", "hi"], "left").join(after, [*keys, "lo", "hi"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        *keys, "lo", "hi", "first_seen", F.coalesce("moves", zero).alias("cutoff_moves"), "cutoff_at_start", "gap_coverage", "draft_coverage", F.coalesce("pulls", zero).alias("pulls"),
        F.coalesce("pulled_s", zero).alias("pulled_s"), "open_at_start", "last_close", "last_price", "last_limit", F.coalesce("observed", zero).alias("observed"),
    )


def _moves(rows: DataFrame, keys: list[str]) -> DataFrame:
    from .history import consecutive_distinct

    return consecutive_distinct(rows, keys, ["at", "seq"], "cutoff")


def _spans(rows: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    until = periods.groupBy(*keys).agg(F.max("until").alias("__until"))
    w = rows.join(until, keys)
    return open_spans(w.withColumn("until", F.col("__until")), [*keys, "until"], ["at", "seq"], "at", F.col("until")).select(*keys, "start", "end")


def summarise(report: DataFrame, by: list[str], good: float = 0.9, fair: float = 0.5) -> DataFrame:
    """Observed periods only: number, median gap coverage, shares covered good or more and open at the start, and a
    verdict on the share: yes, partly or no."""
    seen = report.where("observed > 0")
    out = seen.groupBy(*by).agg(
        F.count("*").cast("long").alias("n"), F.median("gap_coverage").alias("median_coverage"), F.avg(F.when(F.col("gap_coverage") >= good, 1.0).otherwise(0.0)).alias("share_good"),
        F.avg(F.when(F.col("open_at_start"), 1.0).otherwise(0.0)).alias("share_open"),
    )
    return out.withColumn("verdict", F.when(F.col("share_good") >= good, "yes").when(F.col("share_good") >= fair, "partly").otherwise("no"))
