"""Sinks: merges on primary keys, archives, JSONL records, reports. Files are immutable: a merge gives the new table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import day_of
from .shared import delete, materialize


def upsert_replace(stored: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Whole rows of new replace those of their key; within new the last by seq wins (without seq, rows of a key are
    taken in the order of all their columns)."""
    order = [seq] if seq else [c for c in new.columns if c not in keys]
    rest = [c for c in stored.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return stored.join(last, keys, "left_anti").select(*stored.columns).union(last.select(*stored.columns))


def upsert_coalesce(stored: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Non-null values of new win, nulls never clobber; within new the last non-null value by seq."""
    rest = [c for c in stored.columns if c not in keys]
    have = [c for c in rest if c in new.columns]
    order = F.col(seq) if seq else F.lit(0)
    folded = new.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, F.col(c)))).alias(f"__{c}") for c in have])
    both = stored.join(folded, keys, "full_outer")
    return both.select(*[F.col(c) if c in keys else (F.coalesce(f"__{c}", c) if c in have else F.col(c)).alias(c) for c in stored.columns])


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Rows of new whose key isn't there yet, the first by seq of each key, after those of stored."""
    order = [seq] if seq else [c for c in new.columns if c not in keys]
    rest = [c for c in stored.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return stored.union(first.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def with_ids(rows: DataFrame, after: int, order: list[str]) -> DataFrame:
    """rows with a surrogate id counted on from after, in order. Numbers come from a sort by ranges and each range's
    offset, so that no single task holds all rows; only one count for each range goes to the driver."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, after
    for part in sorted(sizes):
        offsets[part], total = total, total + sizes[part]
    if not offsets:
        return rows.select(F.lit(None).cast("long").alias("id"), *rows.columns)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("__part"))
    w = Window.partitionBy("__part").orderBy(*order)
    return ranged.select((base + F.row_number().over(w)).cast("long").alias("id"), *rows.columns)


def archive(payloads: DataFrame, root: str) -> None:
    """Raw JSON payloads (source, captured_at, payload) as gzip text under source, UTC day and time, one to a line, for
    readers.parent_links. Line ends between the tokens of a payload become spaces."""
    rows = payloads.select("source", day_of(F.col("captured_at")).alias("day"), "captured_at", F.regexp_replace("payload", "[\r\n]+", " ").alias("value"))
    rows.write.mode("append").partitionBy("source", "day", "captured_at").option("compression", "gzip").text(root)


ARCHIVED = "source string, day string, captured_at long, payload string"


def archived(spark: SparkSession, root: str, source: str) -> DataFrame:
    """ARCHIVED rows of a source that aren't compacted yet; their folders' names give all but the payload."""
    none = spark.createDataFrame([], ARCHIVED)
    try:
        raw = spark.read.option("basePath", root).text(f"{root}/source={source}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    if "day" not in raw.columns:
        return none  # an empty folder
    return raw.select(F.lit(source).alias("source"), F.col("day").cast("string").alias("day"), F.col("captured_at").cast("long").alias("captured_at"), F.col("value").alias("payload"))


def compact(spark: SparkSession, root: str, source: str, before: str) -> list[str]:
    """Turn a source's archived payloads of days before a day into few sorted files; the days that were taken.

    Payloads go to _compacted/payloads, sorted by capture, and what they say of events to _compacted/links (event_id,
    parent_event_id, captured_at), sorted by event; both by source and day, so that a reader meets no other source or
    time. Small files go when both are written; a run that ends in between leaves payloads in both places, which counts
    them twice nowhere, and the next run takes what is new of a day into its files.
    """
    small = f"{root}/source={source}"
    raw = archived(spark, root, source)
    fresh = materialize(raw.where(F.col("day") < before), "payloads")
    days = sorted(r.day for r in fresh.select("day").distinct().collect())
    if not days:
        return []
    known = compacted(spark, root, "payloads", fresh.schema).where((F.col("source") == source) & F.col("day").isin(days))
    rows = materialize(fresh.unionByName(known).distinct(), "payloads")
    seen = F.explode(F.from_json("payload", "matchups array<struct<id: long, parentId: long>>")["matchups"])
    links = rows.select("source", "day", "captured_at", seen.alias("m")).where("m.id IS NOT NULL").select("source", "day", F.col("m.id").cast("string").alias("event_id"), F.col("m.parentId").cast("string").alias("parent_event_id"), "captured_at")
    for name, table, order in (("payloads", rows, ["day", "captured_at"]), ("links", links, ["day", "event_id", "captured_at"])):
        dealt = table.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "day").parquet(f"{root}/_compacted/{name}")
    for day in days:
        delete(spark, f"{small}/day={day}")
    return days


LINKS = "event_id string, parent_event_id string, captured_at long, source string, day string"


def compacted(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """What compact has written of an archive; empty if it never ran."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/_compacted/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def should_archive(written: int, last_archived: int | None, now: int, heartbeat_s: int = 3600) -> bool:
    """Archive on change, or once a heartbeat without one."""
    return written > 0 or last_archived is None or now - last_archived >= heartbeat_s


def write_predictions(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, prob with 6 decimals, nulls left out."""
    out = df.withColumn("prob", F.round("prob", 6))
    out.write.mode("append" if append else "overwrite").option("ignoreNullFields", True).json(path)


def merge_map(stored: DataFrame, new: DataFrame, dry_run: bool = False) -> DataFrame:
    """The event map with new rows replaced by key; rows of events that new lacks stay. dry_run: as stored."""
    return stored if dry_run else upsert_replace(stored, new, ["source", "event_id"])


def odds_view(snapshots: DataFrame, event_map: DataFrame, name: str = "v_odds_series") -> DataFrame:
    """Snapshots with the series and teams of their event, also as a temporary view."""
    side = event_map.select("source", "event_id", "series_id", "is_kills", "parent_event_id", "home_team_id", "away_team_id")
    out = snapshots.join(side, ["source", "event_id"])
    out.createOrReplaceTempView(name)
    return out


def sorted_json(*columns: str) -> Column:
    """The columns as one JSON object with its keys in order, nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))


def markdown(rows: DataFrame) -> str:
    """A small report as a table; null is -."""
    show = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [rows.columns, ["---"] * len(rows.columns), *[[show(v) for v in r] for r in rows.collect()]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def tsv(rows: DataFrame) -> str:
    return "\n".join("\t".join("-" if v is None else str(v) for v in r) for r in [rows.columns, *rows.collect()])
