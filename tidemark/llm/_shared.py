"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local one on one machine, as in
    tests; on a cluster an error, as tables written there would be lost."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


#: The paths that materialize has written inside each open scratch block.
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: lineage is cut there and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A block whose intermediate tables go when it ends; it gives a materialize for the result, which stays."""
    _OPEN.append([])

    def kept(df: DataFrame, tag: str) -> DataFrame:
        out = materialize(df, tag)
        _OPEN[-1].pop()
        return out

    try:
        yield kept
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for path in _OPEN.pop():
            at = hadoop.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambda variables are bound, not inlined as Catalyst may do with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def long_array(values) -> Column:
    """A literal array of longs; one string is parsed once, when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def numbered(df: DataFrame, tag: str, name: str = "number", order: tuple = ()) -> tuple[DataFrame, int]:
    """df, written, with a dense number from 0 (in the given order, if there is one), and the number of rows.

    An order is a range-partitioned sort, so that no key's rows need fit one task. The written rows hold their place
    inside their part; the driver sees a count for each part alone.
    """
    placed = df.orderBy(*order) if order else df
    rows = materialize(placed.withColumn("__at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__at", 33)
    counts = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    number = F.get(long_array(before), part.cast("int")) + F.col("__at").bitwiseAND((1 << 33) - 1) if before else F.lit(None).cast("long")
    return rows.withColumn(name, number).drop("__at"), total
