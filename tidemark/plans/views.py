"""The driver's tables in the shape of the model, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir) -> DataFrame:
    """Line histories: seq, line_key, t (microseconds), status, price."""
    status = F.when(F.col("event_type").isin("view", "click"), "open").when(F.col("event_type") == "purchase", "gone").otherwise("closed")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("line_key"), epoch_micros("ts").alias("t"), status.alias("status"), (1 + F.col("value") / 100).alias("price"))


LINES = """lines AS (
  SELECT event_id AS seq, user_id AS line_key, epoch_us(ts) AS t, 1e0 + value / 100e0 AS price,
         CASE WHEN event_type IN ('view', 'click') THEN 'open' WHEN event_type = 'purchase' THEN 'gone' ELSE 'closed' END AS status
  FROM events)"""


def maps(spark, sf_dir) -> DataFrame:
    """Decided maps: match_id, start_time, a, b, win, league, series_id, series_type, duration."""
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("match_id"), start.alias("start_time"), (F.col("o_custkey") % 40).alias("a"), (40 + k % 40).alias("b"), (F.col("o_orderstatus") == "F").cast("int").alias("win"),
        F.col("o_orderpriority").alias("league"), F.col("o_custkey").alias("series_id"), (k % 4).cast("int").alias("series_type"), (1200 + k % 1800).alias("duration"),
    )


MAPS = """maps AS (
  SELECT o_orderkey AS match_id, epoch_us(o_orderdate) // 1000000 AS start_time, o_custkey % 40 AS a, 40 + o_orderkey % 40 AS b,
         CAST(o_orderstatus = 'F' AS INTEGER) AS win, o_orderpriority AS league, o_custkey AS series_id,
         CAST(o_orderkey % 4 AS INTEGER) AS series_type, 1200 + o_orderkey % 1800 AS duration
  FROM orders)"""


def picks(spark, sf_dir) -> DataFrame:
    """Draft events: match_id, ord, hero, side, is_pick, account; one for each (match_id, ord)."""
    value = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    one = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(value).alias("v"))
    return one.select(
        F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("ord"), (F.col("v.l_partkey") % 127).cast("int").alias("hero"), (F.col("v.l_suppkey") % 2).cast("int").alias("side"),
        (F.col("v.l_returnflag") != "N").cast("int").alias("is_pick"), F.col("v.l_suppkey").alias("account"),
    )


PICKS = """picks AS (
  SELECT l_orderkey AS match_id, l_linenumber AS ord, CAST(l_partkey % 127 AS INTEGER) AS hero, CAST(l_suppkey % 2 AS INTEGER) AS side,
         CAST(l_returnflag <> 'N' AS INTEGER) AS is_pick, l_suppkey AS account
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS k FROM lineitem) WHERE k = 1)"""


def books(spark, sf_dir) -> DataFrame:
    """Two-way books: match_id, odds_a, odds_b."""
    k = F.col("match_id")
    return maps(spark, sf_dir).select("match_id", (1.05 + (k % 97) / 20).alias("odds_a"), (1.1 + (k % 89) / 25).alias("odds_b"))


BOOKS = MAPS + """, books AS (
  SELECT match_id, 105e-2 + (match_id % 97) / 20e0 AS odds_a, 11e-1 + (match_id % 89) / 25e0 AS odds_b FROM maps)"""
