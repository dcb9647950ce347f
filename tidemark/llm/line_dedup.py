"""Line deduplication: hash normalised lines, count the documents of each hash, drop repeated lines, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BLANKS, ascii_lower, let, materialize, table


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dropped_positions(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(__id, __th, __drop): for each document that loses lines, their sorted positions from 0.

    A key (see line_key) of at least min_chars code points that stands in at least min_docs documents is dropped
    everywhere but in the smallest doc_id that holds it. Only 128-bit hashes, ids and positions are shuffled, never
    line texts. With min_docs = 2 a key's distinct documents need no counting: two exist just when the smallest and
    the largest id differ, and both combine on the map side, so that a line of a third of all documents makes one row
    per task. Larger thresholds count (hash, doc_id) pairs after a distinct on the pair, which no key can skew.
    """
    key = line_key(F.col("__l"))
    lines = (
        docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"), F.posexplode(lines_of(F.col("text"))).alias("__pos", "__l"))
        .where(F.col("__id").isNotNull() & (F.char_length(key) >= min_chars))
        .select("__id", "__th", "__pos", F.unhex(F.md5(key.cast("binary"))).alias("__h"))
    )
    lines = materialize(lines, "line-hashes")  # 16 bytes a line, so that texts are split and hashed once
    if min_docs <= 2:
        counted = lines.groupBy("__h").agg(F.min("__id").alias("__keeper"), F.max("__id").alias("__last"))
        repeated = counted.where((F.col("__keeper") < F.col("__last")) | F.lit(min_docs < 2))
    else:
        counted = lines.select("__h", "__id").distinct().groupBy("__h").agg(F.min("__id").alias("__keeper"), F.count("*").alias("__n"))
        repeated = counted.where(F.col("__n") >= min_docs)
    hits = lines.join(repeated.select("__h", "__keeper"), "__h").where(F.col("__id") != F.col("__keeper"))
    return hits.groupBy("__id", "__th").agg(F.array_sort(F.collect_set("__pos")).alias("__drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with text cut to the kept lines, joined by \\n, and the added columns n_lines and n_dropped (long).

    Null and empty texts are one empty line. A row whose doc_id is null is never compared and keeps all its lines.
    Rows that repeat a doc_id count as one document; each keeps its own text. Lines of fewer than min_chars code
    points stay. Columns of docs beside text pass through, whatever they are called, as they travel inside one column
    of their own; an own n_lines or n_dropped is replaced.
    """
    drops = dropped_positions(docs.select("doc_id", "text"), min_chars, min_docs)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row")
    joined = docs.select(row).withColumns({"__id": F.col("__row.doc_id"), "__th": F.xxhash64("__row.text")}).join(drops, ["__id", "__th"], "left")
    keep = lambda lines: F.when(F.col("__drop").isNull(), lines).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop")), lambda i: F.get(lines, i))
    )
    out = let(lines_of(F.col("__row.text")), lambda x: F.struct(F.array_join(keep(x), "\n").alias("t"), F.size(x).cast("long").alias("n")))
    cut = joined.withColumn("__out", out)
    return cut.select(
        *[F.col("__out.t").alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in own],
        F.col("__out.n").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT x.doc_id, x.pos, x.line, coalesce(x.doc_id <> r.keeper, false) AS gone
  FROM keyed x LEFT JOIN repeated r ON x.k = r.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
