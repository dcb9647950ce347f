"""Target-distribution importance resampling on hashed word runs.

Each document is an array of hashed features. Only bucket totals of the corpus and of the target are shuffled; a
document's weight is an aggregate of its own array over a literal array of gains.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, let, long_array, materialize, numbered, scratch, table

BUCKETS = 10_000
#: What parts words: all of ASCII but digits and letters, after A-Z are lower-cased.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null and empty texts have none. lower() serves texts that are ASCII alone."""
    t = F.coalesce(text, F.lit(""))
    small = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(ascii_lower(t))
    return F.array_remove(F.split(small, SEPARATORS), "")


def features(text: Column, buckets: int = BUCKETS, longest: int = 3) -> Column:
    """A struct of n_words and the array of buckets of all runs of 1 to longest consecutive words, repeats included."""
    bucket = lambda s: (F.crc32(s.cast("binary")) % buckets).cast("short")

    def runs(words: Column, n: int) -> Column:
        run = lambda x, i: F.concat(x, *[y for j in range(1, n) for y in (F.lit(" "), F.get(words, i + j))])
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda x, i: bucket(run(x, i)))

    return let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*[runs(w, n) for n in range(1, longest + 1)]).alias("buckets")))


def bucket_counts(hashed: DataFrame) -> dict[int, int]:
    """Features in each bucket: partial counts combine before the shuffle, and one row a bucket reaches the driver."""
    return {r[0]: r[1] for r in hashed.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln of the ratio of smoothed shares, target over corpus) of each bucket, in doubles."""
    s_all, t_all = float(sum(corpus.values())), float(sum(target.values()))
    ratio = lambda b: (target.get(b, 0) + 1.0) * (s_all + buckets) / ((corpus.get(b, 0) + 1.0) * (t_all + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_features, weight, score, rank: documents drawn without replacement in proportion to exp(weight / 1000).

    score is the weight with Gumbel noise from sha256 of "seed:doc_id" (a null id is written as nothing); of the N rows
    with min_words words or more the floor(percent N / 100) with the highest scores have ranks 1, 2, ..., ties to the
    smaller doc_id (null first), other rows null. Rows that repeat a doc_id are drawn each. Null and empty texts have no
    features, weight 0 and are too short to be drawn; an empty docs gives no rows, an empty target one where all shares
    are equal. Columns of docs beside these four pass through, whatever they are called.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        own = [c for c in docs.columns if c not in ("n_features", "weight", "score", "rank")]
        hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != "text"]).alias("row"), features(F.col("text"), buckets).alias("f"))
        hashed = materialize(hashed.select("row", "f.n_words", "f.buckets"), "bucket-arrays")
        gain = long_array(gains(bucket_counts(hashed), bucket_counts(target.select(features(F.col("text"), buckets)["buckets"].alias("buckets"))), buckets))
        weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
        id_text = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
        u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296
        scored = hashed.select("row", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), (F.col("n_words") >= min_words).alias("fit"), F.floor(-1000 * F.ln(-F.ln(u))).alias("noise"))
        scored = scored.withColumn("score", F.col("weight") + F.col("noise"))
        placed, _ = numbered(scored, "draws", "at", (F.col("fit").desc(), F.col("score").desc(), F.col("row.doc_id").asc_nulls_first()))
        drawn = percent * placed.where("fit").count() // 100
        out = placed.select(*[F.col("row").getField(c).alias(c) for c in own if c != "text"], "n_features", "weight", "score", F.when(F.col("at") < drawn, F.col("at") + 1).alias("rank"))
        return kept(out, "resampled")


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


OP13_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(n, CAST(range(8) AS BIGINT[])),
           lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END) ORDER BY n) AS crc
  FROM range(256) r(n)),
texts AS (SELECT row_number() OVER () AS id, doc_id, text, 0 AS kind FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 1 FROM benchmark),
words AS (
  SELECT id, kind, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM texts),
runs AS (
  SELECT id, kind, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
         || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words),
counted AS (SELECT id, kind, f, count(*) AS n FROM runs GROUP BY id, kind, f),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(hex(f)) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS b
  FROM (SELECT DISTINCT f FROM counted), crc_table),
placed AS (SELECT id, kind, b, n FROM counted JOIN hashed USING (f)),
totals AS (SELECT b, coalesce(sum(n) FILTER (WHERE kind = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0) AS t FROM placed GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM totals) AS DOUBLE) + 10000)
         / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT sum(t) FROM totals) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM totals),
weights AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM placed JOIN gains USING (b) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT x.doc_id, len(x.w) >= 20 AS fit, CAST(coalesce(y.n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(y.weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(y.weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(x.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words x LEFT JOIN weights y USING (id) WHERE kind = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS FIRST) AS place, 5 * (SELECT count(*) FROM scored WHERE fit) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN fit AND place <= drawn THEN place END AS BIGINT) AS rank FROM ranked
"""
