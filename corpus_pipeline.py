"""A corpus pipeline of training-data operators; each stage works on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Null texts count as
empty; a document whose doc_id is null passes the comparing stages by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_monoid, decontaminate, line_dedup, near_dup, quality_gam
from tidemark.llm._shared import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labelled rows, scores 0.7 or more."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_gam.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id."""
    found = near_dup.near_duplicates(docs)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 by byte-level BPE."""
    import public_tokenizers as P

    out = bpe_monoid.code(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("byte-level BPE", encoded)]

#: The fitted classifier, sampling and BPE can't be put into SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
