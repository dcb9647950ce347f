"""Token counts with a digest cache: only texts whose digest has no stored count are encoded, once each."""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_path, materialize, table

#: Distinct chunks whose counts a Python worker holds at most; beyond it, it starts anew.
CHUNKS = 300_000
#: The model writes a space as this sign, and no piece of it has the sign after another character (see ChunkCounts).
SPACE = "▁"
_CHUNK = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")


class ChunkCounts(dict):
    """Token count of a chunk: a run of spaces with the other characters behind it, up to the next space.

    No piece of the model holds a space after another character, so that no merge crosses from one chunk into the
    next and a text's count is the sum over its chunks. The library itself puts one space before what it encodes,
    which stands for the chunk's first. That holds for a model whose normaliser has no map of characters, adds that
    one space, keeps all others and writes them as the sign; of any other, and of one with such pieces, texts are
    encoded whole.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.whole = not plain or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or [len(self.model.encode(x)) for x in ("a b", "a  b", " a", "a\tb")] != [sum(self[c] for c in _CHUNK.findall(" " + x)) for x in ("a b", "a  b", " a", "a\tb")]

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self.model.encode(chunk[1:])) if len(chunk) > 1 else 1
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.whole:
            return len(self.model.encode(text))
        if len(self) > CHUNKS:
            self.clear()
        return sum(map(self.__getitem__, _CHUNK.findall(" " + text)))


def _counted(model):
    def run(batches):
        counts = ChunkCounts(model.value)
        for batch in batches:
            n = [counts.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return run


def _stored(spark, path: str, version: str) -> DataFrame | None:
    try:
        return spark.read.schema("version string, content binary, n_tokens long, run string").parquet(path).where(F.col("version") == version).select("content", "n_tokens", "run")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cached (the count was stored before this call) of every row of docs.

    The key of a count is the SHA-256 of the normalised text (null counts as empty) with the SHA-256 of the tokenizer's
    file. Normalised is what the tokenizer itself does first: a space and the sign it writes for it are one, where its
    normaliser does no more (see ChunkCounts), and else nothing. n_bytes is that of the text as it is. Digests alone are joined with the stored counts; of each missing digest one row's text is encoded and its count
    appended to cache_path, a Parquet table that later calls share. All counts are then read from the cache. A cache
    that holds a digest twice, as after two runs at once, is read as if it held it once. Rows that repeat a doc_id or
    have none are counted each. Further columns of docs are not looked at.
    """
    spark = docs.sparkSession
    blob = open(model_path, "rb").read()
    version, model = hashlib.sha256(blob).hexdigest(), spark.sparkContext.broadcast(blob)
    text, run = F.coalesce("text", F.lit("")), uuid.uuid4().hex
    same_text = text if ChunkCounts(blob).whole else F.translate(text, SPACE, " ")
    keyed = docs.select("doc_id", F.unhex(F.sha2(same_text.cast("binary"), 256)).alias("content"), same_text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    digests = materialize(keyed.select("doc_id", "content", "n_bytes"), "digests")
    known = _stored(spark, cache_path, version)
    unknown = digests if known is None else digests.join(known.select("content").distinct(), "content", "left_anti")
    chosen = materialize(unknown.groupBy("content").agg(F.min(F.struct("doc_id")).alias("first")).select("first.doc_id", "content"), "missing")
    mine = chosen.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("content") == F.col("__content"))
    misses = keyed.join(mine, same, "left_semi").select("content", "text")
    counts = misses.mapInArrow(_counted(model), "content binary, n_tokens long")
    counts.select(F.lit(version).alias("version"), "content", "n_tokens", F.lit(run).alias("run")).write.mode("append").parquet(cache_path)
    before = F.max(~F.col("run").eqNullSafe(run)).alias("cached")
    lookup = materialize(_stored(spark, cache_path, version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"), before), "counts")
    return digests.join(lookup, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    # a cache of its own, so that a run's figures are those of all the work, whatever ran before; users name one that lasts
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), P.path("piece_bpe_32k.model"), fresh_path(spark, "token-cache"))
