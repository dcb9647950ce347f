import public_tokenizers as P
import sentencepiece

from tests.llm.cases import docs, texts
from tests.llm.test_bpe_monoid import odd_texts
from tidemark.llm import token_counts
from tidemark.llm.token_counts import ChunkCounts, count_tokens

MODEL = P.path("piece_bpe_32k.model")
ODD = ["▁", "a▁b", "▁ ▁a ", " ", "  ", "a ", "a  ", " a", "<s> x </s>", "<unk>", "a\x00b", "▁▁▁"]


def test_chunks_equal_the_library():
    sp, counts = sentencepiece.SentencePieceProcessor(model_file=MODEL), ChunkCounts(open(MODEL, "rb").read())
    assert not counts.whole
    for t in ODD + odd_texts() + [x or "" for x in texts()]:
        assert counts.count(t) == len(sp.encode(t)), repr(t)


def test_normalised_texts_share_a_count(spark, tmp_path):
    rows = ["a b", "a▁b", "a▁b", " x▁ y"]
    out = {r.doc_id: r for r in count_tokens(docs(spark, rows), MODEL, f"file://{tmp_path}/c").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [(out[i].n_tokens, out[i].n_bytes) for i in range(4)] == [(len(sp.encode(t)), len(t.encode())) for t in rows]
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == 2


def test_a_model_with_a_map_of_characters_is_encoded_whole():
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    m.normalizer_spec.remove_extra_whitespaces = True
    counts = ChunkCounts(m.SerializeToString())
    assert counts.whole and counts.count("a  b ") == counts.count("a b")


def test_hits_are_reported(spark, tmp_path):
    cache = f"file://{tmp_path}/hits"
    first = count_tokens(docs(spark, ["a", "b", "a"]), MODEL, cache).collect()
    again = {r.doc_id: r.cached for r in count_tokens(docs(spark, ["a", "c", "a", None]), MODEL, cache).collect()}
    assert not any(r.cached for r in first) and again == {0: True, 1: False, 2: True, 3: False}


def test_operator_and_cache(spark, tmp_path, monkeypatch):
    sp, rows = sentencepiece.SentencePieceProcessor(model_file=MODEL), texts()
    want = {i: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in enumerate(rows)}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs(spark, rows), MODEL, cache, 100).collect()}
        assert got == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in rows})
    spark.read.parquet(cache).limit(3).write.mode("append").parquet(cache + "2")
    count_tokens(docs(spark, rows), MODEL, cache + "2", 100)
    assert spark.read.parquet(cache + "2").count() == len({t or "" for t in rows})


def test_empty_and_repeated(spark, tmp_path):
    assert count_tokens(docs(spark, []).limit(0), MODEL, f"file://{tmp_path}/a").collect() == []
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x y"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.n_tokens) for r in count_tokens(df, MODEL, f"file://{tmp_path}/b").collect()) == [(-1, 0), (-1, 2), (1, 2), (1, 2)]
    assert token_counts.CHUNKS > 0
