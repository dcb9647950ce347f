import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import docs, texts
from tests.llm.test_bpe_monoid import odd_texts
from tidemark.llm.token_files import PieceIds, pack, read_range, read_tokens, unpack, write_block, write_tokens

SPEC = P.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=900), st.integers(0, 900), st.integers(0, 900))
def test_round_trip(ids, a, b):
    ids = np.array(ids, dtype=np.uint64)
    words, escaped, _ = pack(ids)
    assert (unpack(words, escaped, len(ids)) == ids).all()
    assert (read_range(write_block([1], [len(ids)], ids), a, b) == ids[a:b]).all()


def test_ranges_over_many_offsets():
    ids = np.random.default_rng(0).integers(0, 50000, 20000).astype(np.uint64)
    ids[::777] = 2**62 + 5
    payload = write_block([1, None], [len(ids), 0], ids)
    for a, b in ((0, 20000), (5000, 5001), (7, 19993), (19999, 20000), (1536, 2048)):
        assert (read_range(payload, a, b) == ids[a:b]).all()
    assert len(pack(np.zeros(1000, np.uint64))[0]) == 5  # 240 zeros a word


def test_pieces_equal_the_library():
    tokenizer, ids = Tokenizer.from_file(SPEC), PieceIds(open(SPEC, encoding="utf-8").read())
    assert ids.known
    for t in odd_texts() + [x or "" for x in texts()] + ["a<|endoftext|>b <|startoftext|>", "Σας ΣΑΣ ΟΔΟΣ", " ́a é", " x y"]:
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_operator(spark, tmp_path):
    tokenizer, rows = Tokenizer.from_file(SPEC), texts(1, 200)
    write_tokens(docs(spark, rows).repartition(7), SPEC, f"file://{tmp_path}/t")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, f"file://{tmp_path}/t").collect()}
    start, want = 0, {}
    for i, t in enumerate(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_empty_null_and_repeated_ids(spark, tmp_path):
    write_tokens(docs(spark, []).limit(0), SPEC, f"file://{tmp_path}/e")
    assert read_tokens(spark, f"file://{tmp_path}/e").collect() == []
    write_tokens(spark.createDataFrame([(1, "b"), (1, "a"), (None, "x")], "doc_id long, text string"), SPEC, f"file://{tmp_path}/r")
    assert sorted((r.start, r.doc_id) for r in read_tokens(spark, f"file://{tmp_path}/r").collect()) == [(0, None), (2, 1), (4, 1)]
