import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.cases import docs, texts
from tidemark.llm.bpe_monoid import MonoidBPE, code

RANKS = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()


def odd_texts():
    rnd = random.Random(5)
    alphabet = ["a", "b", "'s", "'", "re", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "́", "漢", "1", "２", "#", "!", "😀", "A"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 400))) for _ in range(400)]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 40, 2048])
def test_equals_the_library(leaf):
    bpe = MonoidBPE(RANKS, P.PATTERN, leaf)
    for t in odd_texts() + [x[:3000] for x in texts() if x] + ["a" * 700, " " * 300 + "x", "ab" * 200 + "\n" * 100]:
        ids = bpe.encode(t)
        assert ids == bpe.leaf.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_operator(spark):
    bpe = MonoidBPE(RANKS, P.PATTERN)
    rows = texts()
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in code(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    hashed = {r.doc_id: (r.ids, r.decoded) for r in code(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True).collect()}
    for i, t in enumerate(rows):
        ids = bpe.leaf.encode_ordinary(t or "")
        assert got[i] == (len(ids), np.asarray(ids, "<u4").tobytes(), (t or "").encode())
        assert hashed[i] == tuple(hashlib.sha256(x).hexdigest() for x in got[i][1:])
    assert code(docs(spark, []).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_other_patterns_make_one_leaf():
    bpe = MonoidBPE(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), r"(?s:.{1,7})", 16)
    text = "some words and  more of them\n" * 20
    assert bpe.encode(text) == bpe.leaf.encode_ordinary(text)
