import hashlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from tests.llm.test_decontaminate import plain_tiles
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_classes
from tests.llm.test_near_dup import corpus, plain_idf
from tidemark.llm.bpe_monoid import MonoidBPE
from tidemark.llm.near_dup import words_of
from tidemark.llm.quality_gam import features, train


def leaks(text, bench):
    """Whether half of a test item's words lie in tiles."""
    doc, items = words_of(text), [words_of(t) for _, t in bench]
    return any(sum(n for *_, n in plain_tiles(doc, w, min(5, len(w)))) >= 0.5 * len(w) for w in items)


def test_run_equals_brute_force(spark, tmp_path):
    rows = [t or "" for t in corpus(9, 30)]
    rows += ["noise ### $$$ " * 30 + str(i) for i in range(30)] + ["a test passage that must never leak into the data " + t for t in rows[:5]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(i, int("###" not in t), 0) for i, t in enumerate(rows)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    bench = [(1, "a test passage that must never leak into the data"), (2, "quite another passage of seven or more words")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = train(df, marks)
    ids = [i for i, t in enumerate(rows) if model.score(features(t)[None])[0] >= 0.7]
    texts = [rows[i] for i in ids]
    texts = [x[2] for _, x in sorted(brute_lines(texts).items())]
    classes = brute_classes(texts, plain_idf(texts))
    kept = [(ids[i], texts[i]) for i, c in classes.items() if i == c]
    bpe = MonoidBPE(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    want = {}
    for i, t in kept:
        if not leaks(t, bench):
            raw = np.array(bpe.leaf.encode_ordinary(t), "<u4").tobytes()
            want[i] = (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want and 20 < len(want) < len(rows) - 40


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1, "more")], "doc_id long, text string, lang string, source string, n_chars int, block string")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            assert stage(spark, df, str(tmp_path)).dtypes == docs.dtypes


def test_stages_on_nulls_repeated_ids_and_a_very_long_text(spark, tmp_path):
    """Null and empty texts pass as empty ones, rows of one id each by their own text, a long text as a whole."""
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000)) + "\nthe same last line of two"
    rows = [(1, None), (None, None), (2, ""), (3, long), (3, "another text of the same id that nobody else has at all"), (4, "short text\nthe same last line of two"), (5, "one two three four five six seven eight")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(9, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    out = {}
    for name in ("line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"):
        docs = stage[name](spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = sorted((str(r[0]), len(r.text or "") if "text" in docs.columns else r.n_tokens) for r in docs.collect())
    lines = out["line dedup"]
    assert sorted(i for i, _ in lines) == ["1", "2", "3", "3", "4", "5", "None"]
    assert ("3", len(long)) in lines and ("4", len("short text")) in lines and ("1", 0) in lines
    near = {i for i, _ in out["MinHash near-dedup"]}
    assert {"3", "4", "5", "None"} <= near and ("3", len(long)) in out["MinHash near-dedup"]
    assert {i for i, _ in out["benchmark decontamination"]} == near - {"5"}
    assert len(out["byte-level BPE"]) == len(out["benchmark decontamination"]) and max(n for _, n in out["byte-level BPE"]) > 60_000
