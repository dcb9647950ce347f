"""Each registered query over small tables: names and types of its columns, one row for each row of its table."""

import random

import pytest
import public_tokenizers as P
import sentencepiece

from tests.llm.cases import texts
from tidemark.llm import registry

COLUMNS = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_near_dup": "doc_id bigint, class_id bigint, kept boolean",
    "op4_bpe_monoid": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_decontaminate": "doc_id bigint, contaminated boolean, items array<bigint>",
    "op7_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_quality_gam": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_suffix_tree": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op13_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root, rnd = str(tmp_path_factory.mktemp("sf")), random.Random(1)
    rows = texts(7, 25)
    rows += [" ".join(f"w{rnd.randint(0, 400)}" for _ in range(80)) + (" ### $$$" * 9 if i % 4 == 0 else "") for i in range(60)]
    rows += [rows[-1], rows[-2] + " more", "it holds " + "one two three four five six seven"]
    docs = spark.createDataFrame([(i, t, ["en", None][i % 2], "s", len(t or ""), "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, stratum string, n_words int")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    urls = ["http://a.example.com/en/7", "http://b.net/de/1", None, "x", "http://c.info/"]
    spark.createDataFrame([(i, u, '<a href="http://b.net/">b</a>') for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    turns = [(c, t, "user", f"turn {t} of {c % 2}") for c in range(7) for t in range(c % 4 + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


def test_all_are_registered():
    assert sorted(registry.QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = [tuple(c.rsplit(" ", 1)) for c in COLUMNS[name].split(", ")]
    assert df.dtypes[: len(want)] == want
    key, table = ("page_id", "pages") if name == "op2_url_filter" else ("doc_id", "documents")
    got = df.collect()
    if name == "op11_prefix_trie":
        assert [(r.n_convs, r.parent_conv_id) for r in got if r.depth == 0] == [(7, None)]
        return
    ids = sorted(r[key] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())
    assert sorted(r[key] for r in got) == ids
    by_id = {r[key]: r for r in got}
    if name == "op1_quality_rules":
        assert all(r.kept != r.base_failed for r in got if r.failed_rules == "")
    if name == "op6_decontaminate":
        assert {i for i, r in by_id.items() if r.contaminated} == {ids[-1]}
    if name == "op8_token_counts":
        sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
        assert all(by_id[i].n_tokens == len(sp.encode(t)) and by_id[i].over_limit == (by_id[i].n_tokens > 4096) for i, t in rows.items())
        assert not any(r.cached for r in got)
    if name == "op9_quality_gam":
        import zlib

        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in got)
