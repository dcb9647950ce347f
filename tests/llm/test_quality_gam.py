import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import docs, texts
from tidemark.llm.quality_gam import FEATURES, PairwiseGAM, features, keep_good, op9_quality_gam, score, train


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = PairwiseGAM().fit(x[:3000], y[:3000])
    assert (0, 1) in gam.chosen or (1, 0) in gam.chosen
    assert ((gam.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


def test_degenerate_fits():
    assert 0 <= PairwiseGAM().fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3)))[0] <= 1
    assert PairwiseGAM().fit(np.ones((50, 3)), np.ones(50)).score(np.ones((1, 3)))[0] > 0.9


def test_held_out_accuracy_and_fold(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeinrst"), 5))
    rows = [" ".join(word() for _ in range(60)) if i % 3 else " ".join(word() + "###" for _ in range(60)) for i in range(900)]
    df = docs(spark, rows)
    marks = [(i, int(i % 3 > 0)) for i in range(900)]
    fold = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    flipped = [(i, 1 - q if i in set(fold) else q) for i, q in marks]  # labels of the held-out fold are never read
    model = train(df, spark.createDataFrame(flipped, "doc_id long, quality int"), 400)
    got = {r.doc_id: r.score for r in score(df, model).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(i % 3) for i in fold]) > 0.95
    again = train(df.repartition(5), spark.createDataFrame(flipped, "doc_id long, quality int").repartition(3), 400)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))
    kept = keep_good(df, model).collect()
    assert [f.name for f in keep_good(df, model).schema] == df.columns and {r.doc_id for r in kept} == {i for i, s in got.items() if s >= 0.7}


def test_odd_texts_and_empty_tables(spark):
    assert all(len(features(t)) == len(FEATURES) and np.isfinite(features(t)).all() for t in texts())
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    model = train(docs(spark), none)
    assert all(0 <= r.score <= 1 for r in score(docs(spark), model).collect())
    assert score(docs(spark, []).limit(0), model).collect() == []


def plain_step(gam, g, h):
    """The best split of any part, twice, by trying all of them."""
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + gam.smooth)
    parts = [(0, len(g))]
    for _ in range(gam.leaves - 1):
        tried = [(value(a, k) + value(k, b) - value(a, b), a, b, k) for a, b in parts for k in range(a + 1, b)]
        gain, a, b, k = max(tried, key=lambda x: x[0], default=(0, 0, 0, 0))
        if gain > 1e-9:
            parts = [p for p in parts if p != (a, b)] + [(a, k), (k, b)]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [gam.rate * sum(g[a:b]) / (sum(h[a:b]) + gam.smooth)] * (b - a)
    return out


def test_trees_take_the_best_splits():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 30):
        for _ in range(20):
            g, h = rng.normal(size=n), rng.random(n)
            gam = PairwiseGAM()
            assert np.allclose(gam._step(g, h), plain_step(gam, list(g), list(h)))


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    gam = PairwiseGAM(rounds=20, pairs=2, pair_rounds=5).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, got in zip(x[:50], gam.score(x[:50]), strict=True):
        place = lambda cuts, v: sum(v >= c for c in cuts)
        f = gam.base + sum(t[place(c, v)] for c, t, v in zip(gam.cuts, gam.tables, row, strict=True))
        f += sum(t[place(gam.pair_cuts[i], row[i]) * (len(gam.pair_cuts[j]) + 1) + place(gam.pair_cuts[j], row[j])] for (i, j), t in zip(gam.chosen, gam.pair_tables, strict=True))
        assert abs(got - 1 / (1 + np.exp(-f))) < 1e-12


def test_fit_lowers_the_loss_and_repeats_itself():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 3))
    y = (rng.random(900) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    loss = lambda m: float(-(y * np.log(m.score(x)) + (1 - y) * np.log(1 - m.score(x))).mean())
    few, many, again = (PairwiseGAM(rounds=n).fit(x, y) for n in (1, 60, 60))
    assert loss(many) < loss(few) < 0.7 and all(np.array_equal(a, b) for a, b in zip(many.tables, again.tables, strict=True))


def test_query_equals_scores_text_by_text(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [" ".join("".join(rng.choice(list("aeinrst"), 5)) + ("###" if i % 4 == 0 else "") for _ in range(40)) for i in range(200)] + [None, "", "x"]
    docs(spark, rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    model = train(docs(spark, rows), marks)
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in op9_quality_gam(spark, str(tmp_path)).collect()}
    for i, t in enumerate(rows):
        p = float(model.score(features(t)[None])[0])
        assert got[i] == (zlib.crc32(str(i).encode()) % 4 == 2, p, int(p >= 0.7))
    assert len(got) == len(rows)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "good words here", 0.5, 1)] * 2 + [(2, "###", 0.5, 0)], "doc_id long, text string, score double, good int").withColumn("__id", F.lit("x"))
    model = train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert len({r.score for r in score(df, model).where("doc_id = 1").collect()}) == 1 and score(df, model).count() == 3
    assert keep_good(df, model).columns == df.columns
