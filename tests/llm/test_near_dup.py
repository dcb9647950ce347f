import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import docs, texts
from tidemark.llm import near_dup
from tidemark.llm.near_dup import SAMPLES, THRESHOLD, Sampler, Weights, components, content_key, document_idf, near_duplicates, shingles, similarities


def jaccard(a, b, idf):
    x, y = ({s: n * w for s, n, w in zip(*c, idf(c[0]), strict=True)} for c in (a, b))
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(sum(max(x.get(k, 0), y.get(k, 0)) for k in keys), 1e-300)


def plain_idf(rows):
    """idf of shingles by the definition: counts of documents by the first 20 bits of a shingle's hash."""
    held = Counter(f for t in rows for f in {int(s) >> 44 for s in shingles(t)[0]})
    of = lambda s: 0.8 + 0.2 * min(1, math.log(len(rows) / max(1, held[int(s) >> 44])) / math.log(min(1000, len(rows))))
    return lambda own: np.array([of(s) for s in own])


def brute(rows, idf):
    sets, keys, low = [shingles(t) for t in rows], [content_key(t) for t in rows], list(range(len(rows)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if keys[i] == keys[j] or jaccard(sets[i], sets[j], idf) >= THRESHOLD - 1e-9:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: root(i) for i in range(len(rows))}


def corpus(seed=0, n=40):
    rnd = random.Random(seed)
    fresh = lambda k: [f"w{rnd.randint(0, 5000)}" for _ in range(k)]
    passage, rows = fresh(60), [x for x in texts(seed, 10) if x is None or len(x) < 20000]
    for _ in range(n):
        w = fresh(rnd.randint(30, 200))
        rows.append(" ".join(w + passage * rnd.randint(0, 1)))
        for _ in range(rnd.randint(0, 4)):
            v = list(w)
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                v[rnd.randrange(len(v))] = "edit"
            rows.append(" ".join(v) if rnd.random() < 0.7 else " ".join(v).upper() + "!")
    rnd.shuffle(rows)
    return rows


def test_similarities_are_exact():
    rows = [t for t in corpus(3, 15) if t]
    few = shingles(rows[0])[0][:20]
    table = np.ones(1 << 20, dtype=np.float32)
    table[near_dup.features_of(few)] = np.linspace(0.8, 1, len(few))
    idf = Weights(table)
    sets = [(s, n, idf(s)) for s, n in map(shingles, rows)]
    got = similarities(sets[:20], sets[20:40])
    for i in range(20):
        for j in range(20):
            assert abs(got[i, j] - jaccard(shingles(rows[i]), shingles(rows[20 + j]), idf)) < 1e-9


def test_few_texts_are_compared_in_little_memory():
    """The table of shared shingles is as wide as there are such shingles, not as a whole block's."""
    rows = [" ".join(f"w{i * k}" for i in range(200)) for k in (1, 1, 3)]
    sets = [(s, n, np.ones(len(s))) for s, n in map(shingles, rows)]
    tracemalloc.start()
    got = similarities(sets[:1], sets[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [[1, 0]] and peak < 1_000_000


@pytest.mark.parametrize("section", [1 << 16, 1 << 8, 7])
def test_hashes_stand_for_words(section, monkeypatch):
    """Across texts, sections and words longer than those, for ASCII and other letters; 1 to 4 words are one shingle."""
    monkeypatch.setattr(near_dup, "SECTION", section)
    rows = [t for t in corpus(9, 20)] + ["", None, "\u0130stanbul \u03a3\u03a3 \u00e9t\u00e9_1 \u0663 x" * 3, "ab" * 20000 + " ba" * 3, "a", "b a", "a b", "a\u2028b", "\U00010400 x"]
    for part in (rows, [t for t in rows if t and t.isascii()], [], [None]):
        hashes, at = near_dup.hashed_words(part)
        words = [re.findall(r"\w+", (t or "").lower()) for t in part]
        assert np.diff(at).tolist() == [len(w) for w in words]
        pairs = set(zip(hashes.tolist(), (x for w in words for x in w), strict=True))
        assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})
        own, n, bounds, keys = near_dup.shingle_sets(part)
        for i, w in enumerate(words):
            want = Counter(tuple(w[j : j + 5]) for j in range(max(len(w) and 1, len(w) - 4)))
            assert (np.diff(own[bounds[i] : bounds[i + 1]].view(np.uint64).astype(object)) > 0).all()
            assert sorted(n[bounds[i] : bounds[i + 1]].tolist()) == sorted(want.values())
            assert np.array_equal(shingles(part[i])[0], own[bounds[i] : bounds[i + 1]]) and content_key(part[i]) == keys[i]


def test_samples_are_least_of_all_shingles():
    """What is left out of the computation of weights other than 1 changes no sample."""
    rng, sampler = np.random.default_rng(7), Sampler()
    for share in (0, 0.1, 1):
        own = rng.integers(0, 2**63, 500, dtype=np.uint64)
        weight = np.where(rng.random(500) < share, rng.choice([0.8, 0.93, 2.0, 7.0], 500), 1.0)
        starts = np.array([0, 1, 3, 90, 400])
        alone = sampler(own, weight, np.arange(500))
        assert np.array_equal(sampler(own, weight, starts), np.minimum.reduceat(alone, starts))


def test_samples_estimate_similarity():
    rng = np.random.default_rng(5)
    sampler = Sampler(2048)
    own = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    for change in (0.0, 0.1, 0.4):
        a, b = rng.choice([0.8, 1.0, 2.0, 3.0], 300), None
        b = np.where(rng.random(300) < change, rng.choice([0.8, 1.0, 2.0, 3.0, 5.0], 300), a)
        got = sampler(np.concatenate([own, own]), np.concatenate([a, b]), np.array([0, 300]))
        assert abs((got[0] == got[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    assert Sampler()(own, np.ones(300), np.array([0])).shape == (1, SAMPLES)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 160)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)] + [(7, 7), (5, 6), (6, 5)]
    low = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in low.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_idf_is_exact_however_rows_are_dealt(spark):
    """Chunks of 3,000 to 20 documents; a passage in one document of each small partition, 1 % of all."""
    rows = [f"a passage of some few words {i}" if i % 100 == 0 else f"text {i} with words of {i} own {i * 3}" for i in range(3000)]
    rows[7], rows[8] = None, ""
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = [document_idf(d) for d in (df.coalesce(1), df.repartition(7), df.repartition(50), df.repartitionByRange(150, "doc_id"))]
    assert all(np.array_equal(found[0], x) for x in found)
    want, own = plain_idf(rows), np.concatenate([shingles(t)[0] for t in rows])
    assert np.allclose(Weights(found[0])(own), want(own), atol=1e-6)
    passage = shingles("a passage of some few words")[0]
    assert np.allclose(Weights(found[0])(passage), 0.8 + 0.2 * math.log(100) / math.log(1000), atol=1e-3)
    assert (document_idf(df.limit(0)) == 1).all() and (document_idf(df.limit(1)) == 1).all()


def test_classes_do_not_depend_on_partitions(spark):
    rows = corpus(4, 30)
    found = [{r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows).repartition(n)).collect()} for n in (1, 7, 50)]
    assert found[0] == found[1] == found[2] == brute(rows, plain_idf(rows))


def test_matches_brute_force(spark, monkeypatch):
    for seed, block, few in ((0, 400_000, 2_000), (1, 900, 3)):
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block)
        monkeypatch.setattr(near_dup, "BLOCK_TEXTS", few)
        rows = corpus(seed)
        out = near_duplicates(docs(spark, rows).repartition(6)).collect()
        got = {r.doc_id: r.class_id for r in out}
        assert got == brute(rows, plain_idf(rows)) and len(out) == len(rows)
        assert all(r.kept == (r.doc_id == r.class_id) for r in out) and len(set(got.values())) < len(rows) - 30


def test_groups_of_several_large_classes(spark, monkeypatch):
    """Three known classes of one group, two larger than a block, and single texts: only links between classes count."""
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 4)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 9000)}"
    bases = [[word() for _ in range(60)] for _ in range(5)]
    edit = lambda w: " ".join("edit" + word() if k == i else x for k in [rnd.randrange(60)] for i, x in enumerate(w))
    rows, known = [], []
    for k, (base, n) in enumerate(zip(bases, (11, 9, 3, 1, 1), strict=True)):
        rows += [edit(base) for _ in range(n)]
        known += [k] * n
    rows += [" ".join(b) for b in bases[:4]]  # of no known class, but linked with four
    known += [5, 6, 7, 8]
    one = {k: known.index(k) for k in set(known)}
    texts = spark.createDataFrame(list(enumerate(rows)), "doc long, text string")
    groups = spark.createDataFrame([(i, 0, len(shingles(t)[0]), one[k]) for i, (t, k) in enumerate(zip(rows, known, strict=True))], "doc long, root long, n long, class long")
    got = near_dup.group_edges(texts, groups, spark.sparkContext.broadcast(np.ones(1 << 20, dtype=np.float32)), THRESHOLD).collect()
    low = {i: one[k] for i, k in enumerate(known)}
    for _ in range(9):
        for r in got:
            a, b = low[r.a], low[r.b]
            low = {i: min(a, b) if c in (a, b) else c for i, c in low.items()}
    want = brute(rows, lambda own: np.ones(len(own)))
    assert {i: sorted(j for j in low if low[j] == low[i]) for i in low} == {i: sorted(j for j in want if want[j] == want[i]) for i in want}
    assert near_dup.group_edges(texts, groups.withColumn("class", near_dup.F.lit(0).cast("long")), spark.sparkContext.broadcast(np.ones(1 << 20, dtype=np.float32)), THRESHOLD).collect() == []


def test_nulls_repeats_and_empty(spark):
    assert near_duplicates(docs(spark, []).limit(0)).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (2, "A, b c"), (2, "A, b c"), (7, None), (8, "")], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, None, True), (2, 2, True), (2, 2, True), (4, 2, False), (7, 7, True), (8, 7, False)]


def test_bands_join_texts_on_opposite_sides_of_a_hub(spark):
    """Chains whose ends differ from the hub in other samples: 48 and 25 of 64 agree with it, 37 with each other."""
    ids = [r.doc for r in spark.range(90).selectExpr("id AS doc").orderBy("doc").collect()]
    order = {r.doc: r.o for r in spark.range(90).selectExpr("id AS doc", "xxhash64(id) AS o").collect()}
    rows, want = [], []
    for k in range(0, 90, 3):
        hub, close, far = sorted(ids[k : k + 3], key=order.get)
        samples = {hub: np.zeros(64), close: np.repeat([0, 1], [48, 16]), far: np.repeat([0, 2, 1, 2], [25, 23, 12, 4])}
        assert [int((samples[a] == samples[b]).sum()) for a, b in ((hub, close), (hub, far), (close, far))] == [48, 25, 37]
        rows += [(d, [k], x.astype("<u2").tobytes()) for d, x in samples.items()]
        want.append({close, far})
    edges = near_dup.candidate_edges(spark.createDataFrame(rows, "doc long, bands array<long>, samples binary")).select("a", "b")
    root = {r.node: r.root for r in components(edges).collect()}
    assert all(len({root.get(d, d) for d in pair}) == 1 for pair in want)
