import random
import tracemalloc

from tests.llm.cases import docs, texts
from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import COVERAGE, MIN_MATCH, contamination, drop_contaminated, tiles
from tidemark.llm.near_dup import word_hashes, words_of


def plain_tiles(p, t, k):
    """Greedy string tiling by its definition."""
    if not set(zip(*(p[i:] for i in range(k)))) & set(zip(*(t[i:] for i in range(k)))):
        return []  # no run of k words is common
    used_p, used_t, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in used_p and j + n not in used_t:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        out.append((i, j, n))
        used_p.update(range(i, i + n))
        used_t.update(range(j, j + n))


def test_tiles_equal_the_definition():
    rnd = random.Random(3)
    for _ in range(150):
        p, t = ([rnd.choice("abc") for _ in range(rnd.randint(0, 40))] for _ in range(2))
        k = rnd.choice([2, 3])
        assert tiles(word_hashes(p), word_hashes(t), k) == plain_tiles(p, t, k)


def test_long_repetitive_texts_in_bounded_memory():
    """As many tiles as the item holds, however often the document repeats its words: no place pairs are formed."""
    for words, item, want in ((["a"], 300, [300]), (["a", "b"], 1200, [1200]), (["a", "b", "c", "x"], 50, [50])):
        doc, test = word_hashes((words * 200_000)[:200_000]), word_hashes((words * 1200)[:item])
        tracemalloc.start()
        assert [n for *_, n in tiles(doc, test, 5)] == want and tracemalloc.get_traced_memory()[1] < 60e6
        tracemalloc.stop()
    doc = word_hashes((["a"] * 37 + ["x"]) * 5000)
    assert [n for *_, n in tiles(doc, word_hashes(["a"] * 300), 5)] == [37] * 8


def fixture(spark):
    rnd = random.Random(4)
    items = [" ".join(f"q{rnd.randint(0, 300)}" for _ in range(n)) for n in (3, 5, 20, 40, 59)] + ["", "?!"]
    rows = texts(2, 20)
    for t in items[2:5]:
        w = t.split()
        rows += [f"before {t.upper()} after", " ".join(w[len(w) // 2 :] + ["between"] + w[: len(w) // 2]), " ".join(w[: len(w) // 4]), "x, ".join(w), " ".join(w[: int(len(w) * 0.7)])]
    rows += [items[0], "so " + items[1] + " it is"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "a b c d e f"), (99, None)], "item_id long, text string")
    want = {}
    for d, t in enumerate(rows):
        p = words_of(t)
        want[d] = [i for i, x in enumerate(items) if (w := words_of(x)) and sum(n for *_, n in plain_tiles(p, w, min(MIN_MATCH, len(w)))) >= COVERAGE * len(w)]
    return rows, bench, want


def test_matches_brute_force(spark, monkeypatch):
    rows, bench, want = fixture(spark)
    got = {r.doc_id: r["items"] for r in contamination(docs(spark, rows), bench).collect()}
    assert got == want and sum(map(bool, want.values())) >= 10
    kept = drop_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if not x}
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 7)  # a filter that lets nearly all pass
    assert {r.doc_id: r["items"] for r in contamination(docs(spark, rows).repartition(5), bench.repartition(2)).collect()} == want


def test_very_long_and_repeated_texts_and_clashing_columns(spark):
    long = " ".join(["w1 w2 w3"] * 40_000 + ["one two three four five six seven eight"] + ["w1"] * 1000)
    rows = [(1, long), (1, long), (None, long), (None, None), (2, ""), (3, "one two three four nine five six seven eight")]
    df = spark.createDataFrame([(i, t, "x", b"y", 1) for i, t in rows], "doc_id long, text string, items string, digest binary, coverage int")
    bench = spark.createDataFrame([(5, "one two three four five six seven eight"), (6, "w1 w2 w3 w1 w2 w3 w1"), (6, "x y")], "item_id long, text string")
    got = sorted((str(r.doc_id), r["items"]) for r in contamination(df, bench).collect())
    assert got == [("1", [5, 6]), ("1", [5, 6]), ("2", []), ("3", []), ("None", []), ("None", [5, 6])]
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not [r for r in contamination(docs(spark), none).collect() if r.contaminated]
    assert contamination(docs(spark, []).limit(0), none).collect() == []
