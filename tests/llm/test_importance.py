import hashlib
import math
import re
import zlib
from collections import Counter

from tests.llm.cases import docs, texts
from tidemark.llm import importance
from tidemark.llm.importance import resample

LOWER = {i: i + 32 for i in range(65, 91)}


def runs(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5, least=20):
    s, t = Counter(b for _, x in rows for b in runs(x)[1]), Counter(b for x in target for b in runs(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out, fit = [], []
    for i, (doc_id, text) in enumerate(rows):
        n, f = runs(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if n >= least:
            fit.append((-score, doc_id is not None, doc_id or 0, i))
    for rank, (*_, i) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=str)


def test_equal_to_a_plain_version(spark):
    rows, target = texts(3, 80), ["the license of the data set", None, "token line DATA set, big data"]
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    for percent in (5, 50, 100):
        got = resample(docs(spark, rows), goal, percent)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == plain(list(enumerate(rows)), target, percent)


def test_repeats_nulls_and_clashing_columns(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v"
    rows = [(1, long), (1, long), (None, long), (None, None), (2, "")]
    df = spark.createDataFrame([(i, t, "x", 3, [1]) for i, t in rows], "doc_id long, text string, row string, at int, buckets array<int>")
    out = resample(df, spark.createDataFrame([], "text string"), 100)
    assert out.columns == ["doc_id", "row", "at", "buckets", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert [r[:4] for r in got] == [r[:4] for r in plain(rows, [], 100)] and sorted(r[4] or 0 for r in got) == [0, 0, 1, 2, 3]


def test_empty_table_and_a_literal_of_gains(spark):
    assert resample(docs(spark, []).limit(0), docs(spark, ["a"])).collect() == []
    assert len(importance.gains({}, {1: 3})) == 10000 and importance.gains({}, {1: 3})[1] == math.floor(1000 * math.log(4 * 10000 / 10003))


def test_scoring_does_not_explode(spark):
    plan = resample(docs(spark, ["a b c"]), docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Generate" not in plan
