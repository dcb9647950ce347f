from collections import defaultdict

from tests.llm.cases import docs, texts
from tidemark.llm.line_dedup import dedup_lines, dropped_positions


def brute(rows, min_chars=10, min_docs=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(low)
    held = defaultdict(set)
    for i, t in enumerate(rows):
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = {}
    for i, t in enumerate(rows):
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and min(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def rows_of(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in df.collect()}


def test_matches_brute_force(spark):
    rows = texts() + ["A shared boilerplate line\nown %d" % i for i in range(40)] + ["own\n a shared BOILERPLATE line \t\nsame line twice here\nsame line twice here"]
    assert rows_of(dedup_lines(docs(spark, rows))) == brute(rows)


def test_threshold_of_three_documents(spark):
    rows = ["only two hold this", "only two hold this", "three hold this line", "three hold this line\nx", "three hold this line"]
    assert rows_of(dedup_lines(docs(spark, rows), min_docs=3)) == brute(rows, min_docs=3)


def test_empty_table_nulls_and_repeated_rows(spark):
    assert dedup_lines(docs(spark, []).limit(0)).collect() == []
    df = spark.createDataFrame([(1, "a long enough line"), (1, "a long enough line"), (None, "a long enough line"), (2, "a long enough line")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.text) for r in dedup_lines(df).collect())
    assert got == [(-1, "a long enough line"), (1, "a long enough line"), (1, "a long enough line"), (2, "")]


def test_columns_called_like_temporaries(spark):
    names = ["__id", "__th", "__drop", "__out", "__row", "__h", "__l", "__pos", "n_lines", "n_dropped", "a.b", "line"]
    df = spark.createDataFrame([(i, "a long enough line\nown", *range(len(names))) for i in (1, 2)], ", ".join(["doc_id long", "text string", *[f"`{n}` int" for n in names]]))
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", *[n for n in names if n not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r["__id"], r["__out"], r["a.b"], r.n_lines, r.n_dropped) for r in out.collect()} == {(1, "a long enough line\nown", 0, 3, 10, 2, 0), (2, "own", 0, 3, 10, 2, 1)}


def test_lines_are_hashed_once(spark):
    """The hashes are stored, so that what counts and what joins them read no text."""
    docs = spark.createDataFrame([(1, "a line of words\nx"), (2, "A line of words ")], "doc_id long, text string")
    out = dropped_positions(docs)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r[0], r[2]) for r in out.collect()] == [(2, [0])]
