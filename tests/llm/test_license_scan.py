import math
import re
import textwrap

from tests.llm.cases import docs, texts
from tidemark.llm.license_scan import PHRASES, TEMPLATES, op5_license_scan, scan, words_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(t, threshold=0.8):
    t = (t or "").translate(LOW)
    w = WORD.findall(t)
    places, base = [], set()
    for p, label in PHRASES.items():
        p = p.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if base else 0.0
    for line in t.split("\n"):
        b = set(WORD.findall(line))
        for label, text in TEMPLATES:
            x = set(words_of(text))
            if len(b & x) >= threshold * len(x):
                labels.add(label)
                score = max(score, len(b & x) / len(x))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def test_matches_brute_force(spark):
    rows = texts() + ["cc by nc cc by nc", "x\nLicensed under CC BY-NC 4.0.", "Under the MIT\nlicense", "in version 3, under General Public License this work is licensed GNU"] + [x for _, x in TEMPLATES] + [x.replace("the", "a") for _, x in TEMPLATES]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in scan(docs(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(rows)}


def test_other_thresholds(spark):
    rows = texts(3) + [" ".join(x.split()[: n + 3]) for n, (_, x) in enumerate(TEMPLATES)]
    for threshold in (0.5, 1.0):
        got = {r.doc_id: (r.labels, round(r.score, 9)) for r in scan(docs(spark, rows), threshold=threshold).collect()}
        assert got == {i: brute(t, threshold)[-2:] for i, t in enumerate(rows)}


def test_empty_table_and_repeated_rows(spark):
    assert scan(docs(spark, []).limit(0)).collect() == []
    df = spark.createDataFrame([(1, "under the mit license"), (1, "under the mit license"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.labels) for r in scan(df).collect()) == [(-1, ""), (1, "mit"), (1, "mit")]


def brute_across(t, threshold=0.8):
    *_, labels, score = brute(t, threshold)
    w, labels = WORD.findall((t or "").translate(LOW)), set(labels.split(",")) - {""}
    for label, text in TEMPLATES:
        x, n = set(words_of(text)), math.ceil(len(words_of(text)) / threshold)
        best = max((len(set(w[i : i + n]) & x) for i in range(len(w))), default=0)
        if best >= threshold * len(x):
            labels.add(label)
            score = max(score, best / len(x))
    return ",".join(sorted(labels)), round(score, 9)


def test_wrapped_notices(spark, tmp_path):
    wrapped = [("\n" + mark).join(textwrap.wrap(x, width)) for width in (20, 72, 78) for mark in ("", "# ", " * ", "\n") for _, x in TEMPLATES]
    rows = texts(5) + wrapped + ["some prose before,\nand\n" + x + "\nsome prose\nafter" for x in wrapped] + [("the of software " * 9 + "\n").join(x.split()) for _, x in TEMPLATES]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in op5_license_scan(spark, str(tmp_path)).collect()}
    assert got == {i: brute_across(t) for i, t in enumerate(rows)}
    for i, t in enumerate(wrapped, len(texts(5))):
        assert TEMPLATES[(i - len(texts(5))) % len(TEMPLATES)][0] in got[i][0].split(",") and got[i][1] == 1.0, t
    for threshold in (0.5, 1.0):
        got = {r.doc_id: (r.labels, round(r.score, 9)) for r in scan(docs(spark, rows), threshold=threshold, across_lines=True).collect()}
        assert got == {i: brute_across(t, threshold) for i, t in enumerate(rows)}
