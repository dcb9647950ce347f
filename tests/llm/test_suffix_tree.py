import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import docs, texts
from tidemark.llm import suffix_tree
from tidemark.llm.suffix_tree import score, token_hashes

LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def plain(rows, longest=3, least=2, prior=1.0):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by dictionaries."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    all_tokens = [tokens(t) for _, t in rows]
    runs = [Counter() for _ in range(longest + 2)]
    for t, h in zip(all_tokens, held, strict=True):
        if not h:
            for k in range(1, longest + 2):
                runs[k].update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    n, v = sum(runs[1].values()), len(runs[1])
    named = [Counter({(): n})] + [Counter({r: c for r, c in x.items() if c >= least}) for x in runs[1:]]
    after = [defaultdict(dict) for _ in range(longest + 1)]
    for k in range(1, longest + 1):
        for r, c in named[k + 1].items():
            after[k][r[:-1]][r[-1]] = c
    states = {}
    for k in range(1, longest + 1):
        for s, nexts in after[k].items():
            total, share = named[k][s], {w: named[k][(*s[1:], w)] / named[k - 1][s[1:]] for w in nexts}
            gain, rest, rest_share = sum(c * math.log(c / total / share[w]) for w, c in nexts.items()), total - sum(nexts.values()), 1 - sum(share.values())
            if rest > 0 and rest_share > 1e-12:
                gain += rest * math.log(rest / total / rest_share)
            if gain > len(nexts) * math.log(total) / 2:
                states[s] = (total, rest)
    out = []
    for (i, _), t, h in zip(rows, all_tokens, held, strict=True):
        base = total = 0.0
        for j, w in enumerate(t):
            p = (runs[1][(w,)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, min(longest, j) + 1):
                s = tuple(t[j - k : j])
                if s in states:
                    count, rest = states[s]
                    p = (named[k + 1][(*s, w)] + (prior + rest) * p) / (count + prior)
            total += math.log10(p)
        out.append((i, h, len(t), sum(runs[1][(w,)] > 0 for w in t), n, round(base, 6), round(total, 6)))
    return sorted(out, key=str), states


def scored(df, **how):
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in score(df, **how).select(*cols).collect()), key=str)


@pytest.mark.parametrize("section", [7, 64, 1 << 20])
def test_hashes_stand_for_words(section, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SECTION", section)
    rows = texts(1, 40) + ["x" * 70_000 + "y", "x" * 70_001, "ab ba", "  lead", "trail  ", "A a"]
    got, begins = token_hashes(pa.array(rows))
    want = [w for t in rows for w in tokens(t)]
    assert len(got) == len(want) and list(np.diff(np.append(begins, len(got)))) == [len(tokens(t)) for t in rows]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(want, got.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    sliced, _ = token_hashes(pa.array(["zz q", *rows])[1:])
    assert (sliced == got).all() and [len(x) for x in token_hashes(pa.array([], pa.string()))] == [0, 0]


@pytest.mark.parametrize("longest", [1, 3])
def test_equal_to_a_plain_tree(spark, longest):
    rnd = random.Random(5)
    rows = texts(2, 60) + [" ".join(x for _ in range(rnd.randint(1, 20)) for x in rnd.choice(["a b c", "a b d", "x b d", "q"]).split()) for _ in range(60)]
    want, states = plain(list(enumerate(rows)), longest)
    assert states and {len(s) for s in states} <= set(range(1, longest + 1))
    assert scored(docs(spark, rows).repartition(3), longest=longest) == want
    held = [r for r in want if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_next_tokens_of_a_state_add_up_to_one():
    rows = [["a", "b"] * 9, ["a", "c", "b"] * 5, ["b", "a"] * 7]
    t, begins = token_hashes(pa.array([" ".join(r) for r in rows]))
    grams, counts = [], []
    for k in range(4):
        key, n = np.unique(t if not k else suffix_tree._joined(*(x := suffix_tree.run_names(t, begins, grams))[-1:], x[0], begins)[1], return_counts=True)
        grams.append(key[n >= 2]), counts.append(n[n >= 2])
    v = len(grams[0])
    m = suffix_tree.fitted(grams, counts, len(t), v, 1.0)
    for history in (["a"], ["a", "b"], ["c", "b", "a"], ["z", "b"]):
        total = 0.0
        for w in ["a", "b", "c", "unseen"]:
            h, b = token_hashes(pa.array([" ".join([*history, w])]))
            h, b = h[:-1], b
            names = suffix_tree.run_names(h, b, grams)
            p = suffix_tree.state_probabilities(names, b, np.where(names[0] >= 0, (suffix_tree._at(counts[0], names[0]) + 1) / m["below"], 1 / m["below"]), m)
            total += p[-1]
        h, b = token_hashes(pa.array([" ".join(history)]))
        names = suffix_tree.run_names(h, b, grams)
        total += suffix_tree.state_probabilities(names, b, np.where(names[0] >= 0, (suffix_tree._at(counts[0], names[0]) + 1) / m["below"], 1 / m["below"]), m)[-1]
        assert abs(total - 1) < 1e-9


def test_repeats_nulls_clashes_and_empty(spark):
    rows = [(1, "a b a b"), (1, "a b a b"), (None, "a b"), (None, None), (3, ""), (4, "a b a b")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, row string")
    assert scored(df) == plain(rows)[0] and score(df).columns[:3] == ["doc_id", "id", "row"]
    assert score(df.limit(0)).collect() == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    one = spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")
    assert scored(one) == [(only_held, True, 3, 0, 0, 0.0, 0.0)]


def test_runs_that_occur_twice_count_in_a_large_corpus(spark):
    train = [i for i in range(9) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    filler = 4_400_000
    df = spark.createDataFrame(list(zip(train, ["z " * filler, "a b", "A b"], strict=True)), "doc_id long, text string").coalesce(1)
    below = filler + 7 + 4 + 1
    want = math.log10(3 / below * (2 + 3 / below) / 3 * (2 + 4 / below) / 3)
    got = {r.doc_id: r for r in score(df).collect()}
    assert [round(got[i].score, 9) for i in train[1:]] == [round(want, 9)] * 2 and got[train[0]].n_tokens == filler + 1
    assert {(r.n_known - r.n_tokens, r.train_tokens) for r in got.values()} == {(0, filler + 7)}


def test_longer_runs_are_asked_for_by_both_parts(spark, monkeypatch):
    """Pairs of "a b c d" occur twice, its first three tokens once: four tokens need no count."""
    lengths, real = set(), suffix_tree.materialize

    def spy(df, tag):
        out = real(df, tag)
        if tag == "run-counts":
            lengths.update(r.k for r in out.select("k").collect())
        return out

    monkeypatch.setattr(suffix_tree, "materialize", spy)
    train = [i for i in range(9) if zlib.crc32(str(i).encode()) % 7 != 2][:4]
    rows = list(zip(train, ["a b c d", "a b", "b c", "c d"], strict=True))
    assert scored(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)[0]
    assert lengths == {0, 1, 2}
