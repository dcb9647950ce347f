import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import prefix_trie
from tidemark.llm.prefix_trie import ordered_turns, rebuilt

SHAPE = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """The turns of each conversation, each as (role, text), in the defined order."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out[c].append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in out.items()}


def shared(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[:-1] == q for x in members)
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        out.add((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(x) == len(p) + 1 and x[:-1] == p for x in members), sum(map(leaf, below)),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def trie(spark, rows, share=True):
    turns, convs = ordered_turns(spark.createDataFrame(rows, SHAPE))
    out = prefix_trie.prefix_trie(*(rebuilt(turns, convs) if share else (turns, convs)))
    return [tuple(r)[:8] for r in out.collect()]


def some_rows(seed=0):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "bot", None]), rnd.choice(["hi", "é", "", None, "a,b"])) for c in (*range(60), 1000003, -3, -10) for t in range(rnd.randint(1, 9))]
    rows += [(0, None, "user", "first"), (5, None, "user", "x"), (5, None, "bot", "x"), rows[3], rows[3], (None, 1, "user", "no conversation")]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(30) for t in range(4)] + [(200, t, "u", str(t % 3)) for t in range(37)] + [(201, t, "u", str(t % 3)) for t in range(35)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [True, False])
def test_equal_to_a_plain_trie(spark, share, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = some_rows()
    convs = sequences(rows)
    got = trie(spark, rows, share)
    assert len(got) == len(set(got)) and set(got) == plain_trie(shared(convs) if share else convs)


def test_empty_table_and_one_turnless_conversation(spark):
    assert trie(spark, []) == []
    # 5 takes the first h turns of itself; one row each
    c = next(c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert set(trie(spark, [(c, 1, "user", "gone")])) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_extra_columns_are_not_looked_at(spark):
    rows = spark.createDataFrame([(1, 1, "u", "t", "x", 3)], SHAPE + ", name string, d int")
    turns, convs = ordered_turns(rows)
    assert turns.count() == 1 and convs.collect()[0].n == 1
