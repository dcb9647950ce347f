import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import closing, drafts, history, links, ratings, rollups, spans, walkforward
from tidemark.operators.drafts import Combiner, DraftConfig
from tidemark.operators.ratings import Book, RatingConfig, rate
from tidemark.sources import writers


# --- histories ---


def polls_machine(quotes, polls):
    """A recorder, row by row: state, change detection, tombstones."""
    state, out = {}, []
    for at in polls:
        seen = {k: v for (k, t), v in quotes.items() if t == at}
        for k, v in sorted(seen.items()):
            if k not in state or state[k] != v:
                out.append((k, at, *v))
                state[k] = v
        for k in sorted(state):
            if k not in seen and state[k][1] != "gone":
                state[k] = (None, "gone")
                out.append((k, at, *state[k]))
    return sorted(out, key=str)


def test_history_equals_a_recorder(spark):
    rnd = random.Random(1)
    polls = list(range(1, 30))
    quotes = {(k, t): (rnd.choice([1.5, 1.6, None]), rnd.choice(["open", "open", "closed", None])) for k in range(6) for t in polls if rnd.random() < 0.7}
    df = spark.createDataFrame([("s", k, t, *v) for (k, t), v in quotes.items()], "source string, line_key int, captured_at int, price double, status string")
    grid = spark.createDataFrame([("s", t) for t in polls], "source string, captured_at int")
    got = sorted(((r.line_key, r.captured_at, r.price, r.status) for r in history.history(df, grid).collect()), key=str)
    assert got == polls_machine(quotes, polls)


def test_failed_poll_makes_no_tombstones(spark):
    df = spark.createDataFrame([("s", 1, 1, 1.5, "open"), ("s", 1, 3, 1.5, "open")], "source string, line_key int, captured_at int, price double, status string")
    grid = spark.createDataFrame([("s", 1), ("s", 3)], "source string, captured_at int")  # poll 2 failed
    assert history.history(df, grid).count() == 1


def test_append_and_tombstones_by_poll(spark):
    schema = "source string, line_key string, captured_at long, id long, price double, status string"
    stored = spark.createDataFrame([("s", "a", 1, 1, 1.5, "open"), ("s", "b", 1, 2, 2.5, "open"), ("s", "c", 1, 3, None, "gone")], schema)
    poll = spark.createDataFrame([("s", "a", 2, 4, 1.5, "open"), ("s", "c", 2, 5, 3.0, "open")], schema)
    written, skipped = history.append_changes(stored, poll, ["source", "line_key"], ["price", "status"], ["captured_at", "id"])
    assert [r.line_key for r in written.collect()] == ["c"] and [r.line_key for r in skipped.collect()] == ["a"]
    gone = history.tombstones(stored, poll, ["source", "line_key"], ["captured_at", "id"], F.lit(2).cast("long"), ["price"]).collect()
    assert [(r.line_key, r.captured_at, r.price, r.status) for r in gone] == [("b", 2, None, "gone")]


# --- spans ---


def spans_df(spark, rows):
    return spark.createDataFrame([("k", a, b) for a, b in rows], "key string, start long, end long")


def pairs(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_spans(spark):
    rows = spans_df(spark, [(0, 100), (100, 150), (400, 500), (450, 480), (7, 7)])
    assert pairs(spans.merge_spans(rows, ["key"])) == [(0, 150), (400, 500)]
    window = spark.createDataFrame([("k", 100, 200), ("k", 5, 5), ("z", 0, 9)], "key string, lo long, hi long")
    got = {(r.key, r.lo): (r.overlap, r.coverage) for r in spans.coverage(rows, window, ["key"]).collect()}
    assert got == {("k", 100): (50, 0.5), ("k", 5): (0, None), ("z", 0): (0, 0.0)}, got
    assert pairs(spans.gaps(spans_df(spark, [(0, 40), (80, 100)]), window.where("lo = 100").withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(100).cast("long")}), ["key"])) == [(40, 80)]


def test_open_spans(spark):
    rows = [(1, 0, "open"), (2, 5, "closed"), (3, 5, "open"), (4, 5, "gone"), (5, 9, None), (6, 12, "open")]
    df = spark.createDataFrame([("k", *r) for r in rows], "key string, seq int, t long, status string")
    assert pairs(spans.open_spans(df, ["key"], ["t", "seq"], "t", F.lit(20).cast("long"))) == [(0, 5), (5, 5), (12, 20)]
    assert pairs(spans.open_spans(df, ["key"], ["t", "seq"], "t", F.lit(12).cast("long"))) == [(0, 5), (5, 5)]


# --- links ---


def test_nearest_and_inherit(spark):
    left = spark.createDataFrame([(1, "p", 1000), (2, "p", 99999), (3, "p", None), (4, "q", None)], "id long, pair string, at long")
    right = spark.createDataFrame([(10, "p", 900), (11, "p", 1100), (12, "q", 5)], "series long, pair string, start long")
    got = {r.id: (r.series, r.skew, r.ambiguous) for r in links.nearest_within(left, right, ["pair"], ["id"], "at", "start", "series", 500).collect()}
    assert got == {1: (10, 100, True), 2: (None, None, False), 3: (None, None, False), 4: (12, None, False)}
    chain = spark.createDataFrame([(1, None, 7), (2, 1, None), (3, 2, None), (4, 5, None), (5, 4, None), (6, 3, 9)], "id long, up long, v long")
    assert {r.id: r.v for r in links.inherit(chain, "id", "up", "v").collect()} == {1: 7, 2: 7, 3: 7, 4: None, 5: None, 6: 9}


def test_asof(spark):
    left = spark.createDataFrame([("k", 10), ("k", 5), ("z", 1)], "key string, at long")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 9, 2.0), ("k", 10, 3.0)], "key string, t long, v double")
    strict = {(r.key, r.at): r.v for r in links.merge_asof(left, right, ["key"], "at", "t", ["v"]).collect()}
    assert strict == {("k", 10): 2.0, ("k", 5): None, ("z", 1): None}
    assert {r.at: r.v for r in links.merge_asof(left, right, ["key"], "at", "t", ["v"], strict=False).collect()} == {10: 3.0, 5: 1.0, 1: None}


def test_resolve_events(spark):
    aliases = spark.createDataFrame([("team a", 1), ("alpha", 1), ("team b", 2)], "key string, team_id long")
    snaps = [("s", "1", None, "Team A", "TEAM  b", "2026-08-14T08:00:00Z"), ("s", "2", "Kills", "Alpha (Kills)", "Team B (kills)", "2026-08-20T00:00:00Z"), ("s", "3", None, "Nobody", "Team B", None)]
    df = spark.createDataFrame(snaps, "source string, event_id string, units string, home string, away string, start_time string")
    series = spark.createDataFrame([(555, 2, 1, 1786694400 + 60)], "series_id long, team_a long, team_b long, start long")
    parents = spark.createDataFrame([("2", "1")], "event_id string, parent_event_id string")
    got = {r.event_id: (r.series_id, r.is_kills, r.home_team_id, r.start_skew_s) for r in links.resolve_events(df, aliases, series, parents).collect()}
    assert got == {"1": (555, 0, 1, -60), "2": (555, 1, 1, None), "3": (None, 0, None, None)}
    assert links.alias_clashes(aliases.union(spark.createDataFrame([("alpha", 9)], "key string, team_id long"))).count() == 1


def test_resolve_report_and_quoted_names(spark):
    aliases = spark.createDataFrame([("team a", 1), ("team b", 2), ("team c", 3)], "key string, team_id long")
    rows = [(1, "s", "1", None, "Team A", "Team B", "2026-08-14T08:00:00Z", 10), (2, "s", "1", None, "TEAM A", "Team B", "2026-08-14T08:00:00Z", 20), (3, "s", "2", None, "Nobody (Kills)", "Team B", None, 5), (4, "s", "2", None, "Nobody (Kills)", "Team B", None, 6), (5, "s", "3", None, "Team A", "Team C", "2026-08-14T08:00:00Z", 7)]
    snaps = spark.createDataFrame(rows, "id long, source string, event_id string, units string, home string, away string, start_time string, captured_at long")
    series = spark.createDataFrame([(555, 1, 2, 1786694400)], "series_id long, team_a long, team_b long, start long")
    out = links.resolve_events(snaps, aliases, series, spark.createDataFrame([], "event_id string, parent_event_id string"))
    report = {k: [tuple(r) for r in v.collect()] for k, v in links.resolve_report(snaps, out).items()}
    assert [(n.strip(), k) for n, k in report["unresolved"]] == [("Nobody", 2)] and [r[0] for r in report["unjoined"]] == ["3"] and report["ambiguous"] == []
    assert {(r.series_id, r.team_id, r.name) for r in links.quoted_names(snaps, out).collect()} == {(555, 1, "TEAM A"), (555, 2, "Team B")}


def test_last_before_is_strict_breaks_ties_and_keeps_null_groups(spark):
    rows = [("k", None, 1, 1, 5.0), ("k", None, 3, 2, 6.0), ("k", None, 3, 3, 7.0), ("k", "x", 4, 4, 8.0), ("k", "y", 9, 5, 9.0), ("j", "x", 1, 6, None)]
    h = spark.createDataFrame(rows, "k string, g string, at long, id long, price double")
    bounds = spark.createDataFrame([("k", 4, "p"), ("k", 5, "q"), ("j", 2, "r"), ("z", 9, "s")], "k string, bound long, what string")
    got = {(r.k, r.bound, r.what, r.g): (r.price, r.at) for r in links.last_before(bounds, h, ["k"], "bound", "at", ["g"], ["at", "id"], ["price", "at"]).collect()}
    assert got == {("k", 4, "p", None): (7.0, 3), ("k", 5, "q", None): (7.0, 3), ("k", 5, "q", "x"): (8.0, 4), ("j", 2, "r", "x"): (None, 1)}


def test_nearest_within_equals_all_pairs(spark):
    rnd = random.Random(3)
    left = [(i, rnd.randint(0, 2), rnd.choice([None, rnd.randint(-500, 500)])) for i in range(80)]
    right = [(i, rnd.randint(0, 3), rnd.randint(-500, 500)) for i in range(40)]
    for tolerance in (0, 7, 100):
        got = links.nearest_within(spark.createDataFrame(left, "id long, k long, at long"), spark.createDataFrame(right, "series long, k long, start long"), ["k"], ["id"], "at", "start", "series", tolerance)
        want = {}
        for i, k, at in left:
            same = [(s, t) for s, q, t in right if q == k]
            near = sorted((abs(at - t), s, t) for s, t in same if abs(at - t) <= tolerance) if at is not None else []
            want[i] = (near[0][1], at - near[0][2], len(near) > 1) if near else (same[0][0] if at is None and len(same) == 1 else None, None, False)
        assert {r.id: (r.series, r.skew, r.ambiguous) for r in got.collect()} == want


def test_patches_come_from_a_literal_timeline(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 5, None), (3, 99, None), (4, 99, 7), (5, None, None)], "id int, at long, patch int")
    timeline = spark.createDataFrame([(5, 50), (5, 51), (80, 60), (None, 70)], "released_at long, patch_id int")
    assert {r.id: r.patch for r in links.patch_of(df, timeline, "at").collect()} == {1: None, 2: 51, 3: 60, 4: 7, 5: None}
    assert "Join" not in links.patch_of(df, timeline, "at")._jdf.queryExecution().executedPlan().toString()


def test_a_grid_is_bounded_by_the_end(spark):
    df, _ = maps_df(spark, 120)
    cut = df.where("start_time < 150000")
    same = lambda x, y: [(r.config_id, r.n, round(r.log_loss, 9)) for r in x.collect()] == [(r.config_id, r.n, round(r.log_loss, 9)) for r in y.collect()]
    configs = {0: RatingConfig(), 1: RatingConfig(tau=1.2)}
    assert 0 < cut.count() < 120 and same(walkforward.walk_forward(df, configs, end=150000), walkforward.walk_forward(cut, configs))
    none = spark.createDataFrame([], "match_id long, heroes_a array<int>, heroes_b array<int>, first_a boolean")
    assert same(walkforward.walk_forward_draft(df, none, {0: DraftConfig()}, end=150000), walkforward.walk_forward_draft(cut, none, {0: DraftConfig()}))


# --- ratings and drafts ---


def test_glickman_example():
    mu, phi, sigma = rate(0.0, 200 / 173.7178, 0.06, [((1400 - 1500) / 173.7178, 30 / 173.7178, 1), ((1550 - 1500) / 173.7178, 100 / 173.7178, 0), ((1700 - 1500) / 173.7178, 300 / 173.7178, 0)], 0.5)
    assert 1500 + 173.7178 * mu == pytest.approx(1464.06, abs=0.01) and 173.7178 * phi == pytest.approx(151.52, abs=0.01) and sigma == pytest.approx(0.05999, abs=1e-5)


def maps_df(spark, n=300, teams=8, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.sample(range(teams), 2)
        rows.append((i, 1000 + i // 2 * 3600, a, b, int(rnd.random() < 0.5 + 0.05 * (a - b)), i // 3, 0, rnd.choice([None, 1, 2]), [a * 10 + j + rnd.randint(0, 1) for j in range(5)], None))
    return spark.createDataFrame(rows, "match_id long, start_time long, a long, b long, win int, series_id long, series_type int, patch int, lineup_a array<long>, lineup_b array<long>"), rows


def plain_replay(rows, c):
    """{match: P(a wins)} by Glicko-2 in rating units, one map a period, with the volatility by halving."""
    q, teams, out = 173.7178, {}, {}
    g = lambda rd: 1 / math.sqrt(1 + 3 * (rd / q) ** 2 / math.pi**2)

    def volatility(rd, sigma, v, delta):
        a, phi2 = math.log(sigma**2), (rd / q) ** 2
        f = lambda x: math.exp(x) * (delta**2 - phi2 - v - math.exp(x)) / (2 * (phi2 + v + math.exp(x)) ** 2) - (x - a) / c.tau**2
        lo, hi = a - 10, a + 10
        for _ in range(100):
            lo, hi = ((lo + hi) / 2, hi) if f((lo + hi) / 2) > 0 else (lo, (lo + hi) / 2)
        return math.exp(lo / 2)

    def seen(team, at, patch, lineup):
        r, rd, sigma, played, known, five = teams.get(team, (1500.0, 350.0, 0.06, None, None, None))
        square = rd**2
        if played is not None and at > played:
            square += (sigma * q) ** 2 * (at - played) / c.idle_period_s
        if c.patch_rd_boost and patch is not None and known is not None and patch > known:
            square += c.patch_rd_boost**2
        if c.roster_rd_boost and lineup and five:
            square += ((5 - len(set(five) & set(lineup))) * c.roster_rd_boost) ** 2
        return r, min(math.sqrt(square), c.max_rd), sigma

    for m, at, a, b, win, _, _, patch, *lineups in rows:
        before = {t: seen(t, at, patch, x) for t, x in ((a, lineups[0]), (b, lineups[1]))}
        joint = math.hypot(before[a][1], before[b][1])
        out[m] = 1 / (1 + math.exp(-g(joint) * (before[a][0] - before[b][0]) / q))
        for t, o, s, x in ((a, b, win, lineups[0]), (b, a, 1 - win, lineups[1])):
            (r, rd, sigma), (r2, rd2, _) = before[t], before[o]
            e = 1 / (1 + math.exp(-g(rd2) * (r - r2) / q))
            v = 1 / (g(rd2) ** 2 * e * (1 - e))
            sigma = volatility(rd, sigma, v, v * g(rd2) * (s - e))
            phi = 1 / math.sqrt(1 / ((rd / q) ** 2 + sigma**2) + 1 / v)
            known = [p for p in (teams[t][4] if t in teams else None, patch) if p is not None]
            teams[t] = (r + q * phi**2 * g(rd2) * (s - e), phi * q, sigma, at, max(known, default=None), x or (teams[t][5] if t in teams else None))
    return out


def test_volatility_balances():
    rnd = random.Random(4)
    for _ in range(500):
        phi, sigma, v, delta, tau = rnd.uniform(0.05, 2), rnd.choice([0.03, 0.06, 0.2]), rnd.uniform(1, 50), rnd.uniform(-4, 4), rnd.choice([0.3, 0.5, 1.0])
        x = 2 * math.log(ratings.new_volatility(phi, sigma, v, delta, tau))
        s = phi**2 + v + math.exp(x)
        assert math.exp(x) * (delta**2 - s) / (2 * s * s) == pytest.approx((x - 2 * math.log(sigma)) / tau**2, abs=1e-6)


def test_volatility_of_a_surprise_balances():
    """Of a result that was all but ruled out: a balance near the old value where there is one, else a far one, never an error."""
    for v, sigma in [(1e14, 0.06), (1e25, 0.06), (1e14, 5.0), (1e25, 5.0), (1e25, 1e12)]:
        delta, phi, tau = 0.6 * v, 2.0, 0.5
        x = 2 * math.log(ratings.new_volatility(phi, sigma, v, delta, tau))
        grown = math.exp(x) / v
        s = phi**2 / v + 1 + grown
        assert grown * (0.36 * v - s) / (2 * s * s) == pytest.approx((x - 2 * math.log(sigma)) / tau**2, rel=1e-6)
        assert x > 2 * math.log(sigma) and (sigma > 1) == (x > 2 * math.log(sigma) + 0.1)


def test_sure_maps_are_folded(spark):
    """Teams so far apart that a chance rounds to 1, or its power overflows: who was sure to win loses, then wins."""
    from dataclasses import asdict

    configs = {0: RatingConfig(), 1: RatingConfig(roster_rd_boost=30.0)}
    start = {1: 30.0, 2: -30.0, 3: 900.0, 4: -900.0}
    rows = [(i, 1000 * i, a, b, win, [i + n for n in range(5)], None) for i, (a, b, win) in enumerate([(1, 2, 0), (4, 3, 1), (3, 4, 0), (1, 2, 1), (2, 3, 1), (1, 3, 0), (4, 2, 1), (4, 1, 0)] * 4)]
    df = spark.createDataFrame(rows, "match_id long, start_time long, a long, b long, win int, lineup_a array<long>, lineup_b array<long>")
    states = spark.createDataFrame([(k, t, mu, 1.5, 0.06, 9, -5, None, None) for k in configs for t, mu in start.items()], ratings.STATES)
    history = {(r.config_id, r.match_id, r.side): r for r in ratings.replay(df, configs, states).collect()}
    short = {(r.config_id, r.match_id): r.prob for r in ratings.forecasts(df, configs, states).collect()}
    assert len(history) == 2 * len(short) == 4 * len(rows)
    for k, c in configs.items():
        book = Book(asdict(c))
        book.teams = {t: (mu, 1.5, 0.06, 9, -5, None, None) for t, mu in start.items()}
        for m, when, a, b, win, one, _ in rows:
            before, p = {t: book.teams[t][0] for t in (a, b)}, book.play(when, a, b, win, None, frozenset(one), None)[0]
            assert short[k, m] == pytest.approx(p, abs=1e-9) and 0 <= p <= 1
            for side, t, won in (("a", a, win), ("b", b, 1 - win)):
                r, (mu, phi, sigma, *_rest) = history[k, m, side], book.teams[t]
                assert (r.mu, r.phi, r.sigma) == pytest.approx((mu, phi, sigma), rel=1e-6) and all(map(math.isfinite, (mu, phi, sigma)))
                assert mu >= before[t] if won else mu <= before[t]
        assert history[k, 0, "a"].prob == pytest.approx(1) and history[k, 0, "b"].mu > -30 + 1


def test_predictions_frozen_after_sure_maps(spark):
    c = RatingConfig(roster_rd_boost=30.0)
    states = spark.createDataFrame([(0, t, mu, 1.5, 0.06, 9, -5, None, None) for t, mu in ((1, 60.0), (2, -900.0))], ratings.STATES)
    rows = [(i, 1000 * i, 1, 2, i % 3 // 2, [i + n for n in range(5)], None) for i in range(9)]
    df = spark.createDataFrame(rows, "match_id long, start_time long, a long, b long, win int, lineup_a array<long>, lineup_b array<long>")
    at = spark.createDataFrame([(k, a, b, 1000 * k) for k in range(1, 10) for a, b in ((1, 2), (2, 1))], "k long, a long, b long, when long")
    got = {(r.k, r.a): r.p_map for r in ratings.frozen(ratings.replay(df, {0: c}, states), at, c).collect()}
    assert len(got) == 18 and all(got[k, 1] + got[k, 2] == pytest.approx(1) for k in range(1, 10))
    assert got[1, 1] == pytest.approx(1)


def test_replay_doesnt_depend_on_row_order_and_equals_a_plain_fold(spark):
    df, rows = maps_df(spark)
    configs = {0: RatingConfig(), 1: RatingConfig(tau=0.3, patch_rd_boost=60.0, roster_rd_boost=30.0), 5: RatingConfig(tau=1.0), 7: RatingConfig(patch_rd_boost=20.0)}
    got = {(r.config_id, r.match_id): (r.prob, r.games) for r in ratings.replay(df.repartition(7), configs).where("side = 'a'").collect()}
    short = {(r.config_id, r.match_id): (r.prob, r.games_a) for r in ratings.forecasts(df.repartition(3), configs).collect()}
    assert got == short and len(got) == 4 * len(rows)
    for k, c in configs.items():
        for m, p in plain_replay(rows, c).items():
            assert got[k, m][0] == pytest.approx(p, abs=1e-8)
    assert got[0, 0][0] == 0.5
    assert ratings.forecasts(df.limit(0), configs).collect() == []


def test_first_maps_are_even_and_freezing_is_strict(spark):
    df, rows = maps_df(spark, 60)
    c = RatingConfig()
    h = ratings.replay(df, {0: c})
    at = df.select("match_id", "a", "b", F.col("start_time").alias("when"), "patch")
    got = {r.match_id: r.p_map for r in ratings.frozen(h, at, c).collect()}
    from dataclasses import asdict

    for m, when, a, b, *_rest in rows:
        book = Book(asdict(c))
        for n, t, x, y, win, *_more in rows:
            if t < when:
                book.play(t, x, y, bool(win))
        assert got[m] == pytest.approx(book.play(when, a, b, True)[0], abs=1e-9)
    first = rollups.scorecard(walkforward.predictions(df, {0: c}).where("match_id = 0"), outcome="win").first()
    assert first.brier == 0.25


def plain_features(rows, drafts_of, config):
    """Draft features by decayed counters, map by map."""
    h, stats, games, out = config.half_life_s, {}, {}, {}

    def read(key, at, k):
        w, n, last = stats.get(key, (0.0, 0.0, at))
        d = 0.5 ** ((at - last) / h)
        return (w * d + k / 2) / (n * d + k) - 0.5, n * d / (n * d + k)

    def add(key, at, won):
        w, n, last = stats.get(key, (0.0, 0.0, at))
        d = 0.5 ** ((at - last) / h)
        stats[key] = (w * d + won, n * d + 1, at)

    for m, at, a, b, win, *_ in rows:
        if m in drafts_of:
            ha, hb = drafts_of[m]
            r = {x: read(("h", x), at, config.k_hero)[0] for x in ha + hb}

            def synergy(hs):
                total = 0.0
                for i in range(5):
                    for j in range(i):
                        net, ev = read(("p", *sorted((hs[i], hs[j]))), at, config.k_pair)
                        total += net - ev * 0.5 * (r[hs[i]] + r[hs[j]])
                return total

            def counter(x, y):
                lo, hi = sorted((x, y))
                net, ev = read(("m", lo, hi), at, config.k_pair)
                return (net - ev * (r[lo] - r[hi])) * (1 if x == lo else -1)

            team = lambda t, hs: sum(read(("t", t, x), at, config.k_team_hero)[0] for x in hs)
            warm = float(min(games.get(a, 0), games.get(b, 0)) >= config.min_team_games)
            out[m] = (sum(r[x] for x in ha) - sum(r[x] for x in hb), team(a, ha) - team(b, hb), synergy(ha) - synergy(hb), sum(counter(x, y) for x in ha for y in hb), warm)
            for hs, t, won in ((ha, a, win), (hb, b, 1 - win)):
                for i, x in enumerate(hs):
                    add(("h", x), at, won)
                    add(("t", t, x), at, won)
                    for y in hs[:i]:
                        add(("p", *sorted((x, y))), at, won)
            for x in ha:
                for y in hb:
                    add(("m", *sorted((x, y))), at, win if x < y else 1 - win)
        games[a], games[b] = games.get(a, 0) + 1, games.get(b, 0) + 1
    return out


def test_draft_features_equal_the_counters(spark):
    df, rows = maps_df(spark, 80)
    rnd = random.Random(5)
    chosen = {m: (h[:5], h[5:]) for m in range(80) if m % 4 for h in [rnd.sample(range(14), 10)]}
    d = spark.createDataFrame([(m, a, b, m % 2 == 0) for m, (a, b) in chosen.items()], "match_id long, heroes_a array<int>, heroes_b array<int>, first_a boolean")
    config = DraftConfig(half_life_days=1.0)
    got = drafts.draft_features(rollups.running_games(df, ["start_time", "match_id"]), d, config).collect()
    want = plain_features(rows, chosen, config)
    assert len(got) == len(want)
    for r in got:
        assert (r.hero_diff, r.team_hero_diff, r.synergy_diff, r.counter_sum, r.both_warm) == pytest.approx(want[r.match_id], abs=1e-9)
        assert r.first_action == (1.0 if r.match_id % 2 == 0 else -1.0)


def test_complete_drafts(spark):
    rows = [(1, i, 1, i, i % 2) for i in range(10)] + [(1, -1, 0, 50, 1)] + [(2, i, 1, i % 9, i % 2) for i in range(10)] + [(3, i, 1, i, 0) for i in range(10)]
    got = drafts.complete_drafts(spark.createDataFrame(rows, "match_id long, ord int, is_pick int, hero_id int, team int")).collect()
    assert [(r.match_id, r.heroes_a, r.heroes_b, r.first_a) for r in got] == [(1, [0, 2, 4, 6, 8], [1, 3, 5, 7, 9], False)]


def test_disabled_draft_model_is_the_ratings_and_a_grid_ranks(spark):
    df, _ = maps_df(spark, 120)
    none = spark.createDataFrame([], "match_id long, heroes_a array<int>, heroes_b array<int>, first_a boolean")
    plain = walkforward.walk_forward(df, {0: RatingConfig()}).first()
    off = walkforward.walk_forward_draft(df, none, {0: DraftConfig(disabled=True)}).first()
    assert off.brier == pytest.approx(plain.brier) and off.n_fallback == off.n == plain.n
    grid = walkforward.walk_forward(df, {0: RatingConfig(), 1: RatingConfig(tau=1.2)}, min_games=3).collect()
    assert grid[0].log_loss <= grid[1].log_loss and len(walkforward.rating_grid()) == 16 and len(walkforward.draft_grid()) == 27


def test_combiner_step():
    m = Combiner()
    x = [0.4, 0, 0, 0, 0, 1.0, 0]
    p = m.predict(x)
    m.update(x, 1.0, p)
    assert m.predict(x) > p and m.theta[2] == 0


def test_only_rows_without_a_value_are_joined_to_ancestors(spark, monkeypatch):
    """Rows without a link, or with a value, aren't sent to the task of a null key at every step; none is lost."""
    written = []
    monkeypatch.setattr(links, "materialize", lambda df, tag: written.append(df.localCheckpoint()) or written[-1])
    rows = [(i, i - 1 if i % 5 else None, i if i % 7 == 0 else None) for i in range(60)] + [(100, 101, None), (101, 100, None), (102, 999, None), (None, 7, None)]
    df = spark.createDataFrame(rows, "id long, up long, v long")
    got = {(r.id, r.up): r.v for r in links.inherit(df, "id", "up", "v").collect()}
    parent, value = {i: p for i, p, _ in rows}, {i: v for i, _, v in rows}

    def nearest(i, steps=0):
        return None if i is None or steps > 9 else value[i] if value.get(i) is not None else nearest(parent.get(i), steps + 1)

    assert got == {(i, p): nearest(i) for i, p, _ in rows}  # a row without a name is kept, unfilled
    opened = sum(v is None and p is not None for _, p, v in rows)
    assert [w.count() <= opened for w in written[1:]] == [True] * (len(written) - 1) and len(written) > 2


def test_draft_streams_take_no_map_apart(spark):
    """No row for each pair or matchup, no window by hero, and nothing joined once a configuration."""
    df, _ = maps_df(spark, 40)
    d = spark.createDataFrame([(m, [1, 2, 3, 4, 5 + m % 3], [11, 12, 13, 14, 15], True) for m in range(0, 40, 2)], "match_id long, heroes_a array<int>, heroes_b array<int>, first_a boolean")
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    out = plan(drafts.draft_features(rollups.running_games(df, ["start_time", "match_id"]), d))
    assert "Window" not in out and "Generate" not in out and "Join" not in out
    base = rollups.running_games(df, ["start_time", "match_id"]).withColumn("prob", F.lit(0.5))
    rows = walkforward.draft_predictions(base, d, walkforward.draft_grid())
    assert "Join" not in plan(rows) and rows.count() == 27 * 40 and rows.where("fallback").count() == 27 * 20


def test_combiner_folds_as_it_predicts_and_updates():
    rnd = random.Random(3)
    maps = [(rnd.randrange(2), rnd.random() < 0.7, [rnd.gauss(0, 20 if k == 50 else 1) for _ in range(7)]) for k in range(200)]
    plain, want = Combiner(), []
    for won, known, x in maps:
        want.append(plain.predict(x if known else x[:1]))
        if known:
            plain.update(x, float(won), want[-1])
    folded = Combiner()
    parts = [folded.fold([m[0] for m in part], [m[1] for m in part], *zip(*[m[2] for m in part], strict=True)) for part in (maps[:90], maps[90:])]
    assert sum(parts, []) == pytest.approx(want, abs=1e-12) and folded.theta == pytest.approx(plain.theta, abs=1e-12)


# --- closing lines, outcomes, settlement ---


def league(spark):
    m = spark.createDataFrame([(1, 555, 1, 1_000_000, 1, 2, 1), (2, 555, 1, 1_004_000, 2, 1, 0), (3, 556, 3, 2_000_000, 1, 2, 1)], "match_id long, series_id long, series_type int, start_time long, radiant_team_id long, dire_team_id long, radiant_win int")
    rows, n = [], 0
    for period, horn in ((1, 1_000_000), (2, 1_004_000)):
        for at, a, b, live in ((-300, 1.4, 2.9, 0), (-100, 1.5, 2.5, 0), (-50, 9.0, 1.01, 1), (10, 1.1, 7.0, 0)):
            for name, price in (("Alpha", a), ("Beta", b)):
                n += 1
                rows.append((n, "s", "1", period, name, None, price, horn + at, "1970-01-01T00:00:00Z" if period == 2 else None, "moneyline", "open", live))
    snaps = spark.createDataFrame(rows, "id long, source string, event_id string, period int, selection string, points double, price_decimal double, captured_at long, cutoff_at string, market_type string, status string, is_live int")
    events = spark.createDataFrame([("s", "1", 555, 0, None), ("s", "2", 555, 0, "1")], "source string, event_id string, series_id long, is_kills int, parent_event_id string")
    bounds = closing.horns(m).join(closing.closing_events(events), "series_id").select("series_id", "period", "source", "event_id", F.col("horn").alias("bound"))
    return m, closing.closing_lines(snaps, bounds)


def test_closing_line_is_strict_and_never_live(spark):
    m, lines = league(spark)
    got = {r.period: (r.book[0].price, r.probs[0], r.stale_cutoff) for r in lines.collect()}
    assert got.keys() == {1, 2} and got[1][0] == 1.5 and got[1][1] == pytest.approx(0.633333, abs=1e-6)
    assert (got[1][2], got[2][2]) == (False, True)


def test_clv_reasons_and_settlement(spark):
    m, lines = league(spark)
    rows = [(555, 1, "alpha", 1, 0.7, 1.6, 100.0), (555, 2, " BETA", 2, 0.5, None, 50.0), (555, 0, "alpha", 1, 0.6, 1.6, 10.0), (556, 0, "alpha", 1, 0.6, 1.6, 10.0), (777, 1, "x", None, 0.5, 2.0, 1.0), (555, 3, "alpha", 1, 0.5, 2.0, 1.0), (999, 1, "alpha", 1, 0.5, 2.0, None)]
    preds = spark.createDataFrame(rows, "series_id long, period int, selection string, team long, prob double, price_taken double, stake double")
    got = {(r.series_id, r.period): r for r in closing.clv_report(preds, lines, m).collect()}
    assert got[555, 1].reason is None and got[555, 1].clv == pytest.approx(1.6 * 0.633333 - 1, abs=1e-5) and got[555, 1].outcome == 1
    assert got[555, 2].reason is None and got[555, 2].clv is None and got[555, 2].outcome == 0
    assert {k: r.reason for k, r in got.items() if r.reason} == {(555, 0): "no closing line", (556, 0): "no closing line", (777, 1): "unresolved selection", (555, 3): "no closing line", (999, 1): "no closing line"}
    trades = {(r.series_id, r.period): (r.status, r.pnl, r.reason) for r in closing.settle(preds, lines, m).collect()}
    assert trades[555, 1] == ("settled", pytest.approx(60.0), None) and trades[555, 2][:2] == ("settled", -50.0)
    assert trades[555, 0][:2] == ("settled", pytest.approx(6.0)) and trades[556, 0] == ("unresolved", None, "series format has no winner")
    assert trades[555, 3] == ("pending", None, "map not played") and trades[777, 1][0] == "unresolved" and trades[999, 1][2] == "series not in matches"
    total = closing.settlement_summary(closing.settle(preds, lines, m)).first()
    assert (total.n_settled, total.n_pending, total.n_unresolved, total.staked) == (3, 1, 3, 160.0)


def test_totals_are_books_by_points(spark):
    rows = [(1, 8.5, "over", 1.9, 10), (2, 8.5, "under", 1.9, 10), (3, 9.5, "over", 2.2, 50), (4, 9.5, "under", 1.7, 50)]
    snaps = spark.createDataFrame([(i, "s", "1", 1, s, p, o, t, None, "total", "open", None) for i, p, s, o, t in rows], "id long, source string, event_id string, period int, selection string, points double, price_decimal double, captured_at long, cutoff_at string, market_type string, status string, is_live int")
    bounds = spark.createDataFrame([(5, 1, "s", "1", 100)], "series_id long, period int, source string, event_id string, bound long")
    (r,) = closing.closing_lines(snaps, bounds, "total").collect()
    assert r.points == 9.5 and len(r.book) == 2


# --- merges ---


def test_merges(spark):
    s = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k long, p string, v int")
    n = spark.createDataFrame([(2, None, 5, 1), (2, "z", None, 2), (3, "c", 3, 1)], "k long, p string, v int, seq int")
    key = lambda df: sorted((r.k, r.p, r.v) for r in df.collect())
    assert key(writers.upsert_coalesce(s, n, ["k"], "seq")) == [(1, "a", 1), (2, "z", 5), (3, "c", 3)]
    assert key(writers.upsert_replace(s, n, ["k"], "seq")) == [(1, "a", 1), (2, "z", None), (3, "c", 3)]
    assert key(writers.insert_ignore(s, n, ["k"], "seq")) == [(1, "a", 1), (2, "b", None), (3, "c", 3)]
    ids = writers.with_ids(s.repartition(3), 10, ["k"]).orderBy("k").collect()
    assert [r.id for r in ids] == [11, 12]


def test_a_grid_is_folded_without_a_join_and_equals_books(spark, monkeypatch):
    """Packed folds, with teams that play themselves, empty and missing lineups, against the plain book."""
    from dataclasses import asdict

    monkeypatch.setattr(ratings, "PACK", 3)
    monkeypatch.setattr(ratings, "FOLDED", 2)
    rnd = random.Random(7)
    five = lambda: rnd.choice([None, [], rnd.sample(range(9), 5), rnd.sample(range(9), 5)])
    rows = [(i, i // 2 * 40000, rnd.randrange(4), rnd.randrange(4), rnd.randrange(2), rnd.choice([None, 1, 2, 3]), five(), five()) for i in range(80)]
    df = spark.createDataFrame(rows, "match_id long, start_time long, a long, b long, win int, patch int, lineup_a array<long>, lineup_b array<long>")
    configs = {0: RatingConfig(), 3: RatingConfig(patch_rd_boost=40.0, roster_rd_boost=30.0), 4: RatingConfig(roster_rd_boost=60.0, idle_period_s=None)}
    got = {(r.config_id, r.match_id): (r.prob, r.games_a, r.games_b) for r in ratings.forecasts(df.repartition(5), configs).collect()}
    history = {(r.config_id, r.match_id, r.side): r for r in ratings.replay(df, configs).collect()}
    for k, c in configs.items():
        book = Book(asdict(c))
        for m, when, a, b, win, patch, one, two in rows:
            p, x, y = book.play(when, a, b, win, patch, frozenset(one or []) or None, frozenset(two or []) or None)
            assert got[k, m][0] == pytest.approx(p, abs=1e-11) and got[k, m][1:] == (x, y)
            r, (mu, phi, sigma, games, _, newest, lineup) = history[k, m, "b"], book.teams[b]
            assert (r.mu, r.phi, r.sigma) == pytest.approx((mu, phi, sigma), abs=1e-11)
            assert (r.last_patch, r.lineup) == (newest, sorted(lineup) if lineup else None)
    card = walkforward.walk_forward(df, configs)
    assert "Join" not in card.drop("x")._jdf.queryExecution().optimizedPlan().toString() and card.count() == 3


def test_drafts_are_combined_with_sure_maps(spark):
    """Deviations so wide that ratings part within few maps: the combiner gets every map, with a chance in [0, 1]."""
    rnd = random.Random(9)
    rows = [(i, 1000 * i, a, b, int(a < b) if i % 7 else int(a > b)) for i in range(300) for a, b in [rnd.sample(range(12), 2)]]
    df = spark.createDataFrame(rows, "match_id long, start_time long, a long, b long, win int")
    lineups = [(i, h[:5], h[5:], True) for i in range(300) if i % 5 for h in [rnd.sample(range(30), 10)]]
    picked = spark.createDataFrame(lineups, "match_id long, heroes_a array<int>, heroes_b array<int>, first_a boolean")
    wide = RatingConfig(initial_rd=8000.0, max_rd=8000.0)
    base = walkforward.predictions(df, {0: wide}).drop("config_id")
    out = walkforward.draft_predictions(base, picked, {0: DraftConfig()}).collect()
    assert len(out) == 300 and all(0 <= r.prob <= 1 for r in out)
    card = walkforward.walk_forward_draft(df, picked, {0: DraftConfig()}, wide).first()
    assert card.n == 300 and card.n_fallback == 60 and math.isfinite(card.log_loss)


def test_all_pairs_are_joined_in_blocks(spark, monkeypatch):
    """Whole and equal to a plain join, with doubles, null keys and ids and a key with most of the rows; the join itself sees blocks of ids."""
    monkeypatch.setattr(links, "LEFT_BLOCK", 4)
    monkeypatch.setattr(links, "RIGHT_BLOCK", 8)
    rnd = random.Random(3)
    side = lambda n: [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *range(n)])) for _ in range(n)]
    one, two = side(60), side(90)
    left, right = spark.createDataFrame(one, "x int, y int, e long").repartition(3), spark.createDataFrame(two, "x int, y int, m long").repartition(2)
    out = links.all_pairs(left, right, ["x", "y"], "e", "m")
    want = sorted(((e, m) for a, b, e in one for c, d, m in two if (a, b) == (c, d) and None not in (a, b)), key=repr)
    assert out.dtypes == [("e", "bigint"), ("m", "bigint")] and sorted(map(tuple, out.collect()), key=repr) == want
    assert out.select(F.spark_partition_id().alias("p")).toPandas().p.value_counts().max() < len(want) / 2


def test_either_side_join_forms_its_pairs_behind_the_join(spark):
    """Every row of the result is made of two blocks, which is what the join gives, and comes in runs of one map."""
    from tidemark import plans

    out = plans.QUERIES["either_side_join"](spark, "/root/testdata/sf0.01")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and plan.count("collect_list") == 2
    runs = out.withColumn("p", F.spark_partition_id()).toPandas()
    assert len(runs) > 10_000 and (runs.match_id != runs.match_id.shift()).sum() < len(runs) / 20


def test_closing_lines_shuffle_quotes_once(spark):
    """Quotes meet the bound of their event and are grouped by supersets of its keys: no stream of both sides, no window."""
    snaps = spark.createDataFrame([(1, "s", "1", 1, n, None, 2.0, 5, None, "moneyline", "open", 0) for n in "ab"], "id long, source string, event_id string, period int, selection string, points double, price_decimal double, captured_at long, cutoff_at string, market_type string, status string, is_live int")
    bounds = spark.createDataFrame([(7, 1, "s", "1", 9), (8, 1, "s", "1", 5)], "series_id long, period int, source string, event_id string, bound long")
    lines = closing.closing_lines(snaps, bounds)
    assert "Window" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.series_id, r.captured_at, len(r.book)) for r in lines.collect()] == [(7, 5, 2)]
