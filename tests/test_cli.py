import json
import math
import os
from glob import glob

import pytest

from tests.test_http import Remote
from tidemark import cli
from tidemark.operators import drafts, walkforward
from tidemark.schemas import TABLES

DAY = 86400


@pytest.fixture
def root(spark, tmp_path):
    """Maps of an old league and a cup; the cup's last map is undecided, and its second has no draft."""
    rows = [(k, 1, "old", k, 0, k * DAY, 1 + k % 2, 2 - k % 2, int(k % 3 > 0)) for k in range(1, 31)]
    rows += [(101, 2, "cup", 900, 1, 40 * DAY, 1, 2, 1), (102, 2, "cup", 900, 1, 40 * DAY + 3600, 2, 1, 1), (103, 2, "cup", 900, 1, 41 * DAY, 1, 2, 0), (104, 2, "cup", 900, 1, 41 * DAY + 9, 3, 4, 1), (105, 2, "cup", 901, 1, 42 * DAY, 1, 2, None)]
    names = "match_id league_id league_name series_id series_type start_time radiant_team_id dire_team_id radiant_win".split()
    full = [tuple(dict(zip(names, r, strict=True)).get(f.name) for f in TABLES["matches"].fields) for r in rows]
    spark.createDataFrame(full, TABLES["matches"]).write.parquet(f"{tmp_path}/matches")
    events = [(r[0], i, 1, (r[0] * 3 + i * 7) % 120, i % 2) for r in rows if r[0] != 102 for i in range(10)]
    spark.createDataFrame(events, TABLES["draft_events"]).write.parquet(f"{tmp_path}/draft_events")
    return str(tmp_path)


def run(spark, root, *argv):
    a = cli.parser().parse_args(["--root", root, *argv])
    a.run(spark, a)


def written(path):
    return {(r["series_id"], r["period"], r["selection"]): r["prob"] for f in glob(f"{path}/part-*") for r in map(json.loads, open(f))}


def test_predict_with_drafts(spark, root, capsys):
    argv = ["predict", "--league", "cup", "--model", "draft", "--out"]
    run(spark, root, *argv, f"{root}/p")
    assert "maps: 4; without a usable draft: 1" in capsys.readouterr().out
    got = written(f"{root}/p")
    base = walkforward.predictions(cli.maps_of(spark, root), {0: cli.rating_config(cli.parser().parse_args(["--root", root, *argv, "x"]))}).drop("config_id")
    own = drafts.complete_drafts(spark.read.parquet(f"{root}/draft_events"))
    want = {r.match_id: r.prob for r in walkforward.draft_predictions(base, own, {0: drafts.DraftConfig()}).collect()}
    maps = {101: (1, "1", "2"), 102: (2, "2", "1"), 103: (3, "1", "2"), 104: (4, "3", "4")}
    assert got == {(900, p, name): pytest.approx(q, abs=1e-6) for k, (p, a, b) in maps.items() for name, q in ((a, want[k]), (b, 1 - want[k]))}
    run(spark, root, *argv, f"{root}/q", "--learning-rate", "0.9")
    assert written(f"{root}/q") != got


def test_match_report(spark, root, capsys):
    frozen = spark.createDataFrame([(900, 1, 2, 0.75)], "series_id long, a long, b long, p_map double")
    m = cli.readers.table(spark, root, "matches").selectExpr("series_id", "start_time", "radiant_team_id a", "dire_team_id b", "radiant_win win")
    whole, days = walkforward.match_report(frozen, m)
    won, lost = -math.log(0.75), -math.log(0.25)
    assert [(r.n, r.brier, pytest.approx(r.log_loss)) for r in whole.collect()] == [(3, pytest.approx((0.0625 + 2 * 0.5625) / 3), (won + 2 * lost) / 3)]
    assert [(r.day, r.n, pytest.approx(r.log_loss)) for r in days.collect()] == [("1970-02-10", 2, (won + lost) / 2), ("1970-02-11", 1, lost)]
    run(spark, root, "predict", "--league", "cup")
    assert "1970-02-10" in capsys.readouterr().out


def test_backtest_holds_out_the_event(spark, root, capsys):
    for model in ("ratings", "draft"):
        argv = ["backtest", "--model", model, "--burn-in", "0", "--min-games", "0"]
        run(spark, root, *argv)
        assert "holdout: none\n34 " in capsys.readouterr().out
        run(spark, root, *argv, "--league", "cup")
        assert f"holdout: nothing at or after {40 * DAY}\n30 " in capsys.readouterr().out


def test_bet_finds_teams_series_and_heroes(spark, root, tmp_path):
    with open(f"{tmp_path}/teams.json", "w") as f:
        json.dump({"teams": [{"team_id": 1, "name": "Alpha", "aliases": ["A"]}, {"team_id": 2, "name": "Beta"}, {"team_id": 9, "name": "Ninth"}]}, f)
    with open(f"{tmp_path}/heroes.json", "w") as f:
        json.dump([{"id": k, "name": f"npc_dota_hero_h{k}", "localized_name": n} for k, n in enumerate(["Anti-Mage", "Zeus", *[f"H {x}" for x in "abcdefgh"]], 1)], f)
    ask = lambda *argv: cli.parser().parse_args(["--root", root, "bet", "--aliases", f"{tmp_path}/teams.json", "--log", "x", "--heroes", f"{tmp_path}/heroes.json", *argv])
    assert cli._fixture(spark, ask("--team-a", "alpha", "--team-b", "2")) == (901, 1, 2)
    assert cli._fixture(spark, ask("--series", "900")) == (900, 1, 2) and cli._fixture(spark, ask("--series", "900", "--team-a", "Beta")) == (900, 2, 1)
    for bad in (["--team-a", "alpha"], ["--team-a", "alpha", "--team-b", "Gamma"], ["--team-a", "alpha", "--team-b", "ninth"], ["--series", "12345"]):
        with pytest.raises(SystemExit):
            cli._fixture(spark, ask(*bad))
    assert cli._heroes(spark, ask("--heroes-a", "am", "h a", "4", "h c", "6", "--heroes-b", "zuus", "h e", "8", "9", "10")) == ([1, 3, 4, 5, 6], [2, 7, 8, 9, 10])
    assert cli._heroes(spark, ask()) == ([], [])
    for bad in (["--heroes-a", "1"], ["--heroes-a", *"12345", "--heroes-b", *"56789"], ["--heroes-a", *"1234x", "--heroes-b", *"56789"]):
        with pytest.raises(SystemExit):
            cli._heroes(spark, ask(*bad))


def test_a_table_put_aside_is_still_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 5)], TABLES["teams"])
    cli.store(df, str(tmp_path), "teams")
    cli.store(df.union(df), str(tmp_path), "teams")
    assert sorted(p for p in os.listdir(tmp_path)) == ["teams"] and cli.readers.table(spark, str(tmp_path), "teams").count() == 2
    os.rename(f"{tmp_path}/teams", f"{tmp_path}/teams.old")
    assert cli.readers.table(spark, str(tmp_path), "teams").count() == 2


class Pages(Remote):
    """Summaries of maps in pages, details, and SQL slices."""

    def answer(self, path, query):
        if path == "/proMatches":
            below = int(query.get("less_than_match_id", 10**9))
            return 200, [{"match_id": k, "leagueid": 2 - k % 2, "start_time": k * DAY, "radiant_team_id": 1, "dire_team_id": 2, "radiant_win": True} for k in range(40, 0, -1) if k < below][:9], {}
        if path.startswith("/matches/"):
            return 200, {"match_id": int(path.rsplit("/", 1)[1]), "duration": 60, "radiant_win": True}, {}
        if "FROM matches" in query.get("sql", ""):
            return 200, {"rows": [{"match_id": 7, "start_time": 7 * DAY, "radiant_win": True, "patch": "7.41"}]}, {}
        return 200, {"rows": []}, {}


@pytest.fixture
def remote():
    out = Pages()
    yield out
    out.server.shutdown()


def test_backfill_resume_detail_and_bulk_slices(spark, remote, tmp_path, capsys):
    root = str(tmp_path)
    stored = lambda: {r.match_id: r for r in cli.readers.table(spark, root, "matches").collect()}
    away = ["--url", remote.url, "--delay", "0"]
    run(spark, root, "backfill", *away, "--max-matches", "10")
    assert set(stored()) == set(range(31, 41))
    run(spark, root, "backfill", *away, "--max-matches", "5", "--resume")
    assert set(stored()) == set(range(26, 41))
    run(spark, root, "backfill", *away, "--before-match-id", "9", "--league-id", "1")
    assert set(stored()) == {*range(26, 41), 1, 3, 5, 7}
    run(spark, root, "detail", *away, "--limit", "4")
    assert sum(r.detail_fetched_at is not None and r.duration == 60 for r in stored().values()) == 4
    with open(f"{root}/patch.json", "w") as f:
        json.dump([{"id": 61, "name": "7.41", "date": "1970-01-01T00:00:00Z"}], f)
    run(spark, root, "bulkfill", "--url", remote.url, "--patches", f"{root}/patch.json", "--slice-days", "100")
    assert stored()[7].patch == 61 and "failed slices: 0" in capsys.readouterr().out


def test_quoted_names(spark, root):
    quotes = [("b", "l", "e", h, a, t) for h, a, t in (("Spirit", "Other", 5), ("Old", "Other", 1))]
    snaps = spark.createDataFrame([tuple(dict(zip(("source", "line_key", "event_id", "home", "away", "captured_at"), q, strict=True)).get(f.name) for f in TABLES["odds_snapshots"].fields) for q in quotes], TABLES["odds_snapshots"])
    events = spark.createDataFrame([("book", "e", None, 0, None, 2, 1, 900, 0, 0)], TABLES["event_series_map"])
    snaps.selectExpr("*").withColumn("source", cli.F.lit("book")).write.parquet(f"{root}/odds_snapshots")
    events.write.parquet(f"{root}/event_series_map")
    for model in ("ratings", "draft"):
        run(spark, root, "predict", "--league", "cup", "--model", model, "--out", f"{root}/{model}")
        assert {s for series, _, s in written(f"{root}/{model}") if series == 900} == ({"Spirit", "Other"} if model == "ratings" else {"Spirit", "Other", "3", "4"})


def test_record_odds_once_by_sources(spark, tmp_path, capsys):
    from tests.test_supervisor import Books

    books, root = Books(), str(tmp_path)
    with open(f"{root}/settings.json", "w") as f:
        json.dump({"two_endpoint": {"url": books.url, "delay": 0}, "many_books": {}}, f)
    argv = ["record-odds", "--once", "--settings", f"{root}/settings.json", "--sources", "two_endpoint"]
    run(spark, root, *argv, "many_books")
    assert "'written': 2" in capsys.readouterr().out
    assert sorted((r.id, r.selection, r.price_american) for r in cli.readers.table(spark, root, "odds_snapshots").collect()) == [(1, "A", 150.0), (2, "B", -170.0)]
    assert len(glob(f"{root}/archive/source=two_endpoint/*/*/*.gz")) == 1
    with pytest.raises(SystemExit):
        run(spark, root, *argv, "nobody")
    with pytest.raises(SystemExit):
        run(spark, root, "record-odds", "--once")
    run(spark, root, "status")
    assert "moneyline" in capsys.readouterr().out
    books.server.shutdown()


def test_predict_from_a_snapshot(spark, root, monkeypatch):
    folded = []
    replay = cli.ratings.replay
    monkeypatch.setattr(cli.ratings, "replay", lambda maps, *a: (folded.append(maps.count()), replay(maps, *a))[1])
    run(spark, root, "predict", "--league", "cup", "--out", f"{root}/first")
    run(spark, root, "predict", "--league", "cup", "--out", f"{root}/second")
    assert written(f"{root}/first") == written(f"{root}/second") and folded[1] < folded[0]
