import gzip
import os
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import flatten, readers, writers
from tidemark.streaming import recorder

MATCH = {
    "match_id": 7, "start_time": 1000, "duration": 1800, "radiant_win": True, "radiant_team_id": 11, "dire_team_id": 0, "leagueid": 3, "patch": None, "series_id": 5, "series_type": 1,
    "radiant_gold_adv": [1, 2, 3], "radiant_xp_adv": [4], "radiant_team": {"team_id": 11, "name": "One"}, "dire_team": None, "league": {"leagueid": 3, "name": "Cup"},
    "picks_bans": [{"is_pick": False, "hero_id": 1, "team": 1}, {"order": 1, "is_pick": True, "hero_id": 2, "team": 0}, {"order": 2, "is_pick": True, "hero_id": None, "team": 0}],
    "players": [{"player_slot": s, "account_id": 100 + s, "hero_id": s + 1, "kills": 1, "deaths": 2, "assists": 3, "gold_per_min": 4, "xp_per_min": 5, "personaname": f"p{s}", "name": "" if s % 2 else None, "isRadiant": s < 128, "lane_role": None} for s in (0, 1, 128)],
}


def test_match_details(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MATCH))
    raw = readers.json_documents(spark, f"file://{tmp_path}/m.json", flatten.DETAIL)
    timeline = spark.createDataFrame([(500, 58), (2000, 59)], "released_at long, patch_id int")
    out = flatten.match_details(raw, F.lit(9999).cast("long"), timeline)
    assert all(out[n].schema == schemas.TABLES[n] or [f.dataType for f in out[n].schema] == [f.dataType for f in schemas.TABLES[n]] for n in out)
    m = out["matches"].first()
    assert (m.radiant_win, m.patch, m.league_name, m.radiant_name, m.dire_name, m.detail_fetched_at) == (1, 58, "Cup", "One", None, 9999)
    assert sorted((r.ord, r.is_pick, r.hero_id) for r in out["draft_events"].collect()) == [(0, 0, 1), (1, 1, 2)]
    assert [(r.minute, r.radiant_gold_adv, r.radiant_xp_adv) for r in out["match_timeseries"].orderBy("minute").collect()] == [(0, 1, 4), (1, 2, None), (2, 3, None)]
    assert {r.player_name for r in out["match_players"].collect()} == {"p0", "p1", "p128"}
    assert [(r.team_id, r.last_seen) for r in out["teams"].collect()] == [(11, 1000)]
    assert sorted((r.team_id, r.account_id) for r in out["rosters"].collect()) == [(11, 100), (11, 101)]
    assert readers.json_documents(spark, f"file://{tmp_path}/none.json", flatten.DETAIL).count() == 0


def test_bulk_rows_mark_only_complete_matches(spark):
    m = spark.createDataFrame([(1, 1000, True, 11, 12, "7.41"), (2, 1000, False, 11, 12, "7.41"), (3, 100, True, 11, 12, None)], "match_id long, start_time long, radiant_win boolean, radiant_team_id long, dire_team_id long, patch string")
    picks = spark.createDataFrame([(1, True, 5, 0, None), (1, False, 6, 1, None)], "match_id long, is_pick boolean, hero_id int, team int, `order` int")
    players = spark.createDataFrame([(k, s, 1) for k in (1, 3) for s in range(10)] + [(2, 0, 1)], "match_id long, player_slot int, account_id long")
    ids = spark.createDataFrame([("7.41", 60)], "patch string, patch_id int")
    timeline = spark.createDataFrame([(500, 58)], "released_at long, patch_id int")
    out = flatten.bulk_rows(m, picks, players, F.lit(77).cast("long"), ids, timeline)
    assert {r.match_id: (r.patch, r.detail_fetched_at) for r in out["matches"].collect()} == {1: (60, 77), 2: (60, None), 3: (None, None)}
    assert sorted(r.ord for r in out["draft_events"].collect()) == [0, 1]


def test_two_endpoint_quotes(spark):
    matchups = [
        {"id": 1, "startTime": "2026-08-14T08:00:00Z", "isLive": False, "units": None, "league": {"name": "Big Cup"}, "participants": [{"alignment": "away", "name": "B", "order": 1}, {"alignment": "home", "name": "A", "order": 0}]},
        {"id": 2, "league": {"name": "Other"}, "participants": []},
    ]
    markets = [
        {"matchupId": 1, "period": 0, "type": "moneyline", "status": "open", "limits": [{"amount": 5.0, "type": "min"}, {"amount": 500.0, "type": "maxRiskStake"}], "prices": [{"participantId": 902, "price": 120.0}, {"participantId": 901, "price": -150.0}]},
        {"matchupId": 1, "period": 1, "type": "spread", "status": "open", "prices": [{"designation": "home", "points": -1.5, "price": 100.0}, {"designation": "away", "points": 2.0, "price": 100.0}]},
        {"matchupId": 1, "period": 1, "type": "team_total", "side": "home", "status": "open", "prices": [{"designation": "over", "points": 9.5, "price": 100.0}]},
        {"matchupId": 2, "period": 0, "type": "moneyline", "prices": [{"designation": "home", "price": 100.0}]},
        {"matchupId": 3, "period": 0, "type": "moneyline", "prices": [{"designation": "home", "price": 100.0}]},
    ]
    read = lambda rows, schema: spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.from_json("v", schema).alias("r")).select("r.*")
    q = flatten.two_endpoint_quotes(read(matchups, flatten.MATCHUPS), read(markets, flatten.MARKETS), "book", "cup").collect()
    got = {r.line_key: (r.selection, r.price_decimal, r.limit_amount) for r in q}
    assert got == {
        "1|Regular|moneyline|0|A|": ("A", pytest.approx(1 + 100 / 150), 500.0), "1|Regular|moneyline|0|B|": ("B", 2.2, 500.0), "1|Regular|spread|1|A|-1.5": ("A", 2.0, None),
        "1|Regular|spread|1|B|2": ("B", 2.0, None), "1|Regular|team_total|1|A:over|9.5": ("A:over", 2.0, None),
    }


def test_many_book_quotes(spark):
    event = {"id": "e", "sport_title": "S", "commence_time": "2026-08-14T08:00:00Z", "home_team": "A", "away_team": "B", "bookmakers": [{"key": "bk", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 1.5}, {"name": "B", "price": 2.5}]}]}]}
    raw = spark.createDataFrame([(json.dumps(event),)], "v string").select(F.from_json("v", flatten.BOOKS).alias("r")).select("r.*")
    assert sorted((r.source, r.selection, r.price_american, r.status) for r in flatten.many_book_quotes(raw, "agg").collect()) == [("agg:bk", "A", -200.0, None), ("agg:bk", "B", 150.0, None)]


def test_predictions_and_aliases(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"series_id": 1, "period": 2, "selection": "A", "prob": 0.5}\n\n{"series_id": 2, "selection": "B", "prob": 0.25, "price_taken": 2.0}\n')
    assert sorted((r.series_id, r.period, r.market_type) for r in readers.predictions(spark, f"file://{tmp_path}/p.jsonl").collect()) == [(1, 2, "moneyline"), (2, 0, "moneyline")]
    (tmp_path / "q.jsonl").write_text('{"series_id": 1}\n\n{"series_id": 1, "odd": 1}\n')
    with pytest.raises(ValueError, match="q.jsonl:3: unknown keys odd"):
        readers.predictions(spark, f"file://{tmp_path}/q.jsonl").collect()
    teams = [{"team_id": 1, "name": "Alpha", "aliases": ["The  ALPHA"]}, {"team_id": 2, "name": "Beta"}]
    assert {r.key for r in readers.aliases(spark, teams).collect()} == {"alpha", "the alpha", "beta"}
    with pytest.raises(ValueError):
        readers.aliases(spark, [*teams, {"team_id": 3, "name": "beta"}])


def test_heroes(spark):
    heroes = spark.createDataFrame([(1, "npc_x_hero_antimage", "Anti-Mage"), (2, "npc_x_hero_axe", "Axe")], "id int, name string, localized_name string")
    extra = spark.createDataFrame([("am", 1), ("axe", 1)], "key string, hero_id int")
    asked = spark.createDataFrame([("anti mage",), ("AM",), ("axe",), ("2",), ("99",), ("zzz",)], "q string")
    got = {r.q: r.hero_id for r in readers.resolve_heroes(asked, "q", heroes, readers.hero_lookup(heroes, extra)).collect()}
    assert got == {"anti mage": 1, "AM": 1, "axe": 2, "2": 2, "99": None, "zzz": None}


def test_driver_side_helpers():
    asked = []

    def read(lo, hi):
        asked.append(hi - lo)
        if hi - lo > 2 * 86400:
            raise OSError
        return hi

    assert [x[2] for x in readers.slices(0, 8 * 86400, 8 * 86400, read)][-1] == 8 * 86400
    assert list(readers.slices(0, 2 * 86400, 86400, lambda lo, hi: 1 / 0)) == [(0, 86400, None), (86400, 2 * 86400, None)]
    assert [r["match_id"] for r in readers.pages(lambda before: [{"match_id": k} for k in range(9, 0, -1) if before is None or k < before][:4], 7)] == [9, 8, 7, 6, 5, 4, 3]
    waits, tries = [], iter([OSError(), OSError(), None])

    def call():
        if e := next(tries):
            raise e
        return "ok"

    assert readers.with_retries(call, sleep=waits.append) == "ok" and waits == [5.0, 10.0]
    reg = readers.Sources()
    reg.register("off", lambda: None)
    assert reg.build(["off"]) == {}
    with pytest.raises(ValueError):
        reg.build(["nope"])
    assert writers.should_archive(0, 100, 3700) and not writers.should_archive(0, 100, 3699) and recorder.poll_interval(True) == 20


def test_recorder_stream_equals_the_batch(spark, tmp_path):
    schema = "source string, line_key string, captured_at long, id long, price double, status string"
    polls = [[("s", "a", 1, 1, 1.5, "open"), ("s", "b", 1, 2, 2.0, "open")], [("s", "a", 2, 3, 1.5, "open")], [("s", "a", 3, 4, 1.6, "open"), ("s", "b", 3, 5, 2.0, "open")]]
    stored = f"{tmp_path}/stored"
    spark.createDataFrame([], schema).write.parquet(stored)
    for p in polls:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sink = recorder.Recorder(lambda: spark.read.schema(schema).parquet(stored), lambda df: df.write.mode("append").parquet(stored), ["source", "line_key"], ["price", "status"], ["price"], ["captured_at", "id"])
    for _ in range(2):  # a second run finds nothing new
        recorder.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/state").awaitTermination()
        got = sorted((r.line_key, r.captured_at, r.price, r.status) for r in spark.read.parquet(stored).collect() if r.status)
    assert sorted(got, key=str) == sorted([("a", 1, 1.5, "open"), ("b", 1, 2.0, "open"), ("b", 2, None, "gone"), ("a", 3, 1.6, "open"), ("b", 3, 2.0, "open")], key=str)


def test_archive_is_read_back(spark, tmp_path):
    """The later capture counts, whatever the files are called; landed files count too, broken ones don't."""
    link = lambda *pairs: json.dumps({"matchups": [{"id": i, "parentId": p} for i, p in pairs]}, indent=1)
    rows = [("book", 9_000_000_000, link((1, 10), (2, None))), ("book", 1_000_000_000, link((1, 99), (3, 30))), ("other", 9_500_000_000, link((1, 77)))]
    root = f"{tmp_path}/archive"
    for r in rows:
        writers.archive(spark.createDataFrame([r], "source string, captured_at long, payload string"), f"file://{root}")
    links = lambda: {r.event_id: r.parent_event_id for r in readers.parent_links(spark, f"file://{root}", "book").collect()}
    assert links() == {"1": "10", "3": "30"}
    os.makedirs(f"{root}/book/2286-01-01")
    with gzip.open(f"{root}/book/2286-01-01/9999999999.json.gz", "wt") as f:
        f.write(link((3, 31)))
    with open(f"{root}/book/2286-01-01/9999999998.json.gz", "wb") as f:
        f.write(b"no gzip")
    assert links() == {"1": "10", "3": "31"}
    assert readers.parent_links(spark, f"file://{root}", "nobody").collect() == []


def test_compacted_archive(spark, tmp_path):
    link = lambda *pairs: json.dumps({"matchups": [{"id": i, "parentId": p} for i, p in pairs]})
    root, day = f"file://{tmp_path}/archive", 86400
    rows = [("book", 10 * day, link((1, 10), (2, None))), ("book", 10 * day + 5, link((1, 11))), ("book", 12 * day, link((1, 12), (4, 40))), ("other", 10 * day, link((1, 77)))]
    for r in rows:
        writers.archive(spark.createDataFrame([r], "source string, captured_at long, payload string"), root)
    links = lambda **k: {r.event_id: r.parent_event_id for r in readers.parent_links(spark, root, "book", **k).collect()}
    want, after = links(), links(since="1970-01-12")
    assert want == {"1": "12", "4": "40"} and after == want
    assert writers.compact(spark, root, "book", "1970-01-12") == ["1970-01-11"] and links() == want
    assert not os.path.exists(f"{tmp_path}/archive/source=book/day=1970-01-11") and os.path.exists(f"{tmp_path}/archive/source=other")
    writers.archive(spark.createDataFrame([("book", 10 * day + 9, link((3, 30)))], "source string, captured_at long, payload string"), root)
    assert writers.compact(spark, root, "book", "1970-01-13") == ["1970-01-11"] and writers.compact(spark, root, "book", "1971-01-01") == ["1970-01-13"]
    assert writers.compact(spark, root, "book", "1971-01-01") == []
    assert links() == {**want, "3": "30"} and links(since="1970-01-13") == {"1": "12", "4": "40"}
    payloads = spark.read.parquet(f"{root}/_compacted/payloads")
    assert payloads.count() == 4 and payloads.where("day = '1970-01-11'").count() == 3
    links_read = writers.compacted(spark, root, "links", writers.LINKS).where("source = 'book' AND day >= '1970-01-13'")
    assert "PartitionFilters: [isnotnull(source" in links_read._jdf.queryExecution().executedPlan().toString()
    assert writers.compact(spark, f"{root}-none", "book", "1971-01-01") == []


def test_slices_are_pruned_and_named(spark):
    plain, full = readers.slice_sql("matches", 5, 9), readers.slice_sql("matches", 5, 9, True)
    assert "*" not in plain and "gold_adv" not in plain and "m.radiant_gold_adv, m.radiant_xp_adv FROM" in full
    assert "radiant_team_name AS radiant_name" in plain and "start_time >= 5 AND m.start_time < 9" in readers.slice_sql("picks_bans", 5, 9)


def test_patch_constants(spark, tmp_path):
    with open(f"{tmp_path}/patch.json", "w") as f:
        json.dump([{"id": 59, "name": "7.40", "date": "2025-12-15T00:00:00Z"}, {"id": 60, "name": "7.41", "date": "bad"}, {"id": 61, "date": "2026-01-01T00:00:00Z"}, {"name": "7.42"}], f)
    constants = readers.json_documents(spark, f"{tmp_path}/patch.json", "id int, name string, date string")
    assert {(r.patch, r.patch_id) for r in flatten.patch_ids(constants).collect()} == {("7.40", 59), ("7.41", 60)}
    assert [(r.released_at, r.patch_id) for r in flatten.patch_timeline(constants).collect()] == [(1765756800, 59), (1767225600, 61)]


def test_short_hero_names(spark):
    known = spark.createDataFrame([(1, "npc_dota_hero_antimage", "Anti-Mage"), (5, "npc_dota_hero_crystal_maiden", "Crystal Maiden"), (22, "npc_dota_hero_zuus", "Zeus")], "id int, name string, localized_name string")
    lookup = readers.hero_lookup(known, readers.hero_aliases(known))
    asked = spark.createDataFrame([("am",), ("CM",), ("5",), ("99",), ("zuus",), ("nobody",)], "q string")
    assert {r.q: r.hero_id for r in readers.resolve_heroes(asked, "q", known, lookup).collect()} == {"am": 1, "CM": 5, "5": 5, "99": None, "zuus": 22, "nobody": None}


def test_recorder_keeps_the_last_rows_and_numbers_new_ones(spark, tmp_path):
    schema = "source string, line_key string, captured_at long, id long, price double, status string"
    polls = [[("s", "a", 1, None, 1.5, "open"), ("s", "b", 1, None, 2.0, "open")], [("s", "a", 2, None, 1.5, "open")], [("s", "a", 3, None, 1.6, "open"), ("s", "b", 3, None, 2.0, "open")]]
    held = {"latest": spark.createDataFrame([], schema), "all": spark.createDataFrame([], schema)}
    put = lambda k: lambda df: held.update({k: spark.createDataFrame(df.collect(), schema)})
    sink = recorder.Recorder(lambda: held["latest"], lambda df: put("all")(held["all"].union(df)), ["source", "line_key"], ["price", "status"], ["price"], ["captured_at", "id"], put("latest"))
    for n, p in enumerate([*polls, polls[1]]):  # a poll that comes again is skipped
        sink(spark.createDataFrame(p, schema), n)
    got = sorted((r.id, r.line_key, r.captured_at, r.price, r.status) for r in held["all"].collect())
    assert got == [(1, "a", 1, 1.5, "open"), (2, "b", 1, 2.0, "open"), (3, "b", 2, None, "gone"), (4, "a", 3, 1.6, "open"), (5, "b", 3, 2.0, "open")]
    assert {(r.line_key, r.id) for r in held["latest"].collect()} == {("a", 4), ("b", 5)}


def test_sorted_json(spark):
    assert spark.range(1).selectExpr("1 AS b", "'x' AS a", "CAST(NULL AS INT) AS c").select(writers.sorted_json("b", "c", "a").alias("j")).first().j == '{"a":"x","b":1}'
