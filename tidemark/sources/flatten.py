"""Nested JSON payloads to flat tables, with declared schemas and Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import american_to_decimal, decimal_to_american, flag, nonzero, or_else
from ..operators.links import patch_of
from ..schemas import TABLES

SUMMARY = (
    "match_id long, duration int, start_time long, radiant_team_id long, radiant_name string, dire_team_id long, dire_name string, leagueid long, league_name string, "
    "series_id long, series_type int, radiant_score int, dire_score int, radiant_win boolean, version int"
)
DETAIL = (
    "match_id long, duration int, start_time long, pre_game_duration int, patch int, radiant_team_id long, dire_team_id long, leagueid long, series_id long, series_type int, radiant_score int, dire_score int, "
    "radiant_win boolean, radiant_gold_adv array<int>, radiant_xp_adv array<int>, radiant_team struct<team_id: long, name: string>, dire_team struct<team_id: long, name: string>, league struct<leagueid: long, name: string>, "
    "picks_bans array<struct<`order`: int, is_pick: boolean, hero_id: int, team: int>>, "
    "players array<struct<player_slot: int, account_id: long, hero_id: int, kills: int, deaths: int, assists: int, gold_per_min: int, xp_per_min: int, personaname: string, name: string, isRadiant: boolean, lane_role: int>>"
)
MATCHUPS = (
    "id long, startTime string, isLive boolean, parentId long, units string, bestOfX int, league struct<name: string>, participants array<struct<alignment: string, name: string, `order`: int>>"
)
MARKETS = (
    "matchupId long, period int, type string, status string, cutoffAt string, `key` string, side string, limits array<struct<amount: double, type: string>>, "
    "prices array<struct<designation: string, participantId: long, points: double, price: double>>"
)
BOOKS = (
    "id string, sport_title string, commence_time string, home_team string, away_team string, bookmakers array<struct<`key`: string, title: string, "
    "markets: array<struct<`key`: string, outcomes: array<struct<name: string, price: double, point: double>>>>>>"
)


def _as(df: DataFrame, table: str) -> DataFrame:
    """df in the columns and types of a table, nulls for what it lacks."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


def match_summaries(raw: DataFrame) -> DataFrame:
    """matches rows of summaries (SUMMARY)."""
    return _as(raw.withColumnRenamed("leagueid", "league_id").withColumn("radiant_win", flag(F.col("radiant_win"))), "matches")


def match_details(raw: DataFrame, fetched_at: Column, timeline: DataFrame | None = None) -> dict[str, DataFrame]:
    """One nested document (DETAIL) to six tables: matches, draft_events, match_players, match_timeseries, teams, rosters.

    Documents without players or picks give no rows there. A name falls back from name to personaname, an empty one
    too. Arrays of unequal length are padded with nulls.
    """
    name = lambda side: or_else(F.col(f"{side}_team.name"), F.lit(None).cast("string"))
    head = raw.withColumns({
        "radiant_name": name("radiant"), "dire_name": name("dire"), "radiant_team_id": F.coalesce("radiant_team_id", "radiant_team.team_id"), "dire_team_id": F.coalesce("dire_team_id", "dire_team.team_id"),
        "league_id": F.coalesce("leagueid", "league.leagueid"), "league_name": F.col("league.name"), "detail_fetched_at": fetched_at,
    })
    matches = _as(head.withColumn("radiant_win", flag(F.col("radiant_win"))), "matches")
    if timeline is not None:
        matches = patch_of(matches, timeline, "start_time")
    drafts = raw.select("match_id", F.posexplode("picks_bans").alias("pos", "p")).select("match_id", F.coalesce("p.order", "pos").alias("ord"), flag(F.col("p.is_pick")).alias("is_pick"), "p.hero_id", "p.team").where("hero_id IS NOT NULL")
    each = head.select("match_id", "start_time", "radiant_team_id", "dire_team_id", "detail_fetched_at", F.explode("players").alias("p")).select("*", "p.*").withColumns({
        "player_name": or_else(F.col("name"), F.col("personaname")), "is_radiant": flag(F.coalesce("isRadiant", F.col("player_slot") < 128)),
    })
    series = raw.select("match_id", F.posexplode(F.arrays_zip(F.coalesce("radiant_gold_adv", F.array().cast("array<int>")), F.coalesce("radiant_xp_adv", F.array().cast("array<int>")))).alias("minute", "v"))
    series = series.select("match_id", "minute", F.col("v")["0"].alias("radiant_gold_adv"), F.col("v")["1"].alias("radiant_xp_adv"))
    return {
        "matches": matches, "draft_events": _as(drafts, "draft_events"), "match_players": _as(each.where("player_slot IS NOT NULL"), "match_players"), "match_timeseries": _as(series, "match_timeseries"),
        "teams": team_rows(head), "rosters": roster_rows(each),
    }


def team_rows(matches: DataFrame) -> DataFrame:
    """(team_id, name, last_seen) of both sides; a team id of null or 0 is none."""
    at = F.coalesce("start_time", "detail_fetched_at") if "detail_fetched_at" in matches.columns else F.col("start_time")
    sides = F.array(*[F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_name").alias("name"), at.alias("last_seen")) for s in ("radiant", "dire")])
    return _as(matches.select(F.explode(sides).alias("t")).select("t.*").where(nonzero(F.col("team_id")).isNotNull()), "teams")


def roster_rows(players: DataFrame) -> DataFrame:
    """(team_id, account_id, player_name, observed_at) of each player; observed at the start, else when fetched."""
    team = F.when(F.col("is_radiant") == 1, F.col("radiant_team_id")).otherwise(F.col("dire_team_id"))
    rows = players.withColumns({"team_id": nonzero(team), "observed_at": F.coalesce("start_time", "detail_fetched_at")})
    return _as(rows.where("team_id IS NOT NULL AND account_id IS NOT NULL"), "rosters")


def bulk_rows(matches: DataFrame, picks: DataFrame, players: DataFrame, fetched_at: Column, patch_ids: DataFrame, timeline: DataFrame) -> dict[str, DataFrame]:
    """The same six tables from three flat inputs. patch_ids: patch (name), patch_id; the timeline fills what lags.

    detail_fetched_at is set only where the patch is known and exactly ten players are there (drafts don't matter).
    """
    named = matches.withColumnRenamed("patch", "patch_name").join(patch_ids.select(F.col("patch").alias("patch_name"), F.col("patch_id").cast("int").alias("patch")), "patch_name", "left")
    named = patch_of(named, timeline, "start_time")
    ten = players.groupBy("match_id").agg(F.count("*").alias("n"))
    done = named.join(ten, "match_id", "left").withColumn("detail_fetched_at", F.when(F.col("patch").isNotNull() & (F.col("n") == 10), fetched_at))
    if "leagueid" in done.columns:
        done = done.withColumnRenamed("leagueid", "league_id")
    head = _as(done.withColumn("radiant_win", F.col("radiant_win").cast("int")), "matches")
    w = Window.partitionBy("match_id").orderBy(F.asc_nulls_last("order"), "hero_id", "team")
    drafts = picks.where("hero_id IS NOT NULL").withColumns({"ord": F.coalesce("order", F.row_number().over(w) - 1), "is_pick": F.col("is_pick").cast("int")})
    each = players.join(head.select("match_id", "start_time", "radiant_team_id", "dire_team_id", fetched_at.alias("detail_fetched_at")), "match_id").withColumn("is_radiant", (F.col("player_slot") < 128).cast("int"))
    arrays = [c for c in ("radiant_gold_adv", "radiant_xp_adv") if c in matches.columns]
    if len(arrays) == 2:
        minutes = matches.select("match_id", F.posexplode(F.arrays_zip(*arrays)).alias("minute", "v")).select("match_id", "minute", *[F.col(f"v.{c}").alias(c) for c in arrays])
    else:
        minutes = matches.select("match_id").limit(0)
    return {"matches": head, "draft_events": _as(drafts, "draft_events"), "match_players": _as(each, "match_players"), "match_timeseries": _as(minutes, "match_timeseries"), "teams": team_rows(head), "rosters": roster_rows(each)}


def known_only(rows: DataFrame, known: DataFrame, on: str = "match_id") -> tuple[DataFrame, DataFrame]:
    """(rows of known ids, once each; number of rows skipped)."""
    return rows.dropDuplicates().join(known, on, "left_semi"), rows.join(known, on, "left_anti").agg(F.count("*").alias("skipped"))


def patch_ids(constants: DataFrame) -> DataFrame:
    """(patch, patch_id): the ids of patch names of entries (id, name)."""
    return constants.select(F.col("name").alias("patch"), F.col("id").cast("int").alias("patch_id")).dropna().dropDuplicates(["patch"])


def patch_timeline(constants: DataFrame) -> DataFrame:
    """(released_at, patch_id) of entries (id, date) with both, in order of release; unreadable dates drop out."""
    return constants.select(F.unix_seconds(F.col("date").try_cast("timestamp")).alias("released_at"), F.col("id").cast("int").alias("patch_id")).dropna().orderBy("released_at", "patch_id")


def _text(number: Column) -> Column:
    """Points as a key part: whole numbers without decimals, so that 2 and 2.0 are one line."""
    return F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def line_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def two_endpoint_quotes(matchups: DataFrame, markets: DataFrame, source: str, league_filter: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """Quotes of a book with matchups (MATCHUPS) and straight markets (MARKETS), joined by id; orphans drop out. Columns in
    by, as the time of the poll, are joined on too and come last.

    A selection is its designation (home and away as team names), else the participant whose rank among the market's
    ids is that of the id; team totals carry their team. The limit is the first of type maxRiskStake.
    """
    picked = matchups if not league_filter else matchups.where(F.contains(F.lower(F.coalesce("league.name", F.lit(""))), F.lit(league_filter.lower())))
    named = lambda side: F.try_element_at(F.filter("participants", lambda p: p["alignment"] == side), F.lit(1))["name"]
    ordered = F.transform(F.array_sort(F.transform("participants", lambda p: F.struct(p["order"].alias("o"), p["name"].alias("n")))), lambda p: p["n"])
    games = picked.select(*by, F.col("id").alias("matchupId"), F.col("league.name").alias("league"), named("home").alias("home"), named("away").alias("away"), ordered.alias("ordered"), "startTime", "units", F.coalesce(flag(F.col("isLive")), F.lit(0)).alias("is_live"))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("prices", lambda p: p["participantId"]), lambda x: x.isNotNull())))
    limit = F.try_element_at(F.filter("limits", lambda x: x["type"] == "maxRiskStake"), F.lit(1))["amount"]
    rows = markets.join(games, [*by, "matchupId"]).withColumns({"ids": ids, "limit_amount": limit}).withColumn("p", F.explode("prices"))
    given = F.col("p.designation")
    ranked = F.coalesce(F.get("ordered", (F.array_position("ids", F.col("p.participantId")) - 1).cast("int")), F.col("p.participantId").cast("string"))
    plain = F.when(given == "home", or_else(F.col("home"), given)).when(given == "away", or_else(F.col("away"), given)).when(given.isNotNull(), given).otherwise(F.when(F.col("p.participantId").isNotNull(), ranked))
    team = F.when(F.col("side") == "home", F.col("home")).when(F.col("side") == "away", F.col("away"))
    selection = F.when(F.col("side").isNotNull() & plain.isNotNull(), F.concat(or_else(team, F.col("side")), F.lit(":"), plain)).otherwise(plain)
    out = rows.withColumns({"selection": selection, "points": F.col("p.points"), "price_american": F.col("p.price"), "source": F.lit(source), "event_id": F.col("matchupId").cast("string"), "start_time": F.col("startTime"), "market_type": F.col("type"), "cutoff_at": F.col("cutoffAt")})
    out = out.where(F.col("selection").isNotNull()).withColumns({
        "price_decimal": american_to_decimal(F.col("price_american")),
        "line_key": line_key(F.col("event_id"), or_else(F.col("units"), F.lit("Regular")), F.col("market_type"), F.col("period"), F.col("selection"), _text(F.col("points"))),
    })
    return out.select("source", "line_key", "event_id", "league", "home", "away", "start_time", "market_type", "period", "units", "selection", "points", "price_american", "price_decimal", "limit_amount", "is_live", "status", "cutoff_at", *by)


def many_book_quotes(events: DataFrame, source: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Quotes of an aggregator (BOOKS): events x books x markets x outcomes, with the columns in by. Units are the
    regular ones and the cutoff is the start; whether it is live, the limit and the status are unknown: null."""
    x = events.withColumn("b", F.explode("bookmakers")).withColumn("m", F.explode("b.markets")).withColumn("o", F.explode("m.outcomes"))
    x = x.withColumns({"source": F.concat_ws(":", F.lit(source), F.col("b.key")), "market_type": F.col("m.key"), "selection": F.col("o.name"), "points": F.col("o.point"), "price_decimal": F.col("o.price"), "period": F.lit(0)})
    none = lambda kind: F.lit(None).cast(kind)
    x = x.withColumns({"price_american": decimal_to_american(F.col("price_decimal")), "line_key": line_key(F.col("id"), F.col("b.key"), F.col("market_type"), F.col("period"), F.col("selection"), _text(F.col("points")))})
    return x.select(
        "source", "line_key", F.col("id").alias("event_id"), F.col("sport_title").alias("league"), F.col("home_team").alias("home"), F.col("away_team").alias("away"), F.col("commence_time").alias("start_time"), "market_type", "period",
        F.lit("Regular").alias("units"), "selection", "points", "price_american", "price_decimal", none("double").alias("limit_amount"), none("int").alias("is_live"), none("string").alias("status"), F.col("commence_time").alias("cutoff_at"), *by,
    )
