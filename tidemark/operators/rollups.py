"""Aggregates, windows and set operations of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import brier, log_loss
from ..functions.scalars import day_of, lineup_of, wins_needed

#: Parts of the names of top leagues.
TOP_LEAGUES = ["international", "major", "dreamleague", "esl one", "betboom", "pgl", "riyadh", "blast", "fissure", "elite league", "epl", "wallachia", "games of the future"]


def decided(matches: DataFrame, after: int | None = None, before: int | None = None) -> DataFrame:
    """Maps with a winner, a start and both teams; after counts, before doesn't. Order by (start_time, match_id)."""
    out = matches.where("radiant_win IS NOT NULL AND start_time IS NOT NULL AND radiant_team_id IS NOT NULL AND dire_team_id IS NOT NULL")
    out = out if after is None else out.where(F.col("start_time") >= after)
    return out if before is None else out.where(F.col("start_time") < before)


def needing_detail(matches: DataFrame, limit: int) -> DataFrame:
    return matches.where("detail_fetched_at IS NULL").orderBy(F.desc_nulls_last("start_time"), F.desc("match_id")).limit(limit)


def oldest_match(matches: DataFrame) -> DataFrame:
    return matches.agg(F.min("match_id").alias("match_id"))


def leagues_named(matches: DataFrame, parts: list[str] = TOP_LEAGUES) -> DataFrame:
    """Distinct league ids whose name holds one of parts, in any case."""
    name = F.lower("league_name")
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(name, F.lit(p))
    return matches.where(hit).select("league_id").distinct()


def league_id_for(matches: DataFrame, name: str) -> DataFrame:
    """The smallest id of the league of exactly that name."""
    return matches.where(F.col("league_name") == name).agg(F.min("league_id").alias("league_id"))


def first_in(df: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    row = F.min_by(F.struct(*value), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in value])


def nth_in(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n-th row of each group, from 1. One window over the group's rows."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") == n).drop("__k")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "period") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """TakeOrderedAndProject: each task keeps k rows."""
    return df.orderBy(*order).limit(k)


def lineups(players: DataFrame, keys: list[str], account: str) -> DataFrame:
    """keys, lineup: sorted ids of the groups with exactly five distinct ones."""
    return players.where(F.col(account).isNotNull()).groupBy(*keys).agg(lineup_of(F.col(account)).alias("lineup")).where("lineup IS NOT NULL")


def running_games(maps: DataFrame, order: list[str]) -> DataFrame:
    """maps with games_a and games_b: maps that each team played before. Teams are unpivoted, so that a team's maps on
    either side count together."""
    keys = ["match_id", *[c for c in order if c != "match_id"]]
    sides = maps.select(*keys, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("team")), F.struct(F.lit("b").alias("side"), F.col("b").alias("team")))).alias("x")).select(*keys, "x.*")
    w = Window.partitionBy("team").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = sides.withColumn("n", F.count("*").over(w)).groupBy("match_id").agg(F.max(F.when(F.col("side") == "a", F.col("n"))).alias("games_a"), F.max(F.when(F.col("side") == "b", F.col("n"))).alias("games_b"))
    return maps.join(n, "match_id")


def scorecard(df: DataFrame, by: list[str] = (), prob: str = "prob", outcome: str = "outcome", fallback: str | None = None) -> DataFrame:
    """n, brier, log_loss (null without rows) and n_fallback, by group."""
    p, y = F.col(prob), F.col(outcome)
    return df.groupBy(*by).agg(
        F.count("*").cast("long").alias("n"), F.avg(brier(p, y)).alias("brier"), F.avg(log_loss(p, y)).alias("log_loss"),
        (F.count_if(F.col(fallback)) if fallback else F.lit(0)).cast("long").alias("n_fallback"),
    )


def scorecard_by_day(df: DataFrame, at: str, **kw) -> DataFrame:
    return scorecard(df.withColumn("day", day_of(F.col(at))), ["day"], **kw)


def series_outcome(maps: DataFrame) -> DataFrame:
    """series_id, team, outcome (1, 0 or null) and reason, for every team of every series.

    maps: match_id, series_id, series_type, start_time, a, b, win (1: a won). The type is that of the series' first map; who
    first has the wins it needs has won.
    """
    sides = maps.select("series_id", "match_id", "start_time", "series_type", F.explode(F.array(F.struct(F.col("a").alias("team"), F.col("win").alias("won")), F.struct(F.col("b").alias("team"), (1 - F.col("win")).alias("won")))).alias("x")).select("series_id", "match_id", "start_time", "series_type", "x.*")
    tally = sides.groupBy("series_id", "team").agg(F.sum("won").alias("wins"), F.sum(1 - F.col("won")).alias("losses"))
    kind = first_in(maps, ["series_id"], ["start_time", "match_id"], ["series_type"])
    need = wins_needed(F.col("series_type"))
    out = tally.join(kind, "series_id").withColumn("need", need)
    return out.select(
        "series_id", "team",
        F.when(F.col("wins") >= F.col("need"), 1).when(F.col("losses") >= F.col("need"), 0).alias("outcome"),
        F.when(F.col("need").isNull(), "series format has no winner").when(F.greatest("wins", "losses") < F.col("need"), "series undecided").when(F.col("wins").isNull(), "series undecided").alias("reason"),
    )


def status_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts over the stored tables, in one row."""
    m, q = tables["matches"], tables["odds_snapshots"]
    head = m.agg(F.count("*").alias("matches"), F.count("detail_fetched_at").alias("with_detail"), F.count("patch").alias("with_patch"))
    lines = q.agg(F.count("*").alias("snapshots"), F.countDistinct("line_key").alias("lines"), F.countDistinct("event_id").alias("events"), F.min("captured_at").alias("first_capture"), F.max("captured_at").alias("last_capture"))
    return head.join(lines)


def odds_coverage(snapshots: DataFrame, k: int = 10) -> DataFrame:
    """league, market_type, n (snapshots), events: the k with the most snapshots, ties in order of the names."""
    each = snapshots.groupBy("league", "market_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))
    return top_k(each, k, F.desc("n"), F.asc_nulls_first("league"), F.asc_nulls_first("market_type"))


def unfetched_span(matches: DataFrame) -> tuple[int | None, int | None]:
    """The first and the last start of maps without detail."""
    return tuple(matches.where("detail_fetched_at IS NULL").agg(F.min("start_time"), F.max("start_time")).first())


def event_series(matches: DataFrame, league: str, quoted: DataFrame) -> DataFrame:
    """Every real series of a league: series_id, series_type, when, n_maps, a, b, name_a, name_b, patch.

    Teams are those of its first map, also of another league, and without both it is left out. Names are what the book
    calls them (quoted: series_id, team_id, name), else the map's, else the id. a and b may stand on either side there.
    """
    mine = matches.join(league_id_for(matches, league), "league_id", "left_semi").where("series_id > 0 AND start_time IS NOT NULL")
    when = mine.groupBy("series_id").agg(F.min("start_time").alias("when"), F.count("*").alias("n_maps"))
    first = first_in(matches.join(when.select("series_id"), "series_id", "left_semi").where("start_time IS NOT NULL"), ["series_id"], ["start_time", "match_id"], ["series_type", "radiant_team_id", "dire_team_id", "radiant_name", "dire_name", "patch"])
    out = first.join(when, "series_id").where("radiant_team_id IS NOT NULL AND dire_team_id IS NOT NULL").withColumnsRenamed({"radiant_team_id": "a", "dire_team_id": "b"})
    for side, name in (("a", "radiant_name"), ("b", "dire_name")):
        names = quoted.select("series_id", F.col("team_id").alias(side), F.col("name").alias(f"__quoted_{side}")).dropDuplicates(["series_id", side])
        out = out.join(names, ["series_id", side], "left").withColumn(f"name_{side}", F.coalesce(f"__quoted_{side}", F.nullif(name, F.lit("")), F.col(side).cast("string")))
    return out.select("series_id", "series_type", "when", "n_maps", "a", "b", "name_a", "name_b", "patch")


def coverage_report(matches: DataFrame, drafts: DataFrame, players: DataFrame) -> DataFrame:
    """total, detail, patch, draft (any event) and players (ten rows), and the percentage of detail."""
    d = drafts.select("match_id").distinct().withColumn("__d", F.lit(True))
    p = players.groupBy("match_id").agg(F.count("*").alias("n")).where("n = 10").select("match_id", F.lit(True).alias("__p"))
    out = matches.join(d, "match_id", "left").join(p, "match_id", "left").agg(
        F.count("*").alias("total"), F.count("detail_fetched_at").alias("detail"), F.count("patch").alias("patch"), F.count("__d").alias("draft"), F.count("__p").alias("players"),
    )
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("detail") / F.col("total"), 1)))


def skip_reasons(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").cast("long").alias("n"))
