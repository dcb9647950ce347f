"""Walk-forward evaluation: predict, score what is in scope, then learn; grids run in parallel by configuration."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drafts import DRAFT, DraftConfig, combine, with_features
from .ratings import RatingConfig, forecasts
from .rollups import numbered, scorecard, scorecard_by_day

#: The grids that are tuned over.
GRID = {"patch_rd_boost": [None, 30.0, 60.0, 100.0], "roster_rd_boost": [None, 30.0, 60.0, 100.0]}
DRAFT_GRID = {"half_life_days": [60.0, 120.0, 240.0], "k_pair": [50.0, 100.0, 200.0], "learning_rate": [0.01, 0.05, 0.1]}


def rating_grid(grid: dict = GRID) -> dict[int, RatingConfig]:
    """All combinations (16 by default), numbered in order."""
    return {k: RatingConfig(**dict(zip(grid, v, strict=True))) for k, v in enumerate(product(*grid.values()))}


def draft_grid(grid: dict = DRAFT_GRID) -> dict[int, DraftConfig]:
    """All combinations (27 by default), numbered in order."""
    return {k: DraftConfig(**dict(zip(grid, v, strict=True))) for k, v in enumerate(product(*grid.values()))}


def bounded(maps: DataFrame, end: int | None) -> DataFrame:
    """The maps that start before end, so that nothing of the period that is predicted trains or chooses a configuration."""
    return maps if end is None else maps.where(F.col("start_time") < end)


def in_scope(rows: DataFrame, start_scoring: int | None = None, min_games: int = 0, leagues: DataFrame | None = None) -> DataFrame:
    """What is measured: from a start, between teams of min_games or more, in given leagues. All rows train."""
    out = rows.where((F.col("games_a") >= min_games) & (F.col("games_b") >= min_games))
    out = out if start_scoring is None else out.where(F.col("start_time") >= start_scoring)
    return out if leagues is None else out.join(leagues, "league_id", "left_semi")


def predictions(maps: DataFrame, configs: dict[int, RatingConfig]) -> DataFrame:
    """maps with config_id, prob and the decided games of both before each map, all from one fold."""
    return maps.join(forecasts(maps, configs).drop("start_time", "win"), "match_id")


def walk_forward(maps: DataFrame, configs: dict[int, RatingConfig], end: int | None = None, **scope) -> DataFrame:
    """config_id and its score card, best log-loss first (null last), from maps before end."""
    maps = bounded(maps, end)
    rows = forecasts(maps, configs)  # has all that a card needs, so that no row is shuffled once a configuration
    if scope.get("leagues") is not None:
        rows = rows.join(maps.select("match_id", "league_id"), "match_id")
    rows = in_scope(rows, **scope)
    return scorecard(rows, ["config_id"], outcome="win").orderBy(F.asc_nulls_last("log_loss"), "config_id")


def walk_forward_draft(maps: DataFrame, drafts: DataFrame, configs: dict[int, DraftConfig], rating: RatingConfig = RatingConfig(), end: int | None = None, **scope) -> DataFrame:
    """config_id and its score card with the number of fallbacks, from maps before end."""
    maps = bounded(maps, end)
    rows = draft_predictions(predictions(maps, {0: rating}), drafts, configs)
    if scope.get("leagues") is not None:
        rows = rows.join(maps.select("match_id", "league_id"), "match_id")
    return scorecard(in_scope(rows, **scope), ["config_id"], outcome="win", fallback="fallback").orderBy(F.asc_nulls_last("log_loss"), "config_id")


def draft_predictions(base: DataFrame, drafts: DataFrame, configs: dict[int, DraftConfig]) -> DataFrame:
    """PREDICTED of each map of base (maps with prob and games) and configuration: the combiner's prob and fallback.

    Features and what a score card needs travel with the maps, so that nothing is joined once a configuration.
    Configurations that differ in half-life or k_pair share a pass for features, those that differ in the learning rate
    alone share their feature lists.
    """
    shared: dict[tuple, list[int]] = {}
    for k, c in configs.items():
        shared.setdefault((c.k_hero, c.k_team_hero, c.min_team_games), []).append(k)
    rows, place = base.select("match_id", "start_time", "a", "b", "win", "games_a", "games_b", "prob").join(drafts.select("match_id", *DRAFT), "match_id", "left"), {}
    for n, ids in enumerate(shared.values()):
        halves, ks = (list(dict.fromkeys(getattr(configs[k], f) for k in ids)) for f in ("half_life_days", "k_pair"))
        rows = with_features(rows, configs[ids[0]], halves, ks, f"grid_{n}")
        place.update({k: (f"grid_{n}", halves.index(configs[k].half_life_days) * len(ks) + ks.index(configs[k].k_pair)) for k in ids})
    return combine(rows, configs, place)


def event_predictions_draft(maps: DataFrame, drafts: DataFrame, target: DataFrame, config: DraftConfig = DraftConfig(), rating: RatingConfig = RatingConfig()) -> DataFrame:
    """Both sides of each decided map of target, as known before it: series_id, period, selection, prob, match_id, fallback.

    target: match_id, series_id, start_time, name_a, name_b of all maps of an event, also of undecided ones, as periods
    count them. All of maps train the ratings and draft statistics, in order.
    """
    base = predictions(maps, {0: rating}).drop("config_id")
    known = draft_predictions(base, drafts, {0: config}).select("match_id", "prob", "fallback")
    played = numbered(target, ["series_id"], ["start_time", "match_id"]).join(known, "match_id")
    sides = F.explode(F.array(F.struct(F.col("name_a").alias("selection"), F.col("prob").alias("prob")), F.struct(F.col("name_b").alias("selection"), (1 - F.col("prob")).alias("prob")))).alias("x")
    return played.select("series_id", "period", sides, "match_id", "fallback").select("series_id", "period", "x.*", "match_id", "fallback")


def prediction_counts(rows: DataFrame) -> DataFrame:
    """n_maps and n_fallback (maps without a usable draft) of event_predictions_draft, in one row."""
    return rows.select("match_id", "fallback").distinct().agg(F.count("*").alias("n_maps"), F.count_if("fallback").alias("n_fallback"))


def match_report(frozen: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score cards over all decided maps of an event, whole and by day, from predictions frozen at the series' start.

    frozen: series_id, a, b, p_map; matches: series_id, start_time, a, b, win. a may play on either side; maps without
    it are not scored.
    """
    maps = matches.where("win IS NOT NULL AND start_time IS NOT NULL").select("series_id", "start_time", F.col("a").alias("__a"), F.col("b").alias("__b"), "win")
    both = frozen.select("series_id", "a", "p_map").join(maps, "series_id")
    outcome = F.when(F.col("__a") == F.col("a"), F.col("win")).when(F.col("__b") == F.col("a"), 1 - F.col("win"))
    scored = both.select("start_time", F.col("p_map").alias("prob"), outcome.alias("outcome")).where("outcome IS NOT NULL")
    return scorecard(scored), scorecard_by_day(scored, "start_time").orderBy("day")
