"""Closing lines, outcomes, closing-line value and settlement, set-based over all keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market import brier, clv, devig, overround, shin_book
from ..functions.scalars import norm_name, parse_ts
from .rollups import numbered

#: Reasons for which a trade waits; any other leaves it unresolved.
PENDING = ["series undecided", "map undecided or team not in match", "map not played"]


def closing_events(events: DataFrame, is_kills: int = 0) -> DataFrame:
    """(source, series_id, event_id): the parentless event of each series, the first by text order of its id."""
    mine = events.where((F.col("is_kills") == is_kills) & F.col("parent_event_id").isNull() & F.col("series_id").isNotNull())
    return mine.groupBy("source", "series_id").agg(F.min("event_id").alias("event_id"))


def horns(matches: DataFrame) -> DataFrame:
    """(series_id, period, horn): starts of a series (period 0) and of its maps, in order of (start_time, match_id)."""
    played = matches.where("series_id > 0 AND start_time IS NOT NULL").select("series_id", F.col("start_time").alias("horn"), "match_id")
    maps = numbered(played, ["series_id"], ["horn", "match_id"]).select("series_id", "period", "horn")
    return maps.union(played.groupBy("series_id").agg(F.lit(0).alias("period"), F.min("horn").alias("horn")))


def closing_lines(snapshots: DataFrame, bounds: DataFrame, market_type: str = "moneyline", method: str = "shin") -> DataFrame:
    """The de-vigged close of each of bounds (series_id, period, source, event_id, bound).

    Of each (selection, points) the last open, not live row strictly before the bound; rows without a price drop out;
    a market of several points is several books, of which the one quoted last counts (ties: the larger points); a book
    needs two selections. stale_cutoff: a row was captured after the cutoff that it names.
    """
    rows = snapshots.where((F.col("market_type") == market_type) & (F.col("status") == "open") & (F.col("is_live").isNull() | (F.col("is_live") == 0)))
    rows = rows.select("source", "event_id", "period", "selection", "points", "price_decimal", "captured_at", "id", "cutoff_at")
    # an event is of one series, so that a row meets one bound: one shuffle by event serves the join and all that is grouped below
    met = rows.join(bounds.select("series_id", "period", "source", "event_id", "bound"), ["source", "event_id", "period"]).where("captured_at < bound")
    value = F.struct("price_decimal", "captured_at", "cutoff_at")
    last = met.groupBy("source", "event_id", "period", "series_id", "bound", "selection", "points").agg(F.max_by(value, F.struct("captured_at", "id")).alias("v")).select("*", "v.*").drop("v")
    priced = last.where("price_decimal <> 0")
    quote = F.struct("selection", F.col("price_decimal").alias("price"))
    stale = F.coalesce(F.coalesce(parse_ts(F.nullif("cutoff_at", F.lit(""))), F.when(F.nullif("cutoff_at", F.lit("")).isNotNull(), F.lit(0).cast("long"))) < F.col("captured_at"), F.lit(False))
    books = priced.groupBy("series_id", "period", "source", "event_id", "bound", "points").agg(F.array_sort(F.collect_list(quote)).alias("book"), F.max("captured_at").alias("captured_at"), F.max(stale).alias("stale_cutoff"))
    keys = ["series_id", "period", "source", "event_id", "bound"]
    value = ["points", "book", "captured_at", "stale_cutoff"]
    main = books.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct("captured_at", "points")).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in value])
    odds = F.transform("book", lambda q: q.price)
    whole = main.where(F.size("book") >= 2).withColumns({"odds": odds}).withColumns({"__shin": shin_book(F.col("odds")), "overround": overround(F.col("odds"))})
    probs = F.col("__shin.probs") if method == "shin" else devig(F.col("odds"), method)
    return whole.withColumns({"probs": probs, "z": F.col("__shin.z")}).drop("__shin")


def quoted(lines: DataFrame) -> DataFrame:
    """One row for each selection of a close: series_id, period, key (normalised name), close_prob, close_price."""
    both = lines.select("series_id", "period", F.explode(F.arrays_zip("book", "probs")).alias("x"))
    return both.select("series_id", "period", norm_name(F.col("x.book.selection")).alias("key"), F.col("x.probs").alias("close_prob"), F.col("x.book.price").alias("close_price")).dropDuplicates(["series_id", "period", "key"])


def map_outcomes(matches: DataFrame) -> DataFrame:
    """(series_id, period, team, outcome) of the maps of each series."""
    played = numbered(matches.where("series_id > 0 AND start_time IS NOT NULL"), ["series_id"], ["start_time", "match_id"])
    sides = F.array(F.struct(F.col("radiant_team_id").alias("team"), F.col("radiant_win").alias("outcome")), F.struct(F.col("dire_team_id").alias("team"), (1 - F.col("radiant_win")).alias("outcome")))
    return played.select("series_id", "period", F.explode(sides).alias("x")).select("series_id", "period", "x.*").where("team IS NOT NULL")


def outcomes(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """predictions (series_id, period, team, ...) with outcome and reason."""
    played = matches.where("series_id > 0 AND start_time IS NOT NULL")
    sides = map_outcomes(matches)
    wins = sides.groupBy("series_id", "team").agg(F.coalesce(F.sum("outcome"), F.lit(0)).alias("wins"))
    total = played.groupBy("series_id").agg(F.count("*").alias("maps"), F.count("radiant_win").alias("decided"), F.min_by("series_type", F.struct("start_time", "match_id")).alias("series_type"))
    out = predictions.join(total, "series_id", "left").join(wins, ["series_id", "team"], "left").join(
        sides.select("series_id", "period", "team", F.col("outcome").alias("map_outcome")), ["series_id", "period", "team"], "left"
    )
    need = F.when(F.coalesce("series_type", F.lit(0)) == 0, 1).when(F.col("series_type") == 1, 2).when(F.col("series_type") == 2, 3)
    won = F.coalesce("wins", F.lit(0))
    lost = F.when(F.col("wins").isNotNull(), F.col("decided") - won).otherwise(0)
    series = F.when(won >= need, 1).when(lost >= need, 0)
    whole = F.col("period") == 0
    result = F.when(F.col("maps").isNull(), F.lit(None)).when(whole, series).otherwise(F.col("map_outcome")).cast("int")
    reason = (
        F.when(F.col("maps").isNull(), "series not in matches").when(whole & need.isNull(), "series format has no winner").when(whole & series.isNull(), "series undecided")
        .when(~whole & (F.col("period") > F.col("maps")), "map not played").when(~whole & F.col("map_outcome").isNull(), "map undecided or team not in match")
    )
    return out.withColumn("outcome", result).withColumn("reason", reason).drop("maps", "decided", "series_type", "wins", "map_outcome")


def clv_report(predictions: DataFrame, lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Each prediction (series_id, period, selection, team or null, prob, price_taken) with its close, edge, clv, Brier
    scores and reason: the first that applies of unresolved selection, no closing line, selection not quoted, or why
    there is no outcome; null if it is scored. A price of 0 counts as none."""
    has = lines.select("series_id", "period", F.lit(True).alias("__line")).distinct()
    out = outcomes(predictions, matches).withColumn("key", norm_name(F.col("selection")))
    out = out.join(has, ["series_id", "period"], "left").join(quoted(lines), ["series_id", "period", "key"], "left")
    skip = F.when(F.col("team").isNull(), "unresolved selection").when(F.col("__line").isNull(), "no closing line").when(F.col("close_prob").isNull(), "selection not quoted").otherwise(F.col("reason"))
    ok = F.col("skip").isNull()
    return out.withColumn("skip", skip).select(
        *predictions.columns, "close_prob", "close_price", "outcome", F.col("skip").alias("reason"),
        F.when(ok, F.col("prob") - F.col("close_prob")).alias("edge"), F.when(ok & (F.col("price_taken") != 0), clv(F.col("price_taken"), F.col("close_prob"))).alias("clv"),
        F.when(ok, brier(F.col("prob"), F.col("outcome"))).alias("brier"), F.when(ok, brier(F.col("close_prob"), F.col("outcome"))).alias("close_brier"),
    )


def clv_summary(report: DataFrame) -> DataFrame:
    """n_scored, model_brier, closing_brier, mean_edge, mean_clv over the same scored rows, and n_skipped."""
    return report.agg(
        F.count_if(F.col("reason").isNull()).alias("n_scored"), F.avg("brier").alias("model_brier"), F.avg("close_brier").alias("closing_brier"),
        F.avg("edge").alias("mean_edge"), F.avg("clv").alias("mean_clv"), F.count("reason").alias("n_skipped"),
    )


def settle(trades: DataFrame, lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Paper trades (series_id, period, selection, team, prob, price_taken, stake) with status, pnl and clv. Pending
    trades have their clv as soon as there is a close; a missing stake is 0 and a missing price 1 for the win."""
    out = outcomes(trades, matches).withColumn("key", norm_name(F.col("selection"))).join(quoted(lines), ["series_id", "period", "key"], "left")
    known = F.col("team").isNotNull()
    status = F.when(~known, "unresolved").when(F.col("outcome").isNotNull(), "settled").when(F.col("reason").isNull() | F.col("reason").isin(PENDING), "pending").otherwise("unresolved")
    stake = F.coalesce("stake", F.lit(0.0))
    gain = F.when(F.col("outcome") == 1, stake * (F.coalesce(F.when(F.col("price_taken") != 0, F.col("price_taken")), F.lit(1.0)) - 1)).otherwise(-stake)
    return out.withColumn("status", status).select(
        *trades.columns, "status", "outcome", F.when(F.col("status") == "settled", gain).alias("pnl"), F.when(known, clv(F.col("price_taken"), F.col("close_prob"))).alias("clv"),
        F.when(known, F.col("prob") - F.col("close_prob")).alias("edge"), F.when(~known, "unresolved selection").when(F.col("status") != "settled", F.col("reason")).alias("reason"),
    )


def settlement_summary(settled: DataFrame) -> DataFrame:
    done = F.col("status") == "settled"
    return settled.agg(
        F.count_if(done).alias("n_settled"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("status") == "unresolved").alias("n_unresolved"),
        F.coalesce(F.sum(F.when(done, F.coalesce("stake", F.lit(0.0)))), F.lit(0.0)).alias("staked"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"), F.avg("clv").alias("mean_clv"), F.avg("edge").alias("mean_edge"),
    )


def quote_now(snapshots: DataFrame, event_ids: DataFrame, keys: list[str], now: int, fresh_s: int = 300) -> DataFrame:
    """The live quote of each event: newest row of each line whatever its status, of these the open, not live ones,
    newest for each selection; two sides at least; age is that of the oldest leg."""
    from .history import latest

    rows = snapshots.join(event_ids, "event_id", "left_semi")
    lines = latest(rows, keys, ["captured_at", "id"]).where((F.col("status") == "open") & (F.col("is_live").isNull() | (F.col("is_live") == 0)))
    legs = latest(lines, ["event_id", "period", "selection"], ["captured_at", "id"])
    book = legs.groupBy("event_id", "period").agg(F.array_sort(F.collect_list(F.struct("selection", F.col("price_decimal").alias("price")))).alias("book"), F.min("captured_at").alias("oldest"))
    return book.where(F.size("book") >= 2).withColumns({"age_s": F.lit(now) - F.col("oldest"), "stale": F.lit(now) - F.col("oldest") > fresh_s})
