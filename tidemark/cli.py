"""Commands for spark-submit: python -m tidemark.cli COMMAND ... over a folder of stored tables (--root)."""

from __future__ import annotations

import argparse
import json
import signal
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import closing, drafts, history, links, ratings, rollups, spans, walkforward
from .schemas import KEYS, TABLES, TRACKED
from .sources import flatten, http, parts, polls, readers, writers
from .sources.shared import materialize
from .streaming import recorder, supervisor

LINE = ["source", "line_key"]


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def store(df: DataFrame, root: str, name: str) -> None:
    """Replace a table: the new files are complete before the old ones step aside, and these go last. A run that
    ends between the two leaves the old table aside, where readers.table finds it."""
    spark, path = df.sparkSession, f"{root}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, new, old = (hadoop.Path(path + end) for end in ("", ".new", ".old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(old) and fs.exists(at):
        fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def merge(spark: SparkSession, root: str, rows: dict[str, DataFrame]) -> None:
    """Upsert flattened tables: matches keep what is known, rosters keep the first sight, others are replaced by key. Only
    the parts of a table that the new keys lie in are rewritten; a plain table is dealt into parts first."""
    for name, new in rows.items():
        how = {"matches": writers.upsert_coalesce, "rosters": writers.insert_ignore}.get(name, writers.upsert_replace)
        path = f"{root}/{name}"
        table = parts.Parts(spark, path, TABLES[name], KEYS[name], parts.WIDTHS[name])
        if not table.version():
            parts.adopt(table, materialize(readers.table(spark, root, name), "adopted"))
        table.merge(new, how)


def maps_of(spark: SparkSession, root: str, lineups: bool = True, before: int | None = None) -> DataFrame:
    """Decided maps in the shape that the models take."""
    m = rollups.decided(readers.table(spark, root, "matches"), before=before)
    out = m.select("match_id", "start_time", "league_id", F.col("radiant_team_id").alias("a"), F.col("dire_team_id").alias("b"), F.col("radiant_win").alias("win"), "patch", "series_id", "series_type")
    if lineups:
        five = rollups.lineups(readers.table(spark, root, "match_players"), ["match_id", "is_radiant"], "account_id")
        for side, flag in (("a", 1), ("b", 0)):
            out = out.join(five.where(F.col("is_radiant") == flag).select("match_id", F.col("lineup").alias(f"lineup_{side}")), "match_id", "left")
    return out


def rating_config(a) -> ratings.RatingConfig:
    idle = None if a.idle_days is not None and a.idle_days <= 0 else (30 if a.idle_days is None else a.idle_days) * 86400.0
    return ratings.RatingConfig(tau=a.tau, idle_period_s=idle, patch_rd_boost=a.patch_boost, roster_rd_boost=a.roster_boost)


def draft_config(a) -> drafts.DraftConfig:
    return drafts.DraftConfig(half_life_days=a.half_life, k_pair=a.k_pair, learning_rate=a.learning_rate, disabled=a.no_draft)


def _keys(a) -> dict:
    return {"delay": a.delay, "given": json.dumps({"api_key": a.api_key} if a.api_key else {})}


def backfill(spark, a):
    """Match summaries from landed files, or from a list that is read backward: the newest, those before an id, or those
    before the oldest stored."""
    if a.path:
        raw = readers.json_documents(spark, a.path, flatten.SUMMARY)
    else:
        http.register(spark)
        oldest = readers.table(spark, a.root, "matches").agg(F.min("match_id")).first()[0] if a.resume and a.before_match_id is None else None
        before = a.before_match_id or oldest
        bound = {} if before is None else {"before": before}
        pages = spark.read.format("keyset_json").options(url=a.url, pages_at="/proMatches", most=a.max_matches, **bound, **_keys(a)).load()
        raw = pages.select(F.from_json("body", flatten.SUMMARY).alias("r")).select("r.*")
    raw = materialize(raw if a.league_id is None else raw.where(F.col("leagueid") == a.league_id), "summaries")
    merge(spark, a.root, {"matches": flatten.match_summaries(raw)})
    print(f"stored: {raw.count()}")


def detail(spark, a):
    wanted = rollups.needing_detail(readers.table(spark, a.root, "matches"), a.limit).select("match_id")
    if a.path:
        raw = readers.json_documents(spark, a.path, flatten.DETAIL).join(wanted, "match_id", "left_semi")
    else:
        got = http.fetch_each(wanted, "/matches/{id}", a.lanes, url=a.url, **_keys(a))
        raw = materialize(got, "details").select(F.from_json("body", flatten.DETAIL).alias("r")).select("r.*")
    merge(spark, a.root, flatten.match_details(raw, F.lit(int(time.time()))))


def bulkfill(spark, a):
    """Slices of a remote database over the span of the maps without detail; a slice that fails is halved down to a day,
    then skipped and counted."""
    http.register(spark)
    stored, failed = readers.table(spark, a.root, "matches"), 0
    first, last = rollups.unfetched_span(stored)
    since, until = a.since if a.since is not None else first, a.until or (int(time.time()) if last is None else last + 1)
    if since is None:
        print("no maps without detail")
        return
    known = stored.select("match_id")
    constants = readers.json_documents(spark, a.patches, "id int, name string, date string")
    ids, timeline = flatten.patch_ids(constants), flatten.patch_timeline(constants)

    def read(lo, hi):
        # written here, so that a query that fails does so inside the slice, which is then halved
        got = {n: materialize(readers.remote_slice(spark, a.url, n, lo, hi, a.with_timeseries), f"slice-{n}") for n in readers.SLICE_QUERIES}
        return flatten.bulk_rows(*(flatten.known_only(got[n], known)[0] for n in ("matches", "picks_bans", "player_matches")), F.lit(until), ids, timeline)

    for _, _, rows in readers.slices(since, until, a.slice_days * 86400, read):
        failed += rows is None
        if rows is not None:
            merge(spark, a.root, {n: df for n, df in rows.items() if n != "match_timeseries" or a.with_timeseries})
    print(f"failed slices: {failed}")


def recorder_of(spark, root: str) -> recorder.Recorder:
    """The recorder of the stored tables: history appended, last rows kept beside it, a journal between the two."""
    write = lambda df: df.write.mode("append").parquet(f"{root}/odds_snapshots")
    if not readers.table(spark, root, "odds_latest").take(1):
        store(history.latest(readers.table(spark, root, "odds_snapshots"), LINE, ["captured_at", "id"]), root, "odds_latest")
    return recorder.Recorder(
        lambda: readers.table(spark, root, "odds_latest"), write, LINE, TRACKED, ["price_american", "price_decimal", "limit_amount"], ["captured_at", "id"],
        lambda df: store(df, root, "odds_latest"), f"{root}/_journal", lambda: readers.table(spark, root, "odds_snapshots"),
    )


def record_odds(spark, a):
    """Landed quotes as a stream, or configured sources, polled until a signal comes."""
    sink = recorder_of(spark, a.root)
    if a.path:
        stream = spark.readStream.schema(TABLES["odds_snapshots"]).parquet(a.path)
        return recorder.run(stream, sink, f"{a.root}/_recorder", None if a.once else a.interval).awaitTermination()
    settings = json.loads(spark.read.text(a.settings, wholetext=True).first()[0]) if a.settings else {}
    try:
        sources = polls.registry(spark, settings).build(a.sources)
    except ValueError as e:
        sys.exit(str(e))
    if not sources:
        sys.exit("no source is configured")
    watch = supervisor.Supervisor(spark, sources, sink, None if a.no_archive else a.archive_root or f"{a.root}/archive", a.interval, a.live_interval, a.archive_heartbeat)
    if a.once:
        for name, report in watch.once().items():
            print(name, report or "failed")
        return
    for which in (signal.SIGINT, signal.SIGTERM):
        signal.signal(which, watch.stop)
    watch.run(f"{a.root}/_recorder")


def resolve(spark, a):
    snaps = readers.table(spark, a.root, "odds_snapshots").where(F.col("source") == a.source)
    m = readers.table(spark, a.root, "matches").where("start_time IS NOT NULL AND series_id > 0")
    series = m.groupBy("series_id", F.col("radiant_team_id").alias("team_a"), F.col("dire_team_id").alias("team_b")).agg(F.min("start_time").alias("start"))
    series = series.select("series_id", F.least("team_a", "team_b").alias("team_a"), F.greatest("team_a", "team_b").alias("team_b"), "start").groupBy("series_id", "team_a", "team_b").agg(F.min("start").alias("start"))
    parents = readers.parent_links(spark, a.archive, a.source) if a.archive else spark.createDataFrame([], "event_id string, parent_event_id string")
    out = links.resolve_events(snaps, readers.alias_file(spark, a.aliases), series, parents, a.tolerance)
    out = materialize(out, "resolved")
    named = F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()
    out.agg(F.count("*").alias("events"), F.count_if(named).alias("mapped_teams"), F.count("series_id").alias("mapped_series"), F.count_if("ambiguous").alias("ambiguous")).show()
    for what, rows in links.resolve_report(snaps, out).items():
        print(what)
        rows.show(1000, truncate=False)
    if not a.dry_run:
        rows = out.select(*[F.col(c) if c in out.columns else F.lit(int(time.time())).alias(c) for c in TABLES["event_series_map"].names])
        store(writers.merge_map(readers.table(spark, a.root, "event_series_map"), rows), a.root, "event_series_map")


def _lines(spark, a, before_s: int | None = None) -> tuple[DataFrame, DataFrame]:
    m = readers.table(spark, a.root, "matches")
    events = closing.closing_events(readers.table(spark, a.root, "event_series_map").where(F.col("source") == a.source))
    bounds = closing.horns(m).join(events, "series_id").select("series_id", "period", "source", "event_id", (F.col("horn") - (before_s or 0)).alias("bound"))
    return m, closing.closing_lines(readers.table(spark, a.root, "odds_snapshots"), bounds, a.market, a.method)


def _named(spark, a, preds: DataFrame) -> DataFrame:
    return links.resolve_names(preds, "selection", readers.alias_file(spark, a.aliases), "team").drop("is_kills", "name")


def evaluate(spark, a):
    m, lines = _lines(spark, a, a.before_draft)
    report = closing.clv_report(_named(spark, a, readers.predictions(spark, a.predictions)), lines, m)
    closing.clv_summary(report).show()
    rollups.skip_reasons(report).orderBy(F.desc("n")).show(truncate=False)


def holdout_start(spark, a) -> int | None:
    """The first start of the target event's maps."""
    return readers.table(spark, a.root, "matches").where(F.col("league_name") == a.league).agg(F.min("start_time").alias("t")).first().t if a.league else None


def backtest(spark, a):
    """Walk forward over the history; of a league given, nothing at or after its first start trains or counts."""
    end = holdout_start(spark, a)
    print("holdout: none" if end is None else f"holdout: nothing at or after {end}")
    maps, scope = maps_of(spark, a.root, before=end), {"start_scoring": a.burn_in, "min_games": a.min_games}
    if a.score == "elite":
        scope["leagues"] = rollups.leagues_named(readers.table(spark, a.root, "matches"))
    if a.model == "draft":
        configs = walkforward.draft_grid() if a.tune else {0: draft_config(a)}
        out = walkforward.walk_forward_draft(maps, drafts.complete_drafts(readers.table(spark, a.root, "draft_events")), configs, rating_config(a), **scope)
    else:
        configs = walkforward.rating_grid() if a.tune else {0: rating_config(a)}
        out = walkforward.walk_forward(maps, configs, **scope)
    for r in out.collect():
        print(r.n, r.brier, r.log_loss, r.n_fallback, configs[r.config_id])


def _history(spark, root: str, config: ratings.RatingConfig, series: DataFrame) -> DataFrame:
    """States for predictions frozen at the starts of series: from the last valid snapshot before the first of them, which
    is saved there for the next time, to the last."""
    maps = materialize(maps_of(spark, root), "maps")
    first, last = series.agg(F.min("when"), F.max("when")).first()
    saved = ratings.Snapshots(spark, f"{root}/_snapshots", config)
    if first is None:
        return ratings.replay(maps.limit(0), {0: config})
    found = saved.newest(maps, first)
    after = maps.where(F.col("start_time") < last) if found is None else maps.where((F.col("start_time") >= found[1]) & (F.col("start_time") < last))
    past = materialize(saved.joined(None if found is None else found[0], ratings.replay(after, {0: config}, None if found is None else found[0])), "states")
    if found is None or found[1] < first:
        saved.save(maps, past, first)
    return past


def predict(spark, a):
    m = readers.table(spark, a.root, "matches")
    config = rating_config(a)
    quoted = links.quoted_names(*(readers.table(spark, a.root, n).where(F.col("source") == a.source) for n in ("odds_snapshots", "event_series_map")))
    series = rollups.event_series(m, a.league, quoted)
    if a.model == "draft":
        league = rollups.league_id_for(m, a.league)
        named = m.join(league, "league_id", "left_semi").where("series_id IS NOT NULL AND start_time IS NOT NULL AND radiant_team_id IS NOT NULL AND dire_team_id IS NOT NULL")
        for side, n in (("radiant", "name_a"), ("dire", "name_b")):
            book = quoted.select("series_id", F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(n)).dropDuplicates(["series_id", f"{side}_team_id"])
            named = named.join(book, ["series_id", f"{side}_team_id"], "left").withColumn(n, F.coalesce(n, F.nullif(f"{side}_name", F.lit("")), F.col(f"{side}_team_id").cast("string")))
        named = named.select("match_id", "series_id", "start_time", "name_a", "name_b")
        rows = walkforward.event_predictions_draft(maps_of(spark, a.root), drafts.complete_drafts(readers.table(spark, a.root, "draft_events")), named, draft_config(a), config)
        n = walkforward.prediction_counts(rows).first()
        print(f"maps: {n.n_maps}; without a usable draft: {n.n_fallback}")
        out = rows.drop("match_id", "fallback")
    else:
        frozen = ratings.frozen(_history(spark, a.root, config, series), series, config)
        played = m.select("series_id", "start_time", F.col("radiant_team_id").alias("a"), F.col("dire_team_id").alias("b"), F.col("radiant_win").alias("win"))
        whole, by_day = walkforward.match_report(frozen, played)
        whole.show()
        by_day.show(1000, truncate=False)
        out = ratings.event_predictions(frozen)
    if a.out:
        writers.write_predictions(out, a.out)
    out.orderBy("series_id", "period", "selection").show(100, truncate=False)


def _team(spark, a, text: str | None) -> int | None:
    """The team of a name or alias; ids are taken as they are."""
    if text is None or text.isdigit():
        return None if text is None else int(text)
    known = readers.alias_file(spark, a.aliases)
    found = links.resolve_names(spark.createDataFrame([(text,)], "given string"), "given", known, "team").first().team
    if found is None:
        near = scalars.suggestions(text, {r.key: r.name for r in known.select("key", "name").collect()})
        sys.exit(f"unknown team {text!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return found


def _fixture(spark, a) -> tuple[int, int, int]:
    """(series, team a, team b): the series of two teams, by the newest event of the source, else by their last map; of a
    given series, teams that aren't named are those of its first map."""
    one, two, series = _team(spark, a, a.team_a), _team(spark, a, a.team_b), a.series
    m = readers.table(spark, a.root, "matches")
    pair = lambda x, y: (F.least(x, y) == min(one, two)) & (F.greatest(x, y) == max(one, two))
    if series is None:
        if one is None or two is None:
            sys.exit("give --series, or both --team-a and --team-b")
        events = readers.table(spark, a.root, "event_series_map").where((F.col("source") == a.source) & pair("home_team_id", "away_team_id"))
        series = events.where("series_id IS NOT NULL").agg(F.max_by("series_id", "event_id").alias("s")).first().s
        if series is None:
            series = m.where(pair("radiant_team_id", "dire_team_id") & F.col("series_id").isNotNull()).agg(F.max_by("series_id", F.struct("start_time", "match_id")).alias("s")).first().s
        if series is None:
            sys.exit(f"no series of {one} and {two}")
    elif one is None or two is None:
        first = m.where(F.col("series_id") == series).agg(F.min_by(F.struct("radiant_team_id", "dire_team_id"), F.struct("start_time", "match_id")).alias("t")).first().t
        known = [] if first is None else [t for t in first if t]
        one = one or next((t for t in known if t != two), None)
        two = two or next((t for t in known if t != one), None)
    if one is None or two is None or one == two:
        sys.exit(f"no two teams for series {series}")
    return series, one, two


def _heroes(spark, a) -> tuple[list[int], list[int]]:
    """The ids of five and five heroes given by id, name or short name; both empty without a draft."""
    given = (a.heroes_a or []) + (a.heroes_b or [])
    if not given:
        return [], []
    if len(a.heroes_a or []) != 5 or len(a.heroes_b or []) != 5:
        sys.exit("a draft is five and five heroes")
    if a.heroes:
        known = readers.heroes(spark, a.heroes)
        lookup = readers.hero_lookup(known, readers.hero_aliases(known))
        asked = spark.createDataFrame(list(enumerate(given)), "at int, asked string")
        ids = [r.hero_id for r in readers.resolve_heroes(asked, "asked", known, lookup).orderBy("at").collect()]
    else:
        ids = [int(x) if x.isdigit() else None for x in given]
    if None in ids:
        sys.exit(f"unknown hero {given[ids.index(None)]!r}")
    if len(set(ids)) != 10:
        sys.exit(f"a draft names ten heroes; twice: {', '.join(sorted({g for g, i in zip(given, ids, strict=True) if ids.count(i) > 1}))}")
    return ids[:5], ids[5:]


def bet(spark, a):
    """Settle recorded trades, or price a map now: ratings and draft models up to now against the newest fresh quote."""
    if a.settle:
        m, lines = _lines(spark, a)
        settled = closing.settle(_named(spark, a, readers.predictions(spark, a.log)), lines, m)
        settled.show(100, truncate=False)
        closing.settlement_summary(settled).show()
        return
    now = a.now or int(time.time())
    maps = maps_of(spark, a.root, before=now)
    own = drafts.complete_drafts(readers.table(spark, a.root, "draft_events"))
    a.series, a.team_a, a.team_b = _fixture(spark, a)
    a.heroes_a, a.heroes_b = _heroes(spark, a)
    first = {"a": True, "b": False}.get(a.first_action)
    columns = {"match_id": F.lit(1 << 62), "start_time": F.lit(now).cast("long"), "a": F.lit(a.team_a).cast("long"), "b": F.lit(a.team_b).cast("long"), "win": F.lit(0)}
    extra = spark.range(1).select(*[columns.get(c, F.lit(None)).cast(maps.schema[c].dataType).alias(c) for c in maps.columns])
    drafted = spark.createDataFrame([(1 << 62, a.heroes_a, a.heroes_b, first)], own.schema) if a.heroes_a else own.limit(0)
    base = walkforward.predictions(maps.union(extra), {0: rating_config(a)}).drop("config_id")
    p = walkforward.draft_predictions(base, own.union(drafted), {0: draft_config(a)}).where(F.col("match_id") == (1 << 62)).first().prob
    events = readers.table(spark, a.root, "event_series_map").where(F.col("parent_event_id").isNull() & (F.col("series_id") == a.series)).select("event_id")
    quote = closing.quote_now(readers.table(spark, a.root, "odds_snapshots"), events, LINE, now, a.fresh).where(F.col("period") == a.period).first()
    if quote is None:
        sys.exit("no quote with two sides")
    print(f"model {p:.4f}; quote {quote.book}; oldest leg {quote.age_s} s" + " (stale: not recorded)" * quote.stale)
    names = links.resolve_names(spark.createDataFrame([(q.selection, q.price) for q in quote.book], "selection string, price double"), "selection", readers.alias_file(spark, a.aliases), "team")
    from .functions import devig, kelly_stake

    fair = spark.range(1).select(devig(F.array(*[F.lit(q.price) for q in quote.book]), a.method).alias("p")).first().p
    close = dict(zip([q.selection for q in quote.book], fair, strict=True))
    sides = [(r.selection, r.price, prob, prob - close[r.selection]) for r in names.collect() for team, prob in ((a.team_a, p), (a.team_b, 1 - p)) if r.team == team]
    best = max(sides, key=lambda s: s[3], default=None)
    if best is None or best[3] <= 0:
        print("no edge")
        return
    stake = spark.range(1).select(kelly_stake(F.lit(best[2]), F.lit(best[1]), a.bankroll, a.max_stake).alias("s")).first().s
    print(f"{best[0]} at {best[1]}: edge {best[3]:.4f}, stake {stake}")
    if stake > 0 and not a.rehearse and not quote.stale:
        row = [(a.series, a.period, best[0], best[2], "moneyline", best[1], stake, now)]
        writers.write_predictions(spark.createDataFrame(row, "series_id long, period int, selection string, prob double, market_type string, price_taken double, stake double, placed_at long"), a.log, append=True)


def status(spark, a):
    rollups.status_report({n: readers.table(spark, a.root, n) for n in ("matches", "odds_snapshots")}).show(vertical=True)
    rollups.odds_coverage(readers.table(spark, a.root, "odds_snapshots")).show(truncate=False)
    rollups.coverage_report(*(readers.table(spark, a.root, n) for n in ("matches", "draft_events", "match_players"))).show()


def windows(spark, a):
    """How long each map's line stayed open between the maps of a series."""
    m = readers.table(spark, a.root, "matches").where("series_id > 0 AND start_time IS NOT NULL AND duration IS NOT NULL")
    played = rollups.numbered(m, ["series_id"], ["start_time", "match_id"]).select("series_id", "period", "start_time", (F.col("start_time") + F.col("duration")).alias("ended"))
    before = played.select("series_id", (F.col("period") + 1).alias("period"), F.col("ended").alias("lo"))
    quotes = writers.odds_view(readers.table(spark, a.root, "odds_snapshots"), readers.table(spark, a.root, "event_series_map")).where(F.col("market_type") == "moneyline")
    rows = quotes.select("series_id", "period", F.col("captured_at").alias("at"), F.col("id").alias("seq"), "status", F.col("price_decimal").alias("price"), F.col("limit_amount").alias("lim"), F.col("cutoff_at").alias("cutoff"))
    seen = rows.groupBy("series_id", "period").agg(F.min("at").alias("seen"), F.max("at").alias("until"))
    periods = played.join(before, ["series_id", "period"], "left").join(seen, ["series_id", "period"]).select("series_id", "period", F.coalesce("lo", "seen").alias("lo"), F.col("start_time").alias("hi"), "until")
    report = spans.period_report(rows, periods, ["series_id", "period"], a.draft_window)
    report = materialize(report, "windows")
    if a.out:
        report.write.mode("overwrite").parquet(a.out)
    top = rollups.top_k(report, a.top, "series_id", "period")
    print(writers.tsv(top) if a.format == "tsv" else writers.markdown(top))
    print(writers.markdown(spans.summarise(report, ["period"])))


def compact(spark, a):
    print("compacted days:", ", ".join(writers.compact(spark, a.archive, a.source, a.before)) or "none")


def open_now(spark, a):
    history.open_lines(readers.table(spark, a.root, "odds_snapshots"), LINE, ["captured_at", "id"], source_prefix=a.source).show(100, truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--root", required=True, help="folder of the stored tables")
    sub = p.add_subparsers(required=True)

    def command(name, run, *options, model=False):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, kw in options:
            c.add_argument(*flags, **kw)
        if model:
            for flag, kind, default in (("--tau", float, 0.5), ("--idle-days", float, None), ("--patch-boost", float, None), ("--roster-boost", float, None), ("--half-life", float, 120.0), ("--k-pair", float, 100.0), ("--learning-rate", float, 0.05)):
                c.add_argument(flag, type=kind, default=default)
            c.add_argument("--no-draft", action="store_true")

    def o(*flags, **kw):
        return flags, kw

    source, method = o("--source", default="book"), [o("--market", default="moneyline"), o("--method", default="shin", choices=["shin", "proportional"])]
    names = o("--aliases", required=True)
    remote = [o("--path", help="landed files, in place of a url"), o("--url"), o("--delay", type=float, default=1.2, help="seconds between requests"), o("--api-key")]
    command("backfill", backfill, *remote, o("--max-matches", type=int, default=500), o("--before-match-id", type=int), o("--resume", action="store_true"), o("--league-id", type=int))
    command("detail", detail, *remote, o("--limit", type=int, default=100), o("--lanes", type=int, default=4))
    command("bulkfill", bulkfill, o("--url", required=True, help="of JDBC, or an HTTP endpoint that takes sql"), o("--since", type=int), o("--until", type=int), o("--slice-days", type=int, default=14), o("--with-timeseries", action="store_true"), o("--patches", required=True, help="landed patch constants: id, name, date"))
    command(
        "record-odds", record_odds, o("--path", help="landed quotes, in place of sources"), o("--sources", nargs="+", default=["two_endpoint"]), o("--settings", help="JSON: the options of each source"), o("--interval", type=int, default=60), o("--live-interval", type=int, default=20),
        o("--archive-root"), o("--archive-heartbeat", type=int, default=3600), o("--no-archive", action="store_true"), o("--once", action="store_true"),
    )
    command("resolve", resolve, source, names, o("--archive"), o("--tolerance", type=int, default=8 * 3600), o("--dry-run", action="store_true"))
    command("eval", evaluate, source, names, *method, o("--predictions", required=True), o("--before-draft", type=int))
    command("backtest", backtest, o("--model", default="ratings", choices=["ratings", "draft"]), o("--tune", action="store_true"), o("--score", default="all", choices=["all", "elite"]), o("--min-games", type=int, default=20), o("--burn-in", type=int, default=1727740800), o("--league"), model=True)
    command("predict", predict, source, o("--league", required=True), o("--out"), o("--model", default="ratings", choices=["ratings", "draft"]), model=True)
    command(
        "bet", bet, source, names, *method, o("--settle", action="store_true"), o("--log", required=True), o("--series", type=int), o("--period", type=int, default=1), o("--team-a", help="id, name or alias"), o("--team-b"),
        o("--heroes", help="landed hero list, to give heroes by name"), o("--heroes-a", nargs="*"), o("--heroes-b", nargs="*"), o("--first-action", default="unknown", choices=["a", "b", "unknown"]), o("--bankroll", type=float, default=1000.0), o("--max-stake", type=float, default=50.0), o("--fresh", type=int, default=300), o("--now", type=int), o("--rehearse", action="store_true"), model=True,
    )
    command("status", status)
    command("windows", windows, o("--draft-window", type=int, default=600), o("--format", default="md", choices=["md", "tsv"]), o("--out", help="folder for the whole table"), o("--top", type=int, default=1000, help="rows to print"))
    command("compact", compact, source, o("--archive", required=True), o("--before", required=True, help="day, yyyy-MM-dd"))
    command("open", open_now, o("--source", default="", help="prefix of the sources"))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(), a)


if __name__ == "__main__":
    main()
