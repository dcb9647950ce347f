"""Queries that run the flattening, resolution and draft operators on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closing, drafts, history, links, rollups
from ..sources import flatten
from .views import MAPS, PICKS, maps, picks, read

OWN: dict = {}
OWN_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        OWN[f.__name__] = f
        if sql:
            OWN_SQL[f.__name__] = sql
        return f

    return add


# --- nested documents ---


def _documents(spark, sf_dir):
    """Nested match documents (flatten.DETAIL): a map with its picks as draft events and as players.

    Players are the picks with a slot of 0 to 4 on side 0 and 128 to 132 on side 1; names fall back as they do there.
    """
    def shape(kind, **values):
        """A struct of a declared kind with the given fields, nulls elsewhere."""
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])

    kinds = spark.createDataFrame([], flatten.DETAIL).schema
    pick_kind, player_kind = kinds["picks_bans"].dataType.elementType, kinds["players"].dataType.elementType
    p, hero, ord_ = picks(spark, sf_dir), F.col("hero"), F.col("ord")
    action = shape(pick_kind, order=F.when(ord_ % 3 > 0, ord_ - 1), is_pick=F.col("is_pick") == 1, hero_id=F.when(hero > 0, hero), team=F.col("side"))
    name = F.when(hero % 3 == 0, F.concat(F.lit("pro "), hero)).when(hero % 3 == 1, F.lit(""))
    player = shape(player_kind, player_slot=ord_ - 1 + 128 * F.col("side"), account_id=F.when(F.col("account") % 9 > 0, F.col("account")), hero_id=hero, kills=ord_, personaname=F.concat(F.lit("nick "), hero), name=name, isRadiant=F.when(hero % 2 == 0, F.col("side") == 0))
    rows = p.groupBy("match_id").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("ord", x.alias("x")))), lambda r: r.x).alias(n) for x, n in ((action, "picks_bans"), (player, "players"))])
    m = maps(spark, sf_dir).join(rows, "match_id", "left")
    team = lambda n, c: F.when(F.col("match_id") % 5 > 0, shape(kinds[n].dataType, team_id=F.col(c), name=F.concat(F.lit("Team "), F.col(c)))).alias(n)
    gold = F.transform(F.sequence(F.lit(0), (F.col("match_id") % 4).cast("int")), lambda i: (F.col("match_id") % 1000 + i).cast("int"))
    have = {
        "match_id": F.col("match_id"), "start_time": F.col("start_time"), "duration": F.col("duration"), "radiant_team_id": F.when(F.col("match_id") % 3 > 0, F.col("a")), "dire_team_id": F.col("b"), "series_id": F.col("series_id"),
        "series_type": F.col("series_type"), "radiant_win": F.col("win") == 1, "picks_bans": F.col("picks_bans"), "players": F.col("players"), "radiant_team": team("radiant_team", "a"), "dire_team": team("dire_team", "b"),
        "radiant_gold_adv": gold, "radiant_xp_adv": F.slice(gold, 1, 2), "league": shape(kinds["league"].dataType, leagueid=F.lit(7), name=F.col("league")),
    }
    return m.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields])


def _details(spark, sf_dir):
    return flatten.match_details(_documents(spark, sf_dir), F.lit(99).cast("long"))


NESTED = f"""WITH {MAPS}, {PICKS}, hd AS (SELECT match_id, start_time, CASE WHEN match_id % 3 > 0 OR match_id % 5 > 0 THEN a END AS ra, b AS di, CASE WHEN match_id % 5 > 0 THEN 'Team ' || a END AS rn, CASE WHEN match_id % 5 > 0 THEN 'Team ' || b END AS dn, league, win FROM maps),
pl AS (SELECT p.match_id, CAST(ord - 1 + 128 * side AS INTEGER) AS slot, CASE WHEN account % 9 > 0 THEN account END AS account_id, CASE WHEN hero % 3 = 0 THEN 'pro ' || hero ELSE 'nick ' || hero END AS player_name, hero,
  CAST(CASE WHEN hero % 2 = 0 THEN side = 0 ELSE ord - 1 + 128 * side < 128 END AS INTEGER) AS is_radiant, CAST(ord AS INTEGER) AS kills FROM picks p JOIN maps USING (match_id))"""


@query(NESTED + " SELECT match_id, ra AS radiant_team_id, rn AS radiant_name, di AS dire_team_id, dn AS dire_name, CAST(7 AS BIGINT) AS league_id, league AS league_name, win AS radiant_win, CAST(99 AS BIGINT) AS detail_fetched_at FROM hd")
def detail_matches(spark, sf_dir):
    return _details(spark, sf_dir)["matches"].select("match_id", "radiant_team_id", "radiant_name", "dire_team_id", "dire_name", "league_id", "league_name", "radiant_win", "detail_fetched_at")


@query(NESTED + """ SELECT match_id, CAST(CASE WHEN ord % 3 > 0 THEN ord - 1 ELSE row_number() OVER (PARTITION BY match_id ORDER BY ord) - 1 END AS INTEGER) AS ord, is_pick, hero AS hero_id, side AS team
FROM picks JOIN maps USING (match_id) QUALIFY hero > 0""")
def detail_drafts(spark, sf_dir):
    return _details(spark, sf_dir)["draft_events"]


@query(NESTED + " SELECT match_id, slot AS player_slot, account_id, player_name, hero AS hero_id, is_radiant, kills FROM pl")
def detail_players(spark, sf_dir):
    return _details(spark, sf_dir)["match_players"].select("match_id", "player_slot", "account_id", "player_name", "hero_id", "is_radiant", "kills")


@query(f"WITH {MAPS} SELECT match_id, CAST(i AS INTEGER) AS minute, CAST(match_id % 1000 + i AS INTEGER) AS radiant_gold_adv, CAST(CASE WHEN i < 2 THEN match_id % 1000 + i END AS INTEGER) AS radiant_xp_adv FROM (SELECT match_id, unnest(range(0, match_id % 4 + 1)) AS i FROM maps)")
def detail_minutes(spark, sf_dir):
    return _details(spark, sf_dir)["match_timeseries"]


@query(NESTED + " SELECT ra AS team_id, rn AS name, start_time AS last_seen FROM hd WHERE ra <> 0 UNION ALL SELECT di, dn, start_time FROM hd WHERE di <> 0")
def detail_teams(spark, sf_dir):
    return _details(spark, sf_dir)["teams"]


@query(NESTED + " SELECT CASE WHEN is_radiant = 1 THEN ra ELSE di END AS team_id, account_id, player_name, start_time AS observed_at FROM pl JOIN hd USING (match_id) WHERE account_id IS NOT NULL AND CASE WHEN is_radiant = 1 THEN ra ELSE di END <> 0")
def detail_rosters(spark, sf_dir):
    return _details(spark, sf_dir)["rosters"]


# --- flat slices ---


@query(f"""WITH {MAPS}, {PICKS}, n AS (SELECT match_id, count(*) AS n FROM picks GROUP BY match_id)
SELECT match_id, CAST(CASE WHEN match_id % 4 = 0 THEN 40 WHEN match_id % 4 = 1 THEN 41 WHEN start_time >= 800000000 THEN 30 END AS INTEGER) AS patch,
  CASE WHEN (match_id % 4 < 2 OR start_time >= 800000000) AND n = 5 THEN CAST(77 AS BIGINT) END AS detail_fetched_at FROM maps LEFT JOIN n USING (match_id)""")
def bulk_matches(spark, sf_dir):
    """A slice's maps: patch by name, else by the timeline; complete with ten players, each pick counting as two."""
    m = maps(spark, sf_dir)
    flat = m.select("match_id", "start_time", (F.col("win") == 1).alias("radiant_win"), F.col("a").alias("radiant_team_id"), F.col("b").alias("dire_team_id"), F.get(F.array(F.lit("7.40"), F.lit("7.41"), F.lit("no such"), F.lit(None)), (F.col("match_id") % 4).cast("int")).alias("patch"))
    p = picks(spark, sf_dir)
    players = p.select("match_id", F.explode(F.array(F.col("ord"), F.col("ord") + 128)).alias("player_slot"), F.col("account").alias("account_id"))
    drafted = p.select("match_id", F.col("ord").alias("order"), (F.col("is_pick") == 1).alias("is_pick"), F.col("hero").alias("hero_id"), F.col("side").alias("team"))
    names = spark.createDataFrame([("7.40", 40), ("7.41", 41)], "patch string, patch_id int")
    timeline = spark.createDataFrame([(800000000, 30)], "released_at long, patch_id int")
    return flatten.bulk_rows(flat, drafted, players, F.lit(77).cast("long"), names, timeline)["matches"].select("match_id", "patch", "detail_fetched_at")


@query("SELECT DISTINCT l_orderkey AS match_id, l_partkey AS hero FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def known_slices(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("hero"))
    known = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("match_id"))
    return flatten.known_only(rows, known)[0]


# --- quotes ---


@query("""WITH q AS (SELECT o_orderkey AS k, CAST(o_orderkey % 3 AS INTEGER) AS period, 'Home ' || o_custkey AS home, 'Away ' || o_custkey AS away, 100 + o_orderkey % 50 AS p FROM orders)
SELECT CAST(k AS VARCHAR) AS event_id, period, home AS selection, CAST(p AS DOUBLE) AS price_american, round(1 + p / 1e2, 9) AS price_decimal, CAST(CASE WHEN k % 2 = 0 THEN k % 900 END AS DOUBLE) AS limit_amount, k || '|Regular|moneyline|' || period || '|' || home || '|' AS line_key FROM q
UNION ALL SELECT CAST(k AS VARCHAR), period, away, -p, round(1 + 1e2 / p, 9), CASE WHEN k % 2 = 0 THEN k % 900 END, k || '|Regular|moneyline|' || period || '|' || away || '|' FROM q""")
def two_endpoint_lines(spark, sf_dir):
    """A book's matchups and markets made of orders, joined by id; matchups of other leagues drop out with their markets."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    side = lambda n: F.struct(F.lit(n.lower()).alias("alignment"), F.concat(F.lit(n + " "), F.col("o_custkey")).alias("name"), F.lit(0 if n == "Home" else 1).alias("order"))
    league = lambda n: F.struct(F.lit(n).alias("name")).alias("league")
    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    games = o.select(k.alias("id"), none("string", "startTime"), F.lit(False).alias("isLive"), none("long", "parentId"), none("string", "units"), F.lit(3).alias("bestOfX"), league("Some CUP"), F.array(side("Home"), side("Away")).alias("participants"))
    games = games.union(games.select((-1 - F.col("id")).alias("id"), *games.columns[1:6], league("other"), "participants"))
    price = lambda d, s: F.struct(F.lit(d).alias("designation"), none("long", "participantId"), none("double", "points"), (s * (100 + k % 50)).cast("double").alias("price"))
    limit = lambda amount, kind: F.named_struct(F.lit("amount"), amount.cast("double"), F.lit("type"), kind)
    markets = o.select(
        F.explode(F.array(k, -1 - k)).alias("matchupId"), (k % 3).cast("int").alias("period"), F.lit("moneyline").alias("type"), F.lit("open").alias("status"), none("string", "cutoffAt"), F.lit("m").alias("key"), none("string", "side"),
        F.array(limit(F.lit(1), F.lit("other")), limit(k % 900, F.when(k % 2 == 0, F.lit("maxRiskStake")).otherwise(F.lit("none")))).cast("array<struct<amount: double, type: string>>").alias("limits"), F.array(price("home", 1), price("away", -1)).cast("array<struct<designation: string, participantId: bigint, points: double, price: double>>").alias("prices"),
    )
    out = flatten.two_endpoint_quotes(games, markets, "book", "cup")
    return out.select("event_id", "period", "selection", "price_american", F.round("price_decimal", 9).alias("price_decimal"), "limit_amount", "line_key")


@query("""WITH e AS (SELECT c_custkey AS id, unnest(['x', 'y']) AS book FROM customer), o AS (SELECT id, book, unnest([0, 1]) AS side FROM e),
q AS (SELECT id, book, CASE WHEN side = 0 THEN 'Over' ELSE 'Under' END AS selection, CASE WHEN id % 3 = 0 THEN 2 + side WHEN id % 3 = 1 THEN 2.5 END AS points, 12e-1 + (id % 50 + side * 7) / 20e0 AS d FROM o)
SELECT 'agg:' || book AS source, CAST(id AS VARCHAR) AS event_id, selection, CAST(points AS DOUBLE) AS points, round(d, 9) AS price_decimal, round(CASE WHEN d >= 2 THEN (d - 1) * 100 ELSE -100 / (d - 1) END, 2) AS price_american,
  id || '|' || book || '|totals|0|' || selection || '|' || CASE WHEN points IS NULL THEN '' WHEN points = 2.5 THEN '2.5' ELSE CAST(CAST(points AS BIGINT) AS VARCHAR) END AS line_key FROM q""")
def many_book_lines(spark, sf_dir):
    """An aggregator's events made of customers: two books with one market of two outcomes each."""
    k = F.col("c_custkey")
    point = lambda s: F.when(k % 3 == 0, F.lit(2.0 + s)).when(k % 3 == 1, F.lit(2.5))
    outcome = lambda n, s: F.struct(F.lit(n).alias("name"), (1.2 + (k % 50 + s * 7) / 20).alias("price"), point(s).alias("point"))
    market = F.array(F.struct(F.lit("totals").alias("key"), F.array(outcome("Over", 0), outcome("Under", 1)).alias("outcomes")))
    book = lambda n: F.struct(F.lit(n).alias("key"), F.lit(n).alias("title"), market.alias("markets"))
    text = lambda n: F.lit(n).alias(n)
    events = read(spark, sf_dir, "customer").select(k.cast("string").alias("id"), text("sport_title"), text("commence_time"), text("home_team"), text("away_team"), F.array(book("x"), book("y")).alias("bookmakers"))
    out = flatten.many_book_quotes(events, "agg")
    return out.select("source", "event_id", "selection", "points", F.round("price_decimal", 9).alias("price_decimal"), "price_american", "line_key")


QUOTED = """q AS (SELECT o_orderkey AS id, 'book' AS source, CAST(o_custkey AS VARCHAR) AS event_id, CAST(o_orderkey % 2 AS INTEGER) AS period, CASE WHEN o_orderkey % 5 < 3 THEN 'a' ELSE 'b' END AS selection,
  105e-2 + o_orderkey % 97 / 2e1 AS price, epoch_us(o_orderdate) // 1000000 AS captured_at, CASE o_orderstatus WHEN 'P' THEN 'gone' ELSE 'open' END AS status, CAST(o_orderkey % 11 = 0 AS INTEGER) AS is_live,
  o_custkey || '|' || o_orderkey % 2 || '|' || CASE WHEN o_orderkey % 5 < 3 THEN 'a' ELSE 'b' END || '|' || o_orderkey % 3 AS line_key FROM orders)"""


def _quoted(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    sel = F.when(k % 5 < 3, F.lit("a")).otherwise(F.lit("b"))
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    return o.select(
        k.alias("id"), F.lit("book").alias("source"), F.col("o_custkey").cast("string").alias("event_id"), (k % 2).cast("int").alias("period"), sel.alias("selection"), (1.05 + k % 97 / 20).alias("price_decimal"), start.alias("captured_at"),
        F.when(F.col("o_orderstatus") == "P", F.lit("gone")).otherwise(F.lit("open")).alias("status"), (k % 11 == 0).cast("int").alias("is_live"), F.concat_ws("|", F.col("o_custkey"), k % 2, sel, k % 3).alias("line_key"),
    )


@query(f"""WITH {QUOTED}, l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY source, line_key ORDER BY captured_at DESC, id DESC) = 1),
s AS (SELECT * FROM l WHERE status = 'open' AND is_live = 0 QUALIFY row_number() OVER (PARTITION BY event_id, period, selection ORDER BY captured_at DESC, id DESC) = 1)
SELECT event_id, period, round(max(price) FILTER (WHERE selection = 'a'), 9) AS price_a, round(max(price) FILTER (WHERE selection = 'b'), 9) AS price_b, 1000000000 - min(captured_at) AS age_s, 1000000000 - min(captured_at) > 300 AS stale FROM s GROUP BY event_id, period HAVING count(*) >= 2""")
def live_quotes(spark, sf_dir):
    rows = _quoted(spark, sf_dir)
    out = closing.quote_now(rows, rows.select("event_id").distinct(), ["source", "line_key"], 1000000000)
    return out.select("event_id", "period", F.round(F.col("book")[0].price, 9).alias("price_a"), F.round(F.col("book")[1].price, 9).alias("price_b"), F.col("age_s").cast("long").alias("age_s"), "stale")


@query(f"""WITH {QUOTED}, l AS (SELECT * FROM q WHERE starts_with(source, 'bo') QUALIFY row_number() OVER (PARTITION BY source, line_key ORDER BY captured_at DESC, id DESC) = 1)
SELECT line_key, id, status FROM l WHERE status <> 'gone'""")
def open_lines_of_source(spark, sf_dir):
    return history.open_lines(_quoted(spark, sf_dir), ["source", "line_key"], ["captured_at", "id"], source_prefix="bo").select("line_key", "id", "status")


@query(f"""WITH {QUOTED}, b AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS event_id, CAST(p AS INTEGER) AS period, 880000000 + c_custkey % 1000 * 10000 AS bound FROM customer, (SELECT unnest([0, 1]) AS p)),
x AS (SELECT b.*, selection, price, captured_at, id FROM b JOIN q USING (event_id, period) WHERE status = 'open' AND is_live = 0 AND captured_at < bound QUALIFY row_number() OVER (PARTITION BY event_id, period, selection ORDER BY captured_at DESC, id DESC) = 1)
SELECT c_custkey AS series_id, period, CAST(count(*) AS INTEGER) AS sides, round(sum(1 / price) - 1, 9) AS overround, max(captured_at) AS captured_at FROM x GROUP BY c_custkey, period HAVING count(*) >= 2""")
def closes_of_events(spark, sf_dir):
    """Closing lines from histories with live, closed and later rows."""
    c = F.col("c_custkey")
    bounds = read(spark, sf_dir, "customer").select(c.alias("series_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("period"), F.lit("book").alias("source"), c.cast("string").alias("event_id"), (880000000 + c % 1000 * 10000).alias("bound"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = _quoted(spark, sf_dir).withColumns({"market_type": F.lit("moneyline"), "points": none("double"), "cutoff_at": none("string")})
    return closing.closing_lines(rows, bounds).select("series_id", "period", F.size("book").alias("sides"), F.round("overround", 9).alias("overround"), "captured_at")


@query("""WITH o AS (SELECT o_orderkey AS k, 'Home ' || o_custkey AS home, 'Away ' || o_custkey AS away FROM orders),
m AS (SELECT k, CASE WHEN k % 2 = 0 THEN home ELSE away END AS one, CASE WHEN k % 2 = 0 THEN away ELSE home END AS two, CASE WHEN k % 3 = 0 THEN home ELSE away END AS team FROM o),
q AS (SELECT k, 'moneyline' AS market_type, one AS selection, CAST(NULL AS DOUBLE) AS points FROM m UNION ALL SELECT k, 'moneyline', two, NULL FROM m
  UNION ALL SELECT k, 'moneyline', CAST(k * 10 + 9 AS VARCHAR), NULL FROM m WHERE k % 7 = 0
  UNION ALL SELECT k, 'team_total', team || ':' || unnest(['over', 'under']), 5e-1 + k % 2 / 2e0 FROM m)
SELECT CAST(k AS VARCHAR) AS event_id, market_type, selection, points,
  k || '|Regular|' || market_type || '|1|' || selection || '|' || CASE WHEN points IS NULL THEN '' WHEN points = 1 THEN '1' ELSE '0.5' END AS line_key FROM q""")
def team_total_lines(spark, sf_dir):
    """Moneylines whose prices name participants by ids in falling order, some one too many; and totals of one team."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    side = lambda n, first: F.struct(F.lit(n.lower()).alias("alignment"), F.concat(F.lit(n + " "), F.col("o_custkey")).alias("name"), F.when(k % 2 == first, 0).otherwise(1).alias("order"))
    games = o.select(k.alias("id"), none("string", "startTime"), F.lit(False).alias("isLive"), none("long", "parentId"), none("string", "units"), F.lit(3).alias("bestOfX"), F.struct(F.lit("cup").alias("name")).alias("league"), F.array(side("Home", 0), side("Away", 1)).alias("participants"))
    price = lambda d, i, points: F.struct(F.lit(d).cast("string").alias("designation"), i.cast("long").alias("participantId"), points.cast("double").alias("points"), F.lit(-110.0).alias("price"))
    nobody, nothing = F.lit(None), F.lit(None)
    named = F.array(price(None, k * 10 + 5, nothing), price(None, k * 10 + 2, nothing))
    more = F.when(k % 7 == 0, F.concat(named, F.array(price(None, k * 10 + 9, nothing)))).otherwise(named)
    total = 0.5 + (k % 2) / 2
    market = lambda kind, of, prices: F.struct(F.lit(kind).alias("type"), of.alias("side"), prices.alias("prices"))
    both = F.array(market("moneyline", F.lit(None).cast("string"), more), market("team_total", F.when(k % 3 == 0, "home").otherwise("away"), F.array(price("over", nobody, total), price("under", nobody, total))))
    markets = o.select(k.alias("matchupId"), F.lit(1).alias("period"), F.explode(both).alias("m"), F.lit("open").alias("status"), none("string", "cutoffAt"), F.lit("m").alias("key"), F.array().cast("array<struct<amount: double, type: string>>").alias("limits"))
    markets = markets.select("matchupId", "period", "m.type", "status", "cutoffAt", "key", "m.side", "limits", "m.prices")
    return flatten.two_endpoint_quotes(games, markets, "book").select("event_id", "market_type", "selection", "points", "line_key")


@query(f"""WITH {QUOTED}, p AS (SELECT *, id % 3 / 2e0 AS points FROM q), b AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS event_id, CAST(p AS INTEGER) AS period, 880000000 + c_custkey % 1000 * 10000 AS bound FROM customer, (SELECT unnest([0, 1]) AS p)),
x AS (SELECT b.*, selection, points, price, captured_at, id FROM b JOIN p USING (event_id, period) WHERE status = 'open' AND is_live = 0 AND captured_at < bound QUALIFY row_number() OVER (PARTITION BY event_id, period, selection, points ORDER BY captured_at DESC, id DESC) = 1),
k AS (SELECT c_custkey, period, points, count(*) AS sides, sum(1 / price) - 1 AS overround, max(captured_at) AS captured_at FROM x GROUP BY c_custkey, period, points),
m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c_custkey, period ORDER BY captured_at DESC, points DESC) = 1)
SELECT c_custkey AS series_id, period, points, CAST(sides AS INTEGER) AS sides, round(overround, 9) AS overround, captured_at FROM m WHERE sides >= 2""")
def closes_of_totals(spark, sf_dir):
    """Closing lines of markets with three points: the book that was quoted last is the main line, if it has two sides."""
    c = F.col("c_custkey")
    bounds = read(spark, sf_dir, "customer").select(c.alias("series_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("period"), F.lit("book").alias("source"), c.cast("string").alias("event_id"), (880000000 + c % 1000 * 10000).alias("bound"))
    rows = _quoted(spark, sf_dir).withColumns({"market_type": F.lit("total"), "points": (F.col("id") % 3) / 2, "cutoff_at": F.lit(None).cast("string")})
    return closing.closing_lines(rows, bounds, "total").select("series_id", "period", "points", F.size("book").alias("sides"), F.round("overround", 9).alias("overround"), "captured_at")


# --- resolution ---


@query(f"""WITH {MAPS}, se AS (SELECT series_id, least(a, b) AS lo, greatest(a, b) AS hi, min(start_time) AS start FROM maps WHERE series_id > 0 GROUP BY 1, 2, 3),
ev AS (SELECT c_custkey AS id, c_custkey % 40 AS a, 40 + c_custkey * 7 % 40 AS b, CASE WHEN c_custkey % 10 <> 0 THEN 694224000 + c_custkey * 140000 END AS t0, c_custkey % 4 = 0 AS kills, CASE WHEN c_custkey % 4 = 0 THEN c_custkey - 1 END AS parent FROM customer),
rs AS (SELECT id, t0, kills, parent, CASE WHEN a <> 3 THEN a END AS home, b AS away FROM ev),
nr AS (SELECT e.id, s.series_id, e.t0 - s.start AS skew, row_number() OVER (PARTITION BY e.id ORDER BY abs(e.t0 - s.start), s.series_id) AS k, count(*) OVER (PARTITION BY e.id) AS n FROM rs e JOIN se s ON least(home, away) = s.lo AND greatest(home, away) = s.hi AND home IS NOT NULL AND abs(e.t0 - s.start) <= 2000000),
lo AS (SELECT lo, hi, min(series_id) AS only FROM se GROUP BY lo, hi HAVING count(*) = 1),
jn AS (SELECT rs.*, CASE WHEN t0 IS NULL THEN lo.only ELSE nr.series_id END AS sid, nr.skew, coalesce(nr.n > 1, false) AS ambiguous FROM rs LEFT JOIN nr ON nr.id = rs.id AND nr.k = 1 LEFT JOIN lo ON home IS NOT NULL AND lo.lo = least(home, away) AND lo.hi = greatest(home, away))
SELECT CAST(j.id AS VARCHAR) AS event_id, CAST(j.kills AS INTEGER) AS is_kills, j.home AS home_team_id, j.away AS away_team_id, coalesce(j.sid, p.sid) AS series_id, j.skew AS start_skew_s, j.ambiguous FROM jn j LEFT JOIN jn p ON j.parent = p.id""")
def resolved_events(spark, sf_dir):
    """Events made of customers: every fourth is a kills event of the one before; the teams' names are aliases but one."""
    c = F.col("c_custkey")
    name = lambda t, kills: F.concat(F.lit(" TEAM  "), t.cast("string"), F.when(kills, F.lit(" (Kills)")).otherwise(F.lit("")))
    text = F.when(c % 10 != 0, (694224000 + c * 140000).cast("string"))
    snaps = read(spark, sf_dir, "customer").select(F.lit("s").alias("source"), c.cast("string").alias("event_id"), F.lit(None).cast("string").alias("units"), name(c % 40, c % 4 == 0).alias("home"), name(40 + c * 7 % 40, c % 4 == 0).alias("away"), text.alias("start_time"))
    aliases = spark.range(80).where("id <> 3").select(F.concat(F.lit("team "), F.col("id").cast("string")).alias("key"), F.col("id").alias("team_id"), F.lit("x").alias("name"))
    series = maps(spark, sf_dir).groupBy("series_id", F.least("a", "b").alias("team_a"), F.greatest("a", "b").alias("team_b")).agg(F.min("start_time").alias("start"))
    parents = read(spark, sf_dir, "customer").where(c % 4 == 0).select(c.cast("string").alias("event_id"), (c - 1).cast("string").alias("parent_event_id"))
    out = links.resolve_events(snaps, aliases, series, parents, 2000000)
    return out.select("event_id", "is_kills", "home_team_id", "away_team_id", "series_id", "start_skew_s", "ambiguous")


@query(f"WITH {MAPS}, c AS (SELECT c_custkey AS id, least(c_custkey % 40, 40 + c_custkey * 7 % 40) AS lo, greatest(c_custkey % 40, 40 + c_custkey * 7 % 40) AS hi FROM customer) SELECT id AS event_id, match_id FROM c JOIN maps m ON (m.a = c.lo AND m.b = c.hi) OR (m.a = c.hi AND m.b = c.lo)")
def either_side_join(spark, sf_dir):
    """Events with the maps of their two teams, whichever side each is on: a join on the unordered pair."""
    c = F.col("c_custkey")
    events = read(spark, sf_dir, "customer").select(c.alias("event_id"), (c % 40).alias("x"), (40 + c * 7 % 40).alias("y")).select("event_id", *links.unordered_pair("x", "y"))
    return links.all_pairs(events, maps(spark, sf_dir).select("match_id", *links.unordered_pair("a", "b")), ["lo", "hi"], "event_id", "match_id")


# --- drafts ---


@query(f"""WITH {MAPS}, e AS (SELECT match_id, i AS ord, (match_id * 7 + CASE WHEN match_id % 3 = 0 AND i = 9 THEN 0 ELSE i * 11 END) % 127 AS hero, (i + match_id // 2) % 2 AS team, 1 AS is_pick FROM maps, (SELECT unnest(range(0, 10)) AS i)
  WHERE match_id % 5 <> 0 OR i < 9 UNION ALL SELECT match_id, -1, 126, match_id % 2, 0 FROM maps WHERE match_id % 4 > 0),
a AS (SELECT match_id, list(hero ORDER BY ord) FILTER (WHERE is_pick = 1 AND team = 0) AS x, list(hero ORDER BY ord) FILTER (WHERE is_pick = 1 AND team = 1) AS y, min_by(team, ord) = 0 AS first_a FROM e GROUP BY match_id)
SELECT match_id, array_to_string(x, ',') AS heroes_a, array_to_string(y, ',') AS heroes_b, first_a FROM a WHERE len(x) = 5 AND len(y) = 5 AND len(list_distinct(x || y)) = 10""")
def complete_drafts(spark, sf_dir):
    """Drafts of five and five distinct heroes; every third names a hero twice, every fifth lacks a pick, most begin with a
    ban."""
    k = F.col("match_id")
    m = maps(spark, sf_dir).select("match_id")
    picked = m.select("match_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("ord")).where((k % 5 != 0) | (F.col("ord") < 9))
    hero = (k * 7 + F.when((k % 3 == 0) & (F.col("ord") == 9), 0).otherwise(F.col("ord") * 11)) % 127
    team = (F.col("ord") + F.floor(k / 2)) % 2
    events = picked.select("match_id", "ord", F.lit(1).alias("is_pick"), hero.cast("int").alias("hero_id"), team.cast("int").alias("team"))
    bans = m.where(k % 4 > 0).select("match_id", F.lit(-1).alias("ord"), F.lit(0).alias("is_pick"), F.lit(126).alias("hero_id"), (k % 2).cast("int").alias("team"))
    out = drafts.complete_drafts(events.union(bans))
    return out.select("match_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("heroes_a", "heroes_b")], "first_a")


@query(f"""WITH {MAPS}, {QUOTED} SELECT (SELECT count(*) FROM maps) AS matches, (SELECT count(*) FROM maps WHERE win = 1) AS with_detail, (SELECT count(*) FROM maps WHERE series_type > 0) AS with_patch,
  count(*) AS snapshots, count(DISTINCT line_key) AS lines, count(DISTINCT event_id) AS events, min(captured_at) AS first_capture, max(captured_at) AS last_capture FROM q""")
def status_counts(spark, sf_dir):
    m = maps(spark, sf_dir).select("match_id", F.when(F.col("win") == 1, F.lit(1)).alias("detail_fetched_at"), F.when(F.col("series_type") > 0, F.lit(1)).alias("patch"))
    return rollups.status_report({"matches": m, "odds_snapshots": _quoted(spark, sf_dir)})
