"""Queries on maps, drafts, names, payloads and merges; ratings and walk-forward evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import closing, drafts, links, ratings, rollups, walkforward
from ..sources.shared import materialize
from ..sources import writers
from . import views
from .views import BOOKS, MAPS, PICKS, books, maps, picks, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(x, n=9):
    return F.round(x, n)


# --- joins ---


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, sf_dir):
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def semi_known(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_missing(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "top")


TIMELINE = [(694224000 + k * 7776000, k) for k in range(60)]


@query(f"""WITH {MAPS}, timeline(released_at, patch_id) AS (VALUES {", ".join(map(str, TIMELINE))})
SELECT match_id, start_time, (SELECT max_by(patch_id, released_at) FROM timeline WHERE released_at <= start_time) AS patch FROM maps""")
def patch_asof(spark, sf_dir):
    timeline = spark.createDataFrame(TIMELINE, "released_at long, patch_id int")
    m = maps(spark, sf_dir).select("match_id", "start_time", F.lit(None).cast("int").alias("patch"))
    return links.patch_of(m, timeline, "start_time")


NEAR = f"""WITH {MAPS}, ev AS (SELECT c_custkey AS event_id, c_custkey % 40 AS a, 40 + c_custkey * 7 % 40 AS b, CASE WHEN c_custkey % 10 <> 0 THEN 694224000 + c_custkey * 140000 END AS at FROM customer),
se AS (SELECT match_id AS series_id, least(a, b) AS lo, greatest(a, b) AS hi, start_time FROM maps),
near AS (SELECT e.event_id, s.series_id, e.at - s.start_time AS skew, abs(e.at - s.start_time) AS d, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.at - s.start_time), s.series_id) AS k, count(*) OVER (PARTITION BY e.event_id) AS n
  FROM ev e JOIN se s ON least(e.a, e.b) = s.lo AND greatest(e.a, e.b) = s.hi AND abs(e.at - s.start_time) <= 7776000),
lone AS (SELECT lo, hi, min(series_id) AS only FROM se GROUP BY lo, hi HAVING count(*) = 1),
joined AS (SELECT e.event_id, CASE WHEN e.at IS NULL THEN l.only ELSE n.series_id END AS series_id, n.skew, coalesce(n.n > 1, false) AS ambiguous
  FROM ev e LEFT JOIN near n ON n.event_id = e.event_id AND n.k = 1 LEFT JOIN lone l ON l.lo = least(e.a, e.b) AND l.hi = greatest(e.a, e.b))
"""


def _near(spark, sf_dir):
    k = F.col("c_custkey")
    ev = read(spark, sf_dir, "customer").select(k.alias("event_id"), (k % 40).alias("a"), (40 + k * 7 % 40).alias("b"), F.when(k % 10 != 0, 694224000 + k * 140000).alias("at"))
    ev = ev.select("event_id", "at", *links.unordered_pair("a", "b"))
    se = maps(spark, sf_dir).select(F.col("match_id").alias("series_id"), "start_time", *links.unordered_pair("a", "b"))
    return links.nearest_within(ev, se, ["lo", "hi"], ["event_id"], "at", "start_time", "series_id", 7776000).select("event_id", "series_id", "skew", "ambiguous")


@query(NEAR + "SELECT * FROM joined")
def nearest_within_tolerance(spark, sf_dir):
    return _near(spark, sf_dir)


@query(NEAR + "SELECT event_id, series_id FROM joined WHERE ambiguous")
def ambiguous_matches(spark, sf_dir):
    return _near(spark, sf_dir).where("ambiguous").select("event_id", "series_id")


@query("""WITH RECURSIVE x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey - 1 END AS parent, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS v FROM orders),
up AS (SELECT id, parent, v FROM x UNION ALL SELECT u.id, p.parent, p.v FROM up u JOIN x p ON u.v IS NULL AND u.parent = p.id)
SELECT x.id, x.parent, max(up.v) AS v FROM x JOIN up ON up.id = x.id GROUP BY x.id, x.parent""")
def parent_inherit(spark, sf_dir):
    k = F.col("o_orderkey")
    x = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 != 0, k - 1).alias("parent"), F.when(k % 7 == 0, F.col("o_custkey")).alias("v"))
    return links.inherit(x, "id", "parent", "v")


@query(f"WITH {MAPS} SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n, min(start_time) AS first_start FROM maps GROUP BY 1, 2")
def side_or_join(spark, sf_dir):
    return maps(spark, sf_dir).select("start_time", *links.unordered_pair("a", "b")).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("start_time").alias("first_start"))


# --- aggregates, windows, top-k, sets ---


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def distinct_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1, 2 ORDER BY n DESC, days DESC, o_custkey, o_orderpriority LIMIT 10")
def topk_coverage(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_orderdate").alias("days"))
    return rollups.top_k(g, 10, F.desc("n"), F.desc("days"), F.asc("o_custkey"), F.asc("o_orderpriority"))


@query(f"""WITH {MAPS}, {PICKS}, d AS (SELECT DISTINCT match_id FROM picks), p AS (SELECT match_id FROM picks GROUP BY match_id HAVING count(*) = 5)
SELECT count(*) AS total, count(*) FILTER (WHERE win = 1) AS detail, count(*) FILTER (WHERE series_type > 0) AS patch, count(d.match_id) AS draft, count(p.match_id) AS players
FROM maps LEFT JOIN d USING (match_id) LEFT JOIN p USING (match_id)""")
def coverage_report(spark, sf_dir):
    m = maps(spark, sf_dir).select("match_id", F.when(F.col("win") == 1, F.lit(1)).alias("detail_fetched_at"), F.when(F.col("series_type") > 0, F.lit(1)).alias("patch"))
    p = picks(spark, sf_dir)
    ten = p.groupBy("match_id").agg(F.count("*").alias("k")).where("k = 5").select("match_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("slot"))
    return rollups.coverage_report(m, p, ten).drop("percent")


@query(f"WITH {MAPS} SELECT series_id, match_id, a, b, start_time FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_time, match_id) AS k FROM maps) WHERE k = 1")
def first_per_group(spark, sf_dir):
    return rollups.first_in(maps(spark, sf_dir), ["series_id"], ["start_time", "match_id"], ["match_id", "a", "b", "start_time"])


@query(f"WITH {PICKS} SELECT match_id, list_sort(list(DISTINCT account)) AS lineup FROM picks GROUP BY match_id HAVING count(DISTINCT account) = 5")
def lineup_sets(spark, sf_dir):
    return rollups.lineups(picks(spark, sf_dir), ["match_id"], "account")


@query(f"""WITH {MAPS}, s AS (SELECT match_id, start_time, a AS team, 0 AS side FROM maps UNION ALL SELECT match_id, start_time, b, 1 FROM maps),
n AS (SELECT match_id, side, count(*) OVER (PARTITION BY team ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM s)
SELECT match_id, max(n) FILTER (WHERE side = 0) AS games_a, max(n) FILTER (WHERE side = 1) AS games_b FROM n GROUP BY match_id""")
def running_games(spark, sf_dir):
    return rollups.running_games(maps(spark, sf_dir), ["start_time", "match_id"]).select("match_id", "games_a", "games_b")


@query(f"WITH {MAPS} SELECT series_id, match_id, start_time FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_time, match_id) AS k FROM maps) WHERE k = 2")
def nth_in_series(spark, sf_dir):
    return rollups.nth_in(maps(spark, sf_dir), ["series_id"], ["start_time", "match_id"], 2).select("series_id", "match_id", "start_time")


@query(f"WITH {MAPS} SELECT match_id, row_number() OVER (PARTITION BY series_id ORDER BY start_time, match_id) AS period, lag(start_time + duration) OVER (PARTITION BY series_id ORDER BY start_time, match_id) AS prev_end FROM maps")
def prev_end_lag(spark, sf_dir):
    w = Window.partitionBy("series_id").orderBy("start_time", "match_id")
    m = rollups.numbered(maps(spark, sf_dir), ["series_id"], ["start_time", "match_id"])
    return m.select("match_id", F.col("period").cast("long").alias("period"), F.lag(F.col("start_time") + F.col("duration")).over(w).alias("prev_end"))


@query(f"WITH {MAPS} SELECT DISTINCT series_id FROM maps WHERE contains(lower(league), 'urgent') OR contains(lower(league), 'high')")
def named_leagues(spark, sf_dir):
    m = maps(spark, sf_dir).select(F.col("series_id").alias("league_id"), F.col("league").alias("league_name"))
    return rollups.leagues_named(m, ["urgent", "high"]).withColumnRenamed("league_id", "series_id")


@query(f"""WITH {MAPS}, {PICKS}, s AS (SELECT match_id, side, list(DISTINCT hero) AS hs FROM picks GROUP BY match_id, side)
SELECT x.match_id, len(list_intersect(x.hs, y.hs)) AS shared, len(x.hs) AS n_a, len(y.hs) AS n_b FROM s x JOIN s y ON x.match_id = y.match_id AND x.side = 0 AND y.side = 1""")
def hero_overlap(spark, sf_dir):
    s = picks(spark, sf_dir).groupBy("match_id").agg(F.collect_set(F.when(F.col("side") == 0, F.col("hero"))).alias("x"), F.collect_set(F.when(F.col("side") == 1, F.col("hero"))).alias("y")).where("size(x) > 0 AND size(y) > 0")
    return s.select("match_id", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), F.size("x").cast("long").alias("n_a"), F.size("y").cast("long").alias("n_b"))


# --- flatten, scalars ---


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS minute, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def explode_arrays(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("minute", "v"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS minute, embedding[i] AS gold, CASE WHEN i <= 40 THEN embedding[i + 20] END AS xp FROM (SELECT vec_id, embedding, unnest(range(1, 61)) AS i FROM embeddings)")
def zip_arrays(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 60).alias("gold"), F.slice("embedding", 21, 40).alias("xp"))
    return e.select("vec_id", F.posexplode(F.arrays_zip("gold", "xp")).alias("minute", "v")).select("vec_id", "minute", "v.gold", "v.xp")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(f"WITH {MAPS} SELECT a AS team, match_id, win AS won FROM maps UNION ALL SELECT b, match_id, 1 - win FROM maps")
def unpivot_sides(spark, sf_dir):
    m = maps(spark, sf_dir).select("match_id", F.explode(F.array(F.struct(F.col("a").alias("team"), F.col("win").alias("won")), F.struct(F.col("b").alias("team"), (1 - F.col("win")).alias("won")))).alias("x"))
    return m.select("x.team", "match_id", "x.won")


@query("SELECT DISTINCT o_orderkey || '|Regular|' || o_orderpriority || '|' || (o_orderkey % 4) || '||' || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '2' ELSE '2.5' END AS line_key FROM orders")
def composite_key(spark, sf_dir):
    from ..sources.flatten import _text, line_key

    k = F.col("o_orderkey")
    points = F.when(k % 3 == 1, F.lit(2.0)).when(k % 3 == 2, F.lit(2.5))
    return read(spark, sf_dir, "orders").select(line_key(k, F.lit("Regular"), F.col("o_orderpriority"), k % 4, F.lit(None).cast("string"), _text(points)).alias("line_key")).distinct()


@query("""SELECT o_orderkey, p AS american, CASE WHEN p > 0 THEN 1 + p / 100e0 WHEN p < 0 THEN 1 + 100e0 / abs(p) END AS dec,
  CASE WHEN d <= 1 THEN NULL WHEN d >= 2 THEN round((d - 1) * 100, 2) ELSE round(-100 / (d - 1), 2) END AS back
  FROM (SELECT o_orderkey, CAST(o_orderkey % 801 - 400 AS DOUBLE) AS p, 1 + (o_orderkey % 500) / 128e0 AS d FROM orders)""")
def american_decimal(spark, sf_dir):
    k = F.col("o_orderkey")
    x = read(spark, sf_dir, "orders").select("o_orderkey", (k % 801 - 400).cast("double").alias("american"), (1 + (k % 500) / 128).alias("d"))
    return x.select("o_orderkey", "american", fn.american_to_decimal(F.col("american")).alias("dec"), fn.decimal_to_american(F.col("d")).alias("back"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000000 WHEN 2 THEN epoch_us(ts) // 1000000 - 7200 END AS epoch FROM events""")
def parse_ts_mixed(spark, sf_dir):
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, second.cast("string")).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit("+02:00"))).otherwise(F.lit("not a time"))
    return read(spark, sf_dir, "events").select("event_id", fn.parse_ts(text).alias("epoch"))


@query("SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || chr(9) || ' X ', '\\s+', ' ', 'g'))) AS name FROM part")
def norm_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", fn.norm_name(F.concat(F.lit("  "), "p_name", F.lit("\t X "))).alias("name"))


@query("""SELECT c_custkey, c_name AS base, c_custkey % 2 = 0 AS kills FROM customer""")
def kills_strip(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" (Kills) "))).otherwise(F.col("c_name"))
    base, kills = fn.strip_kills(raw)
    return read(spark, sf_dir, "customer").select("c_custkey", base.alias("base"), kills.alias("kills"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^\\p{L}\\p{N}]', '', 'g') AS hero FROM part")
def hero_norm(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", fn.norm_hero(F.concat_ws("-", "p_name", "p_brand")).alias("hero"))


# --- merges ---

STORED = "stored AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS p, o_totalprice AS v FROM orders WHERE o_orderkey % 4 <> 0)"
FRESH = "fresh AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'new' END AS p, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice + 1 END AS v FROM orders WHERE o_orderkey % 2 = 0)"


def _merge(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    stored = o.where("o_orderkey % 4 <> 0").select(k.alias("k"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("p"), F.col("o_totalprice").alias("v"))
    fresh = o.where("o_orderkey % 2 = 0").select(k.alias("k"), F.when(k % 5 != 0, F.lit("new")).alias("p"), F.when(k % 7 != 0, F.col("o_totalprice") + 1).alias("v"))
    return stored, fresh


@query(f"WITH {STORED}, {FRESH} SELECT coalesce(f.k, s.k) AS k, coalesce(f.p, s.p) AS p, coalesce(f.v, s.v) AS v FROM stored s FULL JOIN fresh f ON s.k = f.k")
def upsert_coalesce(spark, sf_dir):
    return writers.upsert_coalesce(*_merge(spark, sf_dir), ["k"])


@query(f"WITH {STORED}, {FRESH} SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE k NOT IN (SELECT k FROM fresh)")
def upsert_replace(spark, sf_dir):
    return writers.upsert_replace(*_merge(spark, sf_dir), ["k"])


@query(f"WITH {STORED}, {FRESH} SELECT * FROM stored UNION ALL SELECT * FROM fresh WHERE k NOT IN (SELECT k FROM stored)")
def insert_ignore(spark, sf_dir):
    return writers.insert_ignore(*_merge(spark, sf_dir), ["k"])


# --- market and scoring ---


@query(f"WITH {BOOKS} SELECT match_id, round(1 / odds_a + 1 / odds_b - 1, 9) AS margin, round((1 / odds_a) / (1 / odds_a + 1 / odds_b), 9) AS p_a, round((1 / odds_b) / (1 / odds_a + 1 / odds_b), 9) AS p_b FROM books")
def devig_proportional(spark, sf_dir):
    o = F.array("odds_a", "odds_b")
    p = fn.devig_proportional(o)
    return books(spark, sf_dir).select("match_id", _r(fn.overround(o)).alias("margin"), _r(F.get(p, 0)).alias("p_a"), _r(F.get(p, 1)).alias("p_b"))


SHIN_P = """CASE WHEN s <= 1 THEN x / s WHEN (s - 1) * (d * d - s) / (s * (d * d - 1)) < 5e-1 THEN x - (s - 1) / 2
  ELSE (sqrt(25e-2 + 2 * x * x / s) - 5e-1) / (sqrt(25e-2 + 2 * x * x / s) - 5e-1 + sqrt(25e-2 + 2 * y * y / s) - 5e-1) END"""
SHIN = BOOKS + """, i AS (SELECT match_id, 1 / odds_a AS x, 1 / odds_b AS y FROM books), s AS (SELECT *, x + y AS s, x - y AS d FROM i)"""


@query(f"""WITH {SHIN} SELECT match_id, round(CASE WHEN s > 1 THEN least((s - 1) * (d * d - s) / (s * (d * d - 1)), 5e-1) END, 9) AS z,
  round({SHIN_P}, 9) AS p_a FROM s""")
def devig_shin_two_way(spark, sf_dir):
    z, p, _ = fn.shin_two_way(F.col("odds_a"), F.col("odds_b"))
    return books(spark, sf_dir).select("match_id", _r(z).alias("z"), _r(p).alias("p_a"))


THREE = BOOKS + """, t AS (SELECT match_id, [1 / (19e-1 + (match_id % 7) / 10e0), 1 / (28e-1 + (match_id % 5) / 10e0), 1 / (3e0 + (match_id % 11) / 10e0)] AS p FROM maps),
b AS (SELECT DISTINCT p FROM t), g AS (SELECT p, list_sum(p) AS s FROM b), h AS (SELECT p, s FROM g WHERE s > 1)"""


@query(f"""WITH RECURSIVE {THREE}, it AS (
  SELECT p, s, 0e0 AS lo, 5e-1 AS hi, 0 AS k FROM h UNION ALL
  SELECT p, s, CASE WHEN big THEN mid ELSE lo END, CASE WHEN big THEN hi ELSE mid END, k + 1 FROM (
    SELECT *, list_sum([(sqrt(mid * mid + 4 * (1 - mid) * q * q / s) - mid) / (2 * (1 - mid)) FOR q IN p]) > 1 AS big FROM (SELECT *, (lo + hi) / 2 AS mid FROM it WHERE k < 60)))
SELECT t.match_id, round((lo + hi) / 2, 8) AS z FROM t LEFT JOIN it ON it.p = t.p AND it.k = 60""")
def devig_shin_multi(spark, sf_dir):
    k = F.col("match_id")
    odds = F.array(1.9 + (k % 7) / 10, 2.8 + (k % 5) / 10, 3.0 + (k % 11) / 10)
    return maps(spark, sf_dir).select("match_id", _r(fn.shin_z(odds, 60), 8).alias("z"))


PROB = "round(1 / (1 + exp(-((match_id % 41) - 20) / 8e0)), 9)"


def _prob():
    return F.round(1 / (1 + F.exp(-((F.col("match_id") % 41) - 20) / 8)), 9)


@query(f"WITH {MAPS}, p AS (SELECT match_id, series_type, {PROB} AS p FROM maps) SELECT match_id, round(CASE series_type WHEN 0 THEN p WHEN 1 THEN p * p * (3 - 2 * p) WHEN 2 THEN p * p * p * (10 - 15 * p + 6 * p * p) END, 9) AS p FROM p")
def series_prob(spark, sf_dir):
    return maps(spark, sf_dir).select("match_id", _r(fn.series_win_prob(_prob(), F.col("series_type"))).alias("p"))


SCORED = MAPS + f", p AS (SELECT *, {PROB} AS p FROM maps), sc AS (SELECT *, (p - win) * (p - win) AS br, -CASE WHEN win = 1 THEN ln(p) ELSE ln(1 - p) END AS ll FROM p)"


@query(f"WITH {SCORED} SELECT league, count(*) AS n, round(avg(br), 9) AS brier, round(avg(ll), 9) AS log_loss FROM sc GROUP BY league")
def scorecard(spark, sf_dir):
    return rollups.scorecard(maps(spark, sf_dir).withColumn("prob", _prob()), ["league"], outcome="win").select("league", "n", _r("brier").alias("brier"), _r("log_loss").alias("log_loss"))


@query(f"WITH {SCORED} SELECT strftime(make_timestamp(start_time * 1000000), '%Y-%m-%d') AS day, count(*) AS n, round(avg(br), 9) AS brier FROM sc GROUP BY 1")
def scorecard_by_day(spark, sf_dir):
    return rollups.scorecard_by_day(maps(spark, sf_dir).withColumn("prob", _prob()), "start_time", outcome="win").select("day", "n", _r("brier").alias("brier"))


OUTCOMES = MAPS + """, sides AS (SELECT series_id, a AS team, win AS won FROM maps UNION ALL SELECT series_id, b, 1 - win FROM maps),
tally AS (SELECT series_id, team, sum(won) AS wins, sum(1 - won) AS losses FROM sides GROUP BY 1, 2),
kind AS (SELECT series_id, CASE series_type WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS need FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_time, match_id) AS k FROM maps) WHERE k = 1),
res AS (SELECT series_id, team, CASE WHEN wins >= need THEN 1 WHEN losses >= need THEN 0 END AS outcome,
  CASE WHEN need IS NULL THEN 'series format has no winner' WHEN greatest(wins, losses) < need THEN 'series undecided' END AS reason FROM tally JOIN kind USING (series_id))"""


@query(f"WITH {OUTCOMES} SELECT * FROM res")
def outcome_series(spark, sf_dir):
    return rollups.series_outcome(maps(spark, sf_dir))


@query(f"WITH {OUTCOMES} SELECT reason, count(*) AS n FROM res WHERE reason IS NOT NULL GROUP BY reason")
def skip_reasons(spark, sf_dir):
    return rollups.skip_reasons(rollups.series_outcome(maps(spark, sf_dir)))


TRADES = MAPS + f""", bk AS (SELECT match_id, 105e-2 + (match_id % 97) / 20e0 AS oa, 11e-1 + (match_id % 89) / 25e0 AS ob FROM maps),
cl AS (SELECT match_id, {SHIN_P} AS close FROM (SELECT match_id, 1/oa AS x, 1/ob AS y, 1/oa + 1/ob AS s, 1/oa - 1/ob AS d FROM bk)),
tr AS (SELECT m.match_id, {PROB.replace("match_id", "m.match_id")} AS prob, oa AS price, close, win FROM maps m JOIN bk USING (match_id) JOIN cl USING (match_id))"""


def _trades(spark, sf_dir):
    _, close, _ = fn.shin_two_way(F.col("odds_a"), F.col("odds_b"))
    return maps(spark, sf_dir).join(books(spark, sf_dir), "match_id").select("match_id", _prob().alias("prob"), F.col("odds_a").alias("price"), close.alias("close"), "win")


@query(f"WITH {TRADES} SELECT match_id, round(prob - close, 9) AS edge, round(price * close - 1, 9) AS clv, round((prob - win) * (prob - win), 9) AS brier, round((close - win) * (close - win), 9) AS close_brier FROM tr")
def clv_scored(spark, sf_dir):
    p, c, y = F.col("prob"), F.col("close"), F.col("win")
    return _trades(spark, sf_dir).select("match_id", _r(fn.edge(p, c)).alias("edge"), _r(fn.clv(F.col("price"), c)).alias("clv"), _r(fn.brier(p, y)).alias("brier"), _r(fn.brier(c, y)).alias("close_brier"))


STAKE = "least(round(greatest(0e0, (prob * price - 1) / (price - 1)) * 1000, 2), 5e1)"


@query(f"WITH {TRADES} SELECT match_id, {STAKE} AS stake FROM tr")
def kelly_stake(spark, sf_dir):
    return _trades(spark, sf_dir).select("match_id", fn.kelly_stake(F.col("prob"), F.col("price"), 1000, 50).alias("stake"))


@query(f"WITH {TRADES}, s AS (SELECT win, {STAKE} AS stake, price FROM tr) SELECT win AS outcome, count(*) AS n, round(sum(stake), 4) AS staked, round(sum(CASE WHEN win = 1 THEN stake * (price - 1) ELSE -stake END), 4) AS pnl FROM s GROUP BY win")
def settlement(spark, sf_dir):
    t = _trades(spark, sf_dir).withColumn("stake", fn.kelly_stake(F.col("prob"), F.col("price"), 1000, 50))
    return t.groupBy(F.col("win").alias("outcome")).agg(F.count("*").alias("n"), _r(F.sum("stake"), 4).alias("staked"), _r(F.sum(fn.pnl(F.col("win"), F.col("stake"), F.col("price"))), 4).alias("pnl"))


def _league(spark, sf_dir):
    """Matches, snapshots and predictions of the full scoring path, made of orders."""
    m = maps(spark, sf_dir).where("series_type < 3 AND match_id > 0").select(
        "match_id", (F.col("match_id")).alias("series_id"), F.lit(0).alias("series_type"), "start_time", F.col("a").alias("radiant_team_id"), F.col("b").alias("dire_team_id"), F.col("win").alias("radiant_win"),
    )
    b = books(spark, sf_dir)
    side = lambda n, c: F.struct(F.concat(F.lit("Team "), F.col(n).cast("string")).alias("selection"), F.col(c).alias("price_decimal"))
    q = m.join(b, "match_id").select("match_id", "start_time", F.explode(F.array(side("radiant_team_id", "odds_a"), side("dire_team_id", "odds_b"))).alias("x"))
    late = F.array(F.struct(F.lit(-60).alias("d"), F.lit(1.0).alias("f")), F.struct(F.lit(-600).alias("d"), F.lit(1.5).alias("f")), F.struct(F.lit(60).alias("d"), F.lit(2.0).alias("f")))
    q = q.select("match_id", "start_time", "x.*", F.explode(late).alias("l"))
    snaps = q.select(
        F.xxhash64("match_id", "selection", "l").alias("id"), F.lit("book").alias("source"), F.col("match_id").cast("string").alias("event_id"), F.lit(1).alias("period"), "selection", F.lit(None).cast("double").alias("points"),
        (F.col("price_decimal") * F.col("l.f")).alias("price_decimal"), (F.col("start_time") + F.col("l.d")).alias("captured_at"), F.lit(None).cast("string").alias("cutoff_at"), F.lit("moneyline").alias("market_type"), F.lit("open").alias("status"), F.lit(0).alias("is_live"),
    )
    bounds = closing.horns(m).where("period = 1").select("series_id", "period", F.lit("book").alias("source"), F.col("series_id").cast("string").alias("event_id"), F.col("horn").alias("bound"))
    preds = m.select("series_id", F.lit(1).alias("period"), F.concat(F.lit("team  "), F.col("radiant_team_id").cast("string")).alias("selection"), F.col("radiant_team_id").alias("team"), F.round(1 / (1 + F.exp(-((F.col("match_id") % 41) - 20) / 8)), 9).alias("prob"), F.lit(2.0).alias("price_taken"), F.lit(10.0).alias("stake"))
    return m, snaps, bounds, preds


LEAGUE = TRADES + ", lg AS (SELECT tr.*, m.series_type FROM tr JOIN maps m USING (match_id) WHERE m.series_type < 3 AND m.match_id > 0)"


@query(f"WITH {LEAGUE} SELECT match_id AS series_id, round(close, 7) AS close_prob, round(prob - close, 7) AS edge, round(2 * close - 1, 7) AS clv, win AS outcome FROM lg")
def clv_pipeline(spark, sf_dir):
    m, snaps, bounds, preds = _league(spark, sf_dir)
    out = closing.clv_report(preds, closing.closing_lines(snaps, bounds), m).where("reason IS NULL")
    return out.select("series_id", _r("close_prob", 7).alias("close_prob"), _r("edge", 7).alias("edge"), _r("clv", 7).alias("clv"), "outcome")


@query(f"WITH {LEAGUE} SELECT count(*) AS n_settled, CAST(0 AS BIGINT) AS n_pending, CAST(0 AS BIGINT) AS n_unresolved, round(count(*) * 1e1, 4) AS staked, round(sum(CASE WHEN win = 1 THEN 1e1 ELSE -1e1 END), 4) AS pnl, round(avg(2 * close - 1), 7) AS mean_clv FROM lg")
def settlement_summary(spark, sf_dir):
    m, snaps, bounds, preds = _league(spark, sf_dir)
    out = closing.settlement_summary(closing.settle(preds, closing.closing_lines(snaps, bounds), m))
    return out.select("n_settled", "n_pending", "n_unresolved", _r("staked", 4).alias("staked"), _r("pnl", 4).alias("pnl"), _r("mean_clv", 7).alias("mean_clv"))


def _series(spark, sf_dir):
    """Matches, closing lines and predictions of all maps in their own series, with what can't be scored or settled.

    Series are customers, also those without a map. Predicted are each map for its own teams, the series (period 0) and
    one map more than were played for the teams of the first map, and that one's second team in maps where it doesn't
    play; team 0 has no alias. Quoted are the teams of each map and, for the series, those of the first.
    """
    m = maps(spark, sf_dir).select("match_id", "series_id", "series_type", "start_time", F.col("a").alias("radiant_team_id"), F.col("b").alias("dire_team_id"), F.col("win").alias("radiant_win"))
    played = rollups.numbered(m.where("series_id > 0"), ["series_id"], ["start_time", "match_id"]).join(books(spark, sf_dir), "match_id")
    first = played.where("period = 1").drop("period")
    quoted = played.unionByName(first.withColumn("period", F.lit(0)))
    name = lambda t: F.concat(F.lit("Team "), F.lpad(t.cast("string"), 2, "0"))
    side = lambda n, c: F.struct(name(F.col(n)).alias("selection"), F.col(c).alias("price_decimal"))
    late = F.array(F.struct(F.lit(-60).alias("d"), F.lit(1.0).alias("f")), F.struct(F.lit(-600).alias("d"), F.lit(1.5).alias("f")), F.struct(F.lit(60).alias("d"), F.lit(2.0).alias("f")))
    q = quoted.select("series_id", "period", "start_time", F.explode(F.array(side("radiant_team_id", "odds_a"), side("dire_team_id", "odds_b"))).alias("x")).select("series_id", "period", "start_time", "x.*", F.explode(late).alias("l"))
    snaps = q.select(
        F.xxhash64("series_id", "period", "selection", "l").alias("id"), F.lit("book").alias("source"), F.col("series_id").cast("string").alias("event_id"), "period", "selection", F.lit(None).cast("double").alias("points"),
        (F.col("price_decimal") * F.col("l.f")).alias("price_decimal"), (F.col("start_time") + F.col("l.d")).alias("captured_at"), F.lit(None).cast("string").alias("cutoff_at"), F.lit("moneyline").alias("market_type"), F.lit("open").alias("status"), F.lit(0).alias("is_live"),
    )
    bounds = closing.horns(m).select("series_id", "period", F.lit("book").alias("source"), F.col("series_id").cast("string").alias("event_id"), F.col("horn").alias("bound"))
    k = F.col("series_id")
    everyone = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series_id")).union(m.select("series_id")).distinct()
    known = everyone.join(first.select("series_id", F.col("radiant_team_id").alias("a"), F.col("dire_team_id").alias("b")), "series_id", "left").join(played.groupBy("series_id").agg(F.count("*").cast("int").alias("n")), "series_id", "left")
    known = known.select("series_id", F.coalesce("a", k % 40).alias("a"), F.coalesce("b", 40 + k % 40).alias("b"), F.coalesce("n", F.lit(0)).alias("n"))
    ends = known.select("series_id", F.explode(F.flatten(F.transform(F.array(F.lit(0), F.col("n") + 1), lambda p: F.array(F.struct(p.alias("period"), F.col("a").alias("t")), F.struct(p.alias("period"), F.col("b").alias("t")))))).alias("x")).select("series_id", "x.*")
    own = played.select("series_id", "period", F.explode(F.array("radiant_team_id", "dire_team_id")).alias("t"))
    away = played.join(known.select("series_id", "b"), "series_id").where("b <> dire_team_id").select("series_id", "period", F.col("b").alias("t"))
    p = ends.union(own).union(away)
    preds = p.select("series_id", "period", F.concat(F.lit("team  "), F.lpad(F.col("t").cast("string"), 2, "0")).alias("selection"), F.nullif("t", F.lit(0)).alias("team"), F.round(1 / (1 + F.exp(-((k * 7 + F.col("period") * 3 + F.col("t")) % 41 - 20) / 8)), 9).alias("prob"), F.lit(2.0).alias("price_taken"), F.lit(10.0).alias("stake"))
    return m, closing.closing_lines(snaps, bounds), preds


SERIES = TRADES + """, pl AS (SELECT m.*, close, row_number() OVER (PARTITION BY series_id ORDER BY start_time, match_id) AS period FROM maps m JOIN cl USING (match_id) WHERE series_id > 0),
fs AS (SELECT series_id, a, b, close, series_type FROM pl WHERE period = 1), n AS (SELECT series_id, count(*) AS n FROM pl GROUP BY series_id),
kn AS (SELECT series_id, coalesce(a, series_id % 40) AS a, coalesce(b, 40 + series_id % 40) AS b, coalesce(n, 0) AS n
  FROM (SELECT c_custkey AS series_id FROM customer UNION SELECT o_custkey FROM orders) LEFT JOIN fs USING (series_id) LEFT JOIN n USING (series_id)),
pd AS (SELECT series_id, 0 AS period, a AS t FROM kn UNION ALL SELECT series_id, 0, b FROM kn UNION ALL SELECT series_id, n + 1, a FROM kn UNION ALL SELECT series_id, n + 1, b FROM kn
  UNION ALL SELECT series_id, period, a FROM pl UNION ALL SELECT series_id, period, b FROM pl UNION ALL SELECT pl.series_id, period, kn.b FROM pl JOIN kn USING (series_id) WHERE kn.b <> pl.b),
pr AS (SELECT *, nullif(t, 0) AS team, round(1 / (1 + exp(-((series_id * 7 + period * 3 + t) % 41 - 20) / 8e0)), 9) AS prob FROM pd),
qt AS (SELECT series_id, period, a AS t, close AS c FROM pl UNION ALL SELECT series_id, period, b, 1 - close FROM pl UNION ALL SELECT series_id, 0, a, close FROM fs UNION ALL SELECT series_id, 0, b, 1 - close FROM fs),
sd AS (SELECT series_id, period, a AS team, win AS o FROM pl UNION ALL SELECT series_id, period, b, 1 - win FROM pl), wn AS (SELECT series_id, team, sum(o) AS w FROM sd GROUP BY series_id, team),
js AS (SELECT pr.*, c, o, coalesce(w, 0) AS won, CASE WHEN w IS NULL THEN 0 ELSE n.n - w END AS lost, n.n AS maps, CASE series_type WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS need FROM pr
  LEFT JOIN qt USING (series_id, period, t) LEFT JOIN sd USING (series_id, period, team) LEFT JOIN wn USING (series_id, team) LEFT JOIN n USING (series_id) LEFT JOIN fs USING (series_id)),
oc AS (SELECT *, CAST(CASE WHEN maps IS NULL THEN NULL WHEN period > 0 THEN o WHEN won >= need THEN 1 WHEN lost >= need THEN 0 END AS INTEGER) AS outcome FROM js),
rs AS (SELECT *, CASE WHEN maps IS NULL THEN 'series not in matches' WHEN period = 0 AND need IS NULL THEN 'series format has no winner' WHEN period = 0 AND outcome IS NULL THEN 'series undecided'
  WHEN period > maps THEN 'map not played' WHEN period > 0 AND outcome IS NULL THEN 'map undecided or team not in match' END AS why FROM oc),
sk AS (SELECT *, CASE WHEN team IS NULL THEN 'unresolved selection' WHEN maps IS NULL OR period > maps THEN 'no closing line' WHEN c IS NULL THEN 'selection not quoted' ELSE why END AS skip,
  CASE WHEN team IS NULL THEN 'unresolved' WHEN outcome IS NOT NULL THEN 'settled' WHEN why IN ('series undecided', 'map undecided or team not in match', 'map not played') THEN 'pending' ELSE 'unresolved' END AS status FROM rs)"""


@query(f"""WITH {SERIES} SELECT series_id, CAST(period AS INTEGER) AS period, t AS selected, round(c, 7) AS close_prob, CASE WHEN skip IS NULL THEN round(prob - c, 7) END AS edge, CASE WHEN skip IS NULL THEN round(2 * c - 1, 7) + 0e0 END AS clv,
  CASE WHEN skip IS NULL THEN round((prob - outcome) * (prob - outcome), 7) END AS brier, outcome, skip AS reason FROM sk""")
def clv_series(spark, sf_dir):
    m, found, preds = _series(spark, sf_dir)
    out = closing.clv_report(preds, found, m)
    return out.select("series_id", "period", F.substring("selection", 7, 20).cast("long").alias("selected"), *[_r(c, 7).alias(c) for c in ("close_prob", "edge", "clv", "brier")], "outcome", "reason")


@query(f"""WITH {SERIES} SELECT series_id, CAST(period AS INTEGER) AS period, t AS selected, status, outcome, CASE WHEN status = 'settled' THEN CASE WHEN outcome = 1 THEN 1e1 ELSE -1e1 END END AS pnl,
  CASE WHEN team IS NOT NULL THEN round(2 * c - 1, 7) + 0e0 END AS clv, CASE WHEN team IS NULL THEN 'unresolved selection' WHEN status <> 'settled' THEN why END AS reason FROM sk""")
def settle_series(spark, sf_dir):
    m, found, preds = _series(spark, sf_dir)
    out = closing.settle(preds, found, m)
    return out.select("series_id", "period", F.substring("selection", 7, 20).cast("long").alias("selected"), "status", "outcome", "pnl", _r("clv", 7).alias("clv"), "reason")


@query(f"""WITH {SERIES} SELECT count(*) FILTER (WHERE status = 'settled') AS n_settled, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'unresolved') AS n_unresolved,
  round(1e1 * count(*) FILTER (WHERE status = 'settled'), 4) AS staked, round(sum(CASE WHEN status = 'settled' THEN CASE WHEN outcome = 1 THEN 1e1 ELSE -1e1 END END), 4) AS pnl, round(avg(CASE WHEN team IS NOT NULL THEN 2 * c - 1 END), 7) AS mean_clv FROM sk""")
def settlement_series(spark, sf_dir):
    m, found, preds = _series(spark, sf_dir)
    out = closing.settlement_summary(closing.settle(preds, found, m))
    return out.select("n_settled", "n_pending", "n_unresolved", _r("staked", 4).alias("staked"), _r("pnl", 4).alias("pnl"), _r("mean_clv", 7).alias("mean_clv"))


# --- decayed statistics, ratings, walk-forward ---

HALF_LIFE = 120 * 86400
HEROES = f"""{MAPS}, {PICKS}, h AS (SELECT DISTINCT p.match_id, p.hero, p.side, m.start_time, m.a, m.b, CASE WHEN p.side = 0 THEN win ELSE 1 - win END AS won FROM picks p JOIN maps m USING (match_id) WHERE is_pick = 1),
t0 AS (SELECT min(start_time) AS t0 FROM h), g AS (SELECT h.*, power(2e0, (start_time - t0) / CAST({HALF_LIFE} AS DOUBLE)) AS g FROM h, t0)"""


def _heroes(spark, sf_dir):
    m = maps(spark, sf_dir).select("match_id", "start_time", "a", "b", "win")
    h = picks(spark, sf_dir).where("is_pick = 1").join(m, "match_id")
    h = h.select("match_id", "hero", "side", "start_time", "a", "b", F.when(F.col("side") == 0, F.col("win")).otherwise(1 - F.col("win")).alias("won")).distinct()
    return materialize(h, "heroes")


@query(f"""WITH {HEROES}, d AS (SELECT match_id, hero, side, coalesce(sum(won * g) OVER w, 0) / g AS wins, coalesce(sum(g) OVER w, 0) / g AS total FROM g
  WINDOW w AS (PARTITION BY hero ORDER BY start_time, match_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, hero, side, round(wins, 6) AS wins, round(total, 6) AS total, round((wins + 10) / (total + 20) - 5e-1, 6) AS rate FROM d""")
def decayed_rates(spark, sf_dir):
    h = _heroes(spark, sf_dir)
    d = drafts.decayed(h, ["hero"], "start_time", ["start_time", "match_id", "side"], "won", [HALF_LIFE], drafts.decay_blocks(h, "start_time", [HALF_LIFE])).withColumnsRenamed({"wins_0": "wins", "total_0": "total"})
    return d.select("match_id", "hero", "side", _r("wins", 6).alias("wins"), _r("total", 6).alias("total"), _r(drafts.net(20), 6).alias("rate"))


@query(f"""WITH {HEROES}, pr AS (SELECT x.match_id, x.side, x.start_time, x.won, x.g, x.hero AS low, y.hero AS high FROM g x JOIN g y ON x.match_id = y.match_id AND x.side = y.side AND x.hero < y.hero),
d AS (SELECT match_id, side, low, high, coalesce(sum(won * g) OVER w, 0) / g AS wins, coalesce(sum(g) OVER w, 0) / g AS total FROM pr
  WINDOW w AS (PARTITION BY low, high ORDER BY start_time, match_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, side, low, high, round((wins + 50) / (total + 100) - 5e-1, 6) AS net FROM d""")
def pair_synergy(spark, sf_dir):
    h = _heroes(spark, sf_dir)
    side = h.groupBy("match_id", "side", "start_time", "won").agg(F.array_sort(F.collect_list("hero")).alias("hs"))
    pair = F.flatten(F.transform("hs", lambda x, i: F.transform(F.slice("hs", i + 2, F.size("hs")), lambda y: F.struct(x.alias("low"), y.alias("high")))))
    p = side.select("match_id", "side", "start_time", "won", F.explode(pair).alias("p")).select("match_id", "side", "start_time", "won", "p.*")
    d = drafts.decayed(p, ["low", "high"], "start_time", ["start_time", "match_id", "side"], "won", [HALF_LIFE], drafts.decay_blocks(h, "start_time", [HALF_LIFE])).withColumnsRenamed({"wins_0": "wins", "total_0": "total"})
    return d.select("match_id", "side", "low", "high", _r(drafts.net(100), 6).alias("net"))


@query(f"""WITH {HEROES}, pr AS (SELECT x.match_id, x.start_time, x.g, least(x.hero, y.hero) AS low, greatest(x.hero, y.hero) AS high, x.hero AS ha, CASE WHEN x.hero < y.hero THEN x.won ELSE 1 - x.won END AS low_won
  FROM g x JOIN g y ON x.match_id = y.match_id AND x.side = 0 AND y.side = 1 AND x.hero <> y.hero),
d AS (SELECT match_id, low, high, ha, coalesce(sum(low_won * g) OVER w, 0) / g AS wins, coalesce(sum(g) OVER w, 0) / g AS total FROM pr
  WINDOW w AS (PARTITION BY low, high ORDER BY start_time, match_id, ha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, low, high, ha, round(CASE WHEN ha = low THEN 1 ELSE -1 END * ((wins + 50) / (total + 100) - 5e-1), 6) + 0e0 AS edge FROM d""")
def matchup_edge(spark, sf_dir):
    h = _heroes(spark, sf_dir)
    hs = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("hero", "won"))).alias(f"s{s}")
    both = h.groupBy("match_id", "start_time").agg(hs(0), hs(1))
    pair = F.flatten(F.transform("s0", lambda x: F.transform(F.filter("s1", lambda y: y.hero != x.hero), lambda y: F.struct(F.least(x.hero, y.hero).alias("low"), F.greatest(x.hero, y.hero).alias("high"), x.hero.alias("ha"), F.when(x.hero < y.hero, x.won).otherwise(1 - x.won).alias("low_won")))))
    p = both.select("match_id", "start_time", F.explode(pair).alias("p")).select("match_id", "start_time", "p.*")
    d = drafts.decayed(p, ["low", "high"], "start_time", ["start_time", "match_id", "ha"], "low_won", [HALF_LIFE], drafts.decay_blocks(h, "start_time", [HALF_LIFE])).withColumnsRenamed({"wins_0": "wins", "total_0": "total"})
    return d.select("match_id", "low", "high", "ha", (_r(F.when(F.col("ha") == F.col("low"), 1).otherwise(-1) * drafts.net(100), 6) + 0.0).alias("edge"))


GLICKO = MAPS + """, st AS (SELECT match_id, ((match_id % 31) - 15) / 10e0 AS ma, 3e-1 + (match_id % 17) / 10e0 AS pa, ((match_id % 29) - 14) / 10e0 AS mb, 3e-1 + (match_id % 13) / 10e0 AS pb, 6e-2 AS s FROM maps),
q AS (SELECT *, 1 / sqrt(1 + 3 * pb * pb / (pi() * pi())) AS g, 1 / sqrt(1 + 3 * (pa * pa + pb * pb) / (pi() * pi())) AS gp FROM st),
e AS (SELECT *, 1 / (1 + exp(-g * (ma - mb))) AS e FROM q), v AS (SELECT *, 1 / (g * g * e * (1 - e)) AS v FROM e),
n AS (SELECT *, 1 / sqrt(1 / (pa * pa + s * s) + 1 / v) AS p1 FROM v)"""


@query(f"WITH {GLICKO} SELECT match_id, round(p1, 9) AS phi, round(ma + p1 * p1 * g * (1 - e), 9) AS mu, round(1 / (1 + exp(-gp * (ma - mb))), 9) AS prob FROM n")
def glicko_one_period(spark, sf_dir):
    k = F.col("match_id")
    x = maps(spark, sf_dir).select("match_id", (((k % 31) - 15) / 10).alias("ma"), (0.3 + (k % 17) / 10).alias("pa"), (((k % 29) - 14) / 10).alias("mb"), (0.3 + (k % 13) / 10).alias("pb"))
    ma, pa, mb, pb = map(F.col, ("ma", "pa", "mb", "pb"))
    g, e = fn.glicko_g(pb), fn.glicko_expected(ma, mb, pb)
    phi = 1 / F.sqrt(1 / (pa * pa + 0.06 * 0.06) + g * g * e * (1 - e))
    return x.select("match_id", _r(phi).alias("phi"), _r(ma + phi * phi * g * (1 - e)).alias("mu"), _r(fn.map_win_prob(ma, pa, mb, pb)).alias("prob"))


@query()
def glicko_replay(spark, sf_dir):
    return ratings.replay(maps(spark, sf_dir), {0: ratings.RatingConfig()}).drop("lineup")


def _with_patch_and_lineups(spark, sf_dir):
    """maps with their patch as of the start, and lineups of five: each team's regulars, of negative ids, for whom the
    accounts of the side's picks stand in, by account % 5."""
    m = maps(spark, sf_dir)
    patch = links.patch_of(m.select("match_id", "start_time", F.lit(None).cast("int").alias("patch")), spark.createDataFrame(TIMELINE, "released_at long, patch_id int"), "start_time")
    place = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("account") % 5 == k), F.col("account"))).alias(f"p{side}{k}")
    sides = picks(spark, sf_dir).groupBy("match_id").agg(*[place(s, k) for s in (0, 1) for k in range(5)])
    five = lambda s, team: F.array_sort(F.array(*[F.coalesce(F.col(f"p{s}{k}").cast("long"), -(F.col(team) * 5 + k + 1)) for k in range(5)]))
    out = m.join(patch.select("match_id", "patch"), "match_id").join(sides, "match_id", "left")
    return out.select(*m.columns, "patch", five(0, "a").alias("lineup_a"), five(1, "b").alias("lineup_b"))


@query()
def frozen_series_prob(spark, sf_dir):
    config = ratings.RatingConfig(roster_rd_boost=30.0)
    m = materialize(_with_patch_and_lineups(spark, sf_dir), "patched-maps")
    # read several times by the joins below, each of which would fold all maps again
    history = materialize(ratings.replay(m, {0: config}), "history")
    first = rollups.first_in(m, ["series_id"], ["start_time", "match_id"], ["a", "b", "start_time", "series_type", "patch", "lineup_a", "lineup_b"]).withColumnRenamed("start_time", "when")
    n = m.groupBy("series_id").agg(F.count("*").alias("n_maps"))
    team = lambda c: F.concat(F.lit("Team "), F.col(c).cast("string"))
    p = ratings.frozen(history, first, config).join(n, "series_id").withColumns({"name_a": team("a"), "name_b": team("b")})
    return ratings.event_predictions(p)


@query()
def walk_forward(spark, sf_dir):
    return walkforward.walk_forward(maps(spark, sf_dir), {0: ratings.RatingConfig()}, min_games=20)


@query()
def tune_grid(spark, sf_dir):
    configs = walkforward.rating_grid()
    named = spark.createDataFrame([(k, c.tau, c.idle_period_s, c.patch_rd_boost, c.roster_rd_boost) for k, c in configs.items()], "config_id int, tau double, idle_period_s double, patch_rd_boost double, roster_rd_boost double")
    return walkforward.walk_forward(_with_patch_and_lineups(spark, sf_dir), configs, min_games=20).join(named, "config_id")


def _drafts(spark, sf_dir):
    """A full draft of every map: heroes by arithmetic."""
    k = F.col("match_id")
    side = lambda s: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((k * 7 + i * 11 + s * 61) % 127).cast("int"))
    return maps(spark, sf_dir).select("match_id", side(0).alias("heroes_a"), side(1).alias("heroes_b"), (k % 2 == 0).alias("first_a")).where("size(array_distinct(concat(heroes_a, heroes_b))) = 10")


FEATURES = f"""WITH {MAPS}, g AS (SELECT *, power(2e0, (start_time - (SELECT min(start_time) FROM maps)) / CAST({HALF_LIFE} AS DOUBLE)) AS g FROM maps),
h AS (SELECT match_id, start_time, g, s, CASE WHEN s = 0 THEN a ELSE b END AS team, CASE WHEN s = 0 THEN win ELSE 1 - win END AS won, (match_id * 7 + i * 11 + s * 61) % 127 AS hero FROM g, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest([0, 1]) AS s)),
r AS (SELECT *, (coalesce(sum(won * g) OVER w, 0) / g + 10) / (coalesce(sum(g) OVER w, 0) / g + 20) - 5e-1 AS rate, (coalesce(sum(won * g) OVER t, 0) / g + 5) / (coalesce(sum(g) OVER t, 0) / g + 10) - 5e-1 AS trate FROM h
  WINDOW w AS (PARTITION BY hero ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY team, hero ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hd AS (SELECT match_id, sum(CASE s WHEN 0 THEN rate ELSE -rate END) AS hero_diff, sum(CASE s WHEN 0 THEN trate ELSE -trate END) AS team_hero_diff FROM r GROUP BY match_id),
pr AS (SELECT x.match_id, x.start_time, x.g, x.s, x.won, x.hero AS lo, y.hero AS hi, (x.rate + y.rate) / 2 AS base FROM r x JOIN r y ON x.match_id = y.match_id AND x.s = y.s AND x.hero < y.hero),
cr AS (SELECT x.match_id, x.start_time, x.g, CASE WHEN x.hero < y.hero THEN 1 ELSE -1 END AS sg, CASE WHEN x.hero < y.hero THEN x.won ELSE 1 - x.won END AS won, least(x.hero, y.hero) AS lo, greatest(x.hero, y.hero) AS hi,
  CASE WHEN x.hero < y.hero THEN x.rate - y.rate ELSE y.rate - x.rate END AS base FROM r x JOIN r y ON x.match_id = y.match_id AND x.s = 0 AND y.s = 1),
pw AS (SELECT match_id, CASE s WHEN 0 THEN 1 ELSE -1 END AS sg, base, coalesce(sum(won * g) OVER w, 0) / g AS wins, coalesce(sum(g) OVER w, 0) / g AS total FROM pr WINDOW w AS (PARTITION BY lo, hi ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cw AS (SELECT match_id, sg, base, coalesce(sum(won * g) OVER w, 0) / g AS wins, coalesce(sum(g) OVER w, 0) / g AS total FROM cr WINDOW w AS (PARTITION BY lo, hi ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sy AS (SELECT match_id, sum(sg * ((wins + 50) / (total + 100) - 5e-1 - total / (total + 100) * base)) AS synergy_diff FROM pw GROUP BY match_id),
co AS (SELECT match_id, sum(sg * ((wins + 50) / (total + 100) - 5e-1 - total / (total + 100) * base)) AS counter_sum FROM cw GROUP BY match_id),
gm AS (SELECT match_id, min(n) AS n FROM (SELECT match_id, count(*) OVER (PARTITION BY team ORDER BY start_time, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM (SELECT match_id, start_time, a AS team FROM maps UNION ALL SELECT match_id, start_time, b FROM maps)) GROUP BY match_id)"""


@query(FEATURES + """ SELECT match_id, round(hero_diff, 6) + 0e0 AS hero_diff, round(team_hero_diff, 6) + 0e0 AS team_hero_diff, round(synergy_diff, 6) + 0e0 AS synergy_diff, round(counter_sum, 6) + 0e0 AS counter_sum,
  CASE WHEN match_id % 2 = 0 THEN 1e0 ELSE -1e0 END AS first_action, CASE WHEN n >= 5 THEN 1e0 ELSE 0e0 END AS both_warm FROM hd JOIN sy USING (match_id) JOIN co USING (match_id) JOIN gm USING (match_id)""")
def draft_features(spark, sf_dir):
    out = drafts.draft_features(rollups.running_games(maps(spark, sf_dir), ["start_time", "match_id"]), _drafts(spark, sf_dir))
    return out.select("match_id", *[(_r(c, 6) + 0.0).alias(c) for c in ("hero_diff", "team_hero_diff", "synergy_diff", "counter_sum")], "first_action", "both_warm")


@query()
def draft_walk_forward(spark, sf_dir):
    """The tuner's whole grid; maps of which lineitem has no line have no draft, and fall back to the ratings."""
    recorded = _drafts(spark, sf_dir).join(picks(spark, sf_dir), "match_id", "left_semi")
    return walkforward.walk_forward_draft(maps(spark, sf_dir), recorded, walkforward.draft_grid(), min_games=20)
