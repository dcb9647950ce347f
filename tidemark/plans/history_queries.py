"""Queries on line histories: changes, tombstones, spans, closing lines, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.market import devig_proportional, shin_two_way
from ..operators import history, links, rollups, spans
from ..operators.links import last_before
from . import views
from .views import LINES, lines

QUERIES, ORACLES = {}, {}
KEY, ORDER = ["line_key"], ["t", "seq"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CHANGES = f"""WITH {LINES}, lagged AS (
  SELECT *, lag(status) OVER w AS ps, lag(seq) OVER w AS pq FROM lines WINDOW w AS (PARTITION BY line_key ORDER BY t, seq))
SELECT seq, line_key, t, status FROM lagged WHERE pq IS NULL OR status IS DISTINCT FROM ps"""


@query(CHANGES)
def line_changes(spark, sf_dir):
    return history.changes(lines(spark, sf_dir).select("seq", "line_key", "t", "status"), KEY, ORDER, ["status"])


@query(f"""WITH {LINES} SELECT seq, line_key, t, status, price FROM (
  SELECT *, row_number() OVER (PARTITION BY line_key ORDER BY t DESC, seq DESC) AS k FROM lines) WHERE k = 1""")
def latest_state(spark, sf_dir):
    return history.latest(lines(spark, sf_dir).select("seq", "line_key", "t", "status", "price"), KEY, ORDER)


@query(f"""WITH {LINES} SELECT seq, line_key, t, status, price FROM (
  SELECT *, row_number() OVER (PARTITION BY line_key ORDER BY t DESC, seq DESC) AS k FROM lines) WHERE k = 1 AND status IS DISTINCT FROM 'gone'""")
def open_lines(spark, sf_dir):
    return history.open_lines(lines(spark, sf_dir).select("seq", "line_key", "t", "status", "price"), KEY, ORDER)


POLL_US = 6 * 3600 * 1_000_000
RECORDED = f"""WITH {LINES}, polled AS (
  SELECT 's' || (line_key % 3) AS source, line_key, t // {POLL_US} AS captured_at, status, price, seq FROM lines),
quotes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, line_key, captured_at ORDER BY seq DESC) AS k FROM polled) WHERE k = 1),
polls AS (SELECT source, captured_at, row_number() OVER (PARTITION BY source ORDER BY captured_at) AS pi FROM (SELECT DISTINCT source, captured_at FROM polled)),
seen AS (
  SELECT q.*, p.pi, lag(pi) OVER w AS pp, lead(pi) OVER w AS nx, lag(status) OVER w AS ps, lag(price) OVER w AS pr
  FROM quotes q JOIN polls p USING (source, captured_at) WINDOW w AS (PARTITION BY source, line_key ORDER BY pi)),
written AS (
  SELECT source, line_key, captured_at, status, price, seq FROM seen WHERE pp IS NULL OR pi > pp + 1 OR status IS DISTINCT FROM ps OR price IS DISTINCT FROM pr),
gone AS (
  SELECT s.source, s.line_key, p.captured_at, 'gone' AS status, NULL::DOUBLE AS price, s.seq
  FROM seen s JOIN polls p ON p.source = s.source AND p.pi = s.pi + 1 WHERE s.nx IS NULL OR s.nx > s.pi + 1)
"""


def _recorded(spark, sf_dir):
    x = lines(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("line_key") % 3).cast("string")).alias("source"), "line_key", F.expr(f"t div {POLL_US}").alias("captured_at"), "status", "price", "seq")
    return history.history(x, x.select("source", "captured_at"), order=["captured_at", "seq"])


@query(RECORDED + "SELECT * FROM written UNION ALL SELECT * FROM gone")
def recorded_history(spark, sf_dir):
    return _recorded(spark, sf_dir)


@query(RECORDED + "SELECT source, line_key, captured_at FROM gone")
def tombstones(spark, sf_dir):
    return _recorded(spark, sf_dir).where("status = 'gone' AND price IS NULL").select("source", "line_key", "captured_at")


SPANS = f"""WITH {LINES}, o AS (SELECT *, status = 'open' AS o FROM lines),
w0 AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY line_key ORDER BY t, seq), false) AS po FROM o),
flips AS (SELECT * FROM w0 WHERE o <> po),
ended AS (SELECT line_key, t AS s, lead(t) OVER (PARTITION BY line_key ORDER BY t, seq) AS e, o FROM flips),
top AS (SELECT max(t) AS until FROM lines),
spans AS (SELECT line_key, s AS "start", coalesce(e, CASE WHEN until > s THEN until END) AS "end" FROM ended, top WHERE o AND coalesce(e, CASE WHEN until > s THEN until END) IS NOT NULL)"""
MERGED = """, mp AS (SELECT *, max("end") OVER (PARTITION BY line_key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top0 FROM spans WHERE "end" > "start"),
mi AS (SELECT *, sum(CASE WHEN top0 IS NULL OR "start" > top0 THEN 1 ELSE 0 END) OVER (PARTITION BY line_key ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM mp),
merged AS (SELECT line_key, min("start") AS "start", max("end") AS "end" FROM mi GROUP BY line_key, k)"""
#: Windows of a line: from its first row to 1.5 times the time to its last.
WINDOWS = """, windows AS (SELECT line_key, min(t) AS lo, max(t) + (max(t) - min(t)) // 2 AS hi FROM lines GROUP BY line_key)"""


def _spans(spark, sf_dir):
    x = lines(spark, sf_dir)
    top = x.agg(F.max("t").alias("until"))
    return spans.open_spans(x.join(F.broadcast(top)), [*KEY, "until"], ORDER, "t", F.col("until")).drop("until")  # one row


def _windows(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("line_key").agg(F.min("t").alias("lo"), F.expr("max(t) + (max(t) - min(t)) div 2").alias("hi"))


@query(SPANS + ' SELECT line_key, "start", "end" FROM spans')
def open_intervals(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(SPANS + MERGED + ' SELECT line_key, "start", "end" FROM merged')
def merged_intervals(spark, sf_dir):
    return spans.merge_spans(_spans(spark, sf_dir), KEY)


@query(SPANS + """, st AS (SELECT line_key, "start" - 3600000000 AS "start", "end" + 3600000000 AS "end" FROM spans)""" + MERGED.replace("FROM spans", "FROM st") + ' SELECT line_key, "start", "end" FROM merged')
def merged_overlapping(spark, sf_dir):
    wide = _spans(spark, sf_dir).select("line_key", (F.col("start") - 3_600_000_000).alias("start"), (F.col("end") + 3_600_000_000).alias("end"))
    return spans.merge_spans(wide, KEY)


COVER = SPANS + MERGED + WINDOWS + """, cover AS (
  SELECT w.line_key, w.lo, w.hi, CAST(coalesce(sum(CASE WHEN m."start" IS NOT NULL THEN greatest(least(m."end", w.hi) - greatest(m."start", w.lo), 0) END), 0) AS BIGINT) AS overlap
  FROM windows w LEFT JOIN merged m ON m.line_key = w.line_key GROUP BY w.line_key, w.lo, w.hi)"""


@query(COVER + " SELECT line_key, overlap FROM cover")
def overlap_seconds(spark, sf_dir):
    return spans.coverage(_spans(spark, sf_dir), _windows(spark, sf_dir), KEY).select("line_key", "overlap")


@query(COVER + " SELECT line_key, lo, hi, round(CASE WHEN hi > lo THEN overlap / (hi - lo) END, 9) AS coverage FROM cover")
def coverage_per_line(spark, sf_dir):
    return spans.coverage(_spans(spark, sf_dir), _windows(spark, sf_dir), KEY).select("line_key", "lo", "hi", F.round("coverage", 9).alias("coverage"))


@query(SPANS + MERGED + WINDOWS + """, clip AS (
  SELECT w.line_key, w.lo, w.hi, greatest(m."start", w.lo) AS s, least(m."end", w.hi) AS e FROM windows w JOIN merged m ON m.line_key = w.line_key),
edge AS (SELECT * FROM clip WHERE e > s UNION ALL SELECT line_key, lo, hi, hi, hi FROM windows),
g AS (SELECT line_key, coalesce(lag(e) OVER (PARTITION BY line_key ORDER BY s, e), lo) AS "start", s AS "end" FROM edge)
SELECT * FROM g WHERE "end" > "start" """)
def gap_intervals(spark, sf_dir):
    return spans.gaps(_spans(spark, sf_dir), _windows(spark, sf_dir), KEY)


#: Two periods of each line: the thirds of its time before its last row.
PERIODS = """, ends AS (SELECT line_key, min(t) AS t0, max(t) AS t1 FROM lines GROUP BY line_key),
periods AS (SELECT line_key, p AS period, t0 + (t1 - t0) // 3 * (p - 1) AS lo, t0 + (t1 - t0) // 3 * p AS hi FROM ends, (VALUES (1), (2)) v(p))"""


def _report(spark, sf_dir, limits=None):
    """limits: seq and lim of each row; without them limits are null."""
    x = lines(spark, sf_dir)
    x = x.withColumn("lim", F.lit(None).cast("double")) if limits is None else x.join(limits, "seq")
    ends = x.groupBy("line_key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    third = F.expr("(t1 - t0) div 3")
    periods = ends.select("line_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("period"), "t0", "t1").select("line_key", "period", (F.col("t0") + third * (F.col("period") - 1)).alias("lo"), (F.col("t0") + third * F.col("period")).alias("hi"), F.col("t1").alias("until"))
    rows = x.select("line_key", F.col("t").alias("at"), "seq", "status", "price", "lim", F.floor(F.col("price") * 2).cast("long").alias("cutoff"))
    both = rows.join(periods.select("line_key", "period"), "line_key")
    return spans.period_report(both, periods, ["line_key", "period"], draft_s=86_400_000_000)


REPORT = SPANS + MERGED + PERIODS + """, rowsp AS (SELECT p.period, p.lo, p.hi, l.*, CAST(floor(l.price * 2) AS BIGINT) AS cutoff FROM periods p JOIN lines l ON l.line_key = p.line_key WHERE l.t < p.hi),
facts AS (SELECT line_key, period, min(t) AS first_seen, CAST(count(*) AS BIGINT) AS observed, max_by(price, t) AS last_price, max_by(cutoff, t) AS cutoff_at_start FROM rowsp GROUP BY line_key, period),
mv AS (SELECT line_key, period, CAST(count(*) FILTER (WHERE was IS NOT NULL AND was <> cutoff) AS BIGINT) AS moves FROM (
  SELECT *, lag(cutoff) OVER (PARTITION BY line_key, period ORDER BY t, seq) AS was FROM rowsp WHERE t >= lo) GROUP BY line_key, period),
lastspan AS (SELECT line_key, CASE WHEN o AND e IS NULL THEN s END AS s FROM ended WHERE e IS NULL),
own AS (SELECT line_key, s AS "start", coalesce(e, CASE WHEN t1 > s THEN t1 END) AS "end" FROM ended JOIN ends USING (line_key) WHERE o AND coalesce(e, CASE WHEN t1 > s THEN t1 END) > s),
mine AS (SELECT p.line_key, p.period, p.lo, p.hi, m."start" AS s, m."end" AS e FROM periods p LEFT JOIN own m ON m.line_key = p.line_key),
cov AS (SELECT line_key, period, lo, hi, sum(CASE WHEN s IS NOT NULL THEN greatest(least(e, hi) - greatest(s, lo), 0) END) / (hi - lo) AS gap_coverage,
   sum(CASE WHEN s IS NOT NULL THEN greatest(least(e, hi) - greatest(s, greatest(lo, hi - 86400000000)), 0) END) / (hi - greatest(lo, hi - 86400000000)) AS draft_coverage,
   CAST(count(*) FILTER (WHERE e > lo AND e < hi) AS BIGINT) AS pulls, coalesce(bool_or(s <= hi AND hi < e), false) AS open_at_start, max(e) FILTER (WHERE e <= hi) AS last_close
  FROM mine GROUP BY line_key, period, lo, hi)
"""


@query(REPORT + """SELECT c.line_key, c.period, c.lo, c.hi, f.first_seen, coalesce(v.moves, 0) AS cutoff_moves, f.cutoff_at_start, round(coalesce(c.gap_coverage, 0), 9) AS gap_coverage,
  round(coalesce(c.draft_coverage, 0), 9) AS draft_coverage, c.pulls, c.open_at_start, c.last_close, f.last_price, coalesce(f.observed, 0) AS observed
FROM cov c LEFT JOIN facts f USING (line_key, period) LEFT JOIN mv v USING (line_key, period)""")
def period_report(spark, sf_dir):
    out = _report(spark, sf_dir).drop("pulled_s", "last_limit")
    return out.withColumns({c: F.round(c, 9) for c in ("gap_coverage", "draft_coverage")})


@query(REPORT + """, clip AS (SELECT line_key, period, lo, hi, greatest(s, lo) AS s, least(e, hi) AS e FROM mine WHERE s IS NOT NULL),
edge AS (SELECT * FROM clip WHERE e > s UNION ALL SELECT line_key, period, lo, hi, hi, hi FROM periods),
g AS (SELECT line_key, period, lo, coalesce(lag(e) OVER (PARTITION BY line_key, period ORDER BY s, e), lo) AS gs, s AS ge FROM edge),
pulled AS (SELECT line_key, period, CAST(sum(ge - gs) AS BIGINT) AS pulled_s FROM g WHERE ge > gs AND gs > lo GROUP BY line_key, period),
lims AS (SELECT r.line_key, r.period, max_by(CAST(regexp_extract(v.props, '[0-9]+') AS DOUBLE), r.t) AS last_limit FROM rowsp r JOIN events v ON v.event_id = r.seq GROUP BY r.line_key, r.period)
SELECT c.line_key, c.period, c.lo, c.hi, f.first_seen, coalesce(v.moves, 0) AS cutoff_moves, f.cutoff_at_start, round(coalesce(c.gap_coverage, 0), 9) AS gap_coverage,
  round(coalesce(c.draft_coverage, 0), 9) AS draft_coverage, c.pulls, coalesce(p.pulled_s, 0) AS pulled_s, c.open_at_start, c.last_close, f.last_price, m.last_limit, coalesce(f.observed, 0) AS observed
FROM cov c LEFT JOIN facts f USING (line_key, period) LEFT JOIN mv v USING (line_key, period) LEFT JOIN pulled p USING (line_key, period) LEFT JOIN lims m USING (line_key, period)""")
def period_report_whole(spark, sf_dir):
    """All metrics of period_report; a row's limit is the number in its event's props."""
    limits = views.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("lim"))
    return _report(spark, sf_dir, limits).withColumns({c: F.round(c, 9) for c in ("gap_coverage", "draft_coverage")})


@query(REPORT + """, x AS (SELECT c.period, coalesce(c.gap_coverage, 0) AS g, c.open_at_start AS o FROM cov c JOIN facts f USING (line_key, period)),
y AS (SELECT period, CAST(count(*) AS BIGINT) AS n, median(g) AS m, avg(CASE WHEN g >= 9e-1 THEN 1e0 ELSE 0e0 END) AS sg, avg(CASE WHEN o THEN 1e0 ELSE 0e0 END) AS so FROM x GROUP BY period)
SELECT period, n, round(m, 9) AS median_coverage, round(sg, 9) AS share_good, round(so, 9) AS share_open, CASE WHEN sg >= 9e-1 THEN 'yes' WHEN sg >= 5e-1 THEN 'partly' ELSE 'no' END AS verdict FROM y""")
def period_summary(spark, sf_dir):
    out = spans.summarise(_report(spark, sf_dir), ["period"])
    return out.withColumns({c: F.round(c, 9) for c in ("median_coverage", "share_good", "share_open")})




@query(f"""WITH {LINES}, top AS (SELECT max(t) AS u, min(t) AS v FROM lines), bounds AS (
  SELECT o_orderkey AS match_id, o_orderkey % 150 AS line_key, v + (u - v) // 100 * (o_orderkey % 100) AS bound FROM orders, top),
j AS (SELECT b.*, l.status, l.price, l.t, l.seq, row_number() OVER (PARTITION BY b.match_id, l.status ORDER BY l.t DESC, l.seq DESC) AS k
  FROM bounds b JOIN lines l ON l.line_key = b.line_key AND l.t < b.bound WHERE l.status <> 'gone')
SELECT match_id, line_key, bound, status, price, t FROM j WHERE k = 1""")
def closing_line(spark, sf_dir):
    x = lines(spark, sf_dir)
    return last_before(_bounds(spark, sf_dir, x), x.where("status <> 'gone'"), KEY, "bound", "t", ["status"], ORDER, ["price", "t"]).select("match_id", "line_key", "bound", "status", "price", "t")


def _bounds(spark, sf_dir, x):
    top = x.agg(F.max("t").alias("u"), F.min("t").alias("v"))
    k = F.col("o_orderkey")
    return views.read(spark, sf_dir, "orders").join(F.broadcast(top)).select(k.alias("match_id"), (k % 150).alias("line_key"), (F.col("v") + F.expr("(u - v) div 100") * (k % 100)).alias("bound"))  # top is one row


@query(f"""WITH {LINES}, top AS (SELECT max(t) AS u, min(t) AS v FROM lines), bounds AS (
  SELECT o_orderkey AS match_id, o_orderkey % 150 AS line_key, v + (u - v) // 100 * (o_orderkey % 100) AS bound FROM orders, top)
SELECT b.match_id, b.line_key, b.bound, l.price, l.t FROM bounds b ASOF LEFT JOIN lines l ON b.line_key = l.line_key AND b.bound > l.t""")
def closing_asof(spark, sf_dir):
    x = lines(spark, sf_dir)
    return links.merge_asof(_bounds(spark, sf_dir, x), x.select("line_key", "t", "price", F.col("t").alias("at")), KEY, "bound", "at", ["price", "t"])


@query(f"""WITH {LINES} SELECT seq, line_key, last_value(CASE WHEN status = 'open' THEN price END IGNORE NULLS)
  OVER (PARTITION BY line_key ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_before FROM lines""")
def previous_open_price(spark, sf_dir):
    return links.asof_previous(lines(spark, sf_dir), KEY, ORDER, F.when(F.col("status") == "open", F.col("price")), "open_before").select("seq", "line_key", "open_before")


@query(f"""WITH {LINES}, w AS (SELECT line_key, status, lag(status) OVER (PARTITION BY line_key ORDER BY t, seq) AS p FROM lines)
SELECT line_key, CAST(count(*) FILTER (WHERE p IS NOT NULL AND p <> status) AS BIGINT) AS moves FROM w GROUP BY line_key""")
def consecutive_distinct(spark, sf_dir):
    return history.consecutive_distinct(lines(spark, sf_dir), KEY, ORDER, "status")


@query(f"""WITH {LINES}, l2 AS (SELECT line_key, status, price, row_number() OVER (PARTITION BY line_key, status ORDER BY t DESC, seq DESC) AS k FROM lines),
b AS (SELECT line_key, max(price) FILTER (WHERE status = 'open') AS x, max(price) FILTER (WHERE status = 'closed') AS y FROM l2 WHERE k = 1 GROUP BY line_key),
d AS (SELECT line_key, x, y, 1e0 / x AS p, 1e0 / y AS q FROM b WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT line_key, round(p / (p + q), 9) AS prob_open, round(p + q - 1, 9) AS margin,
  round(CASE WHEN p + q > 1 THEN least((p + q - 1) * ((p - q) * (p - q) - (p + q)) / ((p + q) * ((p - q) * (p - q) - 1)), 5e-1) END, 9) AS z FROM d""")
def closing_book(spark, sf_dir):
    """Flagship: the last price of each side of a line as a two-way book, without its margin."""
    x = history.latest(lines(spark, sf_dir).select("line_key", "status", "price", "t", "seq"), ["line_key", "status"], ORDER)
    b = x.groupBy("line_key").agg(F.max(F.when(F.col("status") == "open", F.col("price"))).alias("x"), F.max(F.when(F.col("status") == "closed", F.col("price"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    z, _, _ = shin_two_way(F.col("x"), F.col("y"))
    return b.select("line_key", F.round(F.get(devig_proportional(F.array("x", "y")), 0), 9).alias("prob_open"), F.round(1 / F.col("x") + 1 / F.col("y") - 1, 9).alias("margin"), F.round(z, 9).alias("z"))


@query(CHANGES)
def stream_changes(spark, sf_dir):
    """line_changes as a stream over the files that are there, with keyed state; its result is the batch's."""
    import uuid

    from ..sources.shared import shared_dir
    from ..streaming import recorder

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = lines(spark, sf_dir).select("seq", "line_key", "t", "status")
    rows.write.parquet(f"{root}/in")
    found = recorder.stream_changes(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), KEY, ORDER, ["status"])
    done = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


@query(f"""WITH {LINES}, {views.MAPS} SELECT series_id, count(*) AS n, CAST(sum(duration) AS BIGINT) AS total FROM maps GROUP BY series_id HAVING count(*) >= 10""")
def group_having(spark, sf_dir):
    return views.maps(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("duration").alias("total")).where("n >= 10")


@query(f"""WITH {LINES}, k AS (SELECT line_key, t, seq, price, row_number() OVER (PARTITION BY line_key ORDER BY t, seq) AS r FROM lines) SELECT line_key, t, price FROM k WHERE r = 3""")
def nth_in_line(spark, sf_dir):
    return rollups.nth_in(lines(spark, sf_dir), KEY, ORDER, 3).select("line_key", "t", "price")
