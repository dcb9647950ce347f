import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.test_http import Remote
from tidemark.schemas import TABLES, TRACKED
from tidemark.sources import polls, readers
from tidemark.streaming.recorder import Recorder
from tidemark.streaming.supervisor import Supervisor

LINE, CLEARED = ["source", "line_key"], ["price_american", "price_decimal", "limit_amount"]


class Books(Remote):
    """A book whose price, liveness and halves a test sets, and an aggregator."""

    def __init__(self):
        super().__init__()
        self.price, self.live, self.books = 150, False, ["x", "y"]

    def answer(self, path, query):
        if path in self.broken:
            return 500, {}, {}
        if path == "/matchups":
            return 200, [{"id": 7, "isLive": self.live, "league": {"name": "Cup"}, "participants": [{"alignment": "home", "name": "A", "order": 0}, {"alignment": "away", "name": "B", "order": 1}]}], {}
        if path == "/markets":
            price = lambda d, p: {"designation": d, "price": p}
            return 200, [{"matchupId": 7, "period": 0, "type": "moneyline", "status": "open", "key": "m", "prices": [price("home", self.price), price("away", -170)]}], {}
        if path == "/sports/s/odds" and query.get("apiKey") == "k":
            outcomes = [{"name": "A", "price": 1.5}, {"name": "B", "price": 2.5}]
            return 200, [{"id": "e", "bookmakers": [{"key": b, "markets": [{"key": "h2h", "outcomes": outcomes}]} for b in self.books]}], {}
        if path == "/sports":
            return 200, [{"key": "s"}, {"key": "t"}], {}
        return 404, {}, {}


@pytest.fixture
def remote():
    out = Books()
    yield out
    out.server.shutdown()


@pytest.fixture
def recorder(spark, tmp_path):
    held = {"all": spark.createDataFrame([], TABLES["odds_snapshots"])}

    def put(df):
        held["all"] = spark.createDataFrame([*held["all"].collect(), *df.collect()], TABLES["odds_snapshots"])

    out = Recorder(lambda: held["all"], put, LINE, TRACKED, CLEARED, ["captured_at", "id"])
    out.held = held
    return out


def built(spark, remote, names=("two_endpoint", "many_books"), **more):
    settings = {"two_endpoint": {"url": remote.url, "delay": 0}, "many_books": {"url": remote.url, "key": "k", "sport": "s", "delay": 0}}
    return polls.registry(spark, {k: {**v, **more} for k, v in settings.items()}).build(names)


def test_registry(spark, remote):
    assert set(built(spark, remote)) == {"two_endpoint", "many_books"}
    assert polls.registry(spark, {"many_books": {"url": remote.url}}).build(["two_endpoint", "many_books"]) == {}
    with pytest.raises(ValueError, match="nobody"):
        built(spark, remote, ["nobody"])
    assert [r.key for r in polls.available_sports(spark, remote.url, "k", delay=0).collect()] == ["s", "t"]


def test_polls_tombstones_and_isolation(spark, remote, recorder, tmp_path):
    now = [1000.0]
    root = f"file://{tmp_path}/archive"
    watch = Supervisor(spark, built(spark, remote), recorder, root, clock=lambda: now[0])
    stamp = iter(range(100, 200))
    for s in watch.sources.values():
        poll = s.poll
        object.__setattr__(s, "poll", lambda poll=poll: poll().withColumn("captured_at", F.lit(next(stamp)).cast("long")))
    first = watch.once()
    assert {n: (r["written"], r["gone"]) for n, r in first.items()} == {"two_endpoint": (2, 0), "many_books": (4, 0)} and watch.due["two_endpoint"] == 1060
    remote.broken, remote.books, remote.live = {"/markets"}, ["x"], True
    second = watch.once()
    assert second["two_endpoint"] is None and (second["many_books"]["written"], second["many_books"]["gone"]) == (0, 2)
    remote.broken, remote.price = set(), 160
    third = watch.once()
    assert (third["two_endpoint"]["written"], third["two_endpoint"]["live"]) == (2, True) and watch.due["two_endpoint"] == 1020
    remote.books = []
    assert watch.once()["many_books"]["gone"] == 2
    rows = recorder.held["all"].collect()
    assert sorted({r.source for r in rows}) == ["many_books:x", "many_books:y", "two_endpoint"] and sum(r.status == "gone" for r in rows) == 4
    kept = spark.read.option("basePath", root).text(root)
    assert {(r.source, r["count"]) for r in kept.groupBy("source").count().collect()} == {("two_endpoint", 2), ("many_books", 3)}
    again = watch.sources["two_endpoint"].quotes(kept.where("source = 'two_endpoint'").select("source", F.col("captured_at").cast("long").alias("captured_at"), F.col("value").alias("payload")))
    assert again.count() == 4 and {r.price_american for r in again.collect()} == {150, 160, -170}


def test_archive_heartbeat_goes_on_after_a_restart(spark, remote, recorder, tmp_path):
    root = f"file://{tmp_path}/archive"
    source = built(spark, remote, ["two_endpoint"])["two_endpoint"]

    def archived(at):
        fixed = polls.Source(source.name, lambda: source.poll().withColumn("captured_at", F.lit(at).cast("long")), source.quotes)
        Supervisor(spark, {"b": fixed}, recorder, root).poll("b")
        return spark.read.text(root).count()

    assert [archived(t) for t in (10_000, 10_060, 13_599, 13_600, 13_660)] == [1, 1, 1, 2, 2]


def test_queries_run_until_they_are_stopped(spark, remote, recorder, tmp_path):
    sources = built(spark, remote)
    broken = polls.Source("broken", lambda: readers.json_documents(spark, f"{tmp_path}/none", "captured_at long"), lambda p: p)
    watch = Supervisor(spark, {**sources, "broken": broken}, recorder, idle_s=1, live_s=1)
    fails, store = [1], recorder.poll

    def poll(*a, **k):
        if fails and a[0] == "two_endpoint":
            raise RuntimeError(fails.pop())
        return store(*a, **k)

    recorder.poll = poll
    at_work = threading.Thread(target=watch.run, args=(f"{tmp_path}/checkpoint", 0.2))
    at_work.start()
    until = time.time() + 180
    while time.time() < until and not all(watch.reports[n] for n in sources):
        time.sleep(0.5)
    watch.stop()
    at_work.join(60)
    assert not at_work.is_alive() and all(watch.reports[n] for n in sources) and not watch.reports["broken"] and not fails
    assert not [q for q in spark.streams.active if (q.name or "").startswith("recorder-")]
    assert json.loads(json.dumps(watch.reports["two_endpoint"][0]))["written"] == 2
