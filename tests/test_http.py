import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark.sources import http


class Remote:
    """A local server: a list of ids in pages, details, two endpoints, SQL; some requests are refused at first."""

    def __init__(self):
        self.ids, self.asked, self.refuse, self.broken = list(range(1, 41)), [], {}, set()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                url = urlparse(self.path)
                query = {k: v[0] for k, v in parse_qs(url.query).items()}
                outer.asked.append((time.monotonic(), url.path, query))
                code, body, headers = outer.answer(url.path, query)
                self.send_response(code)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, path, query):
        if self.refuse.get(path, 0) > 0:
            self.refuse[path] -= 1
            return 429, {}, {"Retry-After": "0"}
        if path in self.broken:
            return 500, {}, {}
        if path == "/list":
            below = int(query.get("less_than_match_id", 10**9))
            return 200, [{"match_id": k, "x": "é"} for k in sorted(self.ids, reverse=True) if k < below][:7], {}
        if path.startswith("/one/"):
            k = int(path.rsplit("/", 1)[1])
            return (200, {"match_id": k}, {}) if k in self.ids else (404, {}, {})
        if path == "/sql":
            return 200, {"err": "bad"} if "bad" in query["sql"] else {"rows": [{"a": 1}]}, {}
        if path in ("/matchups", "/markets", "/sports"):
            return 200, [{"id": 1, "key": path[1:]}], {}
        return 404, {}, {}


@pytest.fixture
def remote(spark):
    http.register(spark)
    out = Remote()
    yield out
    out.server.shutdown()


def listed(spark, remote, **options):
    return spark.read.format("keyset_json").options(url=remote.url, pages_at="/list", delay=0, first_wait=0.01, **options)


def test_pages_bounds_lanes_and_refusals(spark, remote):
    remote.refuse = {"/list": 2}
    rows = listed(spark, remote).load().collect()
    assert [r.id for r in rows] == list(range(40, 0, -1)) and json.loads(rows[0].body) == {"match_id": 40, "x": "é"}
    assert [r.id for r in listed(spark, remote, most=10, before=31).load().collect()] == list(range(30, 20, -1))
    lanes = listed(spark, remote, before=36, since=4, lanes=4).load()
    assert lanes.rdd.getNumPartitions() == 4 and sorted(r.id for r in lanes.collect()) == list(range(5, 36))
    remote.ids = []
    assert listed(spark, remote).load().collect() == []


def test_gives_up_and_doesnt_try_other_errors_again(remote):
    client = http.Client(remote.url, delay=0, attempts=3, first_wait=0.001)
    remote.refuse = {"/list": 3}
    with pytest.raises(http.urllib.error.HTTPError):
        client.get("/list")
    n = len(remote.asked)
    with pytest.raises(http.urllib.error.HTTPError):
        client.get("/nowhere")
    assert n == 3 and len(remote.asked) == 4


def test_pace_and_what_a_refusal_asks_for(remote):
    client = http.Client(remote.url, delay=0.05, lanes=2)
    for _ in range(4):
        client.get("/list")
    times = [t for t, *_ in remote.asked]
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.09
    refusal = lambda value, code=429: http.urllib.error.HTTPError("u", code, "m", {"Retry-After": value}, None)
    assert http.retry_after(refusal("7")) == 7 and http.retry_after(refusal("soon")) == 0 and http.retry_after(refusal("7", 500)) is None
    assert 50 < http.retry_after(refusal(http.email.utils.formatdate(time.time() + 60, usegmt=True))) <= 61
    waits = []
    tries = iter([refusal("11"), refusal("1"), None])

    def call():
        if e := next(tries):
            raise e

    http.with_retries(call, sleep=waits.append, wait_of=http.retry_after)
    assert waits == [11, 10]


def test_stream_restarts_from_its_cursor(spark, remote, tmp_path):
    def run():
        stream = spark.readStream.format("keyset_json").options(url=remote.url, pages_at="/list", delay=0, since=30, lanes=2).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(31, 41))
    remote.ids += [41, 45, 52]
    assert run() == [*range(31, 42), 45, 52]
    assert run() == [*range(31, 42), 45, 52]


def test_each_id_once_and_unknown_ones_drop_out(spark, remote):
    remote.refuse = {"/one/3": 1}
    ids = spark.createDataFrame([(k,) for k in (3, 40, 99)], "match_id long")
    got = http.fetch_each(ids, "/one/{id}", 2, url=remote.url, delay=0, first_wait=0.01).collect()
    assert sorted((r.id, json.loads(r.body)["match_id"]) for r in got) == [(3, 3), (40, 40)]
    assert http.fetch_each(ids.limit(0), "/one/{id}", 2, url=remote.url).collect() == []


def test_sql_error_payload(remote):
    client = http.Client(remote.url, delay=0)
    assert client.sql("/sql", "SELECT 1") == [{"a": 1}]
    with pytest.raises(http.RemoteError, match="bad"):
        client.sql("/sql", "bad")


def test_half_a_poll_is_no_poll(spark, remote):
    read = lambda **o: spark.read.format("polled_json").options(url=remote.url, source="s", delay=0, **o).load().collect()
    both = json.dumps({"matchups": "/matchups", "markets": "/markets"})
    [row] = read(paths=both)
    assert row.source == "s" and abs(row.captured_at - time.time()) < 5 and json.loads(row.payload) == {"matchups": [{"id": 1, "key": "matchups"}], "markets": [{"id": 1, "key": "markets"}]}
    remote.broken = {"/markets"}
    with pytest.raises(Exception, match="500"):
        read(paths=both)
    assert json.loads(read(paths=json.dumps({"": "/gone"}), absent="[]")[0].payload) == []
    with pytest.raises(Exception, match="404"):
        read(paths=json.dumps({"": "/gone"}))
