"""Sources that fetch: paced JSON over HTTP as Python data sources, for spark.read and spark.readStream.

keyset_json   rows of a list that is read backward page by page; as a stream its offset is the newest id
polled_json   one poll of one or more endpoints: all of them under one capture stamp, or an error and no poll
sql_json      rows of a remote SQL endpoint
"""

from __future__ import annotations

import email.utils
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import pages, with_retries


class RemoteError(RuntimeError):
    """The remote answered with an error inside a payload."""


def retry_after(e: Exception) -> float | None:
    """Seconds that a 429 asks to wait (a number or a date), 0 if it doesn't say; None for what isn't tried again."""
    if not isinstance(e, urllib.error.HTTPError) or e.code != 429:
        return None
    asked = (e.headers.get("Retry-After") or "").strip()
    if asked.isdigit():
        return float(asked)
    try:
        return max(0.0, email.utils.parsedate_to_datetime(asked).timestamp() - time.time())
    except ValueError:
        return 0.0


class Client:
    """GET of JSON, no two requests within `delay` seconds.

    A 429 is tried again, 7 times in all, after 5 2^n seconds, at most 300, and not before what it asks for. `given` are
    parameters of every request. With lanes, this is one of so many clients that share one rate: each takes its share.
    """

    def __init__(self, url: str, delay: float = 1.2, lanes: int = 1, given: dict | None = None, headers: dict | None = None, timeout: float = 30.0, attempts: int = 7, first_wait: float = 5.0, most_wait: float = 300.0):
        self.url, self.delay, self.given, self.headers, self.timeout = url.rstrip("/"), delay * lanes, given or {}, headers or {}, timeout
        self.attempts, self.first_wait, self.most_wait, self.last = attempts, first_wait, most_wait, -math.inf

    def get(self, path: str, **parameters):
        """The parsed answer to one request, paced and tried again; any other error than 429 is raised."""
        query = urllib.parse.urlencode({**self.given, **{k: v for k, v in parameters.items() if v is not None}})
        request = urllib.request.Request(f"{self.url}{path}{'&' if '?' in path else '?'}{query}".rstrip("?&"), headers=self.headers)

        def once():
            time.sleep(max(0.0, self.last + self.delay - time.monotonic()))
            self.last = time.monotonic()
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)

        return with_retries(once, self.attempts, self.first_wait, self.most_wait, wait_of=retry_after, again=lambda e: retry_after(e) is not None)

    def sql(self, path: str, statement: str) -> list[dict]:
        """Rows of a remote SQL endpoint: the list itself or what stands under rows; an error payload is an error."""
        data = self.get(path, sql=statement)
        if isinstance(data, dict) and data.get("err"):
            raise RemoteError(str(data["err"]))
        return data if isinstance(data, list) else data.get("rows", []) if isinstance(data, dict) else []


def _client(options: dict, lanes: int = 1) -> Client:
    number = lambda key, default: float(options.get(key, default))
    return Client(
        options["url"], number("delay", 1.2), lanes, json.loads(options.get("given", "{}")), json.loads(options.get("headers", "{}")), number("timeout", 30),
        int(options.get("attempts", 7)), number("first_wait", 5), number("most_wait", 300),
    )


class Span(InputPartition):
    """Ids over low up to high (None: no bound)."""

    def __init__(self, low: int | None, high: int | None, lanes: int):
        self.low, self.high, self.lanes = low, high, lanes


class _Keyset:
    """Reads spans of ids backward. A bounded span is dealt to lanes, which share the rate; an unbounded one is one lane,
    as each page's cursor comes from the page before."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.path, self.cursor, self.key = options.get("pages_at", ""), options.get("cursor", "less_than_match_id"), options.get("key", "match_id")
        whole = lambda name: int(options[name]) if options.get(name) else None
        self.before, self.since, self.most, self.lanes = whole("before"), whole("since"), whole("most"), int(options.get("lanes", 1))

    def spans(self, low: int | None, high: int | None) -> list[Span]:
        if low is None or high is None or self.most is not None:
            return [Span(low, high, 1)]
        cuts = [low + (high - low) * k // self.lanes for k in range(self.lanes + 1)]
        return [Span(a, b, self.lanes) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, span: Span) -> Iterator[tuple]:
        client = _client(self.options, span.lanes)
        fetch = lambda before: client.get(self.path, **{self.cursor: before})
        first = None if span.high is None else span.high + 1
        for row in pages(fetch, math.inf if self.most is None else self.most, first, self.key):
            if span.low is not None and row[self.key] <= span.low:
                return
            yield row[self.key], json.dumps(row)


class KeysetReader(_Keyset, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans(self.since, None if self.before is None else self.before - 1)


class KeysetStream(_Keyset, DataSourceStreamReader):
    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start["id"], end["id"])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.since or 0}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = _client(self.options).get(self.path)
        return {"id": max((row[self.key] for row in newest), default=self.since or 0)}

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch: the list itself can be read again."""


class KeysetSource(DataSource):
    """(id, body): rows of a list of JSON objects with ids, newest first, whose pages start below a cursor parameter.

    Options: url, pages_at (the path), cursor, key; since (ids over it), before (ids under it), most rows, lanes; delay, given and headers
    (JSON), timeout, attempts, first_wait, most_wait. As a stream, the offset is the newest id; a batch holds the ids
    between two offsets, so that a restart from a checkpoint neither loses nor repeats one.
    """

    @classmethod
    def name(cls) -> str:
        return "keyset_json"

    def schema(self) -> str:
        return "id long, body string"

    def reader(self, schema) -> KeysetReader:
        return KeysetReader(self.options)

    def streamReader(self, schema) -> KeysetStream:  # noqa: N802
        return KeysetStream(self.options)


class PollReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, _partition) -> Iterator[tuple]:
        client, at = _client(self.options), int(time.time())
        paths, absent = json.loads(self.options["paths"]), self.options.get("absent")

        def body(path):
            try:
                return client.get(path)
            except urllib.error.HTTPError as e:
                if e.code == 404 and absent is not None:
                    return json.loads(absent)
                raise

        got = {name: body(path) for name, path in paths.items()}
        yield self.options["source"], at, json.dumps(got if len(got) != 1 or "" not in got else got[""])


class PolledSource(DataSource):
    """(source, captured_at, payload): one poll. Options: url, source, paths (JSON: name to path; the payload is an object
    of these names, or what a single path named "" gives), absent (JSON that stands for a 404) and those of Client.

    All paths are asked in one task under one stamp; if one fails the read fails, so that half a poll is no poll.
    """

    @classmethod
    def name(cls) -> str:
        return "polled_json"

    def schema(self) -> str:
        return "source string, captured_at long, payload string"

    def reader(self, schema) -> PollReader:
        return PollReader(self.options)


class SqlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, _partition) -> Iterator[tuple]:
        for row in _client(self.options).sql(self.options.get("sql_at", ""), self.options["sql"]):
            yield (json.dumps(row),)


class SqlSource(DataSource):
    """(body): rows, as JSON, that a remote SQL endpoint gives for one statement; an error in its answer is an error here.
    Options: url, sql_at (its path), sql and those of Client."""

    @classmethod
    def name(cls) -> str:
        return "sql_json"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema) -> SqlReader:
        return SqlReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (KeysetSource, PolledSource, SqlSource):
        spark.dataSource.register(source)


def fetch_each(ids: DataFrame, path: str, lanes: int = 4, **options) -> DataFrame:
    """(id, body) of each id of a one-column DataFrame: path has {id} in the id's place. Lanes share the rate; ids that
    the remote doesn't know (404) drop out."""
    options = {k: str(v) for k, v in options.items()}

    def run(frames):
        client = _client(options, lanes)
        for frame in frames:
            got = []
            for one in frame["id"]:
                try:
                    got.append((one, json.dumps(client.get(path.format(id=one)))))
                except urllib.error.HTTPError as e:
                    if e.code != 404:
                        raise
            if got:
                yield frame.iloc[:0].reindex(range(len(got))).assign(id=[x for x, _ in got], body=[x for _, x in got])

    named = ids.toDF("id").select(F.col("id").cast("long").alias("id"))
    return named.repartition(lanes).mapInPandas(run, "id long, body string")
