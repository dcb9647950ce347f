"""Configured quote sources: a poll read as one row with its payload, and the quotes that it holds."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from . import http
from .flatten import BOOKS, MARKETS, MATCHUPS, many_book_quotes, two_endpoint_quotes
from .readers import Sources


@dataclass(frozen=True)
class Source:
    """poll() asks the remote now: one row (source, captured_at, payload), or an error. quotes(polls) gives the rows of any
    number of such polls, also of archived ones, in the columns of odds_snapshots. many: names of its quotes' sources
    only begin with its own."""

    name: str
    poll: Callable[[], DataFrame]
    quotes: Callable[[DataFrame], DataFrame]
    many: bool = False


def _stored(quotes: DataFrame) -> DataFrame:
    have = set(quotes.columns)
    return quotes.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["odds_snapshots"].fields])


def two_endpoint(spark: SparkSession, name: str, url: str | None, matchups: str = "/matchups", markets: str = "/markets", league_filter: str = "", **options) -> Source | None:
    """A book with matchups and straight markets, asked under one stamp; None without a url."""
    if not url:
        return None
    paths = json.dumps({"matchups": matchups, "markets": markets})

    def quotes(polls: DataFrame) -> DataFrame:
        read = polls.select("captured_at", F.from_json("payload", f"matchups array<struct<{_inner(MATCHUPS)}>>, markets array<struct<{_inner(MARKETS)}>>").alias("p"))
        games, lines = (read.select("captured_at", F.explode(f"p.{n}").alias("x")).select("captured_at", "x.*") for n in ("matchups", "markets"))
        return _stored(two_endpoint_quotes(games, lines, name, league_filter, ("captured_at",)))

    http.register(spark)
    return Source(name, lambda: spark.read.format("polled_json").options(url=url, source=name, paths=paths, **options).load(), quotes)


def many_books(spark: SparkSession, name: str, url: str | None, key: str | None, sport: str, regions: str = "eu,uk", markets: str = "h2h", **options) -> Source | None:
    """An aggregator of many books; None without a url and a key. A sport that it doesn't list now (404) is a poll without
    quotes."""
    if not (url and key):
        return None
    path = f"/sports/{sport}/odds"
    given = json.dumps({"apiKey": key, "regions": regions, "markets": markets, "oddsFormat": "decimal"})

    def quotes(polls: DataFrame) -> DataFrame:
        events = polls.select("captured_at", F.explode(F.from_json("payload", f"array<struct<{_inner(BOOKS)}>>")).alias("x")).select("captured_at", "x.*")
        return _stored(many_book_quotes(events, name, ("captured_at",)))

    http.register(spark)
    return Source(name, lambda: spark.read.format("polled_json").options(url=url, source=name, paths=json.dumps({"": path}), absent="[]", given=given, **options).load(), quotes, many=True)


def available_sports(spark: SparkSession, url: str, key: str, **options) -> DataFrame:
    """(key): the sports that an aggregator lists, also those without quotes now."""
    http.register(spark)
    poll = spark.read.format("polled_json").options(url=url, source="sports", paths=json.dumps({"": "/sports?all=true"}), given=json.dumps({"apiKey": key}), **options).load()
    return poll.select(F.explode(F.from_json("payload", "array<struct<`key`: string>>")).alias("x")).select("x.key")


def _inner(schema: str) -> str:
    """A table schema as the inside of a struct."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1].replace("key:", "`key`:").replace("order:", "`order`:")


def registry(spark: SparkSession, settings: dict[str, dict]) -> Sources:
    """The known sources, by name, each with its own settings; build(names) leaves out what isn't configured and refuses
    unknown names."""
    known = Sources()
    for name, make, needs in (("two_endpoint", two_endpoint, {"url": None}), ("many_books", many_books, {"url": None, "key": None, "sport": "esports"})):
        own = {**needs, **settings.get(name, {})}
        known.register(name, lambda make=make, own=own, name=name: make(spark, **{"name": name, **own}))
    return known
