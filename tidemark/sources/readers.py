"""Readers: landed files, archives, JDBC, JSONL, lookups, and the registry of sources."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import norm_hero, norm_name
from ..schemas import KEYS, PREDICTIONS, TABLES
from . import parts, writers


log = logging.getLogger(__name__)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema; a missing one is empty. One whose replacement was cut short is read from
    where it was put aside; one dealt in parts, through its manifest."""
    if parts.is_parted(spark, f"{root}/{name}"):
        return parts.Parts(spark, f"{root}/{name}", TABLES[name], KEYS[name], parts.WIDTHS[name]).read()
    for path in (f"{root}/{name}", f"{root}/{name}.old"):
        try:
            return spark.read.schema(TABLES[name]).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], TABLES[name])


def json_documents(spark: SparkSession, path: str, schema: str, whole_file: bool = True, **options) -> DataFrame:
    """Landed payloads (gzip is transparent); a missing path is empty, as a 404 is for some sources."""
    try:
        return spark.read.schema(schema).options(**options).option("multiLine", whole_file).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))


def parent_links(spark: SparkSession, root: str, source: str, since: str | None = None) -> DataFrame:
    """(event_id, parent_event_id) of an archive of payloads: of each child the link in the payload captured last, from a
    day (yyyy-MM-dd) on. Of compacted days only the links of this source and time are read.

    Else reads what writers.archive writes (source=.../day=.../captured_at=...) and landed files (source/day/EPOCH.json.gz, one
    document each). Unreadable files are skipped, a missing archive is empty.
    """
    links, found = "matchups array<struct<id: long, parentId: long>>", []
    for folder, whole in ((f"{root}/source={source}", False), (f"{root}/{source}", True)):
        raw = json_documents(spark, folder, links, whole, ignoreCorruptFiles=True, recursiveFileLookup=True)
        at = F.regexp_extract(F.input_file_name(), "(?:captured_at=([0-9]+)|/([0-9]+)[.]json)", 0)
        found.append(raw.select(F.regexp_replace(at, "[^0-9]", "").try_cast("long").alias("at"), F.explode("matchups").alias("m")).where("m.parentId IS NOT NULL"))
    if since is not None:
        found = [f.where(F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd") >= since) for f in found]
    links = writers.compacted(spark, root, "links", writers.LINKS).where((F.col("source") == source) & F.col("parent_event_id").isNotNull() & (F.lit(True) if since is None else F.col("day") >= since))
    found.append(links.select(F.col("captured_at").alias("at"), F.struct(F.col("event_id").cast("long").alias("id"), F.col("parent_event_id").cast("long").alias("parentId")).alias("m")))
    return found[0].union(found[1]).union(found[2]).groupBy(F.col("m.id").cast("string").alias("event_id")).agg(F.max_by(F.col("m.parentId").cast("string"), F.struct("at", "m.parentId")).alias("parent_event_id"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records, one JSON object a line; blank lines are skipped, an unknown key or a broken line is an error
    that names the file and the number of the line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    keys, allowed = F.json_object_keys("value"), F.array(*[F.lit(f.name) for f in PREDICTIONS.fields])
    extra = F.array_join(F.array_sort(F.array_except(keys, allowed)), ",")
    fault = F.when(keys.isNull(), F.lit("not a JSON object")).when(extra != "", F.concat(F.lit("unknown keys "), extra))
    for bad in lines.where(fault.isNotNull()).select("value", "file", fault.alias("fault")).take(1):
        whole = spark.read.text(bad.file, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")))
        raise ValueError(f"{bad.file}:{whole.where(F.col('col') == bad.value).agg(F.min('pos')).first()[0] + 1}: {bad.fault}")
    return lines.select(F.from_json("value", PREDICTIONS, {"mode": "FAILFAST"}).alias("r")).select("r.*").withColumns({"period": F.coalesce("period", F.lit(0)), "market_type": F.coalesce("market_type", F.lit("moneyline"))})


def aliases(spark: SparkSession, teams: list[dict]) -> DataFrame:
    """(key, team_id, name) of teams ({team_id, name, aliases}); a key that two teams claim is an error. The list is
    curated by hand, and so small."""
    rows = [(t["team_id"], t["name"], a) for t in teams for a in {t["name"], *t.get("aliases", [])}]
    out = spark.createDataFrame(rows, "team_id long, name string, alias string").select(norm_name(F.col("alias")).alias("key"), "team_id", "name").distinct()
    clash = out.groupBy("key").agg(F.countDistinct("team_id").alias("n")).where("n > 1").select("key").take(1)
    if clash:
        raise ValueError(f"alias of two teams: {clash[0].key}")
    return out


def alias_file(spark: SparkSession, path: str) -> DataFrame:
    """aliases of a YAML file (a list under teams), or of JSON where YAML isn't installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    return aliases(spark, data["teams"])


def heroes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, name string, localized_name string").option("multiLine", True).json(path)


#: Community short names of heroes, by normalised query.
HERO_ALIASES = {
    "aa": "Ancient Apparition", "alch": "Alchemist", "am": "Anti-Mage", "bara": "Spirit Breaker", "bat": "Batrider", "beast": "Beastmaster", "bh": "Bounty Hunter", "brew": "Brewmaster",
    "bristle": "Bristleback", "brood": "Broodmother", "cent": "Centaur Warrunner", "centaur": "Centaur Warrunner", "ck": "Chaos Knight", "clock": "Clockwerk", "cm": "Crystal Maiden",
    "cotl": "Keeper of the Light", "cw": "Clockwerk", "dark seer": "Dark Seer", "dawn": "Dawnbreaker", "dk": "Dragon Knight", "dp": "Death Prophet", "drow": "Drow Ranger", "ds": "Dark Seer",
    "dw": "Dark Willow", "ench": "Enchantress", "es": "Earthshaker", "et": "Elder Titan", "furion": "Nature's Prophet", "fv": "Faceless Void", "grim": "Grimstroke", "gyro": "Gyrocopter",
    "invo": "Invoker", "kaolin": "Earth Spirit", "kotl": "Keeper of the Light", "kunkka": "Kunkka", "lc": "Legion Commander", "leoric": "Wraith King", "ls": "Lifestealer", "mag": "Magnus",
    "mk": "Monkey King", "naix": "Lifestealer", "necro": "Necrophos", "np": "Nature's Prophet", "od": "Outworld Destroyer", "omni": "Omniknight", "pa": "Phantom Assassin",
    "pl": "Phantom Lancer", "potm": "Mirana", "qop": "Queen of Pain", "rhasta": "Shadow Shaman", "sb": "Spirit Breaker", "sd": "Shadow Demon", "sf": "Shadow Fiend", "shaker": "Earthshaker",
    "sk": "Sand King", "sky": "Skywrath Mage", "snap": "Snapfire", "spec": "Spectre", "ss": "Shadow Shaman", "storm": "Storm Spirit", "ta": "Templar Assassin", "tb": "Terrorblade",
    "timber": "Timbersaw", "tide": "Tidehunter", "tp": "Treant Protector", "treant": "Treant Protector", "troll": "Troll Warlord", "underlord": "Underlord", "venge": "Vengeful Spirit",
    "veno": "Venomancer", "voker": "Invoker", "void": "Faceless Void", "wd": "Witch Doctor", "wind": "Windranger", "wisp": "Io", "wk": "Wraith King", "wr": "Windranger", "ww": "Winter Wyvern",
    "willow": "Dark Willow", "zeus": "Zeus", "zuus": "Zeus",
}


def hero_aliases(heroes: DataFrame, aliases: dict[str, str] = HERO_ALIASES) -> DataFrame:
    """(key, hero_id) of the short names whose hero is known."""
    named = heroes.sparkSession.createDataFrame(list(aliases.items()), "key string, localized_name string")
    return named.join(heroes.select("localized_name", F.col("id").alias("hero_id")), "localized_name").select("key", "hero_id")


def hero_lookup(heroes: DataFrame, extra: DataFrame | None = None, short_prefix: str = "^npc_[a-z0-9]+_hero_") -> DataFrame:
    """(key, hero_id): normalised localized, internal and short names; an alias (key, hero_id) only where free."""
    internal = F.col("name")
    short = F.regexp_replace(internal, short_prefix, "")
    keys = F.array(F.struct(F.lit(0).alias("rank"), norm_hero(F.col("localized_name")).alias("key")), F.struct(F.lit(1).alias("rank"), norm_hero(internal).alias("key")), F.struct(F.lit(2).alias("rank"), norm_hero(short).alias("key")))
    rows = heroes.select(F.col("id").alias("hero_id"), F.explode(keys).alias("k")).select("k.rank", "k.key", "hero_id")
    if extra is not None:
        rows = rows.union(extra.select(F.lit(3), norm_hero(F.col("key")), F.col("hero_id").cast("int")))
    return rows.where("key <> ''").groupBy("key").agg(F.min_by("hero_id", F.struct("rank", "hero_id")).alias("hero_id"))


def resolve_heroes(df: DataFrame, query: str, heroes: DataFrame, lookup: DataFrame) -> DataFrame:
    """df with hero_id: by id if query is digits (never falling through to names), else by name; null if unknown."""
    digits = F.regexp_like(F.trim(query), F.lit("^[0-9]+$"))
    ids = heroes.select(F.col("id").cast("string").alias("__id"), F.col("id").alias("__by_id"))
    out = df.withColumns({"__id": F.when(digits, F.trim(query)), "__key": F.when(~digits, norm_hero(F.col(query)))})
    out = out.join(ids, "__id", "left").join(lookup.select(F.col("key").alias("__key"), F.col("hero_id").alias("__by_name")), "__key", "left")
    return out.select(*df.columns, F.coalesce("__by_id", "__by_name").alias("hero_id"))


#: What a bulk import asks of a remote PostgreSQL, by time slice [lo, hi).
SLICE_QUERIES = {
    "matches": (
        "SELECT m.match_id, m.leagueid, m.series_id, m.series_type, m.start_time, m.duration, m.radiant_team_id, m.radiant_team_name AS radiant_name, m.dire_team_id, m.dire_team_name AS dire_name, "
        "m.radiant_win, m.radiant_score, m.dire_score, p.patch{series} FROM matches m LEFT JOIN match_patch p USING (match_id) WHERE m.start_time >= {lo} AND m.start_time < {hi}"
    ),
    "picks_bans": 'SELECT b.match_id, b.is_pick, b.hero_id, b.team, b.ord AS "order" FROM picks_bans b JOIN matches m USING (match_id) WHERE m.start_time >= {lo} AND m.start_time < {hi}',
    "player_matches": "SELECT q.match_id, q.player_slot, q.account_id, q.hero_id, q.kills, q.deaths, q.assists, q.gold_per_min, q.xp_per_min, q.lane_role FROM player_matches q JOIN matches m USING (match_id) WHERE m.start_time >= {lo} AND m.start_time < {hi}",
}


#: The minute arrays, asked for only where they are wanted.
SERIES_COLUMNS = ", m.radiant_gold_adv, m.radiant_xp_adv"


#: Schemas of what the slices give over HTTP.
SLICE_SCHEMAS = {
    "matches": (
        "match_id long, leagueid long, series_id long, series_type int, start_time long, duration int, radiant_team_id long, radiant_name string, dire_team_id long, dire_name string, "
        "radiant_win boolean, radiant_score int, dire_score int, patch string, radiant_gold_adv array<int>, radiant_xp_adv array<int>"
    ),
    "picks_bans": "match_id long, is_pick boolean, hero_id int, team int, `order` int",
    "player_matches": "match_id long, player_slot int, account_id long, hero_id int, kills int, deaths int, assists int, gold_per_min int, xp_per_min int, lane_role int",
}


def slice_sql(table: str, lo: int, hi: int, with_timeseries: bool = False) -> str:
    return SLICE_QUERIES[table].format(lo=lo, hi=hi, series=SERIES_COLUMNS if with_timeseries else "")


def remote(spark: SparkSession, url: str, sql: str, **options) -> DataFrame:
    """A query that the remote database answers as a whole."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def remote_slice(spark: SparkSession, url: str, name: str, lo: int, hi: int, with_timeseries: bool = False, **options) -> DataFrame:
    """A table's slice in its declared schema, over JDBC or from an HTTP endpoint that takes SQL."""
    sql, schema = slice_sql(name, lo, hi, with_timeseries), T.StructType.fromDDL(SLICE_SCHEMAS[name])
    if url.startswith("http"):
        rows = spark.read.format("sql_json").options(url=url, sql=sql, **options).load().select(F.from_json("body", schema).alias("r")).select("r.*")
    else:
        rows = remote(spark, url, sql, **options)
    fields = [f for f in schema.fields if with_timeseries or not f.name.endswith("_adv")]
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def slices(lo: int, hi: int, width: int, read: Callable[[int, int], object], least: int = 86400) -> Iterator[tuple[int, int, object]]:
    """(lo, hi, result or None) of read over consecutive slices; a slice that fails is halved, down to least seconds,
    and then skipped, with None as its result."""
    while lo < hi:
        size = width
        while True:
            end = min(hi, lo + size)
            try:
                yield lo, end, read(lo, end)
                break
            except Exception as e:
                log.warning("slice from %s to %s failed: %s", lo, end, e)
                if size <= least:
                    yield lo, end, None
                    break
                size = max(least, size // 2)
        lo = end


def pages(fetch: Callable[[int | None], list[dict]], most: int, before: int | None = None, key: str = "match_id") -> Iterator[dict]:
    """Rows of a list that is read backward: each page asks for ids below the smallest so far."""
    n = 0
    while n < most:
        rows = fetch(before)
        if not rows:
            return
        for r in rows:
            if n >= most:
                return
            n += 1
            yield r
        before = min(r[key] for r in rows)


def with_retries(call: Callable[[], object], attempts: int = 7, base: float = 5.0, most: float = 300.0, sleep=time.sleep, wait_of: Callable[[Exception], float | None] = lambda e: None, again: Callable[[Exception], bool] = lambda e: True):
    """call(), tried again after base 2^n seconds, at most `most`, and not before what the error asks for (wait_of); an
    error that again refuses is raised at once."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n == attempts - 1 or not again(e):
                raise
            sleep(max(min(most, base * 2**n), wait_of(e) or 0.0))


class Sources:
    """Registry of quote sources by name: functions that give a DataFrame, or None if they aren't configured."""

    def __init__(self):
        self.known: dict[str, Callable[..., DataFrame | None]] = {}

    def register(self, name: str, read: Callable[..., DataFrame | None]) -> None:
        self.known[name] = read

    def build(self, names: Iterable[str], **kw) -> dict[str, DataFrame]:
        wanted = list(names)
        if unknown := [n for n in wanted if n not in self.known]:
            raise ValueError(f"unknown sources: {', '.join(unknown)}")
        return {n: df for n in wanted if (df := self.known[n](**kw)) is not None}
