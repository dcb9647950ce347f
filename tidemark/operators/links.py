"""Joins: as-of, nearest in time, all pairs, inheritance, name lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm_name, parse_ts, strip_kills
from ..sources.shared import materialize
from .blocks import blocks, number_of


def last_before(bounds: DataFrame, rows: DataFrame, on: list[str], bound: str, at: str, per: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Strict as-of: for each row of bounds and each value of per, the last row of rows (by order) with at < bound.

    Each bound is repeated for the values of per that its key has at all, which is what comes out, and meets the
    history in one sorted stream (merge_asof): no pairs of bounds and rows are formed. per may be null.
    """
    keys = [f"__k{i}" for i in range(len(per))]
    marked = rows.withColumns({k: F.struct(F.col(p)) for k, p in zip(keys, per, strict=True)})  # a struct is never null
    wanted = bounds.join(marked.select(*on, *keys).distinct(), on)
    out = merge_asof(wanted, marked.select(*on, *keys, F.col(at).alias("__at"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(value)]).alias("__value")), [*on, *keys], bound, "__at", ["__value"], order=[f"__o{i}" for i in range(len(order))])
    found = out.where(F.col("__value").isNotNull())
    return found.select(*bounds.columns, *[F.col(k)[p].alias(p) for k, p in zip(keys, per, strict=True)], *[F.col(f"__value.v{i}").alias(c) for i, c in enumerate(value)])


def asof_previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last non-null value of the rows before each row (ROWS, so ties in time follow the order)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def merge_asof(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, value: list[str], strict: bool = True, order: list[str] = (), n_blocks: int | None = None) -> DataFrame:
    """left with the values of the last row of right before (strict) or at its time, ties by order; null without one.

    Both sides are laid in one sorted stream by key and time and values carried forward: one shuffle and one sort,
    however many rows of right precede a row of left, where an inequality join would form all pairs. Streams are cut at
    quantiles of right's times into n_blocks blocks (see blocks), so that a key with most of the rows is as many tasks; each block of
    a key begins with the last value of those before it, which one small row per key and block works out.
    """
    cuts = blocks(right, right_at, n_blocks)
    row_type, value_type = left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType, right.select(F.struct(*value).alias("x")).schema["x"].dataType
    ties = [F.col(c).alias(f"__tie{i}") for i, c in enumerate(order)]
    none = [F.lit(None).cast(right.schema[c].dataType).alias(f"__tie{i}") for i, c in enumerate(order)]
    block = lambda df, at: cuts.of(number_of(df, at)).alias("__block")
    first = left.select(*on, block(left, left_at), F.col(left_at).alias("__t"), F.lit(1 if strict else 2).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(value_type).alias("__v"), *none)
    other = right.select(*on, block(right, right_at), F.col(right_at).alias("__t"), F.lit(2 if strict else 1).alias("__side"), F.lit(None).cast(row_type).alias("__row"), F.struct(*value).alias("__v"), *ties)
    # what each block of a key hands over: its last value; and what comes to each in which a row of left stands
    last = F.max_by("__v", F.struct("__t", *[f"__tie{i}" for i in range(len(order))]))
    held = other.groupBy(*on, "__block").agg(last.alias("__v")).select(*on, "__block", "__v", F.lit(False).alias("__asks"))
    asked = first.select(*on, "__block").distinct().select(*on, "__block", F.lit(None).cast(value_type).alias("__v"), F.lit(True).alias("__asks"))
    back = Window.partitionBy(*on).orderBy("__block").rangeBetween(Window.unboundedPreceding, -1)
    came = held.union(asked).withColumn("__v", F.last("__v", ignorenulls=True).over(back)).where(F.col("__asks") & F.col("__v").isNotNull() & F.col("__block").isNotNull())
    came = came.select(*on, "__block", F.lit(None).cast(right.schema[right_at].dataType).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(row_type).alias("__row"), "__v", *none)
    w = Window.partitionBy(*on, "__block").orderBy("__t", "__side", *[f"__tie{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    out = first.union(other).union(came).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where(F.col("__row").isNotNull())
    return out.select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in value])


def nearest_within(left: DataFrame, right: DataFrame, on: list[str], left_id: list[str], left_at: str, right_at: str, right_id: str, tolerance: int) -> DataFrame:
    """left's rows with right_id, skew (left_at - right_at) and ambiguous of the nearest row of right with equal keys and
    at most tolerance between; ties go to the smaller right_id; ambiguous: more than one lies inside. Rows of left with
    a null time take the only row of right with their keys, if there is just one (skew null). Others get nulls.

    Times are cut into steps of the tolerance, so that a row of left only meets those of right in its own step and in
    the two beside it, however long the history of its keys is."""
    gap, step = F.abs(F.col(left_at) - F.col(right_at)), F.lit(max(1, tolerance))
    near = F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.col(left_at) / step) + d)).alias("__step")
    both = left.where(F.col(left_at).isNotNull()).select("*", near).join(right.select(*on, right_id, right_at, F.floor(F.col(right_at) / step).alias("__step")), [*on, "__step"])
    timed = both.where(gap <= tolerance).groupBy(*left_id).agg(F.min(F.struct(gap.alias("d"), F.col(right_id), F.col(right_at))).alias("__best"), F.count("*").alias("__n"))
    lone = right.groupBy(*on).agg(F.count("*").alias("__k"), F.min(right_id).alias("__only")).where("__k = 1")
    out = left.join(timed, left_id, "left").join(lone, on, "left")
    chosen = F.when(F.col(left_at).isNull(), F.col("__only")).otherwise(F.col(f"__best.{right_id}"))
    return out.select(*left.columns, chosen.alias(right_id), (F.col(left_at) - F.col(f"__best.{right_at}")).alias("skew"), F.coalesce(F.col("__n") > 1, F.lit(False)).alias("ambiguous"))


def unordered_pair(a: str, b: str) -> list[Column]:
    """Keys of an unordered pair: an equality join in place of "either side matches"."""
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


#: Rows of either side that one block of a join of all pairs holds.
LEFT_BLOCK, RIGHT_BLOCK = 512, 4096


def all_pairs(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of all rows with equal keys, for keys where each row meets very many: an inner join.

    Both sides are packed into blocks of ids, the blocks are joined, dealt in order of their keys, and taken apart there,
    so that only ids travel, never pairs, and a key with most of the rows is many tasks. A task holds one block of each
    side, whatever the result. Ids of left run within each id of right, over few of them at a time: a result that is
    stored takes little for a row.
    """
    packed = []
    for df, id_, size in ((left, left_id, LEFT_BLOCK), (right, right_id, RIGHT_BLOCK)):
        rows = df.select(*on, id_).dropna(subset=on).sortWithinPartitions(*on, id_)
        # numbers run on within a partition, so that a key's block is cut from rows that stand together
        rows = rows.withColumn("__block", F.floor(F.monotonically_increasing_id() / size))
        held = rows.groupBy(*on, "__block").agg(F.collect_list(F.struct(id_)).alias("__ids"))  # in structs, which keep null ids
        packed.append(held.select(*on, F.col("__block").alias(f"__of_{id_}"), F.col("__ids")[id_].alias(id_)))
    both = packed[0].join(packed[1], on)
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    order = [*on, f"__of_{left_id}", f"__of_{right_id}"]
    dealt = both.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.select(left_id, F.explode(right_id).alias(right_id)).select(F.explode(left_id).alias(left_id), right_id)


def inherit(df: DataFrame, node: str, parent: str, value: str, depth: int = 30) -> DataFrame:
    """df with value taken from the nearest ancestor that has one. Links double at every step, so that chains of 2^depth
    are reached; every step is written, and it ends when a step fills nothing more. Rows on a loop stay unfilled, and
    so do rows whose node is null.

    Only rows that still look for a value are joined to their ancestors, and only what was filled to df: rows without a
    link would all meet in one task, as their key is null."""
    open_, left = F.col("__v").isNull() & F.col("__p").isNotNull(), None
    state = materialize(df.select(F.col(node).alias("__n"), F.col(parent).alias("__p"), F.col(value).alias("__v")), "ancestors")
    settled, pending = state.where(~open_), state.where(open_)
    found = pending.limit(0)
    for _ in range(depth):
        up = settled.unionByName(pending).select(F.col("__n").alias("__p"), F.col("__p").alias("__pp"), F.col("__v").alias("__pv"))
        step = pending.join(up.where("__p IS NOT NULL"), "__p", "left").select("__n", F.when(F.col("__pv").isNull(), F.col("__pp")).alias("__p"), F.col("__pv").alias("__v"))
        step = materialize(step, "ancestors")
        filled, pending = step.where(~open_), step.where(open_)
        settled, found = settled.unionByName(filled), found.unionByName(filled)
        now = pending.count()
        if now in (0, left):
            break
        left = now
    filled = found.where("__v IS NOT NULL").select(F.col("__n").alias(node), "__v")
    return df.join(filled, node, "left").withColumn(value, F.coalesce(value, "__v")).select(*df.columns)


#: Releases that a timeline may hold; it has a few a year.
RELEASES = 10_000


def patch_of(df: DataFrame, timeline: DataFrame, at: str, label: str = "patch") -> DataFrame:
    """df with the patch in force: its own label, else the last of timeline (released_at, patch_id) released by its
    start. A start of null or 0 has none. The timeline, RELEASES rows at most, becomes a literal: nothing is joined."""
    known = [(r.released_at, r.patch_id) for r in timeline.select("released_at", "patch_id").where("released_at IS NOT NULL").limit(RELEASES + 1).collect()]
    if len(known) > RELEASES:
        raise ValueError(f"a patch timeline of more than {RELEASES} rows")
    releases = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(p).cast("int").alias("p")) for t, p in sorted(known, key=lambda r: (r[0], r[1] is not None, r[1]))])
    if not known:
        return df
    found = F.array_max(F.filter(releases, lambda r: r.t <= F.nullif(F.col(at), F.lit(0)))).p
    return df.withColumn(label, F.coalesce(F.col(label), found.cast(df.schema[label].dataType)))


def resolve_names(df: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
    """df with out (the team id of an alias or null) and is_kills. aliases: key (normalised), team_id."""
    base, kills = strip_kills(F.col(name))
    known = aliases.select(F.col("key").alias("__key"), F.col("team_id").alias(out))
    return df.withColumns({"__key": norm_name(base), "is_kills": kills.cast("int")}).join(known, "__key", "left").drop("__key")


def alias_clashes(aliases: DataFrame) -> DataFrame:
    """Keys that more than one team claims."""
    return aliases.groupBy("key").agg(F.countDistinct("team_id").alias("n")).where("n > 1")


def resolve_report(events: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """What a human must look at after resolve_events: unresolved (name without its kills suffix, snapshots), unjoined
    and ambiguous (event_id, home, away), each in order.

    events: event_id, home, away; resolved: of resolve_events.
    """
    both = events.select("event_id", "home", "away").dropDuplicates(["event_id"]).join(resolved, "event_id")
    sides = F.array(*[F.struct(F.col(n).alias("raw"), F.col(f"{n}_team_id").alias("team")) for n in ("home", "away")])
    names = both.select("snapshots", F.explode(sides).alias("x")).where("x.team IS NULL AND x.raw <> ''")
    unresolved = names.select(strip_kills(F.col("x.raw"))[0].alias("name"), "snapshots").groupBy("name").agg(F.sum("snapshots").alias("snapshots"))
    named = F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()
    return {
        "unresolved": unresolved.orderBy(F.desc("snapshots"), "name"),
        "unjoined": both.where(named & F.col("series_id").isNull()).select("event_id", "home", "away").orderBy("event_id"),
        "ambiguous": both.where("ambiguous").select("event_id", "home", "away").orderBy("event_id"),
    }


def quoted_names(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """(series_id, team_id, name): what the book calls a series' teams, in the newest quote of its parentless event."""
    mine = events.where(F.col("series_id").isNotNull() & (F.col("is_kills") == 0) & F.col("parent_event_id").isNull()).select("source", "event_id", "series_id", "home_team_id", "away_team_id")
    sides = F.array(*[F.struct(F.col(f"{n}_team_id").alias("team_id"), F.col(n).alias("name")) for n in ("home", "away")])
    last = snapshots.join(mine, ["source", "event_id"]).groupBy("series_id").agg(F.max_by(sides, F.struct("captured_at", "id")).alias("sides"))
    return last.select("series_id", F.explode("sides").alias("x")).select("series_id", "x.*").where("team_id IS NOT NULL AND name <> ''")


def resolve_events(snapshots: DataFrame, aliases: DataFrame, series: DataFrame, parents: DataFrame, tolerance: int = 8 * 3600) -> DataFrame:
    """event_series_map rows of a source's events: teams by alias, the series of the same unordered pair nearest to the
    start, else the parent's. snapshots: source, event_id, units, home, away, start_time; series: series_id, team_a,
    team_b, start; parents: event_id, parent_event_id."""
    events = snapshots.where("event_id IS NOT NULL").groupBy("source", "event_id").agg(
        F.min("units").alias("units"), F.min("home").alias("home"), F.min("away").alias("away"), F.min("start_time").alias("start_time"), F.count("*").alias("snapshots")
    )
    ids = resolve_names(events, "home", aliases, "home_team_id").withColumnRenamed("is_kills", "__k")
    ids = resolve_names(ids, "away", aliases, "away_team_id").withColumn("is_kills", F.greatest("is_kills", "__k")).drop("__k")
    ids = ids.withColumn("start", parse_ts(F.col("start_time"))).select("*", *unordered_pair("home_team_id", "away_team_id"))
    ids = ids.withColumns({c: F.when(F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull(), F.col(c)) for c in ("lo", "hi")})
    pairs = series.where("series_id > 0").select("series_id", F.col("start").alias("series_start"), *unordered_pair("team_a", "team_b"))
    near = nearest_within(ids, pairs, ["lo", "hi"], ["source", "event_id"], "start", "series_start", "series_id", tolerance)
    linked = near.join(parents, "event_id", "left")
    full = inherit(linked, "event_id", "parent_event_id", "series_id")
    return full.select("source", "event_id", "units", "is_kills", "parent_event_id", "home_team_id", "away_team_id", "series_id", F.col("skew").alias("start_skew_s"), "ambiguous", "snapshots")
