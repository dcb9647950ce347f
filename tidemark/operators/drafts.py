"""Draft statistics as windows, and the combiner that learns from them online.

A decayed count sum(win 2^(-(t - t_i) / h)) over earlier maps needs no fold: with g = 2^((t - t0) / h) it is a running
sum of win g divided by the current g, t0 being the beginning of the row's block of time. Frames are ROWS over (time, match), so that maps of one time see each other in
order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import evidence_weight, shrunk_rate
from ..sources.shared import materialize
from .blocks import Blocks, blocks, number_of


@dataclass(frozen=True)
class DraftConfig:
    half_life_days: float = 120.0
    k_hero: float = 20.0
    k_team_hero: float = 10.0
    k_pair: float = 100.0
    learning_rate: float = 0.05
    min_team_games: int = 5
    initial_intercept: float = 0.063
    disabled: bool = False

    @property
    def half_life_s(self) -> float:
        return self.half_life_days * 86400


def decayed(df: DataFrame, keys: list[str], at: str, order: list[str], won: str, half_lives: list[float], cuts: Blocks | None = None) -> DataFrame:
    """df with wins_0, total_0, wins_1, ...: for each half-life, decayed counts of the rows before each row of its key.

    Time is cut into blocks, at most 500 half-lives wide: a block of a key is a window of its own, whose powers count
    from its beginning, so that a key with most of the rows is many tasks and no history is too long. Each block gets
    the decayed sums of the blocks before it, folded over one small array per key of one entry per block. df is read
    twice, and a third time for its blocks where they aren't given (decay_blocks).
    """
    cuts, x = cuts or decay_blocks(df, at, half_lives), number_of(df, at)
    rows, start = df.withColumn("__block", cuts.of(x)), cuts.start
    power = lambda seconds, h: F.pow(F.lit(2.0), seconds / F.lit(float(h)))
    grown = [power(x - start(F.col("__block")), h) for h in half_lives]
    sums = F.array(*[F.sum(v) for g in grown for v in (F.col(won) * g, g)])
    local = rows.groupBy(*keys, "__block").agg(sums.alias("sums"))
    listed = local.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__block").alias("block"), "sums"))).alias("blocks"))
    ages = lambda seconds: [power(-seconds, h) for h in half_lives for _ in (0, 1)]

    def fold(acc, b):
        """acc: the sums as of the beginning of the block before, with that block's own; and what came before each block."""
        faded = F.array(*[acc.sums[i] * a for i, a in enumerate(ages(start(b.block) - start(acc.block)))])
        return F.struct(b.block.alias("block"), F.zip_with(faded, b.sums, lambda u, v: u + v).alias("sums"), F.concat(acc.before, F.array(F.struct(b.block.alias("block"), faded.alias("sums")))).alias("before"))

    none = F.array(*[F.lit(0.0)] * (2 * len(half_lives)))
    empty = F.struct(F.lit(0).alias("block"), none.alias("sums"), F.array().cast("array<struct<block:int,sums:array<double>>>").alias("before"))
    came = listed.select(*keys, F.explode(F.aggregate("blocks", empty, fold, lambda acc: acc.before)).alias("x"))
    # what came stands in the window's stream as the first row of its block, so that no join is needed
    parts = [f"__{name}_{i}" for i in range(len(half_lives)) for name in ("wins", "total")]
    own = rows.select(*df.columns, "__block", F.lit(1).alias("__after"), *[v.alias(p) for p, v in zip(parts, (v for g in grown for v in (F.col(won) * g, g)), strict=True)])
    first = came.select(*[F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns], F.col("x.block").alias("__block"), F.lit(0).alias("__after"), *[F.col("x.sums")[i].alias(p) for i, p in enumerate(parts)])
    w = Window.partitionBy(*keys, "__block").orderBy("__after", *order).rowsBetween(Window.unboundedPreceding, -1)
    counted = own.unionByName(first).withColumns({f"{p}_before": F.sum(p).over(w) for p in parts}).where("__after = 1")
    given = [(F.coalesce(F.col(f"__{name}_{i}_before"), F.lit(0.0)) / F.col(f"__total_{i}")).alias(f"{name}_{i}") for i in range(len(half_lives)) for name in ("wins", "total")]
    return counted.select(*df.columns, *given)


def decay_blocks(df: DataFrame, at: str, half_lives: list[float], n: int | None = None) -> Blocks:
    """Blocks of times for decayed: as even as they can be with none over 500 half-lives wide."""
    return blocks(df, at, n, 500 * min(half_lives))


def net(k: float, wins: str = "wins", total: str = "total") -> Column:
    return shrunk_rate(F.col(wins), F.col(total), k) - 0.5


def complete_drafts(events: DataFrame) -> DataFrame:
    """match_id, heroes_a, heroes_b (in order of pick), first_a: whether side a made the first action, a ban or a pick.

    Only drafts of five and five distinct heroes. events: match_id, ord, is_pick, hero_id, team (0: a, 1: b).
    """
    picks = lambda side: F.transform(F.array_sort(F.collect_list(F.when((F.col("is_pick") == 1) & (F.col("team") == side), F.struct("ord", "hero_id")))), lambda x: x.hero_id)
    out = events.groupBy("match_id").agg(picks(0).alias("heroes_a"), picks(1).alias("heroes_b"), (F.min_by("team", "ord") == 0).alias("first_a"))
    return out.where((F.size("heroes_a") == 5) & (F.size("heroes_b") == 5) & (F.size(F.array_distinct(F.concat("heroes_a", "heroes_b"))) == 10))


def draft_features(maps: DataFrame, drafts: DataFrame, config: DraftConfig = DraftConfig()) -> DataFrame:
    """match_id, hero_diff, team_hero_diff, synergy_diff, counter_sum, first_action, both_warm of every complete draft.

    maps: match_id, start_time, a, b, win, games_a, games_b; drafts: as of complete_drafts. Sums are side a minus b.
    """
    both = maps.select("match_id", "start_time", "a", "b", "win", "games_a", "games_b").join(drafts.select("match_id", *DRAFT), "match_id")
    out = with_features(both, config, [config.half_life_days], [config.k_pair], "grid")
    return out.select("match_id", *[F.col("grid")[0][i].alias(f) for i, f in enumerate(FEATURES[1:])])


#: Columns of a draft, and what a stream of maps lacks for a key's earlier sums.
DRAFT, CARRIED = ["heroes_a", "heroes_b", "first_a"], "__block int, __kind int, __x long, __y long, __sums array<double>"
#: Kinds of keys: a hero, a team with a hero, two heroes on one side, two on opposite ones.
HERO, TEAM_HERO, PAIR, MATCHUP = range(4)
_SAME = [(s * 5 + i, s * 5 + j) for s in (0, 1) for i in range(5) for j in range(i)]
_ACROSS = [(i, 5 + j) for i in range(5) for j in range(5)]


def _encoded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order of appearance, and each key's place among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


#: Half-lives that powers may grow over before a stream starts them anew.
SPAN = 4


class _Tally:
    """Decayed sums by key, wins then total for each half-life; no power exceeds 2^SPAN, however long the history is."""

    def __init__(self, half_lives: list[float]):
        self.halves, self.number = np.array(half_lives)[:, None], {}
        self.at, self.sums = np.zeros(0), np.zeros((2 * len(half_lives), 0))

    def numbers(self, known: np.ndarray) -> np.ndarray:
        out = np.array([self.number.setdefault(k, len(self.number)) for k in known.tolist()], np.int64)
        more = len(self.number) - len(self.at)
        if more:
            self.at, self.sums = np.append(self.at, np.zeros(more)), np.append(self.sums, np.zeros((len(self.sums), more)), 1)
        return out

    def power(self, seconds: np.ndarray) -> np.ndarray:
        return np.tile(np.exp2(seconds / self.halves), (2, 1))

    def as_of(self, n: np.ndarray, at: float) -> np.ndarray:
        sums = self.sums[:, n]
        return sums * self.power(np.where(sums.any(0), self.at[n] - at, 0.0))

    def put(self, n: np.ndarray, at: float, sums: np.ndarray) -> None:
        self.at[n], self.sums[:, n] = at, sums

    def before(self, keys: np.ndarray, at: np.ndarray, won: np.ndarray) -> np.ndarray:
        """(sums, map, place) before each of a map's events, which count from the next map on. keys, won: a row each map,
        in order of at, over SPAN half-lives at most; a map has no key twice."""
        known, place = _encoded(keys.reshape(-1))
        n = self.numbers(known)
        order = np.argsort(place.astype(np.uint16) if len(known) <= 1 << 16 else place, kind="stable")
        group = place[order]
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends, n = np.append(begins[1:], len(group)) - 1, n[group[begins]]
        grown = self.power(at - at[0])[:, order // keys.shape[1]]
        own = grown.copy()
        own[: len(self.halves)] *= won.reshape(-1)[order]
        upto = own.cumsum(1)
        came, below = self.as_of(n, at[0]), upto[:, begins] - own[:, begins]
        self.put(n, at[0], came + upto[:, ends] - below)
        out = np.empty_like(own)
        out[:, order] = (upto - own + np.repeat(came - below, ends - begins + 1, 1)) / grown
        return out.reshape(-1, *keys.shape)


def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _events(batch) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Heroes (five of side a, five of b) and, by kind, x, y and won of each map's events, a row each map."""
    sides = [batch.column(f"heroes_{s}").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 5) for s in "ab"]
    heroes = np.concatenate(sides, 1)
    team = np.repeat(np.stack([_column(batch, "a"), _column(batch, "b")], 1).astype(np.int64), 5, 1)
    win = _column(batch, "win").astype(float)
    won = np.repeat(np.stack([win, 1 - win], 1), 5, 1)
    out = [(heroes, np.zeros_like(heroes), won), (team, heroes, won)]
    for places in (_SAME, _ACROSS):
        i, j = np.array(places).T
        x, y = heroes[:, i], heroes[:, j]
        out.append((np.minimum(x, y), np.maximum(x, y), np.where(x < y, won[:, i], won[:, j])))
    return heroes, out


def _drafted(batch):
    return batch.filter(pc.and_(batch.column("heroes_a").is_valid(), batch.column("heroes_b").is_valid()))


class _Keys:
    """Pairs of numbers as one: the first by its place among those seen, as teams' ids may be long."""

    def __init__(self):
        self.number: dict[int, int] = {}

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        known, place = _encoded(x.reshape(-1))
        n = np.array([self.number.setdefault(v, len(self.number)) for v in known.tolist()], np.int64)
        return (n[place].reshape(x.shape) << 32) | (y & 0xFFFFFFFF)


def _sums_column(sums: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(sums.shape[1] + 1) * len(sums), pa.int32()), pa.array(sums.T.reshape(-1)))


def _sums_of(batch) -> np.ndarray:
    return batch.column("__sums").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T


def _summed(half_lives: list[float], starts: list[float]):
    """Sums of each block's events by key, as of the block's end; of the last block only its keys, as no block follows."""

    def run(batches):
        tally, key = _Tally(half_lives), _Keys()
        for whole in batches:
            of = _column(whole, "__block")
            for block in np.unique(of).tolist():
                batch = _drafted(whole.filter(pa.array(of == block)))
                if not batch.num_rows:
                    continue
                at = _column(batch, "start_time").astype(float)
                weight = tally.power(np.minimum(at - starts[block + 1], 0)) if block + 1 < len(starts) else np.zeros((2 * len(half_lives), len(at)))
                for kind, (x, y, won) in enumerate(_events(batch)[1]):
                    known, place = _encoded(key(x, y).reshape(-1))
                    each = np.repeat(weight, x.shape[1], 1)
                    each[: len(half_lives)] *= won.reshape(-1)
                    sums = np.stack([np.bincount(place, v, len(known)) for v in each])
                    one = np.zeros(len(known), np.int64)
                    one[place] = np.arange(len(place))
                    columns = [pa.array(np.full(len(known), v), pa.int32()) for v in (block, kind)] + [pa.array(v.reshape(-1)[one]) for v in (x, y)]
                    yield pa.RecordBatch.from_arrays([*columns, _sums_column(sums)], [c.split()[0] for c in CARRIED.split(", ")])

    return run


def _handed(half_lives: list[float], starts: list[float]):
    """CARRIED with the sums that come to a key's block from those before, as of its start, from sums as of ends. Each
    key's blocks come in order."""

    def run(batches):
        tallies, keys = [_Tally(half_lives) for _ in range(4)], [_Keys() for _ in range(4)]
        for batch in batches:
            blocks_, kinds = _column(batch, "__block"), _column(batch, "__kind")
            for block in np.unique(blocks_).tolist():
                for kind, (tally, key) in enumerate(zip(tallies, keys, strict=True)):
                    own = batch.filter(pa.array((blocks_ == block) & (kinds == kind)))
                    if not own.num_rows:
                        continue
                    n = tally.numbers(key(_column(own, "__x"), _column(own, "__y")))
                    found, start, end = tally.as_of(n, starts[block]), starts[block], starts[min(block + 1, len(starts) - 1)]
                    tally.put(n, end, found * tally.power(np.full(len(n), start - end)) + _sums_of(own))
                    yield pa.RecordBatch.from_arrays([*own.columns[:4], _sums_column(found)], own.schema.names)

    return run


def _featured(config: DraftConfig, half_lives: list[float], k_pairs: list[float], starts: list[float], given: list[str], name: str):
    """Maps of one block in order, behind what the blocks before hand over; gives them with their feature lists."""
    wide = len(half_lives)

    def excess(sums, k, expected):
        return shrunk_rate(sums[:wide], sums[wide:], k) - 0.5 - evidence_weight(sums[wide:], k) * expected

    def lists(batch, tallies, keys):
        heroes, events = _events(batch)
        at, counts = _column(batch, "start_time").astype(float), []
        cuts = [0]
        while cuts[-1] < len(at):
            cuts.append(int(np.searchsorted(at, at[cuts[-1]] + SPAN * min(half_lives), "right")))
        for tally, key, (x, y, won) in zip(tallies, keys, events, strict=True):
            named = key(x, y)
            counts.append(np.concatenate([tally.before(named[i:j], at[i:j], won[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], 1))
        side = np.repeat([1.0, -1.0], 5)
        rates = excess(counts[HERO], config.k_hero, 0.0)
        (i, j), (x, y) = np.array(_SAME).T, np.array(_ACROSS).T
        above = np.where(heroes[:, x] < heroes[:, y], 1.0, -1.0)
        first, warm = batch.column("first_a").to_pylist(), [min(a or 0, b or 0) >= config.min_team_games for a, b in zip(batch.column("games_a").to_pylist(), batch.column("games_b").to_pylist(), strict=True)]
        grid = np.empty((len(at), wide, len(k_pairs), 6))
        grid[..., 0], grid[..., 1] = (rates @ side).T[:, :, None], (excess(counts[TEAM_HERO], config.k_team_hero, 0.0) @ side).T[:, :, None]
        together, apart = 0.5 * (rates[:, :, i] + rates[:, :, j]), above * (rates[:, :, x] - rates[:, :, y])
        for at_k, k in enumerate(k_pairs):
            grid[:, :, at_k, 2] = (excess(counts[PAIR], k, together) @ side[i]).T
            grid[:, :, at_k, 3] = (above * excess(counts[MATCHUP], k, apart)).sum(2).T
        grid[..., 4] = np.array([0.0 if f is None else 1.0 if f else -1.0 for f in first])[:, None, None]
        grid[..., 5] = np.array(warm, float)[:, None, None]
        return grid

    def run(batches):
        tallies, keys = [_Tally(half_lives) for _ in range(4)], [_Keys() for _ in range(4)]
        size = wide * len(k_pairs)
        for whole in batches:
            came = whole.filter(whole.column("__kind").is_valid())
            kinds = _column(came, "__kind")
            for kind in np.unique(kinds).astype(int).tolist():
                own = came.filter(pa.array(kinds == kind))
                n = tallies[kind].numbers(keys[kind](_column(own, "__x"), _column(own, "__y")))
                tallies[kind].put(n, starts[own.column("__block")[0].as_py()], _sums_of(own))
            batch = whole.filter(whole.column("__kind").is_null())
            if not batch.num_rows:
                continue
            known = np.array(pc.and_(batch.column("heroes_a").is_valid(), batch.column("heroes_b").is_valid()))
            grid = lists(_drafted(batch), tallies, keys) if known.any() else np.zeros((0, size, 6))
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(grid) * size + 1) * 6, pa.int32()), pa.array(grid.reshape(-1)))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(len(grid) + 1) * size, pa.int32()), inner)
            places = pa.array(np.cumsum(known) - 1, mask=~known)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], outer if known.all() else outer.take(places)], [*given, name])

    return run


def with_features(rows: DataFrame, config: DraftConfig, half_lives_days: list[float], k_pairs: list[float], name: str) -> DataFrame:
    """rows with name, the feature lists (FEATURES behind the anchor) of each half-life with each k_pair, in order; null
    without a draft. In blocks of time, in order inside each.

    rows: match_id, start_time, a, b, win, games_a, games_b and DRAFT (null, or a complete draft), and any others. Maps
    aren't taken apart by hero and pair: each block of time is one task, which reads its maps in order and keeps the
    sums of the keys it meets, beginning with what the blocks before hand over. So a map is shuffled twice, whatever the
    number of its pairs; besides, one row for each key and block.
    """
    halves, given = [d * 86400 for d in half_lives_days], rows.columns
    rows = materialize(rows.where("start_time IS NOT NULL"), "drafted-maps")
    cuts = blocks(rows, "start_time")
    starts = [cuts.first, *cuts.bounds]
    # written block by block, so that a batch has the keys of few blocks
    dealt = rows.withColumn("__block", cuts.of(F.col("start_time").cast("double")))
    laid = materialize(dealt.repartitionById(len(starts), F.col("__block")), "maps-in-blocks")
    local = laid.select("__block", "start_time", "a", "b", "win", "heroes_a", "heroes_b").mapInArrow(_summed(halves, starts), CARRIED)
    sums = F.array(*[F.sum(F.col("__sums")[i]) for i in range(2 * len(halves))]).alias("__sums")
    local = local.groupBy("__block", "__kind", "__x", "__y").agg(sums).repartition("__kind", "__x", "__y").sortWithinPartitions("__block", "__kind")
    came = local.mapInArrow(_handed(halves, starts), CARRIED)
    stream = laid.unionByName(came, allowMissingColumns=True).repartitionById(len(starts), F.col("__block")).sortWithinPartitions(F.col("__kind").isNull(), "start_time", "match_id")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.ArrayType(T.DoubleType())))])
    return stream.mapInArrow(_featured(config, halves, k_pairs, starts, given, name), schema)


FEATURES = ["anchor", "hero_diff", "team_hero_diff", "synergy_diff", "counter_sum", "first_action", "both_warm"]


class Combiner:
    """Online logistic regression with AdaGrad steps; starts as the anchor alone plus an intercept."""

    def __init__(self, intercept: float = 0.063, rate: float = 0.05):
        self.theta, self.squares, self.rate = [intercept, 1.0, *[0.0] * 6], [1.0] * 8, rate

    def predict(self, x) -> float:
        z = self.theta[0] + sum(w * v for w, v in zip(self.theta[1:], x, strict=False))
        return 1 / (1 + math.exp(-min(max(z, -35.0), 35.0)))

    def update(self, x, outcome: float, p: float) -> None:
        for j, v in enumerate([1.0, *x]):
            g = (p - outcome) * v
            self.squares[j] += g * g
            self.theta[j] -= self.rate / math.sqrt(self.squares[j] + 1e-4) * g

    def fold(self, wins: list, drafted: list, *x: list) -> list[float]:
        """Predictions before each map; predict and update written out, as this is the one loop that no other task can share."""
        exp, sqrt, rate, out = math.exp, math.sqrt, self.rate, []
        t0, t1, t2, t3, t4, t5, t6, t7 = self.theta
        s0, s1, s2, s3, s4, s5, s6, s7 = (v + 1e-4 for v in self.squares)
        for won, known, x1, x2, x3, x4, x5, x6, x7 in zip(wins, drafted, *x, strict=True):
            z = t0 + t1 * x1
            if known:
                z += t2 * x2 + t3 * x3 + t4 * x4 + t5 * x5 + t6 * x6 + t7 * x7
            p = 1 / (1 + exp(-z)) if -35 < z < 35 else 1 / (1 + exp(-min(max(z, -35.0), 35.0)))
            out.append(p)
            if not known:
                continue
            e = p - won
            g1, g2, g3, g4, g5, g6, g7 = e * x1, e * x2, e * x3, e * x4, e * x5, e * x6, e * x7
            s0 += e * e
            s1 += g1 * g1
            s2 += g2 * g2
            s3 += g3 * g3
            s4 += g4 * g4
            s5 += g5 * g5
            s6 += g6 * g6
            s7 += g7 * g7
            t0 -= rate / sqrt(s0) * e
            t1 -= rate / sqrt(s1) * g1
            t2 -= rate / sqrt(s2) * g2
            t3 -= rate / sqrt(s3) * g3
            t4 -= rate / sqrt(s4) * g4
            t5 -= rate / sqrt(s5) * g5
            t6 -= rate / sqrt(s6) * g6
            t7 -= rate / sqrt(s7) * g7
        self.theta, self.squares = [t0, t1, t2, t3, t4, t5, t6, t7], [v - 1e-4 for v in (s0, s1, s2, s3, s4, s5, s6, s7)]
        return out


#: Maps that travel to a fold as one row of lists, and such rows that it reads at once.
PACK, FOLDED = 64, 250
PREDICTED = "config_id int, match_id long, start_time long, win int, games_a long, games_b long, prob double, fallback boolean"
_SENT = {"match_id": "long", "start_time": "long", "win": "int", "games_a": "long", "games_b": "long", "prob": "double"}


def _listed(grids: list[tuple[str, int]]):
    """PACK maps at a time as one row of lists for each feature list (grid, place), with the first one's place in order."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.append(np.arange(0, batch.num_rows, PACK), batch.num_rows)
            offsets, heads = pa.array(cuts, pa.int32()), pa.array(cuts[:-1])
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in _SENT]
            at, id_ = batch.column("start_time").take(heads), batch.column("match_id").take(heads)
            held = {}
            for column in dict.fromkeys(g for g, _ in grids):
                known = np.array(batch.column(column).is_valid())
                values = batch.column(column).flatten().flatten().to_numpy(zero_copy_only=False)
                held[column] = known, values.reshape(int(known.sum()), -1, 6) if known.any() else np.zeros((0, 0, 6))
            for v, (column, place) in enumerate(grids):
                known, values = held[column]
                full = np.zeros((batch.num_rows, 6))
                if known.any():
                    full[known] = values[:, place]
                features = pa.ListArray.from_arrays(pa.array(cuts * 6, pa.int32()), pa.array(full.reshape(-1)))
                columns = [pa.array(np.full(len(heads), v), pa.int32()), at, id_, *lists, pa.ListArray.from_arrays(offsets, pa.array(known)), features]
                yield pa.RecordBatch.from_arrays(columns, ["list", "at", "id", *_SENT, "drafted", "features"])

    return run


def _combined(configs: dict, of_task: dict[int, list[int]]):
    def run(batches):
        models: dict[int, Combiner] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, FOLDED):
                batch = whole.slice(low, FOLDED)
                models = models or {k: Combiner(configs[k].initial_intercept, configs[k].learning_rate) for k in of_task[batch.column("task")[0].as_py()]}
                flat = {c: batch.column(c).flatten() for c in (*_SENT, "drafted", "features")}
                prob, known = flat["prob"].to_numpy(), flat["drafted"].to_numpy(zero_copy_only=False)
                sure = np.clip(prob, 1e-6, 1 - 1e-6)
                columns = [flat["win"].to_numpy().tolist(), known.tolist(), np.log(sure / (1 - sure)).tolist(), *flat["features"].to_numpy().reshape(-1, 6).T.tolist()]
                fallback = pa.array(~known)
                for k, model in models.items():
                    out = flat["prob"] if configs[k].disabled else pa.array(model.fold(*columns))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prob), k), pa.int32()), *[flat[c] for c in list(_SENT)[:-1]], out, fallback], [x.split()[0] for x in PREDICTED.split(", ")])

    return run


def combine(rows: DataFrame, configs: dict[int, DraftConfig], place: dict[int, tuple[str, int]]) -> DataFrame:
    """PREDICTED: the combiner's prediction before each map, folded in order, with what a score card needs.

    rows: match_id, start_time, win, games_a, games_b, prob (of the ratings) and the columns of with_features (null
    without a complete draft, where the anchor and the side alone predict and nothing is learnt), in its order; place
    says the column and list of each configuration. Configurations of one list share tasks, so that a map is sent once
    a list and task, in packs. Disabled: the ratings' prob as it is.
    """
    lists: dict[tuple[str, int], list[int]] = {}
    for k in sorted(configs):
        lists.setdefault(place[k], []).append(k)
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism // len(lists))
    of_task = dict(enumerate((v, ids[i::parts]) for v, ids in enumerate(lists.values()) for i in range(min(parts, len(ids)))))
    shape = "list int, at long, id long, " + ", ".join(f"{c} array<{t}>" for c, t in _SENT.items()) + ", drafted array<boolean>, features array<double>"
    packs = rows.select(*[F.col(c).cast(t).alias(c) for c, t in _SENT.items()], *dict.fromkeys(g for g, _ in lists)).mapInArrow(_listed(list(lists)), shape)
    tasks = [[t for t, (of, _) in of_task.items() if of == v] for v in range(len(lists))]
    sent = packs.select(F.explode(F.get(F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in tasks]), F.col("list"))).alias("task"), "*")
    dealt = sent.repartitionById(len(of_task), F.col("task")).sortWithinPartitions("task", "at", "id")
    return dealt.mapInArrow(_combined(configs, {t: ids for t, (_, ids) in of_task.items()}), PREDICTED)
