import os

import pytest

from tidemark import cli
from tidemark.schemas import TABLES
from tidemark.sources import parts, readers
from tidemark.sources.writers import upsert_coalesce, upsert_replace

SHAPE = "k long, n int, v string"


def table(spark, path):
    return parts.Parts(spark, path, spark.createDataFrame([], SHAPE).schema, ["k", "n"], 100)


def rows_of(t, **how):
    return sorted(map(tuple, t.read(**how).collect()))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_only_touched_parts_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    t = table(spark, path)
    assert rows_of(t) == [] and t.version() == 0
    rows = {(k, n): f"old value {k}" for k in range(-200, 9800, 2) for n in (0, 1)}
    t.merge(spark.createDataFrame([(k, n, v) for (k, n), v in rows.items()], SHAPE), upsert_replace)
    whole = size(path)
    new = {(k, 0): "new" for k in range(3000, 3100)}
    assert t.merge(spark.createDataFrame([*[(k, n, v) for (k, n), v in new.items()], (None, 0, "no key")], SHAPE), upsert_replace) == [30]
    assert size(f"{path}/v2") < 0.03 * whole
    assert rows_of(t) == sorted((k, n, v) for (k, n), v in {**rows, **new}.items())
    assert rows_of(t, version=1) == sorted((k, n, v) for (k, n), v in rows.items())
    near = t.between(2990, 3010)
    assert sorted({r.k for r in near.collect()}) == [*range(2990, 3000, 2), *range(3000, 3010)] and len({f.split("__part=")[1].split("/")[0] for f in near.inputFiles()}) == 2
    assert t.merge(t.read().limit(0), upsert_replace) == [] and t.version() == 2


def test_a_killed_merge_leaves_the_table(spark, tmp_path, monkeypatch):
    t = table(spark, f"{tmp_path}/t")
    t.merge(spark.createDataFrame([(1, 0, "a"), (250, 0, "b")], SHAPE), upsert_replace)
    with monkeypatch.context() as m:
        m.setattr(parts.Parts, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.merge(spark.createDataFrame([(1, 0, "lost"), (900, 0, "lost")], SHAPE), upsert_replace)
    assert rows_of(t) == [(1, 0, "a"), (250, 0, "b")] and t.version() == 1
    t.merge(spark.createDataFrame([(1, 0, None), (1, 1, "c")], SHAPE), upsert_coalesce)
    assert rows_of(t) == [(1, 0, "a"), (1, 1, "c"), (250, 0, "b")]
    t.merge(spark.createDataFrame([(1, 0, "d")], SHAPE), upsert_replace)
    assert t.vacuum(keep=1) >= 2 and rows_of(t) == [(1, 0, "d"), (1, 1, "c"), (250, 0, "b")]


def test_two_writers_of_one_version(spark, tmp_path):
    t = table(spark, f"{tmp_path}/t")
    t.merge(spark.createDataFrame([(1, 0, "a")], SHAPE), upsert_replace)
    with pytest.raises(parts.Conflict):
        t._commit(1, {})
    assert rows_of(t) == [(1, 0, "a")]


def test_commands_merge_in_parts_and_adopt_plain_tables(spark, tmp_path):
    root = str(tmp_path)
    shape = TABLES["teams"]
    spark.createDataFrame([(1, "old", 5), (2_000_000, "far", 5)], shape).write.parquet(f"{root}/teams")
    cli.merge(spark, root, {"teams": spark.createDataFrame([(1, "new", 6)], shape)})
    assert sorted(map(tuple, readers.table(spark, root, "teams").collect())) == [(1, "new", 6), (2_000_000, "far", 5)]
    assert parts.Parts(spark, f"{root}/teams", shape, ["team_id"], 1_000_000).manifest() == {0: 2, 2: 1}
