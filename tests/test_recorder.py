import pytest
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.streaming import recorder

SHAPE = "source string, line_key string, captured_at long, id long, price double, status string"
KEYS, ORDER = ["source", "line_key"], ["captured_at", "id"]


def test_changes_in_many_batches_equal_one(spark, tmp_path):
    rows = [("s", f"l{k}", t, t * 10 + k, [1.5, None, 1.5, float(t // 3)][(t + k) % 4], ["open", None][t % 7 == 0]) for t in range(24) for k in range(5)]
    want = history.changes(spark.createDataFrame(rows, SHAPE), KEYS, ORDER, ["price", "status"]).collect()
    for t in range(0, 24, 4):
        spark.createDataFrame([r for r in rows if t <= r[2] < t + 4], SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = recorder.stream_changes(stream, KEYS, ORDER, ["price", "status"])
    q = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 5
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == sorted(map(tuple, want), key=str)


def test_recorded_stream_equals_history(spark, tmp_path):
    """Lines that vanish and return, a poll that sees nothing, two rows of one line in a poll, several batches."""
    polls = {t: [("s", f"l{k}", t, k, 1.0 + (t // 3) % 2, "open") for k in range(6) if (t * (k + 2)) % 5 or k == 0] for t in range(1, 13)}
    polls[7] = []
    polls[9].append(("s", "l0", 9, 99, 7.0, "open"))
    rows = [r for p in polls.values() for r in p]
    times = spark.createDataFrame([("s", t) for t in polls], "source string, captured_at long")
    want = history.history(spark.createDataFrame(rows, SHAPE), times, tracked=["price", "status"], cleared=["price"], order=["captured_at", "id"])
    for low in (1, 4, 8):
        part = [x for t, p in polls.items() if low <= t < {1: 4, 4: 8, 8: 13}[low] for x in [*p, ("s", None, t, None, None, None)]]
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = recorder.recorded_stream(stream, ["price", "status"], ["price"], order=["id"], shards=3)
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want.collect()), key=str) and any(r.status == "gone" for r in got)


class Stop(Exception):
    pass


@pytest.mark.parametrize("where", ["write", "after write", "keep"])
def test_a_stop_between_the_tables_stores_no_row_twice(spark, tmp_path, where):
    paths = {"latest": f"{tmp_path}/latest", "all": f"{tmp_path}/all"}
    for p in paths.values():
        spark.createDataFrame([], SHAPE).write.parquet(p)
    fail = {"at": None}

    def write(df):
        if fail["at"] == "write":
            df.where("line_key = 'b'").write.mode("append").parquet(paths["all"])
            raise Stop
        df.write.mode("append").parquet(paths["all"])
        if fail["at"] == "after write":
            raise Stop

    def keep(df):
        if fail["at"] == "keep":
            raise Stop
        rows = df.collect()
        spark.createDataFrame(rows, SHAPE).write.mode("overwrite").parquet(paths["latest"])

    read = lambda name: lambda: spark.read.schema(SHAPE).parquet(paths[name])
    new = lambda: recorder.Recorder(read("latest"), write, KEYS, ["price", "status"], ["price"], ORDER, keep, f"{tmp_path}/journal", read("all"))
    first = spark.createDataFrame([("s", "a", 1, None, 1.5, "open"), ("s", "b", 1, None, 2.0, "open")], SHAPE)
    fail["at"] = where
    with pytest.raises(Stop):
        new()(first, 0)
    fail["at"] = None
    sink = new()
    sink(first, 0)  # the same batch again, by a new process
    sink(spark.createDataFrame([("s", "a", 2, None, 1.5, "open")], SHAPE), 1)
    stored = sorted((r.id, r.line_key, r.captured_at, r.status) for r in read("all")().collect())
    assert stored == [(1, "a", 1, "open"), (2, "b", 1, "open"), (3, "b", 2, "gone")]
    assert {(r.line_key, r.id) for r in read("latest")().collect()} == {("a", 1), ("b", 3)}


def test_an_empty_poll_of_an_aggregator(spark):
    held = {"all": spark.createDataFrame([("agg:x", "a", 1, 1, 1.5, "open"), ("AGG:y", "b", 1, 2, 2.0, "open"), ("other", "c", 1, 3, 2.0, "open")], SHAPE)}
    put = lambda df: held.update(all=spark.createDataFrame([*held["all"].collect(), *df.collect()], SHAPE))
    sink = recorder.Recorder(lambda: held["all"], put, KEYS, ["price", "status"], ["price"], ORDER)
    assert sink.poll("agg", 2, held["all"].limit(0), prefix=True) == (0, 2) and sink.poll("agg", 3, held["all"].limit(0), prefix=True) == (0, 0)
    assert {r.line_key for r in held["all"].where(F.col("status") == "gone").collect()} == {"a", "b"}
