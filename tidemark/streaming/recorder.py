"""The recorder as a stream: change detection by keyed state, tombstones and storage by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import GONE, append_changes, latest, of_source, tombstones
from ..sources.shared import delete, materialize
from ..sources.writers import with_ids

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first_null(row, names) -> tuple:
    """A sort key by columns, nulls first."""
    return tuple((row[c] is not None, row[c]) if row[c] is not None else (False,) for c in names)


class _Changes(StatefulProcessor):
    """Rows of a line that differ from the row before; the state is the line's last tracked values."""

    def __init__(self, state: T.StructType, order: list[str]):
        self.state, self.order = state, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = self.state.names
        before = tuple(self.last.get()) if self.last.exists() else None
        for row in sorted(rows, key=lambda r: _first_null(r, self.order)):
            now = tuple(row[c] for c in names)
            if now != before:
                yield row
            before = now
        self.last.update(before)

    def close(self) -> None:
        pass


def _with_state(stream: DataFrame) -> None:
    """Typed state needs the store that keeps it on disk; queries that run already keep theirs."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def stream_changes(stream: DataFrame, keys: list[str], order: list[str], tracked: list[str]) -> DataFrame:
    """Changed rows of a stream, as history.changes gives for the same rows in one batch.

    State is the last tracked values of each line. Rows of a line must arrive in order from batch to batch (polls do);
    within a batch they are sorted. Nothing is late and no watermark applies, unless the caller sets one before.
    """
    _with_state(stream)
    state = T.StructType([stream.schema[c] for c in tracked])
    return stream.groupBy(*keys).transformWithState(_Changes(state, order), stream.schema, "append", "none")


class _Recorded(StatefulProcessor):
    """Changes and tombstones of a share of a source's lines; the state is each line's last row, when it was seen, and
    whether it was gone since."""

    def __init__(self, shape: T.StructType, tracked: list[str], cleared: list[str], key: str, at: str, order: list[str]):
        self.shape, self.tracked, self.cleared, self.key, self.at, self.order = shape, tracked, cleared, key, at, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([self.shape[self.key]])
        value = T.StructType([*self.shape.fields, T.StructField("__gone", T.BooleanType())])
        self.lines = handle.getMapState("lines", key, value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = self.shape.names
        known = {k[0]: Row(*names, "__gone")(*v) for k, v in self.lines.iterator()}
        moved = set()
        rows = sorted(rows, key=lambda r: (r[self.at], r[self.key] is None, _first_null(r, self.order)))
        for i, row in enumerate(rows):
            line = row[self.key]
            if line is None:
                for other, last in known.items():
                    if not last["__gone"] and last[self.at] < row[self.at]:
                        known[other] = last = Row(*names, "__gone")(*(last[c] for c in names), True)
                        moved.add(other)
                        yield Row(*names)(*(row[self.at] if c == self.at else GONE if c == "status" else None if c in self.cleared else last[c] for c in names))
                continue
            after = rows[i + 1] if i + 1 < len(rows) else None
            if after is not None and after[self.key] == line and after[self.at] == row[self.at]:
                continue  # the last row of a line in a poll counts
            last = known.get(line)
            if last is None or last["__gone"] or any(last[c] != row[c] for c in self.tracked):
                yield Row(*names)(*(row[c] for c in names))
            known[line] = Row(*names, "__gone")(*(row[c] for c in names), False)
            moved.add(line)
        for line in moved:
            self.lines.updateValue((line,), tuple(known[line]))

    def close(self) -> None:
        pass


def recorded_stream(stream: DataFrame, tracked: list[str], cleared: list[str], key: str = "line_key", source: str = "source", at: str = "captured_at", order: list[str] | None = None, shards: int = 16) -> DataFrame:
    """All rows that a recorder writes, as history.history gives for the same polls in one batch.

    stream holds whole successful polls: a row for each line, and one with a null key (the poll's mark, which says that
    all its rows are there). A mark makes tombstones of the lines that its poll didn't see; a poll without one makes
    none. A poll's rows and mark must not come in a batch after a later poll's. A source's lines are dealt to shards by
    hash and marks go to each, so that one source is many tasks; a task holds the last rows of its share of lines.
    """
    _with_state(stream)
    shard = F.when(F.col(key).isNull(), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")))
    dealt = stream.withColumn("__shard", F.explode(shard))
    # by line before by order, so that rows of one line and poll are neighbours
    found = _Recorded(stream.schema, tracked, cleared, key, at, [key, *(order or [])])
    return dealt.groupBy(source, "__shard").transformWithState(found, stream.schema, "append", "none")


class Recorder:
    """foreachBatch sink that stores each poll: changed quotes first, then tombstones of lines that it no longer sees.

    read and write give and append the stored table. A batch is one or more whole successful polls (source,
    captured_at), taken in order; a failed poll makes no rows and so no tombstones. A batch that comes again is safe:
    polls not after the newest stored capture of their source are skipped.

    With keep, a function that replaces the table of each line's last row, read need only give that table: a poll then
    costs as much as there are lines, not as there is history. New rows are numbered on from the largest id.

    With journal, a path, the rows of a poll are written there before they are appended and replaced only when the last
    rows are kept: whatever a stop cuts short, the next call appends those of its rows that history() lacks, by id, and
    keeps them, so that no row is stored twice or lost between the two tables. It needs ids, keep and history.
    """

    def __init__(self, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], tracked: list[str], cleared: list[str], order: list[str], keep: Callable[[DataFrame], None] | None = None, journal: str | None = None, history: Callable[[], DataFrame] | None = None):
        self.read, self.write, self.keys, self.tracked, self.cleared, self.order, self.keep = read, write, keys, tracked, cleared, order, keep
        self.journal, self.history = journal, history
        if journal and not (keep and history):
            raise ValueError("a journal needs keep and history")

    def recover(self, spark: SparkSession) -> None:
        """Finish the poll that a stop cut short, if there is one."""
        if not self.journal:
            return
        table = self.read()
        try:
            rows = spark.read.schema(table.schema).parquet(f"{self.journal}/rows")
            whole = spark.read.text(f"{self.journal}/whole").take(1)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return delete(spark, self.journal)  # its rows weren't complete, so nothing was stored
        if whole:
            low, high = rows.agg(F.min("id"), F.max("id")).first()
            if low is not None:
                have = self.history().where(F.col("id").between(low, high)).select("id")
                lost = materialize(rows.join(have, "id", "left_anti").select(*table.columns), "poll-lost")
                if lost.take(1):
                    self.write(lost)
                self.keep(latest(table.unionByName(rows), self.keys, self.order))
        delete(spark, self.journal)

    def _store(self, table: DataFrame, new: DataFrame) -> None:
        spark = table.sparkSession
        if self.journal:
            new.write.mode("overwrite").parquet(f"{self.journal}/rows")
            spark.range(1).selectExpr("'whole' AS value").coalesce(1).write.mode("overwrite").text(f"{self.journal}/whole")
        self.write(new)
        if self.keep is not None:
            self.keep(latest(table.unionByName(new), self.keys, self.order))
        if self.journal:
            delete(spark, self.journal)

    def poll(self, source: str, at: int, seen: DataFrame, prefix: bool = False) -> tuple[int, int]:
        """Store one successful poll, which may be empty: (changed rows, tombstones). With prefix it is one of all sources
        that begin with source, as an aggregator's are, and lines of any of them that it lacks are gone."""
        self.recover(seen.sparkSession)
        table = self.read()
        stored = table.where(of_source(source) if prefix else F.col("source") == source)
        newest = stored.agg(F.max("captured_at")).first()[0]
        if newest is not None and at <= newest:
            return 0, 0
        written, _ = append_changes(stored, seen, self.keys, self.tracked, self.order)
        gone = tombstones(stored, seen, self.keys, self.order, F.lit(at).cast(stored.schema["captured_at"].dataType), self.cleared)
        new = materialize(written.select(*stored.columns).union(gone), "poll")
        n, lost = new.agg(F.count("*"), F.count_if(F.col("status").eqNullSafe(GONE))).first()
        if not n:
            return 0, 0
        if "id" in new.columns:
            most = table.agg(F.max("id")).first()[0] or 0
            new = materialize(with_ids(new.drop("id"), most, ["source", "line_key"]).select(*stored.columns), "poll-rows")
        self._store(table, new)
        return n - lost, lost

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self.recover(batch.sparkSession)
        for p in batch.select("source", "captured_at").distinct().orderBy("captured_at", "source").collect():
            self.poll(p.source, p.captured_at, batch.where((F.col("source") == p.source) & (F.col("captured_at") == p.captured_at)))


def run(stream: DataFrame, recorder: Recorder, checkpoint: str, interval_s: int | None = None):
    """A started query: once over what is there, or every interval_s seconds until it is stopped."""
    writer = stream.writeStream.foreachBatch(recorder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval_s is None else writer.trigger(processingTime=f"{interval_s} seconds")).start()


def poll_interval(any_live: bool, idle_s: int = 60, live_s: int = 20) -> int:
    return live_s if any_live else idle_s
