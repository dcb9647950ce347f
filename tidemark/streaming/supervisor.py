"""The recorder's policy: one streaming query for each source, so that one that fails doesn't stop another."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.polls import Source
from ..sources.shared import materialize
from ..sources.writers import ARCHIVED, archive, archived, compacted, should_archive
from .recorder import Recorder, poll_interval

log = logging.getLogger(__name__)


class Ended(StreamingQueryListener):
    """Collects the names of queries that an error ended, so that they are started again."""

    def __init__(self):
        self.names, self.failed = {}, []

    def onQueryStarted(self, event):  # noqa: N802
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event):  # noqa: N802
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        if event.exception:
            self.failed.append(self.names.get(str(event.id)))


class Supervisor:
    """Polls sources and stores what changed.

    Each source is a streaming query of clock ticks; a tick polls if the source is due: live_s seconds after its last
    poll if any of its quotes was live, else idle_s. A poll that fails is logged and makes no rows and no tombstones. A
    payload is archived if it changed anything, and else once every heartbeat_s seconds; when it was archived last is
    what the archive itself says, so that a restart goes on with it. A query that an error in storing ends is started
    again; stop() lets polls that run come to their end. Polls are read side by side and stored one by one.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, Source], recorder: Recorder, archive_root: str | None = None, idle_s: int = 60, live_s: int = 20, heartbeat_s: int = 3600, clock: Callable[[], float] = time.time):
        self.spark, self.sources, self.recorder, self.archive_root = spark, sources, recorder, archive_root
        self.idle_s, self.live_s, self.heartbeat_s, self.clock = idle_s, live_s, heartbeat_s, clock
        self.due, self.reports, self.stopping = dict.fromkeys(sources, 0.0), {n: [] for n in sources}, threading.Event()
        self.storing, self.polling = threading.Lock(), {n: threading.Lock() for n in sources}

    def last_archived(self, name: str) -> int | None:
        newest = archived(self.spark, self.archive_root, name).agg(F.max("captured_at")).first()[0]
        known = compacted(self.spark, self.archive_root, "payloads", ARCHIVED).where(F.col("source") == name)
        return newest if newest is not None else known.agg(F.max("captured_at")).first()[0]

    def poll(self, name: str) -> dict | None:
        """One poll of a source: what it stored, or None if it failed."""
        source, now = self.sources[name], self.clock()
        self.due[name] = now + self.idle_s
        try:
            got = materialize(source.poll(), "poll")
            at = got.first().captured_at
            quotes = materialize(source.quotes(got), "poll-quotes")
            live = bool(quotes.where("is_live = 1").take(1))
        except Exception as e:
            log.warning("poll of %s failed: %s", name, e)
            return None
        with self.storing:
            written, gone = self.recorder.poll(source.name, at, quotes, prefix=source.many)
            if self.archive_root and should_archive(written + gone, self.last_archived(source.name), at, self.heartbeat_s):
                archive(got, self.archive_root)
        self.due[name] = now + poll_interval(live, self.idle_s, self.live_s)
        report = {"at": at, "written": written, "gone": gone, "live": live}
        self.reports[name].append(report)
        log.info("%s: %s", name, report)
        return report

    def once(self) -> dict[str, dict | None]:
        return {name: self.poll(name) for name in self.sources}

    def _tick(self, name: str):
        def run(_batch: DataFrame, _epoch: int) -> None:
            with self.polling[name]:
                if not self.stopping.is_set() and self.clock() >= self.due[name]:
                    self.poll(name)

        return run

    def start(self, name: str, checkpoint: str):
        """The streaming query of a source; its checkpoint holds ticks alone, tables hold all else."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        beat = max(1, min(self.idle_s, self.live_s) // 4)
        return ticks.writeStream.foreachBatch(self._tick(name)).queryName(f"recorder-{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(processingTime=f"{beat} seconds").start()

    def run(self, checkpoint: str, wait_s: float = 1.0) -> None:
        """Until stop(): all sources, each started again if its query ends with an error."""
        ended = Ended()
        self.spark.streams.addListener(ended)
        running = {name: self.start(name, checkpoint) for name in self.sources}
        try:
            while not self.stopping.wait(wait_s):
                for name, query in running.items():
                    if not query.isActive and not self.stopping.is_set():
                        log.warning("%s ended (%s) and is started again", name, query.exception())
                        running[name] = self.start(name, checkpoint)
        finally:
            for name, query in running.items():
                with self.polling[name]:
                    query.stop()
            self.spark.streams.removeListener(ended)

    def stop(self, *_signal) -> None:
        """To be called from any thread, or as the handler of a signal."""
        self.stopping.set()
