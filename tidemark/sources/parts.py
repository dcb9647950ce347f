"""Tables dealt by key range, of which a merge rewrites only the parts that it touches.

A part holds the rows whose first key lies in one range of fixed width. A version writes new files for its parts beside
the old ones and then a manifest that names, for each part, the version that holds it; the manifest appears under its
number in one rename, so that readers see the table before or after a merge, never in between, and of two writers of one
version one fails. What a killed merge leaves is in no manifest.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import materialize


class Conflict(RuntimeError):
    """Another writer made this version first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Parts:
    """A table at path with a schema and keys; width is that of a part's range of the first key, which is a number."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], width: int):
        self.spark, self.path, self.schema, self.keys, self.width = spark, path, schema, keys, width

    def version(self) -> int:
        """The newest version, 0 for a table that isn't there."""
        at, fs = _fs(self.spark, f"{self.path}/_manifest")
        if not fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """part: the version that holds it."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/_manifest/{version:012d}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def part_of(self) -> Column:
        """The part of a row; rows without a first key are in part null."""
        return F.floor(F.col(self.keys[0]) / self.width).cast("long")

    def _folder(self, part: int, version: int) -> str:
        return f"{self.path}/v{version}/__part={part}"

    def read(self, parts: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The whole table, or some parts of it."""
        held = self.manifest(version)
        paths = [self._folder(p, v) for p, v in sorted(held.items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def between(self, low: int, high: int) -> DataFrame:
        """Rows whose first key is low or more and under high, from the parts that can hold them alone."""
        return self.read([p for p in self.manifest() if (p + 1) * self.width > low and p * self.width < high]).where((F.col(self.keys[0]) >= low) & (F.col(self.keys[0]) < high))

    def _commit(self, version: int, held: dict[int, int]) -> None:
        target, fs = _fs(self.spark, f"{self.path}/_manifest/{version:012d}.json")
        made, _ = _fs(self.spark, f"{self.path}/_manifest/_making-{version}")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps({str(k): v for k, v in held.items()}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, False)
            raise Conflict(f"version {version} of {self.path}")

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> list[int]:
        """Replace the parts that new's keys lie in by how(stored rows, new, keys); the parts that were written.

        Rows of new without a first key are left out. One job finds the parts, one writes them.
        """
        new = materialize(new.where(F.col(self.keys[0]).isNotNull()), "merge")
        touched = sorted(r[0] for r in new.select(self.part_of()).distinct().collect())
        if not touched:
            return []
        before = self.version()
        version = before + 1
        rows = how(self.read(touched, before), new, self.keys).select(*self.schema.names)
        # a task for each part, as each is one folder
        dealt = rows.withColumn("__part", self.part_of()).repartition(len(touched), "__part")
        dealt.write.mode("overwrite").partitionBy("__part").parquet(f"{self.path}/v{version}")
        self._commit(version, {**self.manifest(before), **dict.fromkeys(touched, version)})
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest versions names, and what killed merges left; their number."""
        newest = self.version()
        kept = {self._folder(p, v) for n in range(max(1, newest - keep + 1), newest + 1) for p, v in self.manifest(n).items()}
        top, fs = _fs(self.spark, self.path)
        gone = 0
        for folder in fs.listStatus(top) if fs.exists(top) else []:
            if folder.getPath().getName().startswith("v"):
                for part in fs.listStatus(folder.getPath()):
                    name = f"{self.path}/{folder.getPath().getName()}/{part.getPath().getName()}"
                    if name not in kept:
                        gone += bool(fs.delete(part.getPath(), True)) and part.isDirectory()
        for n in range(1, newest - keep + 1):
            at, _ = _fs(self.spark, f"{self.path}/_manifest/{n:012d}.json")
            fs.delete(at, False)
        return gone


#: Width of a part's range of the first key, by table; ids of matches grow by about a million a day.
WIDTHS = {"matches": 10_000_000, "draft_events": 10_000_000, "match_players": 10_000_000, "match_timeseries": 10_000_000, "teams": 1_000_000, "rosters": 1_000_000}


def is_parted(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, f"{path}/_manifest")
    return fs.exists(at)


def adopt(table: Parts, stored: DataFrame) -> None:
    """Take the rows of a plain table over as the first version."""
    if not table.version():
        table.merge(stored, lambda _none, new, _keys: new)
