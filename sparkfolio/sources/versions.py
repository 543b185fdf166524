"""State that survives runs: versioned manifests, and tables by date on top of them.

A manifest is one small JSON file for each version in a folder.  A new version is written aside and moved to its name only if
nothing is there, so of two writers that start from one version one fails, and a reader sees a whole version or the one
before.  A table's data lie in folders of their own; what counts is what the last version names.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Manifest:
    """Versions of a JSON state in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self._conf)

    def names(self, path: str) -> list[str]:
        """Names in a folder, none where it is missing."""
        fs = self._fs()
        return sorted(x.getPath().getName() for x in fs.listStatus(self._at(path))) if fs.exists(self._at(path)) else []

    def remove(self, path: str) -> None:
        self._fs().delete(self._at(path), True)

    def version(self) -> int:
        """The last version; 0 before the first."""
        found = [int(n[1:-5]) for n in self.names(f"{self.path}/versions") if n.startswith("v") and n.endswith(".json")]
        return max(found, default=0)

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version (the last if none is given) and its state; empty before the first."""
        version = self.version() if version is None else version
        if not version:
            return 0, {}
        stream = self._fs().open(self._at(f"{self.path}/versions/v{version:012d}.json"))
        try:
            return version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, expected: int, state: dict) -> int:
        """Make ``state`` the version after ``expected``, or fail with :class:`Conflict` if there is one already."""
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        out = self._fs().create(self._at(aside), False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        self._fs().mkdirs(self._at(f"{self.path}/versions"))
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(aside).toUri() if ":" in aside else self._fs().getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs().makeQualified(self._at(aside)), self._fs().makeQualified(self._at(f"{self.path}/versions/v{expected + 1:012d}.json")), none)
        except Exception as e:
            self.remove(aside)
            if self.version() > expected:
                raise Conflict(f"version {expected + 1} is there already") from e
            raise
        return expected + 1


class DatedTable:
    """A table with a folder for each date, whose rows of a date are replaced as a whole or not at all.

    Its manifest names each date's folder.  A write makes new folders and then a new version; a crash between leaves folders
    that nothing names, which :meth:`vacuum` removes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, date: str = "date"):
        self.spark, self.path, self.schema, self.date = spark, path.rstrip("/"), schema, date
        self.manifest = Manifest(spark, path)

    def dates(self) -> list[dt.date]:
        return [dt.date.fromisoformat(d) for d in sorted(self.manifest.read()[1].get("dates", {}))]

    def last(self) -> dt.date | None:
        """The last date that has rows."""
        return max(self.dates(), default=None)

    def read(self, since: dt.date | None = None, until: dt.date | None = None, dates: Iterable[dt.date] | None = None) -> DataFrame:
        """Rows of some dates (all if nothing is said): only their folders are opened."""
        named = self.manifest.read()[1].get("dates", {})
        wanted = None if dates is None else {d.isoformat() for d in dates}
        at = [f for d, f in sorted(named.items()) if (since is None or d >= since.isoformat()) and (until is None or d <= until.isoformat()) and (wanted is None or d in wanted)]
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in at])

    def replace(self, rows: DataFrame) -> list[dt.date]:
        """Replace the dates that ``rows`` holds by its rows, in one new version; gives these dates."""
        version, state = self.manifest.read()
        batch = f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        dealt = rows.select(*columns).withColumn("_day", F.date_format(self.date, "yyyy-MM-dd")).repartition("_day")
        dealt.write.partitionBy("_day").parquet(f"{self.path}/{batch}")
        new = {n[5:]: f"{batch}/{n}" for n in self.manifest.names(f"{self.path}/{batch}") if n.startswith("_day=")}
        self.manifest.commit(version, state | {"dates": state.get("dates", {}) | new})
        return [dt.date.fromisoformat(d) for d in sorted(new)]

    def upsert(self, rows: DataFrame, keys: list[str]) -> list[dt.date]:
        """Put rows in, of one key the new one wins; only dates with new rows are read and written."""
        touched = [r[0] for r in rows.select(self.date).distinct().collect()]  # dates of one run
        if not touched:
            return []
        old = self.read(dates=touched).join(rows.select(*keys), keys, "left_anti")
        return self.replace(old.unionByName(rows.select(*old.columns)))

    def drop(self, dates: Iterable[dt.date]) -> list[dt.date]:
        """Take dates out of the table, in one new version; their folders stay until :meth:`vacuum`."""
        version, state = self.manifest.read()
        named = state.get("dates", {})
        gone = {d.isoformat() for d in dates} & set(named)
        if gone:
            self.manifest.commit(version, state | {"dates": {d: f for d, f in named.items() if d not in gone}})
        return [dt.date.fromisoformat(d) for d in sorted(gone)]

    def vacuum(self) -> list[str]:
        """Remove folders that the last version does not name; it may be repeated, and a crash only leaves it work."""
        named = set(self.manifest.read()[1].get("dates", {}).values())
        gone = []
        for batch in self.manifest.names(f"{self.path}/data"):
            here = [f"data/{batch}/{n}" for n in self.manifest.names(f"{self.path}/data/{batch}") if n.startswith("_day=")]
            unnamed = [f for f in here if f not in named]
            for f in unnamed:
                self.manifest.remove(f"{self.path}/{f}")
            if len(unnamed) == len(here):
                self.manifest.remove(f"{self.path}/data/{batch}")
            gone += unnamed
        return gone
