"""Atomic publishing (A8, A10): snapshots behind a commit log.

A published table is a list of immutable folders ("segments") under
``<root>/snapshots``. What readers see is decided by ``<root>/commits`` alone: one
small JSON file a version, naming the segments of every table and what the writer
noted. A publisher writes its segments first and commits last:

* a reader of a version finds all its tables, old or new, never a mixture and never
  a half-written folder;
* a job that fails leaves no commit, so readers keep the version before, and its
  folders are swept up later (``expire``);
* a commit file is renamed into place, and never over another: of two publishers
  that started from one version the second fails (``Conflict``) and nothing is lost.

Segments are written in parallel by Spark; only the commit files, a few hundred bytes
each, pass through the driver. The rename must be atomic, as it is on HDFS and local
folders.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .scratch import shuffles_released
from .sinks import write_marts

DIGITS = 12


class Conflict(RuntimeError):
    """Another publisher committed first."""


@dataclass(frozen=True)
class Version:
    """One commit: ``tables`` maps a name to its segment folders, ``notes`` is the
    writer's own record (such as the last batch that it merged)."""
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


class Publication:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._commits = self._path("commits")
        self._fs = self._commits.getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    # -- reading ---------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        if not self._fs.exists(self._commits):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._commits)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version:
        """A version (default: the newest; version 0 is the empty one before any)."""
        if number is None:
            number = max(self.versions(), default=0)
        if number == 0:
            return Version()
        stream = self._fs.open(self._path(f"commits/{number:0{DIGITS}}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def folders(self, name: str, number: int | None = None) -> list[str]:
        tables = self.version(number).tables
        if name not in tables:
            raise KeyError(f"{name} is not published under {self.root}")
        return [f"{self.root}/{segment}" for segment in tables[name]]

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A published table: the union of its segments."""
        first, *rest = (self.spark.read.parquet(folder) for folder in self.folders(name, number))
        for segment in rest:
            first = first.unionByName(segment)
        return first

    # -- writing ---------------------------------------------------------------------

    def write(self, tables: dict[str, DataFrame], by_month: dict[str, str] | None = None,
              by: dict[str, str] | None = None) -> dict[str, list[str]]:
        """Write each table to a new segment (``by``: those named, partitioned by a
        column). Nobody sees it before ``commit``."""
        snapshot = f"snapshots/{int(time.time() * 1000):015}-{uuid.uuid4().hex}"
        by = {name: column for name, column in (by or {}).items() if name in tables}
        write_marts({n: df for n, df in tables.items() if n not in by}, f"{self.root}/{snapshot}", mode="error", by_month=by_month)
        for name, column in by.items():
            folder = f"{snapshot}/{name}"
            with shuffles_released(self.spark):
                tables[name].write.partitionBy(column).parquet(f"{self.root}/{folder}")
            if not any(s.isDirectory() for s in self._fs.listStatus(self._path(folder))):
                # No rows, no folders, and no file that tells the columns: write one.
                self.spark.createDataFrame([], tables[name].schema).write.mode("overwrite").parquet(f"{self.root}/{folder}")
        return {name: [f"{snapshot}/{name}"] for name in tables}

    def commit(self, base: Version, replaced: dict[str, list[str]] | None = None,
               appended: dict[str, list[str]] | None = None, notes: dict | None = None) -> Version:
        """Publish ``base`` with some tables replaced and others extended, as the next
        version; raises ``Conflict`` if that is taken."""
        tables = base.tables | (replaced or {})
        for name, segments in (appended or {}).items():
            tables = tables | {name: tables.get(name, []) + segments}
        new = Version(base.number + 1, tables, base.notes | (notes or {}))
        self._fs.mkdirs(self._commits)
        draft = self._path(f"commits/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"tables": new.tables, "notes": new.notes}).encode()))
        finally:
            out.close()
        files = self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf)
        none = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        final = self._path(f"commits/{new.number:0{DIGITS}}.json")
        try:
            files.rename(draft, final, none)  # fails if the target is there
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {new.number} of {self.root} is already committed") from e
            raise
        return new

    def publish(self, tables: dict[str, DataFrame], by_month: dict[str, str] | None = None, notes: dict | None = None) -> Version:
        """Replace tables, all at one instant. Others keep their segments."""
        base = self.version()
        return self.commit(base, replaced=self.write(tables, by_month), notes=notes)

    def expire(self, keep: int = 2, grace_seconds: float = 24 * 3600) -> list[str]:
        """Delete what no reader needs: all commits but the newest ``keep``, and
        snapshots that those do not name and that are older than the grace period
        (younger ones may belong to a publisher at work). Returns the snapshots."""
        numbers = self.versions()
        live = {segment.split("/")[1] for n in numbers[-keep:] for s in self.version(n).tables.values() for segment in s}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"commits/{n:0{DIGITS}}.json"), False)
        top, gone = self._path("snapshots"), []
        before = int((time.time() - grace_seconds) * 1000)
        for status in self._fs.listStatus(top) if self._fs.exists(top) else []:
            name = status.getPath().getName()
            if name not in live and int(name.split("-")[0]) < before:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)


def store_published_views(publication: Publication, names, number: int | None = None) -> Version:
    """A8, stored: point catalog views at one version's segments, the last step of a
    publication. Each view is replaced by itself; until then it reads the version
    before, whose folders stay until ``expire``."""
    version = publication.version(number)
    for name in names:
        folders = (f"{publication.root}/{segment}".replace("`", "``") for segment in version.tables[name])
        parts = (f"SELECT * FROM parquet.`{folder}`" for folder in folders)
        publication.spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS {' UNION ALL '.join(parts)}")
    return version
