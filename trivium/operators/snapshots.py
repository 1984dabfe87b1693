"""A table in versions: rows by key, changed by compare-and-set, read as of any version.

Version n is what the manifest ``_versions/n`` lists: data folders in their
order, where rows of a later folder replace those of the same key, and the
state (``key``) that the table shows.  A writer first writes its rows into a
folder of their own and then creates the next manifest, which only one writer
can: a file that is there is never replaced.  Whoever comes second has lost and
leaves nothing but data that no manifest names.  Readers hold a version and are
not disturbed; folders are put together when there are too many of them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PARTS = 8


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    parts: tuple[str, ...]
    schema: str


class Snapshots:
    """Versions of one table under ``folder``, which all writers share; ``on`` names the columns of its key."""

    def __init__(self, spark: SparkSession, folder: str, on: list[str]):
        self.spark, self.folder, self.on = spark, folder.rstrip("/"), on
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_versions")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_versions"))]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version, the latest unless its number is given; None if there is none."""
        numbers = self._numbers()
        if number is None and not numbers:
            return None
        number = numbers[-1] if number is None else number
        stream = self._fs.open(self._path(f"_versions/{number:020d}"))
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, held["key"], tuple(held["parts"]), held["schema"])

    def _create(self, number: int, text: str) -> bool:
        """Create a manifest with its whole content; False if another writer has."""
        path = self._path(f"_versions/{number:020d}")
        if self._fs.getScheme() == "file":
            # The local file system of Hadoop looks and then creates; a link is made or not.
            place = path.toUri().getPath()
            draft = f"{os.path.dirname(place)}/.{uuid.uuid4().hex}"
            with open(draft, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, place)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as failure:
            if "AlreadyExists" in failure.java_exception.getClass().getName() or self._fs.exists(path):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _write(self, rows: DataFrame) -> str:
        part = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return part

    def _commit(self, number: int, key: str, parts: tuple[str, ...], schema: str) -> Version | None:
        return Version(number, key, parts, schema) if self._create(number, json.dumps({"key": key, "parts": parts, "schema": schema})) else None

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, the latest unless one is given."""
        version = version or self.version()
        if version is None:
            raise ValueError(f"{self.folder} has no version yet")
        parts = [self.spark.read.schema(version.schema).parquet(f"{self.folder}/{p}") for p in version.parts]
        if len(parts) == 1:
            return parts[0]
        columns = parts[0].columns
        rest = [c for c in columns if c not in self.on]
        rows = parts[0].withColumn("_part", F.lit(0))
        for i, p in enumerate(parts[1:], 1):
            rows = rows.unionByName(p.withColumn("_part", F.lit(i)))
        last = rows.groupBy(*self.on).agg(F.max_by(F.struct(*rest), "_part").alias("_row"))
        return last.select(*(F.col(c) if c in self.on else F.col(f"_row.{c}").alias(c) for c in columns))

    def rebuild(self, rows: DataFrame, key: str) -> Version:
        """The whole table anew as the next version, whatever others commit meanwhile."""
        part = self._write(rows)
        while True:
            numbers = self._numbers()
            done = self._commit((numbers[-1] if numbers else 0) + 1, key, (part,), _ddl(rows))
            if done:
                return done

    def apply(self, changed: DataFrame, expected: str, key: str) -> Version | None:
        """Put ``changed`` rows in, as of ``key``, if the table shows ``expected``; None if it does not or another writer was first."""
        held = self.version()
        if held is None or held.key != expected:
            return None
        parts = (*held.parts, self._write(changed.select(*self.spark.createDataFrame([], held.schema).columns)))
        if len(parts) > MOST_PARTS:
            parts = (self._write(self.read(Version(0, key, parts, held.schema))),)
        return self._commit(held.number + 1, key, parts, held.schema)

    def refresh(self, changed: DataFrame, expected: str, key: str, everything: Callable[[], DataFrame]) -> tuple[Version, bool]:
        """Apply, or rebuild from ``everything`` where the table is stale; the version, and whether it was rebuilt."""
        done = self.apply(changed, expected, key)
        return (done, False) if done else (self.rebuild(everything(), key), True)

    def get(self, rows: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows of the keys asked for; those that the table lacks are left out."""
        return self.read(version).join(rows.select(*self.on).distinct(), self.on, "left_semi")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the manifests of all but the last ``keep`` versions, and data that no version names and no writer can still name."""
        numbers = self._numbers()
        old = [self.version(n) for n in numbers[:-keep]]
        named = {p for n in numbers[-keep:] for p in self.version(n).parts}
        gone = sorted({p for v in old for p in v.parts} - named)
        for v in old:
            self._fs.delete(self._path(f"_versions/{v.number:020d}"), False)
        for p in gone:
            self._fs.delete(self._path(p), True)
        return gone


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
