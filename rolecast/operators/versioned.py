"""Keyed tables in the shared folder that change part by part and switch in one step.

A row's part follows from its key.  A change reads and writes only the parts that its
keys fall into; the new files go to a folder of their own, and one small manifest names
the version of every part.  Readers follow the newest manifest, so a writer that dies
before it leaves the table as it was, and one that finds a manifest of its number
already there (a second writer) fails instead of overwriting it.

A stream gives its batch number along.  The manifest keeps the last one, so a batch that
is run again after it was written changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "_part"
#: Manifests that stay readable; files that none of them names are removed.
KEPT = 2


class ConcurrentWrite(RuntimeError):
    """Another writer has written the version that this one was about to write."""


class PartTable:
    """A table of ``schema`` at ``path``, dealt into ``parts`` by ``keys`` (or by ``part``, an int column expression)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], parts: int = 64, part: Column | None = None):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, keys, parts
        self._part = part

    # ---------------------------------------------------------------- manifests

    def _hadoop(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder, files = self._hadoop("manifest")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, parts: {part: folder of its files}, batch, facts}; the newest, or the empty table's."""
        numbers = self._numbers()
        if version is None and not numbers:
            return {"version": 0, "of": self.parts, "parts": {}, "batch": -1, "facts": {}}
        path, files = self._hadoop("manifest", f"v={numbers[-1] if version is None else version}.json")
        stream = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["of"] != self.parts:
            raise ValueError(f"{self.path} has {found['of']} parts, not {self.parts}")
        return found

    def _switch(self, manifest: dict) -> None:
        """Written beside, then renamed, which a file system refuses if the name is taken."""
        draft, files = self._hadoop("manifest", f".{manifest['version']}-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        final, _ = self._hadoop("manifest", f"v={manifest['version']}.json")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise ConcurrentWrite(str(final))

    def _sweep(self) -> None:
        numbers = self._numbers()
        kept = [self.manifest(n) for n in numbers[-KEPT:]]
        named = {v for m in kept for v in m["parts"].values()}
        for n in numbers[:-KEPT]:
            path, files = self._hadoop("manifest", f"v={n}.json")
            files.delete(path, False)
        folder, files = self._hadoop("data")
        if files.exists(folder):
            for status in files.listStatus(folder):
                name = status.getPath().getName()
                # What a newer number names may be another writer's, who is not done.
                if name not in named and int(name[2:].partition("-")[0]) < numbers[-1]:
                    files.delete(status.getPath(), True)

    # ------------------------------------------------------------------ reading

    def with_part(self, df: DataFrame) -> DataFrame:
        part = self._part if self._part is not None else F.pmod(F.xxhash64(*self.keys), F.lit(self.parts))
        return df.withColumn(PART, part.cast("int"))

    def _files(self, manifest: dict, parts: list[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{v}/{PART}={p}" for p, v in manifest["parts"].items() if parts is None or int(p) in parts]

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        files = self._files(manifest, parts)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def near(self, keyed: DataFrame) -> DataFrame:
        """The stored rows of the parts that hold keys of ``keyed``, and no other part's files.

        At most ``parts`` small numbers come to the driver.
        """
        manifest = self.manifest()
        if not manifest["parts"]:
            return self._read(manifest)
        return self._read(manifest, [r[0] for r in self.with_part(keyed).select(PART).distinct().collect()])

    def facts(self) -> dict:
        return self.manifest()["facts"]

    # ------------------------------------------------------------------ writing

    def _write(self, df: DataFrame, name: str) -> set[int]:
        """Writes the parts of ``df`` to a folder of their own; returns those that have rows."""
        typed = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        # A large part is written by several tasks: adaptive execution splits it, whatever the number of parts.
        self.with_part(typed).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/data/{name}")
        folder, files = self._hadoop("data", name)
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return {int(n.partition("=")[2]) for n in names if n.startswith(f"{PART}=")}

    def merge(self, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None,
              facts: dict | None = None) -> list[int]:
        """Replaces the parts that hold keys of ``changes`` by ``fold(their stored rows, changes)``; returns these parts.

        ``changes`` is read more than once, so it should be a written table.  At most ``parts`` small numbers come to the
        driver.  A fold must keep each row in its part, that is leave the keys alone.
        """
        before = self.manifest()
        if batch is not None and before["batch"] >= batch:
            return []
        touched = sorted(r[0] for r in self.with_part(changes).select(PART).distinct().collect())
        return self._replace(before, touched, lambda: fold(self._read(before, touched), changes), batch, facts)

    def rewrite(self, hits: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], facts: dict | None = None) -> list[int]:
        """Replaces the parts that hold rows of ``hits(all rows)`` by ``change(their rows)``; returns these parts."""
        before = self.manifest()
        touched = sorted(r[0] for r in self.with_part(hits(self._read(before))).select(PART).distinct().collect())
        return self._replace(before, touched, lambda: change(self._read(before, touched)), None, facts)

    def replace(self, df: DataFrame, batch: int | None = None, facts: dict | None = None) -> None:
        """The whole table anew."""
        before = self.manifest()
        if batch is None or before["batch"] < batch:
            self._replace(before, list(range(self.parts)), lambda: df, batch, facts)

    def _replace(self, before: dict, touched: list[int], rows: Callable[[], DataFrame], batch: int | None, facts: dict | None) -> list[int]:
        version = before["version"] + 1
        name = f"v={version}-{uuid.uuid4().hex}"
        written = self._write(rows(), name) if touched else set()
        if not written <= set(touched):
            raise ValueError(f"rows for parts {sorted(written - set(touched))[:5]}, which the change does not touch")
        parts = {p: v for p, v in before["parts"].items() if int(p) not in touched} | {str(p): name for p in sorted(written)}
        self._switch({"version": version, "of": self.parts, "parts": parts, "batch": before["batch"] if batch is None else batch,
                      "facts": before["facts"] | (facts or {})})
        self._sweep()
        return touched
