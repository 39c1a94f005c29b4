"""Lines that stand in many documents, kept in an index that takes documents in and out again.

A line's key is the line without white space at its ends, in lower case (A-Z).  The index
counts, exactly, how many documents hold each key, and drops the lines of every key that
at least ``min_docs`` of them hold.  It is a table cut into shards by key.  A shard holds
the reference counts of its keys and one cuckoo filter, which has the fingerprints of the
keys that are to be dropped.  Taking documents in raises counts, taking them out lowers
them; a key that crosses the threshold enters or leaves its shard's filter, so the index
after a deletion answers like one that never saw these documents.  A shard that a change
does not touch is not read, and a change becomes visible in one step.

To clean documents, only what the filters let through meets the exact counts: a task names
the distinct keys of a few megabytes of texts once (a chunk), each shard's filter is read
in front of the stream of keys asked of it, the few positives are joined with the counts,
and the answers meet the chunk's documents again.  So a line that stands in every document
costs one row a chunk, and nothing grows with a key's frequency.

Keys are told apart by 128-bit digests.

Edge cases: a null or empty text is one empty line; lines without a key are kept; a line
that stands twice in a document counts once and goes twice; repeated rows and rows without
an id are documents of their own; a count never falls below zero, so taking out documents
that were never taken in takes away at most what is there; columns other than the text are
carried, one named like the result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolecast.llm import textbytes as tb
from rolecast.llm.cuckoo import CuckooFilter, Full, filled
from rolecast.operators.shaping import cut_lineage, scratch_path
from rolecast.operators.versioned import PartTable

CHUNK_BYTES = 8 << 20
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
RESULT = "lines"
SCHEMA = StructType().add("shard", "integer").add("key", "binary").add("n", "long").add("cells", "binary")


def line_key(line: bytes) -> bytes:
    """The digest that stands for a line's key, empty for a line without one."""
    key = line.strip(WHITE).lower()
    return hashlib.blake2b(key, digest_size=16).digest() if key else b""


class LineChunks:
    """Documents in chunks of a few megabytes, and each chunk's distinct keys; both in one written table.

    documents: the columns kept as ``_doc``, ``_text``, chunk and ``places``, each line's place in the chunk's keys or -1.
    asked: chunk, place, key, held (documents of the chunk with the key).
    """

    def __init__(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES):
        names = [c for c in (keep if keep is not None else docs.columns) if c not in (text, RESULT)]
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_filler")).alias("_doc"), F.col(text).cast("string").alias("_text"))
        columns = ["_doc", "_text", "chunk", "places", "keys", "held"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            place, held, weight, kind = {}, [], 0, None

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([
                    pa.nulls(1, kind), pa.nulls(1, pa.string()), pa.array([number]), pa.nulls(1, pa.list_(pa.int32())),
                    pa.array([list(place)], pa.list_(pa.binary())), pa.array([held], pa.list_(pa.int64()))], names=columns)

            for batch in batches:
                kind = batch.column(0).type
                for row, end, raw, offsets in tb.chunks(batch.column(1), chunk_bytes >> 2):
                    data = raw.tobytes()
                    places = []
                    for i, j in zip(offsets[:-1], offsets[1:]):
                        own = []
                        for line in data[i:j].split(b"\n"):
                            key = line_key(line)
                            own.append(place.setdefault(key, len(place)) if key else -1)
                        held += [0] * (len(place) - len(held))
                        for p in set(own) - {-1}:
                            held[p] += 1
                        places.append(own)
                    n = end - row
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(row, n), batch.column(1).slice(row, n).cast(pa.string()), pa.array(np.full(n, number)),
                        pa.array(places, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.int64()))],
                        names=columns)
                    weight += len(data) + n
                    if weight >= chunk_bytes:
                        yield flush()
                        place, held, weight, number = {}, [], 0, number + 1
            if weight:
                yield flush()

        schema = (f"_doc {packed.schema['_doc'].dataType.simpleString()}, _text string, chunk bigint, places array<int>, "
                  "keys array<binary>, held array<bigint>")
        written = cut_lineage(packed.mapInArrow(run, schema), "line-chunks")
        self.names = names
        self.documents = written.filter("places IS NOT NULL").drop("keys", "held")
        self.asked = written.filter("keys IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("keys", "held")).alias("place", "k")).select(
            "chunk", "place", F.col("k.keys").alias("key"), F.col("k.held").alias("held"))


class LineIndex:
    """Reference counts and filters at ``path``; ``shards`` and ``min_docs`` stay what they were when it was made."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 10, shards: int = 64):
        self.spark, self.min_docs, self.shards = spark, min_docs, shards
        self.table = PartTable(spark, path, SCHEMA, ["shard"], shards, F.col("shard"))

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

    def counts(self) -> DataFrame:
        """(shard, key, n): every key that a document holds."""
        return self.table.read().filter("key IS NOT NULL").select("shard", "key", "n")

    def insert(self, chunks: LineChunks, batch: int | None = None) -> list[int]:
        """Takes documents in; returns the shards that changed."""
        return self._change(chunks, 1, batch)

    def delete(self, chunks: LineChunks, batch: int | None = None) -> list[int]:
        """Takes documents out again."""
        return self._change(chunks, -1, batch)

    def _change(self, chunks: LineChunks, sign: int, batch: int | None) -> list[int]:
        steps = cut_lineage(self._sharded(chunks.asked.groupBy("key").agg((F.sum("held") * sign).alias("step"))), "line-steps")
        return self.table.merge(steps, self._fold, batch, {"min_docs": self.min_docs})

    def _fold(self, stored: DataFrame, steps: DataFrame) -> DataFrame:
        """The touched shards' next counts and filters."""
        old = stored.filter("key IS NOT NULL").select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("shard").alias("_shard"))
        both = old.join(steps, F.col("_key") == F.col("key"), "full").select(
            F.coalesce("shard", "_shard").alias("shard"), F.coalesce("key", "_key").alias("key"),
            F.coalesce("_n", F.lit(0)).alias("was"), F.greatest(F.coalesce("_n", F.lit(0)) + F.coalesce("step", F.lit(0)), F.lit(0)).alias("n"))
        both = cut_lineage(both, "line-counts")
        kept = F.col("n") >= self.min_docs
        marked = both.filter(kept | (F.col("was") >= self.min_docs)).select(
            "shard", "key", kept.alias("stays"), (F.col("was") >= self.min_docs).alias("was"), F.lit(None).cast("binary").alias("cells"))
        cells = stored.filter("key IS NULL").select("shard", "key", F.lit(False).alias("stays"), F.lit(False).alias("was"), "cells")

        def refill(rows: pa.Table) -> pa.Table:
            """A shard's filter after its keys went in and out; made anew from the exact counts if it is full."""
            keys, stays, was, cells = (rows.column(c).to_pylist() for c in ("key", "stays", "was", "cells"))
            held = next((c for c in cells if c is not None), None)
            try:
                if held is None:
                    raise Full
                table = CuckooFilter(cells=held).remove([k for k, s, w in zip(keys, stays, was) if w and not s])
                table.add([k for k, s, w in zip(keys, stays, was) if s and not w])
            except Full:
                table = filled([k for k, s in zip(keys, stays) if s])
            return pa.table([pa.array([rows.column("shard")[0].as_py()], pa.int32()), pa.nulls(1, pa.binary()), pa.array([int(sum(stays))], pa.int64()),
                             pa.array([table.tobytes()], pa.binary())], names=SCHEMA.names)

        filters = marked.unionByName(cells).groupBy("shard").applyInArrow(refill, SCHEMA)
        return both.filter("n > 0").select("shard", "key", "n", F.lit(None).cast("binary").alias("cells")).unionByName(filters)

    def dropped(self, asked: DataFrame) -> DataFrame:
        """The rows of ``asked`` (chunk, place, key) whose key stands in at least ``min_docs`` documents of the index."""
        filters = self.table.read().filter("key IS NULL").select(
            "shard", F.lit(None).cast("bigint").alias("chunk"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("key"), "cells")
        rows = self._sharded(asked.select("chunk", "place", "key")).select("shard", "chunk", "place", "key", F.lit(None).cast("binary").alias("cells"))
        # A shard's filter comes before the keys asked of it, which pass through as a stream.
        dealt = rows.unionByName(filters).repartition("shard").sortWithinPartitions("shard", F.col("cells").isNull())

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, table = None, None
            for batch in batches:
                shards = batch.column(0).to_numpy()
                for cut in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                    part = batch.slice(cut[0], len(cut)) if len(cut) else batch.slice(0, 0)
                    if not part.num_rows:
                        continue
                    if shard != shards[cut[0]]:
                        shard, table = shards[cut[0]], None
                        first = part.column(4)[0].as_py()
                        if first is not None:
                            table, part = CuckooFilter(cells=first), part.slice(1)
                    if table is not None and part.num_rows:
                        found = table.contains(part.column(3).to_pylist())
                        yield pa.RecordBatch.from_arrays([c.filter(pa.array(found)) for c in part.columns[:4]], names=["shard", "chunk", "place", "key"])

        hits = dealt.mapInArrow(probe, "shard int, chunk bigint, place int, key binary")
        exact = self.counts().filter(F.col("n") >= self.min_docs).select(F.col("key").alias("_key"))
        return hits.join(exact, F.col("key") == F.col("_key")).select("chunk", "place")

    def clean(self, chunks: LineChunks) -> DataFrame:
        """The carried columns with ``lines``: n_lines, n_dropped and the text of the other lines, joined by a line feed."""
        gone = self.dropped(chunks.asked).select(F.col("chunk").alias("_chunk"), "place")
        carried = chunks.documents.schema["_doc"].dataType
        schema = f"_doc {carried.simpleString()}, n_lines bigint, n_dropped bigint, kept string"

        def cut(rows: pa.Table, gone: pa.Table) -> pa.Table:
            drop = set(gone.column("place").to_pylist())
            lines, dropped, kept = [], [], []
            for text, places in zip(rows.column("_text").cast(pa.binary()).to_pylist(), rows.column("places").to_pylist()):
                stay = [p not in drop for p in places]
                lines.append(len(places))
                dropped.append(len(places) - sum(stay))
                kept.append(b"\n".join(x for x, s in zip((text or b"").split(b"\n"), stay) if s) if dropped[-1] else text or b"")
            return pa.table([rows.column("_doc"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                             pa.array(kept, pa.binary()).cast(pa.string())], names=["_doc", "n_lines", "n_dropped", "kept"])

        done = chunks.documents.groupBy("chunk").cogroup(gone.groupBy("_chunk")).applyInArrow(cut, schema)
        return done.select(*[F.col(f"_doc.`{c}`") for c in chunks.names], F.struct("n_lines", "n_dropped", "kept").alias(RESULT))


def drop_common_lines(docs: DataFrame, text: str = "text", keep: list[str] | None = None, min_docs: int = 10, shards: int = 64,
                      path: str | None = None) -> DataFrame:
    """``clean`` of all ``docs`` by an index of all of them, made at ``path`` (default: in the scratch folder)."""
    index = LineIndex(docs.sparkSession, path or scratch_path(docs.sparkSession, "line-index"), min_docs, shards)
    chunks = LineChunks(docs, text, keep)
    index.insert(chunks)
    return index.clean(chunks)
