"""Language-model scores of documents by stupid backoff, from counts over all documents.

The counts are a table of n-grams dealt by hash, and the documents' n-grams are joined
to it.  Rows for single n-grams would be many times the corpus, so both sides travel
packed: a chunk of texts sends each of its distinct n-grams once, with its count, to
the bucket of the n-gram's hash; a bucket adds the counts of all chunks and answers
every chunk in the order it was asked.  A chunk with its answers then sums the scores
of its documents.  A word pair that stands everywhere is one entry per chunk.

A document is scored without its own counts, so that a text is not its own model.
For a word with context of ``order - 1`` words the score is count(n-gram) /
count(context), or, where the n-gram stands in no other document, ``alpha`` times the
score with one context word less; a word that stands in no other document counts as
one of all words.  The first words of a text have shorter contexts.

N-grams are told apart by 48 bits of hash within a bucket.  The number of buckets
grows with the corpus, so the share of n-grams that are confused stays at about 1e-8.

Edge cases: a null or empty text has no words, score 0 and no mean; repeated rows are
documents of their own; ids may repeat or be null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm import textbytes as tb
from rolecast.operators.shaping import cut_lineage

CHUNK = 8 << 20
#: Bytes of an n-gram's hash below the bits that name its bucket.
GRAM_BYTES = 6


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, one byte plane after the other, compressed.

    In ascending values the high planes are runs, and in counts they are zero.
    """
    planes = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, 8 - width:] = planes.T
    return wide.view(">u8").ravel().astype(np.uint64)


def _packed_words(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One row per chunk of texts: keys, words per text, distinct word hashes and their numbers in reading order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, offsets in tb.chunks(batch.column(1), CHUNK):
                data = tb.lower_latin(raw)
                starts, ends, bounds = tb.words(data, offsets)
                distinct, codes = np.unique(tb.span_hashes(data, starts, ends), return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), batch.column(0).slice(row, end - row)),
                    pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), pa.array(np.diff(bounds), pa.int64())),
                    pa.array([pack(distinct, 8)], pa.binary()), pa.array([pack(codes.astype(np.uint64), 4)], pa.binary())],
                    names=["keys", "sizes", "words", "codes"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"keys array<{kind}>, sizes array<bigint>, words binary, codes binary")


class _Chunk:
    """The n-grams of one packed chunk."""

    def __init__(self, sizes: np.ndarray, words: bytes, codes: bytes):
        self.sizes = sizes
        self.hashes = unpack(words, 8)[unpack(codes, 4).astype(np.int64)]
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.left = np.arange(len(self.hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def grams(self, order: int):
        """(distinct hashes in ascending order, number of the n-gram ending at each word with enough context, counts, these words)."""
        rolled = np.full(len(self.hashes), order, np.uint64)
        for i in range(order):
            part = np.zeros_like(rolled)
            part[order - 1 - i:] = self.hashes[: len(rolled) - (order - 1 - i)] if order - 1 - i else self.hashes
            rolled = tb.mix(rolled ^ part) + np.uint64(i + 1)
        at = np.flatnonzero(self.left >= order - 1)
        distinct, number, counts = np.unique(tb.mix(rolled[at]), return_inverse=True, return_counts=True)
        return distinct, number, counts, at


def _requests(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(bucket, level, chunk, grams, counts): what each chunk asks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _Chunk(np.array(batch.column(1)[i].as_py(), np.int64), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                for level in range(1, order + 1):
                    distinct, _, counts, _ = chunk.grams(level)
                    bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
                    cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                    low = (distinct << np.uint64(bits)) >> np.uint64(64 - 8 * GRAM_BYTES)
                    some = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(some, pa.int32()), pa.array(np.full(len(some), level), pa.int32()),
                        pa.array(np.full(len(some), batch.column(0)[i].as_py()), pa.int64()),
                        pa.array([pack(low[cuts[b]: cuts[b + 1]], GRAM_BYTES) for b in some], pa.binary()),
                        pa.array([pack(counts[cuts[b]: cuts[b + 1]].astype(np.uint64), 4) for b in some], pa.binary())],
                        names=["bucket", "level", "chunk", "grams", "counts"])

    return chunks.select("chunk", "sizes", "words", "codes").mapInArrow(
        run, "bucket int, level int, chunk bigint, grams binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(chunk, level, bucket, totals): corpus counts in the order of each request."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(g, GRAM_BYTES) for g in table.column("grams").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        level = np.repeat(table.column("level").to_numpy().astype(np.uint64), sizes)
        counts = np.concatenate([unpack(c, 4) for c in table.column("counts").to_pylist()])
        _, number = np.unique(np.concatenate(parts) | (level << np.uint64(56)), return_inverse=True)
        totals = np.bincount(number, weights=counts)[number].astype(np.uint64)
        packed = [pack(t, GRAM_BYTES) for t in np.split(totals, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": table.column("chunk"), "level": table.column("level"), "bucket": table.column("bucket"),
                         "totals": pa.array(packed, pa.binary())})

    return requests.groupBy("bucket").applyInArrow(run, "chunk bigint, level int, bucket int, totals binary")


def chunk_scores(chunk: _Chunk, totals: list[np.ndarray], all_words: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(log10 score, words that backed off) per text; ``totals[k]``: corpus counts of the distinct (k+1)-grams."""
    n = len(chunk.hashes)
    others = []
    for level, total in enumerate(totals, 1):
        _, number, _, at = chunk.grams(level)
        pairs = chunk.text[at] * np.int64(len(total) + 1) + number
        _, inverse, own = np.unique(pairs, return_inverse=True, return_counts=True)
        count = np.zeros(n)
        count[at] = total[number].astype(np.float64) - own[inverse]
        others.append(count)
    words = np.maximum(all_words - chunk.sizes[chunk.text], 1).astype(np.float64) if n else np.zeros(0)
    score = np.log10(1.0 / words) + np.log10(alpha) * np.minimum(len(totals), chunk.left + 1)
    level_of = np.zeros(n, np.int64)
    for level, count in enumerate(others, 1):
        seen = count > 0
        below = words if level == 1 else np.concatenate(([1.0], others[level - 2][:-1]))
        steps = np.minimum(len(totals), chunk.left + 1) - level
        score[seen] = np.log10(count[seen] / below[seen]) + np.log10(alpha) * steps[seen]
        level_of[seen] = level
    back = level_of < np.minimum(len(totals), chunk.left + 1)
    m = len(chunk.sizes)
    return np.bincount(chunk.text, weights=score, minlength=m), np.bincount(chunk.text[back], minlength=m)


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = 2, alpha: float = 0.4,
                    bucket_grams: int = 1_000_000) -> DataFrame:
    """(key, n_words, log10_score, per_word, backed_off), one row per document."""
    # The chunks' numbers hold because they are written.
    chunks = cut_lineage(_packed_words(docs, text, key).withColumn("chunk", F.monotonically_increasing_id()), "lm-words")
    words = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = int(np.ceil(np.log2(max(1, words * order / bucket_grams))))
    answers = cut_lineage(_answers(_requests(chunks, order, bits)), "lm-answers")
    lists = answers.groupBy(F.col("chunk").alias("_c")).agg(F.collect_list(F.struct("level", "bucket", "totals")).alias("answers"))
    joined = chunks.join(lists, F.col("chunk") == F.col("_c"), "left").select("keys", "sizes", "words", "codes", "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _Chunk(np.array(batch.column(1)[i].as_py(), np.int64), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                told = sorted((a["level"], a["bucket"], a["totals"]) for a in batch.column(4)[i].as_py() or [])
                totals = [np.concatenate([np.zeros(0, np.uint64)] + [unpack(t, GRAM_BYTES) for lv, _, t in told if lv == level])
                          for level in range(1, order + 1)]
                score, back = chunk_scores(chunk, totals, words, alpha)
                size = chunk.sizes
                mean = pa.array(np.divide(score, size, out=np.zeros_like(score), where=size > 0), mask=size == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(size), pa.array(score), mean, pa.array(back, pa.int64())],
                    names=[key, "n_words", "log10_score", "per_word", "backed_off"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {kind}, n_words bigint, log10_score double, per_word double, backed_off bigint")
