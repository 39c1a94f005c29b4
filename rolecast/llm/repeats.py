"""Removal of byte strings that stand earlier in the corpus, by suffix order of candidate contexts.

Every byte is removed that is covered by a string of ``length`` bytes which also
starts earlier (smaller key, or the same document further left).

1. Anchors.  In each window of ``length`` bytes the k-gram with the smallest hash is
   its anchor.  Equal windows have the same anchor at the same place, so only
   windows around anchors that stand more than once can be repeats.  An anchor's
   context is all the windows that it can anchor.
2. Equal contexts.  Anchors are dealt by their hash.  All occurrences of a context
   but the first are repeats as a whole; this needs no text.  (Copies inside one
   chunk of texts are told before the shuffle, so that a passage which stands
   everywhere does not meet in one task.)
3. Different contexts of one anchor.  Only their first occurrences are cut out of the
   texts.  Per bucket of anchors, the parts right of the anchors and the reversed
   parts left of them are sorted with the grouping suffix sort of
   ``suffix_groups`` (over blocks of bytes, whose order is the bytes' order).
   Neighbours' common prefixes then say for each window which contexts share it,
   and every context but the first of them has a repeat.
4. The covered ranges of a document are merged and its text is cut.

An anchor with more than ``max_group`` different contexts goes another exact way:
its windows are hashed to 128 bits and grouped by Spark.

Edge cases: a null text is empty; a text shorter than ``length`` keeps all;
documents with equal or null keys are told apart by their place among them in the
order of their texts' hashes (null keys come last), so a repeated row is a later
document; the place is a column of its own, for any number of equal keys; columns
other than key and text are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.llm import textbytes as tb
from rolecast.llm.suffix_groups import suffix_array
from rolecast.operators.shaping import cut_lineage

LENGTH = 100
GRAM = 28
#: Bytes that one symbol of the suffix sort stands for.
BLOCK = 24
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of a packed place: position (32), bytes left (7) and right (7) of the anchor.
_POS, _LEFT = 14, 7


def _slide(a: np.ndarray, width: int, f, fill: int) -> np.ndarray:
    """f over a[i: i + width] for every i, by doubling."""
    out, step = a, 1
    pad = lambda x, d: np.concatenate([x[d:], np.full(min(d, len(x)), fill, np.uint64)])
    while step * 2 <= width:
        out = f(out, pad(out, step))
        step *= 2
    return f(out, pad(out, width - step)) if step < width else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(place, hash, bytes left, bytes right) of all anchors of texts laid end to end."""
    n, width = len(data), length - gram + 1
    hashes = np.full(n, _MAX, np.uint64)
    if n >= gram:
        at = np.arange(n - gram + 1)
        hashes[: n - gram + 1] = tb.span_hashes(data, at, at + gram)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    hashes[room < gram] = _MAX
    least = _slide(hashes, width, np.minimum, int(_MAX))
    least[room < length] = 0
    most = _slide(least[::-1], width, np.maximum, 0)[::-1]
    place = np.flatnonzero((most == hashes) & (hashes != _MAX))
    text = np.searchsorted(offsets, place, "right") - 1
    left = np.minimum(place - offsets[text], width - 1)
    right = np.minimum(offsets[text + 1] - place, length)
    return place, text, hashes[place], left, right


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, doc, copy, at): anchor hash, context hash, key, place among equal keys, packed place.  c = 0: known to be a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            copies = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, offsets in tb.chunks(batch.column(2)):
                place, text, h, left, right = anchors(data, offsets, length, gram)
                c = tb.span_hashes(data, place - left, place + right)
                c = tb.mix(c ^ left.astype(np.uint64)) | np.uint64(1)
                doc, copy = keys[row:end][text], copies[row:end][text]
                at = ((place - offsets[text]) << _POS) | (left << _LEFT) | right
                both = tb.mix(h ^ tb.mix(c))
                order = np.lexsort((at, copy, doc, both))
                again = np.zeros(len(order), bool)
                again[order[1:]] = both[order[1:]] == both[order[:-1]]
                # Known repeats need no partner, so they are dealt evenly.
                c[again] = 0
                from_doc = tb.mix(doc[again].astype(np.uint64) ^ tb.mix(copy[again].astype(np.uint64)))
                h[again] = tb.mix(at[again].astype(np.uint64) ^ from_doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(copy), pa.array(at)],
                    names=["h", "c", "doc", "copy", "at"])

    return docs.select("_doc_key", "_copy", "_text").mapInArrow(run, "h bigint, c bigint, doc bigint, copy bigint, at bigint")


def _marks(rows: DataFrame) -> DataFrame:
    """(doc, copy, at, h) of repeats (h null) and of first occurrences that have to be compared.

    One shuffle by h; the windows only look back, so a group streams through its task.
    """
    by_context = Window.partitionBy("h", "c").orderBy("doc", "copy", "at")
    by_anchor = Window.partitionBy("h").orderBy("c", "doc", "copy", "at").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("n", F.row_number().over(by_context)).withColumn("head", F.first(F.struct("doc", "copy", "at")).over(by_anchor))
    # The second context of an anchor also calls up the first one, each time it is a first occurrence.
    seen = seen.withColumn("rank", F.dense_rank().over(Window.partitionBy("h").orderBy("c")))
    repeat = (F.col("c") == 0) | (F.col("n") > 1)
    own = F.struct("doc", "copy", "at", F.when(~repeat, F.col("h")).alias("h"))
    first = F.struct(*[F.col(f"head.{c}").alias(c) for c in ("doc", "copy", "at")], F.col("h").alias("h"))
    out = F.when((F.col("c") != 0) & (F.col("n") == 1) & (F.col("rank") == 2), F.array(own, first)).when(
        repeat | (F.col("rank") > 1), F.array(own))
    return seen.select(F.inline(out))


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, bytes left, bytes right)."""
    return at >> _POS, (at >> _LEFT) & 127, at & 127


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Rank of equal-length byte strings (m, BLOCK), in byte order."""
    wide = rows.view(">u8").astype(np.uint64)
    order = np.lexsort(tuple(wide[:, k] for k in range(wide.shape[1] - 1, -1, -1)))
    new = np.ones(len(order), np.int64)
    new[1:] = (wide[order[1:]] != wide[order[:-1]]).any(axis=1)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_ranges(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray,
                    length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window start relative to its anchor) of windows that an earlier context also has.

    ``left`` (reversed) and ``right`` are zero-filled byte rows; contexts are in order of occurrence.
    """
    n = len(left)
    n_r, n_l = right.shape[1] // BLOCK, left.shape[1] // BLOCK
    ranks = _ranks(np.concatenate([right.reshape(-1, BLOCK), left.reshape(-1, BLOCK)]))
    stop = np.ones((n, 1), np.int64)
    symbols = np.concatenate([
        np.concatenate([ranks[: n * n_r].reshape(n, n_r) + 1, stop], axis=1).ravel(),
        np.concatenate([ranks[n * n_r:].reshape(n, n_l) + 1, stop], axis=1).ravel(), [0]])
    position = suffix_array(symbols)
    classes = []
    for rows, begin, step in ((right, 0, n_r + 1), (left, n * (n_r + 1), n_l + 1)):
        mine = position[(position >= begin) & (position < begin + n * step)] - begin
        order = mine[mine % step == 0] // step
        same = rows[order[1:]] == rows[order[:-1]]
        common = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
        classes.append((order, common))
    (r_order, r_common), (l_order, l_common) = classes
    who, start = [], []
    for i in range(left.shape[1] + 1):
        valid = np.flatnonzero((n_left >= i) & (n_right >= length - i))
        if not len(valid):
            continue
        r_class, l_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
        r_class[r_order[1:]] = np.cumsum(r_common < length - i)
        l_class[l_order[1:]] = np.cumsum(l_common < i)
        key = (r_class * n + l_class)[valid]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(valid), bool)
        later[first] = False
        who.append(valid[later])
        start.append(np.full(int(later.sum()), -i))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(start)


def _cut_contexts(asked: DataFrame) -> DataFrame:
    """(h, doc, copy, at, bytes) from texts with their asked places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(2))
            counts = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            if not counts.sum():
                continue
            flat = batch.column(3).flatten()
            at, h = flat.field("at").to_numpy(), flat.field("h")
            text = np.repeat(np.arange(len(counts)), counts)
            place, left, right = _places(at)
            place = place + offsets[text]
            raw = data.tobytes()
            doc, copy = (batch.column(i).to_numpy(zero_copy_only=False)[text] for i in (0, 1))
            for k in range(0, len(at), 20_000):
                cut = slice(k, k + 20_000)
                pieces = [raw[a:b] for a, b in zip((place - left)[cut].tolist(), (place + right)[cut].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [h[cut], pa.array(doc[cut]), pa.array(copy[cut]), pa.array(at[cut]), pa.array(pieces, pa.binary())],
                    names=["h", "doc", "copy", "at", "bytes"])

    return asked.mapInArrow(run, "h bigint, doc bigint, copy bigint, at bigint, bytes binary")


def _compare(contexts: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """(doc, copy, lo, hi) of repeats among different contexts of the same anchor."""
    l_width = -(-(length - gram) // BLOCK) * BLOCK
    r_width = -(-length // BLOCK) * BLOCK

    def run(table: pa.Table) -> pa.Table:
        at, copy, doc = (table.column(c).to_numpy() for c in ("at", "copy", "doc"))
        order = np.lexsort((at, copy, doc))
        at, copy, doc = at[order], copy[order], doc[order]
        data, offsets = tb.column_bytes(table.column("bytes"))
        place, n_left, n_right = _places(at)
        n = len(order)
        left, right = np.zeros((n, l_width), np.uint8), np.zeros((n, r_width), np.uint8)
        middle = offsets[:-1][order] + n_left
        for k in range(l_width):
            ok = k < n_left
            left[ok, k] = data[middle[ok] - 1 - k]
        for k in range(r_width):
            ok = k < n_right
            right[ok, k] = data[middle[ok] + k]
        who, start = repeated_ranges(left, right, n_left, n_right, length)
        # Per context, windows that overlap are one range.
        by = np.lexsort((start, who))
        who, start = who[by], start[by]
        lo = place[who] + start
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (lo[1:] > lo[:-1] + length)
        at_new = np.flatnonzero(new)
        last = np.append(at_new[1:], len(who)) - 1 if len(who) else at_new
        return pa.table({"doc": doc[who[at_new]], "copy": copy[who[at_new]], "lo": lo[at_new], "hi": lo[last] + length})

    dealt = contexts.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "doc bigint, copy bigint, lo bigint, hi bigint")


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, copy, lo, hi) of repeats by hashing each window: the way for anchors with very many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(3))
            place, n_left, n_right = _places(batch.column(2).to_numpy())
            doc, copy = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(int(n_left.max(initial=0)) + 1):
                ok = np.flatnonzero((n_left >= i) & (n_right >= length - i))
                lo = offsets[:-1][ok] + n_left[ok] - i
                names = [hashlib.blake2b(data[a: a + length], digest_size=16).digest() for a in lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(doc[ok]), pa.array(copy[ok]), pa.array(place[ok] - i)],
                    names=["w", "doc", "copy", "lo"])

    rows = contexts.select("doc", "copy", "at", "bytes").mapInArrow(run, "w binary, doc bigint, copy bigint, lo bigint")
    first = rows.groupBy("w").agg(F.min(F.struct("doc", "copy", "lo")).alias("first"))
    again = rows.join(first, "w").filter(F.struct("doc", "copy", "lo") != F.col("first"))
    return again.select("doc", "copy", "lo", (F.col("lo") + length).alias("hi"))


def _numbered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(_doc, _doc_key, _copy, _text): the key as a number that sorts nulls last, and the place among equal keys."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("_doc_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    many = cut_lineage(packed.groupBy("_doc_key").agg(F.count("*").alias("n")).filter("n > 1").select("_doc_key"), "rep-keys")
    if many.isEmpty():
        return packed.withColumn("_copy", F.lit(0).cast("long"))
    repeated = cut_lineage(packed.join(many, "_doc_key", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "rep-rows")
    repeated = repeated.join(_copies(repeated), "_row").drop("_row")
    return packed.join(many, "_doc_key", "left_anti").withColumn("_copy", F.lit(0).cast("long")).unionByName(repeated)


def _copies(repeated: DataFrame) -> DataFrame:
    """(_row, _copy): the place of each row among the rows with its key, counted from 0.

    Keys, text hashes and row numbers without the texts are cut by range into parts of equal
    size; a key's rows are numbered part by part, so that no task has to hold all rows of a key.
    """
    order = ["_doc_key", "_h1", "_h2", "_row"]
    rows = repeated.select("_doc_key", F.xxhash64("_text").alias("_h1"), F.xxhash64(F.lit(1), "_text").alias("_h2"), "_row")
    rows = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rep-order")
    earlier = Window.partitionBy("_doc_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_doc_key", "_part").agg(F.count("*").alias("_n")).select(
        "_doc_key", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_doc_key", "_part").orderBy(*order[1:]))
    placed = rows.withColumn("_within", within).join(before, ["_doc_key", "_part"])
    return cut_lineage(placed.select("_row", (F.col("_before") + F.col("_within") - 1).alias("_copy")), "rep-copies")


def cut_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None,
                length: int = LENGTH, gram: int = GRAM, bucket_size: int = 8_000, max_group: int = 100_000) -> DataFrame:
    """The columns ``keep`` (default: all) with ``cut``: n_bytes, n_removed, n_spans and the bytes that stay (kept)."""
    names = [c for c in (keep if keep is not None else docs.columns) if c != "cut"]
    numbered = _numbered(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, key, text])]), text, key)
    marks = cut_lineage(_marks(_anchor_rows(numbered, length, gram)), "rep-marks")
    position = F.shiftright("at", _POS)
    n_left, n_right = F.shiftright("at", _LEFT).bitwiseAND(127), F.col("at").bitwiseAND(127)
    whole = marks.filter("h IS NULL").select(
        "doc", "copy", (position - n_left).alias("lo"), (position + n_right).alias("hi"))

    asks = marks.filter("h IS NOT NULL")
    per_anchor = cut_lineage(asks.groupBy("h").agg(F.count("*").alias("n")), "rep-anchors")
    total = per_anchor.agg(F.sum("n")).first()[0] or 0
    # One list per document, no longer than its text.
    lists = asks.groupBy("doc", "copy").agg(F.collect_list(F.struct("at", "h")).alias("asked"))
    texts = numbered.select("_doc_key", "_copy", "_text")
    on = lambda other: (F.col("_doc_key") == other["doc"]) & (F.col("_copy") == other["copy"])
    contexts = _cut_contexts(texts.join(lists, on(lists)).select("_doc_key", "_copy", "_text", "asked"))
    large = per_anchor.filter(F.col("n") > max_group).select("h")
    if large.isEmpty():
        ranges = whole.unionByName(_compare(contexts, length, gram, 1 + total // bucket_size))
    else:
        ranges = whole.unionByName(_compare(contexts.join(large, "h", "left_anti"), length, gram, 1 + total // bucket_size)) \
            .unionByName(_windows(contexts.join(large, "h", "left_semi"), length))
    ranges = cut_lineage(ranges, "rep-ranges")
    covered = ranges.groupBy("doc", "copy").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    out = numbered.select(
        "_doc_key", "_copy", F.struct(F.lit(0).alias("_"), *[F.col(f"_doc.`{c}`") for c in names]).alias("_kept"), "_text")
    out = out.join(covered, on(covered), "left").select("_kept", "_text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            lists_ = batch.column(2)
            counts = pc.list_value_length(lists_).fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists_.flatten()
            text_of = np.repeat(np.arange(len(counts)), counts)
            lo = flat.field("lo").to_numpy(zero_copy_only=False) + offsets[text_of]
            hi = flat.field("hi").to_numpy(zero_copy_only=False) + offsets[text_of]
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, lo, 1)
            np.add.at(depth, hi, -1)
            stay = np.cumsum(depth[:-1]) == 0
            gone = ~stay
            begins = gone.copy()
            begins[1:] &= stay[:-1]
            heads = offsets[:-1][np.diff(offsets) > 0]
            begins[heads] = gone[heads]
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets])
            spans = np.diff(np.concatenate(([0], np.cumsum(begins)))[offsets])
            rest = data[stay].tobytes()
            ends = np.concatenate(([0], np.cumsum(np.diff(offsets) - removed)))
            kept = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rest)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), kept.cast(pa.binary())],
                names=["_kept", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = out.schema["_kept"].dataType.simpleString()
    done = out.mapInArrow(run, f"_kept {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return done.select(*[F.col(f"_kept.`{c}`") for c in names], F.struct("n_bytes", "n_removed", "n_spans", "kept").alias("cut"))


def kept_text(kept: Column) -> Column:
    """The bytes that stay as text; what is left of characters that were cut in two goes."""
    return F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("\ufffd"), F.lit(""))
