"""Alignment of two tokenizations of the same bytes, and corpus counts of the linked ids.

Both tokenizers cut one byte string.  The offsets at which a token of each ends are
two ascending lists; an offset in both cuts the string into groups.  They are
intersected by galloping: each end of the shorter list is sought in the longer one
by doubling steps, then by halving the span that the last step leaves.  The search
also gives each end's rank in the longer list, and two neighbouring ranks bound the
tokens that a token of the shorter list overlaps, so links need no second pass.  Ends
of many texts lie one behind the other, so numpy takes a step for all of them at once.

A link's count is the number of documents that hold its pair of ids.  Tokens are not
shuffled for it: a task names the distinct pairs of a few megabytes of texts once (a
chunk), Spark sums these and joins the sums back to the chunks that asked, and each
chunk meets its documents again, which carry places in the chunk's list.  So a pair
that stands in every document costs one row a chunk, and no group is larger than one.

The byte-level vocabulary is read from its own file.  Texts of code points below
U+0250, where the two libraries' character classes agree, are encoded by the ranked
form of the same merges, all others by the file's own library; a test compares both.

Edge cases: a null or empty text, one that is no UTF-8, and one whose tokens do not
give back its bytes have no tokens, zeros and an empty digest; repeated rows are
documents of their own; columns other than the text are carried, those named like
results give way to them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.llm import textbytes as tb
from rolecast.operators.shaping import cut_lineage

FOLDER = "/opt/tokenizers"
UNIT_BYTES = 1 << 20
CHUNK_BYTES = 4 << 20
#: Fixed value: how the byte-level vocabulary's library cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: First UTF-8 byte of the code points from U+0280 on, the first above U+024F that starts a byte.
_FAR = 0xCA


# ------------------------------------------------------------------ vocabularies


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabularies:
    """The two tokenizers and the bytes of their tokens; made once per worker from the files' contents."""

    _made: dict[bytes, "Vocabularies"] = {}

    def __init__(self, byte_file: bytes, piece_file: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(byte_file)["model"]
        self.slow = Tokenizer.from_str(byte_file.decode())
        self.slow.encode_special_tokens = True
        letter = byte_letters()
        ids = model["vocab"]
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # Merges are tried in the order of their ids, which is what the ranked form does.
        ranked = len(merges) + 256 <= len(self.a_bytes) and all(ids[x + y] == 256 + k for k, (x, y) in enumerate(merges))
        self.fast = tiktoken.Encoding(
            "byte-level", pat_str=PATTERN, special_tokens={},
            mergeable_ranks={self.a_bytes[i]: i for i in range(256 + len(merges))}) if ranked else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    @classmethod
    def of(cls, byte_file: bytes, piece_file: bytes) -> "Vocabularies":
        key = hashlib.sha256(byte_file + piece_file).digest()
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(byte_file, piece_file)
        return cls._made[key]

    def encode_a(self, raws: list[bytes], texts: list[str]) -> list[list[int]]:
        far = [i for i, raw in enumerate(raws) if self.fast is None or raw and max(raw) >= _FAR]
        slow = dict(zip(far, self.slow.encode_batch_fast([" " + texts[i] for i in far], add_special_tokens=False))) if far else {}
        return [slow[i].ids if i in slow else self.fast.encode_ordinary(" " + t) for i, t in enumerate(texts)]

    def tokens(self, raws: list[bytes | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizations of each text; none where there are none by definition."""
        a: list[list[int]] = [[] for _ in raws]
        b: list[list[int]] = [[] for _ in raws]
        at, texts = [], []
        for i, raw in enumerate(raws):
            try:
                if raw:
                    texts.append(raw.decode())
                    at.append(i)
            except UnicodeDecodeError:
                pass
        if not at:
            return a, b
        some_a, some_b = self.encode_a([raws[i] for i in at], texts), self.pieces.encode(texts, num_threads=1)
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for i, x, y in zip(at, some_a, some_b):
            whole = b" " + raws[i]
            if b"".join(map(of_a, x)) == whole and b"".join(map(of_b, y)) == whole:
                a[i], b[i] = x, y
        return a, b


def vocabulary_files(folder: str = FOLDER, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> tuple[bytes, bytes]:
    """The contents of the two files, a few megabytes whatever the corpus; executors get them from here."""
    with open(f"{folder}/{byte_level}", "rb") as f, open(f"{folder}/{pieces}", "rb") as g:
        return f.read(), g.read()


# --------------------------------------------------------------------- alignment


def gallop(keys: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Number of values below each key in ``longer[low:high]``, plus ``low``.

    From ``start`` on, steps double towards the key until one passes it or leaves the span;
    what lies between the last two is then halved.
    """
    n = len(keys)
    at = np.clip(start, low, high - 1)
    right = longer[at] < keys
    first, last = np.where(right, at + 1, low), np.where(right, high, at)
    live, step = np.arange(n), 1
    while len(live):
        up = right[live]
        probe = at[live] + np.where(up, step, -step)
        lo, hi = low[live], high[live]
        inside = (probe >= lo) & (probe < hi)
        less = np.zeros(len(live), bool)
        less[inside] = longer[probe[inside]] < keys[live[inside]]
        first[live] = np.where(inside & less, probe + 1, first[live])
        last[live] = np.where(inside & ~less, probe, last[live])
        live = live[inside & (less == up)]
        step *= 2
    live = np.flatnonzero(first < last)
    while len(live):
        middle = (first[live] + last[live]) >> 1
        less = longer[middle] < keys[live]
        first[live] = np.where(less, middle + 1, first[live])
        last[live] = np.where(less, last[live], middle)
        live = live[first[live] < last[live]]
    return first


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 … (count values) for each pair."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Aligned:
    """Texts whose two tokenizations lie one behind the other: groups and links by number of token.

    ``a_bounds`` and ``b_bounds`` are the texts' first tokens.  ``a_group`` and ``b_group`` are each token's group, over
    all texts; ``link_a`` and ``link_b`` the linked tokens, ``link_text`` their text.
    """

    def __init__(self, a_sizes: np.ndarray, a_bounds: np.ndarray, b_sizes: np.ndarray, b_bounds: np.ndarray):
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        self.a_bounds, self.b_bounds = a_bounds, b_bounds
        n_a, n_b = np.diff(a_bounds), np.diff(b_bounds)
        a_common, b_common = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
        links = []
        for short, s_bounds, s_common, long, l_bounds, l_common, mine in (
                (a_ends, a_bounds, a_common, b_ends, b_bounds, b_common, n_a <= n_b),
                (b_ends, b_bounds, b_common, a_ends, a_bounds, a_common, n_a > n_b)):
            count = np.where(mine, np.diff(s_bounds), 0)
            at = _spread(s_bounds[:-1], count)
            if not len(at):
                links.append((at, at))
                continue
            text = np.repeat(np.arange(len(count)), count)
            low, high = l_bounds[text], l_bounds[text + 1]
            guess = low + (at - s_bounds[text]) * (high - low) // np.maximum(count[text], 1)
            rank = gallop(short[at], long, low, high, guess)
            met = long[rank] == short[at]
            s_common[at[met]] = True
            l_common[rank[met]] = True
            # A token overlaps the other side's tokens from where the one before it stopped to its own rank.
            begin = np.concatenate(([0], rank[:-1] + met[:-1]))
            opening = np.concatenate(([True], text[1:] != text[:-1]))
            begin[opening] = low[opening]
            n = rank - begin + 1
            links.append((np.repeat(at, n), _spread(begin, n)))
        (a1, b1), (b2, a2) = links
        self.link_a, self.link_b = np.concatenate((a1, a2)), np.concatenate((b1, b2))
        self.link_text = np.searchsorted(a_bounds, self.link_a, "right") - 1
        self.a_common, self.b_common = a_common, b_common
        self.a_group = np.cumsum(a_common) - a_common
        self.b_group = np.cumsum(b_common) - b_common
        self.n_groups = np.add.reduceat(np.append(a_common, False).astype(np.int64), a_bounds[:-1]) * (n_a > 0) if len(n_a) else n_a
        self.n_links = np.bincount(self.link_text, minlength=len(n_a))


class Decimals:
    """Ids as decimal text, many at a time."""

    def __init__(self, size: int):
        self.length = np.char.str_len(np.arange(size).astype("U")).astype(np.int64)
        self.width = int(self.length.max())
        padded = np.array([str(i).ljust(self.width).encode() for i in range(size)])
        self.digits = padded.view(np.uint8).reshape(size, self.width)

    def write(self, ids: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, each with the separator behind it; end of each)."""
        rows = np.empty((len(ids), self.width + 1), np.uint8)
        rows[:, :-1] = self.digits[ids]
        length = self.length[ids]
        rows[np.arange(len(ids)), length] = separators
        return rows[np.arange(self.width + 1) <= length[:, None]], np.cumsum(length + 1)


def group_digests(aligned: Aligned, a: np.ndarray, b: np.ndarray, decimals: Decimals) -> list[str]:
    """Digest of ``a1,a2|b1;a3|b2`` for each text, empty without tokens."""
    # Behind a group's tokens of A stand its tokens of B, so each token's place follows from the other side's count.
    a_in, b_in = np.cumsum(np.bincount(aligned.a_group, minlength=1)), np.cumsum(np.bincount(aligned.b_group, minlength=1))
    place_a = np.arange(len(a)) + np.concatenate(([0], b_in))[aligned.a_group]
    place_b = np.arange(len(b)) + a_in[aligned.b_group]
    ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[place_a], ids[place_b] = a, b
    marks[place_a] = np.where(aligned.a_common, ord("|"), ord(","))
    marks[place_b] = np.where(aligned.b_common, ord(";"), ord(","))
    written, ends = decimals.write(ids, marks)
    cuts = np.concatenate(([0], ends))[aligned.a_bounds + aligned.b_bounds]
    raw = written.tobytes()
    return [hashlib.sha256(raw[i: j - 1]).hexdigest() if j > i else "" for i, j in zip(cuts[:-1], cuts[1:])]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return np.array([i for x in lists for i in x], np.int64), bounds


def _units(column: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(first row, row after the last, texts as bytes) of about ``UNIT_BYTES``."""
    for row, end, raw, offsets in tb.chunks(column, UNIT_BYTES):
        data = raw.tobytes()
        yield row, end, [data[i:j] for i, j in zip(offsets[:-1], offsets[1:])]


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _sent_files(spark: SparkSession, files: tuple[bytes, bytes] | None):
    return spark.sparkContext.broadcast(files or vocabulary_files())


def align(docs: DataFrame, text: str = "text", keep: list[str] | None = None, files: tuple[bytes, bytes] | None = None,
          chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks), both read from one written table.

    documents: the columns ``keep`` (default: all) as ``_doc``, chunk, n_a, n_b, n_groups, n_links, groups_sha256, and the
    distinct linked pairs as places in the chunk's list (``pairs``) with their numbers of links (``times``).
    chunks: chunk, ``keys`` (A id * size of B + B id, ascending) and ``held``, the number of documents with each.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c not in RESULTS]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), *([] if text in names else [F.col(text).alias("_text")]))
    sent = _sent_files(docs.sparkSession, files)
    carried = packed.schema["_doc"].dataType
    columns = ["_doc", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "keys", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Vocabularies.of(*sent.value)
        size_b = len(both.b_bytes)
        span = np.int64(len(both.a_bytes)) * size_b
        decimals = Decimals(max(len(both.a_bytes), size_b))
        number = TaskContext.get().partitionId() << 32
        waiting, weight = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            distinct, inverse, held = np.unique(np.concatenate([w[2] for w in waiting]), return_inverse=True, return_counts=True)
            first = 0
            for rows, stats, keys, times, bounds, digests in waiting:
                n = len(digests)
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    rows, pa.array(np.full(n, number)), *[pa.array(x) for x in stats], pa.array(digests, pa.string()),
                    _lists(inverse[first: first + len(keys)], bounds, pa.int32()), _lists(times, bounds, pa.int32()), none, none], names=columns)
                first += len(keys)
            zero, no = pa.array([0], pa.int64()), pa.nulls(1, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, waiting[0][0].type), pa.array([number]), zero, zero, zero, zero, pa.array([""]), no, no,
                _lists(distinct, np.array([0, len(distinct)]), pa.int64()), _lists(held, np.array([0, len(held)]), pa.int64())], names=columns)

        for batch in batches:
            for row, end, raws in _units(tb.text_column(batch, names, text)):
                lists_a, lists_b = both.tokens(raws)
                (a, a_bounds), (b, b_bounds) = _flat(lists_a), _flat(lists_b)
                found = Aligned(both.a_len[a], a_bounds, both.b_len[b], b_bounds)
                linked, times = np.unique(
                    found.link_text * span + a[found.link_a] * size_b + b[found.link_b], return_counts=True)
                bounds = np.searchsorted(linked, np.arange(end - row + 1) * span)
                stats = (np.diff(a_bounds), np.diff(b_bounds), found.n_groups, found.n_links)
                waiting.append((batch.column(0).slice(row, end - row), stats, linked % span, times, bounds,
                                group_digests(found, a, b, decimals)))
                weight += sum(map(len, raws)) + 1
                if weight >= chunk_bytes:
                    yield from flush()
                    waiting, weight, number = [], 0, number + 1
        if waiting:
            yield from flush()

    schema = (f"_doc {carried.simpleString()}, chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "pairs array<int>, times array<int>, keys array<bigint>, held array<bigint>")
    written = cut_lineage(packed.mapInArrow(run, schema), "alignment")
    return written.filter("pairs IS NOT NULL").drop("keys", "held"), written.filter("keys IS NOT NULL").select("chunk", "keys", "held")


def link_counts(chunks: DataFrame, size_b: int) -> DataFrame:
    """(key, documents, best): documents that hold each pair, and whether no pair of the same A id stands in more."""
    counts = cut_lineage(
        chunks.select(F.inline(F.arrays_zip("keys", "held"))).groupBy(F.col("keys").alias("key")).agg(F.sum("held").alias("documents")),
        "alignment-counts").withColumn("_a", F.expr(f"key div {size_b}"))
    most = counts.groupBy(F.col("_a").alias("_b")).agg(F.max("documents").alias("_most"))
    return counts.join(most, F.col("_a") == F.col("_b")).select("key", "documents", (F.col("documents") == F.col("_most")).alias("best"))


def aligned_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None, files: tuple[bytes, bytes] | None = None,
                      chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns ``keep`` (default: all) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    files = files or vocabulary_files()
    size_b = len(Vocabularies.of(*files).b_bytes)
    found, chunks = align(docs, text, keep, files, chunk_bytes)
    asked = chunks.select(F.col("chunk").alias("_chunk"), F.posexplode("keys").alias("place", "key"))
    told = asked.join(link_counts(chunks, size_b).withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).select(
        "_chunk", "place", "documents", "best")
    schema = found.select("_doc", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"),
                          F.lit(0).cast("long").alias("count_sum"), "groups_sha256").schema

    def settle(rows: pa.Table, told: pa.Table) -> pa.Table:
        """Sums over the links of a chunk's documents."""
        place = told.column("place").to_numpy()
        documents, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        documents[place] = told.column("documents").to_numpy()
        best[place] = told.column("best").to_numpy(zero_copy_only=False)
        rows = rows.combine_chunks()
        bounds = np.concatenate(([0], np.cumsum(rows.column("pairs").combine_chunks().value_lengths().to_numpy())))
        pairs, times = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("pairs", "times"))
        sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[pairs])))[bounds]) for x in (best, documents)]
        return pa.table([rows.column("_doc"), *[rows.column(c) for c in RESULTS[:4]], *map(pa.array, sums), rows.column("groups_sha256")],
                        names=["_doc", *RESULTS])

    return found.groupBy("chunk").cogroup(told.groupBy("_chunk")).applyInArrow(settle, schema).select("_doc.*", *RESULTS)


def token_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", files: tuple[bytes, bytes] | None = None) -> DataFrame:
    """(key, a_ids, b_ids, first_byte, end_byte), one row per group: the smallest runs of tokens that cover the same bytes."""
    sent = _sent_files(docs.sparkSession, files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Vocabularies.of(*sent.value)
        for batch in batches:
            for row, end, raws in _units(batch.column(1)):
                lists_a, lists_b = both.tokens(raws)
                (a, a_bounds), (b, b_bounds) = _flat(lists_a), _flat(lists_b)
                sizes = both.a_len[a]
                found = Aligned(sizes, a_bounds, both.b_len[b], b_bounds)
                a_cuts, b_cuts = (np.concatenate(([0], np.flatnonzero(c) + 1)) for c in (found.a_common, found.b_common))
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                text_of = np.searchsorted(a_bounds, a_cuts[:-1], "right") - 1
                base = offsets[a_bounds[text_of]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, end - row).take(pa.array(text_of)), _lists(a, a_cuts, pa.int32()), _lists(b, b_cuts, pa.int32()),
                    pa.array(offsets[a_cuts[:-1]] - base), pa.array(offsets[a_cuts[1:]] - base)],
                    names=[key, "a_ids", "b_ids", "first_byte", "end_byte"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, a_ids array<int>, b_ids array<int>, first_byte bigint, end_byte bigint")
