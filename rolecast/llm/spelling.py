"""Spelling variants: words that one inserted, deleted or replaced code point turns into a commoner word.

Pairs of words at distance one are found by pivotal grams.  Bigrams have a global order,
the rarest among the words first.  A word's gram prefix is its three rarest bigrams (and
what ties with the third); its pivots are the two bigrams of the prefix that do not
overlap and are rarest together, chosen by dynamic programming over their places.  One
edit cannot touch both pivots, so one of them stands in the other word as well, and it
stands in that word's prefix if that prefix does not end earlier in the global order than
the word's own; of two near words at least one is therefore found by a pivot of it in the
other's prefix.

The position limit is as tight as one edit allows.  Where the edit is before the pivot, the
two words are equal from the pivot on, counted from their ends; and as the letters before
it hold one edit, either their first half is equal as well, or all from there on.  Likewise
behind the pivot.  So each pivot asks for the hashes of these parts in words of one length
or one more or less, and the index holds them for each prefix bigram.  Candidates are
verified by the edit distance itself.  Words of more than 256 letters are paired by their
halves, which is as exact.

Counting runs on byte arrays: each task sends every word of a few megabytes once, with its
count.  The order of the bigrams is a table of at most 90 times 90 rows, since words
consist of 90 letters.

Edge cases: a null or empty text has no words; a null id counts as an empty one in the
planted deletions; repeated rows are documents of their own; a deletion that makes a word
too short takes that occurrence away.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm import textbytes as tb
from rolecast.operators.shaping import cut_lineage

MIN_LETTERS, MIN_COUNT, TIMES = 5, 3, 2
PREFIX, PIVOTS = 3, 2
#: Words up to this length go by pivots, from it on by halves: near words are both in one of the two.
LONG = 256


# ------------------------------------------------------------------------- words


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from the crc32 ``state`` of what stands before it."""
    crc = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    live, k = np.flatnonzero(ends > starts), 0
    while len(live):
        crc[live] = _CRC[(crc[live] ^ data[starts[live] + k]) & np.uint32(0xFF)] ^ (crc[live] >> np.uint32(8))
        k += 1
        live = live[starts[live] + k < ends[live]]
    return crc ^ np.uint32(0xFFFFFFFF)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, in bytes."""
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    folded = data | np.uint8(0x20)
    inside = lead | tail | ((folded >= 0x61) & (folded <= 0x7A))
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    begin, stop = edge[:-1] == 1, edge[1:] == -1
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = inside[inner]
    stop[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(offsets, starts, "right") - 1


def chunk_words(raw: np.ndarray, offsets: np.ndarray, ids: list, least: int, every: int) -> tuple[list[str], np.ndarray]:
    """Distinct words of some texts, with the planted deletions, and their counts."""
    data = tb.lower_ascii(raw)
    starts, ends, text = letter_runs(data, offsets)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    length = letters[ends] - letters[starts]
    seeds = np.array([zlib.crc32(b":" if i is None else f"{i}:".encode()) for i in ids], np.uint32)
    h = span_crcs(data, starts, ends, seeds[text])
    cut = (h % np.uint32(every) == 0) if every else np.zeros(len(h), bool)
    counts: dict[str, int] = {}
    for i in np.flatnonzero(cut & (length > least)):
        word = data[starts[i]: ends[i]].tobytes().decode()
        at = int(h[i]) % len(word)
        word = word[:at] + word[at + 1:]
        counts[word] = counts.get(word, 0) + 1
    whole = np.flatnonzero(~cut & (length >= least))
    _, first, number = np.unique(tb.span_hashes(data, starts[whole], ends[whole]), return_index=True, return_counts=True)
    flat = data.tobytes()
    for i, n in zip(whole[first].tolist(), number.tolist()):
        word = flat[starts[i]: ends[i]].decode()
        counts[word] = counts.get(word, 0) + n
    return list(counts), np.array(list(counts.values()), np.int64)


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                every: int = 97) -> DataFrame:
    """(word, n): lower-cased runs of at least ``least`` letters and ``min_count`` occurrences.

    Of a run whose crc32 with its document's id is divisible by ``every`` one letter is deleted first; 0 deletes none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, offsets in tb.chunks(batch.column(1)):
                words, n = chunk_words(raw, offsets, batch.column(0).slice(row, end - row).to_pylist(), least, every)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], names=["word", "n"])

    parts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --------------------------------------------------------------------- near words


def gram_order(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram, the rarest among the words first; at most 8100 rows, which is why they may come to the driver."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r.gram: i for i, r in enumerate(sorted(counted, key=lambda r: (r.n, r.gram)))}


def pivot_places(places: np.ndarray, ranks: np.ndarray, pivots: int = PIVOTS) -> list[int]:
    """Places of ``pivots`` bigrams that do not overlap and whose ranks have the least sum.

    ``best[k][j]``: least sum of k of the first j bigrams by place, with the places chosen.
    """
    order = np.argsort(places)
    at, cost = [int(places[i]) for i in order], [int(ranks[i]) for i in order]
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] * (len(at) + 1)]
    for k in range(1, pivots + 1):
        row = [(math.inf, ())]
        for j in range(1, len(at) + 1):
            free = j - 1
            while free and at[free - 1] > at[j - 1] - 2:
                free -= 1
            before = best[k - 1][free]
            row.append(min(row[-1], (before[0] + cost[j - 1], before[1] + (at[j - 1],))))
        best.append(row)
    return list(best[pivots][-1][1])


def word_keys(word: str, order: dict[str, int]) -> tuple[list[int], list[int]]:
    """(places of the pivots, places of the gram prefix) of one word."""
    ranks = np.array([order[word[i: i + 2]] for i in range(len(word) - 1)])
    third = np.partition(ranks, PREFIX - 1)[PREFIX - 1] if len(ranks) >= PREFIX else ranks.max()
    prefix = np.flatnonzero(ranks <= third)
    return pivot_places(prefix, ranks[prefix]), prefix.tolist()


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of words at distance one, in both directions; words have four letters or more."""
    sized = words.select("word", F.char_length("word").alias("size"))
    pairs = _by_pivots(sized.filter(F.col("size") <= LONG).select("word")).unionByName(_by_halves(sized.filter(F.col("size") >= LONG)))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def _by_pivots(words: DataFrame) -> DataFrame:
    """Pairs of words of at most ``LONG`` letters, in one direction at least."""
    order = words.sparkSession.sparkContext.broadcast(gram_order(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 2000):
                names = batch.column(0).slice(row, 2000).to_pylist()
                keys = [word_keys(w, order.value) for w in names]
                data = np.frombuffer("".join(names).encode(), np.uint8)
                letter = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                size = np.array([len(w) for w in names])
                first = np.cumsum(size) - size

                def part(word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
                    return tb.span_hashes(data, letter[first[word] + begin], letter[first[word] + end])

                for pivot in (True, False):
                    places = [k[not pivot] for k in keys]
                    word = np.repeat(np.arange(len(names)), [len(p) for p in places])
                    at = np.array([p for own in places for p in own], np.int64)
                    for more in (-1, 0, 1) if pivot else (0,):
                        for number, h in enumerate(_asked(part, word, at, size[word], more)):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(h[0]), pivot)), pa.array([names[i] for i in h[0].tolist()], pa.string()),
                                 pa.array(tb.mix(h[1] + np.uint64(number)).view(np.int64))], names=["pivot", "word", "h"])

    rows = cut_lineage(words.mapInArrow(run, "pivot boolean, word string, h bigint"), "spelling-grams")
    asks = rows.filter("pivot").select("word", "h")
    index = rows.filter("NOT pivot").select(F.col("word").alias("near"), F.col("h").alias("_h"))
    met = asks.join(index, (F.col("h") == F.col("_h")) & (F.col("word") != F.col("near")))
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near")


def _asked(part, word: np.ndarray, at: np.ndarray, size: np.ndarray, more: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Four lists of (words, hashes): what one edit leaves in a word ``more`` letters longer that has the bigram, too.

    ``before`` is the number of letters in front of the bigram in the other word.  If the edit is among them, the words
    are equal from the bigram on.  And they either begin with the same half of these letters, or are equal from there on.
    The same holds behind the bigram.
    """
    none, out = np.zeros_like(at), []
    tag = (size + more).astype(np.uint64) << np.uint64(8)
    for before, front in ((at + more, True), (size - at - 2 + more, False)):
        half = before // 2
        some = np.flatnonzero(before >= 0)
        w, h, s, p = word[some], half[some], size[some], at[some]
        kept = part(w, p, s) if front else part(w, none[some], p + 2)
        outer = part(w, none[some], h) if front else part(w, s - h, s)
        out.append((w, tb.mix(kept ^ tb.mix(outer)) + tag[some]))
        some = np.flatnonzero((before >= 0) & (half > 0))
        w, h, s = word[some], half[some], size[some]
        inner = part(w, h - more, s) if front else part(w, none[some], s + more - h)
        out.append((w, inner + tag[some]))
    return out


def _by_halves(words: DataFrame) -> DataFrame:
    """Pairs of words of at least ``LONG`` letters (word, size): one edit leaves one half of the shorter word as it is.

    A very long run of few letters would have a prefix row for each of its letters.
    """
    def halves(df: DataFrame, shorter: Column) -> DataFrame:
        half = F.floor(shorter / 2).cast("int")
        parts = F.array(F.struct(F.lit("front").alias("side"), F.left("word", half).alias("part")),
                        F.struct(F.lit("back").alias("side"), F.right("word", shorter - half).alias("part")))
        return df.select("word", "size", shorter.alias("shorter"), F.explode(parts).alias("half"))

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("word", "size", F.xxhash64("shorter", "half.side", "half.part").alias("h"))

    own = keyed(halves(words, F.col("size")))
    more = own.unionByName(keyed(halves(words, F.col("size") - 1))).select(F.col("word").alias("near"), F.col("h").alias("_h"))
    met = own.join(more, (F.col("h") == F.col("_h")) & (F.col("word") != F.col("near")))
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near")


# -------------------------------------------------------------------------- forms


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = 97,
             times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    ``form``: the commonest near word (ties: the first in code-point order) if it is at least ``times`` as common.
    """
    if least < 4 or times <= 1:
        raise ValueError("two bigrams that do not overlap need four letters, and forms commoner than their words end chains")
    words = cut_lineage(count_words(docs, text, key, least, min_count, every), "spelling-words")
    near = near_pairs(words).join(words.select(F.col("word").alias("_near"), F.col("n").alias("_n")), F.col("near") == F.col("_near"))
    nearest = near.groupBy(F.col("word").alias("_word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), "near")).alias("first"))
    joined = words.join(nearest, F.col("word") == F.col("_word"), "left")
    takes = -F.col("first.less") >= times * F.col("n")
    formed = cut_lineage(joined.select(
        "word", F.when(takes, F.col("first.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, -F.col("first.less")).alias("form_n")), "spelling-forms")
    roots = _roots(formed, min_count, times)
    return formed.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame, min_count: int, times: int) -> DataFrame:
    """(_word, root) of the words that have a form, by doubling the steps.

    Each form is ``times`` as common as its word, so a chain is no longer than the logarithm of the largest count.
    """
    steps = formed.filter("form IS NOT NULL").select(F.col("word").alias("_word"), F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.ceil(math.log(max(1.0, most / min_count), times)) + 1)
    for _ in range(max(1, math.ceil(math.log2(longest)))):
        ahead = steps.select(F.col("_word").alias("_at"), F.col("root").alias("_next"))
        steps = cut_lineage(steps.join(ahead, F.col("root") == F.col("_at"), "left").select("_word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
    return steps
