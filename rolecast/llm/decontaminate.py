"""Benchmark decontamination: rare words make the pairs, then a check word by word; latent cosine of the hits.

1. Passages of 64 words are rows of a TF-IDF matrix over hashed terms.  A randomised
   singular value decomposition of all passages is computed in one pass: each task
   sums its part of A'A R for a fixed random R, Spark adds the parts, and the small
   rest (Nystroem: A'A is about Z (R'Z)^-1 Z') is done on the driver, whose size depends
   on the number of terms and dimensions only.
2. Every document is read again in cells of 16 words.  An index of each item's rarest
   words makes the (cell, item) pairs: those of an item's words that stand where a
   match could bound the longest common subsequence from above, so no pair is lost.
3. For every pair that meets the bound the subsequence is computed.  A document leaks
   an item if the subsequence has ``near`` of the item's words, or ``paraphrase`` of
   them and the item's answer stands there too.  A subsequence may cover ``STRETCH``
   times the item's own words of text; what other items there are does not matter.
   The answer is the column ``answer`` where the benchmark has one, else the end of
   the item's text.
4. A hit's position in the latent space, with all directions scaled alike, is compared
   with the item's by cosine.  The cosine is given with the hit and, of equally long
   matches in a document, chooses the one that is given; it decides about no pair.

Benchmark items are compared in blocks of ``item_block``, each with its own pass, so
what is sent to the tasks is bounded.

Edge cases: null or empty texts and items without words match nothing; several
items with one text are found each; repeated rows are found each; an empty
benchmark or an empty document table gives no hits; columns are carried as asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm import textbytes as tb

TERMS = 1 << 14
DIMS, OVERSAMPLE = 32, 8
CELL = 16
PASSAGE = 64
#: Items of up to this many words have their cosine with small windows (2 cells), longer ones with large (4 cells).
SHORT = 24
BLOCK_TERMS = 512
#: A match covers at most so many times the item's number of words.
STRETCH = 2


def _word_arrays(column: pa.Array):
    """(first row, row after, word hashes, offsets of the texts among the words) per chunk."""
    for row, end, raw, offsets in tb.chunks(column):
        data = tb.lower_latin(raw)
        starts, ends, bounds = tb.words(data, offsets)
        yield row, end, tb.span_hashes(data, starts, ends), bounds


def _runs(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of runs of ``size`` words that do not cross texts, offsets of the texts among the runs)."""
    counts = -(-np.diff(bounds) // size)
    first = np.concatenate(([0], np.cumsum(counts)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.repeat(bounds[:-1], counts) + within * size, first


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(passages with each hashed term, passages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, _, hashes, bounds in _word_arrays(batch.column(0)):
                starts, _ = _runs(bounds, PASSAGE)
                which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
                pairs = np.sort(which * TERMS + (hashes & np.uint64(TERMS - 1)).astype(np.int64))
                new = np.ones(len(pairs), bool)
                new[1:] = pairs[1:] != pairs[:-1]
                counts += np.bincount(pairs[new] & (TERMS - 1), minlength=TERMS)
                passages += len(starts)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], passages))], names=["term", "n"])

    rows = docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS)
    known = rows[rows["term"] >= 0]
    out[known["term"].to_numpy()] = known["n"].to_numpy()
    total = rows.loc[rows["term"] < 0, "n"].sum()
    return out, int(total)


def _random(dims: int) -> np.ndarray:
    return np.random.default_rng(20_11).standard_normal((TERMS, dims)).astype(np.float32)


def _added(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Sums of float blocks by key."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, np.float32) for b in part["z"]], axis=0, dtype=np.float64)
        return pd.DataFrame({**{c: [part[c].iloc[0]] for c in by}, "z": [total.astype(np.float32).tobytes()]})

    return blocks.groupBy(*by).applyInPandas(run, ", ".join(f"{c} int" for c in by) + ", z binary")


def latent_map(docs: DataFrame, text: str = "text", dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """((TERMS, dims): a text's position is the sum of its words' rows; inverse document frequency per term)."""
    frequency, passages = document_frequencies(docs, text)
    if passages == 0:
        return np.zeros((TERMS, dims), np.float32), np.zeros(TERMS, np.float32)
    idf = np.log((1.0 + passages) / (1.0 + frequency)).astype(np.float32)
    width = dims + OVERSAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, z, seed = _random(width) * idf[:, None], np.zeros((TERMS, width), np.float64), 0
        for batch in batches:
            for _, _, hashes, bounds in _word_arrays(batch.column(0)):
                if not len(hashes):
                    continue
                seed ^= int(hashes[0] & np.uint64(63))
                term = (hashes & np.uint64(TERMS - 1)).astype(np.uint16)
                weight = idf[term]
                starts, _ = _runs(bounds, PASSAGE)
                which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
                norm = np.add.reduceat(weight * weight, starts)
                y = np.add.reduceat(directions[term], starts, axis=0) / np.maximum(norm, 1e-6).astype(np.float32)[:, None]
                order = np.argsort(term, kind="stable")
                sorted_terms = term[order]
                cuts = np.flatnonzero(np.concatenate(([True], sorted_terms[1:] != sorted_terms[:-1])))
                z[sorted_terms[cuts]] += np.add.reduceat(y[which[order]], cuts, axis=0)
        z *= idf[:, None]
        parts = z.astype(np.float32).reshape(-1, BLOCK_TERMS * width)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(parts)), pa.int32()), pa.array(np.full(len(parts), seed), pa.int32()),
            pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "salt", "z"])

    parts = docs.select(text).mapInArrow(run, "block int, salt int, z binary")
    # Two steps, so that no group grows with the number of tasks alone.
    rows = _added(_added(parts, ["block", "salt"]).select("block", "z"), ["block"]).toPandas().sort_values("block")
    z = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, width) for b in rows["z"]]).astype(np.float64)
    core = _random(width).astype(np.float64).T @ z
    core = (core + core.T) / 2 + 1e-8 * np.trace(core) / width * np.eye(width)
    values, vectors = np.linalg.eigh(core)
    good = values > 1e-12 * values.max()
    left, singular, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    left, singular = left[:, :dims], np.maximum(singular[:dims], 1e-9 * singular[0])
    out = idf[:, None] * left / singular
    return np.pad(out, ((0, 0), (0, dims - out.shape[1]))).astype(np.float32), idf


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with one bit per word of the item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = where.get(w)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


class Items:
    """A block of benchmark items: word hashes, answers, and latent probes for the two window sizes."""

    def __init__(self, ids: list, texts: list[str], answers: list[str | None], latent: np.ndarray, idf: np.ndarray, share: float):
        """``share`` of an item's words have to stand around a window for it to be looked at."""
        self.ids, self.words, self.answers, self.need, probes, rare = [], [], [], [], ([], []), []
        for item, text, answer in zip(ids, texts, answers):
            words = self._hashes(text or "")
            if not len(words):
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(words)
            # Of the rarest words of an item, those that a subsequence of the wanted length cannot do without.
            order = np.argsort(-idf[(words & np.uint64(TERMS - 1)).astype(np.int64)], kind="stable")
            chosen = max(len(words) // 2, len(words) - int(np.ceil(share * len(words) - 1e-9))) + 1
            self.need.append(max(1, int(np.ceil(share * len(words) - 1e-9)) - (len(words) - chosen)))
            kinds, counts = np.unique(words[order[:chosen]], return_counts=True)
            rare += [(w, k, c) for w, c in zip(kinds, counts)]
            tail = self._hashes(answer) if answer is not None else words[-max(3, len(words) // 6):]
            self.answers.append(tail.tolist())
            for at in range(0, len(words), PASSAGE):
                part = words[at: at + PASSAGE]
                if at == 0 or len(part) > SHORT:
                    vector = latent[(part & np.uint64(TERMS - 1)).astype(np.int64)].sum(axis=0)
                    probes[len(part) > SHORT].append((k, vector))
        sizes = np.array([len(w) for w in self.words], np.int64)
        # Cells that a match can touch, and cells from which starts are looked at together.
        self.reach = (STRETCH * sizes + CELL - 2) // CELL + 1
        self.step = np.maximum(1, self.reach // 4)
        rare.sort()
        self.rare_words, first = np.unique(np.array([r[0] for r in rare], np.uint64), return_index=True)
        self.postings = np.append(first, len(rare))
        self.rare_item = np.array([r[1] for r in rare], np.int64)
        self.rare_count = np.array([r[2] for r in rare], np.int64)
        self.need = np.array(self.need, np.int64)
        self.probes = [(np.array([k for k, _ in side], np.int64), _unit(np.array([v for _, v in side]).reshape(-1, latent.shape[1])))
                       for side in probes]

    def met_around(self, hashes: np.ndarray, cell_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, item) pairs with enough of the item's rare words where matches stand that start in ``step`` cells from there on.

        Every word of the text counts at most as often as the item has it, so the count bounds
        the common subsequence from above together with the words that are not rare.
        """
        slot = np.minimum(np.searchsorted(self.rare_words, hashes), max(len(self.rare_words) - 1, 0))
        at = np.flatnonzero(self.rare_words[slot] == hashes) if len(self.rare_words) else np.zeros(0, np.int64)
        lists = self.postings[slot[at] + 1] - self.postings[slot[at]]
        entry = np.repeat(self.postings[slot[at]] - (np.cumsum(lists) - lists), lists) + np.arange(lists.sum())
        cell, step = np.repeat(cell_of[at], lists), self.step[self.rare_item[entry]]
        first = np.maximum(-((self.reach[self.rare_item[entry]] + step - 2 - cell) // step), 0)
        several = cell // step - first + 1
        # One row per (first cell, entry): how often the word stands there, up to the item's own count.
        spread = (np.repeat(first - (np.cumsum(several) - several), several) + np.arange(several.sum())) * np.repeat(step, several)
        seen, times = np.unique(spread * np.int64(len(self.rare_item)) + np.repeat(entry, several), return_counts=True)
        which = seen % len(self.rare_item) if len(seen) else seen
        times = np.minimum(times, self.rare_count[which])
        pair, number = np.unique((seen // max(len(self.rare_item), 1)) * np.int64(len(self.ids) + 1) + self.rare_item[which], return_inverse=True)
        total = np.bincount(number, weights=times)
        item = pair % (len(self.ids) + 1)
        enough = total >= self.need[item]
        return pair[enough] // (len(self.ids) + 1), item[enough]

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        data = tb.lower_latin(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
        starts, ends, _ = tb.words(data, np.array([0, len(data)]))
        return tb.span_hashes(data, starts, ends)


def _leaks(hashes: np.ndarray, bounds: np.ndarray, items: Items, latent: np.ndarray, near: float,
           paraphrase: float) -> list[tuple]:
    """(text, item, subsequence, cosine, first word, kind) of one chunk, the best window of each pair."""
    starts, cells = _runs(bounds, CELL)
    if not len(starts):
        return []
    sums = np.add.reduceat(latent[(hashes & np.uint64(TERMS - 1)).astype(np.int64)], starts, axis=0)
    running = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
    text_of = np.repeat(np.arange(len(cells) - 1), np.diff(cells))
    last = cells[1:][text_of]
    cell_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
    best: dict[tuple[int, int], tuple] = {}
    met_cell, met_item = items.met_around(hashes, cell_of)
    for (owner, probe), span in zip(items.probes, (2, 4)):
        if not len(owner):
            continue
        of_side = np.isin(met_item, owner)
        cell, item = met_cell[of_side], met_item[of_side]
        # The starts that are looked at together, cell by cell.
        several = np.minimum(items.step[item], len(starts) - cell)
        cell = np.repeat(cell - (np.cumsum(several) - several), several) + np.arange(several.sum())
        item = np.repeat(item, several)
        stop = np.minimum(cell + span, last[cell])
        vectors = _unit(running[stop] - running[cell])
        first = np.searchsorted(owner, item)
        similar = np.full(len(cell), -1.0)
        # An item of several probes is near if one of them is.
        for more in range(int(np.bincount(owner).max())):
            ok = (first + more < len(owner)) & (owner[np.minimum(first + more, len(owner) - 1)] == item)
            similar[ok] = np.maximum(similar[ok], (vectors[ok] * probe[first[ok] + more]).sum(axis=1))
        for c, i, value in zip(cell.tolist(), item.tolist(), similar.tolist()):
            text = int(text_of[c])
            found = _match(items, i, hashes, int(starts[c]), int(bounds[text]), int(bounds[text + 1]), near, paraphrase)
            if found:
                length, at, kind = found
                found = (length, value, at, kind)
                old = best.get((text, i))
                if old is None or found[:2] > old[:2]:
                    best[text, i] = found
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def _match(items: Items, i: int, hashes: np.ndarray, start: int, begin: int, end: int, near: float,
           paraphrase: float) -> tuple[int, int, str] | None:
    """(subsequence, first word, kind) of the longest match of an item that starts in the cell at ``start`` of a text."""
    words = items.words[i].tolist()
    stretch, reach = STRETCH * len(words), max(2 * CELL, len(words))
    text = hashes[start: min(start + CELL - 1 + stretch, end)].tolist()
    least = min(near, paraphrase) * len(words)
    if common_subsequence(words, text) < least:
        return None
    best, known = None, set(words)
    for k in range(min(CELL, len(text))):
        if text[k] not in known:
            continue
        length = common_subsequence(words, text[k: k + stretch])
        if length < least or (best and length <= best[0]):
            continue
        a = max(start + k - reach, begin)
        if length >= near * len(words):
            best = length, start + k - begin, "near"
        elif length >= paraphrase * len(words) and _stands(items.answers[i], hashes[a: min(start + k + stretch + reach, end)].tolist()):
            best = length, start + k - begin, "paraphrase"
    return best


def _stands(needle: list[int], words: list[int]) -> bool:
    n = len(needle)
    return n > 0 and any(words[i: i + n] == needle for i in range(len(words) - n + 1))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
               item_key: str = "item_id", item_text: str = "text", answer: str = "answer",
               near: float = 0.75, paraphrase: float = 0.6, item_block: int = 20_000) -> DataFrame:
    """The columns ``keep`` (default: all) with ``leaks``: item, item_words, common, cosine, at (word), kind."""
    names = [c for c in (keep if keep is not None else docs.columns) if c != "leaks"]
    items = benchmark.select(
        F.col(item_key).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("words"),
        (F.col(answer).cast("string") if answer in benchmark.columns else F.lit(None).cast("string")).alias("answer"))
    blocks = max(1, -(-items.count() // item_block))
    latent, idf = latent_map(docs, text)
    hits = "array<struct<item: bigint, item_words: bigint, common: bigint, cosine: double, at: bigint, kind: string>>"
    carried = [c for c in names if c != text]
    out = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carried]).alias("_doc"), F.col(text).cast("string").alias("_text"),
                      F.lit(None).cast(hits).alias("leaks"))
    kind = out.schema["_doc"].dataType.simpleString()
    for b in range(blocks):
        # About item_block items, whatever the benchmark's size.
        some = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).orderBy("item", "words").toPandas()
        known = Items([None if pd.isna(i) else int(i) for i in some["item"]], some["words"].tolist(), [a if isinstance(a, str) else None for a in some["answer"]],
                      latent, idf, min(near, paraphrase))
        out = out.mapInArrow(_scanner(known, latent, near, paraphrase, b + 1 == blocks and text not in names),
                             f"_doc {kind}, _text string, leaks {hits}")
    return out.select(*[F.col("_text").alias(c) if c == text else F.col(f"_doc.`{c}`") for c in names],
                      F.coalesce("leaks", F.array().cast(hits)).alias("leaks"))


def _scanner(items: Items, latent: np.ndarray, near: float, paraphrase: float, drop_text: bool):
    """Adds the leaks of one block of items; the texts go along as long as they are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, hashes, bounds in _word_arrays(batch.column(1)):
                found: list[list] = [[] for _ in range(end - row)]
                for t, i, common, cos, at, what in _leaks(hashes, bounds, items, latent, near, paraphrase):
                    found[t].append({"item": items.ids[i], "item_words": len(items.words[i]), "common": common, "cosine": cos,
                                     "at": at, "kind": what})
                before = batch.column(2).slice(row, end - row)
                if before.null_count < len(before):
                    found = [(old or []) + new for old, new in zip(before.to_pylist(), found)]
                texts = pa.nulls(end - row, pa.string()) if drop_text else batch.column(1).slice(row, end - row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), texts, pa.array(found, before.type)], names=["_doc", "_text", "leaks"])

    return run
