"""Near duplicates by BagMinHash signatures of word-shingle multisets.

A text is the multiset of its five-word shingles.  For every shingle, points fall
at random over (time, weight, signature slot), the same points for that shingle in
every text; a text of multiplicity w sees those below weight w.  A slot keeps the
earliest point, so two texts agree in a slot with probability equal to their
weighted Jaccard similarity.

The weights are cut into the dyadic levels [0,1), [1,2), [2,4), [4,8) ..., each a
Poisson process of its own whose rate is the level's length; inside a level a
point's exact weight is drawn by halving.  So a shingle that stands a thousand
times costs eleven processes and few points, not a thousand.  Points are drawn in
order of time and only up to the time by which all slots of that text are filled
(a text whose slots are not all filled is drawn again for twice the time), which
gives the same minima as drawing all of them.

Equal texts are one node.  Signatures are cut into bands; nodes that agree in a
band share a bucket.  A bucket of any size costs one pair per member: each member
is compared with the bucket's leader, the member with the most bucket mates.  The
similarity that decides is exact, by the texts' shingle multisets.  A member that
is not similar to its leader is then compared with those members of the bucket
that are not in its class yet and can be similar to it: by the triangle inequality
of the Jaccard distance, and by how many of their shingles stand in any other such
text at all.  So no link that a bucket offers is lost.  Classes are the
connected components of the links.

Edge cases: a text of fewer than five words, but at least one, is one shingle; a
text without words has no shingles and is only a copy of equal texts; a null text
is an empty one; a class is named by its smallest id, null if it has none;
repeated rows are copies; columns other than key and text are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm import textbytes as tb
from rolecast.operators.components import component_labels
from rolecast.operators.shaping import cut_lineage

SHINGLE = 5
BANDS, ROWS = 24, 5
SIMILARITY = 0.8
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def bags(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, multiplicity) of the distinct shingles of each text, in no particular order."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    tagged = tb.mix(shingles ^ tb.mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(tagged)
    tagged = tagged[order]
    first = np.ones(len(tagged), bool)
    first[1:] = tagged[1:] != tagged[:-1]
    at = np.flatnonzero(first)
    return text[order[at]], shingles[order[at]], np.diff(np.append(at, len(tagged)))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """(n, slots) 32-bit names of each slot's earliest point; rows of texts without shingles hold one filler."""
    out = np.full((n, slots), _NONE, np.uint64)
    total = np.bincount(text, weights=weight, minlength=n)
    limit = np.full(n, slots * (np.log(slots) + 4.0)) / np.maximum(total, 1)
    left = total > 0
    while left.any():
        mine = left[text]
        t, e, w = text[mine], element[mine], weight[mine]
        out[left] = _NONE
        levels = np.where(w == 1, 1, np.ceil(np.log2(np.maximum(w, 2))).astype(np.int64) + 1)
        row = np.repeat(np.arange(len(t)), levels)
        level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
        low = np.where(level == 0, 0, np.int64(1) << np.maximum(level - 1, 0))
        length = np.maximum(low, 1)
        seed = tb.mix(e[row] ^ tb.mix(level.astype(np.uint64) + np.uint64(11)))
        owner, bound, clock = t[row], w[row], np.zeros(len(row))
        until = limit[owner]
        turn = 0
        while len(seed):
            turn += 1
            u = tb.mix(seed + np.uint64(turn * int(_GOLD) & int(_NONE)))
            clock = clock - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
            live = clock < until
            seed, owner, bound, clock, until, low, length, u = (
                x[live] for x in (seed, owner, bound, clock, until, low, length, u))
            more = tb.mix(u ^ np.uint64(0x5851F42D4C957F2D))
            heavy = low + ((more >> np.uint64(32)).astype(np.int64) & (length - 1))
            seen = heavy < bound
            slot = (more & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
            key = (clock[seen].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (
                tb.mix(u[seen]) & np.uint64(0xFFFFFFFF))
            np.minimum.at(out.reshape(-1), owner[seen] * slots + slot[seen].astype(np.int64), key)
        left &= (out == _NONE).any(axis=1)
        limit[left] *= 2
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys; the band's number is part of its key."""
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = tb.mix(h ^ sig[:, b * rows + r]) + _GOLD
        keys[:, b] = h
    return keys


def text_shingles(column: pa.Array, n: int = SHINGLE):
    """(first row, row after, shingle hashes, bounds) per chunk of texts."""
    for row, end, raw, offsets in tb.chunks(column):
        data = tb.lower_latin(raw)
        starts, ends, bounds = tb.words(data, offsets)
        yield (row, end, *tb.shingle_hashes(tb.span_hashes(data, starts, ends), bounds, n))


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(_id, _node, weight, keys) of every row of (_id, _node, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, shingles, bounds in text_shingles(batch.column(2)):
                n = end - row
                sig = signatures(*bags(shingles, bounds), n, bands * rows)
                keys = band_keys(sig, bands, rows).view(np.int64)
                size = np.diff(bounds)
                counts = np.where(size > 0, bands, 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(keys[size > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(size, pa.int64()), lists],
                    names=["_id", "_node", "weight", "keys"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_node", "_text").mapInArrow(run, f"_id {kind}, _node binary, weight bigint, keys array<bigint>")


def pair_similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of texts side by side."""
    out = np.zeros(len(left))
    sizes = np.diff(tb.column_bytes(left)[1]) + np.diff(tb.column_bytes(right)[1])
    total = np.cumsum(sizes)
    row = 0
    while row < len(out):
        done = total[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(total, done + tb.CHUNK_BYTES, "right")))
        sides = []
        for side in (left, right):
            parts = list(text_shingles(side.slice(row, end - row)))
            text = np.concatenate([a + np.repeat(np.arange(b - a), np.diff(bounds)) for a, b, _, bounds in parts])
            hashes = np.concatenate([s for _, _, s, _ in parts])
            tagged, at, count = np.unique(
                tb.mix(hashes ^ tb.mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
            sides.append((tagged, text[at], count, np.bincount(text, minlength=end - row)))
        (ka, ta, ca, na), (kb, _, cb, nb) = sides
        _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        both = np.bincount(ta[ia], weights=np.minimum(ca[ia], cb[ib]), minlength=end - row)
        out[row:end] = both / np.maximum(na + nb - both, 1)
        row = end
    return out


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of nodes, by their texts (_node, _text)."""
    left = texts.select(F.col("_node").alias("a"), F.col("_text").alias("left"))
    right = texts.select(F.col("_node").alias("b"), F.col("_text").alias("right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pair_similarity(batch.column(2), batch.column(3)))],
                names=["a", "b", "similarity"])

    return joined.mapInArrow(run, "a binary, b binary, similarity double")


def _lone_mass(texts: DataFrame) -> DataFrame:
    """(_node, lone): how many of a text's shingles stand in no other of these texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, shingles, bounds in text_shingles(batch.column(1)):
                text, element, weight = bags(shingles, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row).take(pa.array(text)), pa.array(element.view(np.int64)), pa.array(weight)],
                    names=["_node", "s", "n"])

    rows = texts.select("_node", "_text").mapInArrow(run, "_node binary, s bigint, n bigint")
    once = rows.groupBy("s").agg(F.count("*").alias("texts"), F.min("_node").alias("_node"), F.min("n").alias("n"))
    return once.filter("texts = 1").groupBy("_node").agg(F.sum("n").alias("lone"))


def _links(nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(u, v), u > v: similar nodes, as many as it takes to join each class."""
    keyed = nodes.select("_node", "weight", F.explode("keys").alias("h"))
    shared = keyed.groupBy("h").agg(F.count("*").alias("mates")).filter("mates > 1")
    members = cut_lineage(keyed.join(shared, "h"), "dup-members")
    degree = members.groupBy("_node").agg(F.sum("mates").alias("degree"))
    leaders = members.select("h", "_node").join(degree, "_node").groupBy("h").agg(
        F.max(F.struct("degree", "_node"))["_node"].alias("leader"))
    led = cut_lineage(members.select("h", "_node", "weight").join(leaders, "h").filter(F.col("_node") != F.col("leader")), "dup-led")
    stars = cut_lineage(led.select(F.col("_node").alias("a"), F.col("leader").alias("b")).distinct(), "dup-stars")

    rep = nodes.select("_node", "rep")
    wanted = members.select("_node").distinct().join(rep, "_node").select(
        F.col("_node").alias("_n"), F.col("rep").alias("_rep"))
    texts = docs.join(wanted, (F.col("_node") == F.col("_n")) & F.col("_id").eqNullSafe(F.col("_rep")))
    texts = cut_lineage(texts.select("_node", "_text").dropDuplicates(["_node"]), "dup-texts")

    checked = cut_lineage(_verify(stars, texts), "dup-checked")
    as_edge = lambda df: df.filter(F.col("similarity") >= similarity).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = as_edge(checked)

    labels = cut_lineage(component_labels(found), "dup-labels")

    # What a leader did not settle: members of other classes that the distances to the leader and the common
    # shingles allow.  A pair counts in the first bucket that it shares.
    known = led.join(checked, (F.col("_node") == F.col("a")) & (F.col("leader") == F.col("b"))).select(
        "h", "_node", "weight", "similarity")
    named = labels.select(F.col("node").alias("_node"), "label")
    known = known.join(named, "_node", "left").withColumn("label", F.coalesce("label", "_node"))
    mixed = known.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("h")
    known = cut_lineage(known.join(mixed, "h", "left_semi"), "dup-mixed")
    lone = _lone_mass(texts.join(known.select("_node").distinct(), "_node", "left_semi"))
    known = known.join(lone, "_node", "left").withColumn("meets", F.col("weight") - F.coalesce("lone", F.lit(0)))
    # A partner has at least this share of a text's size, and all of it in common at best.
    known = known.filter(F.col("meets") >= similarity * F.col("weight") - 1e-9).join(nodes.select("_node", "keys"), "_node")
    side = lambda p: known.select(
        *[F.col(c).alias(p + c) for c in ("h", "_node", "weight", "similarity", "label", "meets", "keys")])
    far = 1 - similarity
    # Two texts with similarity s have s / (1 + s) of their joint size in common.
    need = similarity / (1 + similarity) * (F.col("xweight") + F.col("yweight")) - 1e-9
    rest = side("x").filter(F.col("xsimilarity") < similarity).join(side("y"), F.col("xh") == F.col("yh")).filter(
        (F.col("xlabel") != F.col("ylabel"))
        & (F.abs(F.col("xsimilarity") - F.col("ysimilarity")) <= far + 1e-9)
        & (F.least("xmeets", "ymeets") >= need) & (F.array_min(F.array_intersect("xkeys", "ykeys")) == F.col("xh")))
    rest = cut_lineage(rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "dup-rest")
    return found.unionByName(as_edge(_verify(rest, texts))).distinct()


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(key).alias("_id"),
        F.unhex(F.md5(whole.cast("binary"))).alias("_node"), whole.alias("_text"))


def _classes(keyed: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(signed rows (_id, _node), nodes with their class: _node, class_id, head)."""
    signed = cut_lineage(_signed(keyed, BANDS, ROWS), "dup-signed")
    nodes = cut_lineage(signed.groupBy("_node", "weight", "keys").agg(
        F.min("_id").alias("rep"), F.count("*").alias("copies")), "dup-nodes")
    labels = component_labels(_links(nodes, keyed.select("_id", "_node", "_text"), similarity))
    labelled = nodes.select("_node", "rep", "copies").join(
        labels.select(F.col("node").alias("_node"), "label"), "_node", "left").withColumn("label", F.coalesce("label", "_node"))
    # The smallest id names the class; nulls only where there is no other, equal ids by node.
    order = F.struct(F.col("rep").isNull(), F.col("rep"), F.col("_node"))
    heads = labelled.groupBy("label").agg(
        F.min(order)["_node"].alias("head"), F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"),
        F.count("*").alias("class_texts"))
    return signed.select("_id", "_node"), cut_lineage(labelled.select("_node", "rep", "label").join(heads, "label").drop("label"), "dup-classes")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, class_size, class_texts), one row per document: the class's smallest id, rows and different texts."""
    signed, classes = _classes(_keyed(docs, text, key), similarity)
    return signed.join(classes.drop("rep", "head"), "_node").select(
        F.col("_id").alias(key), "class_id", "class_size", "class_texts")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class stays, the one with the smallest id; all columns as they are."""
    keyed = _keyed(docs, text, key)
    _, classes = _classes(keyed, similarity)
    heads = classes.filter(F.col("head") == F.col("_node")).select(F.col("_node").alias("_n"), F.col("rep").alias("_rep"))
    kept = keyed.join(heads, (F.col("_node") == F.col("_n")) & F.col("_id").eqNullSafe(F.col("_rep")))
    return kept.dropDuplicates(["_node"]).select("_doc.*")
