"""Approximate nearest neighbours by an adaptive scan over column blocks (cosine).

Vectors are scaled to length one and rotated at random, so that any leading columns
are a fair sample of a distance.  They are dealt to lists around centroids, which are
fitted on a bounded sample; every vector is in a list.  A query probes the lists of
its nearest centroids, as many as the sample's own neighbours call for.  Inside a list, candidates are read column block by column
block: after each block a hypothesis test asks whether the distance so far, scaled up,
could still belong to a distance below the query's fifth best; candidates that fail
are abandoned.  What survives all blocks is scored on the original vectors in double
precision.

Lists are cut into parts of at most about ``part_size`` vectors, so a popular vector
or centroid does not meet in one task; each part returns its best k per query and
Spark merges them.  A query probes further lists until these hold k vectors beside
itself, so no query comes back short while there are candidates.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no
part; vectors of different lengths have no cosine, so each length is a search of its
own; vectors are scaled by powers of two before anything is squared, which changes no
digit and lets components of any finite size be compared; equal scores go to the
smaller id; ids that stand twice are different candidates, but a row is never its
query's candidate under its own id; equal rows of one query id are one query, rows with
different vectors are a query each, with ranks of their own; no vectors give no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecast.operators.shaping import cut_lineage

#: Strictness of the abandoning test: the share of wrong abandonings falls with exp(-c * EPSILON**2).
EPSILON = 2.6
BLOCK = 16


def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(64).standard_normal((dims, dims)))[0]


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on the rows of a sample."""
    rng = np.random.default_rng(5)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def probes_needed(points: np.ndarray, centroids: np.ndarray, k: int, recall: float, trials: int = 256) -> int:
    """Lists to probe so that the sample's own neighbours are found with this recall.

    A sample's neighbours lie farther than those among all rows, which errs on the safe side.
    """
    rng = np.random.default_rng(9)
    home = np.argmax(points @ centroids.T, axis=1)
    places = []
    for q in rng.choice(len(points), min(trials, len(points)), replace=False):
        similar = points @ points[q]
        similar[q] = -np.inf
        near = np.argpartition(-similar, min(k, len(points) - 1))[:k]
        rank = np.empty(len(centroids), np.int64)
        rank[np.argsort(-(centroids @ points[q]))] = np.arange(len(centroids))
        places.append(rank[home[near]])
    return int(np.quantile(np.concatenate(places), recall, method="higher")) + 1


def scan_part(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray,
              k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best in one part of a list."""
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1))[:, None]
    turned_v, turned_q = unit(vectors) @ turn, unit(queries) @ turn
    v_norm, q_norm = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    dims = vectors.shape[1]
    cuts = list(range(0, dims, BLOCK)) + [dims]
    columns = [np.ascontiguousarray(turned_v[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    rows_q, rows_v, scores = [], [], []
    for j in range(len(queries)):
        live = np.flatnonzero(ids != q_ids[j])
        if not len(live):
            continue
        so_far = np.zeros(len(live))
        # A first threshold from a few candidates read whole; it only shrinks.
        first = live[:: max(1, len(live) // 64)]
        bound = _kth(((turned_v[first] - turned_q[j]) ** 2).sum(axis=1), k)
        for b, column in enumerate(columns):
            so_far = so_far + ((column[live] - turned_q[j, cuts[b]: cuts[b + 1]]) ** 2).sum(axis=1)
            seen = cuts[b + 1]
            if seen < dims:
                keep = so_far * (dims / seen) <= bound * (1 + epsilon / np.sqrt(seen)) ** 2
                live, so_far = live[keep], so_far[keep]
                if not len(live):
                    break
        if not len(live):
            continue
        near = live
        if len(live) > 4 * k:
            near = live[so_far <= _kth(so_far, k) + 1e-9]
        score = (vectors[near] * queries[j]).sum(axis=1) / (v_norm[near] * q_norm[j])
        best = np.lexsort((ids[near], -score))[:k]
        rows_q.append(np.full(len(best), j))
        rows_v.append(near[best])
        scores.append(score[best])
    if not rows_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows_q), np.concatenate(rows_v), np.concatenate(scores)


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, k - 1)[k - 1]) if len(values) >= k else np.inf


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if x.size else x


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _v) of the vectors that take part, as lists of doubles without nulls."""
    v = F.col("_v")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).filter(F.col("_id").isNotNull() & fine)


def search(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, recall: float = 0.98,
           sample_size: int = 20_000, max_lists: int = 4096, part_size: int = 4096) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest found of every row that the Column ``is_query`` of the key selects.

    ``sample_size`` bounds the vectors that come to the driver to fit centroids and to
    choose how many lists are probed for ``recall``; ``max_lists`` bounds what is sent to
    the tasks.  Every vector is indexed.  Each length of vectors is a search of its own.
    """
    rows = usable_vectors(df, key, vector)
    kind = rows.schema["_id"].dataType.simpleString()
    lengths = rows.groupBy(F.size("_v").alias("n")).count().orderBy("n").collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    found = [_search_length(rows.filter(F.size("_v") == r["n"]), r["count"], is_query, key, k, recall, sample_size, max_lists, part_size) for r in lengths]
    return reduce(DataFrame.unionByName, found)


def _search_length(rows: DataFrame, total: int, is_query, key: str, k: int, recall: float, sample_size: int, max_lists: int, part_size: int) -> DataFrame:
    """:func:`search` over ``total`` vectors of one length."""
    kind = rows.schema["_id"].dataType.simpleString()
    lists = int(min(max_lists, max(1, round(np.sqrt(total) / 2))))
    scale = 1 << 30
    share = int(scale * min(1.0, sample_size / total))
    sample = rows.filter(F.pmod(F.xxhash64("_id", "_v"), F.lit(scale)) <= share).orderBy("_id").select("_v").toPandas()
    points = scaled(np.array(sample["_v"].tolist() or [rows.select("_v").first()[0]], np.float64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = np.unique(points, axis=0)
    centroids = fit_centroids(points, lists)
    probes = probes_needed(points, centroids, k, recall)
    turn = rotation(points.shape[1])

    def nearest(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.argmax(x @ centroids.T, axis=1), pa.int32())], names=["_id", "_v", "list"])

    listed = cut_lineage(rows.mapInArrow(nearest, f"_id {kind}, _v array<double>, list int"), "ann-lists")
    # At most max_lists rows.
    counts = np.zeros(len(centroids), np.int64)
    for r in listed.groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    parts = np.maximum(1, -(-counts // part_size))

    def probe(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            order = np.argsort(-(x @ centroids.T), axis=1)
            held = np.cumsum(counts[order], axis=1)
            # The lists that are probed in any case, and more until k vectors beside the query are held.
            need = np.maximum(min(probes, len(centroids)), np.minimum((held < k + 1).sum(axis=1) + 1, len(centroids)))
            row = np.repeat(np.arange(len(x)), need)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(need) - need, need)
            lists_ = order[row, rank]
            again = np.repeat(np.arange(len(lists_)), parts[lists_])
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts[lists_]) - parts[lists_], parts[lists_])
            for a in range(0, len(again), 50_000):
                cut = slice(a, a + 50_000)
                take = pa.array(row[again[cut]])
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(take) for c in batch.columns], pa.array(lists_[again[cut]], pa.int32()), pa.array(part[cut], pa.int32())],
                    names=["_id", "_v", "_row", "list", "part"])

    asked = listed.filter(is_query(F.col("_id"))).select("_id", "_v").dropDuplicates(["_id", "_v"])
    queries = asked.withColumn("_row", F.xxhash64("_v")).mapInArrow(probe, f"_id {kind}, _v array<double>, _row bigint, list int, part int")
    split = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
    dealt = listed.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(3)), split).cast("int"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = left.slice(0, 0)
            return pa.table({"query_id": none.column("_id"), "_row": none.column("_row"), "_id": none.column("_id"), "score": pa.array([], pa.float64())})
        q_ids, ids = left.column("_id").to_numpy(), right.column("_id").to_numpy()
        row, found, score = scan_part(_matrix(left.column("_v")), q_ids, _matrix(right.column("_v")), ids, turn, k)
        return pa.table({"query_id": pa.array(q_ids[row]), "_row": left.column("_row").take(pa.array(row)), "_id": pa.array(ids[found]), "score": pa.array(score)})

    hits = queries.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(
        scan, f"query_id {kind}, _row bigint, _id {kind}, score double")
    best = Window.partitionBy("query_id", "_row").orderBy(F.col("score").desc(), "_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(key), "score")
