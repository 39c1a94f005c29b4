"""Mixing sources to target weights, without sorting (native DataFrame operations only).

Each document gets a hash.  Tokens are summed by source and hash bucket; the
running sum over the buckets of a source shows in which bucket its budget ends.
Only that bucket is cut into finer buckets, twice more, so that three histogram
passes over narrow rows place the threshold to 36 bits.  A document is then
taken by comparing its hash with its source's threshold: nothing is sorted, and
a larger budget always takes a superset of a smaller one.

Edge cases: a null text has size 0 and takes nothing; a null source is a source
of its own, last in order; an empty table gives an empty result; repeated rows
are documents of their own; documents that share the last boundary bucket (equal
ids, or a single long document) are taken in the same proportion, so that one
document or one group of copies cannot overshoot the budget.  Columns of the
input other than the three that are named are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.operators.shaping import cut_lineage

#: Hex digits of the hash that each of the nested histograms resolves.
DIGITS = 3
LEVELS = 3


def token_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_digits(key: Column) -> Column:
    """The first 36 bits of the md5 of a key as a number."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS * LEVELS)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size), one row per source.

    Sources in code-point order, null last, weigh ``weights``, repeated, and
    share the total.  A target stops at ``max_repeats`` times its source's
    size.  The excess goes to the others by weight, which is the same as one
    common level L with target = min(weight * L, cap): with the sources in order
    of cap / weight, L is fixed by the first one that L does not reach.  The
    windows run over one row per source, not over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_src").asc_nulls_last())) - 1
    table = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(table, (rank % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_src").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_rest_w", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(below), F.lit(0)))
        .withColumn("_rest", F.col("_total") - F.coalesce(F.sum("_cap").over(below), F.lit(0)))
        .withColumn("_level", F.col("_rest").cast("double") / F.col("_rest_w").cast("double"))
        .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_level", F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    cap = F.col("_cap").cast("double")
    return levels.select("_src", "source_size", F.least(F.coalesce(F.col("_level") * F.col("_w"), cap), cap).alias("target"))


def thresholds(narrow: DataFrame, targets: DataFrame, max_repeats: int = 3) -> DataFrame:
    """One row per source: whole passes, and where on the hash scale the last, partial pass ends.

    ``_cut`` is the boundary bucket, ``_rest`` the tokens left for it and
    ``_bucket`` the tokens in it.
    """
    bits = 4 * DIGITS
    t = F.col("target")
    size = F.col("source_size")
    whole = F.least(F.floor(t / F.greatest(size, F.lit(1))), F.lit(max_repeats)).cast("long")
    state = targets.withColumn("_whole", whole).withColumn("_rest", F.floor(t - F.col("_whole") * size).cast("long"))
    state = state.withColumn("_cut", F.lit(0).cast("long")).withColumn("_bucket", size)
    for level in range(1, LEVELS + 1):
        shift = bits * (LEVELS - level)
        inside = narrow.select("_src", "size", F.shiftright("_h", shift).alias("_b"))
        if level > 1:
            near = state.select(F.col("_src").alias("_s"), F.col("_cut").alias("_c"))
            inside = inside.join(
                near, F.col("_src").eqNullSafe(F.col("_s")) & (F.shiftright("_b", bits) == F.col("_c"))).drop("_s", "_c")
        hist = inside.groupBy("_src", "_b").agg(F.sum("size").alias("_n"))
        # At most 2**12 rows per source, whatever the number of documents.
        run = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).select(
            F.col("_src").alias("_s"), "_b", "_n", "_before")
        state = state.join(
            hist, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_before") <= F.col("_rest"))
            & (F.col("_rest") < F.col("_before") + F.col("_n")), "left")
        state = state.select(
            "_src", "source_size", "target", "_whole",
            F.when(F.col("_b").isNull(), F.col("_rest")).otherwise(F.col("_rest") - F.col("_before")).alias("_rest"),
            F.coalesce("_b", F.lit(-1)).alias("_cut"), F.coalesce("_n", F.lit(0)).alias("_bucket"))
        state = cut_lineage(state, "mix-state")
    return state


def taken() -> Column:
    """Words the mix takes from a document (_h, size), given its source's threshold."""
    part = F.when(F.col("_h") < F.col("_cut"), F.col("size")).when(F.col("_h") > F.col("_cut"), F.lit(0)).otherwise(
        F.floor(F.col("size") * F.col("_rest") / F.greatest(F.col("_bucket"), F.lit(1))))
    return (F.col("_whole") * F.col("size") + part).cast("long")


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
             weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> tuple[DataFrame, DataFrame]:
    """(narrow table of all documents with key, _src, _h and size; thresholds of the sources)."""
    narrow = cut_lineage(docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_src"), hash_digits(F.col(key)).alias("_h"),
        token_count(F.col(text)).alias("size")), "mix-sizes")
    sizes = narrow.groupBy("_src").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, max_repeats), "mix-targets")
    return narrow, thresholds(narrow, targets, max_repeats)


def mix_sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
              weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(key, size, source_size, target, taken), one row per document."""
    narrow, state = plan_mix(docs, text, source, key, weights, max_repeats)
    state = state.withColumnRenamed("_src", "_s")
    joined = narrow.join(state, F.col("_src").eqNullSafe(F.col("_s")))
    return joined.select(F.col("_key").alias(key), "size", "source_size", "target", taken().alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The documents of which the mix takes words, with ``taken``; all other columns as they are."""
    _, state = plan_mix(docs, text, source, key, weights, max_repeats)
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(source).alias("_src"),
        hash_digits(F.col(key)).alias("_h"), token_count(F.col(text)).alias("size"))
    kept = sized.join(state.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s"))).withColumn(
        "_taken", taken()).filter("_taken > 0")
    return kept.select(*[F.col(f"_doc.`{c}`") for c in docs.columns if c != "taken"], F.col("_taken").alias("taken"))
