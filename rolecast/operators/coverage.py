"""Text coverage of postings by résumés and themes (AG-16, AG-17, JN-12, JN-13, FLT-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS
from rolecast.functions import text
from rolecast.functions.text import let
from rolecast.operators.shaping import cut_lineage


def plain_words(t: Column) -> Column:
    """Lower case, accents off, everything but a-z, 0-9 turned into single blanks."""
    return F.trim(F.regexp_replace(F.lower(text.strip_accents(F.coalesce(t, F.lit("")))), "[^a-z0-9]+", " "))


def bigrams(words: Column, stop_words=()) -> Column:
    """Adjacent pairs of the original text; a stop or short word breaks a pair.

    ``words`` went through :func:`plain_words`.  Stop words are marked in one
    pass, then a look-ahead collects the overlapping pairs in another.
    """
    stops = "|".join(["[a-z0-9]{1,2}", *stop_words])
    marked = F.regexp_replace(words, rf"(?<![a-z0-9])(?:{stops})(?![a-z0-9])", ".")
    return F.regexp_extract_all(
        marked, F.lit("(?<![a-z0-9])(?=([a-z0-9]{3,} [a-z0-9]{3,})(?![a-z0-9]))"), F.lit(1))


def tally(items: Column) -> Column:
    """array<struct<term, n>> of an array of strings, counted inside the row.

    Equal items are neighbours once sorted, so a run's length is the distance
    to the next start: linear after the sort, and no shuffle.
    """
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (
            F.try_element_at(s, i) != F.try_element_at(s, F.greatest(i - 1, F.lit(1)))))
        return let(starts, lambda st: F.transform(st, lambda p, k: F.struct(
            F.try_element_at(s, p).alias("term"),
            (F.coalesce(F.get(st, k + 1), F.size(s) + 1) - p).alias("n"))))

    return F.when(F.size(items) > 0, let(F.array_sort(items), runs))


def repeated_bigrams(df: DataFrame, key: str, body: str, stop_words=(), minimum: int = 2, cap: int | None = None) -> DataFrame:
    """AG-16: (key, term, n) of the pairs a text repeats; with ``cap`` only the most frequent (30 in the published check)."""
    counted = df.select(key, F.inline(F.filter(
        tally(bigrams(plain_words(F.col(body)), stop_words)), lambda x: x["n"] >= minimum)))
    if cap is None:
        return counted
    w = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return counted.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def emphasis(df: DataFrame, key: str = "id_externo", kw=DEFAULT_KEYWORDS) -> DataFrame:
    """JN-12, TOP-05: (key, balde, acertos, n) of the themes a posting touches.

    The themes are a fixed list, so they are matched in place: one scan of the
    text finds the triggers of all themes, and no join is needed.
    """
    triggers = [t for terms in kw.emphasis_buckets.values() for t in terms]
    body = text.normalize_text(F.concat_ws(" ", "titulo", "descricao"))

    def by_theme(found: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(name).alias("balde"), F.array_intersect(
                F.array(*[F.lit(text.fold(t)) for t in terms]), found).alias("acertos"))
            for name, terms in kw.emphasis_buckets.items()])

    themes = let(text.triggers_found(body, triggers), by_theme)
    hit = F.filter(themes, lambda t: F.size(t["acertos"]) > 0)
    return df.select(key, F.inline(hit)).withColumn("n", F.size("acertos"))


def forbidden(bullet: Column, patterns) -> Column:
    """FLT-25: does any of the person's own "never mention" patterns match?"""
    return F.coalesce(bullet.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def emphasised_bullets(themes: DataFrame, resumes: DataFrame, never: tuple = ()) -> DataFrame:
    """JN-13: the résumé bullets marked with a theme the posting touches.

    ``resumes``: (empresa, bullets array<string>, temas array<array<string>>).
    """
    bullets = resumes.select(
        "empresa", F.inline(F.arrays_zip(F.col("bullets").alias("texto"), F.col("temas").alias("temas")))).filter(
        ~forbidden(F.col("texto"), never))
    tagged = bullets.select("empresa", "texto", F.explode(F.array_distinct("temas")).alias("balde"))
    return themes.join(tagged, "balde")


def coverage(postings: DataFrame, resumes: DataFrame, synonyms=(), stop_words=(), declared=(), cap: int | None = None) -> DataFrame:
    """AG-17: (id, termo, situacao, via) — coberto, sinonimo or ausente.

    ``postings``: (id, texto, resume_id); ``resumes``: (resume_id, texto).
    What is checked of a posting: the first term it uses of each synonym
    group, the skills the résumé declares, and its repeated pairs; ``cap`` keeps
    only so many of a posting's pairs, the most frequent first, and never cuts
    vocabulary terms.  Terms meet the résumé by equality, never text by text.
    """
    groups = [list(dict.fromkeys(text.fold(t) for t in g)) for g in synonyms]
    vocabulary = [t for g in groups for t in g]
    skills = [text.fold(s) for s in declared if len(text.fold(s)) > 2]
    words = postings.select("id", "resume_id", plain_words(F.col("texto")).alias("w"))
    targets = []
    if vocabulary or skills:
        found = text.terms_found(F.col("w"), vocabulary + skills, plural=False)

        def chosen(f: Column) -> Column:
            firsts = [F.get(F.array_intersect(F.array(*[F.lit(t) for t in g]), f), F.lit(0)) for g in groups]
            listed = F.array_intersect(F.array(*[F.lit(s) for s in skills]), f) if skills else F.array().cast(
                "array<string>")
            return F.concat(F.array_compact(F.array(*firsts)) if firsts else F.array().cast("array<string>"), listed)

        targets.append(words.select(
            "id", "resume_id", F.explode(F.array_distinct(let(found, chosen))).alias("termo")))
    pairs = repeated_bigrams(postings, "id", "texto", stop_words, cap=cap)
    targets.append(pairs.join(postings.select("id", "resume_id"), "id").select(
        "id", "resume_id", F.col("term").alias("termo")))
    wanted = targets[0] if len(targets) == 1 else targets[0].unionByName(targets[1])
    # Written once: both ways to the résumé start from it, and the texts are not read again for the second.
    wanted = cut_lineage(wanted.distinct(), "coverage-terms")

    # What each résumé says: vocabulary terms, and all of its adjacent pairs.
    said = resumes.select("resume_id", plain_words(F.col("texto")).alias("w"))
    all_pairs = F.regexp_extract_all(F.col("w"), F.lit("(?<![a-z0-9])(?=([a-z0-9]+ [a-z0-9]+)(?![a-z0-9]))"), F.lit(1))
    terms = F.concat(text.terms_found(F.col("w"), vocabulary + skills, plural=False), all_pairs) if (
        vocabulary or skills) else all_pairs
    says = said.select("resume_id", F.explode(terms).alias("termo")).distinct()

    spark = postings.sparkSession
    links = [(a, b, i) for g in groups for a in g for i, b in enumerate(g) if a != b]
    direct = wanted.join(says.withColumn("_coberto", F.lit(True)), ["resume_id", "termo"], "left")
    if links:
        equivalents = spark.createDataFrame(links, "termo string, equivalente string, ord int")
        via = (
            wanted.join(equivalents, "termo")
            .join(says.withColumnRenamed("termo", "equivalente"), ["resume_id", "equivalente"])
            .groupBy("id", "termo").agg(F.min_by("equivalente", "ord").alias("via")))
        direct = direct.join(via, ["id", "termo"], "left")
    else:
        direct = direct.withColumn("via", F.lit(None).cast("string"))
    covered = F.coalesce("_coberto", F.lit(False))
    return direct.select(
        "id", "resume_id", "termo",
        F.when(covered, "coberto").when(F.col("via").isNotNull(), "sinonimo").otherwise("ausente").alias("situacao"),
        F.when(~covered, F.col("via")).alias("via"))
