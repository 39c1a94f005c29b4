"""Streaming queries over the event log as a file stream, each with a batch twin as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecast.functions import dates
from rolecast.operators import state
from rolecast.operators.shaping import cut_lineage, scratch_path
from rolecast.plans import inputs
from rolecast.streaming import jobs, keyed


def _events(spark, sf):
    inputs.prepare(spark)
    schema = inputs.table(spark, sf, "events").schema
    stream = jobs.file_stream(spark, f"{sf.rstrip('/')}/events.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_daily_counts(spark, sf):
    out = jobs.run_to_end(lambda s: jobs.daily_counts(s, "event_type", "ts"), _events(spark, sf), "ts", "daily", "4 days")
    return out.select(F.to_date("w.start").cast("string").alias("dia"), "event_type", "n")


def stream_rolling_counts(spark, sf):
    out = jobs.run_to_end(lambda s: jobs.rolling_counts(s, "ts"), _events(spark, sf), "ts", "rolling", "4 days")
    return jobs.spread_days(out).select(F.to_date("ate").cast("string").alias("ate"), "n")


def stream_dedupe(spark, sf):
    run = jobs.AppendRun(jobs.dedupe(_events(spark, sf), ["user_id", "event_type"], "ts"), "dedupe")
    run.once()
    return run.read().select("user_id", "event_type")


def stream_sessions(spark, sf):
    out = jobs.run_to_end(lambda s: jobs.sessions(s, "user_id", "ts", "3 hours"), _events(spark, sf), "ts", "sessions", "2 days")
    return out.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "n")


def _moves(spark, sf):
    mapping = F.create_map(*[F.lit(x) for kv in inputs.STATUS_OF_EVENT.items() for x in kv])
    return _events(spark, sf).select(
        F.col("user_id").cast("string").alias("id"), mapping[F.col("event_type")].alias("para"),
        F.lit("pessoa").alias("por"), F.col("ts").alias("em"), F.col("event_id").alias("seq"))


def _cards(spark, sf):
    """Every order is a card; users beyond the orders have none and are rejected."""
    return inputs.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("Avaliar").alias("status"))


def stream_status_fold(spark, sf):
    cards = _cards(spark, sf)
    run = jobs.AppendRun(keyed.board_moves(_moves(spark, sf), cards), "fold", keyed=True)
    run.once()
    return keyed.current_board(cards, run.checkpoint).groupBy("status").agg(F.count("*").alias("n"))


def stream_status_history(spark, sf):
    """STR-05: the moves that became events, and those that were refused, by kind."""
    run = jobs.AppendRun(keyed.board_moves(_moves(spark, sf), _cards(spark, sf)), "history", keyed=True)
    run.once()
    return run.read().groupBy("tipo", "de", "para").agg(F.count("*").alias("n"))


def stream_day_quota(spark, sf):
    events = _events(spark, sf)
    day = dates.local_day(F.col("ts"), "America/Sao_Paulo")
    requests = events.filter(F.col("event_type").isin("signup", "purchase")).select(
        F.col("user_id").alias("instalacao"), day.alias("dia"),
        F.when(F.col("event_type") == "signup", "reservar").otherwise("confirmar").alias("tipo"),
        F.concat_ws("/", "user_id", day.cast("string")).alias("reserva_id"),
        F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("run_id"),
        F.col("ts").alias("em"), F.col("event_id").alias("seq"))
    run = jobs.AppendRun(keyed.day_quota(requests), "quota", keyed=True)
    run.once()
    return keyed.quota_days(spark, run.checkpoint, run.read()).select("instalacao", F.col("dia").cast("string").alias("dia"), "run_id")


def stream_fingerprints(spark, sf):
    rows = _events(spark, sf).select(
        F.col("user_id").cast("string").alias("id_externo"), F.col("event_type").alias("descricao"),
        F.col("ts").alias("em"), F.col("event_id").alias("seq"))
    run = jobs.AppendRun(keyed.reedited(rows), "prints", keyed=True)
    run.once()
    return run.read().groupBy("id_externo").agg(F.count("*").alias("n"))


def stream_attempt_ledger(spark, sf):
    events = _events(spark, sf)
    rows = events.filter(F.col("event_type").isin("click", "purchase", "error")).select(
        F.col("user_id").cast("string").alias("chave"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tentativa_id"),
        F.when(F.col("event_type") == "click", "intencao").when(F.col("event_type") == "purchase", "confirmar")
        .otherwise("reconciliar").alias("tipo"),
        F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("prova"),
        F.col("ts").alias("em"), F.col("event_id").alias("seq"))
    run = jobs.AppendRun(keyed.attempts(rows), "ledger", keyed=True)
    run.once()
    return keyed.ledger(spark, run.checkpoint).select("chave", "prova", "estado")


def stream_upsert(spark, sf):
    """STR-09, STR-02: postings of a stream in a cache of parts, the late ones beside it."""
    orders = inputs.table(spark, sf, "orders")
    stream = jobs.file_stream(spark, f"{sf.rstrip('/')}/orders.parquet", orders.schema)
    customer, nation = inputs.table(spark, sf, "customer"), inputs.table(spark, sf, "nation")
    inputs.prepare(spark)
    rows = spark.sql(inputs.POSTINGS_SQL, orders=stream, customer=customer, nation=nation).withColumn("publicada_em", F.col("publicada_em").cast("timestamp"))
    schema = spark.createDataFrame([], rows.schema).withColumn("encontrada_em", F.lit(None).cast("timestamp")).schema
    cache = state.cache_table(spark, scratch_path(spark, "cache"), schema, parts=8)
    late = scratch_path(spark, "late")
    jobs.run_batches(rows, jobs.upsert_sink(cache, lambda i: "1998-01-01 00:00:00", late), "upsert")
    side = spark.read.schema(rows.schema).parquet(late).select("fonte", F.lit(True).alias("atrasada"))
    return cache.read().select("fonte", F.lit(False).alias("atrasada")).unionByName(side).groupBy("fonte", "atrasada").agg(F.count("*").alias("n"))


def cache_rounds(spark, sf):
    """SNK-01: two rounds and an expunge on a cache of parts."""
    postings = inputs.postings(spark, sf).withColumn("publicada_em", F.col("publicada_em").cast("timestamp"))
    schema = spark.createDataFrame([], postings.schema).withColumn("encontrada_em", F.lit(None).cast("timestamp")).schema
    cache = state.cache_table(spark, scratch_path(spark, "cache"), schema, parts=8)
    state.save_cache(cache, cut_lineage(postings.filter("seq % 2 = 0")), "2001-08-01 00:00:00")
    edited = postings.filter("seq % 3 = 0").withColumn("descricao", F.concat("descricao", F.lit(" (nova)")))
    state.save_cache(cache, cut_lineage(edited), inputs.NOW)
    state.expunge_cache(cache, inputs.NOW)
    return cache.read().groupBy("fonte", F.date_format("encontrada_em", "yyyy-MM-dd").alias("encontrada"), F.col("descricao").endswith("(nova)").alias("editada")).agg(
        F.count("*").alias("n"))


def snapshot_replace(spark, sf):
    """SNK-09: a newer snapshot replaces the stored one, an older one does not."""
    cards = inputs.board(spark, sf).select("id", "status")
    table = state.snapshot_table(spark, scratch_path(spark, "snapshot"), cards.schema, ["id"])
    done = [state.replace_snapshot(table, rows, at) for rows, at in (
        (cards, "2001-08-01 10:00:00"), (cards.filter("id LIKE 'manual:%'"), "2001-08-02 10:00:00"), (cards, "2001-08-01 12:00:00"))]
    return table.read().groupBy("status").agg(F.count("*").alias("n")).withColumns(
        {"aceitos": F.lit(sum(done)).cast("long"), "consultado_em": F.lit(table.facts()["consultado_em"])})


QUERIES = {f.__name__: f for f in (
    stream_daily_counts, stream_rolling_counts, stream_dedupe, stream_sessions, stream_status_fold, stream_status_history, stream_day_quota,
    stream_fingerprints, stream_attempt_ledger, stream_upsert, cache_rounds, snapshot_replace)}
