"""Incremental forms of the batch operators (STR-01 … STR-10)."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_PROFILE
from rolecast.functions import text
from rolecast.operators import state, windows
from rolecast.operators.shaping import cut_lineage, scratch_path
from rolecast.operators.versioned import PartTable
from rolecast.streaming.keyed import state_store


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a table, a bounded number per micro-batch.

    ``path`` is a folder of part files or a single file.  A file source wants a
    folder or a pattern, so the last letter is written as a pattern that
    matches itself only.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


# ---------------------------------------------------------------- declarative streams


def dedupe(stream: DataFrame, keys: list[str], ts: str, delay: str = f"{DEFAULT_PROFILE.stalled_until} days") -> DataFrame:
    """STR-01: the first delivery of each key within the watermark; exact keys only.

    Transitive merges are the periodic batch resolution's work.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, by: str, ts: str, delay: str = "2 days") -> DataFrame:
    """STR-03: counts per day and value; partial counts combine before the shuffle."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.count("*").alias("n"))


def rolling_counts(stream: DataFrame, ts: str, days: int = 7, delay: str = "2 days") -> DataFrame:
    """STR-04: counts over the last ``days`` days, for every day.

    Days are counted first and spread over the windows after that, so a row is
    shuffled once and not once per window it belongs to.
    """
    per_day = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("d")).agg(F.count("*").alias("n"))
    return per_day.select(F.col("d.start").alias("dia"), "n")


def spread_days(per_day: DataFrame, days: int = 7) -> DataFrame:
    """STR-04: daily counts to the sums of the windows that end on each later day."""
    ends = F.sequence(F.col("dia"), F.col("dia") + F.make_dt_interval(days=F.lit(days - 1)), F.expr("INTERVAL 1 DAY"))
    return per_day.select("n", F.explode(ends).alias("ate")).groupBy("ate").agg(F.sum("n").alias("n"))


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """STR-08: work events grouped into sessions."""
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))


# ------------------------------------------------- batch forms of the keyed streams, and the sink


def split_late(batch: DataFrame, ts: str, newest: Column, profile=DEFAULT_PROFILE) -> tuple[DataFrame, DataFrame]:
    """STR-02: (rows in time, rows older than the zombie window)."""
    limit = newest - F.make_dt_interval(days=F.lit(profile.stalled_until))
    late = F.coalesce(F.col(ts) < limit, F.lit(False))
    return batch.filter(~late), batch.filter(late)


def fold_quota(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR-06 in batch: (next state, rejected requests) of the one paid trigger per installation and local day.

    ``batch``: (instalacao, dia, tipo, reserva_id, run_id, em, seq) with tipo
    reservar or confirmar.  The first reservation of a day wins and uses it up;
    its confirmation names the run; repeats change nothing; another
    reservation or run is rejected.
    """
    key = ["instalacao", "dia"]
    order = F.struct("em", "seq")
    reserves = batch.filter("tipo = 'reservar'").groupBy(*key).agg(
        F.min_by(F.struct("reserva_id", "em"), order).alias("r"))
    held = stored.join(reserves, key, "full").select(
        *key, F.coalesce("reserva_id", "r.reserva_id").alias("reserva_id"),
        F.coalesce("reservado_em", "r.em").alias("reservado_em"), "run_id")
    confirms = batch.filter("tipo = 'confirmar'").join(held.withColumnRenamed("reserva_id", "_res").drop("run_id"), key)
    runs = confirms.filter("reserva_id = _res AND em >= reservado_em").groupBy(*key).agg(
        F.min_by("run_id", order).alias("_run"))
    nxt = held.join(runs, key, "left").select(
        *key, "reserva_id", "reservado_em", F.coalesce("run_id", "_run").alias("run_id"))
    judged = batch.join(nxt.select(*key, F.col("reserva_id").alias("_res"), F.col("run_id").alias("_run"),
                                   F.col("reservado_em").alias("_em")), key, "left")
    why = (
        F.when((F.col("tipo") == "reservar") & (F.col("reserva_id") != F.col("_res")), "COTA_USADA")
        .when((F.col("tipo") == "confirmar") & (
            F.col("_res").isNull() | (F.col("reserva_id") != F.col("_res")) | (F.col("em") < F.col("_em"))
            | (F.col("run_id") != F.col("_run"))), "RESERVA_DIVERGENTE"))
    refused = judged.withColumn("motivo", why).filter("motivo IS NOT NULL").select(*batch.columns, "motivo")
    return nxt, refused


def fold_fingerprints(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR-07 in batch: (next state, re-edited postings).

    ``batch``: (id_externo, descricao, em, seq); ``stored``: (id_externo, impressao).
    """
    printed = batch.withColumn("impressao", text.fingerprint(F.col("descricao"))).filter("impressao IS NOT NULL")
    chained = windows.with_previous(printed, "id_externo", ["em", "seq"], ["impressao"])
    known = stored.withColumnRenamed("impressao", "_antes")
    edits = chained.join(known, "id_externo", "left").withColumn("de", F.coalesce("ant_impressao", "_antes")).filter(
        "de IS NOT NULL AND de <> impressao").select("id_externo", "em", "seq", "de", F.col("impressao").alias("para"))
    last = printed.groupBy("id_externo").agg(F.max_by("impressao", F.struct("em", "seq")).alias("_n"))
    nxt = stored.join(last, "id_externo", "full").select("id_externo", F.coalesce("_n", "impressao").alias("impressao"))
    return nxt, edits


def fold_attempts(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR-10 in batch: (next state, rejected events) of the attempt ledger.

    ``batch``: (chave, tentativa_id, tipo, prova, em, seq) with tipo intencao,
    confirmar or reconciliar.  An intent blocks its key until it is confirmed;
    confirming needs proof; missing proof never clears an intent; a confirmed
    key never changes again.
    """
    order = F.struct("em", "seq")
    intents = batch.filter("tipo = 'intencao'").groupBy("chave").agg(
        F.min_by(F.struct("tentativa_id", "em"), order).alias("i"))
    held = stored.join(intents, "chave", "full").select(
        "chave", F.coalesce("tentativa_id", "i.tentativa_id").alias("tentativa_id"),
        F.coalesce("intencao_em", "i.em").alias("intencao_em"), "prova", F.col("estado").alias("_estado"))
    proofs = batch.filter("tipo IN ('confirmar', 'reconciliar') AND prova IS NOT NULL AND prova <> ''").join(
        held.select("chave", F.col("tentativa_id").alias("_t"), F.col("intencao_em").alias("_e")), "chave").filter(
        "tentativa_id = _t AND em >= _e").groupBy("chave").agg(F.min_by("prova", order).alias("_p"))
    nxt = held.join(proofs, "chave", "left").select(
        "chave", "tentativa_id", "intencao_em", F.coalesce("prova", "_p").alias("prova"),
        F.when(F.coalesce("prova", "_p").isNotNull(), "enviada").otherwise("envio_incerto").alias("estado"))
    judged = batch.join(nxt.select("chave", F.col("tentativa_id").alias("_t"), F.col("intencao_em").alias("_e")), "chave", "left")
    why = (
        F.when((F.col("tipo") == "intencao") & (F.col("tentativa_id") != F.col("_t")), "ENVIO_INCERTO_OU_CONFIRMADO")
        .when((F.col("tipo") != "intencao") & (
            F.col("_t").isNull() | (F.col("tentativa_id") != F.col("_t")) | (F.col("em") < F.col("_e"))), "TENTATIVA_AUSENTE")
        .when((F.col("tipo") != "intencao") & (F.coalesce("prova", F.lit("")) == ""), "RECONCILIACAO_INSUFICIENTE"))
    refused = judged.withColumn("motivo", why).filter("motivo IS NOT NULL").select(*batch.columns, "motivo")
    return nxt, refused


def upsert_sink(cache: PartTable, clock, late: str, ts: str = "publicada_em", sparse: tuple = (), profile=DEFAULT_PROFILE):
    """STR-09, STR-02: each batch merged into the cache, one row per id; late rows to a side table.

    Only the parts of the cache that hold the batch's ids are read and written, and a batch that is run again changes
    nothing.  ``clock`` gives the instant of a batch: an argument, so a replayed batch can be given the instant it had.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        now = clock(batch_id)
        # Combines map-side, so a posting delivered very often is one row before the shuffle.
        # The order is a struct, so a row without a date is kept too; equal dates fall back on the content.
        payload = [c for c in batch.columns if c != "id_externo"]
        latest = batch.groupBy("id_externo").agg(
            F.max_by(F.struct(*payload), F.struct(ts, F.xxhash64(*payload))).alias("r"))
        rows = cut_lineage(latest.select("id_externo", "r.*"), "batch")
        in_time, too_late = split_late(rows, ts, F.lit(now).cast("timestamp"), profile)
        write_batch(too_late, late, batch_id)
        cache.merge(in_time, lambda stored, new: state.upsert_cache(stored, new, now, sparse), batch=batch_id)
    return run


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one batch; running the batch again replaces them."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


# ----------------------------------------------------------------------------- running


def run_batches(stream: DataFrame, each, label: str, mode: str = "append", checkpoint: str | None = None) -> int:
    """Process what is available now, batch by batch, and stop; returns the rows read.

    With a ``checkpoint`` folder that is kept, a later start goes on after the
    last batch; without one, each start reads everything.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


class AppendRun:
    """A stream in append mode into a table: each start takes what is there, goes on after the last batch, and stops.

    With a watermark only final windows and sessions are written, and their state goes.  ``read`` gives the rows written
    so far, of finished batches only.
    """

    def __init__(self, stream: DataFrame, label: str, checkpoint: str | None = None, path: str | None = None, keyed: bool = False):
        spark = stream.sparkSession
        self.stream, self.keyed, self.spark = stream, keyed, spark
        self.checkpoint = checkpoint or scratch_path(spark, f"{label}-checkpoint")
        self.path = path or scratch_path(spark, label)
        #: Newest event time seen by this object's runs, and the most rows of state that a batch left.
        self.newest: str | None = None
        self.state_rows = 0

    def once(self) -> int:
        """Takes in what is available now; returns the rows read."""
        with state_store(self.spark) if self.keyed else nullcontext():
            query = (self.stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", self.checkpoint)
                     .option("path", self.path).trigger(availableNow=True).start())
        query.awaitTermination()
        progress = query.recentProgress
        times = [p["eventTime"]["max"] for p in progress if "max" in p["eventTime"]]
        self.newest = max([*times, *([self.newest] if self.newest else [])], default=None)
        self.state_rows = max([self.state_rows, *(o["numRowsTotal"] for p in progress for o in p["stateOperators"])])
        return sum(p["numInputRows"] for p in progress)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.stream.schema).parquet(self.path)


def with_closing(stream: DataFrame, path: str) -> DataFrame:
    """A stream joined by the rows of ``path``, a folder that is empty until ``close`` is called."""
    spark = stream.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def close(run: AppendRun, path: str, schema, ts: str, after: str) -> None:
    """Ends a finite input: a row ``after`` the newest event moves the watermark past all windows, and the run hands them over.

    The row itself stays in the state, in a window that never ends.
    """
    if run.newest is not None:
        at = F.to_timestamp(F.lit(run.newest)) + F.expr(f"INTERVAL {after}")
        row = [(at if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        run.spark.range(1).select(*row).write.mode("append").parquet(path)
        run.once()


def run_to_end(build, stream: DataFrame, ts: str, label: str, after: str) -> DataFrame:
    """All windows or sessions of a finite input, in append mode: the input, then a closing row ``after`` its newest event."""
    path = scratch_path(stream.sparkSession, f"{label}-closing")
    run = AppendRun(build(with_closing(stream, path)), label)
    run.once()
    close(run, path, stream.schema, ts, after)
    return run.read()
