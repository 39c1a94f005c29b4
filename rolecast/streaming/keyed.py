"""State by key in the state store: board moves, day quotas, fingerprints and attempts (STR-05, STR-06, STR-07, STR-10).

Each stream is a ``StatefulProcessor``: a key's state has a schema, lives in the state
store beside the query's checkpoint, and only the keys of a batch are read and written.
Nothing is rewritten per batch, a restarted query goes on from its checkpoint, and the
state itself can be read as a table (``state_of``).  What a processor returns is appended
through the file sink, which counts each batch once.

The rows of one key in one batch are put in order by (instant, seq) in memory; how many
rows a batch has is bounded by the files it takes (``file_stream``).  Keys without rows
cost nothing.  Instants are microseconds and days are day numbers inside the processors,
so no time zone of a worker matters.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolecast.config import BOARD_EXTRA, BOARD_STATUSES
from rolecast.functions import text

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.em is not None, r.em or 0, r.seq is not None, r.seq or 0))


class BoardMoves(StatefulProcessor):
    """STR-05.  Key: card.  State: its status and the move that set it.

    A row carries the status its card had before any move (``inicial``, null if there is no such card).  A move that is
    older than the one that set the status is history only, so the status does not depend on how the input is cut.
    """

    def __init__(self, known: frozenset[str]):
        self.known = known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.card = handle.getValueState("card", "status string, em bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = self.card.get() if self.card.exists() else None
        status, last = (held[0], (held[1], held[2])) if held else (None, None)
        for r in _in_order(rows):
            make = lambda tipo, de, motivo: Row(
                tipo=tipo, id=key[0], em=r.em, de=de, para=r.para, por=r.por, motivo=motivo)  # noqa: B023
            if r.para not in self.known:
                yield make("rejeitada", None, f"status desconhecido: {r.para or ''}")
                continue
            now = status if last else r.inicial
            if now is None:
                yield make("rejeitada", None, f"vaga nao esta no quadro: {key[0] or ''}")
                continue
            if last and (r.em or 0, r.seq or 0) < last:
                yield make("atrasada", None, None)
                continue
            if now != r.para:
                yield make("evento", now, None)
            status, last = r.para, (r.em or 0, r.seq or 0)
        if last and (not held or (status, *last) != tuple(held)):
            self.card.update((status, *last))

    def close(self) -> None:
        pass


MOVE_OUT = "tipo string, id string, em bigint, de string, para string, por string, motivo string"


def board_moves(moves: DataFrame, cards: DataFrame, statuses: tuple = (*BOARD_STATUSES, *BOARD_EXTRA)) -> DataFrame:
    """STR-05: (tipo, id, em, de, para, por, motivo); tipo is evento, atrasada or rejeitada.

    ``moves``: (id, para, por, em, seq).  ``cards``: (id, status), the board before the stream, joined to each batch's
    moves; only cards that move have state.
    """
    start = cards.select(F.col("id").alias("_id"), F.coalesce("status", F.lit("")).alias("inicial"))
    rows = moves.join(start, F.col("id") == F.col("_id"), "left").select(
        "id", "para", "por", F.unix_micros(F.col("em").cast("timestamp")).alias("em"), "seq", "inicial")
    out = rows.groupBy("id").transformWithState(BoardMoves(frozenset(statuses)), MOVE_OUT, "Append", "none")
    return out.withColumn("em", F.timestamp_micros("em"))


def current_board(cards: DataFrame, checkpoint: str) -> DataFrame:
    """``cards`` with the status that the stream has given them so far."""
    state = state_of(cards.sparkSession, checkpoint, "card")
    if state is None:
        return cards
    moved = state.select(F.col("key.id").alias("_id"), F.col("value.status").alias("_status"))
    return cards.join(moved, F.col("id") == F.col("_id"), "left").withColumn("status", F.coalesce("_status", "status")).drop("_id", "_status")


class DayQuota(StatefulProcessor):
    """STR-06.  Key: installation.  State: a map from day to (reservation, its instant, run).

    A timer at a day's end plus ``keep_days`` hands the day over as a final row and removes it.
    """

    def __init__(self, keep_days: int):
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("dias", "dia int", "reserva_id string, em bigint, run_id string")

    def _due(self, day: int) -> int:
        return (day + 1 + self.keep_days) * DAY_MS

    def handleInputRows(self, key, rows, timerValues):
        by_day: dict[int, list[Row]] = {}
        for r in _in_order(rows):
            by_day.setdefault(r.dia, []).append(r)
        for day, own in by_day.items():
            held = tuple(self.days.getValue((day,))) if self.days.containsKey((day,)) else None
            state = held
            first = next((r for r in own if r.tipo == "reservar"), None)
            if state is None and first is not None:
                state = (first.reserva_id, first.em, None)
            if state is not None and state[2] is None:
                # Its confirmation names the run.
                run = next((r.run_id for r in own if r.tipo == "confirmar" and r.reserva_id == state[0] and r.em >= state[1]), None)
                state = (state[0], state[1], run)
            for r in own:
                if r.tipo == "reservar" and r.reserva_id != state[0]:
                    yield self._row(key, r, "COTA_USADA")
                elif r.tipo == "confirmar" and (state is None or r.reserva_id != state[0] or r.em < state[1] or (
                        r.run_id is not None and state[2] is not None and r.run_id != state[2])):
                    yield self._row(key, r, "RESERVA_DIVERGENTE")
            if state is not None and state != held:
                self.days.updateValue((day,), state)
                if held is None:
                    self.handle.registerTimer(self._due(day))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for day_key, value in list(self.days.iterator()):
            if self._due(day_key[0]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.days.removeKey(day_key)
                yield Row(tipo="final", instalacao=key[0], dia=day_key[0], reserva_id=value[0], run_id=value[2], seq=None, motivo=None)

    def _row(self, key, r: Row, why: str) -> Row:
        return Row(tipo="rejeitada", instalacao=key[0], dia=r.dia, reserva_id=r.reserva_id, run_id=r.run_id, seq=r.seq, motivo=why)

    def close(self) -> None:
        pass


def day_quota(requests: DataFrame, keep_days: int = 2, delay: str = "1 day") -> DataFrame:
    """STR-06: (tipo, instalacao, dia, reserva_id, run_id, seq, motivo); tipo is rejeitada, or final when a day is over.

    ``requests``: (instalacao, dia, tipo, reserva_id, run_id, em, seq) with tipo reservar or confirmar.  The first
    reservation of a day uses it up; its confirmation names the run; repeats change nothing.  A request older than
    ``delay`` behind the newest one is late and does not count.
    """
    kind = requests.schema["instalacao"].dataType.simpleString()
    rows = requests.withColumn("_at", F.col("em").cast("timestamp")).withWatermark("_at", delay).select(
        "_at", "instalacao", F.unix_date("dia").alias("dia"), "tipo", "reserva_id", "run_id", F.unix_micros("_at").alias("em"), "seq")
    out = f"tipo string, instalacao {kind}, dia int, reserva_id string, run_id string, seq bigint, motivo string"
    found = rows.groupBy("instalacao").transformWithState(DayQuota(keep_days), out, "Append", "EventTime")
    return found.withColumn("dia", F.date_from_unix_date("dia"))


def quota_days(spark: SparkSession, checkpoint: str, finals: DataFrame) -> DataFrame:
    """(instalacao, dia, reserva_id, run_id): the days handed over and those still in the state."""
    done = finals.filter("tipo = 'final'").select("instalacao", "dia", "reserva_id", "run_id")
    state = state_of(spark, checkpoint, "dias")
    if state is None:
        return done
    return done.unionByName(state.select(
        F.col("key.instalacao").alias("instalacao"), F.date_from_unix_date("user_map_key.dia").alias("dia"),
        F.col("user_map_value.reserva_id").alias("reserva_id"), F.col("user_map_value.run_id").alias("run_id")))


class LastFingerprint(StatefulProcessor):
    """STR-07.  Key: posting.  State: its last fingerprint and when it was seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("impressao", "impressao string, em bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.last.get()) if self.last.exists() else None
        state = held
        for r in _in_order(rows):
            if state and (r.em or 0, r.seq or 0) < state[1:]:
                continue
            if state and state[0] != r.impressao:
                yield Row(id_externo=key[0], em=r.em, seq=r.seq, de=state[0], para=r.impressao)
            state = (r.impressao, r.em or 0, r.seq or 0)
        if state != held:
            self.last.update(state)

    def close(self) -> None:
        pass


def reedited(postings: DataFrame) -> DataFrame:
    """STR-07: (id_externo, em, seq, de, para) for each change of a posting's text.

    ``postings``: (id_externo, descricao, em, seq); one without text changes nothing.
    """
    rows = postings.select(
        "id_externo", text.fingerprint(F.col("descricao")).alias("impressao"), F.unix_micros(F.col("em").cast("timestamp")).alias("em"), "seq")
    out = rows.filter("impressao IS NOT NULL").groupBy("id_externo").transformWithState(
        LastFingerprint(), "id_externo string, em bigint, seq bigint, de string, para string", "Append", "none")
    return out.withColumn("em", F.timestamp_micros("em"))


class Attempts(StatefulProcessor):
    """STR-10.  Key: what is attempted.  State: the intent that holds it, and its proof; a proven key never changes again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("tentativa", "tentativa_id string, em bigint, prova string")

    def handleInputRows(self, key, rows, timerValues):
        own = _in_order(rows)
        held = tuple(self.held.get()) if self.held.exists() else None
        state = held
        first = next((r for r in own if r.tipo == "intencao"), None)
        if state is None and first is not None:
            state = (first.tentativa_id, first.em, None)
        if state is not None and state[2] is None:
            proof = next((r.prova for r in own if r.tipo != "intencao" and r.prova and r.tentativa_id == state[0] and r.em >= state[1]), None)
            state = (state[0], state[1], proof)
        for r in own:
            why = None
            if r.tipo == "intencao":
                why = "ENVIO_INCERTO_OU_CONFIRMADO" if r.tentativa_id != state[0] else None
            elif state is None or r.tentativa_id != state[0] or r.em < state[1]:
                why = "TENTATIVA_AUSENTE"
            elif not r.prova:
                why = "RECONCILIACAO_INSUFICIENTE"
            if why:
                yield Row(chave=key[0], tentativa_id=r.tentativa_id, tipo=r.tipo, prova=r.prova, em=r.em, seq=r.seq, motivo=why)
        if state is not None and state != held:
            self.held.update(state)

    def close(self) -> None:
        pass


def attempts(events: DataFrame) -> DataFrame:
    """STR-10: the refused events with their reason.

    ``events``: (chave, tentativa_id, tipo, prova, em, seq) with tipo intencao, confirmar or reconciliar.  An intent
    blocks its key until it is confirmed; confirming needs proof; missing proof never clears an intent.
    """
    rows = events.select("chave", "tentativa_id", "tipo", "prova", F.unix_micros(F.col("em").cast("timestamp")).alias("em"), "seq")
    out = rows.groupBy("chave").transformWithState(
        Attempts(), "chave string, tentativa_id string, tipo string, prova string, em bigint, seq bigint, motivo string", "Append", "none")
    return out.withColumn("em", F.timestamp_micros("em"))


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """(chave, tentativa_id, intencao_em, prova, estado), None before the first batch."""
    state = state_of(spark, checkpoint, "tentativa")
    if state is None:
        return None
    proof: Column = F.col("value.prova")
    return state.select(
        F.col("key.chave").alias("chave"), F.col("value.tentativa_id").alias("tentativa_id"), F.timestamp_micros("value.em").alias("intencao_em"),
        proof.alias("prova"), F.when(proof.isNotNull(), "enviada").otherwise("envio_incerto").alias("estado"))


# ---------------------------------------------------------------------------- running


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame | None:
    """The state after the last finished batch, as a table; None if no batch has finished."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not len(files.listStatus(folder)):
        return None
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


class state_store:
    """While a query starts, the session names the state store that keyed state needs; afterwards it has its own again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)
