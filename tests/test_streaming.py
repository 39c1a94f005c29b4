"""Streams over several files: the result does not depend on how the input is cut."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolecast.operators import state
from rolecast.operators.shaping import scratch_path
from rolecast.plans import stream_queries
from rolecast.streaming import jobs, keyed

T0 = dt.datetime(2026, 9, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def folder(spark, tmp_path, rows, schema, files):
    path = f"{tmp_path}/in{files}"
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    return jobs.file_stream(spark, path, df.schema, files_per_batch=1)


@pytest.mark.parametrize("files", [1, 3])
def test_dedupe_and_counts(spark, tmp_path, files):
    rows = [("a", at(0)), ("b", at(1)), ("a", at(2)), ("a", at(30)), ("c", at(31)), ("b", at(50))]
    stream = lambda: folder(spark, f"{tmp_path}/{dt.datetime.now().timestamp()}", rows, "k string, ts timestamp", files)
    run = jobs.AppendRun(jobs.dedupe(stream(), ["k"], "ts"), "d")
    assert run.once() == 6 and run.once() == 0
    assert sorted(r.k for r in run.read().collect()) == ["a", "b", "c"]
    counts = jobs.run_to_end(lambda s: jobs.daily_counts(s, "k", "ts", "30 days"), stream(), "ts", "c", "40 days")
    assert {(r.w.start.day, r.k): r.n for r in counts.collect()} == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1, (2, "c"): 1, (3, "b"): 1}


@pytest.mark.parametrize("build", [
    lambda s: jobs.daily_counts(s, "k", "ts", "1 day"), lambda s: jobs.rolling_counts(s, "ts", delay="1 day"), lambda s: jobs.sessions(s, "k", "ts")])
def test_state_stays_bounded_while_the_watermark_moves(spark, tmp_path, build):
    """Twelve days of events, a file a day: what is final leaves the state, and all is written in the end."""
    rows = [(k, at(24 * day + hour)) for day in range(12) for k in "abc" for hour in (1, 2, 9)]
    stream = folder(spark, tmp_path, rows, "k string, ts timestamp", 12)
    path = scratch_path(spark, "closing")
    run = jobs.AppendRun(build(jobs.with_closing(stream, path)), "w")
    assert run.once() == len(rows)
    before = run.read().count()
    jobs.close(run, path, stream.schema, "ts", "9 days")
    static = spark.createDataFrame(rows, "k string, ts timestamp")
    twin = build(static)
    assert 0 < run.state_rows < twin.count() / 2 and 0 < before < run.read().count() == twin.count()
    assert sorted(map(str, run.read().collect())) == sorted(map(str, twin.collect()))


@pytest.mark.parametrize("name", sorted(n for n in stream_queries.QUERIES if n.startswith("stream_")))
def test_a_table_of_one_file_and_of_many_parts_streams_alike(spark, tmp_path, name):
    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    for other in ("orders", "customer", "nation"):
        spark.read.parquet(f"{source}/{other}.parquet").write.parquet(f"{tmp_path}/{other}.parquet")
    want = sorted(map(str, stream_queries.QUERIES[name](spark, source).collect()))
    assert want and sorted(map(str, stream_queries.QUERIES[name](spark, str(tmp_path)).collect())) == want


QUOTA = "instalacao string, dia date, tipo string, reserva_id string, run_id string, em timestamp, seq bigint"


def test_quota_goes_on_after_a_restart_and_hands_over_days(spark, tmp_path):
    day, later = T0.date(), (T0 + dt.timedelta(days=9)).date()
    steps = [
        [("i", day, "reservar", "r1", None, at(1), 1), ("i", day, "reservar", "r2", None, at(2), 2)],
        [("i", day, "confirmar", "r1", "run1", at(3), 3), ("i", day, "confirmar", "r1", "run1", at(4), 4), ("i", day, "confirmar", "r1", "run2", at(5), 5),
         ("i", day, "confirmar", "r9", "run1", at(6), 6), ("j", day, "confirmar", "r1", "run1", at(7), 7)],
        [("j", day, "reservar", "r3", None, at(8), 8), ("i", day, "reservar", "r1", None, at(9), 9)],
        [("i", later, "reservar", "r4", None, at(9 * 24 + 1), 10)]]
    batch = spark.createDataFrame([r for rows in steps for r in rows], QUOTA)
    empty = spark.createDataFrame([], "instalacao string, dia date, reserva_id string, reservado_em timestamp, run_id string")
    held = None
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, QUOTA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # A new query each time, as after a restart.
        stream = jobs.file_stream(spark, f"{tmp_path}/in", batch.schema, files_per_batch=1)
        run = jobs.AppendRun(keyed.day_quota(stream), "q", f"{tmp_path}/ck", f"{tmp_path}/out", keyed=True)
        assert run.once() == len(rows)
        held = {(r.key.instalacao, r.user_map_key.dia): r.user_map_value.run_id for r in keyed.state_of(spark, f"{tmp_path}/ck", "dias").collect()}
        assert held if n < 3 else True
    # The watermark has passed the first day and its two days more: its timer has handed it over.
    assert list(held.values()) == [None] and len(held) == 1
    finals = run.read()
    got = {(r.instalacao, r.dia, r.reserva_id, r.run_id) for r in keyed.quota_days(spark, f"{tmp_path}/ck", finals).collect()}
    nxt, refused = jobs.fold_quota(empty, batch)
    assert got == {(r.instalacao, r.dia, r.reserva_id, r.run_id) for r in nxt.collect()} and len(got) == 3
    assert {(r.instalacao, r.dia) for r in finals.filter("tipo = 'final'").collect()} == {("i", day), ("j", day)}
    assert sorted((r.seq, r.motivo) for r in finals.filter("tipo = 'rejeitada'").collect()) == [
        (2, "COTA_USADA"), (5, "RESERVA_DIVERGENTE"), (6, "RESERVA_DIVERGENTE"), (7, "RESERVA_DIVERGENTE")]


MOVES = [("a", "Aplicar", "p", at(1), 1), ("a", "Entrevista", "p", at(2), 2), ("b", "Sumiu", "p", at(3), 3), ("a", "Entrevista", "p", at(4), 4),
         ("z", "Aplicar", "p", at(5), 5), ("b", "Cancelada", "p", at(6), 6), (None, "Aplicar", "p", at(7), 7), ("b", None, "p", at(8), 8)]
MOVE_KIND = "id string, para string, por string, em timestamp, seq bigint"


@pytest.mark.parametrize("files", [1, 2, 8])
def test_board_moves(spark, tmp_path, files):
    stream = folder(spark, tmp_path, MOVES, MOVE_KIND, files)
    cards = spark.createDataFrame([("a", "Avaliar"), ("b", "Avaliar"), ("c", "Avaliar")], "id string, status string")
    run = jobs.AppendRun(keyed.board_moves(stream, cards), "fold", keyed=True)
    assert keyed.current_board(cards, run.checkpoint) is cards
    run.once()
    nxt, events, rejected = state.apply_moves(cards, spark.createDataFrame(MOVES, MOVE_KIND))
    assert {tuple(r) for r in keyed.current_board(cards, run.checkpoint).collect()} == {tuple(r) for r in nxt.collect()}
    out = run.read()
    assert {(r.id, r.em, r.de, r.para) for r in out.filter("tipo = 'evento'").collect()} == {(r.id, r.em, r.de, r.para) for r in events.collect()}
    assert {(r.id, r.em, r.motivo) for r in out.filter("tipo = 'rejeitada'").collect()} == {(r.id, r.em, r.motivo) for r in rejected.collect()}
    # Only cards that moved have state.
    assert keyed.state_of(spark, run.checkpoint, "card").count() == 2


def test_late_moves_change_no_status(spark, tmp_path):
    moves = [("a", "Entrevista", "p", at(5), 5), ("a", "Aplicar", "p", at(1), 1)]
    cards = spark.createDataFrame([("a", "Avaliar")], "id string, status string")
    for files in (1, 2):
        run = jobs.AppendRun(keyed.board_moves(folder(spark, tmp_path, moves, MOVE_KIND, files), cards), "late", keyed=True)
        run.once()
        assert keyed.current_board(cards, run.checkpoint).first().status == "Entrevista"
        assert run.read().filter("tipo = 'atrasada'").count() == (files == 2)


def test_keyed_attempts_equal_the_batch_fold(spark, tmp_path):
    kind = "chave string, tentativa_id string, tipo string, prova string, em timestamp, seq bigint"
    rows = [("a", "t1", "intencao", None, at(1), 1), ("b", "t3", "intencao", None, at(1), 2), ("a", "t2", "intencao", None, at(2), 3),
            ("b", "t3", "confirmar", "mail", at(2), 4), ("c", "t4", "confirmar", "x", at(2), 5), ("a", "t1", "reconciliar", None, at(3), 6),
            ("b", "t3", "confirmar", "other", at(4), 7), ("b", "t9", "intencao", None, at(5), 8)]
    empty = spark.createDataFrame([], "chave string, tentativa_id string, intencao_em timestamp, prova string, estado string")
    nxt, refused = jobs.fold_attempts(empty, spark.createDataFrame(rows, kind))
    for files in (1, 4, 8):
        run = jobs.AppendRun(keyed.attempts(folder(spark, tmp_path, rows, kind, files)), "l", keyed=True)
        assert keyed.ledger(spark, run.checkpoint) is None
        run.once()
        assert sorted(map(str, keyed.ledger(spark, run.checkpoint).select(*nxt.columns).collect())) == sorted(map(str, nxt.collect()))
        assert {(r.seq, r.motivo) for r in run.read().collect()} == {(r.seq, r.motivo) for r in refused.collect()}


def test_keyed_fingerprints_over_files(spark, tmp_path):
    kind = "id_externo string, descricao string, em timestamp, seq bigint"
    rows = [("a", "x", at(0), 1), ("a", "x ", at(1), 2), ("b", None, at(1), 3), ("a", "y", at(40), 4), ("a", "z", at(60), 5), ("b", "q", at(60), 6)]
    for files in (1, 6):
        run = jobs.AppendRun(keyed.reedited(folder(spark, tmp_path, rows, kind, files)), "p", keyed=True)
        run.once()
        assert sorted(r.seq for r in run.read().collect()) == [4, 5]


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    with keyed.state_store(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKSDB
    assert spark.conf.get(keyed.PROVIDER, None) == before


def test_attempt_ledger(spark):
    empty = spark.createDataFrame([], "chave string, tentativa_id string, intencao_em timestamp, prova string, estado string")
    kind = "chave string, tentativa_id string, tipo string, prova string, em timestamp, seq bigint"
    batch = spark.createDataFrame([
        ("a", "t1", "intencao", None, at(1), 1), ("a", "t2", "intencao", None, at(2), 2), ("a", "t1", "reconciliar", None, at(3), 3),
        ("b", "t3", "intencao", None, at(1), 4), ("b", "t3", "confirmar", "mail", at(2), 5), ("c", "t4", "confirmar", "x", at(2), 6)], kind)
    nxt, refused = jobs.fold_attempts(empty, batch)
    assert {r.chave: r.estado for r in nxt.collect()} == {"a": "envio_incerto", "b": "enviada"}
    assert {r.seq: r.motivo for r in refused.collect()} == {2: "ENVIO_INCERTO_OU_CONFIRMADO", 3: "RECONCILIACAO_INSUFICIENTE", 6: "TENTATIVA_AUSENTE"}


def test_reedited_postings(spark):
    stored = spark.createDataFrame([], "id_externo string, impressao string")
    kind = "id_externo string, descricao string, em timestamp, seq bigint"
    nxt, edits = jobs.fold_fingerprints(stored, spark.createDataFrame([("a", "x", at(0), 1), ("a", "x ", at(1), 2), ("a", "y", at(40), 3)], kind))
    assert [r.seq for r in edits.collect()] == [3]
    _, later = jobs.fold_fingerprints(nxt, spark.createDataFrame([("a", "z", at(60), 4), ("b", "q", at(60), 5)], kind))
    assert [r.seq for r in later.collect()] == [4]


def test_upsert_sink_keeps_one_row_and_sets_late_ones_aside(spark):
    kind = "id_externo string, titulo string, publicada_em timestamp"
    schema = spark.createDataFrame([], kind + ", encontrada_em timestamp").schema
    cache, late = state.cache_table(spark, scratch_path(spark, "cache"), schema, parts=16), scratch_path(spark, "late")
    sink = jobs.upsert_sink(cache, lambda i: "2026-09-25 00:00:00", late)
    sink(spark.createDataFrame([("a", "v1", at(1)), ("a", "v2", at(2)), ("old", "x", dt.datetime(2026, 1, 1))], kind), 0)
    sink(spark.createDataFrame([("a", "v3", at(3)), ("b", "w", None)], kind), 1)
    version = cache.manifest()["version"]
    sink(spark.createDataFrame([("a", "v3", at(3)), ("b", "w", None)], kind), 1)
    assert cache.manifest()["version"] == version
    assert {r.id_externo: r.titulo for r in cache.read().collect()} == {"a": "v3", "b": "w"}
    assert [r.id_externo for r in spark.read.parquet(late).filter(F.col("id_externo") == "old").collect()] == ["old"]
    before = cache.manifest()["parts"]
    sink(spark.createDataFrame([("b", "w2", None)], kind), 2)
    assert sum(before[p] != v for p, v in cache.manifest()["parts"].items()) == 1


def test_sessions_and_rolling_days(spark, tmp_path):
    rows = [("u", at(0)), ("u", at(0.2)), ("u", at(5)), ("v", at(0))]
    stream = lambda n: folder(spark, f"{tmp_path}/{n}", rows, "k string, ts timestamp", 2)
    got = jobs.run_to_end(lambda s: jobs.sessions(s, "k", "ts"), stream("s"), "ts", "s", "1 day")
    assert sorted((r.k, r.n) for r in got.collect()) == [("u", 1), ("u", 2), ("v", 1)]
    per_day = jobs.run_to_end(lambda s: jobs.rolling_counts(s, "ts"), stream("r"), "ts", "r", "5 days")
    assert {r.ate.day: r.n for r in jobs.spread_days(per_day, 3).collect()} == {1: 4, 2: 4, 3: 4}
