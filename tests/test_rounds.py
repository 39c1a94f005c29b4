"""Runs as one job: what lands changes the state once."""

import datetime as dt
import json

import pytest

from rolecast.config import Profile
from rolecast.operators import rounds
from rolecast.sources.landing import news, read_raw, unread, write_raw

T0 = dt.datetime(2026, 9, 25, 8)
JUDGED = "id string, nota double, resumo string, gaps string, impressao string, lido_em date"


def job(i, title="Senior Product Designer", days=1, **more):
    return {"id": i, "name": title, "careerPageName": f"Co {i}", "jobUrl": f"https://co{i}.gupy.io/jobs/{i}", "workplaceType": "remote",
            "description": "design system para produto", "publishedDate": (T0 - dt.timedelta(days=days)).isoformat() + "Z", **more}


def land(spark, zone, at, *jobs, source="gupy", body=None):
    rows = [(source, "", at, f"https://feed/{source}", 200, body or json.dumps({"data": list(jobs)}))]
    write_raw(spark.createDataFrame(rows, "source string, entry string, fetched_at timestamp, url string, http_status int, body string"), zone)


@pytest.fixture(scope="module")
def story(spark, tmp_path_factory):
    """Four runs: a first landing, nothing new, an edit and a newcomer, and a day on which postings have grown old."""
    path = str(tmp_path_factory.mktemp("round"))
    zone, st = f"{path}/zone", rounds.RoundState.at(spark, f"{path}/state", parts=4)
    judged = spark.createDataFrame([("gupy:1", 40.0, "boa", None, None, T0.date())], JUDGED)
    profile = Profile(read_per_run=2)
    out = []

    def run(now):
        got = rounds.run_round(read_raw(spark, zone), st, judged, now.isoformat(sep=" "), ("gupy", "remotar"), profile)
        tables = {n: t.manifest()["parts"] for n, t in (("cache", st.cache), ("board", st.board))}
        out.append(dict(
            sources=got.sources, cache={r.id_externo: r for r in st.cache.read().collect()}, board={r.id: r for r in st.board.read().collect()},
            top=[r.id_externo for r in got.top.collect()], stalled=[r.id_externo for r in got.stalled.collect()],
            events=sorted((r.id, r.para) for r in got.events.collect()), report=got.report.first(), parts=tables, marks=st.marks.known()))

    land(spark, zone, T0, job(1), job(2), job(3, "Analista Contábil"), job(4, "Designer", days=25, description="x"), job(5, "UX Designer Júnior"), job(6, days=60))
    run(T0)
    run(T0 + dt.timedelta(hours=1))
    land(spark, zone, T0 + dt.timedelta(hours=4), job(1, "Product Designer Senior"), job(7, jobUrl="https://co2.gupy.io/jobs/2"), job(8))
    land(spark, zone, T0 + dt.timedelta(hours=5), source="remotar", body="{broken")
    run(T0 + dt.timedelta(hours=6))
    run(T0 + dt.timedelta(days=40))
    return zone, st, out


def test_first_run_keeps_what_passes(story):
    first = story[2][0]
    assert set(first["cache"]) == {"gupy:1", "gupy:2", "gupy:4"} and first["sources"] == [{"fonte": "gupy", "postagens": 6, "erro": None}]
    # FLT-14: twenty-five days old, and a reading could not lift it far enough.
    assert first["stalled"] == ["gupy:4"] and first["events"] == [("gupy:1", "Avaliar"), ("gupy:2", "Avaliar")]
    assert first["top"][0] == "gupy:1" and len(first["top"]) == 2
    assert first["report"].unicas == 3 and first["report"].aprovadas == 2 and first["report"].lidas == 1


def test_second_run_changes_nothing_and_reads_no_payload(spark, story):
    zone, st, (first, second, *_) = story
    assert second["sources"] == [] and second["events"] == []
    for name in ("cache", "board", "top", "parts", "marks"):
        assert second[name] == first[name]
    raw, marks = read_raw(spark, zone), story[2][-1]["marks"]
    assert news(raw, marks, ("gupy", "remotar")) == {}
    rest = unread(raw, "gupy", marks["gupy"], marks["gupy"])
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert rest.count() == 0 and "PartitionFilters: [isnotnull(source" in plan and "day" in plan.split("PartitionFilters")[1].split("]")[0]


def test_third_run_takes_edits_and_merges(story):
    second, third = story[2][1], story[2][2]
    assert third["cache"]["gupy:1"].titulo == "Product Designer Senior"
    assert third["cache"]["gupy:1"].encontrada_em == second["cache"]["gupy:1"].encontrada_em
    # Posting 7 has the link of posting 2, so one of the two stays; a body that is no JSON has no postings.
    assert len({"gupy:2", "gupy:7"} & set(third["cache"])) == 1 and "gupy:8" in third["cache"]
    assert [line["postagens"] for line in third["sources"]] == [3, 0] and third["board"]["gupy:1"].titulo == "Product Designer Senior"
    assert len(third["top"]) == 2 and ("gupy:8", "Avaliar") in third["events"]


def test_old_postings_leave_the_cache_and_stay_on_the_board(story):
    third, fourth = story[2][2], story[2][3]
    assert fourth["cache"] == {} and fourth["sources"] == [] and set(fourth["board"]) == set(third["board"]) != set()


def test_a_failing_source_keeps_its_mark(spark, tmp_path, monkeypatch):
    from rolecast.sources import normalize
    zone, st = f"{tmp_path}/zone", rounds.RoundState.at(spark, f"{tmp_path}/state", parts=2)
    land(spark, zone, T0, job(1))
    land(spark, zone, T0, source="remotar")
    real = normalize.normalize

    def broken(raw, now, sources, kw):
        if sources == ("remotar",):
            raise RuntimeError("lost")
        return real(raw, now, sources, kw)

    monkeypatch.setattr(normalize, "normalize", broken)
    report = normalize.land_new(read_raw(spark, zone), str(T0), st.cache, st.marks, ("gupy", "remotar"))
    assert [(line["fonte"], line["erro"]) for line in report] == [("gupy", None), ("remotar", "lost")] and set(st.marks.known()) == {"gupy"}
    monkeypatch.undo()
    report = normalize.land_new(read_raw(spark, zone), str(T0), st.cache, st.marks, ("gupy", "remotar"))
    assert [line["fonte"] for line in report] == ["remotar"] and set(st.marks.known()) == {"gupy", "remotar"}
