"""A run as one job: from landed payloads to cache, board, ranking and report (FLT-14, TOP-04, SNK-01, SNK-02, GR-06).

The state between runs is a posting cache and a board, both in parts, and the read marks.
A run reads what has landed since the last one, brings the cache up to today's rules,
resolves it, scores and looks up what is left, registers it on the board and ranks it.  A
second run over an unchanged zone reads no payload and leaves every part as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS, DEFAULT_PROFILE
from rolecast.operators import filters, lookups, resolve, state, views
from rolecast.operators.shaping import cut_lineage
from rolecast.operators.versioned import PartTable
from rolecast.sources import normalize
from rolecast.sources.landing import POSTING_FIELDS, ReadMarks

BOARD_FIELDS = {
    "id": "string", "status": "string", "titulo": "string", "empresa": "string", "url": "string", "fonte": "string", "compatibilidade": "int",
    "salario_texto": "string", "publicada_em": "timestamp", "registrada_em": "timestamp"}


@dataclass
class RoundState:
    """What stays between runs, below one folder."""

    cache: PartTable
    board: PartTable
    marks: ReadMarks

    @classmethod
    def at(cls, spark: SparkSession, path: str, parts: int = 64) -> "RoundState":
        schema = lambda fields: spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in fields.items())).schema
        return cls(
            state.cache_table(spark, f"{path}/cache", schema(POSTING_FIELDS).add("encontrada_em", "timestamp"), parts),
            PartTable(spark, f"{path}/board", schema(BOARD_FIELDS), ["id"], parts), ReadMarks(spark, f"{path}/marks"))


@dataclass
class Round:
    """The outcome of a run.

    ``sources``: a line per source with news.  ``active``: open postings with score, judgement and board status.
    ``stalled``: those that FLT-14 leaves out.  ``top``: the best that are not concluded, ``read_per_run`` of them.
    ``events``: new history rows of the board.  ``report``: the totals, one row.
    """

    sources: list[dict]
    active: DataFrame
    stalled: DataFrame
    top: DataFrame
    events: DataFrame
    report: DataFrame


def run_round(raw: DataFrame, st: RoundState, judgements: DataFrame, now, sources: tuple[str, ...] = normalize.ALL_SOURCES,
              profile=DEFAULT_PROFILE, kw=DEFAULT_KEYWORDS, overlap_days: int = 0) -> Round:
    """One run; running it again changes nothing."""
    lines = normalize.land_new(raw, now, st.cache, st.marks, sources, kw, overlap_days)
    state.expunge_cache(st.cache, now, profile, kw)
    cache = st.cache.read()
    resolved = resolve.resolve(cache, kw=kw)
    # Losers of a merge leave the cache; their ids live on as aliases.
    losers = cut_lineage(resolve.removed_ids(cache, resolved), "losers")
    survivors = cut_lineage(resolved.survivors.select(*cache.columns, "tambem_visto_em", "n_fundidas"), "survivors")
    if not losers.isEmpty():
        st.cache.merge(losers, lambda stored, gone: stored.join(gone, "id_externo", "left_anti").select(*cache.columns))
    # Of several cards with one key the one registered last counts.
    board = st.board.read().withColumn("ord", F.struct("registrada_em", "id"))
    view = lookups.hydrate(survivors, judgements, board, now, profile, kw, aliases=resolved.aliases)
    judged = cut_lineage(view.withColumn("reason", filters.stalled_reason(profile)), "judged")
    active, stalled = judged.filter("reason IS NULL"), judged.filter("reason IS NOT NULL")
    events = register(st.board, active, now)
    open_ = active.filter(~F.coalesce("concluida", F.lit(False)))
    report = views.run_totals(judged.withColumn("nova", F.col("encontrada_em") == F.lit(now).cast("timestamp")))
    return Round(lines, active, stalled, views.rank_top(open_, profile.read_per_run), events, report)


def register(board: PartTable, approved: DataFrame, now) -> DataFrame:
    """SNK-02 on a board of parts: new cards and changed snapshots are written, cards as they were are not; returns the events."""
    rows = cut_lineage(approved.withColumn("id", F.col("id_externo")), "approved")
    stored = board.near(rows)
    known = [f.name for f in board.schema]
    nxt, events = state.register(stored, rows, now)
    events = cut_lineage(events, "events")
    changed = cut_lineage(nxt.select(*known).join(rows.select("id").distinct(), "id", "left_semi").select(*known).exceptAll(stored.select(*known)), "changed")
    if not changed.isEmpty():
        board.merge(changed, lambda old, new: old.join(new.select("id"), "id", "left_anti").select(*known).unionByName(new))
    return events
