"""Training windows of chats, cut at turns within a token budget.

Turns are marked by a template whose control strings cannot come from a text:
``\\`` and ``<`` inside texts and roles are escaped, and unescaping gives the text
back exactly.  A conversation that is longer than the budget becomes several windows.
Each window has the conversation's system turn, some repeated history and the turns
that are new in it; every turn but the system turn is new in exactly one window, and
the loss mask covers the assistant texts among the new turns only.

Where windows begin is read off prefix sums of the turns' tokens.  The sums run in
two levels (blocks of turns, then turns), and a conversation is first cut by them
into segments of ``segment`` budgets, so that a conversation of any length is dealt
to many tasks and no task holds more than a segment with the history before it.

Edge cases: null texts and roles are empty; turns come in the order of turn number
(nulls first), role and text, and repeated rows are turns of their own; a turn that
alone exceeds the budget has a window of its own and is not cut (``over_budget``); a
conversation of system turns only is one window; a null conversation id is a
conversation; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, END = "<turn:", "</turn>\n"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn:((?:[^\\<>]++|\\.)*+)>((?:[^\\<]++|\\.)*+)</turn>\n", re.S)
SCHEMA = ("conv_id bigint, window_start bigint, text string, places array<bigint>, new array<boolean>, "
          "loss array<struct<start: bigint, end: bigint>>, tokens bigint, over_budget boolean")
SCHEMA_FIELDS = [
    ("conv_id", pa.int64()), ("window_start", pa.int64()), ("text", pa.string()), ("places", pa.list_(pa.int64())),
    ("new", pa.list_(pa.bool_())), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("tokens", pa.int64()), ("over_budget", pa.bool_())]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(role: str, text: str) -> tuple[str, int]:
    """(marked turn, place of the text in it)."""
    head = f"{OPEN}{escape(role)}>"
    return f"{head}{escape(text)}{END}", len(head)


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


def token_count(text: Column) -> Column:
    """Words and single other signs; a stand-in for a tokenizer that needs no vocabulary."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long") + 4


def _numbered(turns: DataFrame, tokens: Column | None, turn_block: int) -> DataFrame:
    """(conv_id, turn, role, text, tokens, seq, before): place and tokens before each turn that is no kept system turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens if tokens is not None else token_count(F.col("text")))
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col("turn") / turn_block), F.lit(-(2**62))).cast("long"))
    sums = rows.groupBy("conv_id", "_block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("_t"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_n"))
    order = Window.partitionBy("conv_id", "_block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("seq", F.row_number().over(order) - 1).withColumn(
        "before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    joined = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    return joined.select("conv_id", "turn", "role", "text", "tokens", (F.col("seq") + F.col("_n")).alias("seq"), (F.col("before") + F.col("_t")).alias("before"))


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, tokens: Column | None = None,
            segment: int = 64, turn_block: int = 256) -> DataFrame:
    """Windows of (conv_id, turn, role, text); see SCHEMA.

    ``budget``: tokens of a window; ``history``: tokens of earlier turns that are
    repeated at most; ``tokens``: a Column for a turn's tokens in place of the default
    count.  ``window_start`` is the place of the first new turn in its conversation.
    """
    rows = _numbered(turns, tokens, turn_block)
    length = segment * budget
    own = F.floor(F.col("before") / length)
    # A turn is also history of a segment that begins within ``history`` tokens after the turn's begin.
    rows = rows.withColumn("segment", F.explode(F.sequence(own, F.floor((F.col("before") + history) / length))))
    rows = rows.withColumn("new", F.col("segment") == own)
    system = rows.filter((F.col("role") == "system") & F.col("new")).groupBy("conv_id").agg(
        F.min_by(F.struct("seq", "text", "tokens"), "seq").alias("system"))
    system = system.select(F.col("conv_id").alias("_c"), "system")
    rows = rows.join(system, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")

    def build(conv, part: list[tuple]) -> list[list]:
        """Windows of one segment from its rows (seq, role, text, tokens, new, system) in order."""
        kept = part[0][5]
        head = None if kept is None else (kept["seq"], "system", kept["text"])
        base = 0 if kept is None else kept["tokens"]
        here = head is not None and any(r[4] for r in part if r[0] == head[0])
        body = [r for r in part if head is None or r[0] != head[0]]
        turns_ = [r[:3] for r in body]
        sums = np.concatenate(([0], np.cumsum([r[3] for r in body], dtype=np.int64)))
        first = next((i for i, r in enumerate(body) if r[4]), len(body))
        out = []
        for low, at, stop in _spans(sums, first, budget - base, history):
            # The system turn counts as new in the window around its own place.
            told = here and (not out or head[0] > turns_[at][0]) and (stop == len(body) or head[0] < turns_[stop][0])
            spent = base + int(sums[stop] - sums[low])
            out.append([conv, turns_[at][0], *_format(head, told, turns_[low:at], turns_[at:stop]), spent, spent > budget])
        if here and not out:
            out.append([conv, head[0], *_format(head, True, [], []), base, base > budget])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order, so a segment is complete when the next one begins.
        current, part = None, []
        for batch in batches:
            done = []
            for conv, segment_, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part and (conv, segment_) != current:
                    done += build(current[0], part)
                    part = []
                current = conv, segment_
                part.append(tuple(row))
            yield _batch(done, SCHEMA_FIELDS)
        if part:
            yield _batch(build(current[0], part), SCHEMA_FIELDS)

    ordered = rows.select("conv_id", "segment", "seq", "role", "text", "tokens", "new", "system").repartition(
        "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "seq")
    return ordered.mapInArrow(run, SCHEMA)


def _batch(rows: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def _spans(sums: np.ndarray, at: int, room: int, history: int):
    """(first turn of the history, first new turn, turn after the last) by binary search in the prefix sums."""
    turns = len(sums) - 1
    while at < turns:
        low = int(np.searchsorted(sums, sums[at] - history))
        stop = int(np.searchsorted(sums, sums[low] + room, "right")) - 1
        if stop <= at:
            # The next turn does not fit with its history: it goes without, alone if it has to.
            low, stop = at, max(at + 1, int(np.searchsorted(sums, sums[at] + room, "right")) - 1)
        yield low, at, stop
        at = stop


def _format(head, head_is_new: bool, repeated: list, fresh: list):
    """(text, place of each turn, whether it is new, loss spans) of one window."""
    pieces, places, new, loss, length = [], [], [], [], 0
    listed = ([(head, head_is_new)] if head else []) + [(t, False) for t in repeated] + [(t, True) for t in fresh]
    for (place, role, text), is_new in listed:
        piece, start = marked(role, text)
        if is_new and role == "assistant":
            loss.append({"start": length + start, "end": length + len(piece) - len(END)})
        pieces.append(piece)
        places.append(place)
        new.append(is_new)
        length += len(piece)
    return "".join(pieces), places, new, loss


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: see the columns of ``DIGEST``.

    Windows stream through their task in order, so memory does not grow with a
    conversation; a running digest is a sequence by nature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for conv, *window in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != current:
                    if state is not None:
                        done.append(state.row(current))
                    current, state = conv, _Digest()
                state.add(*window)
            yield _batch(done, DIGEST_FIELDS)
        if state is not None:
            yield _batch([state.row(current)], DIGEST_FIELDS)

    ordered = formatted.select("conv_id", "window_start", "text", "places", "new", "loss").repartition("conv_id").sortWithinPartitions(
        "conv_id", "window_start").drop("window_start")
    return ordered.mapInArrow(run, DIGEST)


DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
          "n_windows bigint")
DIGEST_FIELDS = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST.split(", ")]


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.windows = 0

    def add(self, text: str, places, new, loss) -> None:
        read = read_turns(text)
        for _, role, said in sorted((p, role, said) for p, fresh, (role, said, _, _) in zip(places, new, read, strict=True) if fresh):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in loss:
            target = unescape(text[span["start"]: span["end"]])
            self.loss.update(target.encode())
            self.loss_chars += len(target)
        self.chars += len(text)
        self.windows += 1

    def row(self, conv):
        return [conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows]
