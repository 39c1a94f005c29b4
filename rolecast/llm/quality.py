"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad.  A line's features are counts of
byte classes and words in it and in its two neighbours; a 2 x 2 table weighs
the step from one line's label to the next.  Forward-backward marginals of
"good", weighted by line length, give the document's score between 0 and 1.

Features are computed on Arrow batches with numpy.  The chain's sums are prefix
and suffix products of 2 x 2 matrices over all lines of a chunk at once: the
first line of a text has a matrix of rank one, so no product reaches over it.

The field is fitted by the documents' labels (all lines of a document carry its
label) on at most about ``max_train_docs`` labelled documents, chosen by hash,
with whole texts.  Scoring reads every text whole.

Edge cases: an empty or null text is one empty line; a null label, or a label
without a document, is not used; several labels of one document count as their
maximum; without labels of both classes every score is that class's share (1.0
if there are none); repeated rows get equal scores; only the key and the text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm import textbytes as tb

_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": b" \t\r\x0b\x0c",
    "stop": b".,;:", "bang": b"!?", "bar": b"|", "symbol": b"#$%&*+=<>@^~_\\/{}[]`", "quote": b"'\"()-", "high": range(0x80, 0x100),
}
_LUT = {name: np.isin(np.arange(256), list(members)) for name, members in _CLASSES.items()}
_TABLE = np.zeros(256, np.uint8)
for _i, _name in enumerate(_CLASSES):
    _TABLE[_LUT[_name]] = _i + 1
N_BASE = len(_CLASSES) + 7
N_FEATURES = 3 * 2 * N_BASE + 3


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one row of features per line, offsets of the texts among the lines, bytes per line with its break)."""
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    n = int(bounds[-1])
    begin = np.empty(n, np.int64)
    first = np.zeros(n, bool)
    first[bounds[:-1]] = True
    begin[first] = offsets[:-1]
    begin[~first] = breaks + 1
    end = np.empty(n, np.int64)
    last = np.zeros(n, bool)
    last[bounds[1:] - 1] = True
    end[last] = offsets[1:]
    end[~last] = breaks
    size = (end - begin).astype(np.float64)
    kinds = _TABLE[data]
    line_of = np.repeat(np.arange(n), np.diff(np.append(begin, len(data))))
    counts = np.bincount(line_of * (len(_CLASSES) + 1) + kinds, minlength=n * (len(_CLASSES) + 1))
    counts = counts[: n * (len(_CLASSES) + 1)].reshape(n, -1)[:, 1:].astype(np.float64)
    starts, ends, _ = tb.words(data, offsets, tb.SOLID_BYTES)
    hashes = tb.span_hashes(data, starts, ends)
    word_line = line_of[starts] if len(starts) else np.zeros(0, np.int64)
    n_words = np.bincount(word_line, minlength=n).astype(np.float64)
    word_bytes = np.bincount(word_line, weights=ends - starts, minlength=n)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
    again = np.bincount(word_line[same], minlength=n).astype(np.float64)
    tagged = np.sort(tb.mix(hashes ^ tb.mix(word_line.astype(np.uint64) + np.uint64(1))))
    fresh = np.ones(len(tagged), bool)
    fresh[1:] = tagged[1:] != tagged[:-1]
    # Distinct words per text, since a text may say one line again and again.
    text_of_line = np.repeat(np.arange(len(offsets) - 1), per_text)
    word_text = text_of_line[word_line]
    order = np.argsort(tb.mix(hashes ^ tb.mix(word_text.astype(np.uint64) + np.uint64(7))), kind="stable")
    key = hashes[order], word_text[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
    first_use = np.bincount(word_line[order[new]], minlength=n)
    odd = np.bincount(word_line[(ends - starts) > 14], minlength=n).astype(np.float64)
    short = np.bincount(word_line[(ends - starts) <= 2], minlength=n).astype(np.float64)
    some = np.maximum(size, 1)[:, None]
    per_word = np.maximum(n_words, 1)
    base = np.concatenate([counts / some, np.stack([
        np.log1p(size) / 8, np.log1p(n_words) / 6, word_bytes / per_word / 10, again / per_word,
        first_use / per_word, odd / per_word, short / per_word], axis=1)], axis=1)
    own = np.concatenate([base, base * base], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~first[1:]] = own[:-1][~first[1:]]
    after[:-1][~last[:-1]] = own[1:][~last[:-1]]
    out = np.concatenate([own, before, after, np.stack([np.ones(n), first, last], axis=1)], axis=1)
    return out, bounds, size + 1


def _products(m: np.ndarray, longest: int, backward: bool) -> np.ndarray:
    """Running products of 2 x 2 matrices, scaled; ``longest``: lines of the longest text."""
    p = m.copy()
    step = 1
    while step < longest + 1 and step < len(p):
        left, right = (p[:-step], p[step:]) if not backward else (p[:-step], p[step:])
        joined = np.empty_like(left)
        for i in (0, 1):
            for j in (0, 1):
                joined[:, i, j] = left[:, i, 0] * right[:, 0, j] + left[:, i, 1] * right[:, 1, j]
        joined /= joined.max(axis=(1, 2), keepdims=True)
        p = np.concatenate([p[:step], joined]) if not backward else np.concatenate([joined, p[-step:]])
        step *= 2
    return p


def marginals(potential: np.ndarray, steps: np.ndarray, bounds: np.ndarray):
    """P(good) per line, and P(label before, label) per line, for log potentials of "good" and of steps."""
    n = len(potential)
    first = np.zeros(n, bool)
    first[bounds[:-1]] = True
    e = np.exp(np.clip(potential, -30, 30))
    m = np.empty((n, 2, 2))
    weight = np.exp(np.clip(steps, -8, 8))
    m[:, :, 0] = weight[:, 0]
    m[:, :, 1] = weight[:, 1] * e[:, None]
    m[first, :, 0] = 1.0
    m[first, :, 1] = e[first, None]
    m /= m.max(axis=(1, 2), keepdims=True)
    longest = int(np.diff(bounds).max()) if len(bounds) > 1 else 0
    alpha = _products(m, longest, False)[:, 0, :]
    suffix = _products(m, longest, True).sum(axis=2)
    beta = np.ones((n, 2))
    beta[:-1] = suffix[1:]
    beta[bounds[1:] - 1] = 1.0
    beta /= beta.max(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    pair = np.zeros((n, 2, 2))
    pair[1:] = alpha[:-1, :, None] * m[1:] * beta[1:, None, :]
    pair[first] = 0.0
    total = pair.sum(axis=(1, 2), keepdims=True)
    pair = np.divide(pair, total, out=np.zeros_like(pair), where=total > 0)
    return both[:, 1], pair


@dataclass
class LineField:
    """Fitted weights; ``constant`` replaces the field where labels of one class only were seen."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    constant: float | None = None

    def document_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        features, bounds, size = line_features(data, offsets)
        good, _ = marginals(((features - self.centre) / self.scale) @ self.weights, self.steps, bounds)
        return np.add.reduceat(good * size, bounds[:-1]) / np.add.reduceat(size, bounds[:-1])


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> LineField:
    """Maximise the chain's conditional likelihood by full gradients (Adam)."""
    if len(labels) == 0 or labels.min() == labels.max():
        return LineField(np.zeros(0), np.ones(0), np.zeros(0), np.zeros((2, 2)), float(labels[0]) if len(labels) else 1.0)
    centre, scale = features.mean(axis=0), features.std(axis=0)
    centre[scale < 1e-9], scale[scale < 1e-9] = 0.0, 1.0
    x = (features - centre) / scale
    counts = np.diff(bounds)
    y = np.repeat(labels, counts).astype(np.float64)
    # Each document counts alike, however many lines it has.
    share = np.repeat(1.0 / np.sqrt(counts), counts)
    share /= share.sum()
    first = np.zeros(len(y), bool)
    first[bounds[:-1]] = True
    told = np.zeros((len(y), 2, 2))
    told[np.arange(len(y)), y.astype(int), y.astype(int)] = 1.0
    told[first] = 0.0
    theta = np.zeros(x.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, steps = theta[:-4], theta[-4:].reshape(2, 2)
        good, pair = marginals(x @ w, steps, bounds)
        slope = np.concatenate([x.T @ (share * (y - good)), ((told - pair) * share[:, None, None]).sum(axis=0).ravel()])
        slope -= ridge * theta
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        theta = theta + 0.08 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return LineField(centre, scale, theta[:-4], theta[-4:].reshape(2, 2))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in tb.chunks(batch.column(1)):
            features, bounds, _ = line_features(data, offsets)
            flat = features.astype(np.float32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(row, end - row),
                pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          usable: Column | None = None, max_train_docs: int = 4000) -> LineField:
    """Fit on labelled documents; ``usable`` filters the label rows (for a held-out part).

    ``max_train_docs`` bounds what comes to the driver: label rows are chosen by a
    hash of the key so that about that many remain.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if usable is not None:
        rows = rows.filter(usable)
    rows = rows.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    count = rows.count()
    if count > max_train_docs:
        scale = 1 << 30
        rows = rows.filter(F.pmod(F.xxhash64("_key"), F.lit(scale)) < int(scale * max_train_docs / count))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    # Bounded by max_train_docs rows of two numbers.
    found = texts.join(F.broadcast(rows), F.col("_id") == F.col("_key")).select(F.col("_label").cast("int"), "_text")
    got = found.mapInArrow(_feature_rows, "label int, features binary").toPandas()
    if got.empty:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(1, np.int64), np.zeros(0))
    order = np.lexsort((got["features"].map(hash_bytes).to_numpy(), got["label"].to_numpy()))
    parts = [np.frombuffer(got["features"].iloc[i], np.float32).reshape(-1, N_FEATURES) for i in order]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return fit(np.concatenate(parts).astype(np.float64), bounds, got["label"].to_numpy()[order])


def hash_bytes(raw: bytes) -> int:
    """A fixed order of training rows, so that a rerun sums in the same order."""
    import zlib
    return zlib.crc32(raw)


def score(docs: DataFrame, field: LineField, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every document with its ``score``."""
    names = [c for c in (keep if keep is not None else docs.columns) if c != "score"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), *([] if text in names else [F.col(text).alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.chunks(tb.text_column(batch, names, text)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(field.document_scores(data, offsets), pa.float64())],
                    names=["_doc", "score"])

    schema = f"_doc {packed.schema['_doc'].dataType.simpleString()}, score double"
    return packed.mapInArrow(run, schema).select("_doc.*", "score")
