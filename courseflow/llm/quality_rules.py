"""Quality rules: fixed counts, then a hashed n-gram logistic regression with calibrated probability.

Features are relative frequencies of hashed word 1- and 2-grams and of character (code point) 3- and
4-grams over the whole text. The model is fitted on at most ``MAX_TRAIN`` labelled rows (a documented bound, half of
each class, the rows of smallest key hash), calibrated on a held-out fifth of them (Platt scaling with
both classes weighing the same, so the fixed threshold of 0.5 means "likelier good than bad at even
odds"), and applied to every row in Arrow batches.

Defined cases: a null or empty text has no words and fails; labels with a null key, null quality or
both classes for one key are left out; with fewer than ``MIN_CLASS`` rows of a class there is no model
and only the fixed rules decide; repeated rows are each scored alike (of a repeated key the text of
least hash is trained on); an empty table gives no rows;
further columns of any name pass through ``annotate`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courseflow.llm import textblock as tb
from courseflow.llm.shared import free_name, text_batches

MAX_TRAIN = 2000
MIN_CLASS = 5
THRESHOLD = 0.5
BITS = 17
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_prob double"
#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


def _grams(words: tb.Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hashed index of every gram, and first and last + 1 gram of each row."""
    raw, at, h = words.raw, words.at, words.hash
    shift = tb.U(64 - BITS)
    found = [(tb.mix(h, 11) >> shift, words.first[:-1], words.first[1:])]
    two = tb.mix(h[:-1] * tb.U(3) + h[1:], 12) >> shift if len(h) > 1 else np.zeros(0, tb.U)
    found.append((two, np.minimum(words.first[:-1], len(two)), np.clip(words.first[1:] - 1, 0, len(two))))
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]  # of each text among the code points
    for k in (3, 4):
        code = np.full(max(0, len(points) - k + 1), k, np.uint32)
        for j in range(k):
            code = (code ^ points[j : len(points) - k + 1 + j]) * np.uint32(2654435761)
            code ^= code >> np.uint32(15)
        found.append((code * np.uint32(2246822519) >> np.uint32(32 - BITS), np.minimum(place[:-1], len(code)), np.clip(place[1:] - k + 1, 0, len(code))))
    return [(g.astype(np.int64), a, np.maximum(a, b)) for g, a, b in found]


def _features(words: tb.Words, row: int, grams) -> tuple[np.ndarray, np.ndarray]:
    ids, values = [], []
    for kind, (g, a, b) in enumerate(grams):
        if b[row] > a[row]:
            i, n = np.unique(g[a[row] : b[row]], return_counts=True)
            ids.append(i + (kind << BITS))
            values.append(n / (b[row] - a[row]))
    return (np.concatenate(ids), np.concatenate(values)) if ids else (np.zeros(0, np.int64), np.zeros(0))


def _margin(words: tb.Words, weights: np.ndarray) -> np.ndarray:
    out = np.full(len(words.at) - 1, float(weights[-1]))
    for kind, (g, a, b) in enumerate(_grams(words)):
        total = np.zeros(len(g) + 1)
        np.cumsum(weights[kind << BITS : (kind + 1) << BITS][g], out=total[1:])
        out += (total[b] - total[a]) / np.maximum(b - a, 1)
    return out


def _in_repeats(words: tb.Words) -> np.ndarray:
    """Whether each word lies in a window of WINDOW words found twice or more in its row."""
    at = words.windows(WINDOW)
    cover = np.zeros(len(words.hash) + 1, np.int32)
    if len(at):
        key = words.window_hash(at, WINDOW) + tb.mix(words.row[at].astype(tb.U), 3)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _dup_lines(words: tb.Words) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    raw, at = words.raw, words.at
    n = len(at) - 1
    breaks = np.flatnonzero(raw == 10)
    first = np.zeros(len(raw) + 1, bool)
    first[at[:-1]] = first[breaks + 1] = True
    start = np.flatnonzero(first[:-1])
    if not len(start):
        return np.zeros(n, np.int64)
    row = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(raw)), at[row + 1])
    end = end - ((end > start) & (raw[np.maximum(end - 1, 0)] == 10))
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[full], end[full], row[full]
    key = tb.span_hash(raw, start, end) + tb.mix(row.astype(tb.U), 5)
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _judge(column: pa.Array, model: dict | None) -> pa.StructArray:
    words = tb.Words(*tb.texts(column))
    n = np.diff(words.first)
    chars = _per_row(((words.raw & 0xC0) != 0x80) & ~tb.SEPARATOR[words.raw], words.at)
    symbols = _per_row(_IS_SYMBOL[words.raw], words.at)
    repeats = _per_row(_in_repeats(words), words.first)
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    if model is None:
        probability = pa.nulls(len(n), pa.float64())
        kept = ~failed
    else:
        p = 1 / (1 + np.exp(-np.clip(model["slope"] * _margin(words, model["weights"]) + model["offset"], -50, 50)))
        probability, kept = pa.array(p), ~failed & (p >= model["threshold"])
    arrays = [pa.array(x.astype(np.int64)) for x in (n, chars, symbols, _dup_lines(words), repeats)]
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.StructArray.from_arrays([*arrays, pa.array(failed), pa.array(kept), probability], names)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """At most ``most`` labelled rows with their text."""
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").select("doc_id", "label")
    pick = lambda c: one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
    few = pick(0).unionByName(pick(1))  # bounded by ``most`` rows, so it may be broadcast
    text = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return text.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))  # of repeated ids always the same text


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = THRESHOLD) -> dict | None:
    """Fits and calibrates the model; None if a class has fewer than MIN_CLASS rows."""
    sample = labelled_sample(docs, labels, most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.parts(batch, "text"):
                words = tb.Words(*tb.texts(part.column("text")))
                grams = _grams(words)
                found = [_features(words, i, grams) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary())], ["doc_id", "label", "ids", "freq"])

    rows = sorted(text_batches(sample).mapInArrow(features, "doc_id long, label int, ids binary, freq binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], float)
    if min((y == 0).sum(), (y == 1).sum()) < MIN_CLASS:
        return None
    fold = np.zeros(len(y), bool)
    for c in (0, 1):
        fold[np.flatnonzero(y == c)[::5]] = True
    ids = [np.frombuffer(r["ids"], np.int32) for r in rows]
    freq = [np.frombuffer(r["freq"], np.float32) for r in rows]
    weights = _fit([i for i, f in zip(ids, fold) if not f], [v for v, f in zip(freq, fold) if not f], y[~fold])
    held = np.array([weights[i] @ v + weights[-1] for i, v, f in zip(ids, freq, fold) if f])
    true = y[fold]
    importance = np.where(true == 1, 0.5 / (true == 1).mean(), 0.5 / (true == 0).mean())
    slope, offset = _platt(held, true, importance)
    return {"weights": weights.astype(np.float32), "slope": slope, "offset": offset, "threshold": threshold}


def _fit(ids: list, freq: list, y: np.ndarray, steps: int = 150, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression by full-batch Adam over the hashed features; the last weight is the bias."""
    lengths = np.array([len(i) for i in ids])
    col, val, first = np.concatenate(ids).astype(np.intp), np.concatenate(freq), np.cumsum(lengths) - lengths
    some, n = lengths > 0, (4 << BITS) + 1
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    balance = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for t in range(1, steps + 1):
        z = np.full(len(y), w[-1])
        z[some] += np.add.reduceat(val * w[col], first[some]) if some.any() else 0
        g = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.append(np.bincount(col, val * np.repeat(g.astype(np.float32), lengths), n - 1), g.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _platt(z: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated probability, by Newton steps on smoothed targets."""
    high, low = ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2)
    target, scale = np.where(y == 1, high, low), max(float(np.abs(z).max()), 1e-9)
    x, ab = np.column_stack([z / scale, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -50, 50)))
        grad = x.T @ (importance * (p - target)) + 1e-3 * ab
        step = np.linalg.solve((x * (importance * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(ab[0] / scale), float(ab[1])


def annotate(docs: DataFrame, model: dict | None, into: str = "quality_rules") -> DataFrame:
    """``docs`` with a struct column of the counts and the verdict."""
    into = free_name(docs, into)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**19 float32 at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, _judge(part.column("text"), shared.value)], [*part.schema.names, into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(RESULT))])
    return text_batches(docs).mapInArrow(score, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, counts, verdict and calibrated probability."""
    scored = annotate(docs.select("doc_id", "text"), train(docs, labels, most, threshold), "r")
    return scored.select("doc_id", "r.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    into = free_name(docs, "quality_rules")
    return annotate(docs, train(docs, labels), into).where(F.col(f"`{into}`.kept")).drop(into)
