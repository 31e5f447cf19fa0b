"""Text quality from document statistics: random Fourier features, ridge regression, isotonic calibration.

A text becomes ``len(STATISTICS)`` numbers about its characters, words and lines. ``FEATURES`` random Fourier features of the
standardised numbers approximate a Gaussian kernel; a ridge regression on them solves the normal equations, whose terms are
summed within partitions and then row by row over partitions, so that all labelled rows count. Its values are calibrated by
isotonic regression over a grid of values. What reaches the driver has a fixed size.

Defined cases: null and empty texts have all statistics 0 and are scored like any; labels that are null or whose id is null
are not learnt from, of labels that repeat an id the highest counts; without both kinds of labels the score is the share of
label 1, or 0.5 without any. Rows that repeat are scored alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marketlake.llm.common import held_out, stored, text_or_empty

__all__ = ["FEATURES", "STATISTICS", "Model", "fit", "isotonic", "scores", "statistics"]

STATISTICS = (
    "log_bytes", "upper", "digits", "blanks", "others", "bangs", "bars", "symbols", "stops", "other_marks",
    "log_words", "word_length", "distinct_words", "distinct_lines", "words_a_line", "repeated_next", "marked_words", "shouted_words",
)
FEATURES, WIDTH, RIDGE, SEED = 256, 0.35, 1e-3, 11
#: Steps of the grid of regression values, from -1 to 2, that the calibration is fitted on.
GRID = 1500

_KIND = np.zeros(256, np.int64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", bytes(range(128, 256)), b"!", b"|", b"#$%&*@^~<>{}[]\\_=+", b".,;:?", b"\"'()-/`")):
    _KIND[list(_set)] = _i + 1


def statistics(text: bytes) -> np.ndarray:
    """The numbers of one UTF-8 text, most of them shares."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=10)[1:] / len(text)
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    out[0], out[1:10] = np.log1p(len(text)), kinds
    out[10], out[11] = np.log1p(len(words)), min(50.0, sum(map(len, words)) / n) / 10
    out[12], out[13] = len(set(words)) / n, len(set(lines)) / len(lines)
    out[14] = np.log1p(n / len(lines))
    out[15] = sum(map(bytes.__eq__, words, words[1:])) / n
    out[16] = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n
    out[17] = sum(map(bytes.isupper, words)) / n
    return out


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, x): the statistics of every row."""
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                ids, texts = batch.slice(start, 1024).columns
                x = pa.array([statistics(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids, x], names=["id", "x"])

    return rows.mapInArrow(over, schema)


@dataclass
class Model:
    """Standardisation, random directions, ridge weights and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases) * np.sqrt(2 / FEATURES)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # a thousandth of the uncalibrated value orders what the calibration ties
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip((raw + 1) / 3, 0, 1), 0, 1)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to ``y`` in weighted squares (pooling adjacent violators)."""
    level: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist()):
        level.append([value, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]
    return np.repeat([v for v, _, _ in level], [int(k) for _, _, k in level])


def _summed(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations of all rows (x, y): summed in each partition, then each matrix row over the partitions."""
    d = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            x, y = np.array(batch["x"].to_pylist(), float), np.array(batch["y"].to_pylist(), float)
            if len(y):
                z = np.column_stack([model.features(x), np.ones(len(y))])
                total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["k", "sums"])

    def whole(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "sums": [np.sum([np.frombuffer(s) for s in parts["sums"]], axis=0).tobytes()]})

    found = rows.mapInArrow(partial, "k int, sums binary").groupBy("k").applyInPandas(whole, "k int, sums binary").collect()
    total = np.zeros((d, d + 1))
    for r in found:
        total[r["k"]] = np.frombuffer(r["sums"])
    return total[:, :-1], total[:, -1]


def fit(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """The regression that the labels which are not held out teach; ``measured``: id, x."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("double").alias("y"))
    rows = stored(measured.join(known, "id").select("x", "y"))
    m = len(STATISTICS)
    sums = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y"), *[f(F.col("x")[i]).alias(f"{c}{i}") for i in range(m) for c, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
    n, share = sums["n"], (sums["y"] / sums["n"] if sums["n"] else 0.5)
    rng = np.random.default_rng(SEED)
    mean = np.array([sums[f"a{i}"] or 0.0 for i in range(m)])
    scale = np.array([sums[f"s{i}"] or 1.0 for i in range(m)])
    model = Model(mean, scale, rng.normal(0, WIDTH, (m, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.array([0.0, 1.0]), np.array([share, share])))
    if share in (0.0, 1.0) or not n:
        model.weights[-1] = share
        return model
    a, c = _summed(rows, model)
    ridge = np.full(FEATURES + 1, RIDGE * n / FEATURES)
    ridge[-1] = 1e-9
    model.weights = np.linalg.solve(a + np.diag(ridge), c)

    def raw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array(part["x"].to_pylist(), float).reshape(-1, m)
            at = np.clip(np.floor((model.raw(x) + 1) / 3 * GRID), 0, GRID - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), part["y"]], names=["at", "y"])

    cells = rows.mapInArrow(raw, "at int, y double").groupBy("at").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("at").collect()
    at, w, y = (np.array([r[k] for r in cells], float) for k in ("at", "n", "y"))
    model.knots = (at + 0.5) / GRID * 3 - 1, isotonic(y, w)
    return model


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id and score, 0 to 1; a higher score makes label 1 likelier."""
    measured = stored(_measured(docs, doc_id, text))
    model = fit(measured, labels, doc_id, label)
    schema = T.StructType([T.StructField("id", measured.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(model.score(x), pa.float64())], names=["id", "score"])

    return measured.mapInArrow(over, schema).withColumnRenamed("id", doc_id)
