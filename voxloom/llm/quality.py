"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import pieces, word_hashes, word_spans
from .runtime import map_in_arrow, written

#: Cosine features of the Gaussian kernel.
FEATURES = 256
#: Ridge penalty per training row.
PENALTY = 1e-4
#: Score bins of the calibration; bounds what reaches the driver.
BINS = 4096

# Classes of bytes: 0 other control, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 full stop, 7 comma, 8 other punctuation of prose, 9 symbol, 10 first byte of a longer character, 11 its later bytes
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 13]] = 4, 5
_CLASS[ord(".")], _CLASS[ord(",")] = 6, 7
for _c in "?;:'\"()-":
    _CLASS[ord(_c)] = 8
for _c in "!#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[ord(_c)] = 9
_CLASS[192:], _CLASS[128:192] = 10, 11
_CLASSES = 12

#: Names of the statistics, in order.
STATISTICS = (
    *(f"class_{k}" for k in range(_CLASSES)),
    "log_bytes", "log_words", "word_bytes", "distinct_words", "commonest_word", "same_neighbours", "distinct_pairs", "symbol_ends", "upper_words", "short_words", "long_words", "words_a_line",
)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; an empty or null text has zeros."""
    out = [np.zeros((0, len(STATISTICS)))]
    for first, end, data, offsets in pieces(column):
        n = end - first
        size = np.diff(offsets)
        row = np.repeat(np.arange(n), size)
        kind = _CLASS[data]
        classes = np.bincount(row * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
        start, stop, bounds = word_spans(data, offsets)
        words = word_hashes(data, start, stop)
        count = np.diff(bounds)
        owner = np.repeat(np.arange(n), count)
        length = stop - start
        upper = np.concatenate([[0], np.cumsum(kind == 2)])
        lower = np.concatenate([[0], np.cumsum(kind == 1)])
        shouted = (upper[stop] - upper[start] >= 2) & (lower[stop] == lower[start])
        per = lambda flag: np.bincount(owner, weights=flag, minlength=n)
        distinct, top, pairs, same = (np.zeros(n) for _ in range(4))
        for k in np.flatnonzero(count):
            w = words[bounds[k] : bounds[k + 1]]
            _, c = np.unique(w, return_counts=True)
            distinct[k], top[k] = len(c) / len(w), c.max() / len(w)
            if len(w) > 1:
                same[k] = np.mean(w[1:] == w[:-1])
                pairs[k] = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / (len(w) - 1)
        some = np.maximum(count, 1)
        rest = [
            np.log1p(size), np.log1p(count), per(length) / some, distinct, top, same, pairs,
            per(kind[stop - 1] == 9) / some if len(stop) else np.zeros(n), per(shouted) / some, per(length <= 2) / some, per(length >= 12) / some, np.log1p(count / (classes[:, 5] + 1)),
        ]
        out.append(np.column_stack([classes / np.maximum(size, 1)[:, None], *rest]))
    return np.concatenate(out)


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every row, from the whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = statistics(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), table.shape[1]).cast(pa.list_(pa.float32()))], names=["id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measure, "id long, stats array<float>")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """A fitted classifier; of a fixed size whatever it was trained on."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values (weighted squares): neighbours that fall are pooled."""
    level: list[list[float]] = []
    for v, w in zip(y, weight):
        level.append([v * w, w, 1])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            s, w2, c = level.pop()
            level[-1] = [level[-1][0] + s, level[-1][1] + w2, level[-1][2] + c]
    return np.concatenate([np.full(int(c), s / w) for s, w, c in level]) if level else np.zeros(0)


#: Parts of the normal equations that one task adds up.
FAN_IN = 256


def fit(training: DataFrame, *, features: int = FEATURES, penalty: float = PENALTY, bins: int = BINS, seed: int = 9) -> Model:
    """Fit on all rows of ``training`` (stats, y).

    Each partition sums its moments and its part of the normal equations;
    the parts are summed per matrix row on the executors, ``FAN_IN`` at a time.  The driver solves
    one system of ``features`` + 1 unknowns and pools at most ``bins`` bins,
    so nothing it holds grows with the data.  Without training rows every
    score is 0.5.
    """
    width = len(STATISTICS)
    random = np.random.Generator(np.random.PCG64(seed))
    directions = random.normal(0, 1 / np.sqrt(width), (width, features))
    phases = random.uniform(0, 2 * np.pi, features)
    training = training.select("stats", F.col("y").cast("double").alias("y"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width + 1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "stats")
                total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    sums = np.zeros(2 * width + 1)
    for r in training.mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    n = sums[0]
    if n == 0:
        return Model(np.zeros(width), np.ones(width), directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    mean = sums[1 : width + 1] / n
    scale = np.sqrt(np.maximum(sums[width + 1 :] / n - mean**2, 1e-8))
    empty = Model(mean, scale, directions, phases, np.zeros(features + 1), np.zeros(1), np.zeros(1))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            if batch.num_rows:
                z = empty.features(_matrix(batch, "stats"))
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ batch.column(1).to_numpy()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), part)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part", "row"])

    def add(key, table):
        column = table.column("row").combine_chunks()
        return pa.table({"i": table.column("i")[:1], "part": table.column("part")[:1], "row": pa.array([column.flatten().to_numpy().reshape(len(column), -1).sum(0)], pa.list_(pa.float64()))})

    kind = "i long, part long, row array<double>"
    added = training.mapInArrow(equations, kind)
    parts = training.rdd.getNumPartitions()
    while parts > FAN_IN:  # no task adds up more rows than these
        parts = -(-parts // FAN_IN)
        added = added.withColumn("part", F.col("part") % parts).groupBy("i", "part").applyInArrow(add, kind)
    whole = np.zeros((features + 1, features + 2))
    for r in added.groupBy("i").applyInArrow(add, kind).collect():
        whole[r["i"]] = r["row"]
    ridge = penalty * n * np.eye(features + 1)
    ridge[-1, -1] = 0  # the constant isn't shrunk
    weights = np.linalg.solve(whole[:, :-1] + ridge, whole[:, -1])
    fitted = Model(mean, scale, directions, phases, weights, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bins, 3))
        for batch in batches:
            if batch.num_rows:
                raw, y = fitted.raw(_matrix(batch, "stats")), batch.column(1).to_numpy()
                at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
                total += np.column_stack([np.bincount(at, minlength=bins), np.bincount(at, weights=raw, minlength=bins), np.bincount(at, weights=y, minlength=bins)])
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(3))], names=["bin", "n", "raw", "y"])

    found = training.mapInArrow(binned, "bin long, n double, raw double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.sum("y").alias("y")).orderBy("bin").collect()
    weight = np.array([r["n"] for r in found])
    knots = np.array([r["raw"] for r in found]) / weight
    values = isotonic(np.array([r["y"] for r in found]) / weight, weight)
    order = np.argsort(knots, kind="stable")
    return Model(mean, scale, directions, phases, weights, knots[order], values)


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the fold that no model is fitted on."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == 0, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stats, y) of the labelled rows outside the held-out fold; several labels of an id are averaged, null ones left out."""
    y = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    return stats.join(y, "id").select("stats", "y")


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **options) -> DataFrame:
    """Score every whole text for quality.

    Only statistics of the text enter a score.  The texts are read once: their
    statistics (a few dozen numbers each) are written, joined with the labels
    for fitting and scored by a broadcast-free closure over the fixed-size
    model.

    Returns per row: ``id_col``, ``held_out``, ``score`` (0 to 1), ``predicted``
    (1 from ``threshold`` on).  Null and empty texts are scored by their
    (zero) statistics, a null id is not held out, rows that repeat an id are
    scored one by one, and without usable labels every score is 0.5.
    """
    stats = written(document_statistics(docs, id_col=id_col, text_col=text_col), "stats")
    model = fit(written(training_rows(stats, labels, id_col=id_col, label_col=label_col), "training"), **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch, "stats")) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["id", "score"])

    scored = stats.mapInArrow(apply, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; no row is moved."""
    stats = document_statistics(docs, id_col=id_col, text_col=text_col)
    model = fit(written(training_rows(stats, labels, id_col=id_col, label_col=label_col), "training"), **options)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(statistics(batch.column(at))) >= threshold if batch.num_rows else np.zeros(0, bool)
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_in_arrow(docs, keep, docs.schema)
