"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of a text are standardised, a seeded random map approximates a Gaussian kernel, each
partition sums its share of the normal equations, and the driver solves one small system. Scores of the
half of the learning rows that a fit hasn't seen are calibrated by pool-adjacent-violators.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, id_and_text, rows_to_batch, text_blocks

FEATURES = ("log_bytes", "log_words", "word_length", "lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "bar", "mark", "quote", "other", "beyond_ascii", "distinct_words", "same_as_before", "distinct_lines", "line_words", "longest_word", "distinct_pairs")
#: Random features; the normal equations have DIMENSIONS + features + 1 unknowns, whatever the corpus.
DIMENSIONS = 192
RIDGE = 1e-3
SEED = 20240229
#: Sums of the normal equations that reach the driver, 0.6 MB each; every task has its own, and these add them up.
FIT_SUMS = 32
BINS = 2000
LOW, HIGH = -1.0, 2.0


def _classes() -> np.ndarray:
    """For each byte the ratio feature it counts for."""
    names = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "bar", "mark", "quote", "other", "beyond_ascii")
    sets = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "newline": b"\n\r", "stop": b".", "comma": b",;:", "bang": b"!?", "bar": b"|", "mark": b"#$%&*@^~=+_", "quote": b"\"'()[]{}<>-/\\`"}
    table = np.zeros((256, len(names)))
    for b in range(256):
        name = "beyond_ascii" if b > 127 else next((n for n, s in sets.items() if b in s), "other")
        table[b, names.index(name)] = 1
    return table


_RATIOS = _classes()


def statistics(text: bytes) -> list[float]:
    """The features of one whole text; all are 0 for the empty text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    ratios = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _RATIOS / n).tolist()
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(n / w), *ratios,
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, len(set(lines)) / max(1, len(lines)), math.log1p(w / max(1, len(lines))), math.log1p(max(map(len, words), default=0)),
        pairs / max(1, len(words) - 1),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row's text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            yield rows_to_batch([(i, statistics(t)) for i, t in zip(ids, texts, strict=True)], schema)

    return id_and_text(docs, id_col, text_col, binary=True).mapInArrow(run, "doc_id long, x array<double>")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text: remainder 0 of 5 is held out, the quotient's parity halves the rest."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id) % 5 == 0


@dataclass
class Model:
    """A fitted scorer; None weights: there was nothing to learn from, and all scores are 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return expand(x, self.mean, self.scale) @ weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x, self.weights), self.knots, self.values), 0.0, 1.0)

    def column(self, text: Column) -> Column:
        """The score of a text column, for use in projections and filters."""
        model = self

        @F.pandas_udf("double")
        def scored(texts):
            import pandas as pd

            return pd.Series(model.score(np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))))

        return scored(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """1, the standardised statistics and their random Fourier features; the map is fixed by SEED."""
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    turn = rng.normal(size=(x.shape[1], DIMENSIONS)) / math.sqrt(x.shape[1])
    phase = rng.uniform(0, 2 * math.pi, DIMENSIONS)
    return np.hstack([np.ones((len(z), 1)), z, math.sqrt(2 / DIMENSIONS) * np.cos(z @ turn + phase)])


def _partition_sums(rows: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over all rows of fn(x, y, half), a vector of `size`: one for each task, then FIT_SUMS, then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), float)
                total += fn(x, batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    parts = rows.select("x", "y", "half").mapInArrow(run, "part binary").repartition(FIT_SUMS).mapInArrow(added, "part binary").collect()
    return sum((np.frombuffer(bytes(p["part"])) for p in parts), np.zeros(size))


def pool_adjacent(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The nondecreasing fit of positive / count with weights count."""
    blocks: list[list[float]] = []
    for p, c in zip(positive, count, strict=True):
        blocks.append([p, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / c) for p, c, k in blocks]) if blocks else np.empty(0)


def fit(table: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from all rows of table(doc_id, x) that have a label and aren't held out.

    Rows with a null id or label teach nothing; an id with several labels counts once for each.
    """
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y")).where("doc_id is not null and y is not null")
    rows = table.join(marks.where(~held_out(F.col("doc_id"))), "doc_id").withColumn("half", (F.floor(fold_of(F.col("doc_id")) / 5) % 2).cast("int")).select("x", "y", "half")
    rows = scratch.write(rows, "learn")
    d = len(FEATURES)
    moments = _partition_sums(rows, lambda x, y, h: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n = moments[0]
    if not n:
        return Model(np.zeros(d), np.ones(d), None, np.zeros(1), np.zeros(1))
    mean = moments[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    m = 1 + d + DIMENSIONS

    def equations(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        out = np.zeros((2, m, m + 1))
        for h in (0, 1):
            z = expand(x[half == h], mean, scale)
            out[h, :, :m], out[h, :, m] = z.T @ z, z.T @ y[half == h]
        return out.ravel()

    halves = _partition_sums(rows, equations, 2 * m * (m + 1)).reshape(2, m, m + 1)

    def solve(system: np.ndarray) -> np.ndarray:
        weight = max(system[0, 0], 1.0)
        return np.linalg.solve(system[:, :m] + RIDGE * weight * np.eye(m), system[:, m])

    each = [solve(halves[0]), solve(halves[1])]
    model = Model(mean, scale, solve(halves.sum(0)), np.zeros(1), np.zeros(1))

    def binned(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        raw = np.where(half == 0, model.raw(x, each[1]), model.raw(x, each[0]))
        at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    positive, count = _partition_sums(rows, binned, 2 * BINS).reshape(2, BINS)
    used = np.flatnonzero(count)
    model.knots = LOW + (used + 0.5) * (HIGH - LOW) / BINS
    model.values = pool_adjacent(positive[used], count[used])
    scratch.drop(rows)
    return model


def scores(table: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of table(doc_id, x)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], schema=schema)

    return table.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    The inputs of a score are the text's statistics alone. Null and empty texts get the score of all-zero
    statistics; repeated rows get equal scores; an empty table gives no rows; without labels all scores
    are 0.5; a null doc_id isn't held out; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.write(features(docs, id_col, text_col), "features")
    out = scores(table, fit(table, labels, scratch))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold."""
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.write(features(docs, id_col, text_col), "features")
    model = fit(table, labels, scratch)
    scratch.drop(table)
    return docs.where(model.column(docs[text_col]) >= threshold)
