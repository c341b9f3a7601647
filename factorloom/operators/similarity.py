"""Likeness of a predicted formula to a true one: numbers, variables, operators and trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions import formula

# The weights of numbers, variables, operators and trees in the overall score.
WEIGHTS = {"numeric": 0.5, "variables": 0.2, "operators": 0.2, "tree": 0.1}


def sample_points(names: list[str], rows: int = 400, seed: int = 0, low: float = -2.0, high: float = 2.0, ranges: dict[str, tuple[float, float]] | None = None) -> dict[str, np.ndarray]:
    """Uniform points, drawn in the order of names."""
    rng = np.random.default_rng(seed)
    return {n: rng.uniform(*(ranges or {}).get(n, (low, high)), rows) for n in names}


def _values(text: str, points: dict[str, np.ndarray]) -> np.ndarray:
    rows = len(next(iter(points.values()))) if points else 1
    try:
        return formula.evaluate(text, points, rows)
    except formula.FormulaError:
        return np.full(rows, np.nan)


def numeric_similarity(pred: np.ndarray, truth: np.ndarray) -> float:
    """1 / (1 + RMSE over the truth's spread, or its mean size, or 1); 0 for under 3 finite pairs."""
    both = np.isfinite(pred) & np.isfinite(truth)
    if both.sum() < 3:
        return 0.0
    p, t = pred[both], truth[both]
    scale = float(t.std())
    if scale <= 1e-12:
        scale = float(np.abs(t).mean())
    if scale <= 1e-12:
        scale = 1.0
    return 1.0 / (1.0 + float(np.sqrt(np.mean((p - t) ** 2))) / scale)


def numerically_equal(pred: np.ndarray, truth: np.ndarray, tolerance: float = 1e-6) -> bool:
    both = np.isfinite(pred) & np.isfinite(truth)
    return bool(both.sum() >= 3 and np.allclose(pred[both], truth[both], rtol=tolerance, atol=tolerance))


def algebraically_equal(pred: str, truth: str) -> bool:
    """Whether the canonical form of the difference is 0; what can't be read isn't equal."""
    try:
        a, b = formula.parse(pred), formula.parse(truth)
        return formula.canonical(a) == formula.canonical(b) or formula.canonical(("bin", "-", a, b)) == ("num", 0)
    except (formula.FormulaError, RecursionError, OverflowError, ZeroDivisionError):
        return False


def set_f1(a: set, b: set) -> float:
    if not a and not b:
        return 1.0
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def tree_similarity(pred: str, truth: str) -> float:
    if algebraically_equal(pred, truth):
        return 1.0
    a, b = formula.complexity(pred)["nodes"], formula.complexity(truth)["nodes"]
    return 1.0 - abs(a - b) / max(a, b, 1)


def report(pred: str, truth: str, rows: int = 400, seed: int = 0, ranges: dict[str, tuple[float, float]] | None = None) -> dict[str, Any]:
    """All measures and their weighted sum, held within 0 and 1."""
    names = list(dict.fromkeys(formula.variables(truth) + formula.variables(pred)))
    points = sample_points(names, rows, seed, ranges=ranges) or {"__none": np.zeros(3)}
    p, t = _values(pred, points), _values(truth, points)

    def ops(text: str) -> set[str]:
        try:
            return formula.operators(text)
        except formula.FormulaError:
            return set()

    variables = set_f1(set(formula.variables(pred)), set(formula.variables(truth)))
    parts = {"numeric": numeric_similarity(p, t), "variables": variables, "operators": set_f1(ops(pred), ops(truth)), "tree": tree_similarity(pred, truth)}
    parts = {k: min(1.0, max(0.0, v if math.isfinite(v) else 0.0)) for k, v in parts.items()}
    return {
        "overall": min(1.0, max(0.0, sum(WEIGHTS[k] * v for k, v in parts.items()))), "numeric_similarity": parts["numeric"], "variable_f1": variables, "support_f1": variables,
        "operator_f1": parts["operators"], "tree_similarity": parts["tree"], "numeric_equivalent": numerically_equal(p, t), "algebraic_equivalent": algebraically_equal(pred, truth),
    }


def similarity_table(pairs: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """pairs with all measures; each partition works on its own rows, for any number of pairs."""
    fields = ("overall", "numeric_similarity", "variable_f1", "support_f1", "operator_f1", "tree_similarity")
    flags = ("numeric_equivalent", "algebraic_equivalent")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([report(str(a), str(b)) for a, b in zip(batch[pred], batch[truth], strict=True)], columns=[*fields, *flags])
            yield pd.concat([batch.reset_index(drop=True), made], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + [f"{f} double" for f in fields] + [f"{f} boolean" for f in flags])
    return pairs.mapInPandas(run, schema)


def spark_numeric_similarity(df: DataFrame, pred: str, truth: str, columns: dict) -> DataFrame:
    """One row (n, similarity) over the rows of a table instead of sampled points."""
    p, t = formula.compile_column(pred, columns), formula.compile_column(truth, columns)
    both = p.isNotNull() & t.isNotNull()
    got = df.agg(F.count(F.when(both, 1)).alias("n"), F.sqrt(F.avg(F.when(both, (p - t) * (p - t)))).alias("rmse"), F.stddev_pop(F.when(both, t)).alias("sd"), F.avg(F.when(both, F.abs(t))).alias("size"))
    scale = F.when(F.col("sd") > 1e-12, F.col("sd")).when(F.col("size") > 1e-12, F.col("size")).otherwise(F.lit(1.0))
    return got.select("n", F.when(F.col("n") >= 3, 1 / (1 + F.col("rmse") / scale)).otherwise(F.lit(0.0)).alias("similarity"))
