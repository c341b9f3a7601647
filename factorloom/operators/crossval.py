"""Cross-validation of whole mining runs: honest (selection inside each fold) against leaky (selection once)."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.operators import mine, splits, stats


def fold_score(df: DataFrame, columns: list[Column], y: Column, train: Column, test: Column) -> dict[str, Any]:
    """Least squares on the train rows, R2 and RMSE on the test rows; under two test rows NaN."""
    intercept, beta = stats.fit_linear(df, columns, y, train) if columns else (df.where(train).agg(F.avg(y)).first()[0] or 0.0, [])
    got = stats.regression_metrics(df.where(test), y, stats.linear(columns, intercept, beta), least=2).first()
    nan = float("nan")
    return {"n": got["n"], "r2": got["r2"] if got["r2"] is not None else nan, "rmse": got["rmse"] if got["rmse"] is not None else nan, "n_selected": len(columns)}


def summary(scores: list[dict[str, Any]]) -> dict[str, Any]:
    """Mean and population spread of finite fold scores."""
    out: dict[str, Any] = {"folds": len(scores)}
    for key in ("r2", "rmse"):
        fine = [s[key] for s in scores if math.isfinite(s[key])]
        mean = sum(fine) / len(fine) if fine else float("nan")
        out |= {f"{key}_mean": mean, f"{key}_std": math.sqrt(sum((x - mean) ** 2 for x in fine) / len(fine)) if fine else float("nan"), f"{key}_count": len(fine)}
    return out


def evaluate(df: DataFrame, features: dict[str, Column], y: Column, key: str, options: mine.Options, k: int = 5, seed: int = 0, raw_keep: int = 20, factor_keep: int = 20, model: str = "linear", leaky: bool = True, threads: int = 4) -> dict[str, Any]:
    """Honest and leaky scores and their gap (leaky less honest). Folds are by hash of the key and run side by side."""
    if model != "linear":
        raise NotImplementedError("per-fold search with an external engine isn't available; use model='linear'")
    folded = df.join(splits.folds(df, key, k, seed), key).cache()
    numbers = sorted(r["fold"] for r in folded.select("fold").distinct().collect())
    row_key = F.col(key)

    def specs(where: Column | None) -> list[dict[str, Any]]:
        return mine.select_specs(folded, features, y, row_key, options, where, raw_keep, factor_keep)

    def one(n: int, fixed: list[dict[str, Any]] | None) -> dict[str, Any]:
        train, test = F.col("fold") != n, F.col("fold") == n
        chosen = fixed if fixed is not None else specs(train)
        return fold_score(folded, mine.design_columns(chosen, features), y, train, test) | {"fold": n}

    with ThreadPoolExecutor(threads) as pool:
        honest = list(pool.map(lambda n: one(n, None), numbers))
        report: dict[str, Any] = {"honest": {"folds": honest, "summary": summary(honest), "mean_selected": sum(h["n_selected"] for h in honest) / max(1, len(honest))}}
        if leaky:
            fixed = specs(None)
            loose = list(pool.map(lambda n: one(n, fixed), numbers))
            report["leaky"] = {"folds": loose, "summary": summary(loose), "selected": len(fixed)}
            report["gap"] = report["leaky"]["summary"]["r2_mean"] - report["honest"]["summary"]["r2_mean"]
    folded.unpersist()
    return report
