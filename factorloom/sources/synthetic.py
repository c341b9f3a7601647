"""Synthetic tasks of known formulas: seeded data with roles, and clean points to compare formulas on."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.sources.files import write_json

# Names that stand for something else in algebra systems.
RESERVED = ("S", "N", "O", "E", "I", "Q", "beta", "gamma", "zeta", "Order")


@dataclass
class Task:
    """Rows with roles, noise-free points, and what the data was made from."""

    task_id: str
    expression: str
    names: list[str]
    data: pd.DataFrame
    points: pd.DataFrame
    meta: dict[str, Any] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.data)


def safe_variables(variables: list[str], expression: str) -> tuple[dict[str, str], str]:
    """Reserved names become var_<name>, in the formula too."""
    new = {v: f"var_{v}" if v in RESERVED else v for v in variables}
    return new, formula.rename(expression, new)


def make_task(task_id: str, expression: str, variables: list[dict[str, Any]] | int, rows: tuple[int, int, int] = (300, 150, 300), points: int = 300, irrelevant: int = 5, noise: float = 0.0, seed: int = 0) -> Task:
    """A task with train, validation and test rows, columns z1.. that don't matter in [1, 3], and relative noise.

    variables are {name, low, high}, or a number of v1..vk in [1, 3]. Rows without a finite value are drawn anew.
    """
    if isinstance(variables, int):
        variables = [{"name": f"v{i + 1}", "low": 1.0, "high": 3.0} for i in range(variables)]
    new, text = safe_variables([v["name"] for v in variables], expression)
    names = [new[v["name"]] for v in variables]
    rng = np.random.default_rng(seed)

    def draw(n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        columns, y, left = {m: np.empty(0) for m in names}, np.empty(0), n
        for _ in range(100):
            made = {new[v["name"]]: rng.uniform(float(v.get("low", 1.0)), float(v.get("high", 3.0)), left) for v in variables}
            value = formula.evaluate(text, made, left)
            fine = np.isfinite(value)
            columns = {m: np.concatenate([columns[m], made[m][fine]]) for m in names}
            y = np.concatenate([y, value[fine]])
            left = n - len(y)
            if not left:
                return columns, y
        raise ValueError(f"{task_id}: too few finite values")

    total = sum(rows)
    x, y = draw(total)
    clean = y.copy()
    if noise:
        y = y + rng.normal(size=total) * noise * (y.std() or 1.0)
    data = pd.DataFrame(x)
    for i in range(irrelevant):
        data[f"z{i + 1}"] = rng.uniform(1.0, 3.0, total)
    data.insert(0, "sample_id", [f"{task_id}_{i:06d}" for i in range(total)])
    data["target"], data["role"] = y, np.repeat(["train", "validation", "test"], rows)
    px, py = draw(points)
    cloud = pd.DataFrame(px)
    cloud["target"] = py
    return Task(task_id, text, names, data, cloud, {"seed": seed, "noise": noise, "rows": list(rows), "clean_std": float(clean.std()), "original": expression})


def write_task(spark: SparkSession, task: Task, path: str | Path) -> None:
    path = Path(path)
    task.frame(spark).write.mode("overwrite").parquet(str(path / "data.parquet"))
    spark.createDataFrame(task.points).write.mode("overwrite").parquet(str(path / "points.parquet"))
    write_json({"task_id": task.task_id, "expression": task.expression, "variables": task.names, **task.meta}, path / "meta.json")


def scalable_task(spark: SparkSession, expression: str, variables: list[dict[str, Any]], rows: int, noise: float = 0.0, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Rows of any number, made where they are needed: values are hashes of seed, column and row number."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)

    def uniform(tag: str):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "id"), F.lit(1 << 48)) + 0.5) / float(1 << 48)

    out = base
    for v in variables:
        low, high = float(v.get("low", 1.0)), float(v.get("high", 3.0))
        out = out.withColumn(v["name"], F.lit(low) + uniform(v["name"]) * (high - low))
    y = formula.compile_column(expression, {v["name"]: F.col(v["name"]) for v in variables})
    normal = F.sqrt(-2 * F.ln(uniform("__a"))) * F.cos(2 * np.pi * uniform("__b"))
    return out.withColumn("target", y * (1 + F.lit(noise) * normal))
