"""Files in and out: CSV, JSON, JSON lines, YAML, feature directories, and results of earlier runs."""

from __future__ import annotations

import json
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.functions.numeric import finite_or_zero, missing_flag, nullify


#: Lines of files without a key that are read on the driver.
MOST_LINES = 2_000_000


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all text; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def write_json(data: Any, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str))


def read_yaml(path: str | Path) -> Any:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(str(path))


def write_features(frame: DataFrame, manifest: dict[str, Any], path: str | Path, csv: bool = False) -> None:
    """A keyed feature table as Parquet, its manifest beside it, and CSV on request."""
    path = Path(path)
    frame.write.mode("overwrite").parquet(str(path / "features.parquet"))
    if csv:
        frame.write.mode("overwrite").option("header", True).csv(str(path / "features_csv"))
    write_json(manifest, path / "manifest.json")


def read_features(spark: SparkSession, path: str | Path) -> tuple[DataFrame, dict[str, Any]]:
    """The Parquet table of a feature directory; else its hybrid_features.csv, or features.csv, with y.csv and row_roles.csv.

    CSV files that all have a row_id are read and joined by Spark. Older ones have no key: their lines belong together
    by their places, which become row ids; such files are read here, up to MOST_LINES. y's column is 'target' or the first.
    """
    path = Path(path)
    manifest = read_json(path / "manifest.json") if (path / "manifest.json").exists() else {}
    if (path / "features.parquet").exists():
        return spark.read.parquet(str(path / "features.parquet")), manifest
    name = "hybrid_features.csv" if (path / "hybrid_features.csv").exists() else "features.csv"
    there = [n for n in (name, "y.csv", "row_roles.csv") if (path / n).exists()]
    heads = {n: read_csv(spark, str(path / n)) for n in there}
    if all("row_id" in df.columns for df in heads.values()):
        out = heads[name].select("row_id", *(F.col(f"`{c}`").try_cast("double").alias(c) for c in heads[name].columns if c not in ("row_id", "target", "role")))
        for n, new in (("y.csv", "target"), ("row_roles.csv", "role")):
            if n in heads:
                value = F.col(new if new in heads[n].columns else next(c for c in heads[n].columns if c != "row_id"))
                out = out.join(heads[n].select("row_id", (value.try_cast("double") if new == "target" else value).alias(new)), "row_id", "left")
        return out, manifest
    import pandas as pd

    parts = {n: pd.read_csv(path / n, encoding="utf-8-sig", nrows=MOST_LINES + 1) for n in there}
    x, y = parts[name], parts["y.csv"]
    if len(x) > MOST_LINES:
        raise ValueError(f"over {MOST_LINES} lines without a row_id: give the files a key")
    if len(x) != len(y):
        raise ValueError("features and target have unlike lengths")
    x.insert(0, "row_id", [str(i) for i in range(len(x))])
    x["target"] = y["target"] if "target" in y.columns else y.iloc[:, 0]
    if "row_roles.csv" in parts:
        x["role"] = parts["row_roles.csv"].iloc[:, 0]
    return spark.createDataFrame(x), manifest


def remove(path: str | Path) -> None:
    shutil.rmtree(path, ignore_errors=True)


# --- earlier runs ---


def first_of(row: dict[str, Any], *keys: str) -> Any:
    return next((row[k] for k in keys if row.get(k) not in (None, "")), None)


def equation_of(document: dict[str, Any]) -> str | None:
    """The equation of a result document under whichever key has it."""
    return first_of(document, "best_equation", "expression", "equation")


def best_results(spark: SparkSession, root: str) -> DataFrame:
    """(target, expression, r2, rmse, complexity, status, path) of every best_result.json below root.

    Keys have alternatives; a document without a target takes its directory's name.
    """
    schema = "target string, best_equation string, expression string, equation string, best_r2 double, r2 double, best_rmse double, rmse double, best_complexity double, complexity double, status string"
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "best_result.json").json(root).withColumn("path", F.col("_metadata.file_path"))
    return raw.select(F.coalesce("target", F.element_at(F.split("path", "/"), -2)).alias("target"), F.coalesce("best_equation", "expression", "equation").alias("expression"), F.coalesce("best_r2", "r2").alias("r2"), F.coalesce("best_rmse", "rmse").alias("rmse"), F.coalesce("best_complexity", "complexity").alias("complexity"), "status", "path").where("expression is not null")


def equation_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(target, expression, loss, score, complexity, rank, path) of every model_equations_snapshot.csv below root.

    Column names are taken in any case. Snapshots are small: a file's rows are numbered in file order.
    """
    import pandas as pd

    schema = "target string, expression string, loss double, score double, complexity double, rank int, path string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "model_equations_snapshot.csv").load(root).select("path", "content")

    def run(batches):
        import io

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = pd.read_csv(io.BytesIO(bytes(content)), encoding="utf-8-sig")
                rows.columns = [c.strip().lower() for c in rows.columns]
                if "equation" not in rows.columns:
                    continue
                out = pd.DataFrame({"target": path.split("/")[-2], "expression": rows["equation"].astype(str)}, index=rows.index)
                for c in ("loss", "score", "complexity"):
                    out[c] = pd.to_numeric(rows[c], errors="coerce") if c in rows.columns else float("nan")
                out["rank"], out["path"] = range(len(out)), path
                yield out

    return files.mapInPandas(run, schema).select("target", "expression", *(nullify(F.col(c)).alias(c) for c in ("loss", "score", "complexity")), "rank", "path")


def expression_list(results: DataFrame, top_k: int | None = None) -> DataFrame:
    """Formulas of all runs by target: best R2, then score, loss and complexity, each formula once, the first top_k."""
    order = [F.desc_nulls_last("r2"), F.desc_nulls_last("score"), F.asc_nulls_last("loss"), F.asc_nulls_last("complexity"), F.asc("expression")]
    once = results.withColumn("__n", F.row_number().over(Window.partitionBy("target", "expression").orderBy(*order))).where("__n = 1").drop("__n")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(*order)))
    return ranked.where(F.col("rank") <= top_k) if top_k else ranked


def mine_expressions(spark: SparkSession, root: str, top_k: int | None = None) -> DataFrame:
    """expression_list over all best results and snapshots below root."""
    best = best_results(spark, root).select("target", "expression", "r2", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("loss"), "complexity")
    shots = equation_snapshots(spark, root).select("target", "expression", F.lit(None).cast("double").alias("r2"), "score", "loss", "complexity")
    return expression_list(best.unionByName(shots), top_k)


def sorted_equations(df: DataFrame) -> DataFrame:
    """Equations by score where there are scores, else by loss, else by complexity."""
    has = df.agg(F.count("score").alias("s"), F.count("loss").alias("l")).first()
    order = F.desc_nulls_last("score") if has["s"] else F.asc_nulls_last("loss") if has["l"] else F.asc_nulls_last("complexity")
    return df.orderBy(order, "rank")


def snapshot_equations(path: str | Path) -> list[str]:
    """The equations of one snapshot file: by score if it has one, else by loss, else by complexity."""
    import pandas as pd

    rows = pd.read_csv(path, encoding="utf-8-sig")
    rows.columns = [c.strip().lower() for c in rows.columns]
    for key, up in (("score", False), ("loss", True), ("complexity", True)):
        if key in rows.columns and rows[key].notna().any():
            rows = rows.sort_values(key, ascending=up, kind="stable", na_position="last")
            break
    return rows["equation"].astype(str).tolist() if "equation" in rows.columns else []


def raw_features_from_manifest(df: DataFrame, manifest: dict[str, Any], target: str | None = None) -> DataFrame:
    """Standardised features, indicators and the scaled target of an old manifest's statistics; not finite is 0."""
    s = manifest["statistics"]
    out = []
    for c in s["columns"]:
        x = nullify(F.col(f"`{c}`").try_cast("double"))
        z = (F.coalesce(x, F.lit(float(s["fills"].get(c, 0.0)))) - F.lit(float(s["means"].get(c, 0.0)))) / F.lit(float(s["scales"].get(c, 1.0)) or 1.0)
        out.append(finite_or_zero(z).alias(s["names"][c]))
        if c in s.get("indicators", {}):
            out.append(missing_flag(x).alias(s["indicators"][c]))
    if target and "target_mean" in manifest:
        out.append(((F.col(f"`{target}`").try_cast("double") - manifest["target_mean"]) / (manifest.get("target_scale") or 1.0)).alias("target_z"))
    return df.select(*([F.col("row_id")] if "row_id" in df.columns else []), *out)


def with_best_formula(features: DataFrame, document: dict[str, Any], names: list[str], mean: float = 0.0, scale: float = 1.0, prefix: str = "best") -> DataFrame:
    """features with the predictions of a result's equation, as it is and back in the target's units."""
    text = equation_of(document)
    if not text:
        return features
    z: Column = F.coalesce(formula.compile_column(text, {n: F.col(n) for n in names}), F.lit(0.0))
    return features.withColumn(f"{prefix}_z", z).withColumn(f"{prefix}_raw", F.lit(float(mean)) + F.lit(float(scale)) * z)
