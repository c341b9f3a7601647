"""Whole experiments: task runs under several conditions, baselines, comparison, and the task sampler."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.operators import mine, select, similarity, stats
from factorloom.operators.lineage import Card, Graph
from factorloom.plans import search
from factorloom.sources.synthetic import Task

CONDITIONS = ("raw", "raw_mined", "interpretability_first")
FINITE_SHARE = 0.98


def verify(df: DataFrame, text: str, features: dict[str, Column], y: Column, by_role: bool = False) -> DataFrame:
    """R2, RMSE and n of a formula on a table, by role if asked."""
    frame = df.withColumn("__p", formula.compile_column(text, features))
    return stats.regression_metrics(frame, y, F.col("__p"), ["role"] if by_role else None)


def best_of_hall(rows: list[dict[str, Any]]) -> dict[str, Any] | None:
    """The row of a hall of fame with the least loss, else the highest score, else the last."""
    for key, sign in (("loss", 1), ("score", -1)):
        fine = [r for r in rows if isinstance(r.get(key), (int, float)) and math.isfinite(r[key])]
        if fine:
            return min(fine, key=lambda r: sign * r[key])
    return rows[-1] if rows else None


def finite_columns(df: DataFrame, columns: dict[str, Column], least: float = FINITE_SHARE) -> dict[str, Column]:
    """Columns with more than `least` of their values finite."""
    row = df.agg(*(F.avg(c.isNotNull().cast("double")).alias(f"s{i}") for i, c in enumerate(columns.values()))).first()
    return {n: c for i, (n, c) in enumerate(columns.items()) if (row[f"s{i}"] or 0.0) > least}


def run_task(spark: SparkSession, task: Task, engine: search.Search = search.surrogate, domain: set[str] | None = None, factor_top_k: int = 12) -> dict[str, Any]:
    """Search with raw and with mined columns, choose by accuracy and by interpretability; test rows are read once, at the end.

    Nodes are counted on expanded formulas, so a mined column doesn't hide its size.
    """
    df = task.frame(spark).cache()
    y = F.col("target")
    train, validation, test = (F.col("role") == r for r in ("train", "validation", "test"))
    raw = {c: F.col(c) for c in task.data.columns if c not in ("sample_id", "target", "role")}
    texts = mine.generic_factors(task.names)
    moments = stats.formula_moments(df, texts, raw, y, F.col("sample_id"), train)
    order = moments[(moments["valid"] > FINITE_SHARE * moments["rows"]) & (moments["std"] > 1e-12)].sort_values(["score", "formula"], ascending=[False, True]).head(factor_top_k)
    cards = [Card(f"f{i}", f"f{i}", t) for i, t in enumerate(order["formula"])]
    graph = Graph(cards)
    mined = raw | {c.name: formula.compile_column(c.expression, raw) for c in cards}
    archives = {}
    for condition, columns in (("raw", raw), ("raw_mined", mined)):
        records = search.score_archive(df, engine(df, columns, y, "sample_id", train), columns, y, validation, size=lambda t: graph.complexity(t)["nodes"])
        archives[condition] = [r | {"candidate_id": f"{condition}_{i:03d}", "expression": r["equation"], "uses_domain_factor": bool(set(formula.variables(r["equation"])) & (domain or set()))} for i, r in enumerate(records)]
    picked = {c: select.best_accuracy(archives[c]) for c in ("raw", "raw_mined")}
    chosen = select.interpretability_first(select.choices(archives["raw"] + archives["raw_mined"]), graph)["selected"]
    picked["interpretability_first"] = next((r for c in archives.values() for r in c if chosen and r["candidate_id"] == chosen.candidate_id), None)
    results = []
    for condition, r in picked.items():
        if r is None:
            results.append({"task_id": task.task_id, "method": condition, "error": "no candidate"})
            continue
        expanded = graph.expand(r["expression"])
        got = verify(df.where(test), r["expression"], mined, y).first()
        like = similarity.report(expanded, task.expression)
        results.append({"task_id": task.task_id, "method": condition, "expression": expanded, "r2_val": r["r2_val"], "r2_test": got["r2"], "nodes": r["complexity"], "similarity": like["overall"], "equivalent": like["algebraic_equivalent"], "seed": task.meta.get("seed", 0)})
    df.unpersist()
    return {"task_id": task.task_id, "results": results, "archives": archives}


def run_all(spark: SparkSession, tasks: list[Task], out_path: str | Path, engine: search.Search = search.surrogate) -> list[dict[str, Any]]:
    """Every task that the log doesn't have yet; each result is appended as soon as it is there."""
    log = Path(out_path)
    log.parent.mkdir(parents=True, exist_ok=True)
    rows = [json.loads(x) for x in log.read_text().splitlines() if x.strip()] if log.exists() else []
    done = {(r["task_id"], r.get("seed", 0)) for r in rows}
    for task in tasks:
        if (task.task_id, task.meta.get("seed", 0)) in done:
            continue
        for r in run_task(spark, task, engine)["results"]:
            r.setdefault("seed", task.meta.get("seed", 0))
            rows.append(r)
            with log.open("a") as f:
                f.write(json.dumps(r, default=str) + "\n")
    return rows


def ablation(df: DataFrame, raw: dict[str, Column], mined: dict[str, Column], selected: list[str], y: Column, key: str, train: Column, validation: Column, engine: search.Search = search.surrogate) -> dict[str, Any]:
    """Four conditions: raw columns, with all mined, with the selected ones, and the simplest within the band of those."""
    pools = {"raw": raw, "raw_mined": raw | mined, "raw_selected": raw | {n: c for n, c in mined.items() if n in selected}}
    out: dict[str, Any] = {}
    for name, columns in pools.items():
        records = search.score_archive(df, engine(df, columns, y, key, train), columns, y, validation)
        out[name] = {"columns": list(columns), "best": select.best_accuracy(records), "records": records}
    fine = [r for r in out["raw_selected"]["records"] if math.isfinite(r["r2_val"])]
    top = max((r["r2_val"] for r in fine), default=math.nan)
    near = [r for r in fine if r["r2_val"] >= top - select.BAND]
    out["interpretability_first"] = {"columns": out["raw_selected"]["columns"], "best": min(near, key=lambda r: (r["complexity"], r["equation"]), default=None)}
    return out


def pool_difference(pools: dict[str, list[str]]) -> dict[str, dict[str, list[str]]]:
    """For each pair of pools the columns only one of them has."""
    names = list(pools)
    return {f"{a}|{b}": {a: sorted(set(pools[a]) - set(pools[b])), b: sorted(set(pools[b]) - set(pools[a]))} for i, a in enumerate(names) for b in names[i + 1 :]}


def run_baselines(spark: SparkSession, tasks: list[Task], call: Callable[[str], str], out_path: str | Path, iterations: int = 10) -> list[dict[str, Any]]:
    """Direct and skeleton answers of a model for each task, resumed from the log."""
    log = Path(out_path)
    log.parent.mkdir(parents=True, exist_ok=True)
    rows = [json.loads(x) for x in log.read_text().splitlines() if x.strip()] if log.exists() else []
    done = {(r["task_id"], r["method"], r.get("seed", 0)) for r in rows}
    for task in tasks:
        df, y = task.frame(spark), F.col("target")
        columns = {n: F.col(n) for n in task.names}
        local = task.data[task.data["role"] == "train"]
        summary = search.data_summary(df, columns, F.col("role") == "train")
        for method in ("direct", "skeleton"):
            key = (task.task_id, method, task.meta.get("seed", 0))
            if key in done:
                continue
            if method == "direct":
                text = search.direct_formula(call, task.names, summary)
            else:
                found = search.skeleton_search(call, task.names, summary, {n: local[n].to_numpy() for n in task.names}, local["target"].to_numpy(), iterations)
                text = found[0]["expression"] if found and found[0]["expression"] else None
            row: dict[str, Any] = {"task_id": key[0], "method": method, "seed": key[2], "expression": text}
            try:
                got = {r["role"]: r for r in verify(df, text, columns, y, by_role=True).collect()} if text else {}
            except formula.FormulaError:
                got = {}
            row |= {"r2_val": got["validation"]["r2"] if "validation" in got else None, "r2_test": got["test"]["r2"] if "test" in got else None}
            if text:
                like = similarity.report(text, task.expression)
                row |= {"nodes": formula.complexity(text)["nodes"], "similarity": like["overall"], "equivalent": like["algebraic_equivalent"]}
            rows.append(row)
            with log.open("a") as f:
                f.write(json.dumps(row) + "\n")
    return rows


def compare(results: DataFrame) -> DataFrame:
    """Runs, mean and median of finite measures, and the share of equivalent formulas of each method."""
    def finite(c: str) -> Column:
        return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))

    return results.groupBy("method").agg(F.count(F.lit(1)).alias("n"), *(f(finite(c)).alias(f"{name}_{c}") for c in ("r2_test", "similarity", "nodes") for f, name in ((F.avg, "mean"), (F.median, "median"))), F.avg(F.col("equivalent").cast("double")).alias("equivalence_rate"))


def one_per_task(results: DataFrame) -> DataFrame:
    """For each task and method the run with the least seed, for blind rating."""
    order = Window.partitionBy("task_id", "method").orderBy("seed", "expression")
    return results.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def rating_candidates(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Items for blind rating: the chosen run of each task and method with what the catalogue says of the task.

    results(task_id, method, seed, expression, expanded_expression, r2_test), of which those without an expression
    don't count; catalogue(task_id, name, variables: array of (name, low, high, meaning)). The formula is the
    expanded one, if there is one. Runs of tasks that the catalogue lacks have no item.
    """
    runs = one_per_task(results.where(F.coalesce("expression", F.lit("")) != ""))
    variables = F.transform("variables", lambda v: F.struct(v["name"].alias("name"), F.coalesce(v["meaning"], F.lit("")).alias("definition"), F.lit("-").alias("unit"), F.concat(F.lit("["), v["low"].cast("string"), F.lit(","), v["high"].cast("string"), F.lit("]")).alias("allowed_range")))
    return runs.join(catalogue.select("task_id", "name", "variables"), "task_id").select(
        F.when(F.coalesce("expanded_expression", F.lit("")) != "", F.col("expanded_expression")).otherwise(F.col("expression")).alias("formula"), variables.alias("variables"),
        F.concat(F.lit("Find the relation behind the target y. Domain: "), F.coalesce("name", F.lit("")), F.lit(".")).alias("task_context"), F.concat(F.lit("task_"), F.substring(F.col("task_id").cast("string"), 1, 3)).alias("dataset_label"),
        "method", "seed", "r2_test", F.col("task_id").cast("string").alias("dataset"), F.lit("y").alias("target"),
    )


def sample_tasks(pool: list[dict[str, Any]], size: int = 20, seed: int = 0, least_nodes: int = 3, required: tuple[str, ...] = ()) -> list[dict[str, Any]]:
    """A stratified, reproducible sample of tasks.

    Tasks with enough nodes are put into bins by variables and size; each bin gives its rounded share. Missing
    operators are then covered, the sample topped up, and cut by id.
    """
    fit = sorted((t for t in pool if t.get("node_count", 0) >= least_nodes), key=lambda t: t["task_id"])
    if len(fit) <= size:
        return fit
    rng = random.Random(seed)
    bins: dict[tuple[int, int], list[dict[str, Any]]] = defaultdict(list)
    for t in fit:
        bins[min(int(t.get("n_variables", 1)), 5), min(int(t["node_count"]) // 6, 4)].append(t)
    chosen: list[dict[str, Any]] = []
    for key in sorted(bins):
        members = list(bins[key])
        rng.shuffle(members)
        chosen += members[: round(size * len(members) / len(fit))]
    have = {t["task_id"] for t in chosen}
    covered = Counter(o for t in chosen for o in t.get("operators", []))
    for operator in required or sorted({o for t in fit for o in t.get("operators", [])}):
        if not covered[operator]:
            extra = next((t for t in fit if operator in t.get("operators", []) and t["task_id"] not in have), None)
            if extra:
                chosen.insert(0, extra)
                have.add(extra["task_id"])
                covered.update(extra.get("operators", []))
    rest = [t for t in fit if t["task_id"] not in have]
    rng.shuffle(rest)
    chosen += rest[: max(0, size - len(chosen))]
    return sorted(chosen, key=lambda t: t["task_id"])[:size]
