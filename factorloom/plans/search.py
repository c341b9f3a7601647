"""Formula search: a protocol for engines, a deterministic surrogate, a bounded beam search, skeleton fitting."""

from __future__ import annotations

import itertools
import math
import subprocess
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.operators import mine, stats
from factorloom.sources.files import write_json

BAD = 1e6


class Search(Protocol):
    """An engine gets a keyed table and returns equations with loss and complexity."""

    def __call__(self, df: DataFrame, features: dict[str, Column], y: Column, key: str, where: Column | None) -> list[dict[str, Any]]: ...


@dataclass
class SearchOptions:
    """Settings handed on to an engine; those that one doesn't know are recorded all the same."""

    niterations: int = 60
    timeout_in_seconds: int = 120
    maxsize: int = 20
    populations: int = 15
    population_size: int = 33
    parsimony: float = 0.0
    binary_operators: tuple[str, ...] = ("+", "-", "*", "/")
    unary_operators: tuple[str, ...] = ("square", "sqrt_abs", "log_abs", "inv")
    random_state: int = 0
    more: dict[str, Any] = field(default_factory=dict)


# Option names of an external engine and their defaults; others are handed on as they are.
ENGINE_OPTIONS: dict[str, Any] = {
    "model_selection": "accuracy", "niterations": 1_000_000, "binary_operators": ["+", "-", "*", "/"], "unary_operators": ["abs", "inv(x)=1/x"], "elementwise_loss": "loss(x, y) = (x - y)^2",
    "population_size": 300, "populations": 32, "maxsize": 30, "parsimony": 1e-6, "adaptive_parsimony_scaling": 150.0, "ncycles_per_iteration": 250, "optimizer_algorithm": "BFGS",
    "optimizer_nrestarts": 3, "optimizer_iterations": 12, "should_optimize_constants": True, "optimize_probability": 0.16, "tournament_selection_n": 15, "precision": 64, "procs": 16,
    "parallelism": "multiprocessing", "timeout_seconds": 86400, "seed": 20260709, "deterministic": False, "warm_start": False, "verbosity": 0, "update_verbosity": 0, "progress": False, "output_directory": None,
}
#: The table of equations that an engine leaves in its folder, with columns equation, loss, score and complexity.
SNAPSHOT = "model_equations_snapshot.csv"


def external(command: list[str], work: str | Path, options: dict[str, Any] | None = None, most_rows: int = 1_000_000) -> Search:
    """An engine that is a program of its own: command + [folder].

    The folder holds features.csv, y.csv and run_config.json with all options; the program writes SNAPSHOT there.
    It works on one machine, so tables of over `most_rows` training rows are refused, not sampled. A program that
    fails or outlasts timeout_seconds by a minute is an error.
    """
    settings = ENGINE_OPTIONS | (options or {})
    settings["tournament_selection_n"] = max(2, min(int(settings["tournament_selection_n"]), int(settings["population_size"]) - 1))

    def run(df: DataFrame, features: dict[str, Column], y: Column, key: str, where: Column | None = None) -> list[dict[str, Any]]:
        rows = (df.where(where) if where is not None else df).select(F.col(key).cast("string").alias("row_id"), *(c.alias(n) for n, c in features.items()), y.alias("__y"))
        table = rows.limit(most_rows + 1).toPandas().sort_values("row_id")
        if len(table) > most_rows:
            raise ValueError(f"over {most_rows} training rows are more than the external engine is given")
        place = Path(work)
        place.mkdir(parents=True, exist_ok=True)
        (place / SNAPSHOT).unlink(missing_ok=True)
        table[list(features)].to_csv(place / "features.csv", index=False)
        table[["__y"]].rename(columns={"__y": "target"}).to_csv(place / "y.csv", index=False)
        write_json(settings | {"output_directory": settings["output_directory"] or str(place)}, place / "run_config.json")
        done = subprocess.run([*command, str(place)], capture_output=True, text=True, timeout=float(settings["timeout_seconds"]) + 60, check=False)
        if done.returncode:
            raise RuntimeError(f"the engine ended with {done.returncode}: {done.stderr[-500:]}")
        found = pd.read_csv(place / SNAPSHOT)
        found.columns = [c.lower() for c in found.columns]
        return [{k: (None if pd.isna(v) else v) for k, v in r.items() if k in ("equation", "loss", "score")} for r in found.to_dict("records") if isinstance(r.get("equation"), str)]

    return run


def _terms(text: str, beta: float) -> str:
    return f"({beta:.6g} * {text})"


def fit_terms(df: DataFrame, texts: list[str], features: dict[str, Column], y: Column, where: Column | None) -> str:
    """intercept + sum of coefficients times terms, by least squares on the rows of `where`."""
    columns = [F.coalesce(formula.compile_column(t, features), F.lit(0.0)) for t in texts]
    intercept, beta = stats.fit_linear(df, columns, y, where)
    return f"({intercept:.6g} + " + " + ".join(_terms(t, b) for t, b in zip(texts, beta, strict=True)) + ")"


def surrogate(df: DataFrame, features: dict[str, Column], y: Column, key: str, where: Column | None = None) -> list[dict[str, Any]]:
    """The leading one, two and three features as linear formulas, and the product of the leading two."""
    ranked = [r["feature"] for r in stats.corr_ranking(df, features, y, where).orderBy(F.desc("score"), "feature").limit(3).collect()]
    texts = [ranked[:k] for k in range(1, len(ranked) + 1)]
    if len(ranked) > 1:
        texts.append([f"({ranked[0]} * {ranked[1]})"])
    return [{"equation": fit_terms(df, t, features, y, where)} for t in texts]


def beam_search(options: SearchOptions | None = None, width: int = 30, rounds: int = 2) -> Search:
    """A bounded search: mined factors as single terms, then pairs of the leading terms."""
    o = options or SearchOptions()

    def run(df: DataFrame, features: dict[str, Column], y: Column, key: str, where: Column | None = None) -> list[dict[str, Any]]:
        settings = mine.Options(base_top_k=12, pair_top_k=12, beam_width=width, final_top_k=width, max_order=rounds, unary_ops=tuple(u for u in o.unary_operators if u in mine.UNARY), binary_ops=o.binary_operators)
        found, _ = mine.mine(df, features, y, F.col(key), settings, where)
        terms = [c.expression for c in found]
        texts = [[t] for t in terms[:8]] + [list(p) for p in itertools.combinations(terms[:4], 2)]
        return [{"equation": fit_terms(df, t, features, y, where)} for t in texts]

    return run


def score_archive(df: DataFrame, records: list[dict[str, Any]], features: dict[str, Column], y: Column, where: Column, name: str = "r2_val", size: Callable[[str], int] | None = None) -> list[dict[str, Any]]:
    """R2 of each equation on the rows of `where`, and its complexity; equations that don't compile drop out.

    Forty equations share an aggregation.
    """
    good = []
    for r in records:
        try:
            good.append((r, formula.compile_column(r["equation"], features)))
        except formula.FormulaError:
            continue
    out = []
    for at in range(0, len(good), 40):
        part = good[at : at + 40]
        exprs = []
        for i, (_, p) in enumerate(part):
            exprs += [c.alias(f"{n}{i}") for c, n in zip(stats.metrics(y, p), ("n", "sse", "sst"), strict=True)]
        row = df.where(where).agg(*exprs).first()
        for i, (r, _) in enumerate(part):
            n, sse, sst = row[f"n{i}"], row[f"sse{i}"], row[f"sst{i}"]
            r2 = 1 - sse / sst if n >= 3 and sst else float("nan")
            out.append(r | {name: r2, "rmse" if name == "r2_val" else f"{name}_rmse": math.sqrt(sse / n) if n >= 3 else float("nan"), "complexity": (size or (lambda t: formula.complexity(t)["nodes"]))(r["equation"])})
    return out


def run_search(df: DataFrame, features: dict[str, Column], y: Column, key: str, search: Search = surrogate, train: Column | None = None, validation: Column | None = None, out_dir: str | Path | None = None, options: SearchOptions | None = None) -> dict[str, Any]:
    """One engine's run with its status; the result document names the best equation on the validation rows."""
    fitted_on = train if train is not None else F.lit(True)
    status: dict[str, Any] = {"status": "started", "started_at": time.time(), "options": vars(options or SearchOptions()), "n_features": len(features)}
    line = stats.linear(list(features.values()), *stats.fit_linear(df, list(features.values()), y, fitted_on)) if features else F.lit(0.0)
    plain = stats.regression_metrics(df.where(fitted_on), y, line).first()
    status |= {"linear_r2": plain["r2"], "linear_rmse": plain["rmse"]}
    if out_dir:
        write_json(status, Path(out_dir) / "best_result.json")
    try:
        records = score_archive(df, search(df, features, y, key, train), features, y, validation if validation is not None else train if train is not None else F.lit(True))
        best = max((r for r in records if math.isfinite(r["r2_val"])), key=lambda r: (r["r2_val"], -r["complexity"]), default=None)
        status |= {"status": "success" if best else "error", "equations": records} | ({"best_equation": best["equation"], "best_r2": best["r2_val"], "best_rmse": best["rmse"], "best_complexity": best["complexity"]} if best else {"error": "no equation with a finite score"})
    except Exception as problem:
        status |= {"status": "error", "error": f"{type(problem).__name__}: {problem}", "finished_at": time.time()}
        if out_dir:
            write_json(status, Path(out_dir) / "best_result.json")
        raise
    status |= {"finished_at": time.time()}
    status["elapsed_seconds"] = status["finished_at"] - status["started_at"]
    if out_dir:
        write_json(status, Path(out_dir) / "best_result.json")
        pd.DataFrame(records, columns=sorted({k for r in records for k in r} | {"equation"})).to_csv(Path(out_dir) / SNAPSHOT, index=False)
    return status


# --- skeletons with parameters ---


def safe_skeleton(text: str) -> formula.Node:
    """A skeleton's tree; text with anything outside the grammar is refused."""
    return formula.parse(text)


def parameter_count(node: formula.Node) -> int:
    return 1 + max((x[1] for x in formula.walk(node) if x[0] == "param"), default=-1)


def levenberg(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, evaluations: int = 2000) -> np.ndarray:
    """Damped least squares with a finite-difference Jacobian and a capped number of evaluations."""
    x, used, damp = start.astype(float), 1, 1e-2
    r = residual(x)
    cost = float(r @ r)
    while used < evaluations:
        jac = np.empty((len(r), len(x)))
        for i in range(len(x)):
            step = 1e-6 * max(1.0, abs(x[i]))
            moved = x.copy()
            moved[i] += step
            jac[:, i] = (residual(moved) - r) / step
        used += len(x)
        a, g = jac.T @ jac, jac.T @ r
        for _ in range(12):
            move = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0]
            r2 = residual(x + move)
            used += 1
            cost2 = float(r2 @ r2)
            if cost2 < cost:
                done = cost - cost2 <= 1e-14 * cost
                x, r, cost, damp = x + move, r2, cost2, max(damp / 5, 1e-12)
                break
            damp *= 4
        else:
            return x
        if done:
            return x
    return x


def fit_skeleton(text: str, columns: dict[str, np.ndarray], y: np.ndarray, seed: int = 0, starts: int = 3) -> dict[str, Any]:
    """Parameters of a skeleton by least squares from N(0, 1) starts; values that aren't finite count as BAD."""
    try:
        tree = safe_skeleton(text)
        n = parameter_count(tree)

        def residual(p: np.ndarray) -> np.ndarray:
            value = formula.evaluate(tree, columns, len(y), formula.SKELETON_FUNCTIONS, p)
            return np.where(np.isfinite(value), value - y, BAD)

        rng = np.random.default_rng(seed)
        tries = [levenberg(residual, rng.normal(size=n)) if n else np.empty(0) for _ in range(starts if n else 1)]
        best = min(tries, key=lambda p: float(residual(p) @ residual(p)))
        sst = float(((y - y.mean()) ** 2).sum())
        left = residual(best)
        return {"skeleton": text, "params": best.tolist(), "expression": fill_parameters(text, best.tolist()), "r2": 1 - float(left @ left) / sst if sst > 0 else float("nan"), "error": None}
    except (formula.FormulaError, IndexError, ValueError) as problem:
        return {"skeleton": text, "params": [], "expression": None, "r2": float("nan"), "error": str(problem)}


def fit_skeleton_table(df: DataFrame, text: str, columns: dict[str, Column], y: Column, seed: int = 0, passes: int = 30, sample: int = 5000) -> dict[str, Any]:
    """fit_skeleton over a table of any size.

    Starting values are fitted to at most `sample` rows, those with the least hashes. Then each pass adds up the
    residuals' products with their numeric derivatives over all rows, in Arrow batches, until a damped step no
    longer helps. The driver gets one small matrix for each of up to 32 groups of tasks.
    """
    try:
        tree = safe_skeleton(text)
    except formula.FormulaError as problem:
        return {"skeleton": text, "params": [], "expression": None, "r2": float("nan"), "error": str(problem)}
    n, names = parameter_count(tree), list(columns)
    rows = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())), y.cast("double").alias("y")).where("y is not null and not isnan(y)")
    few = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(sample).toPandas()
    first = fit_skeleton(text, {v: few[f"c{i}"].to_numpy(float) for i, v in enumerate(names)}, few["y"].to_numpy(float), seed)
    if first["error"]:
        return first

    def sums(at: np.ndarray) -> tuple[float, float, float, float, np.ndarray, np.ndarray]:
        """Rows, their sum and sum of squares of y, cost, gradient and Gram matrix of the derivatives."""
        steps = 1e-6 * np.maximum(np.abs(at), 1e-3)
        size = 4 + n + n * n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = {v: batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i, v in enumerate(names)}
                truth = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(float)
                with np.errstate(all="ignore"):
                    each = [formula.evaluate(tree, values, len(truth), formula.SKELETON_FUNCTIONS, p) for p in (at, *(at + s * e for s in (1, -1) for e in np.diag(steps)))]
                fine = np.isfinite(each).all(axis=0)
                r = np.where(fine, each[0] - truth, BAD)
                slopes = np.array([np.where(fine, (each[1 + j] - each[1 + n + j]) / (2 * steps[j]), 0.0) for j in range(n)]).reshape(n, len(truth))
                total += np.concatenate([[len(truth), truth.sum(), truth @ truth, r @ r], slopes @ r, (slopes @ slopes.T).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

        def added(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [sum(np.frombuffer(x) for x in part["part"]).tobytes()]})

        parts = rows.mapInArrow(run, "part binary").withColumn("g", F.spark_partition_id() % 32).groupBy("g").applyInPandas(added, "part binary").collect()
        t = sum((np.frombuffer(bytes(p["part"])) for p in parts), np.zeros(size))
        return t[0], t[1], t[2], t[3], t[4 : 4 + n], t[4 + n :].reshape(n, n)

    at, damp = np.array(first["params"], float), 1e-6
    count, total, squares, cost, gradient, square = sums(at)
    for _ in range(passes if n else 0):
        move = np.linalg.lstsq(square + damp * np.diag(np.maximum(np.diag(square), 1e-12)), -gradient, rcond=None)[0]
        *_, cost2, gradient2, square2 = sums(at + move)
        if cost2 < cost:
            done = cost - cost2 <= 1e-12 * cost
            at, cost, gradient, square, damp = at + move, cost2, gradient2, square2, max(damp / 10, 1e-12)
            if done:
                break
        elif np.abs(move).max() <= 1e-9 * np.abs(at).max() or damp > 1e6:
            break
        else:
            damp *= 10
    sst = squares - total * total / max(count, 1.0)
    return {"skeleton": text, "params": at.tolist(), "expression": fill_parameters(text, at.tolist()), "r2": float(1 - cost / sst) if sst > 0 else float("nan"), "error": None}


def fill_parameters(text: str, params: list[float]) -> str:
    """The skeleton with six significant digits of each parameter."""
    return formula.show(formula.substitute(formula.parse(text), {}, {i: ("num", float(f"{p:.6g}")) for i, p in enumerate(params)}))


def skeleton_search(call: Callable[[str], str], names: list[str], summary: dict[str, dict[str, float]], columns: dict[str, np.ndarray], y: np.ndarray, iterations: int = 10, seed: int = 0) -> list[dict[str, Any]]:
    """Ask for skeletons again and again, showing the best three so far; all fits are returned, best first."""
    from factorloom.sources.chat import extract_json

    best: list[dict[str, Any]] = []
    for i in range(iterations):
        shown = "\n".join(f"- {b['skeleton']} (R2 {b['r2']:.4f})" for b in best[:3])
        prompt = f"Propose one formula skeleton for the target. Variables: {', '.join(names)}. Statistics on training rows: {summary}. Write free constants as params[0], params[1], and so on.\nBest so far:\n{shown or '- none'}\nAnswer with JSON: {{\"skeleton\": \"...\"}}"
        try:
            answer = extract_json(call(prompt))
            text = answer["skeleton"] if isinstance(answer, dict) else str(answer)
        except (ValueError, KeyError, TypeError) as problem:
            best.append({"skeleton": None, "params": [], "expression": None, "r2": float("nan"), "error": str(problem)})
            continue
        best.append(fit_skeleton(str(text), columns, y, seed + i))
        best.sort(key=lambda b: -b["r2"] if math.isfinite(b["r2"]) else math.inf)
    return best


def direct_formula(call: Callable[[str], str], names: list[str], summary: dict[str, dict[str, float]]) -> str | None:
    """A formula asked for outright; the answer may be JSON, an equation or a line of text."""
    from factorloom.sources.chat import extract_json

    text = call(f"Give a formula for the target from {', '.join(names)}. Statistics on training rows: {summary}. Answer with JSON: {{\"formula\": \"...\"}}")
    try:
        answer = extract_json(text)
        text = answer.get("formula") or answer.get("expression") or "" if isinstance(answer, dict) else str(answer)
    except ValueError:
        text = text.strip().splitlines()[-1] if text.strip() else ""
    text = text.split("=", 1)[1] if "=" in text else text
    text = text.strip().strip("`$ .")
    try:
        formula.parse(text)
        return text
    except formula.FormulaError:
        return None


def data_summary(df: DataFrame, columns: dict[str, Column], where: Column | None = None) -> dict[str, dict[str, float]]:
    """min, max and mean of each variable on the rows of `where`."""
    return {n: {k: v[k] for k in ("min", "max", "mean")} for n, v in stats.profile(df, columns, where).items()}
