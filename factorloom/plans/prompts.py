"""Prompts for proposing, selecting and interpreting factors; all facts in them come from training rows."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.operators import stats


def top_correlations(df: DataFrame, features: dict[str, Column], y: Column, k: int = 30, where: Column | None = None) -> list[dict[str, Any]]:
    return [r.asDict() for r in stats.corr_ranking(df, features, y, where).orderBy(F.desc("score"), "feature").limit(k).collect()]


def _table(rows: list[dict[str, Any]], columns: list[str]) -> list[str]:
    def cell(v: Any) -> str:
        return f"{v:.4f}" if isinstance(v, float) else str(v)

    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c, "")) for c in columns) + " |" for r in rows)]


def proposal_prompt(target: str, correlations: list[dict[str, Any]], context: str = "", count: int = 20) -> str:
    shape = {"target": target, "proposed_factors": [{"name": "", "expression": "", "meaning": "", "dimension_note": "", "priority": 1}]}
    return "\n".join([f"# Factor proposals for {target}", "", context, "", f"Propose up to {count} factors that a domain expert can explain, as formulas over the features below.", "Allowed: + - * / ^ and abs, sqrt, log, exp, square, cube, inv, sin, cos, tan.", "", *_table(correlations, ["feature", "score", "signed"]), "", "Answer with JSON:", json.dumps(shape)])


def selection_prompts(target: str, factors: list[dict[str, Any]], keep: int = 40, batch: int | None = None) -> list[str]:
    """One prompt, or one for each batch of factors."""
    size = batch or max(1, len(factors))
    shape = {"target": target, "selected_factors": [{"factor_name": "", "reason": "", "final_formula_allowed": True}]}
    out = []
    for at in range(0, max(1, len(factors)), size):
        part = factors[at : at + size]
        out.append("\n".join([f"# Factor selection for {target}" + (f", part {at // size + 1}" if batch else ""), "", f"Choose up to {keep} factors with a clear meaning. A factor that only screens may be kept with final_formula_allowed false.", "", *_table(part, ["factor_name", "expression", "order", "score"]), "", "Answer with JSON:", json.dumps(shape)]))
    return out


def interpretation_prompt(target: str, equation: str, metrics: dict[str, Any], sources: dict[str, int]) -> str:
    return "\n".join([f"# Interpretation of a formula for {target}", "", f"Formula: {equation}", "Metrics: " + ", ".join(f"{k} {v}" for k, v in metrics.items()), "Columns by source: " + ", ".join(f"{k} {v}" for k, v in sorted(sources.items())), "", "Explain each term, its sign and its limits; say where the formula shouldn't be used."])


def brief(manifest: dict[str, Any]) -> str:
    """A feature table's manifest in a few lines."""
    lines = [f"# {manifest['target']}", "", f"Rows: {manifest.get('rows')}", f"Features: {manifest.get('n_features')}, fitted on {manifest.get('fitted_on')}", f"Dropped: {len(manifest.get('dropped', {}))}"]
    if manifest.get("ols"):
        lines.append(f"Least squares: R2 {manifest['ols']['r2']}, RMSE {manifest['ols']['rmse']}")
    lines += ["", *_table([{"feature": k, "score": v} for k, v in list(manifest.get("scores", {}).items())[:30]], ["feature", "score"])]
    return "\n".join(lines)


def source_counts(sources: dict[str, str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for s in sources.values():
        out[s] = out.get(s, 0) + 1
    return dict(sorted(out.items()))


def write(text: str, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def dump_judge_prompts(items: list, rubric: dict[str, Any], path: str | Path) -> int:
    from factorloom.operators.ratings import judge_prompt

    write("".join(json.dumps({"item_id": i.item_id, "prompt": judge_prompt(i, rubric)}) + "\n" for i in items), path)
    return len(items)
