"""Formula selection: within a band of the best accuracy, the simplest formula wins."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.operators.lineage import Graph, LineageError

BAND = 0.02


@dataclass
class Choice:
    """A candidate formula; r2_test is carried along and never read by a selector."""

    candidate_id: str
    expression: str
    r2_val: float
    r2_test: float | None = None
    uses_domain_factor: bool = False
    stability: float = 0.0
    hard_violation: str | None = None
    meta: dict[str, Any] = field(default_factory=dict)


def choices(records: list[dict[str, Any]]) -> list[Choice]:
    """Records to candidates: ids by place where missing, unreadable accuracies are NaN."""
    out = []
    for i, r in enumerate(records):
        try:
            r2 = float(r.get("r2_val"))
        except (TypeError, ValueError):
            r2 = math.nan
        known = set(Choice.__dataclass_fields__)
        out.append(Choice(str(r.get("candidate_id") or f"candidate_{i:04d}"), str(r.get("expression") or ""), r2, r.get("r2_test"), bool(r.get("uses_domain_factor", False)), float(r.get("stability") or 0.0), r.get("hard_violation"), {k: v for k, v in r.items() if k not in known}))
    return out


def hard_violation(c: Choice, graph: Graph | None = None, leakage: set[str] | None = None) -> str | None:
    """Why a candidate can't be chosen: as given, empty, not a formula, or uses a leaking variable."""
    if c.hard_violation:
        return str(c.hard_violation)
    if not c.expression.strip():
        return "empty"
    try:
        used = set(graph.variables(c.expression) if graph else formula.variables(c.expression))
        formula.parse(c.expression)
    except (formula.FormulaError, LineageError) as problem:
        return f"invalid: {problem}"
    leaks = sorted(used & (leakage or set()))
    return f"leakage: {', '.join(leaks)}" if leaks else None


def interpretability_first(found: list[Choice], graph: Graph | None = None, band: float = BAND, leakage: set[str] | None = None, check: Callable[[Choice], str | None] | None = None) -> dict[str, Any]:
    """The band's simplest candidate, with a full trace.

    Candidates without a finite validation R2 drop out first. The band hangs from the best of all others,
    violators included; then violators go, and the order is: fewest expanded nodes, domain factor, stability, id.
    """
    graph = graph or Graph([])
    finite = [c for c in found if math.isfinite(c.r2_val)]
    trace: list[dict[str, Any]] = [{"stage": "finite", "in": len(found), "out": len(finite)}]
    if not finite:
        return {"selected": None, "threshold": None, "trace": trace, "rows": []}
    threshold = max(c.r2_val for c in finite) - band
    near = [c for c in finite if c.r2_val >= threshold - 1e-12]
    trace.append({"stage": "band", "threshold": threshold, "out": len(near)})
    rows = []
    for c in near:
        problem = (check or (lambda x: hard_violation(x, graph, leakage)))(c)
        nodes = graph.complexity(c.expression)["nodes"] if c.expression.strip() else 0
        rows.append({"candidate_id": c.candidate_id, "expression": c.expression, "r2_val": c.r2_val, "nodes": nodes, "uses_domain_factor": c.uses_domain_factor, "stability": c.stability, "violation": problem})
    fair = [r for r in rows if not r["violation"]]
    trace.append({"stage": "violations", "out": len(fair), "removed": [r["candidate_id"] for r in rows if r["violation"]]})
    ranked = sorted(fair, key=lambda r: (r["nodes"], not r["uses_domain_factor"], -r["stability"], r["candidate_id"]))
    trace.append({"stage": "order", "out": [r["candidate_id"] for r in ranked]})
    return {"selected": next(c for c in near if c.candidate_id == ranked[0]["candidate_id"]) if ranked else None, "threshold": threshold, "trace": trace, "rows": rows}


def band_select(df: DataFrame, by: list[str] | None = None, band: float = BAND, nodes: str = "nodes") -> DataFrame:
    """The same rule over a table (candidate_id, r2_val, nodes, violation, domain, stability), for many tasks at once.

    One window over each task's candidates, of which there are few.
    """
    keys = by or []
    fine = df.where(F.col("r2_val").isNotNull() & ~F.isnan("r2_val")).withColumn("threshold", F.max("r2_val").over(Window.partitionBy(*keys)) - band)
    order = Window.partitionBy(*keys).orderBy(F.asc(nodes), F.desc("domain"), F.desc("stability"), F.asc("candidate_id"))
    return fine.where((F.col("r2_val") >= F.col("threshold") - 1e-12) & ~F.coalesce("violation", F.lit(False))).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def best_accuracy(records: list[dict[str, Any]], size: str = "complexity") -> dict[str, Any] | None:
    """The highest validation R2, then the smaller size."""
    fine = [r for r in records if isinstance(r.get("r2_val"), (int, float)) and math.isfinite(r["r2_val"])]
    return max(fine, key=lambda r: (r["r2_val"], -(r.get(size) or 0)), default=None)
