"""Factor mining: beam search over formulas, scored by one moment pass for each order."""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.functions.numeric import TINY
from factorloom.operators import prep, stats
from factorloom.operators.grammar import proposed_name, slug

UNARY = {"abs": "abs({})", "square": "square({})", "cube": "cube({})", "inv": "inv({})", "sqrt_abs": "sqrt_abs({})", "log_abs": "log_abs({})"}
BINARY = {"+": ("({a} + {b})",), "-": ("({a} - {b})", "({b} - {a})"), "*": ("({a} * {b})",), "/": ("({a} / {b})", "({b} / {a})")}
#: Fingerprints that differ by at most this are of equal values: a root mean square of about 1.7 times as much in standardised values.
SAME = 1e-7


@dataclass
class Options:
    base_top_k: int = 40
    pair_top_k: int = 60
    beam_width: int = 300
    final_top_k: int = 1000
    max_order: int = 2
    max_abs_value: float = 1e12
    unary_ops: tuple[str, ...] = ("abs", "square", "inv", "sqrt_abs", "log_abs")
    binary_ops: tuple[str, ...] = ("+", "-", "*", "/")
    #: Rows on which spreads and fingerprints are taken: all, or those scores are taken on.
    stats_scope: str = "all"

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> Options:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in config.items() if k in cls.__dataclass_fields__})


@dataclass
class Candidate:
    """A formula with its statistics; values stay lazy."""

    id: int
    expression: str
    order: int
    score: float
    signed: float
    mean: float
    std: float
    source: str
    prints: tuple[float, ...]

    def row(self) -> dict[str, Any]:
        out = asdict(self)
        out.pop("prints")
        return out | {"factor_name": f"mined_{self.id:06d}"}


class Seen:
    """Fingerprints of the values met so far: equal values up to a positive scale and shift are found in a few buckets."""

    def __init__(self) -> None:
        self.cells: dict[int, list[tuple[float, ...]]] = {}

    def add(self, prints: tuple[float, ...]) -> bool:
        """True if new."""
        cell = math.floor(prints[0] / (10 * SAME))
        for c in (cell - 1, cell, cell + 1):
            for other in self.cells.get(c, ()):
                if all(abs(a - b) <= SAME for a, b in zip(prints, other, strict=True)):
                    return False
        self.cells.setdefault(cell, []).append(prints)
        return True


def _generate(seeds: list[Candidate], o: Options, tried: set[str]) -> list[tuple[str, str]]:
    """New texts in order: unary ones of every seed, then pairs of the leading seeds."""
    out = []

    def add(text: str, source: str) -> None:
        if text not in tried:
            tried.add(text)
            out.append((text, source))

    for s in seeds:
        for op in o.unary_ops:
            add(UNARY[op].format(s.expression), op)
    for a, b in itertools.combinations(seeds, 2):
        for op in o.binary_ops:
            for form in BINARY[op]:
                add(form.format(a=a.expression, b=b.expression), op)
    return out


def mine(df: DataFrame, features: dict[str, Column], y: Column, row_key: Column, options: Options | None = None, where: Column | None = None, proposals: dict[str, str] | None = None) -> tuple[list[Candidate], dict[str, Any]]:
    """Beam search. Returns the kept candidates, best first, and a manifest.

    Scores come from the rows of `where`. Each order draws its seeds from all kept candidates, and formulas
    and values are tried once, even if they were pruned later. A candidate is valid if it is finite on every
    row, varies, and stays within max_abs_value. Ties go to the earlier one. proposals (name to formula)
    start beside the features as their formulas.
    """
    o = options or Options()
    scope = where if o.stats_scope == "train" and where is not None else None
    rows = df.where(scope) if scope is not None else df
    tried: set[str] = set()
    seen = Seen()
    number = itertools.count()
    tested = 0

    def score(texts: list[tuple[str, str]], order: int) -> list[Candidate]:
        nonlocal tested
        tested += len(texts)
        if not texts:
            return []
        table = stats.formula_moments(rows, [t for t, _ in texts], features, y, row_key, where)
        out = []
        for (text, source), r in zip(texts, table.itertuples(index=False), strict=True):
            i = next(number)
            if r.valid < r.rows or not r.valid or not r.std > TINY or r.top > o.max_abs_value:
                continue
            prints = tuple(getattr(r, f"print{j}") for j in range(stats.WEIGHTS))
            if seen.add(prints):
                out.append(Candidate(i, text, order, float(r.score), float(r.signed), float(r.mean), float(r.std), source, prints))
        return out

    start = [(n, "base") for n in features] + [(formula.show(formula.parse(t)), "proposed") for t in (proposals or {}).values()]
    tried.update(t for t, _ in start)
    base = sorted(score(start, 0), key=lambda c: (-c.score, c.id))
    kept = [c for c in base if c.score > 0][: o.base_top_k]
    beam, sizes = kept, [len(kept)]
    for order in range(1, o.max_order + 1):
        if not beam:
            break
        seeds = sorted(kept, key=lambda c: (-c.score, c.id))[: o.pair_top_k]
        found = score(_generate(seeds, o, tried), order)
        beam = sorted(found, key=lambda c: (-c.score, c.id))[: o.beam_width]
        kept = kept + beam
        sizes.append(len(beam))
    final = sorted(kept, key=lambda c: (-c.score, c.id))[: o.final_top_k]
    return final, {"options": asdict(o), "tested": tested, "kept_by_order": sizes, "kept": len(final), "rows": "train" if where is not None else "all"}


def factor_columns(candidates: list[Candidate], features: dict[str, Column]) -> dict[str, Column]:
    """Each candidate's standardised values as a lazy column."""
    return {f"mined_{c.id:06d}": (formula.compile_column(c.expression, features) - F.lit(c.mean)) / F.lit(c.std if c.std > TINY else 1.0) for c in candidates}


def factor_frame(spark, candidates: list[Candidate]) -> DataFrame:
    rows = [c.row() for c in candidates]
    return spark.createDataFrame(rows or [], "factor_name string, id int, expression string, order int, score double, signed double, mean double, std double, source string") if rows else spark.createDataFrame([], "factor_name string, id int, expression string, order int, score double, signed double, mean double, std double, source string")


def read_proposals(path: str | Path) -> list[dict[str, Any]]:
    data = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    found = data.get("proposed_factors", data.get("factors", [])) if isinstance(data, dict) else data
    return [p for p in found if isinstance(p, dict) and p.get("expression")]


def proposal_status(df: DataFrame, features: dict[str, Column], y: Column, row_key: Column, proposals: list[dict[str, Any]], where: Column | None = None, most: float = 1e12) -> pd.DataFrame:
    """For each proposal its column name, formula, status (kept, dropped: nonfinite_or_constant, error) and score."""
    taken: set[str] = set()
    rows, good = [], []
    for p in proposals:
        row = {"name": proposed_name(str(p.get("name") or p["expression"]), taken), "expression": p["expression"], "status": "kept", "reason": None, "score": None, "signed": None}
        try:
            tree = formula.parse(p["expression"])
            unknown = [n for n in formula.names(tree) if n not in features and n not in formula.CONSTANTS]
            if unknown:
                raise formula.FormulaError(f"unknown name {unknown[0]}")
            formula.compile_column(tree, features)
            good.append(len(rows))
        except formula.FormulaError as problem:
            row |= {"status": "error", "reason": str(problem)}
        rows.append(row)
    if good:
        table = stats.formula_moments(df, [rows[i]["expression"] for i in good], features, y, row_key, where)
        for i, r in zip(good, table.itertuples(index=False), strict=True):
            if r.valid < r.rows or not r.std > TINY or r.top > most:
                rows[i] |= {"status": "dropped", "reason": "nonfinite_or_constant"}
            else:
                rows[i] |= {"score": float(r.score), "signed": float(r.signed)}
    return pd.DataFrame(rows, columns=["name", "expression", "status", "reason", "score", "signed"])


def read_selection(path: str | Path) -> list[dict[str, Any]]:
    """Selected factors from JSON (an object, a list of objects or of names) or CSV."""
    path = Path(path)
    if path.suffix.lower() == ".csv":
        return pd.read_csv(path, encoding="utf-8-sig").where(lambda x: x.notna(), None).to_dict("records")
    data = json.loads(path.read_text(encoding="utf-8-sig"))
    if isinstance(data, dict):
        data = data.get("selected_factors", data.get("factors", []))
    return [{"factor_name": d} if isinstance(d, str) else d for d in data]


def build_pool(factors: list[dict[str, Any]], raw: list[dict[str, Any]], selection: list[dict[str, Any]] | None = None, raw_keep: int = 20, factor_top_k: int = 100, authoritative: bool = True, fallback_top_k: int = 0, extra_top_k: int = 0) -> tuple[list[str], list[dict[str, Any]], dict[str, Any]]:
    """The search pool: leading raw features (ties: the later name first) and the selected factors.

    A selection names a factor by name or by formula, equal up to the canonical form. An authoritative one
    alone decides, but for fallback_top_k factors when it is empty or matches nothing; otherwise the
    factor_top_k best are taken, with extra_top_k selected ones beyond. The manifest tells what matched.
    """
    kept = sorted(raw, key=lambda r: (r["score"], r["feature"]), reverse=True)[:raw_keep]
    ranked = sorted(factors, key=lambda f: (-f["score"], f["factor_name"]))
    by_name = {f["factor_name"]: f for f in ranked}
    by_tree: dict[Any, dict[str, Any]] = {}
    for f in ranked:
        by_tree.setdefault(formula.canonical(f["expression"]), f)
    chosen, unmatched, allowed = [], [], {}
    for s in selection or []:
        found = by_name.get(s.get("factor_name"))
        if found is None and s.get("expression"):
            try:
                found = by_tree.get(formula.canonical(s["expression"]))
            except formula.FormulaError:
                found = None
        if found is None:
            unmatched.append(s)
        elif found["factor_name"] not in allowed:
            chosen.append(found)
            allowed[found["factor_name"]] = bool(s.get("final_formula_allowed", True))
    warnings = []
    if selection is None or not authoritative:
        extra = [f for f in chosen if f not in ranked[:factor_top_k]][:extra_top_k]
        picked = ranked[:factor_top_k] + extra
    elif chosen:
        picked = chosen
    else:
        warnings.append("the selection is empty" if not selection else "the selection matches no factor")
        picked = ranked[:fallback_top_k]
    pool = [{**f, "final_formula_allowed": allowed.get(f["factor_name"], True)} for f in picked]
    manifest = {"raw": len(kept), "factors": len(pool), "final_formula_allowed": sum(p["final_formula_allowed"] for p in pool), "unmatched": unmatched, "warnings": warnings, "mode": "authoritative" if selection is not None and authoritative else "corr_top_k"}
    return [r["feature"] for r in kept], pool, manifest


def select_specs(df: DataFrame, features: dict[str, Column], y: Column, row_key: Column, options: Options, where: Column | None = None, raw_keep: int = 20, factor_keep: int = 20) -> list[dict[str, Any]]:
    """Re-evaluable features chosen on the rows of `where`: leading raw ones (ties: column order) and mined ones."""
    ranked = stats.corr_ranking(df, features, y, where).orderBy(F.desc("score"), "ordinal").limit(raw_keep).collect()
    specs = [{"name": r["feature"], "expression": r["feature"], "source": "raw", "abs_corr": r["score"]} for r in ranked]
    found, _ = mine(df, features, y, row_key, options, where)
    specs += [{"name": f"mined_{c.id:06d}", "expression": c.expression, "source": "mined", "abs_corr": c.score} for c in found if c.order > 0][:factor_keep]
    return specs


def design_columns(specs: list[dict[str, Any]], features: dict[str, Column]) -> list[Column]:
    """A column for each spec; formulas that can't be compiled, and missing values, are 0."""
    out = []
    for s in specs:
        try:
            out.append(F.coalesce(formula.compile_column(s["expression"], features), F.lit(0.0)))
        except formula.FormulaError:
            out.append(F.lit(0.0))
    return out


def snapshot_columns(equations: list[str], features: dict[str, Column], top_n: int, source: str) -> dict[str, Column]:
    """The predictions of the first top_n equations that compile, missing ones 0."""
    out: dict[str, Column] = {}
    for text in equations[:top_n]:
        try:
            out[slug(f"{source}_eq{len(out) + 1}_{text}")] = F.coalesce(formula.compile_column(text, features), F.lit(0.0))
        except formula.FormulaError:
            continue
    return out


def generic_factors(names: list[str]) -> list[str]:
    """Squares, inverses, products and both ratios of all pairs."""
    out = [f"square({n})" for n in names] + [f"inv({n})" for n in names]
    for a, b in itertools.combinations(names, 2):
        out += [f"({a} * {b})", f"({a} / {b})", f"({b} / {a})"]
    return out


def build_union(sources: list[tuple[str, DataFrame]], key: str, target: str) -> prep.Table:
    """Feature tables joined by key: colliding columns compared, zero-variance ones dropped, R2 in the manifest."""
    (first, frame), names = sources[0], {}
    names[first] = {c: c for c in frame.columns}
    for source, other in sources[1:]:
        frame, names[source] = prep.union_sources(frame, other.drop(target), key, source)
    kept, dropped = prep.drop_zero_variance(frame, [c for c in frame.columns if c not in (key, target, "role")])
    frame = frame.select(key, target, *kept)
    manifest = {"sources": names, "features": kept, "dropped": dropped, "ols": prep.diagnose(frame, kept, target) if kept else None}
    return prep.Table(frame, kept, manifest, prep.State([], {}, {}, {}, {}))
