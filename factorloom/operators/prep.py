"""Preprocessing: statistics fitted once, applied as one lazy projection; feature selection; manifests."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from math import ceil
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.numeric import TINY, fill, missing_flag
from factorloom.operators import stats
from factorloom.operators.grammar import Grammar, double_of, infer_features, safe_names


@dataclass
class State:
    """Fitted fills, means, scales and names; indicators are the columns with one."""

    columns: list[str]
    names: dict[str, str]
    fills: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    indicators: dict[str, str] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> State:
        return cls(**data)

    @property
    def features(self) -> list[str]:
        """Output names in order: each value, then its indicator."""
        out = []
        for c in self.columns:
            out.append(self.names[c])
            if c in self.indicators:
                out.append(self.indicators[c])
        return out


def fit(df: DataFrame, columns: list[str], g: Grammar, where: Column | None = None) -> State:
    """Fit on the rows of `where` (all by default): fills, constant columns, indicators that vary, z-scales.

    The first aggregation has fills and counts. The spread after filling follows from it without another
    pass for mean fills; median and zero fills take one more.
    """
    raw = {c: double_of(df, c) for c in columns}
    seen = stats.profile(df, raw, where)
    names = safe_names(columns, g)
    pick = {"median": "median", "mean": "mean"}.get(g.missing_policy)
    fills = {c: float(seen[c][pick] or 0.0) if pick and seen[c]["count"] else 0.0 for c in columns}
    gaps = [c for c in columns if seen[c]["missing"] and g.missing_policy != "mean" or not seen[c]["count"]]
    filled = stats.profile(df, {c: fill(raw[c], fills[c]) for c in gaps}, where) if gaps else {}
    state = State([], {}, {}, {}, {})
    for c in columns:
        after = filled.get(c, seen[c])
        mean, std = after["mean"] or 0.0, after["std"] or 0.0
        if c not in filled and seen[c]["missing"]:  # filled with the mean: the sum of squares stays, the rows grow
            std *= (seen[c]["count"] / (seen[c]["count"] + seen[c]["missing"])) ** 0.5
        if std <= TINY:
            state.dropped[c] = "constant_on_train" if where is not None else "constant"
            continue
        state.columns.append(c)
        state.names[c], state.fills[c] = names[c][0], fills[c]
        state.means[c], state.scales[c] = (mean, std) if g.scaling == "zscore" else (0.0, 1.0)
        if g.missing_indicators and 0 < seen[c]["missing"] < seen[c]["missing"] + seen[c]["count"]:
            state.indicators[c] = names[c][1]
    return state


def feature_columns(df: DataFrame, state: State) -> dict[str, Column]:
    """The output features as lazy columns of the raw table."""
    out: dict[str, Column] = {}
    for c in state.columns:
        x = double_of(df, c)
        out[state.names[c]] = (fill(x, state.fills[c]) - F.lit(state.means[c])) / F.lit(state.scales[c])
        if c in state.indicators:
            out[state.indicators[c]] = missing_flag(x)
    return out


def transform(df: DataFrame, state: State, keep: list[str] | None = None) -> DataFrame:
    """All rows with the fitted state applied, and the columns of keep: one projection."""
    return df.select(*(keep or []), *(c.alias(n) for n, c in feature_columns(df, state).items()))


def select_features(df: DataFrame, columns: dict[str, Column], y: Column, top_k: int | None = None, top_fraction: float | None = None, where: Column | None = None) -> list[dict[str, Any]]:
    """Features by |corr|, best first, ties by name: top_k, else ceil(top_fraction of all), else all; at least one."""
    ranked = stats.corr_ranking(df, columns, y, where).orderBy(F.desc("score"), "feature").collect()
    keep = len(ranked)
    if top_k:
        keep = min(keep, int(top_k))
    elif top_fraction:
        keep = min(keep, max(1, ceil(top_fraction * len(ranked))))
    return [r.asDict() for r in ranked[: max(1, keep)]]


@dataclass
class Table:
    """A feature table: the keyed frame, its feature names and the manifest of how it was made."""

    frame: DataFrame
    features: list[str]
    manifest: dict[str, Any]
    state: State


def finite_target(df: DataFrame, target: str, strict: bool = False) -> DataFrame:
    """df with the double column target, rows without a finite one dropped; strict: such a row is an error."""
    out = df.withColumn("__target", double_of(df, target))
    if strict:
        bad, rows = out.agg(F.count(F.when(F.col("__target").isNull(), 1)), F.count(F.lit(1))).first()
        if bad:
            raise ValueError(f"{bad} of {rows} targets aren't finite")
        return out
    out = out.where("__target is not null")
    if out.limit(3).count() < 3:
        raise ValueError(f"fewer than 3 finite values of {target}")
    return out


def build_features(df: DataFrame, g: Grammar, target: str, role: Column | None = None, top_k: int | None = None, top_fraction: float | None = None, row_id: str | None = None) -> Table:
    """The raw feature table of a target: row_id, target, role, then the chosen features.

    With a role column all statistics come from its 'train' rows alone. The manifest has the counts, names,
    fitted statistics, drops, scores and the R2 and RMSE of a least-squares fit on the same rows.
    """
    key = row_id or next((c for c in g.id_columns if c in df.columns), None)
    if key is None:
        raise ValueError("a row id column is needed; generate one once and store it")
    rows = finite_target(df, target, g.strict_target).withColumn("__role", role if role is not None else F.lit("all"))
    where = (F.col("__role") == "train") if role is not None else None
    columns = infer_features(df, g, target)
    state = fit(rows, columns, g, where)
    lazy = feature_columns(rows, state)
    chosen = select_features(rows, lazy, F.col("__target"), top_k, top_fraction, where) if lazy else []
    features = [n for n in state.features if n in {r["feature"] for r in chosen}]
    frame = rows.select(F.col(f"`{key}`").cast("string").alias("row_id"), F.col("__target").alias("target"), F.col("__role").alias("role"), *(lazy[n].alias(n) for n in features))
    manifest = {"target": target, "id_column": key, "n_features": len(features), "features": features, "candidates": len(columns), "dropped": state.dropped, "scores": {r["feature"]: r["score"] for r in chosen}, "statistics": state.as_dict(), "grammar": g.as_dict(), "fitted_on": "train" if role is not None else "all", "rows": {r["role"]: r["count"] for r in frame.groupBy("role").count().collect()}}
    manifest["ols"] = diagnose(frame, features, where=F.col("role") == "train" if role is not None else None) if features else None
    return Table(frame, features, manifest, state)


def diagnose(frame: DataFrame, features: list[str], target: str = "target", where: Column | None = None) -> dict[str, float | None]:
    """R2 and RMSE of the least-squares fit of target on features."""
    columns = [F.col(c) for c in features]
    intercept, beta = stats.fit_linear(frame, columns, F.col(target), where)
    rows = frame.where(where) if where is not None else frame
    out = stats.regression_metrics(rows, F.col(target), stats.linear(columns, intercept, beta)).first()
    return {"n": out["n"], "r2": out["r2"], "rmse": out["rmse"]}


def union_sources(left: DataFrame, right: DataFrame, key: str, source: str, tolerance: float = 1e-10) -> tuple[DataFrame, dict[str, str]]:
    """left with right's columns by key: equal columns of one name are dropped, others renamed source__name.

    One aggregation over the join compares all columns of the same name.
    """
    shared = [c for c in right.columns if c in left.columns and c != key]
    joined = left.alias("l").join(right.alias("r"), key)
    before, after = left.count(), joined.count()
    if before != after or right.count() != before:
        raise ValueError("the sources don't have the same rows")
    same: dict[str, bool] = {}
    if shared:
        def close(c: str) -> Column:
            a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
            return F.bool_and((a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance + tolerance * F.abs(b), F.lit(False)))

        row = joined.agg(*(close(c).alias(f"s{i}") for i, c in enumerate(shared))).first()
        same = {c: bool(row[f"s{i}"]) for i, c in enumerate(shared)}
    names: dict[str, str] = {}
    taken = set(left.columns)
    for c in right.columns:
        if c == key or same.get(c):
            continue
        new, k = (c, 1) if c not in taken else (f"{source}__{c}", 1)
        while new in taken:
            new, k = f"{source}__{c}_{k}", k + 1
        taken.add(new)
        names[c] = new
    return joined.select(*(F.col(f"l.{c}") if c != key else F.col(key) for c in left.columns), *(F.col(f"r.{c}").alias(n) for c, n in names.items())), names


def drop_zero_variance(frame: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """Features kept and dropped, by a population spread of exactly 0."""
    seen = stats.profile(frame, {c: F.col(c) for c in features})
    return [c for c in features if (seen[c]["std"] or 0.0) > 0.0], [c for c in features if not (seen[c]["std"] or 0.0) > 0.0]
