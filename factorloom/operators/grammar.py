"""The dataset grammar: which columns are ids, targets and features, and how they are named and filled."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.numeric import to_double

# Names that count as ids and prefixes that count as targets where the configuration has none.
DEFAULT_IDS = ("structure_id", "design_index", "id", "ID", "sample_id", "Sample", "Task")
DEFAULT_TARGET_PREFIXES = ("Ads_", "N2_", "H2_", "Hydrogenation_", "NH3_")
FILLS = ("median", "mean", "zero")
SCALES = ("zscore", "none")
#: Where a configuration file has each rule, by section; rules may also stand at the top under their own names.
SECTIONS = {
    "": {"targets": "target_columns"},
    "target_rules": {"prefixes": "target_prefixes", "regex": "target_regex", "exclude": "exclude_targets"},
    "feature_rules": {"include": "feature_columns", "regex": "feature_regex", "exclude": "exclude_columns", "exclude_regex": "exclude_regex", "numeric_only": "numeric_only"},
    "missing": {"fill": "missing_policy", "add_indicators": "missing_indicators"},
    "naming": {"safe_prefix": "feature_prefix", "max_length": "max_name_length"},
}


@dataclass(frozen=True)
class Grammar:
    """Declarative rules over a table's columns; every rule has a default."""

    id_columns: tuple[str, ...] = DEFAULT_IDS
    target_columns: tuple[str, ...] = ()
    target_prefixes: tuple[str, ...] = DEFAULT_TARGET_PREFIXES
    target_regex: tuple[str, ...] = ()
    exclude_targets: tuple[str, ...] = ()
    feature_columns: tuple[str, ...] = ()
    feature_regex: tuple[str, ...] = ()
    exclude_columns: tuple[str, ...] = ()
    exclude_regex: tuple[str, ...] = ()
    numeric_only: bool = True
    missing_policy: str = "median"
    missing_indicators: bool = True
    scaling: str = "zscore"
    feature_prefix: str = "raw_"
    max_name_length: int = 96
    encoding: str = "utf-8-sig"
    strict_target: bool = False

    def __post_init__(self) -> None:
        if self.missing_policy not in FILLS:
            raise ValueError(f"missing_policy is one of {FILLS}")
        if self.scaling not in SCALES:
            raise ValueError(f"scaling is one of {SCALES}")

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> Grammar:
        known = {f.name: f for f in fields(cls)}
        values = {}
        flat = dict(config)
        for section, rules in SECTIONS.items():
            inside = config.get(section, {}) if section else config
            flat |= {name: inside[key] for key, name in rules.items() if key in inside}
        for key, value in flat.items():
            if key in known:
                values[key] = tuple([value] if isinstance(value, str) else value) if isinstance(known[key].default, tuple) else value
        return cls(**values)

    def as_dict(self) -> dict[str, Any]:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}


@dataclass
class Workflow:
    """A JSON configuration whose paths are relative to its file and may contain {target}."""

    data: dict[str, Any]
    base: Path = field(default_factory=Path)

    @classmethod
    def from_json(cls, path: str | Path) -> Workflow:
        path = Path(path)
        return cls(json.loads(path.read_text(encoding="utf-8-sig")), path.resolve().parent)

    @property
    def grammar(self) -> Grammar:
        """The rules of 'dataset'; targets may also be listed beside it."""
        return Grammar.from_config({"targets": self.data.get("targets", [])} | self.data.get("dataset", {}))

    def get(self, key: str, default: Any = None) -> Any:
        return self.data.get(key, default)

    def path(self, key_or_path: str, target: str | None = None) -> Path:
        value = str(self.data.get(key_or_path, key_or_path))
        if target is not None:
            value = value.replace("{target}", target)
        found = Path(value)
        return found if found.is_absolute() else self.base / found

    def targets(self, chosen: list[str] | None = None, columns: list[str] | None = None) -> list[str]:
        """Targets named by the caller, else by the configuration, else inferred from columns."""
        found = list(dict.fromkeys(chosen or self.data.get("targets") or (infer_targets(columns, self.grammar) if columns else [])))
        if not found:
            raise SystemExit("no target: name one, or set targets or target rules")
        return found


def matches_any(name: str, patterns: tuple[str, ...]) -> bool:
    return any(re.search(p, name) for p in patterns)


def infer_targets(columns: list[str], g: Grammar) -> list[str]:
    """Named targets that exist; without names, by prefix and then by pattern, once each."""
    if g.target_columns:
        found = [c for c in g.target_columns if c in columns]
    else:
        found = [c for c in columns if any(c.startswith(p) for p in g.target_prefixes)]
        found += [c for c in columns if matches_any(c, g.target_regex)]
    return [c for c in dict.fromkeys(found) if c not in g.exclude_targets]


def infer_features(df: DataFrame, g: Grammar, target: str | None = None) -> list[str]:
    """Columns that are no id, target or excluded, and, if numeric_only, have a number: one aggregation decides."""
    targets = set(infer_targets(df.columns, g)) | ({target} if target else set())
    found = [c for c in df.columns if c not in g.id_columns and c not in targets and c not in g.exclude_columns and not matches_any(c, g.exclude_regex)]
    if g.feature_columns:
        found = [c for c in found if c in g.feature_columns]
    if g.feature_regex:
        found = [c for c in found if matches_any(c, g.feature_regex)]
    if g.numeric_only and found:
        row = df.agg(*(F.count(double_of(df, c)).alias(f"n{i}") for i, c in enumerate(found))).first()
        found = [c for i, c in enumerate(found) if row[f"n{i}"]]
    return found


def double_of(df: DataFrame, name: str) -> Column:
    return to_double(F.col(f"`{name}`"), df.schema[name].dataType)


def safe_name(name: str, taken: set[str], prefix: str = "raw_", longest: int = 96) -> str:
    """A valid, unused identifier for a column; the caller's set of taken names grows."""
    core = re.sub("[^A-Za-z0-9_]+", "_", name).strip("_") or "x"
    if core[0].isdigit():
        core = f"x_{core}"
    stem = (prefix + core)[:longest].rstrip("_") or "x"
    found, k = stem, 2
    while found in taken:
        tail = f"_{k}"
        found, k = stem[: longest - len(tail)] + tail, k + 1
    taken.add(found)
    return found


def safe_names(columns: list[str], g: Grammar, indicators: bool = True) -> dict[str, tuple[str, str]]:
    """For each column the names of its value and of its missing indicator, always allotted in order."""
    taken: set[str] = set()
    return {c: (safe_name(c, taken, g.feature_prefix, g.max_name_length), safe_name(f"{c}_missing", taken, g.feature_prefix, g.max_name_length) if indicators else "") for c in columns}


def slug(text: str, longest: int = 88) -> str:
    return (re.sub("[^A-Za-z0-9_]+", "_", text).strip("_") or "x")[:longest]


def proposed_name(name: str, taken: set[str]) -> str:
    return safe_name("".join(c if c.isalnum() else "_" for c in name), taken, "llmprop_", 80)


def inspect(df: DataFrame, g: Grammar) -> dict[str, Any]:
    """Rows, columns, targets, features of each target and the ids there are."""
    targets = infer_targets(df.columns, g)
    return {"rows": df.count(), "columns": len(df.columns), "targets": targets, "features": {t: len(infer_features(df, g, t)) for t in targets}, "ids": [c for c in g.id_columns if c in df.columns]}
