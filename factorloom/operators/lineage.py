"""Factor cards and their lineage: expansion like nested views, complexity on the expanded form, consistency."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import formula

# What a card may say about units and origin.
UNIT_STATUS = ("valid", "unknown", "screening_only")
SOURCES = ("expert", "llm", "literature", "mined")
DEEPEST = 200


class LineageError(ValueError):
    """A card that isn't valid, or factors that refer to each other in a circle."""


@dataclass
class Card:
    factor_id: str
    name: str
    expression: str
    variables: list[str] = field(default_factory=list)
    meaning: str = ""
    unit_status: str = "unknown"
    source: str = "mined"
    approved_for_final_formula: bool = False

    def __post_init__(self) -> None:
        if not self.factor_id.strip() or not self.expression.strip():
            raise LineageError("a card needs an id and an expression")
        if self.unit_status not in UNIT_STATUS:
            raise LineageError(f"unit_status is one of {UNIT_STATUS}")
        if self.source not in SOURCES:
            raise LineageError(f"source is one of {SOURCES}")

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Card:
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})


class Graph:
    """Cards by id and by name; an expression's names lead to other cards."""

    def __init__(self, cards: list[Card]):
        self.cards = cards
        self.index: dict[str, Card] = {}
        for c in cards:
            for key in dict.fromkeys((c.factor_id, c.name)):
                if key and self.index.setdefault(key, c) is not c:
                    raise LineageError(f"{key} names two cards")

    def expand(self, text: str) -> str:
        """The formula over raw variables alone, sub-formulas in brackets."""
        return formula.show(self._expand(formula.parse(text), ()))

    def _expand(self, node: formula.Node, path: tuple[str, ...]) -> formula.Node:
        if len(path) > DEEPEST:
            raise LineageError("lineage too deep")
        found: dict[str, formula.Node] = {}
        for name in formula.names(node):
            card = self.index.get(name)
            if card is None:
                continue
            if card.factor_id in path:
                raise LineageError("circle: " + " -> ".join([*path, card.factor_id]))
            inner = formula.parse(card.expression)
            found[name] = inner if inner == ("name", name) else self._expand(inner, (*path, card.factor_id))
        return formula.substitute(node, found)

    def variables(self, text: str) -> list[str]:
        return formula.variables(self.expand(text))

    def complexity(self, text: str) -> dict[str, int]:
        """Nodes, depth, variables and constants of the expanded canonical form."""
        try:
            return formula.complexity(self.expand(text))
        except formula.FormulaError:
            return formula.complexity(text)

    def edges(self) -> list[tuple[str, str]]:
        """(card, card or variable it uses), for all cards."""
        out = []
        for c in self.cards:
            for n in formula.variables(c.expression):
                out.append((c.factor_id, self.index[n].factor_id if n in self.index else n))
        return out

    def consistency(self, df: DataFrame, text: str, columns: dict[str, Column], atol: float = 1e-8, rtol: float = 1e-6) -> dict[str, Any]:
        """Whether a formula over factors equals its expansion on the rows of df: one aggregation."""
        lazy = dict(columns)
        for c in self.cards:
            lazy.setdefault(c.name, formula.compile_column(self.expand(c.expression), columns))
            lazy.setdefault(c.factor_id, lazy[c.name])
        a, b = formula.compile_column(text, lazy), formula.compile_column(self.expand(text), columns)
        both = a.isNotNull() & b.isNotNull()
        gap = F.abs(a - b)
        row = df.agg(F.count(F.when(both, 1)).alias("n"), F.max(F.when(both, gap)).alias("worst"), F.bool_and(F.when(both, gap <= atol + rtol * F.abs(b))).alias("equal"), F.count(F.when(a.isNull() != b.isNull(), 1)).alias("unlike")).first()
        return {"n": row["n"], "max_abs_diff": row["worst"], "consistent": bool(row["equal"]) and not row["unlike"]}


def unscale(text: str, means: dict[str, float], scales: dict[str, float]) -> str:
    """A formula over standardised variables as one over raw ones: each f becomes ((f - mean) / scale)."""
    values = {n: ("bin", "/", ("bin", "-", ("name", n), ("num", float(m))), ("num", float(scales.get(n, 1.0)))) for n, m in means.items()}
    return formula.show(formula.substitute(formula.parse(text), values))


def inverse_standardise(z: Column, mean: float, scale: float) -> Column:
    return F.lit(float(mean)) + F.lit(float(scale)) * z


def load_cards(path: str | Path) -> list[Card]:
    """Cards from an object with 'factors', or from a list."""
    data = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    return [Card.from_dict(d) for d in (data.get("factors", []) if isinstance(data, dict) else data)]


def save_cards(cards: list[Card], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"factors": [asdict(c) for c in cards]}, indent=2, ensure_ascii=False))


def cards_from_mined(rows: list[dict[str, Any]], limit: int | None = None) -> list[Card]:
    """A screening card for each mined factor."""
    return [Card(str(r["factor_name"]), str(r["factor_name"]), str(r["expression"]), formula.variables(str(r["expression"])), "", "screening_only", "mined") for r in rows[:limit]]
