"""Formula text as DuckDB SQL, for the equivalents of registered queries."""

from __future__ import annotations

from factorloom.functions import formula

_CALLS = {
    "log": "ln(nullif(abs({0}), 0))", "sqrt": "sqrt(abs({0}))", "inv": "(1.0 / nullif({0}, 0))", "square": "({0} * {0})", "cube": "({0} * {0} * {0})", "sqrt_abs": "sqrt(abs({0}))",
    "log_abs": "ln(abs({0}) + 1e-12)", "pow": "pow({0}, {1})", "arcsin": "asin({0})", "arccos": "acos({0})", "arctan": "atan({0})",
}


def sql(text: str | formula.Node, columns: dict[str, str]) -> str:
    """The formula over SQL expressions of its variables; division by zero gives null."""
    node = formula.parse(text) if isinstance(text, str) else text
    kind = node[0]
    if kind == "num":
        return f"CAST({node[1]!r} AS DOUBLE)"
    if kind == "name":
        return columns[node[1]] if node[1] in columns else f"CAST({formula.CONSTANTS[node[1]]!r} AS DOUBLE)"
    if kind == "neg":
        return f"(-{sql(node[1], columns)})"
    if kind == "bin":
        a, b = sql(node[2], columns), sql(node[3], columns)
        return f"({a} / nullif({b}, 0))" if node[1] == "/" else f"pow({a}, {b})" if node[1] == "**" else f"({a} {node[1]} {b})"
    args = [sql(a, columns) for a in node[2]]
    return _CALLS.get(node[1], node[1] + "({0})").format(*args)


def scores(texts: list[str], columns: dict[str, str], y: str, table: str, digits: int = 6, where: str = "true") -> str:
    """(expression, score, signed) of the formulas that are finite on all rows and vary."""
    parts = [f"SELECT '{t}' AS expression, count(*) AS n, count(x) AS c, stddev_pop(x) AS s, corr(x, y) AS r FROM (SELECT {sql(t, columns)} AS x, {y} AS y FROM {table} WHERE {where})" for t in texts]
    return f"SELECT expression, round(abs(r), {digits}) AS score, round(r, {digits}) AS signed FROM ({' UNION ALL '.join(parts)}) WHERE c = n AND s > 1e-12"
