"""Formula text: a whitelisted grammar, compiled to Spark columns and to numpy, and canonical trees.

Nothing is ever evaluated as code: text is tokenised, parsed by precedence into small tuples, and those
are compiled. Nodes: ("num", v), ("name", s), ("param", i), ("neg", x), ("bin", op, a, b), ("call", f, args).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Mapping
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.functions.numeric import divide, nullify

Node = tuple
_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|[-+*/^(),|\[\]]))")
CONSTANTS = {"pi": math.pi, "e": math.e}


class FormulaError(ValueError):
    """Text outside the grammar, or a name that is no column, function or constant."""


# --- function tables: Spark and numpy forms side by side ---


def _np_cbrt(x):
    return np.cbrt(x)


def _both(spark: Callable[..., Column], local: Callable, arity: int = 1) -> tuple:
    return spark, local, arity


FUNCTIONS: dict[str, tuple] = {
    "abs": _both(F.abs, np.abs),
    "sin": _both(F.sin, np.sin),
    "cos": _both(F.cos, np.cos),
    "tan": _both(F.tan, np.tan),
    "asin": _both(F.asin, np.arcsin),
    "acos": _both(F.acos, np.arccos),
    "atan": _both(F.atan, np.arctan),
    "sinh": _both(F.sinh, np.sinh),
    "cosh": _both(F.cosh, np.cosh),
    "tanh": _both(F.tanh, np.tanh),
    "exp": _both(F.exp, np.exp),
    "log": _both(lambda x: F.ln(F.abs(x)), lambda x: np.log(np.abs(x))),
    "sqrt": _both(lambda x: F.sqrt(F.abs(x)), lambda x: np.sqrt(np.abs(x))),
    "inv": _both(lambda x: divide(F.lit(1.0), x), lambda x: 1.0 / x),
    "square": _both(lambda x: x * x, lambda x: x * x),
    "cube": _both(lambda x: x * x * x, lambda x: x * x * x),
    "cbrt": _both(F.cbrt, _np_cbrt),
    "pow": _both(F.pow, np.power, 2),
    "sqrt_abs": _both(lambda x: F.sqrt(F.abs(x)), lambda x: np.sqrt(np.abs(x))),
    "log_abs": _both(lambda x: F.ln(F.abs(x) + F.lit(1e-12)), lambda x: np.log(np.abs(x) + 1e-12)),
}
FUNCTIONS |= {"arcsin": FUNCTIONS["asin"], "arccos": FUNCTIONS["acos"], "arctan": FUNCTIONS["atan"]}
#: The dialect of skeletons with params[i]: log never meets zero, and power is a function.
SKELETON_FUNCTIONS = FUNCTIONS | {"log": FUNCTIONS["log_abs"], "power": FUNCTIONS["pow"]}


# --- parsing ---


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found or found.end() == at:
            raise FormulaError(f"unexpected text at {at}: {text[at:at + 12]!r}")
        kind = found.lastgroup
        out.append((kind, found.group(kind)))
        at = found.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.bars = _tokens(text), 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if value is not None and token[1] != value:
            raise FormulaError(f"expected {value!r}, found {token[1]!r}")
        self.at += 1
        return token

    def sum(self) -> Node:
        node = self.product()
        while self.peek()[1] in ("+", "-"):
            op = self.take()[1]
            node = ("bin", op, node, self.product())
        return node

    def product(self) -> Node:
        node = self.unary()
        while self.peek()[1] in ("*", "/"):
            op = self.take()[1]
            node = ("bin", op, node, self.unary())
        return node

    def unary(self) -> Node:
        if self.peek()[1] in ("+", "-"):
            op = self.take()[1]
            inner = self.unary()
            return ("neg", inner) if op == "-" else inner
        return self.power()

    def power(self) -> Node:
        base = self.atom()
        if self.peek()[1] in ("**", "^"):
            self.take()
            return ("bin", "**", base, self.unary())
        return base

    def atom(self) -> Node:
        kind, value = self.take()
        if kind == "num":
            return ("num", float(value))
        if kind == "name":
            if self.peek()[1] == "(":
                self.take()
                args = [self.sum()]
                while self.peek()[1] == ",":
                    self.take()
                    args.append(self.sum())
                self.take(")")
                return ("call", value, tuple(args))
            if value == "params" and self.peek()[1] == "[":
                self.take()
                index = self.take()[1]
                self.take("]")
                if not index.isdigit():
                    raise FormulaError("a parameter's index is a whole number")
                return ("param", int(index))
            return ("name", value)
        if value == "(":
            node = self.sum()
            self.take(")")
            return node
        if value == "|":  # bars alternate; one that is left open ends with the text
            self.bars += 1
            node = self.sum()
            if self.peek()[1] == "|":
                self.take()
            elif self.peek()[0] != "end":
                raise FormulaError("bars can't be nested")
            self.bars -= 1
            return ("call", "abs", (node,))
        raise FormulaError(f"unexpected {value!r}" if value else "unexpected end")


@lru_cache(maxsize=65536)
def parse(text: str) -> Node:
    """The tree of a formula; ^ and ** are powers, |x| is abs(x), functions come from the whitelist."""
    if not isinstance(text, str) or not text.strip():
        raise FormulaError("empty formula")
    parser = _Parser(text)
    node = parser.sum()
    if parser.peek()[0] != "end":
        raise FormulaError(f"unexpected {parser.peek()[1]!r}")
    return node


def walk(node: Node) -> Iterable[Node]:
    yield node
    kind = node[0]
    for child in (node[1:] if kind == "neg" else node[2:] if kind == "bin" else node[2] if kind == "call" else ()):
        yield from walk(child)


def names(text: str | Node) -> list[str]:
    """Identifiers of a formula in order of first use, functions aside; constants count, since columns may shadow them."""
    node = parse(text) if isinstance(text, str) else text
    return list(dict.fromkeys(x[1] for x in walk(node) if x[0] == "name"))


def variables(text: str) -> list[str]:
    """Names without the constants; for text that doesn't parse, words that aren't functions or constants."""
    try:
        return [n for n in names(text) if n not in CONSTANTS]
    except FormulaError:
        words = re.findall(r"(?<![\w.])[A-Za-z_]\w*", text)
        return list(dict.fromkeys(w for w in words if w not in FUNCTIONS and w not in CONSTANTS))


def show(node: Node) -> str:
    """Text that parses to the same tree."""
    kind = node[0]
    if kind == "num":
        return repr(node[1]) if node[1] != int(node[1]) or abs(node[1]) > 1e15 else str(int(node[1]))
    if kind == "name":
        return node[1]
    if kind == "param":
        return f"params[{node[1]}]"
    if kind == "neg":
        return f"(-{show(node[1])})"
    if kind == "bin":
        return f"({show(node[2])} {node[1]} {show(node[3])})"
    return f"{node[1]}({', '.join(map(show, node[2]))})"


def substitute(node: Node, values: Mapping[str, Node], params: Mapping[int, Node] | None = None) -> Node:
    """The tree with names, and parameters, replaced by trees."""
    kind = node[0]
    if kind == "name":
        return values.get(node[1], node)
    if kind == "param":
        return (params or {}).get(node[1], node)
    if kind == "neg":
        return ("neg", substitute(node[1], values, params))
    if kind == "bin":
        return ("bin", node[1], substitute(node[2], values, params), substitute(node[3], values, params))
    if kind == "call":
        return ("call", node[1], tuple(substitute(a, values, params) for a in node[2]))
    return node


def rename(text: str, new: Mapping[str, str]) -> str:
    """Whole-name replacement, never inside other names."""
    return show(substitute(parse(text), {a: ("name", b) for a, b in new.items()}))


# --- compiling ---


def compile_column(text: str | Node, columns: Mapping[str, Column], functions: Mapping[str, tuple] = FUNCTIONS, params: list[float] | None = None) -> Column:
    """A double column, null where the formula has no finite value; columns shadow constants and functions."""

    def build(node: Node) -> Column:
        kind = node[0]
        if kind == "num":
            return F.lit(float(node[1]))
        if kind == "name":
            if node[1] in columns:
                return columns[node[1]]
            if node[1] in CONSTANTS:
                return F.lit(CONSTANTS[node[1]])
            raise FormulaError(f"unknown name {node[1]}")
        if kind == "param":
            return F.lit(float(params[node[1]]))
        if kind == "neg":
            return -build(node[1])
        if kind == "bin":
            a, b = build(node[2]), build(node[3])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "**": lambda: F.pow(a, b)}[node[1]]()
        spark, _, arity = _function(node, functions, columns)
        return spark(*(build(x) for x in node[2]))

    return nullify(build(parse(text) if isinstance(text, str) else text))


def _function(node: Node, functions: Mapping[str, tuple], shadow: Iterable[str]) -> tuple:
    if node[1] in shadow or node[1] not in functions:
        raise FormulaError(f"unknown function {node[1]}")
    found = functions[node[1]]
    if len(node[2]) != found[2]:
        raise FormulaError(f"{node[1]} takes {found[2]} argument(s)")
    return found


def _build(node: Node, columns: Mapping[str, np.ndarray], functions: Mapping[str, tuple], params, memo: dict):
    # Not a closure that calls itself: such a cycle would hold memo's values until the garbage collector comes round.
    if node in memo:
        return memo[node]
    kind = node[0]
    if kind == "num":
        return node[1]
    if kind == "name":
        if node[1] in columns:
            return columns[node[1]]
        if node[1] in CONSTANTS:
            return CONSTANTS[node[1]]
        raise FormulaError(f"unknown name {node[1]}")
    if kind == "param":
        return float(params[node[1]])
    if kind == "neg":
        out = -_build(node[1], columns, functions, params, memo)
    elif kind == "bin":
        a, b = (_build(x, columns, functions, params, memo) for x in node[2:4])
        op = node[1]
        if op == "/":
            out = np.where(np.asarray(b) == 0, np.nan, np.divide(a, np.where(np.asarray(b) == 0, 1.0, b)))
        else:
            out = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else np.power(np.asarray(a, float), b)
    else:
        out = _function(node, functions, columns)[1](*(_build(x, columns, functions, params, memo) for x in node[2]))
    memo[node] = out
    return out


def evaluate(text: str | Node, columns: Mapping[str, np.ndarray], rows: int, functions: Mapping[str, tuple] = FUNCTIONS, params=None, memo: dict | None = None) -> np.ndarray:
    """The same in numpy, over `rows` values; not finite is NaN. memo shares subtrees between formulas."""
    memo = {} if memo is None else memo

    with np.errstate(all="ignore"):
        out = np.broadcast_to(np.asarray(_build(parse(text) if isinstance(text, str) else text, columns, functions, params, memo), float), (rows,))
    return np.where(np.isfinite(out), out, np.nan)


def last_uses(trees: list[Node]) -> list[set[Node]]:
    """For each tree its subtrees that no later one has."""
    seen: set[Node] = set()
    out = []
    for tree in reversed(trees):
        mine, todo = set(), [tree]
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                mine.add(node)
                todo += {"neg": node[1:2], "bin": node[2:4]}.get(node[0], node[2] if node[0] == "call" else ())
        out.append(mine)
    return out[::-1]


# --- canonical trees ---

#: Functions that are powers or products in canonical form.
_ALIASES = {"arcsin": "asin", "arccos": "acos", "arctan": "atan"}


def _number(value) -> Fraction | float:
    if isinstance(value, Fraction):
        return value
    exact = Fraction(repr(value)) if isinstance(value, float) and math.isfinite(value) else Fraction(value)
    return exact if exact.denominator < 10**12 and abs(exact) < 10**18 else float(value)


def canonical(text: str | Node) -> Node:
    """n-ary sums and products of sorted terms with collected coefficients; a - b is a + (-1) b, a / b is a b^-1.

    Nodes: ("num", q), ("name", s), ("add", terms), ("mul", factors), ("pow", base, exponent), ("fn", f, args).
    """
    node = parse(text) if isinstance(text, str) else text
    kind = node[0]
    if kind == "num":
        return ("num", _number(node[1]))
    if kind in ("name", "param"):
        return node if kind == "name" else ("name", f"params[{node[1]}]")
    if kind == "neg":
        return _mul([("num", Fraction(-1)), canonical(node[1])])
    if kind == "bin":
        a, b = canonical(node[2]), canonical(node[3])
        if node[1] == "+":
            return _add([a, b])
        if node[1] == "-":
            return _add([a, _mul([("num", Fraction(-1)), b])])
        if node[1] == "*":
            return _mul([a, b])
        if node[1] == "/":
            return _mul([a, _pow(b, ("num", Fraction(-1)))])
        return _pow(a, b)
    name, args = node[1], [canonical(a) for a in node[2]]
    if name in ("square", "cube", "inv"):
        return _pow(args[0], ("num", Fraction({"square": 2, "cube": 3, "inv": -1}[name])))
    if name in ("sqrt", "cbrt"):
        return _pow(args[0], ("num", Fraction(1, 2 if name == "sqrt" else 3)))
    if name == "sqrt_abs":
        return _pow(_abs(args[0]), ("num", Fraction(1, 2)))
    if name in ("pow", "power"):
        return _pow(*args)
    if name == "abs":
        return _abs(args[0])
    return ("fn", _ALIASES.get(name, name), tuple(args))


def _abs(x: Node) -> Node:
    if x[0] == "num":
        return ("num", abs(x[1]))
    if x[0] == "fn" and x[1] == "abs":
        return x
    coefficient, rest = _split(x)
    if coefficient != 1:
        return _mul([("num", abs(coefficient)), _abs(rest)])
    return ("fn", "abs", (x,))


def _key(node: Node) -> str:
    return repr(node)


def _split(node: Node) -> tuple:
    """A term's number and the rest."""
    if node[0] == "num":
        return node[1], ("num", Fraction(1))
    if node[0] == "mul" and node[1][0][0] == "num":
        rest = node[1][1:]
        return node[1][0][1], rest[0] if len(rest) == 1 else ("mul", rest)
    return Fraction(1), node


def _add(terms: list[Node]) -> Node:
    sums: dict[Node, Fraction | float] = {}
    for term in terms:
        for part in term[1] if term[0] == "add" else (term,):
            coefficient, rest = _split(part)
            sums[rest] = sums.get(rest, Fraction(0)) + coefficient
    one = ("num", Fraction(1))
    out = []
    for rest, coefficient in sums.items():
        if coefficient == 0:
            continue
        out.append(("num", coefficient) if rest == one else _mul([("num", coefficient), rest]))
    if not out:
        return ("num", Fraction(0))
    return out[0] if len(out) == 1 else ("add", tuple(sorted(out, key=_key)))


def _mul(factors: list[Node]) -> Node:
    number: Fraction | float = Fraction(1)
    powers: dict[Node, list[Node]] = {}
    for factor in factors:
        for part in factor[1] if factor[0] == "mul" else (factor,):
            if part[0] == "num":
                number = number * part[1]
            elif part[0] == "pow":
                powers.setdefault(part[1], []).append(part[2])
            else:
                powers.setdefault(part, []).append(("num", Fraction(1)))
    if number == 0:
        return ("num", Fraction(0))
    out = []
    for base, exponents in powers.items():
        made = _pow(base, _add(exponents))
        if made[0] == "num":
            number = number * made[1]
        else:
            out.append(made)
    if len(out) == 1 and out[0][0] == "add" and number != 1:  # a number is spread over a lone sum
        return _add([_mul([("num", number), t]) for t in out[0][1]])
    out.sort(key=_key)
    if number != 1 or not out:
        out.insert(0, ("num", number))
    return out[0] if len(out) == 1 else ("mul", tuple(out))


def _pow(base: Node, exponent: Node) -> Node:
    if exponent == ("num", Fraction(1)):
        return base
    if exponent == ("num", Fraction(0)):
        return ("num", Fraction(1))
    if base[0] == "num" and exponent[0] == "num" and isinstance(exponent[1], Fraction) and exponent[1].denominator == 1 and abs(exponent[1]) <= 64 and (base[1] != 0 or exponent[1] > 0):
        return ("num", base[1] ** int(exponent[1]))
    whole = exponent[0] == "num" and isinstance(exponent[1], Fraction) and exponent[1].denominator == 1
    if base[0] == "pow" and whole and base[2][0] == "num":
        return _pow(base[1], ("num", base[2][1] * exponent[1]))
    if base[0] == "mul" and whole:
        return _mul([_pow(f, exponent) for f in base[1]])
    return ("pow", base, exponent)


def _children(node: Node) -> tuple:
    return node[1] if node[0] in ("add", "mul") else node[1:] if node[0] == "pow" else node[2] if node[0] == "fn" else ()


def node_count(node: Node) -> int:
    """All nodes; a ratio of whole numbers is one."""
    return 1 + sum(map(node_count, _children(node)))


def depth(node: Node) -> int:
    return 1 + max(map(depth, _children(node)), default=0)


def complexity(text: str) -> dict[str, int]:
    """Nodes, depth, distinct variables and constants of the canonical form; word counts if text doesn't parse."""
    try:
        tree = canonical(text)
    except (FormulaError, RecursionError, OverflowError, ZeroDivisionError):
        words = re.findall(r"[A-Za-z_]\w*|\d+\.?\d*|[-+*/^]", text)
        return {"nodes": len(words), "depth": 1 + max((text[:i].count("(") - text[:i].count(")") for i in range(len(text) + 1)), default=0), "variables": len(variables(text)), "constants": sum(w[0].isdigit() for w in words)}
    flat: list[Node] = []

    def visit(n: Node) -> None:
        flat.append(n)
        for c in _children(n):
            visit(c)

    visit(tree)
    return {"nodes": len(flat), "depth": depth(tree), "variables": len({n[1] for n in flat if n[0] == "name" and n[1] not in CONSTANTS}), "constants": sum(n[0] == "num" or n[0] == "name" and n[1] in CONSTANTS for n in flat)}


def operators(text: str) -> set[str]:
    """The operators and functions a formula uses, read from its tree."""
    out: set[str] = set()
    for node in walk(parse(text)):
        if node[0] == "bin":
            out.add(node[1])
        elif node[0] == "neg":
            out.add("-")
        elif node[0] == "call":
            out.add(node[1])
    return out
