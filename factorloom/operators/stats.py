"""Statistics: guarded correlation, mergeable moments of many formulas, least squares, metrics, ranks, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.functions.numeric import TINY

#: Independent row weights of the value fingerprint.
WEIGHTS = 3
#: Rows that formulas are evaluated on at a time.
CHUNK = 8192
#: Ranges of values for ranks, and of each of two values whose pairs are counted.
CELLS, PAIR_CELLS = 512, 256


def guarded_corr(x: Column, y: Column, least: float = TINY) -> Column:
    """Pearson r over rows where both are present: 0 for under 3 pairs or a spread of at most `least`.

    Built from covar_pop and stddev_pop, which are centred; bare corr raises on constants in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    usable = (F.count(a) >= 3) & (sa > least) & (sb > least)
    return F.when(usable, F.covar_pop(a, b) / F.when(usable, sa * sb)).otherwise(F.lit(0.0))


def profile(df: DataFrame, columns: dict[str, Column], where: Column | None = None) -> dict[str, dict[str, float]]:
    """count, missing, mean, median, population spread, min and max of each column, in one aggregation."""
    keep = where if where is not None else F.lit(True)
    out: dict[str, dict[str, float]] = {}
    items = list(columns.items())
    for at in range(0, len(items), 40):  # wider aggregations spend their time in planning
        exprs = []
        for i, (_, c) in enumerate(items[at : at + 40]):
            v = F.when(keep, c)
            exprs += [F.count(v).alias(f"n{i}"), F.count(F.when(keep & c.isNull(), 1)).alias(f"m{i}"), F.avg(v).alias(f"a{i}"), F.median(v).alias(f"d{i}"), F.stddev_pop(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
        row = df.agg(*exprs).first()
        for i, (name, _) in enumerate(items[at : at + 40]):
            out[name] = {"count": row[f"n{i}"], "missing": row[f"m{i}"], "mean": row[f"a{i}"], "median": row[f"d{i}"], "std": row[f"s{i}"], "min": row[f"l{i}"], "max": row[f"h{i}"]}
    return out


def corr_ranking(df: DataFrame, columns: dict[str, Column], y: Column, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """(feature, ordinal, score, signed): guarded correlations with y, over the rows of `where`.

    One aggregation for up to 40 columns at a time; the result has one row per column.
    """
    keep = where if where is not None else F.lit(True)
    parts = None
    items = list(columns.items())
    for at in range(0, len(items), 40):
        part = items[at : at + 40]
        row = df.agg(*(guarded_corr(F.when(keep, c), F.when(keep, y)).alias(f"r{i}") for i, (_, c) in enumerate(part)))
        rows = F.array(*(F.struct(F.lit(name).alias("feature"), F.lit(at + i).alias("ordinal"), F.col(f"r{i}").alias("signed")) for i, (name, _) in enumerate(part)))
        found = row.select(F.explode(rows).alias("x")).select("x.*")
        parts = found if parts is None else parts.unionByName(found)
    signed = F.round("signed", digits) if digits is not None else F.col("signed")
    return parts.select("feature", "ordinal", F.abs(signed).alias("score"), signed.alias("signed"))


# --- moments of many formulas in one pass ---

_FIELDS = ("n", "mx", "xx", "my", "yy", "xy", "valid", "rows", "top", "am", "aa", *(f"w{j}" for j in range(WEIGHTS)), *(f"v{j}" for j in range(WEIGHTS)))


def _weights(keys: np.ndarray, j: int) -> np.ndarray:
    """Uniform numbers in [-1, 1) that depend on the row's key alone."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z.astype(np.float64) / 2.0**63 - 1.0


def _chan(n: float, m: float, s: float, n2: float, m2: float, s2: float) -> tuple[float, float, float]:
    """Merged count, mean and sum of squares around it."""
    total = n + n2
    if not total:
        return 0.0, 0.0, 0.0
    d = m2 - m
    return total, m + d * n2 / total, s + s2 + d * d * n * n2 / total


def formula_moments(df: DataFrame, formulas: list[str], columns: dict[str, Column], y: Column, row_key: Column, where: Column | None = None) -> pd.DataFrame:
    """For each formula: pairs, signed correlation on the rows of `where`, and spread, reach and fingerprint on all rows.

    Every partition evaluates all formulas on Arrow batches, shares subtrees between them, and centres its
    sums on its own means; they are merged exactly around the common mean. No values leave the executors: the
    driver gets one row for each formula. Fingerprints are the standardised values' products with WEIGHTS
    random weights of the row keys: equal for equal values up to a positive scale and shift. They are divided by
    the root of the number of values, so their differences are of the size of those of the values in tables of any size.
    """
    names = list(columns)
    flag = (where if where is not None else F.lit(True)).cast("boolean")
    base = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())), y.cast("double").alias("y"), F.coalesce(flag, F.lit(False)).alias("m"), F.xxhash64(row_key).alias("k"))
    trees = [formula.parse(t) for t in formulas]
    ends = formula.last_uses(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Huge values overflow their squares; such formulas are dropped by their reach later.
        with np.errstate(all="ignore"):
            yield from sums(batches)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(trees)
        s = {f: np.zeros(size) for f in _FIELDS}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rows = part.num_rows
                values = {n: _doubles(part.column(i)) for i, n in enumerate(names)}
                target = _doubles(part.column(len(names)))
                mask = part.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool) & np.isfinite(target)
                key = part.column(len(names) + 2).to_numpy(zero_copy_only=False)
                weights = np.stack([_weights(key, j) for j in range(WEIGHTS)])
                memo: dict = {}
                for i, tree in enumerate(trees):
                    x = formula.evaluate(tree, values, rows, memo=memo)
                    for node in ends[i]:  # memory holds what later formulas share, whatever their number
                        memo.pop(node, None)
                    fine = np.isfinite(x)
                    s["rows"][i] += rows
                    count = int(fine.sum())
                    if not count:
                        continue
                    z, w = (x, weights) if count == rows else (x[fine], weights[:, fine])
                    mean = z.mean()
                    centred = z - mean
                    # The fingerprint's sums are kept around the running mean, so they are moved along with it.
                    before_n, before = s["valid"][i], s["am"][i]
                    s["valid"][i], s["am"][i], s["aa"][i] = _chan(before_n, before, s["aa"][i], count, mean, float(centred @ centred))
                    now = s["am"][i]
                    for j in range(WEIGHTS):
                        ws = float(w[j].sum())
                        s[f"v{j}"][i] += s[f"w{j}"][i] * (before - now) if before_n else 0.0
                        s[f"v{j}"][i] += float(w[j] @ centred) + ws * (mean - now)
                        s[f"w{j}"][i] += ws
                    s["top"][i] = max(s["top"][i], float(np.abs(z).max()))
                    pair = fine & mask
                    n2 = int(pair.sum())
                    if n2:
                        a, b = x[pair], target[pair]
                        ma, mb = a.mean(), b.mean()
                        ca, cb = a - ma, b - mb
                        n1, m1, q1 = s["n"][i], s["mx"][i], s["my"][i]
                        total, s["mx"][i], s["xx"][i] = _chan(n1, m1, s["xx"][i], n2, ma, float(ca @ ca))
                        _, s["my"][i], s["yy"][i] = _chan(n1, q1, s["yy"][i], n2, mb, float(cb @ cb))
                        s["xy"][i] += float(ca @ cb) + (ma - m1) * (mb - q1) * n1 * n2 / total
                        s["n"][i] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), *(pa.array(s[f]) for f in _FIELDS)], names=["i", *_FIELDS])

    partial = base.mapInArrow(run, "i long, " + ", ".join(f"{f} double" for f in _FIELDS))
    weight = Window.partitionBy("i")

    def common(mean: str, count: str) -> Column:
        return F.sum(F.col(mean) * F.col(count)).over(weight) / F.greatest(F.sum(count).over(weight), F.lit(1.0))

    shifted = partial.withColumn("gx", common("mx", "n")).withColumn("gy", common("my", "n")).withColumn("ga", common("am", "valid"))
    dx, dy, da = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy"), F.col("am") - F.col("ga")
    merged = shifted.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"), F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"),
        F.sum("valid").alias("valid"), F.sum("rows").alias("rows"), F.max("top").alias("top"), F.max("ga").alias("mean"), F.sum(F.col("aa") + F.col("valid") * da * da).alias("aa"),
        *(F.sum(F.col(f"v{j}") + F.col(f"w{j}") * da).alias(f"v{j}") for j in range(WEIGHTS)),
    )
    out = merged.orderBy("i").toPandas()
    sd = np.sqrt(np.maximum(out["aa"], 0) / np.maximum(out["valid"], 1))
    sx, sy = np.sqrt(np.maximum(out["xx"], 0) / np.maximum(out["n"], 1)), np.sqrt(np.maximum(out["yy"], 0) / np.maximum(out["n"], 1))
    usable = (out["n"] >= 3) & (sx > TINY) & (sy > TINY)
    signed = np.where(usable, out["xy"] / np.where(usable, np.sqrt(out["xx"] * out["yy"]), 1), 0.0)
    prints = {f"print{j}": np.where(sd > TINY, out[f"v{j}"] / np.where(sd > TINY, np.sqrt(np.maximum(out["valid"], 1)) * sd, 1), np.nan) for j in range(WEIGHTS)}
    return pd.DataFrame({"formula": formulas, "n": out["n"].astype(int), "rows": out["rows"].astype(int), "valid": out["valid"].astype(int), "mean": out["mean"], "std": sd, "top": out["top"], "score": np.abs(signed), "signed": signed, **prints})


def _doubles(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


# --- regression ---


def metrics(y: Column, p: Column) -> list[Column]:
    """n, sum of squared errors and the spread of y over finite pairs, for metric_columns()."""
    both = y.isNotNull() & p.isNotNull()
    return [F.count(F.when(both, 1)).alias("n"), F.sum(F.when(both, (y - p) * (y - p))).alias("sse"), (F.var_pop(F.when(both, y)) * F.count(F.when(both, 1))).alias("sst")]


def metric_columns(least: int = 3) -> list[Column]:
    """r2 = 1 - SSE / SST and rmse; null for fewer than `least` pairs, r2 also for a constant y."""
    enough = F.col("n") >= least
    return [F.col("n"), F.when(enough & (F.col("sst") > 0), 1 - F.col("sse") / F.when(F.col("sst") > 0, F.col("sst"))).alias("r2"), F.when(enough, F.sqrt(F.col("sse") / F.greatest(F.col("n"), F.lit(1)))).alias("rmse")]


def regression_metrics(df: DataFrame, y: Column, p: Column, by: list[str] | None = None, least: int = 3) -> DataFrame:
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(*metrics(y, p)).select(*(by or []), *metric_columns(least))


def gram(df: DataFrame, columns: list[Column], y: Column, where: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and centred products of [columns, y] over complete rows, by exact merging of partial sums."""
    d = len(columns) + 1
    rows = df.where(where) if where is not None else df
    base = rows.select(F.array(*(c.cast("double") for c in columns), y.cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, prod = 0.0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            flat = flat[np.isfinite(flat).all(axis=1)]
            if not len(flat):
                continue
            m = flat.mean(axis=0)
            c = flat - m
            total, delta = n + len(flat), m - mean
            prod += c.T @ c + np.outer(delta, delta) * n * len(flat) / total
            mean, n = mean + delta * len(flat) / total, total
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([prod.tobytes()])], names=["n", "mean", "prod"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, prod = 0.0, np.zeros(d), np.zeros((d, d))
        for row in pdf.itertuples():
            if row.n:
                m, p, total = np.frombuffer(row.mean), np.frombuffer(row.prod).reshape(d, d), n + row.n
                delta = m - mean
                prod += p + np.outer(delta, delta) * n * row.n / total
                mean, n = mean + delta * row.n / total, total
        return pd.DataFrame({"n": [n], "mean": [mean.tobytes()], "prod": [prod.tobytes()]})

    # Partial sums meet in 32 tasks first, so the driver's share doesn't grow with the partitions.
    few = base.mapInArrow(run, "n double, mean binary, prod binary").withColumn("g", F.spark_partition_id() % 32).groupBy("g").applyInPandas(lambda pdf: join(pdf), "n double, mean binary, prod binary").toPandas()
    whole = join(few).iloc[0]
    return float(whole["n"]), np.frombuffer(whole["mean"]), np.frombuffer(whole["prod"]).reshape(d, d)


def solve_least_squares(n: float, mean: np.ndarray, prod: np.ndarray, cut: float = 1e-10) -> tuple[float, np.ndarray]:
    """Intercept and the least-norm coefficients, with eigenvalues under cut times the largest left out."""
    a, b = prod[:-1, :-1], prod[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 0))
    scale[scale <= 0] = 1.0
    value, vector = np.linalg.eigh(a / np.outer(scale, scale)) if len(b) else (np.empty(0), np.empty((0, 0)))
    keep = value > cut * max(value.max(initial=0), 1e-300)
    beta = (vector[:, keep] @ ((vector[:, keep].T @ (b / scale)) / value[keep])) / scale if len(b) else b
    return float(mean[-1] - mean[:-1] @ beta), beta


def fit_linear(df: DataFrame, columns: list[Column], y: Column, where: Column | None = None) -> tuple[float, np.ndarray]:
    return solve_least_squares(*gram(df, columns, y, where))


def linear(columns: list[Column], intercept: float, beta: np.ndarray) -> Column:
    out = F.lit(float(intercept))
    for c, b in zip(columns, beta, strict=True):
        out = out + c * F.lit(float(b))
    return out


# --- ranks, agreement, bootstrap ---


def average_rank(value: str, by: list[str] | None = None) -> Column:
    """Rank with ties sharing their mean."""
    keys = by or []
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho): Pearson of average ranks; null for constants and under two rows.

    Ranks are found by counting equal and lesser values within ranges of values, so no task holds all rows.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = rows.join(_ranks(rows, "a"), "a").join(_ranks(rows, "b"), "b")
    spread = (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(spread, F.covar_pop("ra", "rb") / F.when(spread, F.stddev_pop("ra") * F.stddev_pop("rb"))).alias("rho"))


def cells(rows: DataFrame, columns: list[str], most: int = CELLS) -> list[list[float]]:
    """For each column the lower edges of ranges of values with about equally many rows; at most `most` numbers reach the driver."""
    places = [i / most for i in range(most)]
    row = rows.agg(*(F.percentile_approx(c, places, 20 * most).alias(f"q{i}") for i, c in enumerate(columns))).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(len(columns))]


def cell_of(value: Column, edges: list[float]) -> Column:
    """The number of edges that are at most the value."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= value)) if edges else F.lit(0)


def _ranks(rows: DataFrame, c: str) -> DataFrame:
    """(c, rank) of the distinct values: rows in lower ranges, then a running count within the range."""
    (edges,) = cells(rows, [c])
    counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("k")).withColumn("cell", cell_of(F.col(c), edges))
    # As many rows as there are ranges.
    below = counts.groupBy("cell").agg(F.sum("k").alias("in_cell")).select("cell", (F.sum("in_cell").over(Window.orderBy("cell")) - F.col("in_cell")).alias("below"))
    until = F.col("below") + F.sum("k").over(Window.partitionBy("cell").orderBy(c))
    return counts.join(F.broadcast(below), "cell").select(c, (until - (F.col("k") - 1) / 2.0).alias(f"r{c}"))


def ordered_pairs(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """(pairs tied in neither, those ordered alike) of rows that stand for k items each, by merging."""
    def tied(*keys: np.ndarray) -> float:
        _, at = np.unique(np.stack(keys), axis=1, return_inverse=True)
        each = np.bincount(at.ravel(), k)
        return float((each * each).sum())

    total = float(k.sum()) ** 2
    apart = (total - tied(a) - tied(b) + tied(a, b)) / 2
    order = np.lexsort((-b, a))  # equal a: falling b, so they are never counted as ordered alike
    rank = np.unique(b, return_inverse=True)[1].ravel()[order].astype(np.int64)
    weight, n, alike, width = k[order].astype(float), len(order), 0.0, 1
    place, top = np.arange(n), n + 1
    while width < n:
        left = place // width % 2 == 0
        block = place // (2 * width)
        key = block * top + rank
        lefts = np.flatnonzero(left)
        lefts = lefts[np.argsort(key[lefts], kind="stable")]
        until = np.append(0.0, np.cumsum(weight[lefts]))
        rights = np.flatnonzero(~left)
        lower, start = np.searchsorted(key[lefts], key[rights]), np.searchsorted(key[lefts], block[rights] * top)
        alike += float(((until[lower] - until[start]) * weight[rights]).sum())
        width *= 2
    return apart, alike


def pairwise_agreement(df: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """One row (pairs, agreement): of item pairs tied in neither, the share ordered alike.

    Both values are cut into ranges. Pairs in unlike ranges of both are counted from the table of ranges, those in
    one range of a, or of b alone, within the range, by merging; no pair of items is made.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ea, eb = cells(rows, ["a", "b"], PAIR_CELLS)
    groups = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).withColumns({"i": cell_of(F.col("a"), ea), "j": cell_of(F.col("b"), eb)})
    table = groups.groupBy("i", "j").agg(F.sum("k").alias("k")).collect()  # at most PAIR_CELLS squared
    grid = np.zeros((len(ea) + 1, len(eb) + 1))
    for r in table:
        grid[r["i"], r["j"]] = r["k"]
    until = grid.cumsum(0).cumsum(1)
    low = (grid[1:, 1:] * until[:-1, :-1]).sum()
    others = (grid.sum() ** 2 - (grid.sum(0) ** 2).sum() - (grid.sum(1) ** 2).sum() + (grid**2).sum()) / 2

    def within_a(part: pd.DataFrame) -> pd.DataFrame:
        apart, alike = ordered_pairs(part["a"].to_numpy(), part["b"].to_numpy(), part["k"].to_numpy())
        return pd.DataFrame({"apart": [apart], "alike": [alike]})

    def within_b(part: pd.DataFrame) -> pd.DataFrame:
        """Pairs in one range of b but in unlike ranges of a."""
        i, x, k = part["i"].to_numpy(), part["b"].to_numpy(), part["k"].to_numpy()
        apart, alike = ordered_pairs(i, x, k)
        return pd.DataFrame({"apart": [apart], "alike": [alike]})

    sums = "apart double, alike double"
    first, second = groups.groupBy("i").applyInPandas(within_a, sums), groups.groupBy("j").applyInPandas(within_b, sums)
    found = first.unionByName(second).agg(F.coalesce(F.sum("apart"), F.lit(0.0)).alias("apart"), F.coalesce(F.sum("alike"), F.lit(0.0)).alias("alike"))
    apart, alike = F.col("apart") + float(others), F.col("alike") + float(low)
    return found.select(F.round(apart).cast("long").alias("pairs"), F.when(apart > 0, alike / apart).alias("agreement"))


def bootstrap_interval(values: np.ndarray, draws: int = 2000, seed: int = 0) -> tuple[float, float]:
    """The 2.5 and 97.5 percentiles of resampled means; nothing gives NaN, one value itself."""
    if not len(values):
        return float("nan"), float("nan")
    if len(values) == 1:
        return float(values[0]), float(values[0])
    rng = np.random.default_rng(seed)
    means = values[rng.integers(0, len(values), (draws, len(values)))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def _poisson_edges(mean: int) -> tuple[int, np.ndarray]:
    """The least weight and the distribution function from it on; what lies 12 spreads away is left out."""
    low, high = max(0, int(mean - 12 * mean**0.5)), int(mean + 12 * mean**0.5 + 20)
    counts = np.arange(low, high + 1)
    steps = np.log(mean) - np.log(np.maximum(counts[1:], 1))
    return low, np.cumsum(np.exp(low * math.log(mean) - mean - math.lgamma(low + 1) + np.append(0.0, np.cumsum(steps))))


def bootstrap_by_weights(df: DataFrame, value: Column, key: Column, draws: int = 200, seed: int = 0, by: list[str] | None = None, copies: Column | None = None) -> DataFrame:
    """(by, n, mean, low, high) of the mean for tables of any size: each row has a Poisson weight of its key in each draw.

    A row that stands for several, as copies says, has the sum of as many weights. A task adds up two vectors
    of `draws` sums for each group; no row is repeated.
    """
    names = by or []
    many = copies if copies is not None else F.lit(1)
    rows = df.select(*names, value.cast("double").alias("v"), F.xxhash64(F.lit(seed), key).alias("k"), many.cast("long").alias("c")).where("v is not null and not isnan(v)")
    edges = np.cumsum(np.exp(-1.0) / np.cumprod(np.append(1.0, np.arange(1, 9))))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.select(*names).dtypes), "draw int", "w double", "wv double", "n long", "s double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for name, part in frame.groupby([*names, "c"], dropna=False):
                v, keys, c = part["v"].to_numpy(), part["k"].to_numpy().astype(np.uint64), int(name[-1])
                least, until = (0, edges) if c == 1 else _poisson_edges(c)
                sums = held.setdefault(tuple(name[:-1]), [np.zeros(draws), np.zeros(draws), np.zeros(2)])
                sums[2] += c * len(v), c * v.sum()
                for j in range(draws):
                    weight = least + np.searchsorted(until, (_weights(keys, j) + 1.0) / 2.0, side="right")
                    sums[0][j] += weight.sum()
                    sums[1][j] += weight @ v
        for name, (w, wv, total) in held.items():
            columns = [[None if pd.isna(x) else x] * draws for x in name]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(dict(zip(names, columns, strict=True)) | {"draw": np.arange(draws, dtype=np.int32), "w": w, "wv": wv, "n": int(total[0]), "s": total[1]}), preserve_index=False)

    each = rows.mapInArrow(run, schema).groupBy(*names, "draw").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = each.select(*names, "n", (F.col("s") / F.nullif("n", F.lit(0))).alias("mean"), (F.col("wv") / F.nullif("w", F.lit(0.0))).alias("draw_mean"))
    return means.groupBy(*names).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.percentile("draw_mean", 0.025).alias("low"), F.percentile("draw_mean", 0.975).alias("high"))
