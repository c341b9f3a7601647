"""The registered queries over the driver's tables, and their DuckDB equivalents.

Each query takes (spark, sf_dir) and reads its whole tables. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.functions.numeric import fill, missing_flag, to_double
from factorloom.operators import crossval, lineage, mine, prep, ratings, select, similarity, splits, stats
from factorloom.operators.grammar import Grammar, infer_features
from factorloom.plans import experiments, search
from factorloom.plans.oracle import scores, sql
from factorloom.session import ship
from factorloom.sources import files
from factorloom.sources.synthetic import make_task, scalable_task

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = {"q": "l_quantity", "d": "l_discount", "t": "l_tax"}
PRICE = "l_extendedprice"


def line(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    df = table(spark, sf_dir, "lineitem")
    return df, {n: F.col(c) for n, c in LINE.items()}


def line_key():
    return F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


def order_one(names: list[str], unary: tuple[str, ...] = ("square", "inv", "sqrt_abs", "log_abs")) -> list[str]:
    """Columns, their unary factors and the factors of all pairs."""
    out = list(names) + [mine.UNARY[u].format(n) for n in names for u in unary]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out += [f.format(a=a, b=b) for op in mine.BINARY for f in mine.BINARY[op]]
    return out


# --- mining ---

_RANKED = scores(order_one(list(LINE)), LINE, PRICE, "lineitem")


@query("flagship_rank_order1", f"SELECT expression, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, expression) AS rank FROM ({_RANKED})) WHERE rank <= 20")
def flagship(spark, sf_dir):
    """Columns and order-1 factors of lineitem by |corr| with the price: the best 20, from one moment pass."""
    df, x = line(spark, sf_dir)
    m = stats.formula_moments(df, order_one(list(LINE)), x, F.col(PRICE), line_key())
    m = m[(m["valid"] == m["rows"]) & (m["std"] > 1e-12)]
    rows = sorted(((round(float(s), 6), f) for s, f in zip(m["score"], m["formula"], strict=True)), key=lambda r: (-r[0], r[1]))[:20]
    return spark.createDataFrame([(f, s, i + 1) for i, (s, f) in enumerate(rows)], "expression string, score double, rank int")


_SMALL = mine.Options(base_top_k=3, pair_top_k=12, beam_width=60, final_top_k=60, max_order=1, unary_ops=("abs", "square", "inv", "sqrt_abs"))
_POOL = [t for t in order_one(list(LINE), ("square", "inv", "sqrt_abs"))]


_BY_TREE = {formula.canonical(t): t for t in _POOL}


def named(text: str) -> str:
    """A mined formula as the list above writes it: the miner puts the better operand first."""
    return _BY_TREE.get(formula.canonical(text), text)


@query("mined_order1_pool", f"SELECT expression, score, signed FROM ({scores(_POOL, LINE, PRICE, 'lineitem')})")
def mined_order1(spark, sf_dir):
    """The miner at order 1: values already met (abs of positive columns) and invalid ones drop out."""
    df, x = line(spark, sf_dir)
    found, _ = mine.mine(df, x, F.col(PRICE), line_key(), _SMALL)
    return spark.createDataFrame([(named(c.expression), round(c.score, 6), round(c.signed, 6)) for c in found], "expression string, score double, signed double")


@query("mined_final_topk", f"SELECT expression, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, expression) AS k FROM ({scores(_POOL, LINE, PRICE, 'lineitem')})) WHERE k <= 8")
def mined_topk(spark, sf_dir):
    df, x = line(spark, sf_dir)
    found, _ = mine.mine(df, x, F.col(PRICE), line_key(), _SMALL)
    rows = sorted(((round(c.score, 6), named(c.expression)) for c in found), key=lambda r: (-r[0], r[1]))[:8]
    return spark.createDataFrame([(e, s) for s, e in rows], "expression string, score double")


def order_two(spark, sf_dir) -> tuple[list, dict]:
    df, x = line(ship(spark), sf_dir)
    return mine.mine(df, x, F.col(PRICE), line_key(), mine.Options(base_top_k=3, pair_top_k=12, beam_width=40, final_top_k=50))


@query("mined_order2")
def mined_order2(spark, sf_dir):
    """Beam search to order 2 over lineitem; rows only."""
    return mine.factor_frame(spark, order_two(spark, sf_dir)[0])


_VALID = ["q", "inv(d)", "(q / t)", "(q - q)", "log(q)", "exp(q * 20)", "sqrt_abs(d)"]


@query("valid_values_filter", " UNION ALL ".join(f"SELECT '{t}' AS expression, count(x) = count(*) AND stddev_pop(x) > 1e-12 AND max(abs(x)) <= 1e12 AS valid FROM (SELECT {sql(t, LINE)} AS x FROM lineitem)" for t in _VALID if "exp" not in t) + " UNION ALL SELECT 'exp(q * 20)', false")
def valid_values(spark, sf_dir):
    """Which formulas are finite everywhere, vary and stay within 1e12."""
    df, x = line(spark, sf_dir)
    m = stats.formula_moments(df, _VALID, x, F.col(PRICE), line_key())
    return spark.createDataFrame([(r.formula, bool(r.valid == r.rows and r.std > 1e-12 and r.top <= 1e12)) for r in m.itertuples(index=False)], "expression string, valid boolean")


_TWINS = ["a", "a * 2 + 1", "b", "a + b", "b + a", "a - b", "b - a", "square(b)", "b * b"]
_TWIN_COLUMNS = {"a": "o_totalprice", "b": "CAST(o_custkey AS DOUBLE)"}
_Z = ", ".join(f"({e} - avg({e}) OVER ()) / stddev_pop({e}) OVER () AS z{i}" for i, e in enumerate(sql(t, _TWIN_COLUMNS) for t in _TWINS))
_FIRST = " UNION ALL ".join(f"SELECT '{t}' AS expression, CAST(least({', '.join([f'CASE WHEN m{j}_{i} < 1e-6 THEN {j} ELSE {i} END' for j in range(i)] + [str(i)])}) AS INTEGER) AS first_equal FROM g" for i, t in enumerate(_TWINS))


@query("value_signature_dedup", f"WITH z AS (SELECT {_Z} FROM orders), g AS (SELECT {', '.join(f'max(abs(z{j} - z{i})) AS m{j}_{i}' for i in range(len(_TWINS)) for j in range(i))} FROM z) {_FIRST}")
def value_signature(spark, sf_dir):
    """For each formula the first one with the same standardised values, found by fingerprints alone."""
    df = table(spark, sf_dir, "orders")
    m = stats.formula_moments(df, _TWINS, {"a": F.col("o_totalprice"), "b": F.col("o_custkey").cast("double")}, F.col("o_totalprice"), F.col("o_orderkey"))
    prints = m[[f"print{j}" for j in range(stats.WEIGHTS)]].to_numpy()
    return spark.createDataFrame([(t, next(j for j in range(i + 1) if max(abs(prints[i] - prints[j])) <= mine.SAME)) for i, t in enumerate(_TWINS)], "expression string, first_equal int")


_PROPOSED = [{"name": "density", "expression": "price / size"}, {"name": "bad name", "expression": "nothing + 1"}, {"name": "flat", "expression": "size - size"}, {"name": "broken", "expression": "price +* 2"}, {"name": "log price", "expression": "log(price) * size"}]
_PART = {"price": "p_retailprice", "size": "CAST(p_size AS DOUBLE)"}
_PROPOSED_SQL = " UNION ALL ".join([f"SELECT '{n}' AS name, 'kept' AS status, (SELECT score FROM ({scores([e], _PART, 'CAST(p_partkey AS DOUBLE)', 'part')})) AS score" for n, e in (("llmprop_density", "price / size"), ("llmprop_log_price", "log(price) * size"))] + ["SELECT 'llmprop_bad_name', 'error', NULL", "SELECT 'llmprop_flat', 'dropped', NULL", "SELECT 'llmprop_broken', 'error', NULL"])


@query("proposed_factor_status", _PROPOSED_SQL)
def proposed(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    got = mine.proposal_status(df, {"price": F.col("p_retailprice"), "size": F.col("p_size").cast("double")}, F.col("p_partkey").cast("double"), F.col("p_partkey"), _PROPOSED)
    return spark.createDataFrame([(r.name, r.status, None if r.score is None or r.score != r.score else round(float(r.score), 6)) for r in got.itertuples(index=False)], "name string, status string, score double")


def _factors(spark, sf_dir) -> list[dict]:
    df, x = line(spark, sf_dir)
    return [c.row() | {"expression": named(c.expression)} for c in mine.mine(df, x, F.col(PRICE), line_key(), _SMALL)[0] if c.order > 0]


@query("pool_llm_authoritative", f"SELECT expression, score, expression <> '(d + t)' AS final_formula_allowed FROM ({scores(['(q * d)', '(d + t)'], LINE, PRICE, 'lineitem')})")
def pool_selected(spark, sf_dir):
    """A selection by formula, in another order of operands; what it names is the pool."""
    chosen = [{"expression": "d * q"}, {"expression": "t + d", "final_formula_allowed": False}, {"expression": "q^7"}]
    _, pool, _ = mine.build_pool(_factors(spark, sf_dir), [], chosen)
    return spark.createDataFrame([(p["expression"], round(p["score"], 6), p["final_formula_allowed"]) for p in pool], "expression string, score double, final_formula_allowed boolean")


_DERIVED = [t for t in _POOL if t not in LINE]


@query("pool_corr_topk", f"SELECT expression, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, expression) AS k FROM ({scores(_DERIVED, LINE, PRICE, 'lineitem')})) WHERE k <= 5")
def pool_top(spark, sf_dir):
    made = [f | {"score": round(f["score"], 6), "factor_name": f["expression"]} for f in _factors(spark, sf_dir)]
    _, pool, _ = mine.build_pool(made, [], None, factor_top_k=5)
    return spark.createDataFrame([(p["expression"], p["score"]) for p in pool], "expression string, score double")


@query("source_union_collisions", "SELECT unnest(['p_partkey', 'size', 'price', 'b__price', 'extra']) AS column_name, unnest([sum(p_partkey)::DOUBLE, sum(p_size)::DOUBLE, round(sum(p_retailprice), 2), round(sum(p_retailprice * 2), 2), count(*) * 1.5]::DOUBLE[]) AS total FROM part")
def collisions(spark, sf_dir):
    """Equal columns of one name merge, unlike ones are renamed after their source; sums tell whose values they are."""
    df = table(spark, sf_dir, "part")
    left = df.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    right = df.select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") * 2).alias("price"), F.lit(1.5).alias("extra"))
    frame, _ = prep.union_sources(left, right, "p_partkey", "b")
    sums = frame.agg(*(F.round(F.sum(F.col(c).cast("double")), 2).alias(c) for c in frame.columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("total")) for c in frame.columns))).alias("x")).select("x.*")


# --- schema, fills, scales ---


@query("finite_target_filter", "SELECT event_id, k FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL")
def finite_target(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return prep.finite_target(df, "k").select("event_id", F.col("__target").alias("k"))


@query("numeric_only_columns", "SELECT column_name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(try_cast({c} AS DOUBLE)) AS n FROM events" for c in ("user_id", "event_type", "props")) + ") WHERE n > 0")
def numeric_only(spark, sf_dir):
    """The columns that are inferred as features: neither id nor target, with a number in some row."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    return spark.createDataFrame([(c,) for c in infer_features(df, Grammar(id_columns=("event_id",), target_columns=("value",)))], "column_name string")


def labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("double").alias("quality"))


_LABELLED = "(SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS quality FROM documents d LEFT JOIN labels l USING (doc_id))"


def _fill(policy: str) -> None:
    value = {"median": "(SELECT median(quality) FROM x)", "mean": "(SELECT avg(quality) FROM x)", "zero": "0.0"}[policy]

    @query(f"fill_{policy}", f"WITH x AS {_LABELLED} SELECT doc_id, round(coalesce(quality, {value}), 6) AS filled FROM x")
    def run(spark, sf_dir):
        df = labelled(spark, sf_dir)
        seen = stats.profile(df, {"quality": F.col("quality")})["quality"]
        return df.select("doc_id", F.round(fill(F.col("quality"), seen[policy] if policy != "zero" else 0.0), 6).alias("filled"))


for _policy in ("median", "mean", "zero"):
    _fill(_policy)


@query("missing_indicator", f"SELECT doc_id, CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS missing FROM {_LABELLED}")
def indicator(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", missing_flag(F.col("quality")).alias("missing"))


@query("zscore_full", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS z FROM orders")
def zscore(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    state = prep.fit(df, ["o_totalprice"], Grammar())
    return prep.transform(df, state, ["o_orderkey"]).select("o_orderkey", F.round("raw_o_totalprice", 6).alias("z"))


def _roles_sql(source: str, key: str) -> str:
    ranked = f"SELECT {key}, row_number() OVER (ORDER BY sha256('7|' || {key})) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {source})"
    return f"SELECT {key}, CASE WHEN k <= round_even(n * 0.6, 0) THEN 'train' WHEN k <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'validation' ELSE 'test' END AS role FROM ({ranked})"


@query("split_hash_roles", _roles_sql("orders", "o_orderkey"))
def split_roles(spark, sf_dir):
    return splits.hash_roles(table(spark, sf_dir, "orders"), "o_orderkey")


@query("split_group_roles", f"SELECT c_custkey, role FROM customer JOIN ({_roles_sql('customer', 'c_nationkey')}) USING (c_nationkey)")
def split_groups(spark, sf_dir):
    return splits.group_roles(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")


@query("split_check", "WITH r AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 11 = 0) SELECT count(*)::BIGINT AS rows, count(DISTINCT o_orderkey)::BIGINT AS distinct_ids, (SELECT count(*) FROM (SELECT o_orderkey FROM r GROUP BY 1 HAVING count(*) > 1))::BIGINT AS repeated, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r))::BIGINT AS missing, count(CASE WHEN o_orderkey < 0 THEN 1 END)::BIGINT AS unknown, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0)::BIGINT AS invalid FROM r")
def split_check(spark, sf_dir):
    """Roles with rows left out, listed twice, and unknown ones under a role that there isn't."""
    df = table(spark, sf_dir, "orders")
    roles = splits.hash_roles(df, "o_orderkey")
    key = F.col("o_orderkey")
    spoilt = roles.where(key % 10 != 0).unionByName(roles.where(key % 7 == 0)).unionByName(df.where(key % 11 == 0).select((-key).alias("o_orderkey"), F.lit("holdout").alias("role")))
    return splits.check_roles(spoilt, df, "o_orderkey")


@query("kfold_assignment", "SELECT o_orderkey, CAST(('0x' || substr(sha256('7|' || o_orderkey), 1, 12))::BIGINT % 5 AS INTEGER) AS fold FROM orders")
def kfold(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "orders"), "o_orderkey", 5)


@query("zscore_train_fit", f"WITH r AS ({_roles_sql('orders', 'o_orderkey')}), x AS (SELECT o_orderkey, role, o_totalprice AS v FROM orders JOIN r USING (o_orderkey)) SELECT o_orderkey, role, round((v - (SELECT avg(v) FROM x WHERE role = 'train')) / (SELECT stddev_pop(v) FROM x WHERE role = 'train'), 6) AS z FROM x")
def zscore_train(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rows = df.join(splits.hash_roles(df, "o_orderkey"), "o_orderkey")
    state = prep.fit(rows, ["o_totalprice"], Grammar(), F.col("role") == "train")
    return prep.transform(rows, state, ["o_orderkey", "role"]).select("o_orderkey", "role", F.round("raw_o_totalprice", 6).alias("z"))


@query("constant_column_drop", " UNION ALL ".join(f"SELECT '{n}' AS column_name, CASE WHEN stddev_pop({e}) > 1e-12 THEN 'kept' ELSE 'constant' END AS state FROM part" for n, e in (("p_size", "p_size"), ("p_retailprice", "p_retailprice"), ("flat", "p_size * 0 + 3"), ("brief", "length(p_name) * 0"))))
def constant_drop(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("flat", F.col("p_size") * 0 + 3).withColumn("brief", F.length("p_name") * 0)
    state = prep.fit(df, ["p_size", "p_retailprice", "flat", "brief"], Grammar())
    return spark.createDataFrame([(c, "kept") for c in state.columns] + list(state.dropped.items()), "column_name string, state string")


_COLUMNS = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax", "l_linenumber": "CAST(l_linenumber AS DOUBLE)"}


def _ranking_sql(where: str = "true") -> str:
    return scores(list(_COLUMNS), _COLUMNS, PRICE, "lineitem", where=where)


@query("abs_corr_ranking", f"SELECT expression AS feature, score, signed FROM ({_ranking_sql()})")
def corr_ranking(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return stats.corr_ranking(df, {c: F.col(c).cast("double") for c in _COLUMNS}, F.col(PRICE), digits=6).select("feature", "score", "signed")


@query("abs_corr_train_only", f"SELECT expression AS feature, score, signed FROM ({_ranking_sql('l_orderkey % 5 < 3')})")
def corr_train(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return stats.corr_ranking(df, {c: F.col(c).cast("double") for c in _COLUMNS}, F.col(PRICE), F.col("l_orderkey") % 5 < 3, 6).select("feature", "score", "signed")


@query("topk_features", f"SELECT expression AS feature, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, expression) AS k FROM ({_ranking_sql()})) WHERE k <= 2")
def topk(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    best = prep.select_features(df, {c: F.col(c).cast("double") for c in _COLUMNS}, F.col(PRICE), top_k=2)
    return spark.createDataFrame([(r["feature"], round(r["score"], 6)) for r in best], "feature string, score double")


@query("feature_table_manifest", "SELECT count(*)::BIGINT AS rows, 1::BIGINT AS n_features, round(avg(CAST(o_custkey AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(o_custkey AS DOUBLE)), 6) AS scale, round(regr_r2(o_totalprice, o_custkey), 6) AS r2 FROM orders")
def manifest(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    built = prep.build_features(df, Grammar(id_columns=("o_orderkey",), target_columns=("o_totalprice",)), "o_totalprice")
    s = built.manifest["statistics"]
    return spark.createDataFrame([(built.manifest["rows"]["all"], built.manifest["n_features"], round(s["means"]["o_custkey"], 6), round(s["scales"]["o_custkey"], 6), round(built.manifest["ols"]["r2"], 6))], "rows long, n_features long, mean double, scale double, r2 double")


# --- formulas ---


def _evaluated(name: str, texts: list[str], digits: int = 4) -> None:
    sums = ", ".join(f"round(sum({sql(t, LINE)}), {digits}) AS s{i}, count({sql(t, LINE)})::BIGINT AS n{i}" for i, t in enumerate(texts))

    @query(name, f"SELECT l_returnflag, {sums} FROM lineitem GROUP BY l_returnflag")
    def run(spark, sf_dir):
        df, x = line(spark, sf_dir)
        columns = [formula.compile_column(t, x) for t in texts]
        return df.groupBy("l_returnflag").agg(*(c for i, v in enumerate(columns) for c in (F.round(F.sum(v), digits).alias(f"s{i}"), F.count(v).alias(f"n{i}"))))


_evaluated("formula_eval_core", ["q * d + t", "-(q - 3)^2 / 7", "|q - 25| * 0.5", "square(d) + cube(t) + 2**-1", "sqrt(q) + log(q + 1)"])
_evaluated("formula_eval_trig", ["sin(q) + cos(d)", "atan(q) - tanh(t)", "exp(-d) * pi", "cosh(d) + sinh(t)"])
_evaluated("formula_guards", ["q / d", "inv(t)", "log(d)", "log_abs(d)", "sqrt_abs(d - t)", "1 / (q - q)"])


@query("numeric_consistency", f"SELECT count(a)::BIGINT AS n, bool_and(abs(a - b) <= 1e-8 + 1e-6 * abs(b)) AS consistent FROM (SELECT f2 * l_quantity - f1 AS a, {sql('(q * d + t) * q - q * d', LINE)} AS b FROM (SELECT *, f1 + l_tax AS f2 FROM (SELECT *, l_quantity * l_discount AS f1 FROM lineitem)))")
def consistency(spark, sf_dir):
    df, x = line(spark, sf_dir)
    graph = lineage.Graph([lineage.Card("f1", "f1", "q * d"), lineage.Card("f2", "f2", "f1 + t")])
    got = graph.consistency(df, "f2 * q - f1", x)
    return spark.createDataFrame([(got["n"], got["consistent"])], "n long, consistent boolean")


@query("formula_complexity", "SELECT * FROM (VALUES ('a + b', 3, 2), ('a', 1, 1), ('a - b', 5, 2), ('a * a', 3, 1), ('(a + b) / c', 7, 3)) AS t(expression, nodes, variables)")
def complexities(spark, sf_dir):
    texts = ["a + b", "a", "a - b", "a * a", "(a + b) / c"]
    return spark.createDataFrame([(t, formula.complexity(t)["nodes"], formula.complexity(t)["variables"]) for t in texts], "expression string, nodes int, variables int")


@query("formula_similarity")
def formula_similarity(spark, sf_dir):
    """Likeness of formula pairs, worked on in partitions; rows only."""
    pairs = [("a + b", "b + a"), ("a * b", "a + b"), ("square(a)", "a * a"), ("sin(a)", "cos(a)"), ("a / b", "a * inv(b)")]
    return similarity.similarity_table(spark.createDataFrame(pairs, "pred string, truth string"))


# --- regression ---


@query("ols_metrics", "SELECT count(*)::BIGINT AS n, round(regr_r2(o_totalprice, o_custkey), 6) AS r2, round(sqrt(avg((o_totalprice - p) * (o_totalprice - p))), 2) AS rmse FROM (SELECT o_totalprice, o_custkey, regr_intercept(o_totalprice, o_custkey) OVER () + regr_slope(o_totalprice, o_custkey) OVER () * o_custkey AS p FROM orders)")
def ols(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    x, y = [F.col("o_custkey").cast("double")], F.col("o_totalprice")
    out = stats.regression_metrics(df, y, stats.linear(x, *stats.fit_linear(df, x, y)))
    return out.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"))


_FORMULA = "1000 * q + 500 * d"


@query("verify_formula", f"SELECT count(*)::BIGINT AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse FROM (SELECT {PRICE} AS y, {sql(_FORMULA, LINE)} AS p FROM lineitem)")
def verify(spark, sf_dir):
    df, x = line(spark, sf_dir)
    return experiments.verify(df, _FORMULA, x, F.col(PRICE)).select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"))


@query("fold_scores", "WITH f AS (SELECT o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x, ('0x' || substr(sha256('7|' || o_orderkey), 1, 12))::BIGINT % 3 AS fold FROM orders), m AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE fold <> k GROUP BY k) SELECT CAST(fold AS INTEGER) AS fold, count(*)::BIGINT AS n, round(1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)), 6) AS r2 FROM f JOIN m ON fold = k GROUP BY fold")
def fold_scores(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rows = df.join(splits.folds(df, "o_orderkey", 3), "o_orderkey")
    x = [F.col("o_custkey").cast("double")]
    got = [(k, (s := crossval.fold_score(rows, x, F.col("o_totalprice"), F.col("fold") != k, F.col("fold") == k))["n"], round(s["r2"], 6)) for k in range(3)]
    return spark.createDataFrame(got, "fold int, n long, r2 double")


@query("cv_honest_leaky")
def cv_gap(spark, sf_dir):
    """Honest and leaky cross-validation of the miner on orders; rows only."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("a"), (F.hour("o_orderdate") + F.dayofyear("o_orderdate")).cast("double").alias("b"))
    got = crossval.evaluate(df, {"a": F.col("a"), "b": F.col("b")}, F.col("o_totalprice"), "o_orderkey", mine.Options(base_top_k=2, pair_top_k=2, max_order=1), k=3, factor_keep=4)
    return spark.createDataFrame([("honest", got["honest"]["summary"]["r2_mean"]), ("leaky", got["leaky"]["summary"]["r2_mean"]), ("gap", got["gap"])], "measure string, value double")


@query("surrogate_search")
def surrogate(spark, sf_dir):
    """The surrogate engine on lineitem, scored on validation rows; rows only."""
    df, x = line(spark, sf_dir)
    records = search.score_archive(df, search.surrogate(df, x, F.col(PRICE), "l_orderkey", F.col("l_orderkey") % 5 < 3), x, F.col(PRICE), F.col("l_orderkey") % 5 == 3)
    return spark.createDataFrame([(r["equation"], r["r2_val"], r["complexity"]) for r in records], "equation string, r2_val double, nodes int")


@query("skeleton_fit", f"SELECT round(regr_slope(y, x), 3) AS p0, round(regr_intercept(y, x), 1) AS p1, round(regr_r2(y, x), 6) AS r2 FROM (SELECT {PRICE} AS y, {sql('q * (1 - d)', LINE)} AS x FROM lineitem)")
def skeleton(spark, sf_dir):
    """The parameters of a skeleton fitted to all of lineitem."""
    df, x = line(spark, sf_dir)
    got = search.fit_skeleton_table(df, "params[0] * q * (1 - d) + params[1]", x, F.col(PRICE))
    return spark.createDataFrame([(round(got["params"][0], 3), round(got["params"][1], 1), round(got["r2"], 6))], "p0 double, p1 double, r2 double")


@query("task_experiment")
def task_experiment(spark, sf_dir):
    """One task under all conditions with the surrogate engine; rows only."""
    got = experiments.run_task(spark, make_task("ratio", "v1 * v2", 2, rows=(120, 60, 60), points=50, irrelevant=2))
    return spark.createDataFrame([(r["method"], r.get("expression"), r.get("r2_test"), r.get("nodes")) for r in got["results"]], "method string, expression string, r2_test double, nodes int")


@query("synthetic_rows", "SELECT 5000::BIGINT AS n, true AS inside")
def synthetic(spark, sf_dir):
    """A generated table of any size: values depend on seed and row number alone."""
    df = scalable_task(spark, "a * b", [{"name": "a", "low": 1, "high": 3}, {"name": "b", "low": 2, "high": 4}], 5000)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("a").between(1, 3) & F.col("b").between(2, 4) & (F.abs(F.col("target") - F.col("a") * F.col("b")) < 1e-9)).alias("inside"))


# --- selection and history ---

_CANDIDATES_SQL = "(SELECT l_returnflag AS task, 'c' || l_linenumber AS candidate_id, round(0.9 + avg(l_discount), 6) AS r2_val, CAST(l_linenumber * 37 % 11 + 3 AS INTEGER) AS nodes, l_linenumber % 7 = 0 AS violation, l_linenumber % 2 = 0 AS domain, round(avg(l_tax), 4) AS stability FROM lineitem GROUP BY l_returnflag, l_linenumber)"


def candidates(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("task"), "l_linenumber").agg(F.round(0.9 + F.avg("l_discount"), 6).alias("r2_val"), F.round(F.avg("l_tax"), 4).alias("stability"))
    return df.select("task", F.concat(F.lit("c"), n).alias("candidate_id"), "r2_val", (n * 37 % 11 + 3).cast("int").alias("nodes"), (n % 7 == 0).alias("violation"), (n % 2 == 0).alias("domain"), "stability")


@query("selector_band", f"SELECT task, candidate_id, nodes FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY nodes, domain DESC, stability DESC, candidate_id) AS k FROM (SELECT *, max(r2_val) OVER (PARTITION BY task) - 0.02 AS threshold FROM {_CANDIDATES_SQL}) WHERE r2_val >= threshold - 1e-12 AND NOT violation) WHERE k = 1")
def selector(spark, sf_dir):
    return select.band_select(candidates(spark, sf_dir), ["task"]).select("task", "candidate_id", "nodes")


@query("standard_select", f"SELECT task, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY r2_val DESC, nodes, candidate_id) AS k FROM {_CANDIDATES_SQL}) WHERE k = 1")
def standard(spark, sf_dir):
    records = sorted((r.asDict() for r in candidates(spark, sf_dir).collect()), key=lambda r: (r["task"], r["candidate_id"]))
    best = [select.best_accuracy([r for r in records if r["task"] == task], "nodes") for task in sorted({r["task"] for r in records})]
    return spark.createDataFrame([(r["task"], r["candidate_id"]) for r in best], "task string, candidate_id string")


_HISTORY_SQL = "(SELECT l_returnflag AS target, 'x' || (l_suppkey % 9) AS expression, CASE WHEN l_linenumber > 2 THEN round(l_discount * 10, 3) END AS r2, round(l_tax, 3) AS score, round(l_quantity, 3) AS loss, CAST(l_linenumber AS DOUBLE) AS complexity FROM lineitem)"
_HISTORY_ORDER = "r2 DESC NULLS LAST, score DESC NULLS LAST, loss ASC NULLS LAST, complexity ASC NULLS LAST, expression"


@query("expression_list_topk", f"SELECT target, expression, r2, score, loss, complexity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_HISTORY_ORDER}) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target, expression ORDER BY {_HISTORY_ORDER}) AS n FROM {_HISTORY_SQL}) WHERE n = 1) WHERE rank <= 4")
def history(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    rows = df.select(F.col("l_returnflag").alias("target"), F.concat(F.lit("x"), F.col("l_suppkey") % 9).alias("expression"), F.when(F.col("l_linenumber") > 2, F.round(F.col("l_discount") * 10, 3)).alias("r2"), F.round("l_tax", 3).alias("score"), F.round("l_quantity", 3).alias("loss"), F.col("l_linenumber").cast("double").alias("complexity"))
    return files.expression_list(rows, 4)


@query("method_summary", "SELECT l_shipmode AS method, count(*)::BIGINT AS n, round(avg(r2), 6) AS mean_r2_test, round(median(r2), 6) AS median_r2_test, round(avg(CASE WHEN eq THEN 1.0 ELSE 0.0 END), 6) AS equivalence_rate FROM (SELECT l_linestatus || l_returnflag AS l_shipmode, l_discount AS r2, l_tax > 0.04 AS eq FROM lineitem) GROUP BY l_shipmode")
def method_summary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("method"), F.col("l_discount").alias("r2_test"), F.col("l_tax").alias("similarity"), F.col("l_quantity").alias("nodes"), (F.col("l_tax") > 0.04).alias("equivalent"))
    return experiments.compare(df).select("method", "n", *(F.round(c, 6).alias(c) for c in ("mean_r2_test", "median_r2_test", "equivalence_rate")))


@query("one_per_task_method", "SELECT task_id, method, seed FROM (SELECT *, row_number() OVER (PARTITION BY task_id, method ORDER BY seed, expression) AS n FROM (SELECT DISTINCT l_suppkey AS task_id, l_returnflag AS method, l_partkey AS seed, 'e' AS expression FROM lineitem)) WHERE n = 1")
def one_per_task(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task_id"), F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("seed"), F.lit("e").alias("expression")).distinct()
    return experiments.one_per_task(df).select("task_id", "method", "seed")


# --- ratings ---

_D = ratings.DIMENSIONS
_RATED = "(SELECT doc_id % 200 AS item, 'item_' || (doc_id % 200) AS item_id, 'rater_' || (doc_id // 200 % 3) AS rater_id, CASE WHEN doc_id // 200 % 3 = 0 THEN 'human' ELSE 'llm' END AS grp, " + ", ".join(f"CAST((doc_id * {7 + 2 * i} + doc_id // 200 * {i + 3}) % 5 + 1 AS DOUBLE) AS {d}" for i, d in enumerate(_D)) + ", (" + " + ".join(f"CAST((doc_id * {7 + 2 * i} + doc_id // 200 * {i + 3}) % 5 + 1 AS DOUBLE)" for i in range(4)) + ") / 4.0 AS overall FROM documents)"


def rated(spark, sf_dir) -> DataFrame:
    doc, block = F.col("doc_id"), F.floor(F.col("doc_id") / 200)
    df = table(spark, sf_dir, "documents")
    return df.select(F.concat(F.lit("item_"), doc % 200).alias("item_id"), F.concat(F.lit("rater_"), block % 3).alias("rater_id"), F.when(block % 3 == 0, "human").otherwise("llm").alias("grp"), *(((doc * (7 + 2 * i) + block * (i + 3)) % 5 + 1).cast("double").alias(d) for i, d in enumerate(_D)))


@query("rating_group_means", f"SELECT grp, count(*)::BIGINT AS n, {', '.join(f'round(avg({d}), 6) AS {d}' for d in (*_D, 'overall'))} FROM {_RATED} GROUP BY grp")
def rating_means(spark, sf_dir):
    return ratings.group_means(rated(spark, sf_dir), "grp").select("grp", "n", *(F.round(d, 6).alias(d) for d in (*_D, "overall")))


@query("rating_inter_rater", f"WITH m AS (SELECT item_id, rater_id, avg(overall) AS v FROM {_RATED} GROUP BY ALL), p AS (SELECT a.rater_id AS ra, b.rater_id AS rb, CASE WHEN count(*) >= 2 AND stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN corr(a.v, b.v) END AS r, avg(abs(a.v - b.v)) AS g FROM m a JOIN m b ON a.item_id = b.item_id AND a.rater_id < b.rater_id GROUP BY ALL) SELECT (SELECT count(DISTINCT rater_id) FROM m)::BIGINT AS raters, count(*)::BIGINT AS pairs, round(avg(r), 6) AS mean_pearson, round(avg(g), 6) AS mean_abs_diff FROM p")
def inter_rater(spark, sf_dir):
    return ratings.inter_rater(rated(spark, sf_dir)).select("raters", "pairs", F.round("mean_pearson", 6).alias("mean_pearson"), F.round("mean_abs_diff", 6).alias("mean_abs_diff"))


_BOTH = f"(SELECT h.item_id, h.v AS a, l.v AS b FROM (SELECT item_id, avg(overall) AS v FROM {_RATED} WHERE grp = 'human' GROUP BY 1) h JOIN (SELECT item_id, avg(overall) AS v FROM {_RATED} WHERE grp = 'llm' GROUP BY 1) l USING (item_id))"


def _rounded(value: float) -> float | None:
    return None if value != value else round(value, 6)


def agreed(spark, sf_dir) -> dict:
    df = rated(spark, sf_dir)
    return ratings.agreement(*(df.where(F.col("grp") == g) for g in ("human", "llm")))


@query("rating_spearman", f"SELECT count(*)::BIGINT AS n, round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM {_BOTH})")
def rating_spearman(spark, sf_dir):
    got = agreed(spark, sf_dir)
    return spark.createDataFrame([(got["n_common"], _rounded(got["spearman"]))], "n long, rho double")


@query("rating_pairwise", f"WITH x AS (SELECT * FROM {_BOTH}) SELECT count(*)::BIGINT AS pairs, round(avg(CASE WHEN (p.a < q.a) = (p.b < q.b) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM x p JOIN x q ON p.item_id < q.item_id AND p.a <> q.a AND p.b <> q.b")
def rating_pairwise(spark, sf_dir):
    got = agreed(spark, sf_dir)
    return spark.createDataFrame([(got["pairs"], _rounded(got["pairwise"]))], "pairs long, agreement double")


@query("pairwise_continuous", "WITH x AS (SELECT c_custkey AS i, c_acctbal AS a, sin(c_custkey) * 1000 + c_acctbal AS b FROM customer) SELECT count(*)::BIGINT AS pairs, round(avg(CASE WHEN (p.a < q.a) = (p.b < q.b) THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM x p JOIN x q ON p.i < q.i AND p.a <> q.a AND p.b <> q.b")
def pairwise_continuous(spark, sf_dir):
    """Agreement of two measures with as many values as rows; no pair of rows is made."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), (F.sin(F.col("c_custkey")) * 1000 + F.col("c_acctbal")).alias("b"))
    return stats.pairwise_agreement(df, "c_custkey", "a", "b").select("pairs", F.round("agreement", 9).alias("agreement"))


@query("spearman_continuous", "SELECT count(*)::BIGINT AS n, round(corr(ra, rb), 9) AS rho FROM (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ra, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rb FROM lineitem)")
def spearman_continuous(spark, sf_dir):
    return stats.spearman(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity").select("n", F.round("rho", 9).alias("rho"))


@query("rating_unblind", f"SELECT method, round(avg(overall), 6) AS mean_overall, count(*)::BIGINT AS n FROM (SELECT *, CASE item % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'mined' ELSE 'selector' END AS method FROM {_RATED} WHERE item < 150) GROUP BY method")
def rating_unblind(spark, sf_dir):
    private = {f"item_{i}": {"method": ("raw", "mined", "selector")[i % 3]} for i in range(150)}
    return ratings.unblind(rated(spark, sf_dir), private).select("method", F.round("mean_overall", 6).alias("mean_overall"), "n")


_ANSWER = ", ".join(f"\"{d}\": %s" for d in _D)


@query("rating_strict_parse", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'item' WHEN 2 THEN 'dimensions' ELSE 'values' END AS error FROM documents")
def strict_parse(spark, sf_dir):
    """Answers for the right item, for another, with a dimension too few, and with a value out of range."""
    kind = F.col("doc_id") % 4
    item = F.concat(F.lit("i"), F.col("doc_id"))
    body = F.when(kind == 2, f'"{_D[0]}": 3').when(kind == 3, _ANSWER % (1, 2, 3, 6)).otherwise(_ANSWER % (1, 2, "4.0", 5))
    df = table(spark, sf_dir, "documents").select("doc_id", item.alias("item_id"), F.concat(F.lit('{"item_id": "'), F.when(kind == 1, "other").otherwise(item), F.lit('", "ratings": {'), body, F.lit("}}")).alias("answer"))
    return ratings.parse_answers(df).select("doc_id", "error")


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark, sf_dir):
    return ratings.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("bootstrap_ci", "SELECT count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, true AS as_expected FROM orders")
def bootstrap(spark, sf_dir):
    """Bootstrap interval of a mean with Poisson weights: as wide as 1.96 standard errors each way, within a third."""
    df = table(spark, sf_dir, "orders")
    got = stats.bootstrap_by_weights(df, F.col("o_totalprice"), F.col("o_orderkey"))
    error = df.agg((F.stddev_pop("o_totalprice") / F.sqrt(F.count(F.lit(1)))).alias("e")).scalar()
    fine = ((F.col("mean") - F.col("low")) / error).between(1.3, 2.7) & ((F.col("high") - F.col("mean")) / error).between(1.3, 2.7)
    return got.select("n", F.round("mean", 4).alias("mean"), fine.alias("as_expected"))


@query("rating_intervals", f"SELECT grp, dimension, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, true AS inside FROM (UNPIVOT (SELECT grp, {', '.join((*_D, 'overall'))} FROM {_RATED}) ON {', '.join((*_D, 'overall'))} INTO NAME dimension VALUE value) GROUP BY ALL")
def rating_intervals(spark, sf_dir):
    """Means of each dimension by group, each inside its bootstrap interval."""
    got = ratings.group_intervals(rated(spark, sf_dir), ["grp"], draws=100)
    return got.select("grp", "dimension", "n", F.round("mean", 6).alias("mean"), (F.col("mean").between(F.col("low"), F.col("high")) & ((F.col("high") > F.col("low")) | (F.col("n") == 1))).alias("inside"))


@query("rating_candidates", "SELECT formula, method, seed, task_context, dataset_label, '[0,' || CAST(b AS INTEGER) || ']' AS first_range FROM (SELECT 'e' || l_linenumber AS formula, l_returnflag AS method, l_partkey AS seed, 'Find the relation behind the target y. Domain: ' || s_name || '.' AS task_context, 'task_' || substr(CAST(l_suppkey AS VARCHAR), 1, 3) AS dataset_label, s_nationkey AS b, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_partkey, 'e' || l_linenumber) AS n FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber <> 1) JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 3) WHERE n = 1")
def rating_items(spark, sf_dir):
    """Runs joined with the catalogue of tasks: runs without a formula and tasks that it lacks have no item."""
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task_id"), F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("seed"), F.when(F.col("l_linenumber") != 1, F.concat(F.lit("e"), "l_linenumber")).alias("expression"), F.lit("").alias("expanded_expression"), F.lit(0.5).alias("r2_test")).distinct()
    catalogue = table(spark, sf_dir, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").alias("task_id"), F.col("s_name").alias("name"), F.array(F.struct(F.lit("x").alias("name"), F.lit(0).alias("low"), F.col("s_nationkey").cast("int").alias("high"), F.lit("m").alias("meaning"))).alias("variables"))
    return experiments.rating_candidates(runs, catalogue).select("formula", "method", "seed", "task_context", "dataset_label", F.col("variables")[0]["allowed_range"].alias("first_range"))


@query("blind_export", " UNION ALL ".join(f"SELECT '{t}' AS formula, true AS hidden" for t in order_one(list(LINE))))
def blind(spark, sf_dir):
    """Items of formulas with their origin hidden behind unlike ids."""
    texts = order_one(list(LINE))
    items, private = ratings.export_blind([{"formula": t, "method": "mined", "label": "lineitem"} for t in texts], seed=3)
    ids = spark.createDataFrame([(i.item_id, i.formula, private[i.item_id]["orig_index"]) for i in items], "item_id string, formula string, at long")
    once = ids.groupBy("item_id").agg(F.count(F.lit(1)).alias("k"))
    return ids.join(once, "item_id").select("formula", (F.col("item_id").rlike("^item_[0-9a-f]{16}$") & (F.col("k") == 1)).alias("hidden"))
