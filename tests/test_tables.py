"""Grammar, preprocessing, statistics, splits and leakage."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.numeric import to_double
from factorloom.operators import grammar, mine, prep, splits, stats


def noisy(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 2 * x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.05
    return pd.DataFrame({"sample_id": [f"s{i:03d}" for i in range(n)], "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": y})


def test_numbers_from_text(spark):
    rows = [" 1.5 ", "1e5", "inf", "", "1.5d", "nan", None, "-.5", "0x10"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "v string").coalesce(1).select(to_double(F.col("v"))).collect()]
    assert got == [1.5, 1e5, None, None, None, None, None, -0.5, None]


def test_grammar_small(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 5.0, 1.0), ("b", None, 3.0, 5.0, 2.0), ("c", 3.0, 5.0, 5.0, 4.0), ("d", 4.0, 1.0, 5.0, 3.0)], "sample_id string, `x one` double, `x-two` double, drop_me double, y double")
    g = grammar.Grammar(target_columns=("y",), exclude_columns=("drop_me",))
    table = prep.build_features(df, g, "y")
    assert len(table.features) == 3
    assert table.state.names == {"x one": "raw_x_one", "x-two": "raw_x_two"}
    assert table.state.indicators == {"x one": "raw_x_one_missing"}
    got = table.frame.orderBy("row_id").toPandas()
    assert got["raw_x_one"].to_numpy() == pytest.approx((np.array([1, 3, 3, 4]) - 2.75) / np.std([1, 3, 3, 4]))


def test_names_collide_within_length():
    taken = set()
    names = [grammar.safe_name("a b", taken, "p_", 6), grammar.safe_name("a-b", taken, "p_", 6), grammar.safe_name("a_b", taken, "p_", 5), grammar.safe_name("9!", taken, ""), grammar.safe_name("!!", taken, "")]
    assert names == ["p_a_b", "p_a__2", "p_a_2", "x_9", "x"]
    assert grammar.safe_name("ab_!_cd", set(), "raw_", 8) == "raw_ab" and grammar.safe_name("abc_def", set(), "raw_", 8) == "raw_abc"


@pytest.mark.parametrize("policy", ["median", "mean", "zero"])
def test_fill_then_scale(spark, policy):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in (1, 2, None, 9, math.inf)], "v double")
    state = prep.fit(df, ["v"], grammar.Grammar(missing_policy=policy))
    value = {"median": 2.0, "mean": 4.0, "zero": 0.0}[policy]
    filled = np.array([1, 2, value, 9, value])
    assert state.fills["v"] == pytest.approx(value)
    assert state.scales["v"] == pytest.approx(filled.std()) and state.means["v"] == pytest.approx(filled.mean())


def test_constant_all_null_and_duplicate_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (3.0, None, 5.0)], "a double, n double, c double")
    state = prep.fit(df, ["a", "n", "c"], grammar.Grammar())
    assert state.columns == ["a"] and state.dropped == {"n": "constant", "c": "constant"}


def test_guarded_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, 5.0, 3.0), (None, 1.0, 3.0)], "x double, y double, c double")
    row = df.agg(stats.guarded_corr(F.col("x"), F.col("y")).alias("r"), stats.guarded_corr(F.col("c"), F.col("y")).alias("z")).first()
    assert row["r"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1]) and row["z"] == 0.0


def test_moments_survive_large_means(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=4000), rng.normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"i": range(4000), "x": x + 1e8, "y": x * 0.1 + y})).repartition(7)
    m = stats.formula_moments(df, ["x", "-x", "x * 2 + 3", "1 / (x - x)"], {"x": F.col("x")}, F.col("y"), F.col("i"))
    want = np.corrcoef(x, x * 0.1 + y)[0, 1]
    assert m["signed"][0] == pytest.approx(want, abs=1e-6) and m["signed"][1] == pytest.approx(-want, abs=1e-6)
    assert abs(m["print0"][0] - m["print0"][2]) < 1e-7 and m["print0"][0] == pytest.approx(-m["print0"][1], abs=1e-7)
    assert m["valid"][3] == 0 and m["score"][3] == 0


def test_least_squares_with_twins(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": a * 2, "y": 3 * a + 1}))
    columns = [F.col("a"), F.col("b")]
    fit = stats.fit_linear(df, columns, F.col("y"))
    got = stats.regression_metrics(df, F.col("y"), stats.linear(columns, *fit)).first()
    assert got["r2"] == pytest.approx(1) and fit[0] == pytest.approx(1)


def test_metrics_of_few_and_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "y double, p double")
    assert stats.regression_metrics(df, F.col("y"), F.col("p")).first()["r2"] is None
    assert stats.regression_metrics(df.limit(2), F.col("y"), F.col("p")).first()["rmse"] is None


def test_ranks_and_pairs(spark):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate([(1, 2), (2, 1), (2, 3), (4, 4)])], "i int, a double, b double")
    ranks = [r["r"] for r in df.select("i", stats.average_rank("a").alias("r")).orderBy("i").collect()]
    assert ranks == [1, 2.5, 2.5, 4]
    assert stats.spearman(df, "a", "b").first()["rho"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [2, 1, 3, 4])[0, 1])
    got = stats.pairwise_agreement(df, "i", "a", "b").first()
    assert (got["pairs"], got["agreement"]) == (5, 0.8)


def test_bootstrap_edges():
    assert all(map(math.isnan, stats.bootstrap_interval(np.array([]))))
    assert stats.bootstrap_interval(np.array([3.0])) == (3.0, 3.0)
    low, high = stats.bootstrap_interval(np.arange(100.0))
    assert low < 49.5 < high


def test_hash_roles_match_a_sort(spark):
    df = spark.createDataFrame([(i,) for i in range(137)], "k long")
    got = {r["k"]: r["role"] for r in splits.hash_roles(df, "k", 3).collect()}
    import hashlib

    order = sorted(range(137), key=lambda i: hashlib.sha256(f"3|{i}".encode()).hexdigest())
    a, b, _ = splits.counts(137, splits.fractions())
    assert got == {k: "train" if i < a else "validation" if i < a + b else "test" for i, k in enumerate(order)}


@pytest.mark.parametrize("parts", [(1, 0, 0), (0, 0, 1), (0.5, 0, 0.5), (0, 1, 0)])
def test_hash_roles_of_whole_tables(spark, parts):
    df = spark.createDataFrame([(i,) for i in range(10)], "k long")
    roles = [r["role"] for r in splits.hash_roles(df, "k", 1, splits.fractions(*parts)).collect()]
    assert [roles.count(r) for r in splits.ROLES] == list(splits.counts(10, splits.fractions(*parts)))


def test_groups_stay_whole_and_manifest_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i:03d}", f"m{i % 5}") for i in range(40)], "sample_id string, material string")
    roles = splits.group_roles(df, "sample_id", "material").join(df, "sample_id").groupBy("material").agg(F.countDistinct("role").alias("n")).collect()
    assert all(r["n"] == 1 for r in roles)
    m = splits.build_manifest(df, ("sample_id",), seed=4, group="material")
    m.save(tmp_path / "m.json")
    assert splits.Manifest.load(tmp_path / "m.json").digest() == m.digest()
    assert splits.build_manifest(df, ("sample_id",), seed=4, group="material").roles == m.roles
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text().replace("s001", "s9"))
    with pytest.raises(ValueError):
        splits.Manifest.load(tmp_path / "m.json")
    with pytest.raises(ValueError):
        splits.build_manifest(df.unionByName(df), ("sample_id",))


def test_folds():
    got = splits.exact_folds(10, 3, 1)
    assert [len(g) for g in got] == [4, 3, 3] and sorted(np.concatenate(got)) == list(range(10))


@pytest.mark.parametrize("corrupt", ["features", "labels"])
def test_test_rows_leak_nothing(spark, corrupt):
    data = noisy(spark)
    roles = np.where(np.arange(60) % 3 == 0, "test", "train")
    bad = data.copy()
    if corrupt == "features":
        bad.loc[roles == "test", ["x1", "x2", "x3"]] *= 1e6
    else:
        bad.loc[roles == "test", "y"] = bad["y"] * 1000 + 12345
    made = []
    for d in (data, bad):
        df = spark.createDataFrame(d.assign(role=roles))
        t = prep.build_features(df.drop("role").join(df.select("sample_id", F.col("role").alias("r")), "sample_id"), grammar.Grammar(target_columns=("y",), exclude_columns=("r",)), "y", F.col("r"))
        o = mine.Options(max_order=1, stats_scope="train", final_top_k=12)
        x = {n: F.col(n) for n in t.features}
        found, _ = mine.mine(t.frame, x, F.col("target"), F.col("row_id"), o, F.col("role") == "train")
        made.append((t.manifest["statistics"], t.manifest["scores"], [(c.expression, round(c.score, 9)) for c in found]))
    assert made[0][0]["means"] == pytest.approx(made[1][0]["means"]) and made[0][1] == pytest.approx(made[1][1])
    assert made[0][2] == made[1][2]


def test_union_collisions(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "k int, same double, other double")
    b = spark.createDataFrame([(2, 3.0, 9.0), (1, 1.0, 8.0)], "k int, same double, other double")
    frame, names = prep.union_sources(a, b, "k", "b")
    assert frame.columns == ["k", "same", "other", "b__other"] and names == {"other": "b__other"}
    with pytest.raises(ValueError):
        prep.union_sources(a, b.limit(1), "k", "b")


def test_too_few_targets(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "id string, y double")
    with pytest.raises(ValueError):
        prep.finite_target(df, "y")


def test_grammar_sections():
    g = grammar.Grammar.from_config({"targets": ["y"], "id_columns": ["k"], "target_rules": {"exclude": ["t"]}, "feature_rules": {"exclude": "z", "numeric_only": False}, "missing": {"fill": "mean", "add_indicators": False}, "naming": {"safe_prefix": "f_", "max_length": 9}})
    assert (g.target_columns, g.id_columns, g.exclude_targets, g.exclude_columns) == (("y",), ("k",), ("t",), ("z",))
    assert (g.missing_policy, g.missing_indicators, g.numeric_only, g.feature_prefix, g.max_name_length) == ("mean", False, False, "f_", 9)
    with pytest.raises(ValueError):
        grammar.Grammar.from_config({"missing": {"fill": "mode"}})
