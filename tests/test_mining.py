"""Mining, pools, cross-validation, lineage, selection, similarity and search."""

import json
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.operators import crossval, lineage, mine, select, similarity, stats
from factorloom.plans import experiments, search
from factorloom.sources.synthetic import make_task


@pytest.fixture(scope="module")
def product(spark):
    rng = np.random.default_rng(0)
    x1 = np.linspace(-2, 2, 30)
    x2 = 1.5 + np.sin(np.arange(30))
    df = spark.createDataFrame(pd.DataFrame({"id": range(30), "x1": x1, "x2": x2, "y": x1 * x2 + rng.normal(size=30) * 0.01})).cache()
    return df, {"x1": F.col("x1"), "x2": F.col("x2")}


def brute(df, x, order):
    """Scores of all valid formulas of an order by numpy."""
    pdf = df.toPandas()
    cols = {n: pdf[n].to_numpy() for n in x}
    out = {}
    for t in order:
        v = formula.evaluate(t, cols, len(pdf))
        if np.isfinite(v).all() and v.std() > 1e-12:
            out[t] = abs(np.corrcoef(v, pdf["y"])[0, 1])
    return out


def test_product_is_found_and_scores_are_right(product):
    df, x = product
    found, manifest = mine.mine(df, x, F.col("y"), F.col("id"), mine.Options(max_order=1))
    assert "*" in found[0].expression and found[0].score > 0.99
    want = brute(df, x, [c.expression for c in found])
    assert all(c.score == pytest.approx(want[c.expression], abs=1e-9) for c in found)
    assert manifest["kept"] == len(found) and found == sorted(found, key=lambda c: (-c.score, c.id))


def test_equal_values_enter_once(spark):
    df = spark.createDataFrame([(i, float(i + 1), float(2 * i + 2), float(i * i)) for i in range(20)], "id int, a double, b double, y double")
    found, _ = mine.mine(df, {"a": F.col("a"), "b": F.col("b")}, F.col("y"), F.col("id"), mine.Options(max_order=1, unary_ops=("abs", "square"), binary_ops=("*",)))
    # b = 2 a, so that b, abs, and all products but one repeat earlier values.
    assert sorted(c.expression for c in found) == ["a", "square(a)"]


def test_proposals(product):
    df, x = product
    got = mine.proposal_status(df, x, F.col("y"), F.col("id"), [{"name": "ok", "expression": "x1 * x2"}, {"name": "ok", "expression": "x1 - x1"}, {"name": "c", "expression": "zz"}, {"name": "d", "expression": "os.system"}])
    assert list(got["status"]) == ["kept", "dropped", "error", "error"] and list(got["name"])[:2] == ["llmprop_ok", "llmprop_ok_2"]


def test_pool_follows_the_selection(tmp_path):
    factors = [{"factor_name": f"m{i}", "expression": e, "score": 1 - i / 10} for i, e in enumerate(["a * b", "a + b", "a / b"])]
    raw = [{"feature": "a", "score": 0.5}, {"feature": "b", "score": 0.5}]
    assert mine.build_pool(factors, raw, None, raw_keep=1, factor_top_k=2)[0] == ["b"]
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"selected_factors": [{"expression": "b*a"}, {"factor_name": "m2", "final_formula_allowed": False}, {"factor_name": "no"}]}))
    _, pool, manifest = mine.build_pool(factors, raw, mine.read_selection(path))
    assert [p["factor_name"] for p in pool] == ["m0", "m2"] and [p["final_formula_allowed"] for p in pool] == [True, False]
    assert len(manifest["unmatched"]) == 1 and manifest["final_formula_allowed"] == 1
    _, pool, manifest = mine.build_pool(factors, raw, [], fallback_top_k=1)
    assert len(pool) == 1 and manifest["warnings"]


def test_honest_is_below_leaky_on_noise(spark):
    rng = np.random.default_rng(11)
    data = pd.DataFrame({f"n{i}": rng.normal(size=120) for i in range(25)}).assign(id=range(120), y=rng.normal(size=120))
    df = spark.createDataFrame(data)
    x = {f"n{i}": F.col(f"n{i}") for i in range(25)}
    got = crossval.evaluate(df, x, F.col("y"), "id", mine.Options(base_top_k=25, pair_top_k=25, max_order=1, unary_ops=(), binary_ops=("*",)), k=3, raw_keep=0, factor_keep=12)
    assert got["leaky"]["summary"]["r2_mean"] > got["honest"]["summary"]["r2_mean"] and got["gap"] > 0.05 and got["honest"]["summary"]["r2_mean"] < 0.2
    with pytest.raises(NotImplementedError):
        crossval.evaluate(df, x, F.col("y"), "id", mine.Options(), model="pysr")


def test_lineage():
    g = lineage.Graph([lineage.Card("f1", "ratio", "a / b"), lineage.Card("f2", "twice", "ratio * 2 + c")])
    assert formula.canonical(g.expand("twice - c")) == formula.canonical("2 * a / b")
    assert g.variables("twice") == ["a", "b", "c"] and ("f2", "f1") in g.edges()
    with pytest.raises(lineage.LineageError):
        lineage.Graph([lineage.Card("x", "x", "y + 1"), lineage.Card("y", "y", "x")]).expand("x")
    with pytest.raises(lineage.LineageError):
        lineage.Card("", "n", "a")
    with pytest.raises(lineage.LineageError):
        lineage.Card("i", "n", "a", source="rumour")


def test_consistency_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0), (4.0, 0.5)], "a double, b double")
    x = {"a": F.col("a"), "b": F.col("b")}
    g = lineage.Graph([lineage.Card("f", "f", "a * b")])
    assert g.consistency(df, "f + a", x)["consistent"]
    text = lineage.unscale("a + ab", {"a": 2.0}, {"a": 4.0})
    assert formula.canonical(text) == formula.canonical("(a - 2) / 4 + ab")


def pick(*rows, **kw):
    got = select.interpretability_first(select.choices([dict(zip(("candidate_id", "expression", "r2_val"), r[:3], strict=False)) | (r[3] if len(r) > 3 else {}) for r in rows]), **kw)
    return got["selected"].candidate_id if got["selected"] else None


def test_selector_rules():
    assert pick(("a", "x * y + z * w", 0.90), ("b", "x", 0.88)) == "b"  # the band's edge counts
    assert pick(("a", "x * y", 0.90), ("b", "x", 0.8799)) == "a"
    assert pick(("a", "x + y", 0.9, {"r2_test": -5}), ("b", "x * y", 0.9, {"r2_test": 1})) == "a"
    assert pick(("a", "x + y", 0.9), ("b", "x * y", 0.9, {"uses_domain_factor": True})) == "b"
    assert pick(("a", "x + y", 0.9, {"stability": 0.1}), ("b", "x * y", 0.9, {"stability": 0.9})) == "b"
    assert pick(("a", "x", float("nan")), ("b", "x + y", 0.5)) == "b"
    assert pick(("a", "leak", 0.99), ("b", "x", 0.5), leakage={"leak"}) is None  # the leaking one sets the band
    assert pick(("a", "", 0.9), ("b", "x +", 0.9)) is None and pick() is None


def test_alias_nodes_count_expanded():
    g = lineage.Graph([lineage.Card("f", "f", "a * b * c * d")])
    assert pick(("alias", "f", 0.9), ("plain", "a + b", 0.9), graph=g) == "plain"


def test_similarity():
    same = similarity.report("a * b", "b * a")
    assert same["overall"] == pytest.approx(1) and same["algebraic_equivalent"] and same["numeric_equivalent"]
    other = similarity.report("sin(a)", "a * b")
    assert 0 <= other["overall"] < 0.7 and not other["algebraic_equivalent"]
    assert similarity.report("a +", "a")["overall"] < 1 and similarity.set_f1(set(), set()) == 1.0


def test_skeletons():
    rng = np.random.default_rng(0)
    x = {"v": rng.uniform(1, 3, 80)}
    y = 2 * np.exp(-0.7 * x["v"]) + 0.5
    got = search.fit_skeleton("params[0] * exp(params[1] * v) + params[2]", x, y)
    assert got["r2"] > 0.9999 and "params" not in got["expression"]
    assert search.fit_skeleton("__import__('os')", x, y)["error"]
    answers = iter(['{"skeleton": "params[0] * v"}', "nonsense", '```json\n{"skeleton": "params[0] * exp(params[1] * v) + params[2]"}\n```'])
    best = search.skeleton_search(lambda p: next(answers), ["v"], {}, x, y, iterations=3)
    assert best[0]["r2"] > 0.999 and len(best) == 3
    assert search.direct_formula(lambda p: "y = 2 * v", ["v"], {}) == "2 * v"


def test_task_run_and_resume(spark, tmp_path):
    task = make_task("prod", "v1 * v2", 2, rows=(80, 40, 40), points=20, irrelevant=1, noise=0.01)
    got = experiments.run_all(spark, [task], tmp_path / "log.jsonl")
    assert {r["method"] for r in got} == set(experiments.CONDITIONS)
    assert max(r["r2_test"] for r in got) > 0.95
    assert len(experiments.run_all(spark, [task], tmp_path / "log.jsonl")) == len(got)


def test_task_sampler():
    pool = [{"task_id": f"t{i:02d}", "n_variables": i % 4 + 1, "node_count": 3 + i, "operators": ["+"] if i else ["sin"]} for i in range(25)]
    a, b = experiments.sample_tasks(pool), experiments.sample_tasks(pool)
    assert a == b and len(a) == 20 and any("sin" in t["operators"] for t in a)


def test_reserved_names():
    task = make_task("r", "S * beta", [{"name": "S", "low": 1, "high": 2}, {"name": "beta", "low": 1, "high": 2}], rows=(10, 5, 5), points=5)
    assert task.names == ["var_S", "var_beta"] and task.expression == "(var_S * var_beta)"


def test_external_engine(spark, tmp_path):
    """A program of its own gets the training rows and options; its equations are scored here, its failures are told."""
    program = tmp_path / "engine.py"
    program.write_text(
        "import csv, json, sys, pathlib\n"
        "place = pathlib.Path(sys.argv[1])\n"
        "options = json.loads((place / 'run_config.json').read_text())\n"
        "rows = list(csv.reader((place / 'features.csv').open()))\n"
        "assert options['maxsize'] == 9 and options['populations'] == 32 and rows[0] == ['a', 'b'] and len(rows) == 31, rows[:2]\n"
        "(place / 'model_equations_snapshot.csv').write_text('Complexity,Loss,Equation\\n3,0.5,a * b\\n1,2,a\\n')\n"
    )
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float((i % 7) * (i % 5))) for i in range(40)], "k long, a double, b double, y double")
    x, train = {"a": F.col("a"), "b": F.col("b")}, F.col("k") < 30
    engine = search.external([sys.executable, str(program)], tmp_path / "work", {"maxsize": 9})
    got = search.run_search(df, x, F.col("y"), "k", engine, train, ~train, tmp_path / "out")
    assert (got["status"], got["best_equation"], got["best_r2"]) == ("success", "a * b", 1.0) and 0 < got["linear_r2"] < 1 and got["equations"][0]["loss"] == 0.5
    assert (tmp_path / "out" / search.SNAPSHOT).exists()
    program.write_text("raise SystemExit(3)")
    with pytest.raises(RuntimeError):
        search.run_search(df, x, F.col("y"), "k", engine, train, ~train, tmp_path / "out")
    assert json.loads((tmp_path / "out" / "best_result.json").read_text())["status"] == "error"
    with pytest.raises(ValueError):
        search.external([sys.executable, str(program)], tmp_path / "work", most_rows=5)(df, x, F.col("y"), "k", None)


def test_skeleton_over_a_table(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(1, 3, 5000), rng.uniform(1, 3, 5000)
    df = spark.createDataFrame([(float(x), float(z), float(2.5 * x / (z + 0.7) + 1)) for x, z in zip(a, b, strict=True)] + [(1.0, 2.0, None)], "a double, b double, y double").repartition(5)
    got = search.fit_skeleton_table(df, "params[0] * a / (b + params[1]) + params[2]", {"a": F.col("a"), "b": F.col("b")}, F.col("y"), sample=300)
    assert got["params"] == pytest.approx([2.5, 0.7, 1], rel=1e-4) and got["r2"] > 0.999999
    assert search.fit_skeleton_table(df, "a + nothing(", {"a": F.col("a")}, F.col("y"))["error"]


def test_ranks_and_pairs_against_brute_force(spark):
    rng = np.random.default_rng(8)
    for n, values in ((300, 12), (400, 10**6), (3, 2), (1, 1)):
        a, b = rng.integers(0, values, n).astype(float), rng.integers(0, values, n).astype(float)
        b = np.where(rng.random(n) < 0.6, a, b)
        df = spark.createDataFrame([(i, float(x), float(z)) for i, (x, z) in enumerate(zip(a, b, strict=True))] + [(n, None, 1.0)], "i long, a double, b double")
        pairs = [(a[i] < a[j], b[i] < b[j]) for i in range(n) for j in range(i) if a[i] != a[j] and b[i] != b[j]]
        got = stats.pairwise_agreement(df, "i", "a", "b").first()
        assert got["pairs"] == len(pairs)
        assert got["agreement"] == (pytest.approx(np.mean([x == y for x, y in pairs])) if pairs else None)
        ranks = [pd.Series(x).rank().to_numpy() for x in (a, b)]
        rho = stats.spearman(df, "a", "b").first()
        assert rho["n"] == n
        if n > 3:
            assert rho["rho"] == pytest.approx(np.corrcoef(*ranks)[0, 1])


def test_bootstrap_by_group(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 10) if i != 5 else None) for i in range(2000)], "i long, g string, v double").repartition(4)
    got = {r["g"]: r for r in stats.bootstrap_by_weights(df, F.col("v"), F.col("i"), 200, 1, ["g"]).collect()}
    for g, r in got.items():
        v = np.array([float(i % 10) for i in range(2000) if "ab"[i % 2] == g and i != 5])
        error = v.std() / np.sqrt(len(v))
        assert r["n"] == len(v) and r["mean"] == pytest.approx(v.mean())
        assert 1.3 < (r["mean"] - r["low"]) / error < 2.7 and 1.3 < (r["high"] - r["mean"]) / error < 2.7
    assert stats.bootstrap_by_weights(df.limit(0), F.col("v"), F.col("i")).first()["low"] is None


def test_nearly_equal_values_stay_apart_in_long_tables(spark):
    """Fingerprints don't shrink with the table: values that differ by 1e-5 of their spread are two, however many rows there are."""
    rng = np.random.default_rng(8)
    n = 20_000
    df = spark.createDataFrame(pd.DataFrame({"i": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "y": rng.normal(size=n)})).repartition(4)
    found, _ = mine.mine(df, {"a": F.col("a"), "c": F.col("a") + 1e-5 * F.col("b"), "d": F.col("a") * 3 + 1}, F.col("y"), F.col("i"), mine.Options(max_order=0))
    assert {c.expression for c in found} == {"a", "c"}
