"""Ratings, judging, connectors, earlier runs and the command line."""

import json
import urllib.error

import numpy as np
import pytest

from factorloom.operators import ratings
from factorloom.plans import cli
from factorloom.sources import chat, files

RUBRIC = {"dimensions": [{"key": d, "title": d, "anchors": {"1": "low", "5": "high"}} for d in ratings.DIMENSIONS]}


def answer(item, **more):
    return {"item_id": item, "ratings": dict.fromkeys(ratings.DIMENSIONS, 3) | more}


def records():
    return [{"formula": f"a * {i}", "method": "mined", "seed": i, "r2_test": 0.5, "label": "d", "variables": [{"name": "a", "unit": "m"}]} for i in range(6)]


def test_blind_export(tmp_path):
    items, private = ratings.export_blind(records(), 1, tmp_path / "p.jsonl", tmp_path / "m.json")
    again, _ = ratings.export_blind(records(), 1)
    assert [i.item_id for i in items] == [i.item_id for i in again]
    assert [i.item_id for i in items] != [i.item_id for i in ratings.export_blind(records(), 2)[0]]
    public = (tmp_path / "p.jsonl").read_text()
    assert not any(f'"{k}"' in public for k in ratings.FORBIDDEN) and len(private) == 6
    assert [i.item_id for i in ratings.load_items(tmp_path / "p.jsonl")] == [i.item_id for i in items]
    with pytest.raises(ValueError):
        ratings.export_blind([{"formula": "a", "variables": [{"method": "x"}]}])


@pytest.mark.parametrize("bad", [answer("other"), {"item_id": "i"}, answer("i", extra=3), answer("i", structural_plausibility=6), answer("i", structural_plausibility=True), answer("i", structural_plausibility=2.5), answer("i", structural_plausibility="3"), []])
def test_strict_parsing(bad):
    with pytest.raises(ValueError):
        ratings.parse_rating(bad, "i")


def test_whole_floats_pass():
    assert ratings.parse_rating(answer("i", structural_plausibility=4.0), "i")["structural_plausibility"] == 4


def test_judge_resumes_and_logs_errors(tmp_path):
    items, _ = ratings.export_blind(records(), 1)
    calls = []

    def call(prompt):
        calls.append(prompt)
        item = next(i.item_id for i in items if i.item_id in prompt)
        if item == items[2].item_id:
            raise OSError("down")
        return answer(item)

    got = ratings.run_judge(items, RUBRIC, call, tmp_path / "r.jsonl", "m", retries=1)
    assert (got["judged"], got["failed"]) == (5, 1) and len(calls) == 7
    again = ratings.run_judge(items, RUBRIC, lambda p: answer(items[2].item_id), tmp_path / "r.jsonl", "m", order_seed=4)
    assert (again["already_done"], again["judged"]) == (5, 1) and again["coverage"] == 1


def test_rating_report(spark, tmp_path):
    head = "item_id," + ",".join(ratings.DIMENSIONS) + ",rater_id\n"
    (tmp_path / "h.csv").write_text(head + "i1,1,2,3,4,r1\ni2,5,5,5,5,r1\ni1,2,2,3,4,r2\ni2,4,5,5,5,r2\ni3,,1,1,1,r2\n")
    human = ratings.load_human(spark, str(tmp_path / "h.csv"))
    assert human.count() == 4
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"item_id": i, "model_id": "m", "ratings": dict.fromkeys(ratings.DIMENSIONS, v)}) + "\n" for i, v in (("i1", 2), ("i2", 4))))
    report = ratings.full_report({"human": human, "llm": ratings.load_model(spark, str(tmp_path / "m.jsonl"))}, {"i1": {"method": "raw"}, "i2": {"method": "mined"}})
    assert report["human"]["summary"]["n"] == 4 and report["llm"]["summary"]["n"] == 2
    assert report["human"]["agreement"]["mean_pearson"] == pytest.approx(1) and report["llm_vs_human"]["spearman"] == pytest.approx(1)
    assert [m["method"] for m in report["human"]["by_method"]] == ["mined", "raw"]
    (tmp_path / "bad.csv").write_text(head + "i1,9,2,3,4,r1\n")
    with pytest.raises(ValueError):
        ratings.load_human(spark, str(tmp_path / "bad.csv"))


def test_json_from_text():
    assert chat.extract_json('Sure:\n```json\n{"a": [1]}\n```\nDone') == {"a": [1]}
    assert chat.extract_json("x {bad} [1, 2] y") == [1, 2]
    with pytest.raises(ValueError):
        chat.extract_json("none")


def test_chat_retries(monkeypatch):
    monkeypatch.setenv("K", "v")
    provider = chat.Provider.from_config({"base_url": "http://x", "model": "m", "api_key_env": "K", "retries": 2})
    waits, codes = [], iter([503, 429])

    def post(p, body):
        code = next(codes, None)
        if code:
            raise urllib.error.HTTPError("u", code, "busy", {}, None)
        return {"choices": [{"message": {"content": "hi"}}]}

    assert chat.chat(provider, "p", post=post, sleep=waits.append) == "hi" and waits == [2.0, 4.0]
    codes = iter([400])
    with pytest.raises(urllib.error.HTTPError):
        chat.chat(provider, "p", post=post, sleep=waits.append)


def test_history(spark, tmp_path):
    a, b = tmp_path / "runs/t1", tmp_path / "runs/t2"
    for d in (a, b):
        d.mkdir(parents=True)
    (a / "best_result.json").write_text(json.dumps({"equation": "x + 1", "best_r2": 0.9}))
    (b / "best_result.json").write_text(json.dumps({"target": "other", "best_equation": "y", "best_r2": 0.7}))
    (a / "model_equations_snapshot.csv").write_text("﻿Equation,Loss,Score\nx + 1,0.5,2\nx * 2,0.1,3\n")
    assert files.snapshot_equations(a / "model_equations_snapshot.csv") == ["x * 2", "x + 1"]
    rows = files.mine_expressions(spark, str(tmp_path / "runs")).orderBy("target", "rank").collect()
    assert [(r["target"], r["expression"], r["rank"]) for r in rows] == [("other", "y", 1), ("t1", "x + 1", 1), ("t1", "x * 2", 2)]


def test_command_line(spark, tmp_path, capsys):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2))
    (tmp_path / "d.csv").write_text("﻿sample_id,a b,c,y\n" + "".join(f"s{i},{u},{v},{u * v + 0.1 * u}\n" for i, (u, v) in enumerate(x)))
    (tmp_path / "c.json").write_text(json.dumps({"input_csv": "d.csv", "output_root": "out", "targets": ["y"], "dataset": {"target_columns": ["y"]}, "factor_mining": {"max_order": 1}}))
    config = ["--config", str(tmp_path / "c.json")]
    for command in (["inspect-dataset"], ["generate-split"], ["build-raw"], ["llm-propose-factors"], ["mine-factors"], ["llm-select-factors"], ["build-pysr-pool"], ["run-pysr"], ["verify"], ["llm-brief"], ["llm-interpret"], ["factor-cards"]):
        assert cli.main([*command, *config]) == 0
    best = json.loads((tmp_path / "out/y/search/best_result.json").read_text())
    assert best["status"] == "success" and best["best_r2"] > 0.9
    assert cli.main(["expression-similarity", "--pred", "a+b", "--truth", "b+a"]) == 0
    capsys.readouterr()


def test_intervals_where_each_item_has_all_ratings_alike(spark):
    """Each rater and item has every value equally often, so intervals by item would have no width; each rating has a weight of its own."""
    rows = [("r", f"i{i % 4}", *(float((k + i % 4) % 5 + 1) for k in (i // 4, i // 8, i // 4 + 1, 2 * (i // 4)))) for i in range(4000)]
    df = spark.createDataFrame(rows, ["rater_id", "item_id", *ratings.DIMENSIONS]).repartition(3)
    got = {r["dimension"]: r for r in ratings.group_intervals(df, ["rater_id"], 200).collect()}
    for at, d in enumerate(ratings.DIMENSIONS):
        v = np.array([r[2 + at] for r in rows])
        error = v.std() / np.sqrt(len(v))
        assert got[d]["n"] == len(v) and got[d]["mean"] == pytest.approx(v.mean())
        assert 1.3 < (v.mean() - got[d]["low"]) / error < 2.7 and 1.3 < (got[d]["high"] - v.mean()) / error < 2.7
