"""Command line: python -m factorloom.plans.cli COMMAND --config FILE ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import formula
from factorloom.operators import crossval, grammar, lineage, mine, prep, ratings, similarity, splits
from factorloom.plans import experiments, prompts, search
from factorloom.session import session
from factorloom.sources import chat, files

Args = argparse.Namespace


class Run:
    """A configuration, its session and the places of its tables."""

    def __init__(self, args: Args):
        self.args, self.work, self.spark = args, grammar.Workflow.from_json(args.config), session()
        self.out = self.work.path(self.work.get("output_root", "runs"))

    def table(self) -> DataFrame:
        return files.read_csv(self.spark, str(self.work.path("input_csv")))

    def targets(self) -> list[str]:
        chosen = [self.args.target] if getattr(self.args, "target", None) else getattr(self.args, "targets", None)
        return self.work.targets(chosen, self.table().columns)

    def place(self, kind: str, target: str) -> Path:
        return self.out / target / kind

    def features(self, target: str, kind: str = "raw") -> tuple[DataFrame, dict[str, Any], dict[str, Column]]:
        frame, manifest = files.read_features(self.spark, self.place(kind, target))
        names = [c for c in frame.columns if c not in ("row_id", "target", "role")]
        return frame, manifest, {n: F.col(n) for n in names}

    def train(self, frame: DataFrame) -> Column | None:
        return F.col("role") == "train" if "role" in frame.columns and frame.where("role = 'train'").limit(1).count() else None


def _call(args: Args) -> Callable[[str], str]:
    provider = chat.Provider.from_config(files.read_json(args.provider))
    return lambda prompt: chat.chat(provider, prompt)


def inspect_dataset(args: Args) -> Any:
    run = Run(args)
    return grammar.inspect(run.table(), run.work.grammar)


def generate_split(args: Args) -> Any:
    run = Run(args)
    out = {}
    for t in run.targets():
        rows = prep.finite_target(run.table(), t)
        m = splits.build_manifest(rows, run.work.grammar.id_columns, args.seed, splits.fractions(*args.fractions), args.group)
        m.save(run.place("split.json", t))
        out[t] = {r: len(v) for r, v in m.roles.items()} | {"sha256": m.digest()}
    return out


def build_raw(args: Args) -> Any:
    run = Run(args)
    out = {}
    chosen = run.work.get("raw_feature_selection", {})
    for t in run.targets():
        df, role = run.table(), None
        where = run.place("split.json", t)
        if where.exists():
            m = splits.Manifest.load(where)
            df, role = splits.assign(df, m.frame(run.spark), m.id_column), F.col("role")
        table = prep.build_features(df.drop("role") if role is None and "role" in df.columns else df, run.work.grammar, t, role, chosen.get("top_k"), chosen.get("top_fraction"))
        files.write_features(table.frame, table.manifest, run.place("raw", t), args.csv)
        out[t] = {"features": len(table.features), "ols": table.manifest["ols"]}
    return out


def propose(args: Args) -> Any:
    run = Run(args)
    out = {}
    for t in run.targets():
        frame, _, x = run.features(t)
        out[t] = str(prompts.write(prompts.proposal_prompt(t, prompts.top_correlations(frame, x, F.col("target"), where=run.train(frame))), run.place("proposal_prompt.md", t)))
    return out


def mine_factors(args: Args) -> Any:
    run = Run(args)
    out = {}
    options = mine.Options.from_config(run.work.get("factor_mining", {}))
    for t in run.targets():
        frame, _, x = run.features(t)
        y, key, train = F.col("target"), F.col("row_id"), run.train(frame)
        proposals: dict[str, str] = {}
        if args.proposals:
            status = mine.proposal_status(frame, x, y, key, mine.read_proposals(args.proposals), train)
            files.write_json(status.to_dict("records"), run.place("proposals.json", t))
            proposals = {r.name: r.expression for r in status[status["status"] == "kept"].itertuples(index=False)}
        found, manifest = mine.mine(frame, x, y, key, options, train, proposals)
        files.write_json({"factors": [c.row() for c in found], "manifest": manifest}, run.place("mined_factors.json", t))
        out[t] = {"kept": len(found), "best": found[0].row() if found else None}
    return out


def _mined(run: Run, target: str) -> list[dict[str, Any]]:
    return files.read_json(run.place("mined_factors.json", target))["factors"]


def select_factors(args: Args) -> Any:
    run = Run(args)
    return {t: [str(prompts.write(p, run.place(f"selection_prompt_{i + 1}.md", t))) for i, p in enumerate(prompts.selection_prompts(t, _mined(run, t)[: args.limit], batch=args.batch))] for t in run.targets()}


def build_pool(args: Args) -> Any:
    run = Run(args)
    out = {}
    settings = run.work.get("factor_selection", {})
    for t in run.targets():
        frame, _, x = run.features(t)
        train = run.train(frame)
        raw = [r.asDict() for r in prep.stats.corr_ranking(frame, x, F.col("target"), train).collect()]
        chosen = mine.read_selection(args.selection) if args.selection else None
        keep, pool, manifest = mine.build_pool(_mined(run, t), raw, chosen, **{k: v for k, v in settings.items() if k in ("raw_keep", "factor_top_k", "authoritative", "fallback_top_k", "extra_top_k")})
        lazy = {p["factor_name"]: (formula.compile_column(p["expression"], x) - p["mean"]) / (p["std"] or 1.0) for p in pool}
        base = [c for c in ("row_id", "target", "role") if c in frame.columns]
        table = frame.select(*base, *(x[n].alias(n) for n in keep), *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in lazy.items()))
        manifest |= {"pool": pool, "features": [*keep, *lazy], "ols": prep.diagnose(table, [*keep, *lazy], where=train)}
        files.write_features(table, manifest, run.place("pool", t), args.csv)
        out[t] = {"features": len(manifest["features"]), "ols": manifest["ols"]}
    return out


def build_union(args: Args) -> Any:
    run = Run(args)
    out = {}
    for t in run.targets():
        tables = []
        for s in run.work.get("feature_sources", []):
            frame, _ = files.read_features(run.spark, run.work.path(s["feature_path"], t))
            names = [c for c in frame.columns if c not in ("row_id", "target", "role")]
            if s.get("best_result_path") and s.get("include_best", True):
                frame = files.with_best_formula(frame, files.read_json(run.work.path(s["best_result_path"], t)), names)
            if s.get("equations_path") and s.get("include_equations", True):
                lazy = mine.snapshot_columns(files.snapshot_equations(run.work.path(s["equations_path"], t)), {n: F.col(n) for n in names}, int(s.get("top_equations", 5)), s["name"])
                frame = frame.select("*", *(c.alias(n) for n, c in lazy.items()))
            tables.append((s["name"], frame.drop("role")))
        union = mine.build_union(tables, "row_id", "target")
        files.write_features(union.frame, union.manifest, run.place("union", t), args.csv)
        out[t] = {"features": len(union.features), "ols": union.manifest["ols"]}
    return out


def run_search(args: Args) -> Any:
    run = Run(args)
    out = {}
    for t in run.targets():
        kind = next((k for k in ("pool", "raw") if run.place(k, t).exists()), "raw")
        frame, _, x = run.features(t, kind)
        settings = run.work.get("raw_pysr", {})
        if args.engine == "external":
            # The configuration names the program, as a list of words; the engine's options stand beside it.
            engine = search.external(settings["command"], run.place("search", t) / "engine", {k: v for k, v in settings.items() if k != "command"})
        else:
            engine = search.surrogate if args.engine == "surrogate" else search.beam_search()
        got = search.run_search(frame, x, F.col("target"), "row_id", engine, run.train(frame), out_dir=run.place("search", t))
        out[t] = {k: got.get(k) for k in ("status", "best_equation", "best_r2", "best_complexity")}
    return out


def verify(args: Args) -> Any:
    run = Run(args)
    out = {}
    for t in run.targets():
        kind = next((k for k in ("pool", "raw") if run.place(k, t).exists()), "raw")
        frame, _, x = run.features(t, kind)
        text = args.expression or files.equation_of(files.read_json(run.place("search", t) / "best_result.json"))
        out[t] = {"expression": text} | experiments.verify(frame, text, x, F.col("target")).first().asDict()
    return out


def llm_brief(args: Args) -> Any:
    run = Run(args)
    return {t: str(prompts.write(prompts.brief(run.features(t)[1]), run.place("brief.md", t))) for t in run.targets()}


def llm_interpret(args: Args) -> Any:
    run = Run(args)
    out = {}
    for t in run.targets():
        best = files.read_json(run.place("search", t) / "best_result.json")
        sources = prompts.source_counts({n: "mined" if n.startswith("mined_") else "raw" for n in formula.variables(files.equation_of(best) or "")})
        out[t] = str(prompts.write(prompts.interpretation_prompt(t, files.equation_of(best) or "", {"R2": best.get("best_r2"), "RMSE": best.get("best_rmse")}, sources), run.place("interpretation_prompt.md", t)))
    return out


def llm_call(args: Args) -> Any:
    return chat.call_prompt_file(args.prompt, _call(args), args.out, args.mode)


def mine_exprs(args: Args) -> Any:
    rows = [r.asDict() for r in files.mine_expressions(session(), args.root, args.top_k).orderBy("target", "rank").collect()]
    if args.out:
        files.write_json(rows, args.out)
    return {"expressions": len(rows)}


def export_blind(args: Args) -> Any:
    items, _ = ratings.export_blind(files.read_json(args.records), args.seed, args.public, args.private)
    return {"items": len(items)}


def score_prompt(args: Args) -> Any:
    return {"prompts": prompts.dump_judge_prompts(ratings.load_items(args.items), ratings.load_rubric(args.rubric), args.out)}


def run_judge(args: Args) -> Any:
    return ratings.run_judge(ratings.load_items(args.items), ratings.load_rubric(args.rubric), lambda p: chat.extract_json(_call(args)(p)), args.out, args.model_id, args.order_seed)


def aggregate(args: Args) -> Any:
    spark, groups = session(), {}
    if args.human:
        groups["human"] = ratings.load_human(spark, args.human)
    if args.llm:
        groups["llm"] = ratings.load_model(spark, args.llm)
    report = ratings.full_report(groups, files.read_json(args.private)["mapping"] if args.private else None)
    if args.out:
        files.write_json(report, args.out)
    return report


def expression_similarity(args: Args) -> Any:
    return similarity.report(args.pred, args.truth)


def sample_known(args: Args) -> Any:
    config = files.read_yaml(args.pool) if str(args.pool).endswith((".yaml", ".yml")) else files.read_json(args.pool)
    chosen = experiments.sample_tasks(config["tasks"] if isinstance(config, dict) else config, args.size, args.seed)
    if args.out:
        files.write_json(chosen, args.out)
    return [t["task_id"] for t in chosen]


def cv_evaluate(args: Args) -> Any:
    run = Run(args)
    out = {}
    for t in run.targets():
        frame, _, x = run.features(t)
        out[t] = crossval.evaluate(frame, x, F.col("target"), "row_id", mine.Options.from_config(run.work.get("factor_mining", {})), args.folds, args.seed, model=args.model)
        files.write_json(out[t], run.place("cv_report.json", t))
    return out


def cards(args: Args) -> Any:
    run = Run(args)
    out = {}
    for t in run.targets():
        made = lineage.cards_from_mined(_mined(run, t), args.limit)
        lineage.save_cards(made, run.place("factor_cards.json", t))
        out[t] = len(made)
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factorloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, func: Callable[[Args], Any], config: bool = True, **options: dict[str, Any]) -> None:
        p = sub.add_parser(name)
        p.set_defaults(func=func)
        if config:
            p.add_argument("--config", required=True)
            p.add_argument("--target")
            p.add_argument("--targets", nargs="*")
        for key, kw in options.items():
            p.add_argument("--" + key.replace("_", "-"), **kw)

    need, number, flag = {"required": True}, lambda d: {"type": int, "default": d}, {"action": "store_true"}
    command("inspect-dataset", inspect_dataset)
    command("build-raw", build_raw, csv=flag)
    command("generate-split", generate_split, seed=number(0), group={}, fractions={"nargs": 3, "type": float, "default": [0.6, 0.2, 0.2]})
    command("llm-propose-factors", propose)
    command("mine-factors", mine_factors, proposals={})
    command("llm-select-factors", select_factors, limit=number(200), batch={"type": int})
    command("build-pysr-pool", build_pool, selection={}, csv=flag)
    command("build-union", build_union, csv=flag)
    command("run-pysr", run_search, engine={"choices": ["surrogate", "beam", "external"], "default": "surrogate"})
    command("verify", verify, expression={})
    command("llm-brief", llm_brief)
    command("llm-interpret", llm_interpret)
    command("llm-call", llm_call, False, provider=need, prompt=need, out={}, mode={"choices": ["text", "json", "auto"], "default": "text"})
    command("mine-exprs", mine_exprs, False, root=need, top_k={"type": int}, out={})
    command("export-blind-ratings", export_blind, False, records=need, seed=number(0), public=need, private=need)
    command("score-interpretability-prompt", score_prompt, False, items=need, rubric=need, out=need)
    command("run-llm-judge", run_judge, False, items=need, rubric=need, provider=need, out=need, model_id=need, order_seed={"type": int})
    command("aggregate-ratings", aggregate, False, human={}, llm={}, private={}, out={})
    command("expression-similarity", expression_similarity, False, pred=need, truth=need)
    command("sample-known-formulas", sample_known, False, pool=need, size=number(20), seed=number(0), out={})
    command("cv-evaluate", cv_evaluate, folds=number(5), seed=number(0), model={"choices": ["linear", "pysr"], "default": "linear"})
    command("factor-cards", cards, limit={"type": int})
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    out = args.func(args)
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=lambda x: asdict(x) if hasattr(x, "__dataclass_fields__") else str(x)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
