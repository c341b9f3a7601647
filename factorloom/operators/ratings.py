"""Blind ratings: export, judging, strict parsing, and aggregation. Human and model groups are never merged."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.operators import stats

# The dimensions every rating has, each a whole number from 1 to 5.
DIMENSIONS = ("domain_meaning", "structural_plausibility", "readability_generalizability", "hypothesis_support")
#: Ratings that are resampled on the driver.
MOST_RATINGS = 1_000_000
# Keys that a public item never has.
FORBIDDEN = ("method", "method_name", "seed", "r2", "r2_test", "r2_val", "explanation", "llm_explanation")
LOW, HIGH = 1, 5


@dataclass
class Item:
    """What a judge sees of a formula, and nothing of where it comes from."""

    item_id: str
    label: str
    formula: str
    variables: list[dict[str, Any]] = field(default_factory=list)
    context: str = ""


def export_blind(records: list[dict[str, Any]], seed: int = 0, public_path: str | Path | None = None, private_path: str | Path | None = None) -> tuple[list[Item], dict[str, dict[str, Any]]]:
    """Shuffled items with opaque ids, and the private map from ids to their origin.

    The seed alone decides order and ids. A public item with a key that tells its origin is an error.
    """
    order = list(range(len(records)))
    random.Random(seed).shuffle(order)
    items, private = [], {}
    for i in order:
        r = records[i]
        ident = "item_" + hashlib.blake2b(f"{seed}|{i}|{r['formula']}".encode(), digest_size=8).hexdigest()
        item = Item(ident, str(r.get("dataset_label", r.get("label", ""))), str(r["formula"]), list(r.get("variables", [])), str(r.get("task_context", r.get("context", ""))))
        leaked = [k for v in item.variables for k in v if k in FORBIDDEN]
        if leaked:
            raise ValueError(f"a public item would tell {leaked[0]}")
        items.append(item)
        private[ident] = {"orig_index": i, **{k: r.get(k) for k in ("method", "seed", "r2_test", "r2_val", "dataset", "target")}}
    if public_path:
        _write_lines(public_path, [public_row(x) for x in items])
        head = ",".join(["item_id", *DIMENSIONS, "overall_judgment", "rater_id"])
        Path(public_path).with_suffix(".human_template.csv").write_text("\n".join([head, *(f"{x.item_id}," + "," * (len(DIMENSIONS) + 1) for x in items)]) + "\n")
    if private_path:
        Path(private_path).parent.mkdir(parents=True, exist_ok=True)
        Path(private_path).write_text(json.dumps({"seed": seed, "mapping": private}, indent=2))
    return items, private


def public_row(item: Item) -> dict[str, Any]:
    row = asdict(item)
    return {"item_id": row["item_id"], "dataset_label": row["label"], "formula": row["formula"], "variables": row["variables"], "task_context": row["context"]}


def load_items(path: str | Path) -> list[Item]:
    out = []
    for line in Path(path).read_text(encoding="utf-8-sig").splitlines():
        if line.strip():
            r = json.loads(line)
            out.append(Item(r["item_id"], r.get("dataset_label", ""), r["formula"], r.get("variables", []), r.get("task_context", "")))
    return out


def _write_lines(path: str | Path, rows: list[dict[str, Any]]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


# --- rubric, prompts, parsing ---


def load_rubric(path: str | Path) -> dict[str, Any]:
    rubric = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if {d["key"] for d in rubric["dimensions"]} != set(DIMENSIONS):
        raise ValueError(f"a rubric has the dimensions {DIMENSIONS}")
    return rubric


def judge_prompt(item: Item, rubric: dict[str, Any]) -> str:
    """Formula, variables, anchors of each score, and the form of the answer."""
    lines = ["Rate how well a person can interpret this formula. Accuracy is not asked for.", "", f"Item: {item.item_id}", f"Dataset: {item.label}", f"Formula: {item.formula}"]
    if item.context:
        lines.append(f"Context: {item.context}")
    lines += ["", "| variable | definition | unit | range |", "|---|---|---|---|"]
    lines += [f"| {v.get('name', '')} | {v.get('definition', '')} | {v.get('unit', '')} | {v.get('allowed_range', '')} |" for v in item.variables]
    for d in rubric["dimensions"]:
        lines += ["", f"{d.get('title', d['key'])} ({d['key']})"] + [f"  {k}: {text}" for k, text in sorted(d.get("anchors", {}).items())]
    shape = rubric.get("output_schema") or {"item_id": item.item_id, "ratings": dict.fromkeys(DIMENSIONS, "1..5")}
    return "\n".join([*lines, "", "Answer with this JSON object alone:", json.dumps(shape, ensure_ascii=False)])


def prompt_hash(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


def parse_rating(answer: dict[str, Any] | str, item_id: str) -> dict[str, int]:
    """Exactly the dimensions, each a whole number from 1 to 5, for the right item; anything else is a ValueError."""
    if isinstance(answer, str):
        answer = json.loads(answer)
    if not isinstance(answer, dict) or answer.get("item_id") != item_id:
        raise ValueError("the answer is for another item")
    ratings = answer.get("ratings")
    if not isinstance(ratings, dict) or set(ratings) != set(DIMENSIONS):
        raise ValueError("the answer lacks a dimension or has another")
    out = {}
    for key in DIMENSIONS:
        value = ratings[key]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or not LOW <= value <= HIGH:
            raise ValueError(f"{key} is a whole number from {LOW} to {HIGH}")
        out[key] = int(value)
    return out


def parse_answers(df: DataFrame, item_col: str = "item_id", answer_col: str = "answer") -> DataFrame:
    """df with rating (struct of the dimensions, or null) and error: strict parsing with JSON functions alone."""
    number = ", ".join(f"{d}: double" for d in DIMENSIONS)
    parsed = F.from_json(answer_col, f"item_id string, ratings struct<{number.replace(': ', ':')}>")
    keys = F.array_sort(F.json_object_keys(F.get_json_object(answer_col, "$.ratings")))
    exact = F.coalesce(keys == F.array(*(F.lit(d) for d in sorted(DIMENSIONS))), F.lit(False))
    out = df.withColumn("__p", parsed).withColumn("__exact", exact)
    whole = [F.coalesce(F.col(f"__p.ratings.{d}").between(LOW, HIGH) & (F.col(f"__p.ratings.{d}") == F.floor(f"__p.ratings.{d}")) & ~F.get_json_object(answer_col, f"$.ratings.{d}").isin("true", "false"), F.lit(False)) for d in DIMENSIONS]
    fine = whole[0]
    for w in whole[1:]:
        fine = fine & w
    error = F.when(F.coalesce(F.col("__p.item_id") != F.col(item_col), F.lit(True)), "item").when(~F.col("__exact"), "dimensions").when(~fine, "values")
    rating = F.when(error.isNull(), F.struct(*(F.col(f"__p.ratings.{d}").cast("int").alias(d) for d in DIMENSIONS)))
    return out.withColumn("error", error).withColumn("rating", rating).drop("__p", "__exact")


def run_judge(items: list[Item], rubric: dict[str, Any], call: Callable[[str], Any], out_path: str | Path, model_id: str, order_seed: int | None = None, retries: int = 2, temperature: float | None = None) -> dict[str, Any]:
    """Judge what the log at out_path doesn't have yet, appending each answer; failures go to a log of errors.

    With an order seed the items are shown in another order. Nothing is ever filled in for a failed answer.
    """
    log, errors = Path(out_path), Path(out_path).with_suffix(".errors.jsonl")
    log.parent.mkdir(parents=True, exist_ok=True)
    done = {json.loads(x)["item_id"] for x in log.read_text().splitlines() if x.strip()} if log.exists() else set()
    order = list(items)
    if order_seed is not None:
        random.Random(order_seed).shuffle(order)
    judged = failed = 0
    for position, item in enumerate(order):
        if item.item_id in done:
            continue
        prompt, problem = judge_prompt(item, rubric), None
        for attempt in range(retries + 1):
            try:
                rating = parse_rating(call(prompt), item.item_id)
            except Exception as error:  # noqa: BLE001  whatever a service raises is logged
                problem = f"{type(error).__name__}: {error}"
                continue
            with log.open("a") as f:
                f.write(json.dumps({"item_id": item.item_id, "model_id": model_id, "ratings": rating, "position": position, "order_seed": order_seed, "prompt_sha256": prompt_hash(prompt), "attempt": attempt + 1, "temperature": temperature}) + "\n")
            judged += 1
            problem = None
            break
        if problem:
            failed += 1
            with errors.open("a") as f:
                f.write(json.dumps({"item_id": item.item_id, "model_id": model_id, "error": problem, "prompt_sha256": prompt_hash(prompt)}) + "\n")
    return {"items": len(items), "already_done": len(done & {i.item_id for i in items}), "judged": judged, "failed": failed, "coverage": (len(done & {i.item_id for i in items}) + judged) / max(1, len(items))}


def pending(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that no answer is there for yet."""
    return items.join(done.select(key), key, "left_anti")


# --- reading and aggregation ---


def load_human(spark: SparkSession, path: str) -> DataFrame:
    """(rater_id, item_id, dimensions): complete rows within 1..5; a value outside is an error."""
    raw = spark.read.option("header", True).csv(path)
    lacking = [c for c in ("item_id", *DIMENSIONS) if c not in raw.columns]
    if lacking:
        raise ValueError(f"the file lacks {lacking}")
    rater = F.coalesce(F.col("rater_id"), F.lit("human_1")) if "rater_id" in raw.columns else F.lit("human_1")
    out = raw.select(rater.alias("rater_id"), "item_id", *(F.trim(d).try_cast("double").alias(d) for d in DIMENSIONS)).dropna(subset=["item_id", *DIMENSIONS])
    inside = F.lit(True)
    for d in DIMENSIONS:
        inside = inside & F.col(d).between(LOW, HIGH)
    if out.where(~inside).limit(1).count():
        raise ValueError(f"ratings are from {LOW} to {HIGH}")
    return out


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """(rater_id, item_id, dimensions) from a judge's log."""
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("ratings", T.StructType([T.StructField(d, T.DoubleType()) for d in DIMENSIONS]))])
    return spark.read.schema(schema).json(path).select(F.coalesce("model_id", F.lit("model")).alias("rater_id"), "item_id", "ratings.*")


def overall():
    """The mean of a row's dimensions."""
    total = F.col(DIMENSIONS[0])
    for d in DIMENSIONS[1:]:
        total = total + F.col(d)
    return total / float(len(DIMENSIONS))


def group_means(df: DataFrame, by: str) -> DataFrame:
    """Ratings, mean of each dimension and overall mean of each group."""
    return df.withColumn("overall", overall()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(d).alias(d) for d in (*DIMENSIONS, "overall")))


def summarise(df: DataFrame, draws: int = 2000, seed: int = 0) -> dict[str, Any]:
    """Means with bootstrap intervals of one group, resampled here; over MOST_RATINGS rows are an error."""
    rows = df.withColumn("overall", overall()).select(*DIMENSIONS, "overall").limit(MOST_RATINGS + 1).toPandas()
    if len(rows) > MOST_RATINGS:
        raise ValueError(f"over {MOST_RATINGS} ratings: use group_intervals, which collects none")
    out: dict[str, Any] = {"n": len(rows)}
    for c in rows.columns:
        values = rows[c].to_numpy(float)
        low, high = stats.bootstrap_interval(values, draws, seed)
        out[c] = {"mean": float(values.mean()) if len(values) else float("nan"), "low": low, "high": high}
    return out


def group_intervals(df: DataFrame, by: list[str], draws: int = 200, seed: int = 0) -> DataFrame:
    """(by, dimension, n, mean, low, high): means of each dimension and overall with bootstrap intervals, for tables of any size.

    A rating's weights depend on its rater, item and values, so its dimensions are resampled together. Equal ratings
    are one row that stands for all; each of them has a weight of its own, and so have several of one rater and item.
    """
    equal = df.groupBy(*by, "rater_id", "item_id", *DIMENSIONS).agg(F.count(F.lit(1)).alias("copies")).withColumn("overall", overall())
    measures = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in (*DIMENSIONS, "overall")))
    long = equal.select(*by, "copies", F.struct("rater_id", "item_id", *DIMENSIONS).alias("key"), F.explode(measures).alias("m")).select(*by, "copies", "key", "m.*")
    return stats.bootstrap_by_weights(long, F.col("value"), F.col("key"), draws, seed, [*by, "dimension"], F.col("copies"))


def item_means(df: DataFrame) -> DataFrame:
    return df.withColumn("overall", overall()).groupBy("item_id").agg(F.avg("overall").alias("overall"))


def inter_rater(df: DataFrame) -> DataFrame:
    """One row: raters, pairs, the mean correlation of rater pairs with two common items or more and any spread, and the mean difference."""
    means = df.withColumn("overall", overall()).groupBy("item_id", "rater_id").agg(F.avg("overall").alias("v"))
    pairs = means.alias("a").join(means.alias("b"), (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.rater_id") < F.col("b.rater_id")))
    x, y = F.col("a.v"), F.col("b.v")
    spread = (F.count(F.lit(1)) >= 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    each = pairs.groupBy(F.col("a.rater_id").alias("ra"), F.col("b.rater_id").alias("rb")).agg(F.count(F.lit(1)).alias("n"), F.when(spread, F.covar_pop(x, y) / F.when(spread, F.stddev_pop(x) * F.stddev_pop(y))).alias("r"), F.avg(F.abs(x - y)).alias("gap"))
    raters = df.agg(F.countDistinct("rater_id").alias("raters"))
    return raters.join(each.agg(F.count(F.lit(1)).alias("pairs"), F.avg("r").alias("mean_pearson"), F.avg("gap").alias("mean_abs_diff")), F.lit(True))


def agreement(human: DataFrame, model: DataFrame) -> dict[str, Any]:
    """Spearman and pairwise agreement of item means that both groups have; under two NaN."""
    both = item_means(human).withColumnRenamed("overall", "h").join(item_means(model).withColumnRenamed("overall", "m"), "item_id").cache()
    rho, pairs = stats.spearman(both, "h", "m").first(), stats.pairwise_agreement(both, "item_id", "h", "m").first()
    both.unpersist()
    nan = float("nan")
    return {"n_common": rho["n"], "spearman": rho["rho"] if rho["n"] >= 2 and rho["rho"] is not None else nan, "pairs": pairs["pairs"], "pairwise": pairs["agreement"] if pairs["agreement"] is not None else nan}


def unblind(df: DataFrame, private: dict[str, dict[str, Any]], by: str = "method") -> DataFrame:
    """Mean and number of ratings by origin; items without one are dropped."""
    spark = df.sparkSession
    origin = spark.createDataFrame([(i, str(v[by])) for i, v in private.items() if v.get(by) is not None], f"item_id string, `{by}` string")
    return df.withColumn("overall", overall()).join(F.broadcast(origin), "item_id").groupBy(by).agg(F.avg("overall").alias("mean_overall"), F.count(F.lit(1)).alias("n"))


def full_report(groups: dict[str, DataFrame], private: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
    """For each group its summary, agreement of raters and, with the private map, means by method; then human against model."""
    out: dict[str, Any] = {}
    for name, df in groups.items():
        out[name] = {"summary": summarise(df), "agreement": inter_rater(df).first().asDict()}
        if private:
            out[name]["by_method"] = [r.asDict() for r in unblind(df, private).orderBy("method").collect()]
    if "human" in groups and "llm" in groups:
        out["llm_vs_human"] = agreement(groups["human"], groups["llm"])
    return out


