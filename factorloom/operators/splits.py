"""Splits by row or by group, folds, checks and digests.

The scalable mode orders ids by a hash of seed and id, so roles depend on nothing else and no id reaches
the driver. The exact mode permutes the collected ids with numpy, for tables that fit there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("train", "validation", "test")
#: Digits by which prefixes of hashes grow while a cut is sought.
STEP = 4
#: Ids that the exact mode collects.
MOST_IDS = 5_000_000


def fractions(train: float = 0.6, validation: float = 0.2, test: float = 0.2) -> tuple[float, float, float]:
    """Scaled to a sum of 1; negative or all-zero fractions are errors."""
    parts = (float(train), float(validation), float(test))
    if min(parts) < 0 or sum(parts) <= 0:
        raise ValueError("fractions are positive")
    return tuple(p / sum(parts) for p in parts)


def counts(n: int, parts: tuple[float, float, float]) -> tuple[int, int, int]:
    """Rounded half to even; test takes what is left."""
    train = min(n, round(n * parts[0]))
    validation = min(n - train, round(n * parts[1]))
    return train, validation, n - train - validation


def hash_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def _cuts(ids: DataFrame, places: Callable[[int], list[int]]) -> list[str | None]:
    """The hash at each 0-based place of ids(h) in order, found by narrowing on hash prefixes; places(n) names them.

    One aggregation by a prefix of STEP digits tells n and the cell of every place, and the least hash of a cell
    with one id is the answer. Larger cells are read on, all at once: with 65,536 cells twice will do for 10^9 ids.
    """
    width, found, open_ = STEP, {}, {}
    while True:
        inside = ids
        if open_:
            inside = ids.where(F.substring("h", 1, width - STEP).isin(sorted({p for p, _ in open_.values()})))
        rows = inside.groupBy(F.substring("h", 1, width).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h")).orderBy("p").collect()
        if not open_:
            total = sum(r["n"] for r in rows)
            wanted = places(total)
            open_ = {k: ("", place) for k, place in enumerate(wanted)}
        left = {}
        for k, (prefix, place) in open_.items():
            for r in rows:
                if not r["p"].startswith(prefix):
                    continue
                if place < r["n"]:
                    if r["n"] == 1 or width >= 64:
                        found[k] = r["h"]
                    else:
                        left[k] = (r["p"], place)
                    break
                place -= r["n"]
        if not left:
            return [found.get(k) for k in range(len(wanted))]
        open_, width = left, width + STEP


def hash_roles(df: DataFrame, key: str, seed: int = 7, parts: tuple[float, float, float] | None = None) -> DataFrame:
    """(key, role) for each distinct key: the first by hash are train, then validation, then test.

    The two cuts are found by prefix counts; no global sort and no single task see all keys.
    """
    ids = df.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("h", hash_order(F.col(key), seed))
    share = parts or fractions()

    def places(n: int) -> list[int]:
        train, validation, _ = counts(n, share)
        return [train, train + validation]

    first, second = _cuts(ids, places)
    role = F.lit("train")
    if first is not None:
        role = F.when(F.col("h") < first, "train").otherwise("validation")
    if second is not None:
        role = F.when(F.col("h") >= second, "test").otherwise(role)
    return ids.select(key, role.alias("role"))


def group_roles(df: DataFrame, key: str, group: str, seed: int = 7, parts: tuple[float, float, float] | None = None) -> DataFrame:
    """(key, role): all rows of a group share a role; counts are of groups. Rows without a group are one group."""
    keyed = df.select(key, F.coalesce(F.col(group).cast("string"), F.lit("__none__")).alias("g"))
    return keyed.join(hash_roles(keyed, "g", seed, parts), "g").select(key, "role").distinct()


def folds(df: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """(key, fold): hash order modulo k, with k held between 2 and the number of keys."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    k = max(2, min(k, ids.count()))
    return ids.select(key, F.pmod(F.conv(F.substring(hash_order(F.col(key), seed), 1, 12), 16, 10).cast("long"), F.lit(k)).cast("int").alias("fold"))


def exact_roles(ids: list[str], seed: int = 0, parts: tuple[float, float, float] | None = None) -> dict[str, list[str]]:
    """Roles by a numpy permutation of collected ids."""
    order = np.random.default_rng(seed).permutation(len(ids))
    train, validation, _ = counts(len(ids), parts or fractions())
    edges = (0, train, train + validation, len(ids))
    return {r: [ids[i] for i in order[edges[j] : edges[j + 1]]] for j, r in enumerate(ROLES)}


def exact_group_roles(groups: dict[str, str], seed: int = 0, parts: tuple[float, float, float] | None = None) -> dict[str, list[str]]:
    """The same with whole groups; groups maps ids to their group."""
    roles = exact_roles(sorted(set(groups.values())), seed, parts)
    of = {g: r for r, members in roles.items() for g in members}
    return {r: [i for i, g in groups.items() if of[g] == r] for r in ROLES}


def exact_folds(n: int, k: int, seed: int = 0) -> list[np.ndarray]:
    """Shuffled index folds; the first n mod k have one more."""
    k = max(2, min(k, n))
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    return np.array_split(order, k)


@dataclass
class Manifest:
    """Row ids of each role with how they came about."""

    roles: dict[str, list[str]]
    seed: int
    parts: tuple[float, float, float]
    id_column: str | None = None
    group_column: str | None = None
    groups: dict[str, str] = field(default_factory=dict)

    def digest(self) -> str:
        """SHA-256 of the sorted ids of each role, the seed, the fractions and the columns used."""
        body = {"roles": {r: sorted(self.roles.get(r, [])) for r in ROLES}, "seed": self.seed, "fractions": list(self.parts), "id_column": self.id_column, "group_column": self.group_column}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()

    def save(self, path: str | Path) -> None:
        body = {"roles": self.roles, "seed": self.seed, "fractions": list(self.parts), "id_column": self.id_column, "group_column": self.group_column, "groups": self.groups, "sha256": self.digest()}
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(body, indent=2, sort_keys=True))

    @classmethod
    def load(cls, path: str | Path) -> Manifest:
        body = json.loads(Path(path).read_text())
        out = cls(body["roles"], body["seed"], tuple(body["fractions"]), body["id_column"], body["group_column"], body.get("groups", {}))
        if out.digest() != body["sha256"]:
            raise ValueError("the manifest's digest doesn't match its rows")
        return out

    def check(self, ids: list[str]) -> None:
        """No id twice, in two roles, unknown or left out; no group in two roles."""
        listed = [i for r in ROLES for i in self.roles.get(r, [])]
        if set(self.roles) - set(ROLES):
            raise ValueError("unknown role")
        if len(listed) != len(set(listed)):
            raise ValueError("a row has two roles or is listed twice")
        if set(listed) != set(ids):
            raise ValueError("roles don't cover the rows")
        if self.groups:
            seen: dict[str, str] = {}
            for r in ROLES:
                for i in self.roles.get(r, []):
                    if seen.setdefault(self.groups[i], r) != r:
                        raise ValueError(f"group {self.groups[i]} is in two roles")

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, r) for r in ROLES for i in self.roles.get(r, [])], "row_id string, role string")


def build_manifest(df: DataFrame, id_columns: tuple[str, ...], seed: int = 0, parts: tuple[float, float, float] | None = None, group: str | None = None) -> Manifest:
    """Exact mode: collects ids (and groups), which must fit the driver; repeated ids are an error."""
    key = next((c for c in id_columns if c in df.columns), None)
    if key is None:
        raise ValueError("a row id column is needed")
    rows = df.select(F.col(key).cast("string").alias("i"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g")).limit(MOST_IDS + 1).collect()
    if len(rows) > MOST_IDS:
        raise ValueError(f"over {MOST_IDS} rows: use hash_roles or group_roles, which collect none")
    ids = [r["i"] for r in rows]
    if len(ids) != len(set(ids)):
        raise ValueError(f"repeated ids in {key}")
    share = parts or fractions()
    groups = {r["i"]: r["g"] for r in rows} if group else {}
    out = Manifest(exact_group_roles(groups, seed, share) if group else exact_roles(ids, seed, share), seed, share, key, group, groups)
    out.check(ids)
    return out


def assign(df: DataFrame, roles: DataFrame, key: str, role_key: str = "row_id") -> DataFrame:
    """df with role: 'unassigned' for rows that no role names."""
    named = roles.select(F.col(role_key).cast("string").alias("__k"), "role")
    return df.join(named, F.col(key).cast("string") == F.col("__k"), "left").drop("__k").withColumn("role", F.coalesce("role", F.lit("unassigned")))


def check_roles(roles: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct, repeated, missing, unknown and invalid, for tables of any size."""
    each = roles.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("role").isin(*ROLES), 0).otherwise(1)).alias("invalid"))
    both = each.withColumn("here", F.lit(1)).join(ids.select(key).distinct().withColumn("there", F.lit(1)), key, "full")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count("here").alias("distinct_ids"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.count(F.when(F.col("here").isNull(), 1)).alias("missing"), F.count(F.when(F.col("there").isNull(), 1)).alias("unknown"), F.coalesce(F.sum("invalid"), F.lit(0)).cast("long").alias("invalid"))
