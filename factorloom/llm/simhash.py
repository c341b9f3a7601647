"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated fingerprint bits are put into the same part; a dynamic programme gives each part its own
threshold T_i (-1: the part isn't probed) with sum(T_i) = tau - parts + 1, at the least estimated cost
of probes and candidates. Two fingerprints within tau bits then differ in at most T_i bits of some
part i. A part with threshold T is probed by keys that blank out T of its bits, so both sides meet in
an ordinary hash group; all distances are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, components, id_and_text, rows_to_batch, shuffle_width, signed, sorted_runs, text_blocks

BITS = 64
ALL = (1 << BITS) - 1
#: Rows of one key that are compared in memory; the rows of larger groups get longer keys instead.
GROUP_ROWS = 4096
#: Candidates by min-hashes: a key is shared by 0.9996 of pairs with similarity 0.8, as 1 - (1 - 0.8 ** 5) ** 20.
BANDS, BAND_ROWS = 20, 5
#: Texts of a block.
BLOCK = 1024
#: A probe's cost in comparisons: a row shuffled and sorted.
PROBE_COST = 60.0
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: The multiplier that mixes min-hashes into a key.
MIX = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `width` words of the ASCII-lower-cased text; fewer words: one hash of all; none: empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[width - 1 :].tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it; no hashes: 0."""
    if not len(hashes):
        return 0
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BYTE_BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit majority fingerprint of a whole text."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0) for every row; null and empty texts have fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("f0", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(prints))], schema=schema)

    return id_and_text(docs, id_col, text_col, binary=True).mapInArrow(run, "doc_id long, f0 long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set, over all rows of f0; 64 rows reach the driver."""
    schema = "i int, n long, " + ", ".join(f"c{j} long" for j in range(BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 65536):
                part = np.ascontiguousarray(values[at : at + 65536])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                total += len(part)
        counts = np.rint(both).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array([total] * BITS, pa.int64()), *(pa.array(counts[:, j]) for j in range(BITS))], names=["i", "n", *(f"c{j}" for j in range(BITS))])

    rows = prints.select("f0").mapInArrow(run, schema).groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(BITS))).orderBy("i").collect()
    return (int(rows[0]["n"]), np.array([[r[f"c{j}"] for j in range(BITS)] for r in rows], float)) if rows else (0, np.zeros((BITS, BITS)))


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size: the bit with most correlation left, and those most correlated with it."""
    p = np.diag(both) / max(total, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        head = max(left, key=lambda b: (round(corr[b, left].sum(), 9), -b))
        near = sorted((b for b in left if b != head), key=lambda b: (-round(corr[head, b], 9), b))[: size - 1]
        out.append(sorted([head, *near]))
        left = [b for b in left if b not in out[-1]]
    return out


def allocate(total: int, both: np.ndarray, tau: int, most_parts: int = 10) -> list[tuple[list[int], int]]:
    """Parts and thresholds of the least estimated cost, by dynamic programming over the thresholds' sum."""
    p = np.diag(both) / max(total, 1)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, min(most_parts, tau + 1) + 1):
        groups, need = group_bits(total, both, parts), tau - parts + 1
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            within = np.array([1.0])
            for b in bits:
                within = np.convolve(within, [agree[b], 1 - agree[b]])
            costs = {-1: 0.0}
            for t in range(min(tau, 3, len(bits)) + 1):
                costs[t] = total * comb(len(bits), t) * PROBE_COST + 0.5 * total * total * float(within[: t + 1].sum()) * (t + 1)
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in state.items():
                for t, more in costs.items():
                    if used + t not in after or cost + more < after[used + t][0]:
                        after[used + t] = (cost + more, [*chosen, t])
            state = after
        if need in state and (best is None or state[need][0] < best[0]):
            best = (state[need][0], list(zip(groups, state[need][1], strict=True)))
    assert best is not None, "tau too large for the number of parts"
    return [(bits, t) for bits, t in best[1] if t >= 0]


def probe_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """For each part and each choice of T of its bits: a mask of the part's other bits."""
    out = []
    for bits, t in plan:
        whole = sum(1 << b for b in bits)
        out += [whole & ~sum(1 << b for b in blank) for blank in combinations(bits, t)]
    return list(dict.fromkeys(out))


def _longer_masks(mask: int, tau: int) -> list[int]:
    """mask with each of tau + 1 shares of the bits it lacks: two prints within tau bits agree on one of them."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: tau + 1]) for k in range(tau + 1)]


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def link_forest(prints: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of prints within tau bits."""
    waiting, edges = np.arange(len(prints)), []
    while len(waiting) > 1:
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(prints[waiting] ^ prints[at]) <= tau
            if near.any():
                found = waiting[near]
                edges += [(at, int(x)) for x in found]
                front += found.tolist()
                waiting = waiting[~near]
    return edges


def links(reps: DataFrame, scratch: Scratch, tau: int) -> DataFrame:
    """(a, b): edges that connect just what the pairs of reps(rep, f0), each f0 once, within tau bits connect.

    A key's group of up to GROUP_ROWS rows is compared in memory, and a spanning forest stands for all
    its pairs. Rows of a larger group stream through and get longer keys for a further round, until the
    bits left are so few that distinct prints can't be many.
    """
    names, most = ["f0"], GROUP_ROWS
    total, both = bit_statistics(reps)
    if total < 2:
        return reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    masks = probe_masks(allocate(total, both, tau))
    fields = ["mask", "key", "rep", *names]
    keyed = reps.select("rep", *names, F.explode(F.array(*(F.lit(_as_long(m)) for m in masks))).alias("mask")).withColumn("key", F.col("f0").bitwiseAND(F.col("mask"))).select(*fields)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((n, pa.int64()) for n in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bounds, is_open, _ in sorted_runs(batches, ["mask", "key"], most):
            sizes = np.diff(bounds) if bounds[-1] == len(block["rep"]) else np.diff(np.append(bounds, len(block["rep"])))
            firsts = bounds[: len(sizes)]
            rows: list[tuple] = []
            table = block["f0"].view(np.uint64)
            for i in np.flatnonzero(sizes > 1) if not is_open else range(len(sizes)):
                lo, hi = int(firsts[i]), int(firsts[i] + sizes[i])
                mask = int(block["mask"][lo]) & ALL
                if is_open and BITS - mask.bit_count() > 12:
                    for longer in _longer_masks(mask, tau):
                        keys = signed(table[lo:hi] & np.uint64(longer))
                        n = hi - lo
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, _as_long(longer))), pa.array(keys), pa.array(block["rep"][lo:hi]), *(pa.array(block[x][lo:hi]) for x in names)], schema=schema)
                    continue
                rep = block["rep"]
                rows += [(int(rep[lo + a]), int(rep[lo + b]), *([None] * len(fields))) for a, b in link_forest(table[lo:hi], tau)]
            if rows:
                yield rows_to_batch(rows, schema)

    spark_schema = "a long, b long, " + ", ".join(f"{n} long" for n in fields)
    found: DataFrame | None = None
    for _ in range(BITS):
        width = shuffle_width(reps.sparkSession)
        out = scratch.write(keyed.repartition(width, "mask", "key").sortWithinPartitions("mask", "key", *names).mapInArrow(run, spark_schema), "links")
        pairs = out.where("a is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        keyed = out.where("a is null").select(*fields)
        if keyed.isEmpty():
            break
    return found.distinct()


def near_duplicates(docs: DataFrame, width: int = 3, tau: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, component_id) for every row: component_id is the least doc_id reachable over links.

    Documents link if their fingerprints differ in at most tau bits. Equal fingerprints are one node, so copies cost one row however many
    they are. Null and empty texts have fingerprint 0 and link like others; repeated rows keep one
    output row each; a null doc_id stays null and is never the least, so component_id is null where no row has an id;
    an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs, width, id_col, text_col), "prints")
    nodes = scratch.write(prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "nodes")
    classes = components(links(nodes.select(F.col("f0").alias("rep"), "f0"), scratch, tau), scratch)
    placed = nodes.join(classes, nodes["f0"] == classes["id"], "left").select("f0", "least", F.coalesce("component", "f0").alias("node"))
    named = placed.groupBy("node").agg(F.min("least").alias("component_id"))
    facts = scratch.write(placed.join(named, "node").select("f0", "component_id"), "facts")
    return prints.join(facts, "f0").select("doc_id", "f0", "component_id")


def candidate_keys(docs: DataFrame, width: int) -> DataFrame:
    """(uid, f0, keys) of rows(uid, body): the fingerprint, and BANDS keys of BAND_ROWS min-hashes each. A text is taken once in a task."""
    schema = pa.schema([("uid", pa.int64()), ("f0", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(7).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        seen: set[int] = set()
        for ids, bodies in text_blocks(batches):
            fresh = [i for i, uid in enumerate(ids) if uid not in seen and not seen.add(uid)]
            ids, bodies = [ids[i] for i in fresh], [bodies[i] for i in fresh]
            if len(seen) > 1 << 20:
                seen.clear()
            prints, keys = np.zeros(len(bodies), np.uint64), np.zeros((len(bodies), BANDS), np.uint64)
            for i, t in enumerate(bodies):
                hashes = shingle_hashes(t, width)
                prints[i] = majority(hashes)
                hashes = np.unique(hashes)
                hashes ^= hashes >> np.uint64(32)
                least = np.zeros(len(odd), np.uint64)
                for k in range(len(odd) if len(hashes) else 0):
                    least[k] = (hashes * odd[k]).min()
                for r in range(BAND_ROWS):
                    keys[i] = (keys[i] ^ least[r::BAND_ROWS]) * np.uint64(MIX)
                    keys[i] ^= keys[i] >> np.uint64(31)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(signed(prints)), pa.array(signed(keys).tolist(), pa.list_(pa.int64()))], schema=schema)

    return docs.select("uid", "body").mapInArrow(run, "uid long, f0 long, keys array<long>")


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of sets (sorted, without repeats) with a Jaccard similarity of at least `least`; empty sets equal each other.

    A set is compared with all that wait at once: its members are flagged, and the flags of each other set added up.
    """
    sizes = np.array([len(s) for s in sets])
    member = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel() if sizes.any() else np.empty(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    waiting, edges = np.arange(len(sets)), []
    held, rows = member, np.arange(len(sets))  # members of the sets in rows, which are few more than those that wait
    flags = np.zeros(int(member.max(initial=0)) + 1, np.int32)
    while len(waiting) > 1:
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            if len(waiting) < len(rows) // 2:
                rows = waiting
                held = np.concatenate([member[starts[i] : starts[i] + sizes[i]] for i in rows.tolist()])
            mine = member[starts[at] : starts[at] + sizes[at]]
            flags[mine] = 1
            until = np.append(0, np.cumsum(flags[held]))
            flags[mine] = 0
            ends = np.cumsum(sizes[rows])
            shared = (until[ends] - until[ends - sizes[rows]])[np.searchsorted(rows, waiting)]
            union = sizes[waiting] + sizes[at] - shared
            near = shared >= least * union
            found = waiting[near].tolist()
            edges += [(at, x) for x in found]
            front += found
            waiting = waiting[~near]
    return edges


def similar_texts(rows: DataFrame, scratch: Scratch, least: float, width: int = 5, tau: int = 6) -> DataFrame:
    """(id, component) of texts of rows(key, uid, body) that pairs with a Jaccard similarity of at least `least` connect.

    uid stands for the text. Candidates share a class by fingerprints within tau bits or by a key of
    min-hashes; in a class all pairs are compared, by their sets of runs of `width` words (32-bit hashes). A class of over
    BLOCK texts is dealt into blocks, and each two blocks meet in a group of their own.
    """
    firsts = scratch.write(rows.groupBy("uid").agg(F.min("key").alias("key")), "firsts")
    prints = scratch.write(candidate_keys(rows, width).dropDuplicates(["uid"]), "prints")
    keyed = prints.select("uid", F.posexplode("keys").alias("band", "value"))
    heads = scratch.write(keyed.groupBy("band", "value").agg(F.min("uid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "heads")
    by_band = keyed.join(heads, ["band", "value"]).select(F.col("uid").alias("a"), F.col("head").alias("b")).distinct()
    reps = scratch.write(prints.groupBy("f0").agg(F.min("uid").alias("rep")), "reps")
    by_print = prints.join(reps, "f0").select(F.col("uid").alias("a"), F.col("rep").alias("b"))
    loose = components(by_band.unionByName(by_print).unionByName(links(reps, scratch, tau)).where("a <> b"), scratch)
    blocks = scratch.write(loose.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = loose.join(blocks, "component").select(F.col("id").alias("uid"), "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("mine"))
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("mine")))
    cell = F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")
    asked = dealt.select("uid", "component", "blocks", "mine", F.explode(cells).alias("other")).withColumn("cell", cell).groupBy("uid", "component").agg(F.collect_list("cell").alias("cells"))
    part = pa.schema([("component", pa.int64()), ("cell", pa.int64()), ("uid", pa.int64()), ("runs", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                runs = np.unique((shingle_hashes(at["body"][i].as_py(), width) >> np.uint64(32)).astype(np.uint32)).tobytes()
                yield rows_to_batch([(at["component"][i].as_py(), c, at["uid"][i].as_py(), runs) for c in at["cells"][i].as_py()], part)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[dict[str, np.ndarray]] = []
        for block, bounds, is_open, goes_on in sorted_runs(batches, ["component", "cell"], 4 * BLOCK):
            held.append(block)
            if is_open and goes_on:
                continue
            block = {n: np.concatenate([x[n] for x in held]) for n in block} if len(held) > 1 else block
            edges = np.append(bounds[bounds < len(block["uid"])], len(block["uid"])) if len(held) == 1 else np.array([0, len(block["uid"])])
            held, out = [], []
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sets = [np.frombuffer(r, np.uint32) for r in block["runs"][x:y]]
                out += [(int(block["uid"][x + a]), int(block["uid"][x + b])) for a, b in similar_forest(sets, least)]
            if out:
                yield rows_to_batch(out, schema)

    whole = rows.join(asked.join(firsts, "uid"), ["uid", "key"]).dropDuplicates(["uid"])
    parts = whole.select("uid", "component", "cells", "body").mapInArrow(cut, "component long, cell long, uid long, runs binary")
    found = parts.repartition(shuffle_width(rows.sparkSession), "component", "cell").sortWithinPartitions("component", "cell", "uid").mapInArrow(compare, "a long, b long")
    return components(scratch.write(found, "similar"), scratch)


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


