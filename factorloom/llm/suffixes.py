"""Repeated substrings by a logarithmic family of sparse suffix arrays.

A suffix array here holds the suffixes that start at anchors: positions whose hash of SEED bytes is the
least within some window of LENGTH bytes. Each window of LENGTH bytes has an anchor, at the same place in
each of its copies, so no repeat is missed. The arrays are sorted by that hash, then by the hash of the
bytes around; any fixed order will do, as long as suffixes that share SEED bytes stand together.

New batches get an array, are merge-scanned against each level for shared heads, and levels of equal size
merge into one of twice the size. Suffixes with a shared head are then resolved to the byte: equal
surroundings repeat as a whole, and for the others all windows of LENGTH bytes around are compared, all
by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, rows_to_batch, shuffle_width, signed, sorted_runs

LENGTH, SEED = 200, 64
BEFORE = LENGTH - SEED  # bytes ahead of an anchor that a window with it can reach
#: Suffixes with one head that are resolved in memory; windows of larger groups are counted by Spark.
GROUP_ROWS = 15_000
#: Levels of arrays that a one-off run builds from: documents come in this many batches.
BATCHES = 4
NONE = np.uint64(2**64 - 1)
_RNG = np.random.default_rng(20240307)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(0, 2**63, 10, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_LAST = np.uint64(0x9E3779B97F4A7C15)


def _ladder(data: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, .. longest bytes from each position, as far as they fit."""
    out, m = [_BYTE[data]], 1
    while m < longest:
        h = out[-1]
        if len(h) <= m:
            out.append(h[:0])
        else:
            nxt = h[:-m] * _STEP[len(out)]
            nxt += h[m:]
            nxt ^= nxt >> np.uint64(29)
            out.append(nxt)
        m *= 2
    return out


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over values[i : i + width], shortened at the end."""
    out, m = values.copy(), 1
    while 2 * m <= width:
        out[:-m] = op(out[:-m], out[m:]) if len(out) > m else out[:-m]
        m *= 2
    if m < width and len(out) > width - m:
        d = width - m
        out[:-d] = op(out[:-d], out[d:].copy())
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, bytes after it up to LENGTH, head hash, hash of the surroundings) of all anchors."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    ends = np.cumsum(sizes)
    rungs = _ladder(data, 128)
    head = np.full(len(data), NONE)
    head[: len(rungs[6])] = (rungs[6] * _LAST) ^ (rungs[6] >> np.uint64(32))
    no_window = np.zeros(len(data), bool)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        head[max(a, b - SEED + 1) : b] = NONE
        no_window[max(a, b - LENGTH + 1) : b] = True
    least = _slide(head, BEFORE + 1, np.minimum)
    least[no_window] = 0
    reach = _slide(least[::-1], BEFORE + 1, np.maximum)[::-1]
    at = np.flatnonzero((head == reach) & (head != NONE))
    text = np.searchsorted(ends, at, side="right")
    position, after = at - (ends - sizes)[text], np.minimum(ends[text] - at, LENGTH)
    around = np.zeros(len(at), np.uint64)
    inner = np.flatnonzero((position >= BEFORE) & (after == LENGTH))
    i = at[inner]
    h = rungs[7][i - BEFORE]
    for rung, where in ((3, i - 8), (7, i), (6, i + 128), (3, i + 192)):
        h = h * _STEP[8] + rungs[rung][where]
        h ^= h >> np.uint64(31)
    around[inner] = h * _STEP[9]
    for j in np.flatnonzero((position < BEFORE) | (after < LENGTH)):
        before = min(BEFORE, int(position[j]))
        around[j] = xxhash.xxh64_intdigest(data[at[j] - before : at[j] + after[j]].tobytes(), before)
    return text, position, after, head[at], around


#: What an entry's row is: one of the arrays, one whose head is known to be shared, or a range that is known to repeat.
IN_ARRAY, SHARED, REPEATED = 0, 1, 2
#: Entries of one head in a block from which on only a mark of the head goes to the arrays.
OFTEN = 16
#: Bytes of texts hashed at once, and entries that make a block.
TEXT_BLOCK, AT_ONCE = 1 << 18, 200_000
ENTRY = pa.schema([("kind", pa.int8()), ("head", pa.int64()), ("around", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int32()), ("position", pa.int32()), ("after", pa.int16())])
ENTRY_SPARK = "kind byte, head long, around long, n int, doc_id long, th int, position int, after short"
ROW = [name for name in ENTRY.names if name != "kind"]


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Columns and bodies in blocks of about `size` bytes."""
    for batch in batches:
        names = batch.schema.names
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names) if n != "body"}
        bodies = batch.column(names.index("body"))
        start, held = 0, 0
        lengths = pc.binary_length(bodies).to_pylist()
        for i, n in enumerate([*lengths, size + 1]):
            if i > start and held + n > size or i == len(lengths):
                if i > start:
                    yield {n: c[start:i] for n, c in columns.items()}, bodies.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, body): th tells apart different texts under one id; a null id is -1."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-1).cast("long")).alias("doc_id"), short_hash(text).alias("th"), text.cast("binary").alias("body"))


def short_hash(text: Column) -> Column:
    return (F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF))).cast("int")


def entries(docs: DataFrame) -> DataFrame:
    """The suffix array entries of documents(doc_id, th, body), unsorted, after what a block of them tells by itself.

    Entries of a block with equal surroundings repeat: their ranges are done, and one of them stands for all
    with n = 2; n = 1 is an entry alone. Of a head with OFTEN or more entries in the block only a mark, without a
    document, goes to the arrays. So a passage that many texts hold is no key of many rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for columns, bodies in _blocks(batches, TEXT_BLOCK):
            text, position, after, head, around = anchors(bodies)
            if len(text):
                ids, ths = np.array(columns["doc_id"], np.int64)[text], np.array(columns["th"], np.int32)[text]
                held.append((head, around, ids, ths, position.astype(np.int32), after.astype(np.int16)))
            if sum(len(x[0]) for x in held) >= AT_ONCE:
                yield from _aggregated(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield from _aggregated(*map(np.concatenate, zip(*held, strict=True)))

    return docs.mapInArrow(run, ENTRY_SPARK)


def _aggregated(head: np.ndarray, around: np.ndarray, ids: np.ndarray, ths: np.ndarray, position: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((position, ids, around, head))
    head, around, ids, ths, position, after = (x[order] for x in (head, around, ids, ths, position, after))
    firsts, sizes = _runs(head, around)
    again = np.repeat(sizes > 1, sizes) & (np.minimum(position, BEFORE) + after >= LENGTH)
    parts = [(REPEATED, np.flatnonzero(again), np.ones(len(head), np.int32))]
    count = np.zeros(len(head), np.int32)
    count[firsts] = np.minimum(sizes, 2)
    heads, kinds = _runs(head[firsts])
    often = np.repeat(kinds >= OFTEN, kinds)
    parts += [(SHARED, firsts[often], count), (IN_ARRAY, firsts[~often], count)]
    for kind, at, n in parts:
        yield _entry_rows(kind, head[at], around[at], n[at], ids[at], ths[at], position[at], after[at])
    marks = head[firsts[heads[kinds >= OFTEN]]]
    none, zero = np.ma.masked_all(len(marks), np.int64), np.zeros(len(marks), np.int64)
    yield _entry_rows(IN_ARRAY, marks, zero, zero + 2, none, zero, zero, zero)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal rows."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    firsts = np.flatnonzero(new)
    return firsts, np.diff(np.append(firsts, len(new)))


def _entry_rows(kind: int, head: np.ndarray, around: np.ndarray, n: np.ndarray, ids: np.ndarray, ths: np.ndarray, position: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(head), kind, np.int8), signed(head), signed(around), n, ids, ths, position, after]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, ENTRY, strict=True)], schema=ENTRY)


class SuffixArrays:
    """The family of levels: add() takes a batch of entries, shared() the entries whose heads it has met more than once.

    Each array is a table bucketed and sorted by head, so a merge-scan of two of them shuffles nothing. A family
    with a home of its own outlives the session: see stored() and save().
    """

    def __init__(self, scratch: Scratch, home: str | None = None):
        self.scratch, self.spark = scratch, scratch.spark
        self.home = (home or scratch.home).rstrip("/")
        self.width = shuffle_width(self.spark)
        self.levels: list[tuple[int, str, str]] = []  # size in batches, table, path
        self.heads: list[DataFrame] = []

    @classmethod
    def stored(cls, scratch: Scratch, home: str) -> SuffixArrays:
        """The family that save() left in a folder, or a new one for it; its arrays keep their buckets."""
        out = cls(scratch, home)
        where, system = scratch._place(f"{out.home}/levels.json")
        if system.exists(where):
            rows = out.spark.read.schema("size int, path string, width int").json(f"{out.home}/levels.json").orderBy(F.desc("size")).collect()
            for r in rows:
                out.width, name = r["width"], f"factorloom_sa_{uuid.uuid4().hex}"
                columns = ENTRY_SPARK.removeprefix("kind byte, ").replace("short", "smallint")
                out.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (head) SORTED BY (head, around) INTO {r['width']} BUCKETS LOCATION '{r['path']}'")
                out.levels.append((r["size"], name, r["path"]))
        return out

    def save(self) -> None:
        """Note the levels in the folder; their tables stay, and only the session's names for them go."""
        rows = [(size, path, self.width) for size, _, path in self.levels]
        self.spark.createDataFrame(rows, "size int, path string, width int").coalesce(1).write.mode("overwrite").json(f"{self.home}/levels.json")
        for _, name, _ in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(*self.heads)
        self.levels, self.heads = [], []

    def _array(self, rows: DataFrame) -> tuple[str, str]:
        name = f"factorloom_sa_{uuid.uuid4().hex}"
        path = f"{self.home}/{name}"
        rows.repartition(self.width, "head").sortWithinPartitions("head", "around").write.option("compression", "zstd").option("path", path).bucketBy(self.width, "head").sortBy("head", "around").saveAsTable(name)
        return name, path

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        gone = self.spark.range(0)
        gone._scratch_path = path
        self.scratch.drop(gone)

    def add(self, batch: DataFrame) -> None:
        name, path = self._array(batch)
        mine = self.spark.table(name)
        found = mine.groupBy("head").agg(F.sum("n").alias("n")).where("n > 1").select("head")
        heads = mine.select("head").distinct()
        for _, other, _ in self.levels:
            found = found.unionByName(heads.join(self.spark.table(other).select("head").distinct(), "head"))
        self.heads.append(self.scratch.write(found, "heads"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, other, other_path = self.levels.pop()
            merged = self._array(self.spark.table(other).unionByName(self.spark.table(name)))
            self._drop(other, other_path)
            self._drop(name, path)
            name, path = merged
            size *= 2
        self.levels.append((size, name, path))

    def shared(self) -> DataFrame:
        """The entries of all levels whose head is seen more than once."""
        heads = self.heads[0]
        for more in self.heads[1:]:
            heads = heads.unionByName(more)
        heads = heads.distinct()
        out = None
        for _, name, _ in self.levels:
            part = self.spark.table(name).join(heads, "head", "left_semi")
            out = part if out is None else out.unionByName(part)
        return out

    def close(self) -> None:
        for _, name, path in self.levels:
            self._drop(name, path)
        self.scratch.drop(*self.heads)
        self.levels, self.heads = [], []


SURROUNDINGS = pa.schema([("head", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()), ("first", pa.int32()), ("anchor", pa.int32()), ("alone", pa.bool_()), ("body", pa.binary())])
SURROUNDINGS_SPARK = "head long, doc_id long, th int, first int, anchor int, alone boolean, body binary"
#: A repeat, or for hot heads one window with its hash.
FOUND = pa.schema([("doc_id", pa.int64()), ("th", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("window", pa.int64()), ("alone", pa.bool_())])
FOUND_SPARK = "doc_id long, th int, a int, b int, window long, alone boolean"


#: Anchor places in a window that share a key, for heads with many surroundings.
PLACES = 17


def _by_places(head: int, first: int, anchor: int, around: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(key, first, anchor, bytes) for each run of PLACES: all windows with the anchor at one of them share the key's bytes."""
    after = len(around) - anchor
    for low in range(0, BEFORE + 1, PLACES):
        high = min(low + PLACES - 1, BEFORE)
        if max(low, LENGTH - after) > min(high, anchor):
            continue
        core = around[anchor - low : anchor + LENGTH - high]
        key = xxhash.xxh64_intdigest(core, (head * 16 + low) & 0xFFFFFFFFFFFFFFFF)
        start = max(0, anchor - high)
        yield key - (1 << 64) if key >> 63 else key, first + start, anchor - start, around[start : anchor + LENGTH - low]


def _cut_out(asked: DataFrame) -> DataFrame:
    """The bytes around the asked anchors of (doc_id, th, body, asked: [(position, head, alone, many)]).

    A head with many surroundings is divided: its rows get longer keys, by the places an anchor may have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bodies in _blocks(batches):
            rows = []
            for doc_id, th, asked, body in zip(columns["doc_id"], columns["th"], columns["asked"], bodies, strict=True):
                for a in asked:
                    first = max(0, a["position"] - BEFORE)
                    around, anchor = body[first : a["position"] + LENGTH], a["position"] - first
                    if a["many"]:
                        rows += [(key, doc_id, th, x, y, a["alone"], part) for key, x, y, part in _by_places(a["head"], first, anchor, around)]
                    else:
                        rows.append((a["head"], doc_id, th, first, anchor, a["alone"], around))
                    if len(rows) >= 4096:
                        yield rows_to_batch(rows, SURROUNDINGS)
                        rows = []
            yield rows_to_batch(rows, SURROUNDINGS)

    return asked.select("doc_id", "th", "asked", "body").mapInArrow(run, SURROUNDINGS_SPARK)


def _windows(block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in its bytes, hash) of each window of LENGTH bytes; the hash also tells the head and the anchor's place."""
    sizes = np.array([len(b) for b in block["body"]], np.int64)
    data = np.frombuffer(b"".join(block["body"]), np.uint8)
    rungs = _ladder(data, 128)
    counts = np.maximum(sizes - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[row] + start
    if not len(at):
        return row, start, np.empty(0, np.uint64)
    h = rungs[7][at] * _STEP[8] + rungs[6][at + 128]
    h ^= h >> np.uint64(31)
    h = h * _STEP[9] + rungs[3][at + 192]
    h ^= h >> np.uint64(30)
    h = (h + block["head"].astype(np.int64).view(np.uint64)[row]) * _LAST
    h += (block["anchor"].astype(np.int64)[row] - start).astype(np.uint64) * _STEP[7]
    return row, start, h ^ (h >> np.uint64(32))


def _compare(contexts: DataFrame) -> DataFrame:
    """Repeats among the surroundings of each head, for those that stand alone with theirs."""
    most = GROUP_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, is_open, _ in sorted_runs(batches, ["head"], most):
            for part in _parts(block, is_open):
                row, start, h = _windows(part)
                alone, first = part["alone"].astype(bool), part["first"].astype(np.int64)
                ids, ths = part["doc_id"], part["th"]
                a = first[row] + start
                if is_open:
                    n = len(row)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row].astype(np.int64)), pa.array(ths[row].astype(np.int32)), pa.array(a.astype(np.int32)), pa.array((a + LENGTH).astype(np.int32)), pa.array(signed(h)), pa.array(alone[row])], schema=FOUND) if n else rows_to_batch([], FOUND)
                    continue
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                twice = np.zeros(len(h), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                hit = np.flatnonzero(twice & alone[row])
                if not len(hit):
                    continue
                new = np.append(True, (row[hit][1:] != row[hit][:-1]) | (a[hit][1:] != a[hit][:-1] + 1))
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(hit)) - 1
                rows = row[hit][lo]
                n = len(lo)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows].astype(np.int64)), pa.array(ths[rows].astype(np.int32)), pa.array(a[hit][lo].astype(np.int32)), pa.array((a[hit][hi] + LENGTH).astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], schema=FOUND)

    width = shuffle_width(contexts.sparkSession)
    return contexts.repartition(width, "head").sortWithinPartitions("head").mapInArrow(run, FOUND_SPARK)


def _parts(block: dict[str, np.ndarray], anywhere: bool) -> Iterator[dict[str, np.ndarray]]:
    """Parts of a sorted block of about 4,000 rows, which split no head unless anywhere."""
    head = block["head"]
    n = len(head)
    edges = np.arange(n + 1) if anywhere else np.append(np.flatnonzero(np.append(True, head[1:] != head[:-1])), n)
    at = 0
    while at < n:
        cut = int(edges[np.searchsorted(edges, at + 4000, side="right") - 1])
        if cut <= at:
            cut = int(edges[np.searchsorted(edges, at, side="right")])
        yield {k: v[at:cut] for k, v in block.items()}
        at = cut


def repeats(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, home: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """(doc_id, th, a, b): byte ranges that the repeated strings of documents(doc_id, th, body) cover, unmerged.

    With a home, docs are added to the family that is stored there: their arrays are merge-scanned against its
    levels, and the ranges are those of strings that docs share with each other or with `earlier`, the documents
    added before, in both. What earlier documents share among themselves was told when they came.
    """
    family = SuffixArrays.stored(scratch, home) if home else SuffixArrays(scratch)
    kept = scratch.write(entries(docs), "entries")
    batch = F.pmod(F.xxhash64(F.coalesce("doc_id", "head")), F.lit(batches))
    # Later documents are compared with every entry that is stored.
    fit = F.col("kind").isin(IN_ARRAY, SHARED) & F.col("doc_id").isNotNull() if home else F.col("kind") == IN_ARRAY
    done = False
    try:
        for b in range(batches):
            family.add(kept.where(fit & (batch == b)).select(*ROW))
        found = family.shared().where("doc_id is not null")
        shared = scratch.write(found if home else found.unionByName(kept.where(F.col("kind") == SHARED).select(*ROW)), "shared")
        done = True
    finally:
        if home and done:
            family.save()
        elif not home:
            family.close()
    if earlier is not None:
        docs = docs.unionByName(earlier)
    groups = scratch.write(shared.groupBy("head", "around").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "th", "position")).alias("one")), "groups")
    whole = shared.join(groups.where("n > 1").select("head", "around"), ["head", "around"], "left_semi").unionByName(kept.where(F.col("kind") == REPEATED).select(*ROW))
    first = F.greatest(F.lit(0), F.col("position") - BEFORE)
    covered = whole.select("doc_id", "th", first.cast("int").alias("a"), (F.col("position") + F.col("after")).cast("int").alias("b")).where(F.col("b") - F.col("a") >= LENGTH)
    many = scratch.write(groups.groupBy("head").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("head", (F.col("kinds") > GROUP_ROWS).alias("many")), "many")
    asked = groups.join(many, "head").select("one.doc_id", "one.th", F.struct(F.col("one.position").alias("position"), "head", (F.col("n") == 1).alias("alone"), "many").alias("x")).groupBy("doc_id", "th").agg(F.collect_list("x").alias("asked"))
    # Surroundings on repeated rows are cut out for each; they don't stand alone, so that changes nothing.
    found = scratch.write(_compare(_cut_out(docs.join(asked, ["doc_id", "th"]))), "found")
    counted = found.where("window is not null")
    hot = counted.join(counted.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"), "window", "left_semi").where("alone")
    return covered.unionByName(found.where("window is null").select("doc_id", "th", "a", "b")).unionByName(hot.select("doc_id", "th", "a", "b"))


def merged(ranges: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of ranges packed as a << 32 | b."""
    out: list[list[int]] = []
    for packed in sorted(ranges):
        a, b = packed >> 32, packed & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def gathered(ranges: DataFrame) -> DataFrame:
    """(doc_id, th, runs): the packed ranges of each document that has any."""
    packed = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    return ranges.distinct().groupBy("doc_id", "th").agg(F.collect_list(packed).alias("runs"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Bytes covered by a LENGTH-byte string that also starts elsewhere, in the same or another document, are
    removed, all occurrences alike. Null and empty texts have no bytes; texts under LENGTH bytes lose none;
    repeated rows repeat each other; overlaps count; an empty table gives no rows; a null id is -1; extra
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    bodies = documents(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, texts in _blocks(batches):
            rows = []
            for doc_id, runs, body in zip(columns["doc_id"], columns["runs"], texts, strict=True):
                spans = merged(runs or [])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(body[at:a])
                    at = b
                kept.update(body[at:])
                rows.append((doc_id, len(body), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            yield rows_to_batch(rows, schema)

    return bodies.join(gathered(repeats(bodies, scratch, batches)), ["doc_id", "th"], "left").select("doc_id", "runs", "body").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
