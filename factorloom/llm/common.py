"""What the operators of this subpackage share: inputs, durable tables, sorted groups, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = False) -> DataFrame:
    """The two columns an operator needs, as doc_id and body; a null text is the empty text."""
    body = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), (body.cast("binary") if binary else body).alias("body"))


#: Shuffle files go when their query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the folder that spark.checkpoint.dir names, so that no executor's loss costs a result.

    They replace checkpoint(): Parquet is smaller than serialised rows. drop() removes a table that
    nothing reads any more; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file:///tmp/checkpoints/factorloom"
        self.home = f"{root.rstrip('/')}/{job}-{uuid.uuid4().hex}"
        self.made = 0
        where, system = self._place(self.home)
        system.mkdirs(where)
        system.deleteOnExit(where)  # what drop() hasn't removed goes with the application

    def _place(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table; the shuffle files that it took are deleted when it is written."""
        self.made += 1
        path = f"{self.home}/{self.made:03d}-{name}"
        conf = self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := getattr(table, "_scratch_path", None):
                where, system = self._place(path)
                system.delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[tuple[list[int], list]]:
    """(doc_ids, bodies) in blocks of at most `rows` rows and about `size` bytes; a longer text comes alone."""
    for batch in batches:
        ids, bodies = batch.column(0).to_pylist(), batch.column(1)
        start, held = 0, 0
        lengths = pc.binary_length(bodies).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield ids[start:i], bodies.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if len(ids) > start:
            yield ids[start:], bodies.slice(start).to_pylist()


def release_memory() -> None:
    """Give freed memory back to the system: Spark deals its tasks to all workers that wait, and each keeps what it took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, bool, bool]]:
    """Blocks of whole groups from a partition sorted by keys.

    Yields (columns, bounds, open, goes_on): rows bounds[i]:bounds[i+1] are one group. A group of more
    than `most` rows comes alone in several blocks; open says that this block continues such a group or
    starts one, goes_on that more of it follows. So memory holds one batch and at most `most` rows.
    """
    held: dict[str, np.ndarray] | None = None
    spilling: tuple | None = None  # key of a group that is being passed on in parts
    for batch in batches:
        block = {n: _numpy(batch.column(i)) for i, n in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        if held is not None:
            block = {n: np.concatenate([held[n], block[n]]) for n in block}
            held = None
        size = len(block[keys[0]])
        change = np.zeros(size, bool)
        change[0] = True
        for k in keys:
            change[1:] |= block[k][1:] != block[k][:-1]
        starts = np.flatnonzero(change)
        first = tuple(block[k][0] for k in keys)
        if spilling is not None:
            if first == spilling:
                end = int(starts[1]) if len(starts) > 1 else size
                part = {n: v[:end] for n, v in block.items()}
                yield part, np.array([0, end]), True, len(starts) == 1
                if len(starts) == 1:
                    continue
                block = {n: v[end:] for n, v in block.items()}
                starts = starts[1:] - end
                size -= end
            spilling = None
        last = int(starts[-1])
        if last:
            yield {n: v[:last] for n, v in block.items()}, starts, False, False
        rest = {n: v[last:] for n, v in block.items()}
        if size - last > most:
            spilling = tuple(rest[k][0] for k in keys)
            yield rest, np.array([0, size - last]), True, True
        else:
            held = rest
    if held is not None:
        yield held, np.array([0, len(held[keys[0]])]), False, False


def _numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_string(column.type):
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(id, component): the least id that each id of edges(a, b) reaches.

    Large-star and small-star contraction: every round is two aggregations by key with map-side
    combining and two joins. The least neighbours are written first, since adaptive execution splits a join's
    large partitions only if both sides are plain; so a hub needs no task of its own, and after that join few
    edges share an end. Each round's edges are written, which also cuts lineage. Null ends are dropped; loops
    and repeats are harmless; no edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct()
    table = scratch.write(now, "edges")
    mark = _mark(table)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = table.select("u", "v").unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = scratch.write(small, "edges")
        scratch.drop(table, least)
        table, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    both = table.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(table.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return scratch.write(both.distinct(), "components")


def _mark(table: DataFrame) -> tuple:
    """Rows and an order-free digest; equal for equal edge sets."""
    row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def hex_digest(column: Column) -> Column:
    return F.lower(F.sha2(column, 256))
