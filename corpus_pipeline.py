"""The corpus pipeline: quality, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as Parquet and hands
it to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import packing, pii, quality, simhash, suffixes
from factorloom.llm.common import Scratch, read_table
from factorloom.llm.queries import vocabulary
from factorloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The least Jaccard similarity of near-duplicates, on sets of five-word shingles.
SIMILAR = 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more, learned from the labels of this stage's input."""
    ship(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id, then the least hash of its text.

    A null id counts as -1, and rows of one id with different texts are documents of their own. Words are compared in runs of five. Documents without words are equal to each other.
    """
    ship(spark)
    scratch = Scratch(spark, "near")
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-1)).cast("long")).withColumn("uid", F.xxhash64(text))
    rows = docs.select("key", "uid", text.cast("binary").alias("body"))
    classes = simhash.similar_texts(rows, scratch, SIMILAR)
    named = rows.select("key", "uid").join(classes, F.col("uid") == F.col("id"), "left").withColumn("class", F.coalesce("component", "uid"))
    first = named.groupBy("class").agg(F.min(F.struct("key", "uid")).alias("kept")).select("kept.*")
    return docs.join(first, ["key", "uid"], "left_semi").dropDuplicates(["key", "uid"]).select(*COLUMNS)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that also start elsewhere.

    A range is narrowed to whole characters; documents that nothing is left of stay, as empty texts.
    """
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    bodies = suffixes.documents(docs)
    ranges = suffixes.repeats(bodies, scratch)
    schema = pa.schema([("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            kept = [shortened(t, suffixes.merged(r or [])) for t, r in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("runs")).to_pylist(), strict=True)]
            text = pa.array(kept, schema.field(0).type)
            columns = {n: batch.column(i) for i, n in enumerate(names)} | {"text": text}
            yield pa.RecordBatch.from_arrays([columns[n] for n in COLUMNS], names=list(COLUMNS))

    keyed = docs.select(*COLUMNS).withColumn("th", suffixes.short_hash(F.coalesce("text", F.lit("")))).withColumn("key", F.coalesce("doc_id", F.lit(-1).cast("long")))
    gathered = suffixes.gathered(ranges).withColumnRenamed("doc_id", "key")
    whole = keyed.join(gathered, ["key", "th"], "left").select(*COLUMNS, "runs")
    spark_schema = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in COLUMNS)
    return whole.mapInArrow(cut, spark_schema).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))


def shortened(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without spans of its UTF-8 bytes, each narrowed to whole characters."""
    if text is None or not spans:
        return text
    body, out, at = text.encode(), [], 0
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]]).decode()


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in angle brackets."""
    ship(spark)
    return pii.redacted(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of up to 4096 tokens."""
    ship(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each),
    ("suffix-array dedup", no_repeats),
    ("pii", no_personal_data),
    ("packing", packed),
]

#: No stage but the packing's arithmetic is within SQL's reach; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = read_table(ship(spark), sf_dir, "documents")
    scratch = Scratch(spark, "stages")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
