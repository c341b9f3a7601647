"""Document fingerprints from closed syncmers, with DataFrame functions only.

A run of K words is an anchor if the least of its S-word parts lies at its start or its end. Whether a
run is an anchor depends on nothing around it, so equal passages have equal anchors wherever they
stand. A fingerprint is a bottom sketch of a document's anchors; likeness is the sketches' estimate of
the anchors' Jaccard similarity, which is exact below SKETCH anchors. Where a text has no anchor, all
its runs count.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import shuffle_width

#: Words in a run, and in the parts of which the least is sought.
K, S = 5, 2
#: Anchors kept in a fingerprint: those with the least hashes.
SKETCH = 64
SPACES = " \t\n\x0b\x0c\r"
CELLS = 256
#: Ranges of ids for each shuffle partition: so many that their hashes fill partitions about evenly.
RANGES = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _short(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def word_codes(text: Column) -> Column:
    """The hash of each word of the text; none for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w)))


def _run_at(codes: Column, i: Column) -> Column:
    return _short(F.xxhash64(*(F.get(codes, i + j) for j in range(K))))


def _anchor_at(codes: Column, parts: Column, i: Column) -> Column:
    """The hash of the run at word i if it is a closed syncmer, else null."""
    last = K - S
    inner = F.least(*(F.get(parts, i + j) for j in range(1, last)))
    edge = F.least(F.get(parts, i), F.get(parts, i + last))
    return F.when(edge <= inner, _run_at(codes, i))


def _over_runs(codes: Column, entry: Callable[[Column, Column], Column], every: Callable[[Column], Column]) -> Column:
    """What entry gives for the runs that are anchors, or every for all runs if none is."""
    n = F.size(codes)
    parts = F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
    runs = F.sequence(F.lit(0), n - K)
    found = let(parts, lambda p: F.filter(F.transform(runs, lambda i: entry(p, i)), lambda x: x.isNotNull()))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.transform(runs, every)))


def anchors(text: Column) -> Column:
    """Array of (position in words, hash) of the text's anchors, in order; for texts under K words every word."""

    def body(codes: Column) -> Column:
        def entry(parts: Column, i: Column) -> Column:
            found = _anchor_at(codes, parts, i)
            return F.when(found.isNotNull(), F.struct(i.cast("int").alias("position"), found.alias("hash")))

        def every(i: Column) -> Column:
            return F.struct(i.cast("int").alias("position"), _run_at(codes, i).alias("hash"))

        words = F.transform(codes, lambda c, i: F.struct(i.cast("int").alias("position"), _short(c).alias("hash")))
        return F.when(F.size(codes) < K, words).otherwise(_over_runs(codes, entry, every))

    return let(word_codes(text), body)


def sketch(text: Column) -> Column:
    """The SKETCH least distinct anchor hashes, sorted."""

    def body(codes: Column) -> Column:
        hashes = F.when(F.size(codes) < K, F.transform(codes, _short)).otherwise(_over_runs(codes, lambda parts, i: _anchor_at(codes, parts, i), lambda i: _run_at(codes, i)))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)

    return let(word_codes(text), body)


def as_text(sketched: Column) -> Column:
    """A sketch as hexadecimal digits, eight for each anchor."""
    return F.lower(F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two documents' anchors by their sketches; two empty ones: 1."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), least)) / F.greatest(F.size(least), F.lit(1)).cast("double"))


def matches(left: DataFrame, right: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(left_id, right_id, shift, runs): anchors that two tables' documents share, by difference of position.

    Rows of equal text are matched once, by their least id. A run that many texts share pairs them all,
    so this is for a stated set of queries on one side.
    """

    def placed(docs: DataFrame, name: str) -> DataFrame:
        once = docs.groupBy(docs[text_col].alias("t")).agg(F.min(docs[id_col]).alias(name))
        return once.select(name, F.explode(anchors(F.col("t"))).alias("a")).select(name, F.col("a.position").alias(f"p_{name}"), F.col("a.hash").alias("hash"))

    both = placed(left, "left_id").join(placed(right, "right_id"), "hash")
    return both.groupBy("left_id", "right_id", (F.col("p_right_id") - F.col("p_left_id")).alias("shift")).agg(F.count(F.lit(1)).alias("runs"))


def order_buckets(docs: DataFrame, id_col: str) -> Column:
    """Equally filled ranges of ids, numbered upward; null ids are in range -1.

    CELLS quantiles of all ids reach the driver, and each cell is divided evenly, so the number of ranges
    follows the number of shuffle partitions.
    """
    row = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / CELLS for i in range(CELLS + 1)], 10_000).alias("q")).first()
    edges = sorted(set(row["q"] or [0]))
    within = max(1, ceil(RANGES * shuffle_width(docs.sparkSession) / len(edges)))
    table = F.array(*(F.lit(int(e)).cast("long") for e in edges))
    at = F.col(id_col).cast("long")
    cell = F.size(F.filter(table, lambda e: e <= at))
    low, high = F.get(table, cell - 1), F.get(table, cell)
    part = F.least(F.lit(within - 1), F.floor((at.cast("double") - low) / (high.cast("double") - low) * within))
    return F.coalesce((cell * within + F.coalesce(part, F.lit(0))).cast("long"), F.lit(-1).cast("long"))


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """docs(doc_id, text) and what is derived from text, with next_<c> of each: that of the document with the next lower id.

    After the last comes the first. The rows are shuffled once, by ranges of ids; the first row of each
    range is added to the range above it, so no row needs another partition. Those few rows are picked before
    anything is derived from them. Equal ids follow each other by text.
    """
    docs = docs.withColumn("bucket", order_buckets(docs, "doc_id"))
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    line = Window.orderBy(F.desc("bucket"))
    # A row for each range: above is the range whose last document is followed by this one's first.
    ranges = tops.withColumn("above", F.coalesce(F.lag("bucket").over(line), F.min("bucket").over(Window.partitionBy()))).select(F.col("bucket").alias("b"), "top", "above")
    heads = docs.join(F.broadcast(ranges), (docs["bucket"] == ranges["b"]) & docs["doc_id"].eqNullSafe(ranges["top"]))
    heads = heads.groupBy("above", "doc_id").agg(F.min("text").alias("text")).select(F.col("above").alias("bucket"), "doc_id", "text", F.lit(1).alias("added"))
    rows = docs.withColumn("added", F.lit(0)).unionByName(heads).withColumns(derived)
    order = Window.partitionBy("bucket").orderBy("added", F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *derived)})
    return rows.where("added = 0").drop("added", "bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every text, of its edited text, and their likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has its last third replaced by the start of the next document's, by descending id. Null
    texts count as empty; texts without words have the empty fingerprint, alike to each other alone;
    repeated rows follow one another; rows with a null id come after all others and keep it; a lone document is its own next; extra columns are ignored.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = with_next(base, {"sketch": sketch(F.col("text"))})
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
