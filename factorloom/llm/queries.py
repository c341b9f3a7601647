"""The registered queries of this subpackage: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import bpe, flac, licenses, packing, passages, pii, quality, simhash, suffixes, syncmers
from factorloom.llm.common import read_table
from factorloom.session import ship


def _over_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read_table(ship(spark), sf_dir, "documents"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary file, from the installed package that names its place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(ship(spark), sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_syncmer_fingerprints": _over_documents(syncmers.fingerprints),
    "op2_suffix_array_dedup": _over_documents(suffixes.without_repeats),
    "op3_simhash_pigeonhole": _over_documents(simhash.op3),
    "op4_quality_fourier": op4,
    "op5_compact_windows": _over_documents(passages.near_passages),
    "op6_tiered_packing": _over_documents(lambda docs: packing.pack(docs, vocabulary())),
    "op7_pii_field": _over_documents(pii.personal_data),
    "op8_flac_media": _over_documents(flac.op8),
    "op9_bpe_transducer": _over_documents(lambda docs: bpe.round_trip(docs, vocabulary())),
    "op10_license_scan": _over_documents(lambda docs: licenses.scan(licenses.with_paths(docs))),
}

_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
-- Every string of {suffixes.LENGTH} bytes by its hash; those that start in more than one place; their runs; what is left.
w AS (SELECT r, i, hash(b[i:i + {suffixes.LENGTH - 1}]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {suffixes.LENGTH - 2})) AS i FROM d)),
x AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM (
    SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + {suffixes.LENGTH} THEN 1 ELSE 0 END AS new FROM x)),
runs AS (SELECT r, min(i) AS a, max(i) + {suffixes.LENGTH} AS e FROM g GROUP BY r, k),
p AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 1) AS s FROM runs),
cut AS (SELECT r, sum(e - a) AS n_removed, count(*) AS n_spans, string_agg(hex(b[s:a - 1]), '' ORDER BY a) || hex(any_value(b)[max(e):octet_length(any_value(b))]) AS kept FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


def _terms(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({text}), '{licenses.SPLIT}'), lambda t: regexp_replace(t, '[.]+$', '')), lambda t: t <> '')"


_NAME, _PLACE = "CASE WHEN n % 8 = 0 THEN 'LICENSE-' || n ELSE 'doc' || n || '.txt' END", "coalesce(source, '') || '/' || (n // 512) || '/'"
_OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_PLACE} || CASE WHEN n % 64 = 0 THEN '' ELSE (n // 32) || '/' END || {_NAME} AS path FROM (SELECT *, coalesce(doc_id, 0) AS n FROM documents)),
f AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENCE_FILE}') AS named FROM d),
l AS (SELECT *, regexp_split_to_array(text, '\r?\n') AS lines FROM f WHERE regexp_matches(lower(text), '{licenses.KEYS}')),
k AS (SELECT *, list_filter(range(len(lines)), lambda i: regexp_matches(lower(lines[i + 1]), '{licenses.KEYS}')) AS keyed FROM l),
h AS (SELECT r, unnest(list_distinct(list_concat(list_concat(
    list_transform(keyed, lambda i: lines[i + 1]),
    list_transform(keyed, lambda i: array_to_string(lines[greatest(i - {licenses.BEFORE}, 0) + 1 : i + 1 + {licenses.BEHIND}], chr(10)))),
    CASE WHEN named THEN list_filter(regexp_split_to_array(text, '\r?\n[ \t]*\r?\n'), lambda x: trim(x, ' ') <> '') ELSE [] END))) AS unit FROM k),
known AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.template_list()))}) AS t(template, license, unit)),
-- TF-IDF: counts over all headers, weights of distinct ones, cosines to the templates.
u AS (SELECT unit, count(*) AS files FROM h GROUP BY unit),
every AS (SELECT unit, files FROM u UNION ALL SELECT unit, 1 FROM known),
df AS (SELECT term, sum(files) AS df FROM (SELECT files, unnest(list_distinct({_terms("unit")})) AS term FROM every) GROUP BY term),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT sum(files) FROM every)::DOUBLE) / (1.0::DOUBLE + df::DOUBLE)) + 1.0 AS idf FROM df),
raw AS (SELECT unit, term, (1 + ln(count(*)::DOUBLE)) * any_value(idf) AS w FROM (SELECT unit, unnest({_terms("unit")}) AS term FROM (SELECT unit FROM u UNION SELECT unit FROM known)) JOIN idf USING (term) GROUP BY unit, term),
v AS (SELECT unit, term, w / sqrt(sum(w * w) OVER (PARTITION BY unit)) AS w FROM raw),
near AS (SELECT a.unit, license, template, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN u ON a.unit = u.unit JOIN v b ON a.term = b.term JOIN known ON b.unit = known.unit GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= {licenses.LEAST}),
own AS (SELECT r, license, cosine FROM (SELECT r, license, cosine, row_number() OVER (PARTITION BY r ORDER BY cosine DESC, license) AS k FROM h JOIN near USING (unit)) WHERE k = 1),
dirs AS (SELECT dir, license FROM (SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path, license) AS k FROM f JOIN own USING (r) WHERE named) WHERE k = 1),
up AS (SELECT DISTINCT dir AS place FROM f),
above AS (SELECT place, arg_max(dirs.dir, length(dirs.dir)) AS near_dir, arg_max(dirs.license, length(dirs.dir)) AS near_license FROM up JOIN dirs ON dirs.dir = '' OR place = dirs.dir OR starts_with(place, dirs.dir || '/') GROUP BY place)
SELECT doc_id, path, own.license, cosine, CASE WHEN own.license IS NULL THEN near_license END AS inherited_license, CASE WHEN own.license IS NULL THEN near_dir END AS inherited_from
FROM f LEFT JOIN own USING (r) LEFT JOIN above ON above.place = f.dir
"""

#: The others' hashes, codecs, models and searches are out of SQL's reach; tests compare them with brute force.
ORACLES: dict[str, str] = {"op2_suffix_array_dedup": _OP2, "op10_license_scan": _OP10}
