"""Every stage of the pipeline against brute force on a small table."""

import random
import re

import pytest

import corpus_pipeline as pipeline
from factorloom.llm import pii, quality, simhash

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    rng = random.Random(2)

    def fresh(n):
        return " ".join(rng.choice(WORDS) + str(rng.choice("abcdefghij")) for _ in range(n))

    rows = []
    for i in range(160):
        text = fresh(120)
        rows.append((i, text if i % 4 else " ".join(w.upper() + "###" for w in text.split())))
    passage = fresh(60)
    copy = rows[1][1]
    rows += [(200, copy), (201, copy + " more"), (202, fresh(50) + " " + passage + " " + fresh(50)), (203, passage + " " + fresh(70)), (204, fresh(40) + " x@mail.example.com é " + fresh(40)), (205, ""), (206, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(rows), passage


def test_stages(spark, place):
    path, texts, passage = place
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, path).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert not kept & set(range(0, 160, 4)) and set(range(160)) - set(range(0, 160, 4)) <= kept
    assert good.columns == list(pipeline.COLUMNS)
    once = stages["simhash near-dedup"](spark, good, path).cache()
    left = {r["doc_id"] for r in once.collect()}
    assert 1 in left and not left & {200, 201} and {202, 203} & kept <= left
    cut = {r["doc_id"]: r for r in stages["suffix-array dedup"](spark, once, path).collect()}
    assert set(cut) == left
    for d in {202, 203} & left:
        assert passage[20:-20] not in cut[d]["text"] and cut[d]["n_chars"] == len(cut[d]["text"])
    assert cut[5]["text"] == texts[5]
    clean = {r["doc_id"]: r["text"] for r in stages["pii"](spark, once, path).collect()}
    if 204 in clean:
        assert "<EMAIL>" in clean[204]
    field = pii.train(pii.labelled_rows())
    for d, t in clean.items():
        assert t is None or not pii.base_spans(t) and (d == 204 or t == texts[d] or pii.Finder(field).find([texts[d]])[0][1])
    pieces = stages["packing"](spark, once, path)
    assert {r["doc_id"] for r in pieces.collect()} == left


def runs_of(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_just_above_and_below(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(150)]
        # Three or four changed words: a similarity of 0.81 or 0.76.
        other = list(words)
        for at in range(20, 140 if i % 2 else 110, 30):
            other[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    likeness = [len(runs_of(rows[j][1]) & runs_of(rows[j + 1][1])) / len(runs_of(rows[j][1]) | runs_of(rows[j + 1][1])) for j in range(0, 120, 2)]
    assert min(likeness[::2]) >= 0.8 > max(likeness[1::2])
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in pipeline.one_of_each(spark, df, "").collect()}
    assert kept == set(range(0, 120, 2)) | {2 * i + 1 for i in range(1, 60, 2)}


def test_a_family_of_like_texts_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 16)
    monkeypatch.setattr(simhash, "BLOCK", 16, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    rng = random.Random(9)

    def fresh(n):
        return [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n)]

    family, rows = fresh(200), []
    for i in range(70):
        own = fresh(45)
        # The template is most of each text; only the two texts with one ending are alike enough.
        rows += [(2 * i, " ".join(family + own)), (2 * i + 1, " ".join(family + own + fresh(3)))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        kept = {r["doc_id"] for r in pipeline.one_of_each(spark, df, "").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(runs_of(rows[0][1]) & runs_of(rows[2][1])) < 0.8 * len(runs_of(rows[0][1]) | runs_of(rows[2][1]))
    assert kept == set(range(0, 140, 2))


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[3]), (2, texts[4]), (7, texts[4]), (7, texts[5])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in pipeline.one_of_each(spark, df, "").collect()), key=str)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (2, texts[4]), (7, texts[5])], key=str)


def test_whole_run(spark, place):
    path, _, _ = place
    rows = pipeline.run(spark, path).collect()
    assert len({r["doc_id"] for r in rows}) > 100


@pytest.mark.parametrize(("text", "spans", "want"), [("héllo", [(2, 4)], "hélo"), ("abc", [(0, 3)], ""), (None, [(0, 1)], None), ("日本", [(1, 4)], "日本")])
def test_cuts_keep_whole_characters(text, spans, want):
    assert pipeline.shortened(text, spans) == want


def test_statistics_of_odd_texts():
    for text in (b"", b" ", b"\n\n", b"a", "漢".encode() * 9):
        assert len(quality.statistics(text)) == len(quality.FEATURES)


def test_stage_list():
    assert [re.sub(r"\W", " ", n) for n, _ in pipeline.STAGES] == ["quality classifier", "simhash near dedup", "suffix array dedup", "pii", "packing"]
