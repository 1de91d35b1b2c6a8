"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tellumen.llm import ann, chat, decontam, linededup, minhash, mixing, pii, quality, rnnlm, toxicity

LONG = "alpha beta gamma delta " * 5000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "src1"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "src1"),
    (3, None, None, None),
    (4, "", "en", "x"),
    (5, LONG, "de", "src2"),
    (5, LONG, "de", "src2"),
    (None, "one two three", None, "src3"),
    (7, "mail a.b@c.de +49 (0) 123 456 789 at 10.0.0.255 or 256.1.1.1", "fr", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names operators use inside.
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(1) for k in ("h", "pos", "th", "n", "gone", "score", "band", "rep", "epoch", "tokens", "part", "k_id")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("1 = 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (5, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, "")], "item_id long, text string")


def test_minhash(docs, none):
    got = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert (1, 1, True, 10) in got and (2, 1, False, 10) in got and (3, 3, True, 0) in got and (4, 4, True, 0) in got
    assert (None, None, True, 1) in got and len(got) == 7
    assert minhash.near_duplicates(none, 3, 85).count() == 0


def test_linededup(spark, docs, none):
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "ld_chunks", "ld_removed"] and out.count() == len(ROWS)
    assert linededup.dedup_lines(none).count() == 0
    passage = " ".join(f"w{k}" for k in range(60))
    two = spark.createDataFrame([(1, f"first\n{passage}\nend"), (2, f"other start\n{passage}\nstop"), (3, f"{passage} tail")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(two).collect()}
    assert got == {1: f"first\n{passage}\nend", 2: "other start\nstop", 3: f"{passage} tail"}


def test_decontam(docs, none, items):
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(1, 1), (2, 1)}
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs, items.filter("1 = 0")).count() == 0


def test_quality(docs, none, labels):
    got = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    assert got[3] is False and got[4] is False and got[1] is True and len(got) == 7
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.filter("1 = 0")).filter("kept").count() == 5


def test_lm(docs, none):
    got = {(r.doc_id, r.n_tokens) for r in rnnlm.language_model_scores(docs, top=64, frequent=32).collect()}
    assert {(3, 1), (4, 1), (5, 20001), (1, 13)} <= got and len(got) == 7
    assert rnnlm.language_model_scores(none, top=64, frequent=32).count() == 0


def test_mixing(docs, none):
    out = mixing.mix_sources(docs)
    assert out.filter("cum_tokens > leaf_budget").count() == 0 and out.count() > 0
    assert mixing.mix_sources(none).count() == 0


def test_toxicity(docs, none, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.filter("1 = 0")).filter("score = 0").count() == len(ROWS)


def test_pii(docs, none):
    out = pii.discover(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS) and [tuple(x) for x in got[7].b_email] == [(5, 13)] and len(got[7].b_ip) == 1 and len(got[7].b_phone) == 1
    assert pii.discover(none).count() == 0


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a\\b ### </turn>"), (1, 1, "assistant", None), (None, 0, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y")], "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    out = chat.format_conversations(rows).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(x) for x in got[1].back] == [("user", "a\\b ### </turn>"), ("assistant", "")] and got[1].valid
    assert not got[2].valid and got[2].n_turns == 2 and not got[None].valid
    assert chat.format_conversations(rows.filter("1 = 0")).count() == 0


def test_ann(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    top = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert {r.query_id for r in got} == {0, 50} and [v for _, v in top][:2] == [21, 42] and len(top) == 5
    assert ann.nearest(df.filter("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id in (0, 1)"), F.col("vec_id") == 0).count() == 1
