"""Contract cases: roles with separators, distinct seeds, documents with several texts, small chunks, target weights."""

import collections

import numpy as np
from pyspark.sql import functions as F

from tellumen.llm import chat, linededup, minhash, mixing, pii


def test_roles_with_separators_read_back(spark):
    roles = ["a: b", ":", "User", "x\\c", "\\", "###", "</turn>", "a:b: c", "", "system"]
    rows = [(k, 0, r, f"{r}: hello: {r}") for k, r in enumerate(roles)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [tuple(x) for x in r.back] for r in out.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert got == {k: [(r, t)] for k, _, r, t in rows}


def test_copies_of_one_seed_are_one_seed(spark):
    rows = [(k, f"text {k} contact: same@mail.com and more") for k in range(40)] + [(99, "text contact: user7#mail bye")]
    assert pii.discover(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.size("b_context") > 0).isEmpty()
    rows = [(k, f"text {k} contact: name{'abcdefgh'[k % 8] * (k // 8 + 1)}@mail.com and more") for k in range(40)] + rows[-1:]
    assert [r.doc_id for r in pii.discover(spark.createDataFrame(rows, "doc_id long, text string")).filter(F.size("b_context") > 0).collect()] == [99]


def test_many_matches_in_one_text(spark):
    """Offsets over several blocks of matches."""
    import re

    rng = np.random.default_rng(3)
    text = " ".join(str(rng.choice(["a@b.cd", "word", "10.0.0.1", "x9", "éé"])) for _ in range(4000))
    r = pii.discover(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).filter("doc_id = 1").first()
    assert [tuple(x) for x in r.b_email] == [m.span() for m in re.finditer("a@b.cd", text)]
    assert [tuple(x) for x in r.b_ip] == [m.span() for m in re.finditer(r"10\.0\.0\.1", text)]


def test_a_document_with_two_texts_joins_their_groups(spark):
    rng = np.random.default_rng(5)
    a, b = ([f"{t}{k}" for k in rng.integers(0, 10**6, 80)] for t in "ab")
    near = lambda w, k: " ".join([*w[:k], "new", *w[k + 1 :]])
    rows = [(1, " ".join(a)), (5, near(a, 3)), (5, near(b, 3)), (9, " ".join(b)), (7, "nothing like it at all")]
    for _ in range(2):
        got = collections.defaultdict(set)
        for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect():
            got[r.doc_id].add(r.component_id)
        assert got == {1: {1}, 5: {1}, 9: {1}, 7: {7}}
        rows = rows[::-1]


def test_small_chunks_go(spark):
    """A repeated chunk of two short lines is removed, lines without words are not."""
    shared = "\n".join(f"k{i}" for i in range(12))
    rows = [(i, f"head{i} x{i} y{i}\n{shared}\n\n\n\ntail{i} z{i}") for i in range(30)]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [sum(f"k{i}" in out[d].split() for i in range(12)) for d in range(30)]
    assert left[0] == 12 and max(left[1:]) < 12 and all(out[d].endswith(f"\n\n\n\ntail{d} z{d}") and out[d].startswith(f"head{d}") for d in range(30))


def test_hot_chunks_equal_cold_ones(spark):
    passage = "\n".join(" ".join(f"p{k}_{j}" for j in range(30)) for k in range(3))
    rows = [(i, f"only {i} here {i}\n{passage}\nend of {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r.text for r in linededup.dedup_lines(df, hot_share=s).collect()} for s in (1, 10**9))
    assert a == b == {i: t if not i else f"only {i} here {i}\nend of {i}" for i, t in rows}


def test_weights_are_a_parameter(spark):
    rows = [(i, "one two three four", "en", f"src{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    only = lambda level: F.when(F.lit(level != "source") | (F.col("source") == "src1"), 1.0).otherwise(0.0) if level == "source" else F.lit(1.0)
    got = {r.source for r in mixing.mix_sources(df, portion=0.3, weight=only).collect()}
    assert got <= {"src0", "src1"} and "src1" in got
