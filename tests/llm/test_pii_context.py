"""The word before an identifier, also where it holds a digit, is long or is missing."""

import re

from pyspark.sql import functions as F

from tellumen.llm.pii import discover, instances, spans

LONG = "w" * 200


def test_patterns_equal_brute_force(spark):
    texts = ["acct2 998877 x", "12 ab 7", "call +49 (0) 123 456 789 now", "  \n5", f"{LONG}x 1 {LONG}y 2 {LONG}y3 4", "no digits", "a\t\n 9b 10 8"]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    got = {}
    for r in instances(spans(df)).collect():
        got.setdefault(r.rid, []).append((r.s, r.pattern))
    want = {}
    for k, t in enumerate(texts):
        w = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        for i, (s, x) in enumerate(w):
            if re.search("[0-9]", x):
                want.setdefault(k, []).append((s, re.sub("[0-9]+", "9", w[i - 1][1] if i else "^")))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_contexts_with_digits_are_learned_apart(spark):
    rows = [(k, f"text tel2 +49301234{k:03}5 end") for k in range(40)] + [(100 + k, f"text box3 {k} free") for k in range(200)] + [(k, f"{k} rows") for k in range(300, 400)]
    out = discover(spark.createDataFrame([*rows, (999, "text tel7 55-77 bye")], "doc_id long, text string"))
    got = {r.doc_id: [tuple(x) for x in r.b_context] for r in out.filter(F.size("b_context") > 0).collect()}
    assert got == {999: [(10, 15)]}
