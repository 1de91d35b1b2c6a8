"""Planted paraphrases and verbatim items of every length against the word rule by brute force."""

import numpy as np

from tellumen.llm import decontam

HOSTS = 300


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_planted_items(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{k}" for k in range(3000)]
    share = 1 / np.arange(1, 3001)
    draw = lambda n: list(rng.choice(vocab, n, p=share / share.sum()))
    items, docs, want, sure = [], [], set(), set()
    for k in range(HOSTS):
        m = int(rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 16, 25, 40, 60]))
        # Items of rarer words, as those of common words stand in many texts anyway.
        item = list(rng.choice(vocab[200:], m, replace=False))
        keep = rng.choice([1.0, 0.9, 0.8, 0.7])
        text = [w if rng.random() < keep else str(rng.choice(vocab)) for w in item]
        host, at = draw(int(rng.integers(60, 400))), int(rng.integers(0, 60))
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(host[:at] + text + host[at:])))
        tail = item[-max(3, m // 4) :]
        both = lcs(item, text) / m
        if both >= (1 if m < 6 else 0.8) or (m >= 6 and both >= 0.55 and lcs(tail, text) / len(tail) >= 0.6):
            want.add((k, k))
        if text == item:
            sure.add((k, k))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert sure <= found and len(want & found) >= 0.95 * len(want) and len(want - sure) > 50
    words = {d: t.split() for d, t in docs}
    for r in got:
        item = items[r.item_id][1].split()
        # Every hit obeys the rule on the whole text, and clean documents are left alone.
        assert lcs(item, words[r.doc_id]) >= (len(item) if len(item) < 6 else 0.55 * len(item))
    assert sum(len(items[i][1].split()) >= 6 for _, i in found - want) < 0.02 * HOSTS


def test_chunks_of_windows_and_long_texts(spark):
    """A window chunk is smaller than one long text's windows."""
    rng = np.random.default_rng(8)
    item = [f"q{k}" for k in range(24)]
    body = [f"w{k}" for k in rng.integers(0, 500, 60000)]
    rows = [(1, " ".join(body[:59000] + item + body[59000:])), (2, " ".join(body))]
    many = [(k, " ".join(f"z{k}_{j}" for j in range(24))) for k in range(1, 3000)] + [(0, " ".join(item))]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(many, "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.verbatim) for r in got.collect()] == [(1, 0, True)]
