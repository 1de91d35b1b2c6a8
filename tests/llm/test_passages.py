"""Line dedup against a brute-force version: shared runs of whole lines, in differing contexts."""

import numpy as np

from tellumen.llm.linededup import dedup_lines


def shared_lines(texts, least):
    """Lines of each text inside a run of lines with `least` words or more that stands at an earlier place too."""
    seen, out = {}, {}
    for i, t in sorted(texts.items()):
        lines = t.split("\n")
        out[i] = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least:
                    first = seen.setdefault("\n".join(lines[a:b]), (i, a))
                    if first != (i, a):
                        assert first[0] != i
                        out[i] |= set(range(a, b))
    return out


def test_passages_of_short_lines_go_in_every_context(spark):
    rng = np.random.default_rng(3)
    line = lambda tag, n: " ".join(f"{tag}{rng.integers(1 << 40)}" for _ in range(n))
    passages = [[line("p", 60 // k) for _ in range(k)] for k in (2, 3, 4, 6) for _ in range(5)]
    texts = {}
    for i in range(60):
        parts = []
        for p in rng.choice(len(passages), 3, replace=False):
            parts += [line(f"x{i}_", int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 4)))] + passages[p]
        texts[i] = "\n".join([*parts, line(f"x{i}_", 5)])
    want = shared_lines(texts, 50)
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(map(len, want.values())) > 400
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in texts.items()}


def test_overlapping_copies_leave_the_first(spark):
    a = [" ".join(f"{c}{k}" for k in range(25)) for c in "abc"]
    texts = {1: "\n".join([a[0]] * 4), 2: "\n".join(["x", a[1], a[2], "y"]), 3: "\n".join([a[2], a[1], a[2]])}
    got = {r.doc_id: (r.text, r.ld_removed > 0) for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1] == ("\n".join([a[0]] * 2), True) and got[2] == (texts[2], False) and got[3] == (a[2], True)
