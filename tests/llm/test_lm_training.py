"""Every training segment trains in exactly one round, whatever its first word."""

import numpy as np
import pyarrow as pa

from tellumen.llm import rnnlm


def test_documents_with_one_first_word_train(spark):
    """Sentences of a fixed order, all with one opening: counts alone cannot predict them, a trained model can."""
    rng = np.random.default_rng(2)
    order = [f"w{k}" for k in range(20)]
    rows = [(i, " ".join(["the", *(order[(s + k) % 20] for k in range(60))]), "en") for i, s in enumerate(rng.integers(0, 20, 2000))]
    got = rnnlm.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), top=64, frequent=32).filter("held_out").collect()
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.3


def test_each_segment_has_one_round():
    voc = rnnlm.Vocabulary(rnnlm.tx.HashIndex(np.zeros(0, np.uint64)), np.zeros(0), np.zeros(0, int), np.zeros((1, 2, 4096)), np.zeros(1), 1.0, 1.0, 1.0, np.ones(3), 32)
    text = pa.array(["the " * n for n in (1, 10, 255, 256, 700)] * 40 + [""])
    key = rnnlm.tx.mix(np.arange(len(text), dtype=np.uint64))
    sizes = [sorted(len(x[0]) for x in rnnlm.drawn_segments(text, key, voc, k, 2, 1.0, 256)) for k in range(2)]
    want = sorted([2, 11, 256, 256, 1, 256, 256, 189] * 40 + [1])
    assert sorted(sizes[0] + sizes[1]) == want and all(0.3 < len(x) / len(want) < 0.7 for x in sizes)
