import math
import random
import tracemalloc
from collections import Counter

import brute_models
import numpy as np
import pyarrow as pa
import pytest
from onomast.llm import kneser_ney


@pytest.mark.parametrize("smoothing", ["kn", "mkn", "wb"])
def test_model_against_dictionaries(smoothing):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd é漢") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    order = 4
    keys, counts = np.unique(np.concatenate([kneser_ney.ngram_keys(pa.array([x]), order)[0] for x in texts]), return_counts=True)
    model = kneser_ney.NgramModel(keys, counts, order, smoothing)
    p = brute_models.model(texts, order, smoothing)
    for x in ("abcda", "", "é漢漢", "zzz", "a" * 30, "Жb"):
        sums, n = kneser_ney.text_scores(pa.array([x]), [model])
        padded = "\1" * (order - 1) + x
        assert n[0] == len(x) and math.isclose(sums[0, 0], sum(math.log(p(padded[i : i + order])) for i in range(len(x))), rel_tol=1e-6, abs_tol=1e-6)
    # the symbols' probabilities after any context sum to at most one
    bits = kneser_ney.bits_of(order)
    context = int(kneser_ney.ngram_keys(pa.array(["abc"]), order)[0][-1]) << bits & (1 << 60) - 1
    assert np.exp(model.log_probability(np.arange(1 << bits).astype(np.uint64) | np.uint64(context))).sum() <= 1 + 1e-5


def test_long_texts_in_stretches(monkeypatch, spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é漢") for _ in range(n)) for n in (3000, 0, 2, 700)] + [None]
    whole = [kneser_ney.ngram_keys(pa.array([x], pa.string()), 4)[0].tolist() for x in texts]
    monkeypatch.setattr(kneser_ney, "WINDOW", 100)
    monkeypatch.setattr(kneser_ney, "slices", lambda x: ((i, x.slice(i, 1)) for i in range(len(x))))
    got = [[] for _ in texts]
    for rows, keys, n in kneser_ney.windows(pa.array(texts), 4):
        got[rows[0]] += keys.tolist()
        assert len(rows) == len(n) == 1 and n[0] == len(keys)
    assert got == whole


def test_counts_given_out_in_parts(monkeypatch, spark):
    df = spark.createDataFrame([("en", "abcabcabd"), ("en", None), (None, "xyz"), ("de", "abc")], "l string, t string")
    counts = {(r.label, r.gram): r.n for r in kneser_ney.count_ngrams(df, df.t, df.l, 3).collect()}
    want = Counter()
    for label, x in (("en", "abcabcabd"), ("de", "abc")):
        want.update((label, int(k)) for k in kneser_ney.ngram_keys(pa.array([x]), 3)[0])
    assert counts == want


def test_scoring_takes_little_memory(monkeypatch):
    """Two workers of an executor score at once: the arrays of a whole slice took some 48 times its text."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts = pa.array([None, ""] + [" ".join(rng.choice(words) for _ in range(400)) for _ in range(450)])
    model = kneser_ney.NgramModel(*np.unique(kneser_ney.ngram_keys(texts, 4)[0], return_counts=True), 4)
    tracemalloc.start()
    sums, n = kneser_ney.text_scores(texts, [model, model], low=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * n.sum()
    monkeypatch.setattr(kneser_ney, "SCORED", 1 << 30)
    whole, again = kneser_ney.text_scores(texts, [model, model], low=2)
    assert np.array_equal(n, again) and np.allclose(sums, whole, rtol=1e-9)
