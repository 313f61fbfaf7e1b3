import random
import re

import pytest
from onomast.functions import normalize as N
from onomast.functions import rules, similarity
from onomast.functions import tokens as T
from onomast.functions.automaton import Automaton
from pyspark.sql import functions as F


def values(spark, rows, *made):
    names = "abcdefgh"[: len(rows[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [tuple(r)[1:] for r in df.select("i", *[m.alias(f"x{k}") for k, m in enumerate(made)]).orderBy("i").collect()]


VECTORS = {
    "IL-2": "il 2", "TNFalpha": "tnf alpha", "TNF-alpha": "tnf alpha", "p53": "p 53", "STAT5B": "stat 5 b", "HLA-DRB1": "hla drb 1", "IL2RA": "il 2 ra", "LERKs": "lerk s", "14-3-3 zeta": "14 3 3 zeta",
    "type II collagen": "type 2 collagen", "Receptor for activated C kinase 1": "receptor activated c kinase 1", "for": "for", "EC 1.1.99.1": "ec 1.1.99.1", "TNF-α": "tnf", "nuclear receptor": "nu clear receptor",
    "tnfalpha ifnbeta": "tnf alpha ifnbeta", "p75alphax": "p 75 alpha", "": "", "   ": "", "the": "the",
}


def test_normalize(spark):
    got = values(spark, [(k,) for k in VECTORS] + [(None,)], N.normalize(F.col("a")))
    assert [x for (x,) in got] == [*VECTORS.values(), None]
    (strict,) = values(spark, [("p75alphax tnfalpha ifnbeta",)], N.normalize(F.col("a"), strict=True))
    assert strict == ("p 75 alpha x tnf alpha ifn beta",)


def test_changes_within_tokens_as_a_loop(spark):
    pattern = re.compile("(.*[a-z])([A-Z0-9].*)|(.*[A-Z])([0-9].*)|(.*[0-9])([a-zA-Z].*)|(.*[A-Z][A-Z])([a-z].*)")

    def loop(token):
        parts = [token]
        while True:
            new = []
            for p in parts:
                m = pattern.fullmatch(p)
                new += [x for x in m.groups() if x] if m else [p]
            if new == parts:
                return " ".join(parts)
            parts = new

    rng = random.Random(1)
    names = ["".join(rng.choice("aabcABC012") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    assert [x for (x,) in values(spark, [(n,) for n in names], N.split_changes(F.col("a")))] == [loop(n) for n in names]


def test_variants_and_modifiers(spark):
    assert values(spark, [("IL-2 typeIV TNF alpha",), ("aXXI",), ("XX",), (None,)], N.variants(F.col("a")))[:3] == [
        (["IL-2 typeIV TNF alpha", "IL-2 type IV TNF alpha", "IL-2 typeIV TNF a", "IL-2 typeIV TNFa"],), (["aXXI", "aXX I", "aXXI", "aXXI"],), (["XX"] * 4,)]
    got = values(spark, [("human actin gene",), ("proteins",), ("heat shock protein family",), ("receptor",), ("insulin receptor",), ("x m rna s",), (None,)], N.remove_modifiers(F.col("a")))
    assert [x for (x,) in got] == ["actin", "", "", "", "insulin receptor", "x", None]
    got = values(spark, [("tgf b 1",), ("b",), ("x A e",), ("b-",), ("alpha",)], N.expand_greek(F.col("a")))
    assert [x for (x,) in got] == ["tgf beta 1", "beta", "xi A epsilon", "beta", "alpha"]
    got = values(spark, [("IL2R",), ("fasL receptors",), ("il",)], N.short_forms(F.col("a")))
    assert [x for (x,) in got] == ["IL2 receptor", "fas ligand receptor", "interleukin"]
    assert values(spark, [("EC 1.1.99.1",), ("17q21.3",), ("p53",)], N.is_ec_number(F.col("a")), N.is_locus(F.col("a"))) == [(True, False), (False, True), (False, False)]


def test_rules(spark):
    pairs = [("il 2", "il 3"), ("il 2", "2"), ("il 2", "tnf"), ("tnf alpha", "tnf beta"), ("tnf beta", "tnf"), ("tnf", "tnf beta"), ("il 2", "il"), ("il 1", "il"), ("insulin receptor", "insulin"), ("fos related", "fos like"), ("beta factor", "beta chain"), ("a x", "a y")]
    want = [True, True, True, True, True, False, True, False, True, False, True, True]
    assert [x for (x,) in values(spark, pairs, rules.filter_out(F.col("a"), F.col("b")))] == want
    got = values(spark, [("il 2 2", "2 il 2"), ("il 2", "il 2 2"), ("p alpha x 5", "p x")], rules.number_compatible(F.col("a"), F.col("b")), rules.single_symbols(F.col("a")), rules.content_tokens(F.col("a")), rules.common_tokens(F.col("a"), F.col("b")))
    assert got == [(True, ["2", "2"], ["il"], 3), (False, ["2"], ["il"], 2), (False, ["5", "alpha", "p", "x"], [], 2)]
    got = values(spark, [("a b c", "a b"), ("x 1", "x 2"), ("same", "same")], rules.overlaps(F.col("a"), F.col("b")), rules.overlaps_enough(F.col("a"), F.col("b")), rules.overlaps_with_meaning(F.col("a"), F.col("b")))
    assert got == [(True, True, False), (True, True, False), (False, True, False)]


def test_similarity(spark):
    got = values(spark, [("hemoglobin gamma a chain", "hemoglobin gamma g"), ("a b", " a  b "), ("kitten", "sitting"), (None, "x")], similarity.simple(F.col("a"), F.col("b")), similarity.levenshtein(F.col("a"), F.col("b")))
    assert [round(x, 6) if x is not None else None for x, _ in got] == [0.333333, 9999.0, 0.0, None]
    assert round(got[2][1], 6) == 0.571429 and got[1][1] == 9999.0
    assert similarity.jaro("martha", "marhta") == pytest.approx(17 / 18) and similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.transpositions("a b", "c d") == 0 and similarity.transpositions("il 12 a b", "il receptor 12") == 0
    assert similarity.token_jaro("a b c", "a b c") == 1.0 and similarity.token_jaro("a b", "b a") < 1
    rows = values(spark, [("il 12 a b", "il receptor 12"), ("x", "x"), (None, "y")], similarity.token_jaro_score(F.col("a"), F.col("b")), similarity.jaro_winkler_score(F.col("a"), F.col("b")), similarity.token_transpositions(F.col("a"), F.col("b")))
    assert rows[1] == (9999.0, 1.0, 0) and rows[2][1:] == (None, None) and 0 < rows[0][0] < 1
    with pytest.raises(ValueError):
        similarity.scorer(5)


def test_tokens(spark):
    a, b = F.split("a", " "), F.split("b", " ")
    got = values(spark, [("x y x z", "x x q")], T.common(a, b), T.different(a, b), T.overlap_ratio(a, b), T.ngrams(a, 2, "_"), T.char_ngrams(F.col("b"), 3), T.common_size(a, b), T.window_around(a, F.lit(3), 2), T.counts(a))
    assert got == [(["x"], ["y", "z"], 0.25, ["x_y", "y_x", "x_z"], ["x x", " x ", "x q"], 2, ["y", "x"], {"x": 2, "y": 1, "z": 1})]


def test_automaton_against_a_loop():
    rng = random.Random(2)
    for _ in range(300):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(4)}
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        want = {(i, i + len(w) - 1, w) for w in words for i in range(len(text)) if text.startswith(w, i)}
        a = Automaton(words)
        assert set(a.matches(text)) == want and len(a.matches(text)) == len(want)
        kept = a.longest(text)
        assert all(x[1] < y[0] for x, y in zip(kept, kept[1:]))
        assert a.is_prefix("") and all(a.is_prefix(w[:k]) for w in words for k in range(len(w) + 1)) and not a.is_prefix("zz")
