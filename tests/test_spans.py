import random

from onomast.operators import spans
from pyspark.sql import functions as F


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id string, begin int, end int" + (", " + extra if extra else ""))


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n: [(f"d{rng.randint(0, 2)}", a := rng.randint(0, 60), a + rng.randint(0, 25), i) for i in range(n)]
    left, right = make(60), make(60)
    a, b = frame(spark, left, "i int"), frame(spark, right, "i int")
    want = {(x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]}
    for width in (3, 16, 256):
        got = [(r.i, r.r_i) for r in spans.overlapping(a, b, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    inside = {(x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] >= y[1] and x[2] <= y[2]}
    assert {(r.i, r.r_i) for r in spans.containing(a, b, 16).collect()} == inside


def test_longest_first(spark):
    rows = [("d", 0, 3, 1), ("d", 2, 9, 2), ("d", 2, 9, 3), ("d", 20, 22, 4), ("d", 10, 21, 5), ("e", 0, 1, 6)]
    got = [r.i for r in spans.longest_first(frame(spark, rows, "i int"), "i").orderBy("i").collect()]
    # 5 doesn't overlap the kept span before it, so it is added although it overlaps 4
    assert got == [2, 4, 5, 6]


def test_evidence(spark):
    m = frame(spark, [("d", 30, 34, "FGF"), ("d", 60, 63, "hTNF"), ("e", 0, 3, "abc")], "text string")
    species = frame(spark, [("d", 2, 6, "t"), ("d", 22, 28, "a"), ("d", 12, 14, "s"), ("d", 36, 40, "b"), ("d", 70, 74, "c")], "tax string")
    sentences = frame(spark, [("d", 0, 8), ("d", 10, 50), ("d", 52, 80), ("e", 0, 9)])
    chunks = frame(spark, [("d", 10, 18), ("d", 21, 41), ("d", 58, 65)])
    titles = spark.createDataFrame([("d", 0, 8)], "doc_id string, title_begin int, title_end int")
    headings = spark.createDataFrame([("d", "m")], "doc_id string, tax string")
    got = {(r.doc_id, r.begin, r.tax): r.evidence for r in spans.evidence(m, species, sentences, chunks, titles, headings, {"h": "9606"}, "def").collect()}
    assert got["d", 30, "a"] == "ANYWHERE COMPOUND_PRECEED FIRST" and got["d", 30, "b"] == "ANYWHERE COMPOUND_SUCCEED FIRST"
    assert got["d", 30, "s"] == "ANYWHERE FIRST SENTENCE" and got["d", 30, "t"] == "ANYWHERE TITLE" and got["d", 30, "m"] == "MESH"
    assert got["d", 60, "c"] == "ANYWHERE SENTENCE" and got["d", 60, "9606"] == "SPECIES_PREFIX" and got["e", 0, "def"] == "DEFAULT"
    assert len([k for k in got if k[0] == "e"]) == 1


def test_selection_and_coreference(spark):
    m = frame(spark, [("d", 0, 3, "TNF", False, "A"), ("d", 10, 32, "tumor necrosis factor", False, "B"), ("d", 40, 43, "TNF", False, "B"), ("d", 50, 54, "TNFs", True, "A"), ("d", 60, 66, "HLH462", False, "A"), ("d", 0, 3, "TNF", False, "B")], "text string, plural boolean, tagger string")
    acronyms = frame(spark, [("d", 0, 3, "TNF", 10, 32), ("d", 60, 63, "HLH", 10, 32)], "text string, long_begin int, long_end int")
    got = {r.begin: r.set_id for r in spans.coreferent(m, acronyms).collect()}
    assert got[0] == got[10] == got[40] == 0 and got[50] == 50 and got[60] == 60
    one = spans.one_per_place(m, ["B", "A"]).where("begin = 0").collect()
    assert [r.tagger for r in one] == ["B"]
    left = spans.without_tagger_overlaps(m, "B").orderBy("begin").collect()
    assert [(r.begin, r.tagger) for r in left] == [(0, "B"), (10, "B"), (40, "B"), (50, "A"), (60, "A")]
    cut = spans.without_species_prefix(frame(spark, [("d", 5, 17, "human FGF-22"), ("d", 5, 9, "human")], "text string"), "human|mouse").collect()
    assert [(r.begin, r.text) for r in cut] == [(11, "FGF-22"), (5, "human")]
    kept = spans.with_candidates(spark.createDataFrame([("a",), ("b",)], "mention string"), spark.createDataFrame([("a",)], "mention string")).collect()
    assert [r.mention for r in kept] == ["a"]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([("d", i, i + 1) for i in range(40)] + [("e", 3, 9), ("e", 5, 5)], "doc_id string, a int, b int")
    got = {(r.doc_id, r.node): r.component for r in spans.components(edges).collect()}
    assert all(got["d", i] == 0 for i in range(41)) and got["e", 9] == 3 and got["e", 5] == 5


def test_enclosing_and_nearest(spark):
    s = frame(spark, [("d", 5, 7), ("d", 100, 101), (None, 1, 2)])
    got = {(r.doc_id, r.begin): (r.sentence_begin, r.sentence_end) for r in spans.enclosing(s, frame(spark, [("d", 0, 6), ("d", 7, 9)])).collect()}
    assert got == {("d", 5): (0, 6), ("d", 100): (None, None), (None, 1): (None, None)}
    near = spans.nearest(s.where("doc_id = 'd'").withColumn("tax", F.lit("x")), frame(spark, [("d", 2, 3, "x"), ("d", 5, 6, "x"), ("d", 50, 51, "x"), ("d", 6, 6, "y")], "tax string"))
    assert sorted((r.begin, r.previous, r.next) for r in near.collect()) == [(5, 2, 50), (100, 50, None)]
