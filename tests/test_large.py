"""Operators whose memory or time must not grow with the longest group, or faster than the input."""

import random
import re
import time
import tracemalloc

import pyarrow as pa
from onomast.functions import rules, stem
from onomast.operators import index, retrieval, spans
from pyspark.sql import functions as F

ENTRIES = "synonym string, id bigint, priority int, tax string"


def test_ambiguity_is_that_of_the_rules(spark):
    rows = [("a", 1, 0, "t"), ("a", 1, 1, "t"), ("a", 1, 1, "u"), ("b", 1, 0, "t"), ("b", 10, 0, "t"), ("b", 9, 2, "u"), ("b", 10, 3, "u"), ("c", 3, 0, "u"), ("d", None, 0, "t"), ("d", 4, 0, "t"), ("e", 5, 0, None), ("e", 6, 0, None), ("f", None, 0, "t")]
    table = spark.createDataFrame(rows, ENTRIES)
    e, tax = F.col("entries"), F.lit("t")
    want = index.synonyms(table.withColumnRenamed("synonym", "name")).select(
        "synonym", rules.is_ambiguous(e), rules.is_ambiguous_within(e), rules.is_ambiguous_between(e), F.coalesce(rules.has_tax(e, tax), F.lit(False)), F.array_compact(F.sort_array(rules.ids_of(e, tax))), rules.restrict_to_tax(e, tax), rules.id_in_tax(e, tax),
        F.size(rules.priorities_of(e, rules.ids_of(e, tax))),
    )
    got = retrieval.ambiguity(table, "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ambiguity_of_a_name_with_very_many_ids(spark):
    many = spark.range(300_000).select(F.lit("x").alias("synonym"), "id", F.lit(0).alias("priority"), F.when(F.col("id") % 2 == 0, "t").otherwise("u").alias("tax"))
    began = time.time()
    (row,) = retrieval.ambiguity(many, "t").select(F.size("ids").alias("n"), "within", "n_priorities", "last_id").collect()
    assert tuple(row) == (150_000, True, 150_000, 299_998) and time.time() - began < 30


def test_entries_are_made_different_once_and_only_after_the_shuffle(spark):
    from onomast.plans import catalog

    plan = catalog.QUERIES["lk_index_entries"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before = [line for line in plan.splitlines() if "HashAggregate" in line and "synonym" in line]
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "synonym" in line]
    assert before and not shuffles, plan


def test_headings_make_no_rows_that_are_dropped_again(spark):
    headings = spark.createDataFrame([(1, "a, b"), (1, "b, a, a"), (2, "b"), (2, None), (None, "a")], "doc_id bigint, heading string")
    descriptors = spark.createDataFrame([("a", "t"), ("a", "u"), ("a", "u"), ("b", None), (None, "t")], "descriptor string, tax string")
    found = spans.heading_taxa(headings, descriptors)
    rows = lambda *r: sorted(r, key=str)
    assert rows(*map(tuple, found.collect())) == rows((1, "a", "t"), (1, "a", "u"), (1, "b", None), (2, "b", None), (None, "a", "t"), (None, "a", "u"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]


def test_without_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    spot = lambda: None if rng.random() < 0.05 else rng.randint(0, 80)
    rows = [(rng.choice(["d", "e", None]), b := spot(), None if b is None or rng.random() < 0.05 else b + rng.randint(-2, 9), rng.choice(["x", "y", "z", None]), i) for i in range(200)]
    meet = lambda a, m: None not in (a[0], m[0], *a[1:3], *m[1:3]) and a[0] == m[0] and a[1] <= m[2] and m[1] <= a[2]
    want = [r[4] for r in rows if r[3] == "x" or not any(m[3] == "x" and meet(r, m) for m in rows)]
    table = spark.createDataFrame(rows, "doc_id string, begin int, end int, tagger string, i int")
    assert sorted(r.i for r in spans.without_tagger_overlaps(table, "x").collect()) == want
    # one row for each span, not for each stretch of positions that it covers
    wide = spark.createDataFrame([("d", 0, 2_000_000_000, "x"), ("d", 5, 1_900_000_000, "y"), ("e", 5, 1_900_000_000, "y")], "doc_id string, begin int, end int, tagger string")
    assert [tuple(r)[0::3] for r in spans.without_tagger_overlaps(wide, "x").orderBy("doc_id").collect()] == [("d", "x"), ("e", "y")]
    assert "Generate" not in spans.without_tagger_overlaps(wide, "x")._jdf.queryExecution().optimizedPlan().toString()


def test_components_never_broadcast_labels(spark, monkeypatch):
    plans, real = [], spans.cut
    monkeypatch.setattr(spans, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    edges = spark.range(64).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 16 < 14, 2).otherwise(0)).alias("b"))
    found = spans.components(edges)
    assert found.count() == 64 and found.where("component <> node - node % 16 + node % 2").isEmpty()
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_stemming_holds_each_different_word_once():
    """A batch of long texts: Python's memory is that of different words, not of all."""
    lists = pa.array([["running", None, "cats"], None, [], ["cats"] * 3], pa.list_(pa.string()))
    assert stem.stemmed_lists(lists).to_pylist() == [["run", None, "cat"], None, [], ["cat"] * 3]
    assert stem.stemmed_lists(lists[1:]).to_pylist() == [None, [], ["cat"] * 3]
    assert stem.stemmed_lists(lists[:0]).to_pylist() == []
    long = pa.array([[f"word{i % 1000}ing" for i in range(1000)]], pa.list_(pa.string())).take(pa.array([0] * 1000))
    tracemalloc.start()
    stem.stemmed_lists(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000


def test_contexts_shuffle_documents_not_their_matches(spark):
    words = "a b c d e f".split()
    rng = random.Random(5)
    docs = spark.createDataFrame([(i % 25, [rng.choice(words) for _ in range(rng.randint(1, 9))]) for i in range(30)], "id bigint, tokens array<string>")
    queries = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c", "x"])], "query_id bigint, tokens array<string>")
    allowed = spark.createDataFrame([(1, 3), (1, 4), (2, 4)], "query_id bigint, id bigint")
    everything = {(r.query_id, r.id): r.score for r in retrieval.context_or(queries, docs, top=None).collect()}
    best = {r.query_id: (-r.score, r.id) for r in retrieval.context_or(queries, docs).collect()}
    assert best == {q: min((-s, i) for (k, i), s in everything.items() if k == q) for q in (1, 2)}
    some = {(r.query_id, r.id): r.score for r in retrieval.context_or(queries, docs, 0.0, allowed, None).collect()}
    assert some == {k: v for k, v in everything.items() if k in {(1, 3), (1, 4), (2, 4)}}
    plan = retrieval.context_or(queries, docs, top=None)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((.*?)#\d+L?, \d+\)", plan)) == {"id", "token"}
