from collections import Counter

import numpy as np
from onomast.llm import mixing
from pyspark.sql import functions as F

from tests.oracle import difference


def test_against_sql(spark):
    assert difference(spark, mixing.query, mixing.SQL, "/root/testdata/sf0.001") == ""


def docs(spark):
    rows = [(i, "w " * (i % 37 * 11), f"s{0 if i % 3 == 0 else i % 5}") for i in range(300)] + [(1000, "long " * 5000, "s1"), (None, "a b", None), (None, "a b", None), (7, None, "s2"), (8, "", "s2")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("block", F.lit("clash")).withColumn("n", F.lit(1))


def test_slots_have_equal_tokens_and_shares_hold(spark):
    d = docs(spark)
    rows = mixing.mix(d, block_tokens=100).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.source, r.epoch, r.block] += r.n_tokens
    of = {r.s: r.n for r in d.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    for (source, _, block), n in tokens.items():
        assert n == min(100, of[source] - 100 * block)
    slots = {r.slot: r.source for r in rows}
    assert sorted(slots) == list(range(len(slots)))
    share = {s: n**0.5 for s, n in of.items()}
    total = sum(share.values())
    for upto in (40, 100, len(slots)):
        for s in share:
            assert abs(sum(slots[t] == s for t in range(upto)) - upto * share[s] / total) < 4
    one = [r for r in rows if r.doc_id == 1000]
    assert sorted(r.first for r in one if r.epoch == 0)[:1] and all(r.n_tokens <= 100 for r in one)


def test_stage_keeps_whole_documents_in_order(spark):
    d = docs(spark)
    out = mixing.stage(spark, d, "")
    assert out.columns == d.columns
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    placed, slots, _ = mixing._placed(d, mixing.BLOCK_TOKENS, mixing.SEED, None, mixing.POWER)
    times = Counter((r.source, r.block) for r in slots.collect())
    want = Counter()
    texts = {(r.doc_id, r.h): r.text for r in d.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()}
    for r in placed.collect():
        n = times[r.source, min(r.place // mixing.BLOCK_TOKENS, r.last)]
        if n:
            want[r.doc_id, texts[r.doc_id, r.digest], r.source or None] += n
    assert got == want


def test_edges(spark):
    none = docs(spark).limit(0)
    assert mixing.mix(none).count() == 0 and mixing.stage(spark, none, "").count() == 0
    assert {r.source for r in mixing.mix(docs(spark), {"s1": 1.0, "s2": 0.0}).collect()} == {"s1"}
    # far slots: exact with integers of any size
    far = np.array([0, 1, 3_480_000_000, 2**40 + 12345])
    assert mixing.points(far).tolist() == [t * mixing.GOLDEN % 2**32 for t in far.tolist()]


def test_a_task_has_one_python_worker(spark):
    """Workers live on after the stage; a second one in every task, and those of another kind that read rows of Python, took some 250 MB of an executor."""

    def most(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return most(node.initialPlan())
        parts = [most(node.children().apply(i)) for i in range(node.children().size())]
        here = max((n for n, _ in parts), default=0) + ("Python" in name or "InArrow" in name)
        return (0 if "Exchange" in name else here), max([here, *(n for _, n in parts)])

    out = mixing.stage(spark, docs(spark).select("doc_id", "text", "source").where("doc_id < 100"), "")
    assert most(out._jdf.queryExecution().executedPlan())[1] == 1
    placed, slots, _ = mixing._placed(docs(spark), mixing.BLOCK_TOKENS, mixing.SEED, None, mixing.POWER)
    for df in (placed, slots):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
