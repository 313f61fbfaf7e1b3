import random

import numpy as np
import pyarrow as pa
import pytest
from onomast.llm import bpe, token_files, training_order
from onomast.llm.files import sizes
from pyspark.sql import functions as F

ROWS = [(1, "one text of some words", "x"), (2, None, "y"), (3, "", "z"), (None, "no id", None), (5, "long " * 9000, "x"), (1, "one text of some words", "x"), (7, "ü" * 400, "w")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, file string").withColumn("ordinal", F.lit("clash")).repartition(3)


def encoded(text):
    tokens, _ = bpe.vocabulary(bpe.VOCABULARY).encode(pa.array([text], pa.string()))
    return tokens.tolist()


def test_counts_of_written_documents(spark, docs, tmp_path):
    uri = f"file://{tmp_path}/t"
    rows = token_files.write_tokens(docs, uri).join(token_files.count_documents(spark, uri, block_bytes=64), ["file", "ordinal"]).collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in rows))) == sorted(map(str, ((i, len(encoded(x))) for i, x, _ in ROWS)))
    assert all(r.ended for r in rows)


def test_scan_against_a_loop(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for k in range(6):
        ids = [rng.choice([7, 9, token_files.END]) if rng.random() < 0.3 else 5 for _ in range(rng.randint(0, 400))] if k else []
        if k == 2:
            ids = [5] * 300
        if k == 3:
            ids = [token_files.END] * 50
        np.array(ids, "<u2").tofile(tmp_path / f"part-{k}.tokens")
        first, number = 0, 0
        for i, x in enumerate(ids):
            if x == token_files.END:
                want.append((f"part-{k}.tokens", number, first, i - first, True))
                first, number = i + 1, number + 1
        if first < len(ids):
            want.append((f"part-{k}.tokens", number, first, len(ids) - first, False))
    for block in (2, 14, 4096):
        got = [tuple(r) for r in token_files.count_documents(spark, f"file://{tmp_path}", block_bytes=block).collect()]
        assert sorted(got) == sorted(want)
    (tmp_path / "odd.tokens").write_bytes(b"abc")
    with pytest.raises(ValueError):
        token_files.count_documents(spark, f"file://{tmp_path}")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    p = training_order.Permutation(n, 5)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (p.number(slots) == np.arange(n)).all()
    if n > 100:
        assert (slots != training_order.Permutation(n, 6).slot(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.15


def test_training_order(spark, docs, tmp_path):
    uri = f"file://{tmp_path}/order"
    rows = sorted(training_order.materialise(docs, uri, length=16, per_shard=100).collect())
    assert [r.slot for r in rows] == list(range(len(rows)))
    read = list(training_order.read(uri, length=16, per_shard=100))
    assert [s for s, _ in read] == [r.slot for r in rows]
    assert [s for s, _ in training_order.read(uri, 137, length=16, per_shard=100)] == [r.slot for r in rows][137:]
    assert all(r.shard == r.slot // 100 and r.offset == r.slot % 100 * 32 for r in rows)
    # in the order of their numbers the sequences are each partition's documents, end to end
    order = training_order.Permutation(len(rows)).slot(np.arange(len(rows)))
    texts = docs.select("doc_id", "text", F.spark_partition_id().alias("p")).collect()
    flat, ids = [], []
    for p in sorted({r.p for r in texts}):
        own = [(r.doc_id, t) for r in texts if r.p == p for t in [*encoded(r.text), token_files.END]]
        fill = -len(own) % 16
        flat += [t for _, t in own] + [token_files.END] * fill
        ids += [i for i, _ in own] + [...] * fill
    assert [t for s in order for t in read[s][1].tolist()] == flat
    for k, s in enumerate(order):
        own = ids[16 * k : 16 * k + 16]
        assert rows[s].n_tokens == sum(x is not ... for x in own)
        assert set(rows[s].doc_ids) == {x for x in own if x is not ...}
    before = {p: __import__("os").stat(p[7:]).st_mtime_ns for p, _ in sizes(uri, (".tokens",))}
    again = sorted(training_order.materialise(docs, uri, length=16, per_shard=100).collect())
    assert again == rows and before == {p: __import__("os").stat(p[7:]).st_mtime_ns for p, _ in sizes(uri, (".tokens",))}


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    assert training_order.materialise(none, f"file://{tmp_path}/a").count() == 0
    uri = f"file://{tmp_path}/b"
    assert token_files.write_tokens(none, uri).count() == 0
    assert token_files.count_documents(spark, uri).count() == 0
