import random

import numpy as np
import pyarrow as pa
from onomast.llm import simhash
from pyspark.sql import functions as F


def groups(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def near(rng, base, k):
    return base ^ sum(1 << b for b in rng.sample(range(256), k))


def as_rows(values):
    return np.array([[x >> 64 * w & (1 << 64) - 1 for w in range(simhash.WORDS)] for x in values], np.uint64)


def test_groups_are_those_of_all_pairs(spark):
    """Whatever is connected by pairs up to the guaranteed distance is found connected, and nothing beyond the greatest distance."""
    rng = random.Random(2)
    values = []
    for _ in range(40):
        base = rng.getrandbits(256)
        values += [base] + [near(rng, base, k) for k in (1, 6, 11, 23)]
    hot = rng.getrandbits(256)
    values += [near(rng, hot, k % 20) for k in range(300)]
    values = list(dict.fromkeys(values))
    rng.shuffle(values)
    sig = as_rows(values)
    df = spark.createDataFrame([(bytes(x),) for x in simhash.as_binary(sig).to_pylist()], "sig binary")
    index = {x: i for i, x in enumerate(simhash.as_binary(sig).to_pylist())}
    edges = [(index[bytes(r.a)], index[bytes(r.b)]) for r in simhash.links(df).collect()]
    pairs = {(i, j): (values[i] ^ values[j]).bit_count() for i in range(len(values)) for j in range(i + 1, len(values))}
    found = groups(len(values), edges)
    sure = groups(len(values), [p for p, d in pairs.items() if d <= 23])
    most = groups(len(values), [p for p, d in pairs.items() if d <= simhash.MAX_DISTANCE])
    assert all(found[a] == found[b] for a, b in enumerate(sure))
    assert all(most[a] == most[b] for a, b in enumerate(found))
    roots = {bytes(r.node): bytes(r.root) for r in simhash.connected(simhash.links(df)).collect()}
    assert groups(len(values), [(index[a], index[b]) for a, b in roots.items()]) == found


def test_recall_by_distance():
    rng = random.Random(3)
    for distance, least in ((23, 1.0), (28, 0.97), (32, 0.94), (36, 0.9)):
        hit = 0
        for _ in range(300):
            a = rng.getrandbits(256)
            sig = as_rows([a, near(rng, a, distance)])
            way = simhash.routes(sig)
            hit += any(len(simhash.local_links(w, sig, 36)[0]) for w in way if w[0] == w[1])
        assert hit >= least * 300


def test_signatures_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    texts = pa.array([text, None, "", "a b", text[:3000]])
    whole = simhash.signatures(texts)
    monkeypatch.setattr(simhash, "SLICE", 1000)
    pieces = simhash.signatures(texts)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    words = {w for w in text.split()}
    assert whole[1].tolist()[:4] == [len(words), 0, 0, 2]


def test_group_copies_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, long, "x"), (2, long + " more", "x"), (2, long + " more", "x"), (None, long, None), (3, None, None), (4, "", "a"), (5, "...", "a"), (3, None, None), (7, "one other text", "a"), (None, "null id", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sig string").withColumn("row", F.lit(0))
    got = sorted(map(str, (tuple(r) for r in simhash.group_copies(df).collect())))
    assert got == sorted(map(str, [(1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False), (3, 3, 1, True), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 1, True), (7, 7, 1, True), (None, None, 1, True)]))
    left = [r.doc_id for r in simhash.stage(spark, df, "").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [1, 3, 3, 4, 5, 7, None]))
    assert simhash.stage(spark, df, "").columns == df.columns
    assert simhash.group_copies(df.limit(0)).count() == 0


def test_every_pair_up_to_the_limit_is_found():
    """Also where the bits that differ are spread evenly, two or three to a segment."""
    rng = random.Random(5)
    first = [64 * w + at for w, at, _ in simhash.SEGMENTS]
    for distance in (24, 30, 36):
        for _ in range(50):
            a = rng.getrandbits(256)
            even = sum(1 << at + i for k, (at, (_, _, n)) in enumerate(zip(first, simhash.SEGMENTS)) for i in rng.sample(range(n), distance // 12 + (k < distance % 12)))
            for b in (a ^ even, near(rng, a, distance)):
                sig = as_rows([a, b])
                assert any(len(simhash.local_links(w, sig, 36)[0]) for w in simhash.routes(sig) if w[0] == w[1])


def test_large_groups_are_those_of_all_pairs(monkeypatch):
    """Values looked up, pivots and nodes of several members: components as by brute force, with pairs on both sides of the limit."""
    rng = random.Random(6)
    values = []
    for _ in range(25):
        base = rng.getrandbits(256)
        values += [near(rng, base, rng.randint(5, 30)) for _ in range(40)] + [near(rng, base, 3) for _ in range(20)]
        values += [near(rng, values[-1], k) for k in (34, 35, 36, 37, 38)]
    sig = as_rows(list(dict.fromkeys(values)))
    far = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2)
    for short, pairs in ((3, 1 << 18), (64, 16)):
        monkeypatch.setattr(simhash, "SHORT_RUN", short)
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        links = [simhash.local_links(w, sig, 36) for w in simhash.routes(sig)]
        found = simhash.components(len(sig), *(np.concatenate(x) for x in zip(*links)))
        assert (found == simhash.components(len(sig), *np.nonzero(far <= 36))).all()
