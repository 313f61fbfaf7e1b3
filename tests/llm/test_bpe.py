import random
import tracemalloc

import numpy as np
import pyarrow as pa
import regex
from onomast.llm import bpe
from onomast.llm.vec import raw_bytes, word_hashes
from pyspark.sql import functions as F


def merged(v, piece):
    token = [int(v.of_byte[b]) for b in piece]
    while True:
        ranks = [(v.pairs.get(p), i) for i, p in enumerate(zip(token, token[1:])) if p in v.pairs]
        if not ranks:
            return token
        r, i = min(ranks)
        token[i : i + 2] = [r]


def test_bpe_merges():
    rng = random.Random(1)
    v = bpe.vocabulary(bpe.VOCABULARY)
    texts = ["".join(rng.choice("the andionéß漢&1 \n") for _ in range(n)) for n in (0, 1, 5, 80, 700)] + ["information" * 60, None]
    tokens, n = v.encode(pa.array(texts))
    want = [[t for piece in regex.findall(bpe.PATTERN, x or "") for t in merged(v, piece.encode())] for x in texts]
    assert n.tolist() == [len(x) for x in want]
    assert tokens.tolist() == [t for x in want for t in x]


def test_bpe_pieces_are_the_matches_of_the_pattern():
    rng = random.Random(5)
    some = ["'", "'", "s", "t", "re", "ve", "ll", "l", "d", "m", " ", " ", "  ", "\n", "\t", "\u00a0", "7", "½", "é", "漢", "!", "&", "😀", "\u0301", "\ufeff", "don't", "I'll", "A"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    data, offsets = raw_bytes(pa.array(texts))
    cuts = bpe.piece_starts(data, offsets).tolist() + [len(data)]
    got = [data[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])]
    want = [p for x in texts for p in regex.findall(bpe.PATTERN, x)]
    assert got == want


def test_bpe_round_trip_and_edge_cases(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("ab cé\n漢😀") for _ in range(50_000))
    rows = [(1, "plain text", "x"), (2, None, "x"), (3, "", None), (4, long, "y"), (4, long, "y"), (None, " \n ", "y"), (5, "x" * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    got = bpe.tokenize(df, ["doc_id", "text"]).withColumn("back", bpe.decode(F.col("tokens"))).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(r[:2]) for r in rows)
    for r in got:
        assert r.back == r.text and r.round_trip == (None if r.text is None else True) and r.n_tokens == len(r.tokens or [])
    assert bpe.tokenize(df.limit(0), ["doc_id"]).count() == 0
    odd = spark.createDataFrame([([1, None, 60_000, -4, 2],), (None,), ([],)], "t array<int>").select(bpe.decode(F.col("t")).alias("x")).collect()
    v = bpe.vocabulary(bpe.VOCABULARY)
    assert [r.x for r in odd] == [v.decode_bytes(np.array([1, 2])).tobytes().decode(), None, ""]


def test_classes_are_built_in_little_memory():
    """Every worker of an executor builds them at once; an object for each code point took some 90 MB."""
    tracemalloc.start()
    found = bpe._classes.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    for kind, pattern in ((bpe.LETTER, r"\p{L}"), (bpe.NUMBER, r"\p{N}"), (bpe.SPACE, r"\s")):
        assert all((found[i] == kind) == bool(regex.fullmatch(pattern, chr(i))) for i in range(0, 0x30000) if not 0xD800 <= i < 0xE000)


def test_encoding_takes_little_memory():
    """Two workers of an executor encode at once: positions of every byte and character took some 30 times the text."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts = pa.array([" ".join(rng.choice(words) for _ in range(400)) for _ in range(450)])
    data, offsets = raw_bytes(texts)
    v = bpe.vocabulary(bpe.VOCABULARY)
    v.encode(texts.slice(0, 1))

    def peak(of):
        tracemalloc.start()
        found = of()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, most / len(data)

    tokens = v.encode(texts)[0]
    back, most = peak(lambda: v.decode_bytes(tokens))
    assert np.array_equal(back, data) and most < 12
    cuts, most = peak(lambda: bpe.piece_starts(data, offsets))
    assert len(cuts) and most < 10


def test_word_hashes_leave_nothing_behind():
    """Powers for the largest slice so far stayed in every worker, 34 MB of them."""
    text = pa.array(["some words " * 100_000])
    tracemalloc.start()
    word_hashes(text)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1e6
