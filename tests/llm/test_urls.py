import random

import pytest
from onomast.llm import urls

KIND = "page_id bigint, url string"
GOOD = [(i, f"https://www.therwh{x}.example.org/en/{x}") for i, x in enumerate(f"{a}{b}{c}" for a in "abcdefgh" for b in "stuvw" for c in "klmn")]


def decided(spark, rows):
    return {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, KIND), ["page_id"]).collect()}


def test_seeds_of_one_half_are_still_rejected(spark):
    got = decided(spark, GOOD + [(1000 + i, f"https://m.ads-track.example.net/x/{i % 10}") for i in range(50)])
    assert len(got) == len(GOOD) + 50
    assert all(got[1000 + i].seed and not got[1000 + i].kept for i in range(50))
    assert sum(got[i].kept for i, _ in GOOD) >= 0.95 * len(GOOD)


def test_nothing_to_compare(spark):
    assert all(r.kept and r.score is None and not r.seed for r in decided(spark, GOOD[:20]).values())
    assert all(not r.kept and r.score is None and r.seed for r in decided(spark, [(1, "http://casino.example/"), (2, "http://poker.example/")]).values())
    assert decided(spark, GOOD[:0]) == {}


def test_unseen_hosts_are_caught_and_clean_ones_stay(spark):
    """Seeds are caught by models that haven't seen their hosts; accepted hosts hardly ever."""
    rng = random.Random(1)
    bad = [(5000 + i, f"http://{rng.choice(['win', 'best', 'top', 'free'])}-casino{'-' + rng.choice(['poker', 'slots', 'bonus', 'bets']) if i % 2 else ''}{i // 4}.example.net/bonus/{i}") for i in range(200)]
    odd = [(1, None), (2, ""), (3, "http://"), (4, "not a url"), (5, "http://www.therwhaskk.example.org/" + "x" * 100_000)]
    got = decided(spark, [(100 + k, u) for k, (_, u) in enumerate(GOOD)] + bad + odd)
    assert not any(got[5000 + i].kept for i in range(200))
    held_out = [got[5000 + i].score > got[5000 + i].threshold for i in range(200)]
    assert sum(held_out) > 150
    assert sum(got[100 + k].kept for k in range(len(GOOD))) >= 0.98 * len(GOOD)
    assert got[1].kept and got[1].score is None and got[2].kept and got[2].score is None


def test_threshold():
    good, bad = [(b, False, 100) for b in range(10)], [(b, True, 5) for b in range(8, 20)]
    assert urls.best_threshold(good + bad, 0.0) == pytest.approx(0.10)
    assert urls.best_threshold(good, 0.0) == float("inf")
