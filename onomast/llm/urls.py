"""URL filter: the ratio of two character language models.

One smoothed variable-order Markov model is trained on the URLs of rejected
seeds, one on all others; both predict a character from the longest context
seen, weighed with the shorter ones.  A URL's score is the difference of its
log likelihoods for each character.  Hosts are in one of two halves, and a URL
is scored by models of the other half, which have seen neither it nor its host.
A URL is rejected if it is more like the rejected ones, by a threshold that
rejects at most MAX_REJECTED of the others; known seeds are rejected whatever
their score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import kneser_ney
from onomast.llm.shared import cut
from onomast.llm.vec import trimmed

ORDER = 6
#: Of the URLs that aren't seeds, the share that the threshold may reject.
MAX_REJECTED = 0.02
#: What the query takes as rejected seeds, as the tables have no such labels: hosts that name their trade.
SEEDS = r"(casino|poker|pills|pharma|viagra|porn|xxx|spam|malware|phish|ads-|adserver|click-?bait|track)"
#: Scores are calibrated to this many nats a character.
STEP = 0.01


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; "" where there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def plain(url: Column) -> Column:
    """What the models read: lower case, without scheme, digits as one symbol."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://", ""), "[0-9]", "0")


def best_threshold(histogram: list[tuple[int, bool, int]], most: float = MAX_REJECTED) -> float:
    """0, above which a URL is more like the rejected ones, or if more than ``most`` of the accepted are there the least score above which they aren't; of a stretch without any URL the middle.

    ``histogram`` has (score / STEP rounded down, seed, URLs); infinite where
    no score has so few above it but the greatest.
    """
    steps = sorted({b for b, _, _ in histogram})
    good = np.array([sum(n for b, s, n in histogram if b == x and not s) for x in steps], float)
    bad = np.array([sum(n for b, s, n in histogram if b == x and s) for x in steps], float)
    above = np.concatenate([good[::-1].cumsum()[::-1][1:], [0.0]])
    at = int(np.flatnonzero(above <= most * good.sum())[0])
    if not bad[at + 1 :].sum():
        return float("inf")  # no seed would be caught: the models say nothing
    return max(0.0, STEP * (steps[at] + 1 + steps[at + 1]) / 2)


def filter_urls(pages: DataFrame, keep: list[str], url: str = "url", rejected: Column | None = None, order: int = ORDER, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``pages`` with seed, score (nats a character; above the threshold is rejected), threshold and kept.

    ``rejected``: which rows are rejected seeds; hosts with one of SEEDS where
    none is given.  Null and blank URLs have a null score and are kept.  If
    all rows or none are seeds there is nothing to compare: scores and the
    threshold are null, and just the seeds are rejected.  If all rows of a
    kind are in one half, both halves are scored by the one model of that
    kind.  Where the models tell seeds from others no better than by chance
    the threshold is infinite.  Repeated rows are judged alike, as a host is in
    one half.  A very long URL is scored whole; scores equal to the threshold
    are accepted.  An empty table gives an empty result.  Added columns are
    named ``prefix`` + name.
    """
    t = "_url_"
    text = plain(F.col(url).cast("string"))
    seed = F.coalesce(F.regexp_like(host(F.col(url).cast("string")), F.lit(SEEDS)) if rejected is None else rejected, F.lit(False))
    half = F.pmod(F.xxhash64(host(F.col(url).cast("string"))), F.lit(2)).cast("int")
    rows = pages.select(*keep, F.when(text != "", text).alias(t + "text"), seed.alias(t + "seed"), half.alias(t + "half"))
    names = ["seed", "score", "threshold", "kept"]
    label = F.concat(F.when(F.col(t + "seed"), "r").otherwise("a"), F.col(t + "half").cast("string"))
    models = kneser_ney.fit(rows, F.col(t + "text"), label, order, "wb")
    if not all(any(k[0] == kind for k in models) for kind in "ar"):
        return rows.select(*keep, F.col(t + "seed").alias(prefix + names[0]), F.lit(None).cast("double").alias(prefix + names[1]), F.lit(None).cast("double").alias(prefix + names[2]), (~F.col(t + "seed")).alias(prefix + names[3]))
    sent = pages.sparkSession.sparkContext.broadcast([[models.get(f"{kind}{1 - i}") or models[f"{kind}{i}"] for kind in "ar"] for i in (0, 1)])

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, halves in trimmed(batches):
            which = halves.to_numpy(zero_copy_only=False)
            out, length = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i in (0, 1):
                at = np.flatnonzero(which == i)
                if len(at):
                    sums, length[at] = kneser_ney.text_scores(texts.take(pa.array(at)), sent.value[i])
                    out[at] = (sums[:, 1] - sums[:, 0]) / np.maximum(length[at], 1)
            yield pa.array(out, mask=length == 0)

    scored = cut(rows.withColumn(t + "score", score(F.col(t + "text"), F.coalesce(t + "half", F.lit(0)))).drop(t + "text", t + "half"))
    sent.destroy()
    known = scored.where(F.col(t + "score").isNotNull())
    histogram = [tuple(r) for r in known.groupBy(F.floor(F.col(t + "score") / STEP), t + "seed").count().collect()]
    limit = best_threshold(histogram)
    added = [F.col(t + "seed"), F.col(t + "score"), F.lit(limit), ~F.col(t + "seed") & F.coalesce(F.col(t + "score") <= limit, F.lit(True))]
    return scored.select(*keep, *[c.alias(prefix + k) for c, k in zip(added, names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on the URL of every page: page_id, url, seed, score, threshold, kept."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), ["page_id", "url"])
