"""Robust bands of a per-character score, by class and length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of at least this many characters give the spread between documents; shorter ones the spread of their length.
LONG = 256


def calibrate(scored: DataFrame, label: str = "label", score: str = "score", n: str = "n") -> dict[str, tuple[float, float, float]]:
    """(median, deviation between texts, variance of one character) of ``score`` by class, over all rows.

    ``scored`` is read twice, so pass a materialised one.  Quartiles stand for
    the deviation, so that a minority of odd texts doesn't widen the bands.
    """
    use = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull() & (F.col(n) > 0)).select(F.col(label).alias("label"), F.col(score).alias("score"), F.col(n).alias("n"))
    first = use.groupBy("label").agg(
        F.percentile_approx(F.when(F.col("n") >= LONG, F.col("score")), [0.25, 0.5, 0.75], 10_000).alias("long"),
        F.percentile_approx("score", 0.5, 10_000).alias("all"),
    ).collect()
    middle = {r["label"]: (r["long"][1], max(0.01, (r["long"][2] - r["long"][0]) / 1.349)) if r["long"] else (r["all"], 0.1) for r in first}
    if not middle:
        return {}
    center = F.create_map(*[F.lit(x) for name, (m, _) in middle.items() for x in (name, float(m))])
    short = use.where(F.col("n") < LONG).select("label", (F.abs(F.col("score") - center[F.col("label")]) * F.sqrt("n")).alias("x"))
    wide = {r["label"]: r["x"] for r in short.groupBy("label").agg(F.percentile_approx("x", 0.75, 10_000).alias("x")).collect()}
    return {name: (float(m), float(s), max(1.0, float(wide.get(name) or 2.0) / 1.15) ** 2) for name, (m, s) in middle.items()}


def deviations(stats: dict[str, tuple[float, float, float]], label: str = "label", score: str = "score", n: str = "n"):
    """How many deviations a text's score is above its class's median; null where the class is unknown."""
    if not stats:
        return F.lit(None).cast("double")
    part = [F.create_map(*[F.lit(x) for name, v in stats.items() for x in (name, v[i])]) for i in range(3)]
    m, s, v = (p[F.col(label)] for p in part)
    return (F.col(score) - m) / F.sqrt(s * s + v / F.col(n))
