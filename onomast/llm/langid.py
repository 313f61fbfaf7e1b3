"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import bands, kneser_ney
from onomast.llm.shared import cut
from onomast.llm.vec import trimmed

ORDER = 4
#: Characters whose joint probability a minority of texts with a wrong label hardly moves.
LOW = 2
#: A text whose cross-entropy is this many deviations from what its language's texts have is in none of them.
MAX_DEVIATIONS = 6.0


def score_languages(docs: DataFrame, models: dict[str, kneser_ney.NgramModel], text: str = "text", half: str = "half", prefix: str = "") -> tuple[DataFrame, Broadcast]:
    """``docs`` with label (of the lowest length-normalised cross-entropy), score (nats a character), runner (the second's score), low (nats of LOW characters together, by the label's model), n (characters).

    ``models`` are named half + language; a text is scored by those that
    haven't seen its ``half`` (0 or 1).  A language that has a model of one
    half only can't be chosen by texts of that half.  Of two languages with
    the same score the alphabetically first is taken.  Null and empty texts,
    and texts that no model may score, have null label and score.  Columns are named ``prefix`` + name.
    With it the models as sent to the tasks, to be destroyed when it has been worked out.
    """
    names = [sorted(k[1:] for k in models if k[0] == str(1 - i)) for i in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast([[models[f"{1 - i}{k}"] for k in names[i]] for i in (0, 1)])
    kind = "struct<label:string,score:double,runner:double,low:double,n:bigint>"

    @F.arrow_udf(kind)
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, halves in trimmed(batches):
            side = halves.to_numpy(zero_copy_only=False)
            label = np.full(len(texts), None, object)
            values, n = np.zeros((3, len(texts))), np.zeros(len(texts), np.int64)
            for i in (0, 1):
                at = np.flatnonzero(side == i)
                if not len(at) or not names[i]:
                    continue
                sums, n[at] = kneser_ney.text_scores(texts.take(pa.array(at)), sent.value[i], low=LOW)
                scores = -sums / np.maximum(n[at], 1)[:, None]
                width, rows = len(names[i]), np.arange(len(at))
                rank = np.argsort(scores[:, :width], axis=1, kind="stable")
                label[at] = np.asarray(names[i], dtype=object)[rank[:, 0]]
                values[:, at] = scores[rows, rank[:, 0]], scores[rows, rank[:, min(1, width - 1)]], scores[rows, width + rank[:, 0]]
            empty = n == 0
            yield pa.StructArray.from_arrays([pa.array(label, pa.string(), mask=empty), *[pa.array(x, mask=empty) for x in values], pa.array(n)], names=["label", "score", "runner", "low", "n"])

    found = prefix + "found"
    out = docs.withColumn(found, best(F.lower(F.col(text)), F.col(half)))
    return out.select(*docs.columns, *[F.col(f"{found}.{k}").alias(prefix + k) for k in ("label", "score", "runner", "low", "n")]), sent


def identify(docs: DataFrame, keep: list[str], order: int = ORDER, max_deviations: float = MAX_DEVIATIONS, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id, text, lang, ...) with the language found.

    Training: two models per value of ``lang``, one for each half of the texts
    by their hash, from the character n-grams of all rows that have one; a
    text is scored by the models of the other half, which have seen neither it
    nor a copy.  Decision: lowest cross-entropy per character.
    Rejection, calibrated on all texts of a language and half, each counted once: a text is accepted
    unless its cross-entropy is more than ``max_deviations`` above its
    language's median, or below it, as that of a foreign text whose few words
    are known from others with a wrong label.  Since such a text may fall
    between, the improbability of its LOW characters together mustn't be that
    far above either: a minority can't make those likely, and the models count
    in how many contexts they occur, not how often.  The deviation grows as the text gets shorter.

    Added: pred_lang, cross_entropy, margin (to the second language),
    accepted.  Null, empty and blank texts, and texts without any letter: pred_lang null,
    accepted false.  No labelled rows at all: every row so, and texts of one
    half where only that half has labelled rows.  Repeated rows are
    decided alike, one by one.  Columns of the same name in ``docs`` must be
    left out of ``keep`` or a ``prefix`` given for the added ones.
    """
    inner = "_onomast_"
    text = F.lower("text")
    half = F.pmod(F.xxhash64(text), F.lit(2)).cast("int")
    models = kneser_ney.fit(docs, text, F.concat(half.cast("string"), F.col("lang").cast("string")), order, "kn")
    names = ["pred_lang", "cross_entropy", "margin", "accepted"]
    if not models:
        none = [F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False)]
        return docs.select(*keep, *[c.alias(prefix + k) for c, k in zip(none, names)])
    has = docs.select(*keep, F.col("text").alias(inner + "text"), half.alias(inner + "half"), F.xxhash64(text).alias(inner + "hash"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(inner + "letters"))
    each, sent = score_languages(has, models, inner + "text", inner + "half", inner)
    scored = cut(each.withColumn(inner + "group", F.concat(F.col(inner + "half").cast("string"), F.col(inner + "label"))).drop(inner + "text", inner + "half"))
    sent.destroy()
    once = cut(scored.where(inner + "letters").select(*[inner + k for k in ("group", "score", "low", "n", "hash")]).dropDuplicates([inner + "hash"]))
    z, z_low = (bands.deviations(bands.calibrate(once, inner + "group", inner + k, inner + "n"), inner + "group", inner + k, inner + "n") for k in ("score", "low"))
    good = F.col(inner + "letters")
    inside = (F.abs(z) <= max_deviations) & (z_low <= max_deviations)
    added = [F.when(good, F.col(inner + "label")), F.col(inner + "score"), F.col(inner + "runner") - F.col(inner + "score"), F.coalesce(good & inside, F.lit(False))]
    return scored.select(*keep, *[c.alias(prefix + k) for k, c in zip(names, added)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, lang, pred_lang, cross_entropy, margin, accepted."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), ["doc_id", "lang"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are in none of the languages go; ``lang`` becomes the language found."""
    found = identify(docs, docs.columns, prefix="_lid_")
    return found.where("_lid_accepted").select(*[F.col("_lid_pred_lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])
