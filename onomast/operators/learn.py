"""Learning whether two names mean the same: pairs, features, a maximum-entropy model and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions import rules, similarity, words
from onomast.functions import tokens as T
from onomast.functions.normalize import let, tokens

PERFECT = 9999.0
CLASSES = {"NUM": "[0-9]+", "GREEK": words.GREEK_REGEX, "ALPHA": "[a-z]+", "MODIFIER": words.MODIFIER_REGEX}


# Pairs


def _by_token(names: DataFrame) -> DataFrame:
    return names.select("name", "id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("token"))


def positive_pairs(dictionary: DataFrame) -> DataFrame:
    """(term1, term2, label): different names of one id that share enough, each pair once."""
    names = dictionary.select("name", "id").distinct()
    a, b = names.select("id", F.col("name").alias("term1")), names.select("id", F.col("name").alias("term2"))
    return a.join(b, "id").where("term1 < term2").where(rules.overlaps(F.col("term1"), F.col("term2"))).select("term1", "term2", F.lit("TRUE").alias("label")).distinct()


def negative_pairs(dictionary: DataFrame, each: int = 10, ratio: float = 0.5, longest: int = 5) -> DataFrame:
    """(term1, term2, label): for each name at most ``each`` others, in their order, that share enough tokens and no id."""
    rows = dictionary.select("name", "id").distinct()
    a, b = _by_token(rows), _by_token(rows)
    left, right = a.select("token", F.col("name").alias("term1")).distinct(), b.select("token", F.col("name").alias("term2")).distinct()
    close = left.join(right, "token").where("term1 <> term2").select("term1", "term2").distinct().where(rules.overlaps_enough(F.col("term1"), F.col("term2"), ratio, longest))
    same = rows.select("id", F.col("name").alias("term1")).join(rows.select("id", F.col("name").alias("term2")), "id").select("term1", "term2").distinct()
    apart = close.join(same, ["term1", "term2"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("term1").orderBy("term2"))
    return apart.withColumn("_r", rank).where(F.col("_r") <= each).select("term1", "term2", F.lit("FALSE").alias("label"))


# Features


def _kinds(parts: Column, prefix: str, single: bool) -> Column:
    """The class of each token, the first that fits; single letters are a class of their own where ``single``."""
    kind = F.lit(None).cast("string")

    def of(t: Column) -> Column:
        out = F.when(t.rlike("^[a-z]$"), "CHAR") if single else None
        for name, pattern in CLASSES.items():
            hit = t.rlike(f"^(?:{pattern})$")
            out = out.when(hit, name) if out is not None else F.when(hit, name)
        return F.concat(F.lit(prefix), F.coalesce(out.otherwise("OTHER"), kind, F.lit("OTHER")))

    return F.transform(parts, of)


def _bin(prefix: str, value: Column, width: float) -> Column:
    return F.concat(F.lit(prefix), F.floor(value / width).cast("string"))


def features(a: Column, b: Column) -> Column:
    """array<string>: what a pair of normalized names has; a name equal in all but blanks has PERFECT besides."""

    def of(p: Column) -> Column:
        x, y = tokens(p[0]), tokens(p[1])
        same, mine, theirs = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
        diff = F.concat(mine, theirs)
        sames, diffs = _kinds(same, "SAME_", False), _kinds(diff, "DIFF_", True)
        weight = lambda c: F.regexp_extract(c, r"\bp ([0-9]+)\b", 1)
        counted = lambda kinds: F.transform(F.map_entries(T.counts(kinds)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        only = lambda kinds, tag: F.when((F.size(kinds) > 0) & (F.size(F.array_distinct(kinds)) == 1), F.array(F.concat(F.lit(tag), kinds[0])))
        long, short = F.greatest(F.size(x), F.size(y)), F.least(F.size(x), F.size(y))
        some = F.array(
            F.when((weight(p[0]) != "") & (weight(p[1]) != ""), F.when(weight(p[0]) == weight(p[1]), "SAME_WEIGHT").otherwise("DIFF_WEIGHT")),
            F.when(similarity.is_perfect(p[0], p[1]), F.lit("PERFECT")).otherwise(_bin("SIMPLE=", similarity.simple(p[0], p[1]), 0.1)),
            F.when(F.contains(p[0], p[1]) | F.contains(p[1], p[0]), F.lit("SUBSTRING")),
            F.concat(F.lit("NUM_OF_SAMES="), F.size(same).cast("string")), F.concat(F.lit("NUM_OF_DIFFS="), F.size(diff).cast("string")),
            F.concat(F.lit("LENGTHDIFF="), (long - short).cast("string")), _bin("RELLENGTHDIFF=", (long - short) / F.greatest(long, F.lit(1)), 0.25),
        )
        grams = F.concat(*[F.transform(F.array_intersect(T.ngrams(x, n), T.ngrams(y, n)), lambda g: F.concat(F.lit(f"GRAM{n}="), g)) for n in (2, 3)])
        none = F.array().cast("array<string>")
        return F.array_distinct(F.concat(F.filter(some, lambda s: s.isNotNull()), grams, counted(sames), counted(diffs), F.coalesce(only(sames, "ONLY_"), none), F.coalesce(only(diffs, "ONLY_"), none)))

    return let(F.array(a, b), of)


def with_features(pairs: DataFrame, a: str = "term1", b: str = "term2") -> DataFrame:
    """Pairs with their features, and the transpositions of their tokens among them.  A pair with a null name has none."""
    moved = similarity.token_transpositions(F.col(a), F.col(b))
    own = F.concat(features(F.col(a), F.col(b)), F.array(F.concat(F.lit("TRANSPOSITIONS="), moved.cast("string"))))
    return pairs.withColumn("features", F.coalesce(own, F.array().cast("array<string>")))


# Model


def train(pairs: DataFrame, regularization: float = 0.01, label: str = "label") -> PipelineModel:
    """A maximum-entropy model of pairs (term1, term2, label TRUE or FALSE)."""
    rows = with_features(pairs).withColumn("y", (F.col(label) == "TRUE").cast("double"))
    return Pipeline(stages=[CountVectorizer(inputCol="features", outputCol="vector", binary=True, vocabSize=1 << 18), LogisticRegression(featuresCol="vector", labelCol="y", regParam=regularization)]).fit(rows)


def scored(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Pairs with score: the probability of TRUE; PERFECT for equal names, 0 for null ones."""
    out = model.transform(with_features(pairs)).withColumn("_p", vector_to_array("probability")[1])
    a, b = F.col("term1"), F.col("term2")
    score = F.when(a.isNull() | b.isNull(), 0.0).when(similarity.is_perfect(a, b), PERFECT).otherwise(F.col("_p"))
    return out.select(*pairs.columns, score.alias("score"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n)."""
    return rows.groupBy(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(n, accuracy), rows with a null left out."""
    return rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def cross_validated(pairs: DataFrame, folds: int = 5, threshold: float = 0.5, keys: Sequence[str] = ("term1", "term2")) -> DataFrame:
    """(fold, n, accuracy): each fold, by a hash of the pair, judged by a model of the others."""
    rows = pairs.withColumn("fold", F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int"))
    out = None
    for k in range(folds):
        model = train(rows.where(F.col("fold") != k))
        judged = scored(model, rows.where(F.col("fold") == k)).withColumn("said", F.when(F.col("score") > threshold, "TRUE").otherwise("FALSE"))
        one = accuracy(judged, "label", "said").select(F.lit(k).alias("fold"), "n", "accuracy")
        out = one if out is None else out.unionByName(one)
    return out
