"""The tables of a folder, and the views of them that stand for dictionaries, mentions and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The same views for the oracle.
DICT = "dict AS (SELECT p_name AS name, p_partkey AS id, CAST(p_size % 9 - 1 AS INTEGER) AS priority, p_brand AS tax FROM part)"
MENTION = "mention AS (SELECT DISTINCT upper(string_split(p_name, ' ')[1]) || '-' || string_split(p_name, ' ')[2] || CAST(p_size % 3 AS VARCHAR) AS mention FROM part)"
PAIR = "names AS (SELECT DISTINCT p_name AS name FROM part), pair AS (SELECT a.name AS a, b.name AS b FROM (SELECT name, string_split(name, ' ') AS t FROM names) a JOIN (SELECT name, string_split(name, ' ') AS t FROM names) b ON a.name <> b.name AND list_has_any(a.t, b.t))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, id, priority, tax) from the parts."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), (F.col("p_size") % 9 - 1).cast("int").alias("priority"), F.col("p_brand").alias("tax"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention): different spellings, as of a text, of the parts' names."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(F.concat(F.upper(words[0]), F.lit("-"), words[1], (F.col("p_size") % 3).cast("string")).alias("mention")).distinct()


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) different names with a token in common, by an equi-join on their tokens."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    tokens = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("token"))
    left, right = (tokens.select("token", F.col("name").alias(c)) for c in "ab")
    return left.join(right, "token").where("a <> b").select("a", "b").distinct()
