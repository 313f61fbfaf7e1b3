"""Sinks: delimited files, annotations, readable listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(table: DataFrame, path: str, compressed: bool = True, mode: str = "errorifexists") -> None:
    """One tab-separated line for each row; nulls as empty fields.  Use ``table.distinct()`` first for a set."""
    table.write.mode(mode).option("sep", "\t").option("compression", "gzip" if compressed else "none").option("quote", "").option("escape", "").option("nullValue", "").option("emptyValue", "").csv(path)


def write_table(table: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """As Parquet, in folders by some columns."""
    table.write.mode(mode).partitionBy(*partition_by).parquet(path)


def as_annotations(mapped: DataFrame, source: str = "part catalogue") -> DataFrame:
    """(source, entry_id, taxonomy_id, begin, end, confidence, normalized, synonym) of the mentions that were resolved; rejected ones have none.

    confidence: the score of the name and that of the context, to three places.
    """
    kept = mapped.where("id IS NOT NULL")
    return kept.select(F.lit(source).alias("source"), F.col("id").cast("string").alias("entry_id"), F.col("tax").alias("taxonomy_id"), "begin", "end", F.format_string("%.3f / %.3f", "score", "semantic_score").alias("confidence"), F.col("form").alias("normalized"), "synonym")


def replace_annotations(existing: DataFrame, new: DataFrame, key: tuple[str, ...] = ("doc_id", "begin", "end")) -> DataFrame:
    """The new annotations, and the existing ones of places that have no new one."""
    return existing.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def readable(candidates: DataFrame) -> DataFrame:
    """(form, line): a line for each candidate with its score and what it stands for."""
    ids = F.array_join(F.transform("entries", lambda e: F.concat_ws("/", e["id"].cast("string"), e["tax"], e["priority"].cast("string"))), ", ")
    return candidates.select("form", F.format_string("%s (%.3f): %s", "synonym", "score", ids).alias("line"))
