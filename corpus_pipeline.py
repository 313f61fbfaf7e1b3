"""A training corpus from the documents table, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
it kept; ``run`` writes each result as Parquet in the shared folder and reads
it again.  All stages but the last return the columns of ``documents``.

What a stage returns reads tables that it made on the way.  By then the result
of the stage before it has been written, so that one's are deleted first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from onomast.llm import bpe, langid, mixing, quality, simhash
from onomast.llm.shared import clear, new_folder, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _after_clearing(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _after_clearing(langid.stage)),
    ("quality_rules", _after_clearing(quality.stage)),
    ("near_dedup", _after_clearing(simhash.stage)),
    ("mix_sources", _after_clearing(mixing.stage)),
    ("bpe_encode", _after_clearing(bpe.stage)),
]

#: SQL has no language models, signatures or merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last is not written.

    Null and empty texts go with the first stage.  Rows that repeat are one
    after near_dedup, but for texts without words.  An empty table gives an
    empty result.  The folder of a stage is deleted when the next one's has
    been written; the last, from which the result is read, stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
