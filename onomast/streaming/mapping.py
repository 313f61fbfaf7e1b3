"""Mentions that arrive as a stream, mapped as in batch: a stream-static join without state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from onomast.functions import normalize as N
from onomast.operators.retrieval import map_mentions


def resolved(forms: DataFrame, table: DataFrame) -> DataFrame:
    """A stream of rows with ``form`` joined to a static table of what each form means (form, synonym, score, tax, id, match_type); unknown forms are rejected, with nulls."""
    return forms.join(table, "form", "left")


def normalized_stream(mentions: DataFrame, mention: str = "mention") -> DataFrame:
    """A stream of mentions with their normal form."""
    return mentions.withColumn("form", N.normalize(F.col(mention)))


def start(mentions: DataFrame, postings: DataFrame, entries: DataFrame, items: DataFrame, taxa: Sequence[str], path: str, checkpoint: str, mention: str = "mention", **trigger) -> StreamingQuery:
    """Map each micro-batch of a stream of mentions like a batch and append it to a Parquet table.

    A batch that is run again after a failure writes its own folder again, so
    the table has every mention once.
    """

    def write(batch: DataFrame, number: int) -> None:
        map_mentions(batch, postings, entries, items, taxa, mention).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return mentions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
