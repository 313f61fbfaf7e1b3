"""Flat files of token ids, and token counts of the documents in them by a separator scan.

A flat file is nothing but token ids of fixed width, with an end-of-document
id after each document; there is no index.  Blocks of the files are searched
for that id all at once, and a prefix scan over the blocks' summaries (how many
separators, where the last one is) gives each block the number and the start
of the document with which it begins.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.llm import bpe
from onomast.llm.files import open_read, open_write, sizes
from onomast.llm.shared import cut, new_folder
from onomast.llm.vec import as_array, slices, trimmed

#: End of document in the 50k vocabularies: the one id that they leave free.
END = 50_256
#: Little-endian type of an id, and the bytes that a task scans at a time.
WIDTH, BLOCK_BYTES = "<u2", 4 << 20


def with_ends(tokens: np.ndarray, n: np.ndarray, end: int, width: str) -> np.ndarray:
    """The tokens of documents end to end, with ``end`` after each."""
    out = np.full(len(tokens) + len(n), end, width)
    at = np.ones(len(out), bool)
    at[np.cumsum(n + 1) - 1] = False
    out[at] = tokens
    return out


def write_tokens(docs: DataFrame, uri: str, id_col: str = "doc_id", text: str = "text", path: str = bpe.VOCABULARY, end: int = END, width: str = WIDTH) -> DataFrame:
    """Encode all documents into flat files in the folder ``uri``, one for each partition; gives (doc_id, file, ordinal), from a table that is written with them.

    ``ordinal`` is the place of the document in its file, from 0.  A null text
    is written as an empty one.  Repeated rows are written one by one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(path)
        name = f"part-{TaskContext.get().partitionId():06d}.tokens"
        done = 0
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with open_write(f"{uri}/{name}") as f:
            for batch in trimmed(itertools.chain([first], batches)):
                for _, part in slices(batch.column(1), bpe.SLICE):
                    tokens, n = v.encode(as_array(part))
                    f.write(with_ends(tokens, n, end, width).tobytes())
                yield pa.record_batch({"doc_id": batch.column(0), "file": pa.array([name] * batch.num_rows), "ordinal": pa.array(np.arange(done, done + batch.num_rows))})
                done += batch.num_rows

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cut(rows.mapInArrow(write, "doc_id bigint, file string, ordinal bigint"))


def blocks(spark: SparkSession, uri: str, suffixes: tuple[str, ...] = (".tokens",), width: str = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, file, block, first, n): the stretches of ids of all files, some for each task."""
    size = np.dtype(width).itemsize
    step = max(1, block_bytes // size)
    found = sizes(uri, suffixes, missing=True)
    for path, n in found:
        if n % size:
            raise ValueError(f"{path}: {n} bytes are no whole number of ids")
    files = [(path, path.rsplit("/", 1)[-1], n // size) for path, n in found]
    rows = spark.createDataFrame(files, "path string, file string, ids bigint").where("ids > 0")
    each = rows.select("path", "file", "ids", F.explode(F.sequence(F.lit(0), F.expr(f"cast((ids - 1) div {step} as int)"))).alias("block"))
    each = each.select("path", "file", F.col("block").cast("bigint").alias("block"), (F.col("block") * F.lit(step).cast("bigint")).alias("first"), F.least(F.lit(step).cast("bigint"), F.col("ids") - F.col("block") * F.lit(step).cast("bigint")).alias("n"))
    many = sum(-(-n // step) for _, _, n in files)
    return each.repartition(max(1, min(many, 2 * spark.sparkContext.defaultParallelism, 20_000) if many < 20_000 else many // 8))


def count_documents(spark: SparkSession, uri: str, end: int = END, suffixes: tuple[str, ...] = (".tokens",), width: str = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, first, n_tokens, ended) of every document in the flat files: the place of its first token and its tokens, without the separator.

    Separators side by side are empty documents (0 tokens).  Tokens after the
    last separator of a file are a document that isn't ended.  An empty file
    has no documents; a folder without such files gives an empty table.  A
    file that isn't a whole number of ids is an error, a missing folder isn't.  A document may be
    longer than any number of blocks.
    """
    kind = np.dtype(width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_read(row["path"]) as f:
                    f.seek(row["first"] * kind.itemsize)
                    ids = np.frombuffer(f.read(row["n"] * kind.itemsize), kind)
                ends = np.flatnonzero(ids == end).astype(np.int64) + row["first"]
                last = [int(ends[-1]) if len(ends) else None]
                yield pa.record_batch({
                    "file": pa.array([row["file"]]), "block": pa.array([row["block"]]), "stop": pa.array([row["first"] + len(ids)]), "found": pa.array([len(ends)], pa.int64()), "last": pa.array(last, pa.int64()),
                    "ends": pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends)),
                })

    scanned = cut(blocks(spark, uri, suffixes, width, block_bytes).mapInArrow(scan, "file string, block bigint, stop bigint, found bigint, last bigint, ends array<bigint>"))
    # the prefix scan: over one small row for each block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = scanned.select("file", "block", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("base"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"))
    whole = scanned.where("found > 0").join(base, ["file", "block"]).select("file", "base", "open", "ends", F.posexplode("ends").alias("i", "stop"))
    whole = whole.withColumn("first", F.when(F.col("i") == 0, F.col("open")).otherwise(F.expr("element_at(ends, i)") + 1))
    ended = whole.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "first", (F.col("stop") - F.col("first")).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = scanned.groupBy("file").agg(F.sum("found").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("first"), F.max("stop").alias("stop")).where("stop > first")
    return ended.unionByName(tail.select("file", "ordinal", "first", (F.col("stop") - F.col("first")).alias("n_tokens"), F.lit(False).alias("ended")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files of all of them: doc_id, file, ordinal, first, n_tokens."""
    folder = new_folder(spark, "tokens")
    written = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return written.join(count_documents(spark, folder), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "first", "n_tokens")
