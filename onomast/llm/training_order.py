"""Training order: every sequence of tokens gets a slot by a keyed Feistel permutation, and is written at its slot in shards of fixed stride.

The permutation of 0 .. n-1 is a balanced Feistel network over the least even
number of bits that holds n, walked on while a value is n or more.  It needs
no table and no sort of random keys: a sequence's slot follows from its number
alone, and the number from the slot.  Slot s is in shard s // PER_SHARD, at
byte (s % PER_SHARD) * stride, so reading can begin or go on anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import bpe
from onomast.llm.files import open_read, open_write, sizes
from onomast.llm.shared import cut, new_folder, remove, written
from onomast.llm.token_files import END, WIDTH, with_ends
from onomast.llm.vec import mix64, slices, trimmed

#: Tokens of a sequence, and sequences of a shard.
LENGTH, PER_SHARD = 2048, 8192
KEY, ROUNDS = 0x5EED, 6
_U = np.uint64


class Permutation:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        if n < 0 or n > 1 << 62:
            raise ValueError("n must be in 0 .. 2**62")
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = _U((1 << self.half) - 1)
        self.keys = mix64(np.arange(rounds, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(key & (1 << 64) - 1))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> _U(self.half), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix64(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & self.mask)
        return left << _U(self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(_U), back)
        while len(todo := np.flatnonzero(out >= _U(self.n))):
            out[todo] = self._once(out[todo], back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.tokens"


def pack(docs: DataFrame, length: int = LENGTH, path: str = bpe.VOCABULARY, end: int = END, width: str = WIDTH) -> tuple[DataFrame, str]:
    """(part, place, n_tokens, doc_ids, tokens) sequences of ``length`` ids: each partition's documents end to end with ``end`` after each, the last sequence filled up with ``end``; and the URI of the table that they are in."""
    kind = np.dtype(width)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(path)
        part = TaskContext.get().partitionId()
        rest, place = np.zeros(0, kind), 0
        ids: list[np.ndarray] = []  # the documents of ``rest`` and what of them is in it
        spans: list[np.ndarray] = []

        def out(tokens: np.ndarray, owner: np.ndarray, null: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            n = len(tokens) // length
            ends = np.cumsum(size)
            first, last = (ends - size) // length, np.maximum(ends - 1, 0) // length
            many = last - first + 1
            row = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            order = np.argsort(row, kind="stable")
            doc = np.repeat(np.arange(len(owner)), many)[order]
            offsets = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(owner[doc], mask=null[doc]))
            filled = np.minimum(length, ends[-1] - np.arange(n) * length)
            flat = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * length * kind.itemsize, length * kind.itemsize, dtype=np.int32)), pa.py_buffer(tokens.tobytes())])
            return pa.record_batch({"part": pa.array(np.full(n, part, np.int32)), "place": pa.array(np.arange(place, place + n)), "n_tokens": pa.array(filled.astype(np.int32)), "doc_ids": lists, "tokens": flat})

        owner, null, size = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        for batch in trimmed(batches):
            for first, texts in slices(batch.column(1), bpe.SLICE):
                tokens, n = v.encode(texts)
                who = batch.column(0).slice(first, len(texts))
                owner = np.concatenate([owner, who.fill_null(0).to_numpy()])
                null = np.concatenate([null, np.asarray(who.is_null())])
                size = np.concatenate([size, n + 1])
                rest = np.concatenate([rest, with_ends(tokens, n, end, width)])
                whole = len(rest) // length * length
                if not whole:
                    continue
                upto = int(np.searchsorted(np.cumsum(size), whole))  # the document that holds the last token taken
                here = size[: upto + 1].copy()
                here[-1] -= int(here.sum()) - whole
                yield out(rest[:whole], owner[: upto + 1], null[: upto + 1], here)
                place += whole // length
                left = int(size[upto] - here[-1])
                start = upto if left else upto + 1
                owner, null, size, rest = owner[start:], null[start:], size[start:].copy(), rest[whole:]
                if left:
                    size[0] = left
        if len(rest):
            yield out(np.concatenate([rest, np.full(length - len(rest), end, kind)]), owner, null, size)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return written(rows.mapInArrow(packed, "part int, place bigint, n_tokens int, doc_ids array<bigint>, tokens binary"), "packed", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "6"})


def materialise(docs: DataFrame, uri: str, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD, path: str = bpe.VOCABULARY, end: int = END, width: str = WIDTH) -> DataFrame:
    """Write all documents (doc_id, text) in training order into the folder ``uri``; gives (slot, shard, offset, n_tokens, doc_ids) of every sequence, from a table written with them.

    ``doc_ids`` are the documents with tokens in the sequence, in their order;
    ``n_tokens`` counts its ids without those that fill up a partition's last.
    A null or empty text has only its end-of-document id.  A null doc_id is a
    null in doc_ids.  Repeated rows are written one by one; an empty table
    gives no shard and an empty result.  A text may be longer than any number
    of sequences.  Other columns aren't read.  A shard that is there already
    with all its bytes isn't written again, so a job that was stopped can be
    run again with the same folder, data and parameters.
    """
    spark = docs.sparkSession
    stride = length * np.dtype(width).itemsize
    table, table_uri = pack(docs, length, path, end, width)
    parts = table.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one small row for each task
    total = sum(r["n"] for r in parts)
    before = np.concatenate([[0], np.cumsum([r["n"] for r in parts])])
    base = np.zeros(1 + max((r["part"] for r in parts), default=0), np.int64)
    base[[r["part"] for r in parts]] = before[:-1]
    order = Permutation(total, key)

    @F.arrow_udf("struct<slot:bigint,packed:binary>")
    def placed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pack_ = zstandard.ZstdCompressor(level=6).compress
        for part, place, tokens in trimmed(batches):
            slots = order.slot(base[part.to_numpy()] + place.to_numpy())
            yield pa.StructArray.from_arrays([pa.array(slots), pa.array([pack_(x.as_buffer()) for x in tokens], pa.binary())], names=["slot", "packed"])

    there = dict(sizes(uri, (".tokens",), missing=True))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard(rows: pa.Table) -> pa.RecordBatch:
            number = rows.column("shard")[0].as_py()
            name = f"{uri.rstrip('/')}/{shard_name(number)}"
            if there.get(name) != rows.num_rows * stride:
                with open_write(name) as f:
                    unpack = zstandard.ZstdDecompressor().decompress
                    for chunk in rows.column("packed").chunks:
                        for x in chunk:
                            f.write(unpack(x.as_buffer()))
            slots = rows.column("slot").to_numpy()
            return pa.record_batch({"slot": pa.array(slots), "shard": pa.array(np.full(len(slots), number)), "offset": pa.array(slots % per_shard * stride), "n_tokens": rows.column("n_tokens").combine_chunks(), "doc_ids": rows.column("doc_ids").combine_chunks()})

        for batch in batches:
            number = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and held[0].column("shard")[0].as_py() != number[a]:
                        yield shard(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield shard(pa.Table.from_batches(held))

    shards = max(1, -(-total // per_shard))
    found = table.select("n_tokens", "doc_ids", placed("part", "place", "tokens").alias("p")).select("p.slot", F.expr(f"p.slot div {per_shard}").alias("shard"), "n_tokens", "doc_ids", "p.packed")
    ranges = found.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    done = cut(ranges.mapInArrow(write, "slot bigint, shard bigint, offset bigint, n_tokens int, doc_ids array<bigint>"))
    remove(spark, table_uri)
    return done


def read(uri: str, slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, width: str = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, token ids) of every sequence in training order from ``slot`` on: shard after shard, each read forward from its first wanted byte."""
    kind = np.dtype(width)
    stride = length * kind.itemsize
    for path, size in sizes(uri, (".tokens",)):
        first = int(path.rsplit("-", 1)[1].split(".")[0]) * per_shard
        if slot >= first + size // stride:
            continue
        skip = max(0, slot - first)
        with open_read(path) as f:
            f.seek(skip * stride)
            for i in range(skip, size // stride):
                yield first + i, np.frombuffer(f.read(stride), kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in training order: slot, shard, offset, n_tokens, doc_ids."""
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), new_folder(spark, "training"))
