"""Byte-level BPE: length-bucketed padded numpy matrices, one merge per row and round.

Texts are cut into pieces by the vocabulary's pattern, whose boundaries are
found for all characters of a slice at once from their classes.  Its distinct
pieces are put into matrices of equal padded length, and in every round each
row merges its leftmost pair of least rank.  Ranks of pairs come from a sorted
hash array of all (left, right) whose bytes together are a token; after a
merge only the two pairs beside it are looked up again, and rows without a
pair left to merge leave the matrix.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm.shared import limit_batches
from onomast.llm.vec import SortedHashArray, raw_bytes, slices, trimmed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1 << 40)
#: Pieces of more bytes than this are merged with a queue, whose time doesn't grow with the square of the length.
LONG_PIECE = 256
#: Text bytes encoded together: more share more pieces, and take more memory, of which the pipeline's stage has less.
SLICE, STAGE_SLICE = 4 << 20, 1 << 20
#: Text bytes whose pieces are sought together, and runs copied together: their arrays take many times that, and gain nothing from more.
SOUGHT, RUNS = 1 << 17, 1 << 15


class Vocabulary:
    """Token bytes by rank, and the ranks of pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, rank = (array("q") for _ in range(3))  # no tuples: every worker builds this at once
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        self.table = SortedHashArray((left << 32 | right).astype(np.uint64))
        self.pair_rank = np.concatenate([rank, [NONE]])
        self.merges = left, right, rank

    @functools.cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """Rank by pair, for long pieces only."""
        return {(a, b): r for a, b, r in zip(*(x.tolist() for x in self.merges))}

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; NONE where there is none."""
        return self.pair_rank[self.table.find((left << 32 | right).astype(np.uint64))]

    def merge_matrix(self, tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a padded matrix; ``n`` tokens count in each row.  Gives the matrix and the new counts."""
        rows, width = tokens.shape
        out, out_n = tokens.copy(), n.copy()
        if width < 2:
            return out, out_n
        live = np.arange(rows)
        valid = np.arange(width - 1)[None, :] < (n - 1)[:, None]
        rank = np.full((rows, width - 1), NONE)
        rank[valid] = self.find(tokens[:, :-1][valid], tokens[:, 1:][valid])
        columns = np.arange(width)
        while len(live):
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(live)), at]
            done = least == NONE
            if done.any():
                out[live[done], :width] = tokens[done]
                out_n[live[done]] = n[done]
                go = ~done
                live, tokens, n, rank, at, least = live[go], tokens[go], n[go], rank[go], at[go], least[go]
                if not len(live):
                    break
            here = np.arange(len(live))
            tokens[here, at] = least
            take = columns[None, :] + (columns[None, :] > at[:, None])
            np.minimum(take, width - 1, out=take)
            tokens = np.take_along_axis(tokens, take, axis=1)
            n = n - 1
            take = np.minimum(columns[None, : width - 1] + (columns[None, : width - 1] > at[:, None]), width - 2)
            rank = np.take_along_axis(rank, take, axis=1)
            rank[np.arange(width - 1)[None, :] >= (n - 1)[:, None]] = NONE
            for offset in (-1, 0):
                j = at + offset
                ok = np.flatnonzero((j >= 0) & (j < n - 1))
                rank[ok, j[ok]] = self.find(tokens[ok, j[ok]], tokens[ok, j[ok] + 1])
            if (most := int(n.max())) < width:  # compaction of columns
                width = max(most, 2)
                tokens, rank, columns = tokens[:, :width], rank[:, : width - 1], columns[:width]
        return out, out_n

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a queue of (rank, position) over a linked list."""
        token = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := self.pairs.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i] if token[i] >= 0 else n
            if j >= n or self.pairs.get((token[i], token[j])) != r:
                continue
            token[i], token[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := self.pairs.get((r, token[after[i]]))) is not None:
                    heapq.heappush(queue, (x, i))
            if before[i] >= 0 and (x := self.pairs.get((token[before[i]], r))) is not None:
                heapq.heappush(queue, (x, before[i]))
        return np.array([t for t in token if t >= 0], np.int64)

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct pieces, end to end, and how many each has."""
        data, offsets = raw_bytes(pieces)
        sizes = np.diff(offsets)
        counts = np.zeros(len(sizes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, tokens end to end
        edges = [0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONG_PIECE]
        for low, high in zip(edges, edges[1:]):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(rows), 1 << 16):
                some = rows[a : a + (1 << 16)]
                cells = np.minimum(offsets[some][:, None] + np.arange(high)[None, :], max(0, len(data) - 1))
                tokens, n = self.merge_matrix(self.of_byte[data[cells]], sizes[some].copy())
                counts[some] = n
                found.append((some, n, tokens[np.arange(tokens.shape[1])[None, :] < n[:, None]]))
        for i in np.flatnonzero(sizes > LONG_PIECE):
            t = self.merge_long(data[offsets[i] : offsets[i + 1]].tobytes())
            counts[i] = len(t)
            found.append((np.array([i]), np.array([len(t)]), t))
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, n, tokens in found:
            out[spread(ends[rows] - n, n)] = tokens
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts end to end (int32) and how many each has; a null text has none."""
        data, offsets = raw_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cuts = piece_starts(data, offsets)
        ends = np.concatenate([cuts[1:], [len(data)]])
        edges = np.concatenate([cuts, ends[-1:]]).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        tokens, counts = self.encode_pieces(coded.dictionary)
        n = counts[codes]
        starts = (np.cumsum(counts) - counts)[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        upto = total[np.searchsorted(cuts, offsets)]
        return gathered(tokens, starts, n), np.diff(upto)

    def decode_bytes(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of tokens, end to end."""
        return gathered(self.bytes, self.starts[tokens], self.lengths[tokens])


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start+1, ... (n of them) for each start, end to end."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - n), n)


def gathered(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``values[spread(starts, n)]``, whose positions take eight times the room of bytes: some runs at a time."""
    return np.concatenate([values[:0], *(values[spread(starts[a : a + RUNS], n[a : a + RUNS])] for a in range(0, len(n), RUNS))])


OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, as the pattern sees it."""
    out = np.zeros(0x110000, np.uint8)
    cps = np.arange(0x110000, dtype=np.uint32)
    cps[0xD800:0xE000] = ord("?")
    for a in range(0, len(cps), 1 << 16):  # no object for each code point: every worker builds this at once
        part = cps[a : a + (1 << 16)].tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, part):
                out[a + m.start() : a + m.end()] = kind
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of UTF-8 texts (end to end, with the n+1 offsets between them) start, as byte positions.

    The same as all matches of PATTERN in each text: runs of one class, to
    which a blank before them belongs; white space before anything else
    without its last character; and the contractions of an apostrophe.
    Texts are independent, so some are looked at together; one long text stays whole.
    """
    edges = np.flatnonzero(np.diff(offsets[:-1] // SOUGHT, prepend=-1))
    parts = [_piece_starts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) + offsets[a] for a, b in zip(edges, [*edges[1:], len(offsets) - 1])]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[cps]
    n = len(cps)
    text_start = np.zeros(n + 1, bool)
    text_start[np.searchsorted(lead, offsets)] = True
    text_start = text_start[:n]
    before = np.concatenate([[OTHER], kind[:-1]])
    after_blank = np.concatenate([[False], cps[:-1] == 32]) & ~text_start
    run = text_start | (kind != before)
    start = run & ~((kind != SPACE) & after_blank)  # a blank before belongs to the run
    # the last white space before something else stands alone or, if a blank, goes with it
    last = (kind == SPACE) & np.concatenate([(kind[1:] != SPACE) & ~text_start[1:], [False]])
    start |= last
    # 's 't 'm 'd 're 've 'll
    quote = np.flatnonzero((cps == 39) & run & ~after_blank)
    quote = quote[quote + 1 < n]
    quote = quote[~text_start[quote + 1]]
    one = cps[quote + 1]
    two = np.where((quote + 2 < n) & ~text_start[np.minimum(quote + 2, n - 1)], cps[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & ((((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    start[quote[short | long] + 1] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    after = after[after < n]
    start[after[kind[after] == LETTER]] = True
    start |= text_start
    return lead[start]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python process."""
    return Vocabulary(path)


def encode(text: Column, path: str = VOCABULARY) -> Column:
    """array<int> of a text's token ids; an empty text has none, null stays null."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for texts in trimmed(batches):
            parts = []
            for _, part in slices(texts, SLICE):
                tokens, n = v.encode(part)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens), mask=pc.is_null(part)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return of(text)


def decode(tokens: Column, path: str = VOCABULARY) -> Column:
    """The text of an array<int> of token ids; bytes that are no UTF-8 become U+FFFD.  Ids outside the vocabulary and null ids are left out; a null array stays null."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for lists in batches:
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            good = (ids >= 0) & (ids < len(v.lengths))
            ids = np.where(good, ids, 0)
            size = np.where(good, v.lengths[ids], 0)
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
            data = v.bytes[spread(v.starts[ids], size)].tobytes()
            yield pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string(), mask=np.asarray(lists.is_null()))

    return of(tokens)


def tokenize(docs: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY, prefix: str = "", slice_bytes: int = SLICE) -> DataFrame:
    """The columns ``keep`` of ``docs`` with tokens (array<int>), n_tokens, and round_trip: the tokens decode to the text's very bytes.

    A null text has null tokens, 0 n_tokens and null round_trip; an empty one
    no tokens and a true round_trip.  Repeated rows are encoded one by one; an
    empty table gives an empty result.  Whole texts are encoded, however long;
    special tokens are never produced.  Added columns are named ``prefix`` + name.
    The result is lazy, so the session's limit of rows that go to Python at a
    time is lowered for good.
    """
    limit_batches(docs.sparkSession)
    kind = "struct<tokens:array<int>,round_trip:boolean>"

    @F.arrow_udf(kind)
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for texts in trimmed(batches):
            parts = []
            for _, part in slices(texts, slice_bytes):
                tokens, n = v.encode(part)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                data, byte_offsets = raw_bytes(part)
                size = v.lengths[tokens]
                ends = np.concatenate([[0], np.cumsum(size)])[offsets]
                back = v.decode_bytes(tokens)
                same = np.diff(ends) == np.diff(byte_offsets)
                if len(back) == len(data):
                    wrong = np.searchsorted(np.flatnonzero(back != data), byte_offsets)
                    same &= wrong[1:] == wrong[:-1]
                else:
                    same &= np.array([back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(ends, ends[1:], byte_offsets, byte_offsets[1:])], bool)
                null = pc.is_null(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens), mask=null)
                parts.append(pa.StructArray.from_arrays([lists, pa.array(same, mask=np.asarray(null))], names=["tokens", "round_trip"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("tokens", pa.list_(pa.int32())), ("round_trip", pa.bool_())]))

    found = docs.select(*keep, both(F.col(text)).alias("_bpe_found"))
    t = F.col("_bpe_found.tokens")
    return found.select(*keep, t.alias(prefix + "tokens"), F.coalesce(F.when(t.isNotNull(), F.size(t)), F.lit(0)).alias(prefix + "n_tokens"), F.col("_bpe_found.round_trip").alias(prefix + "round_trip"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, tokens, n_tokens, round_trip."""
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, source, tokens, n_tokens, round_trip."""
    return tokenize(docs, [c for c in ("doc_id", "lang", "source") if c in docs.columns], slice_bytes=STAGE_SLICE)
