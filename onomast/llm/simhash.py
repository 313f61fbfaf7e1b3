"""SimHash near-duplicates: every pair of signatures up to the greatest distance is found.

A signature has 256 bits and is cut into twelve segments of 21 or 22 bits.  Of
two signatures that differ in at most 36 bits, either the first segment
differs in at most three bits or another in at most two, since four and eleven
times three would make 37.

If a segment differs in at most two bits, one of its thirds doesn't differ at
all (one of its quarters, if in three).  So a signature is sent to three or
four tasks for each segment, by the value of one such piece, and there the
values of the rest of the segment that differ in few enough bits are looked
up: 37 small rows a distinct signature are shuffled.  Signatures whose segments
are that close are verified by their whole distance.

Near copies of one text aren't expanded into pairs: signatures with one value
of a segment are connected first, and what is connected goes on as one node.
Two nodes that no link connects are passed over only if their first members
are too far apart for any two of their members to be within the limit, so no
connection is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm.bloom import maybe_among
from onomast.llm.shared import cut, limit_batches, remove, written
from onomast.llm.vec import as_array, mix64, raw_bytes, slices, trimmed, word_hashes

#: 64-bit words of a signature, and the bits of the segments of each.
WORDS, SEGMENT_BITS = 4, (22, 21, 21)
#: Bits in which the signatures of near-duplicates may differ.
MAX_DISTANCE = 36
#: Text bytes signed at a time; a longer text is taken in pieces.
SLICE = 256 << 10
#: Rows joined at a time, if no group of one piece is larger.
ROWS = 50_000
#: Signatures that share a value are compared pair by pair up to this many, else through pivots.
SHORT_RUN = 64
#: Values looked up, and nodes compared, at a time.
LOOKUPS, PAIRS = 1 << 17, 1 << 18

_U = np.uint64
_LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], _U)
#: (word, first bit, bits) of each segment.
SEGMENTS = [(w, sum(SEGMENT_BITS[:i]), n) for w in range(WORDS) for i, n in enumerate(SEGMENT_BITS)]
#: Bits in which a segment may differ, such that of two signatures within MAX_DISTANCE one segment differs in no more.
RADII = [MAX_DISTANCE // len(SEGMENTS) - (i > MAX_DISTANCE % len(SEGMENTS)) for i in range(len(SEGMENTS))]
#: (segment, first bit in it, bits) of each piece by which signatures are sent: one more for a segment than bits may differ.
PIECES = [(i, n * k // (r + 1), n * (k + 1) // (r + 1) - n * k // (r + 1)) for i, ((_, _, n), r) in enumerate(zip(SEGMENTS, RADII)) for k in range(r + 1)]


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each piece, pieces): short texts whole, those over SLICE bytes cut where no word is cut."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    long = np.flatnonzero(size > SLICE)
    if not len(long):
        yield from ((np.arange(a, a + len(p)), p) for a, p in slices(texts, SLICE))
        return
    short = pc.if_else(pa.array(size > SLICE), None, texts)
    yield from ((np.arange(a, a + len(p)), p) for a, p in slices(short, SLICE))
    for row in long:
        data, _ = raw_bytes(texts.slice(row, 1))
        blank = np.concatenate([np.flatnonzero(data == 32), [len(data)]])
        at = 0
        while at < len(data):
            end = int(blank[min(len(blank) - 1, np.searchsorted(blank, at + SLICE))])
            yield np.array([row]), pa.array([data[at:end].tobytes()], pa.binary())
            at = end + 1


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, WORDS) uint64 signatures and the number of distinct words of each text.

    A bit is set where more than half of the distinct words have it set in
    their hash.  A null text counts as empty.
    """
    texts = as_array(texts)
    out, kinds = np.zeros((len(texts), WORDS), _U), np.zeros(len(texts), np.int64)
    long: dict[int, list[np.ndarray]] = {}
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    for rows, part in _pieces(texts):
        hashes, counts = word_hashes(part)
        if len(rows) == 1 and size[rows[0]] > SLICE and part.type == pa.binary():
            long.setdefault(int(rows[0]), []).append(np.unique(hashes >> _U(20)))
            continue
        of = np.repeat(np.arange(len(part), dtype=_U), counts)
        word = np.unique(of << _U(44) | hashes >> _U(20))
        of = (word >> _U(44)).astype(np.int64)
        _sign(word & _U((1 << 44) - 1), of, rows, out, kinds)
    for row, parts in long.items():
        word = np.unique(np.concatenate(parts))
        _sign(word, np.zeros(len(word), np.int64), np.array([row]), out, kinds)
    return out, kinds


def _sign(word: np.ndarray, of: np.ndarray, rows: np.ndarray, out: np.ndarray, kinds: np.ndarray) -> None:
    """Signatures of texts from their distinct words: eight bits are counted at once, in the bytes of an integer, over at most 255 words."""
    n = np.bincount(of, minlength=len(rows))
    kinds[rows] = n
    some = np.flatnonzero(n)
    if not len(some):
        return
    place = np.arange(len(word)) - (np.cumsum(n) - n)[of]
    starts = np.flatnonzero(place % 255 == 0)
    sums = []
    for a in range(0, len(starts), 64):
        begin, end = starts[a], starts[a + 64] if a + 64 < len(starts) else len(word)
        h = mix64(word[begin:end])
        bits = np.stack([mix64(h + _U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(WORDS)], axis=1).view(np.uint8)
        sums.append(np.add.reduceat(_LANES[bits], starts[a : a + 64] - begin, axis=0))
    ones = np.concatenate(sums).view(np.uint8)
    owner = of[starts]
    ones = np.add.reduceat(ones, np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), axis=0, dtype=np.int64)
    out[rows[some]] = np.packbits(ones * 2 > n[some, None], axis=1, bitorder="little").view(_U)


def as_binary(sig: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(np.ascontiguousarray(sig).view(f"S{8 * WORDS}").ravel() if not len(sig) else [x.tobytes() for x in sig], pa.binary(), mask=mask)


def from_binary(column: pa.Array) -> np.ndarray:
    return raw_bytes(column)[0].view(_U).reshape(-1, WORDS)


def signature(text: Column) -> Column:
    """The signature of the distinct lower-case words, as binary; null for a text without words, empty or null."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in trimmed(batches):
            s, n = signatures(texts)
            yield as_binary(s, n == 0)

    return of(F.lower(text))


def _segment(sig: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a piece, and of the rest of its segment."""
    i, at, bits = PIECES[piece]
    word, start, n = SEGMENTS[i]
    value = (sig[:, word] >> _U(start) & _U((1 << n) - 1)).astype(np.int64)
    return value >> at & (1 << bits) - 1, value & (1 << at) - 1 | value >> at + bits << at


def routes(sig: np.ndarray) -> np.ndarray:
    """(37, signatures): the piece, and its value, by which each is sent."""
    return np.stack([_segment(sig, p)[0] | p << 16 for p in range(len(PIECES))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _pivot_links(sig: np.ndarray, rows: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows of one bucket that connect all whom pairs within ``limit`` connect."""
    left = rows
    while len(left) > 1:
        pivot = left[:1]
        far = distances(sig[pivot], sig[left])
        hit, rest, far = left[far <= limit], left[far > limit], far[far > limit]
        yield np.repeat(pivot, len(hit) - 1), hit[1:]
        near = rest[far <= 2 * limit]  # others are further than ``limit`` from all that were hit
        for a in range(1, len(hit), 64):
            if not len(near):
                break
            block = hit[a : a + 64]
            close = distances(sig[near][:, None], sig[block][None]) <= limit if len(near) <= 4096 else np.concatenate([distances(sig[near[i : i + 4096]][:, None], sig[block][None]) <= limit for i in range(0, len(near), 4096)])
            found = close.any(axis=1)
            yield near[found], block[close[found].argmax(axis=1)]
            near = near[~found]
        left = rest


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (further := new[new] != new).any():
            new = np.where(further, new[new], new)
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _run_links(key: np.ndarray, sig: np.ndarray, limit: int, pivots: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the rows of equal sorted keys that connect all whom pairs within ``limit`` connect; without ``pivots`` of short runs only."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    length = np.diff(edge)
    if pivots:
        for i in np.flatnonzero(length > SHORT_RUN):
            yield from _pivot_links(sig, np.arange(edge[i], edge[i + 1]), limit)
    at_rows = np.flatnonzero(np.repeat(length <= SHORT_RUN, length))
    key = key[at_rows]
    for d in range(1, min(SHORT_RUN, len(key))):
        pair = np.flatnonzero(key[d:] == key[:-d])
        if not len(pair):
            break
        a, b = at_rows[pair], at_rows[pair + d]
        close = distances(sig[a], sig[b]) <= limit
        yield a[close], b[close]


@functools.cache
def _masks(bits: int, most: int) -> np.ndarray:
    """All values of 1 to ``most`` ones."""
    x = np.arange(1, 1 << bits, dtype=np.int32)
    return x[np.bitwise_count(x) <= most]


def _value_links(value: np.ndarray, bits: int, most: int, sig: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all whom pairs within ``limit`` connect whose sorted values, of ``bits`` bits, differ in at most ``most``."""
    first, second = (np.concatenate(x) for x in zip((value[:0], value[:0]), *_run_links(value, sig, limit)))
    yield first, second
    # a node: rows of one value that are connected; its head is the first of them
    root = components(len(sig), first, second)
    rows = np.argsort(root, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], root[rows][1:] != root[rows][:-1]]))
    size = np.diff(np.concatenate([begin, [len(rows)]]))
    head = rows[begin]
    reach = np.maximum.reduceat(distances(sig[rows], sig[root[rows]]), begin)
    value = value[head].astype(np.int32)
    words = [np.ascontiguousarray(sig[head, w]) for w in range(WORDS)]
    upto = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << bits))])
    some_have = upto[1:] > upto[:-1]
    label, masks = np.arange(len(head)), _masks(bits, most)
    step = max(1, LOOKUPS // len(masks))
    for i in range(0, len(head), step):
        other = value[i : i + step, None] ^ masks
        hit = np.flatnonzero(some_have[other] & (other > value[i : i + step, None]))
        node, other = hit // len(masks) + i, other.ravel()[hit]
        n = upto[other + 1] - upto[other]
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
            k = n[part]
            a = np.repeat(node[part], k)
            b = np.arange(len(a)) + np.repeat(upto[other[part]] - (np.cumsum(k) - k), k)
            far = np.zeros(len(a), np.int64)
            for j, w in enumerate(words):
                far += np.bitwise_count(w[a] ^ w[b])
                if j & 1:
                    left = np.flatnonzero((far <= limit + reach[a] + reach[b]) & (label[a] != label[b]))
                    a, b, far = a[left], b[left], far[left]
            close = far <= limit
            if close.any():
                yield head[a[close]], head[b[close]]
                some, at = np.unique(np.concatenate([label[a[close]], label[b[close]]]), return_inverse=True)
                to = np.arange(len(label))
                to[some] = some[components(len(some), at[: close.sum()], at[close.sum() :])]
                label = to[label]
            for a_, b_ in zip(a[~close], b[~close]):  # heads too far apart, but perhaps not all members
                if label[a_] == label[b_]:
                    continue
                x, y = (rows[begin[v] : begin[v] + size[v]] for v in (a_, b_))
                if len(x) > len(y):
                    x, y = y, x
                for v in x:
                    hit = y[distances(sig[v], sig[y]) <= limit]
                    if len(hit):
                        yield np.array([v]), hit[:1]
                        label[label == label[b_]] = label[a_]
                        break


def local_links(route: np.ndarray, sig: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) stars that connect the signatures which share a route, whose segments differ in no more bits than its radius allows, and are within ``limit``."""
    order = np.argsort(route, kind="stable")
    key, own = route[order], sig[order]
    first, second = [order[:0]], [order[:0]]
    for a, b in _run_links(key, own, limit, pivots=False):
        first.append(order[a])
        second.append(order[b])
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for i in np.flatnonzero(np.diff(edge) > SHORT_RUN):
        piece = int(key[edge[i]]) >> 16
        segment, _, bits = PIECES[piece]
        rows = order[edge[i] : edge[i + 1]]
        value = _segment(sig[rows], piece)[1]
        by = np.argsort(value, kind="stable")
        rows = rows[by]
        for a, b in _value_links(value[by], SEGMENTS[segment][2] - bits, RADII[segment], sig[rows], limit):
            first.append(rows[a])
            second.append(rows[b])
    root = components(len(sig), np.concatenate(first), np.concatenate(second))
    member = np.flatnonzero(root != np.arange(len(sig)))
    return root[member], member


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) pairs of the distinct signatures (sig): they connect exactly those that pairs within ``max_distance``, MAX_DISTANCE at most, connect."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for a in range(0, batch.num_rows, 4096):
                part = batch.column(0).slice(a, 4096)
                for way in routes(from_binary(part)):
                    yield pa.record_batch({"route": pa.array(way.astype(np.int32)), "sig": part})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(route: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            a, b = local_links(route, sig, max_distance)
            return pa.record_batch({"a": as_binary(sig[a]), "b": as_binary(sig[b])})

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy().astype(np.int64), from_binary(batch.column(1))))
            if sum(len(r) for r, _ in held) >= ROWS and held[0][0][0] != held[-1][0][-1]:
                route, sig = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(route, route[-1]))  # the last group may go on
                yield joined(route[:whole], sig[:whole])
                held = [(route[whole:], sig[whole:])]
        if held:
            yield joined(*(np.concatenate(x) for x in zip(*held)))

    sent = nodes.select("sig").mapInArrow(send, "route int, sig binary")
    return sent.repartition("route").sortWithinPartitions("route").mapInArrow(lambda batches: trimmed(find(batches)), "a binary, b binary").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots, the least node of each component; by large and small stars."""
    spark = edges.sparkSession
    least = lambda df: df.groupBy("a").agg(F.min("b").alias("m"))
    now, uri = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    check = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = check(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both).withColumn("m", F.least("m", "a")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(least(large), "a")
        after, after_uri = written(small.select(F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct(), "edges")
        new = check(after)
        remove(spark, uri)
        now, uri = after, after_uri
        if new == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _decided(docs: DataFrame, id_col: str, text: str, max_distance: int) -> DataFrame:
    """(doc_id, digest of the text, sig, group_id, group_size, kept) of every row."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row"), signature(F.col(text)).alias("sig")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = cut(rows.where("sig IS NOT NULL").groupBy("sig").agg(first.alias("first"), F.count("*").alias("n")))
    roots = connected(links(nodes, max_distance))
    member = nodes.join(roots, nodes.sig == roots.node, "left").select("sig", "first", "n", F.coalesce("root", "sig").alias("root"))
    groups = member.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("group_size"))
    of_sig = member.select("sig", "root").join(groups, "root").select("sig", F.col("best.doc_id").alias("group_id"), F.col("best.row").alias("best"), "group_size")
    alone = F.col("best").isNull()
    return rows.join(of_sig, "sig", "left").select(
        "doc_id", "digest", "sig", F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("row") == F.col("best"))).alias("kept")
    )


def group_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id, group_size, kept) of every row: groups of texts linked by near-duplicate pairs.

    ``group_id`` is the least id of the group; the row with it is kept, and
    only one if it is repeated.  A text without words (null, empty, only
    punctuation) has no signature: it forms a group of its own and is kept.  A
    null id counts as the greatest; a group of nothing but null ids has a null
    group_id and one row kept.  A very long text is signed in pieces, whole.
    An empty table gives an empty result.  Other columns of ``docs`` aren't
    read, whatever their names.
    """
    return _decided(docs, id_col, text, max_distance).select("doc_id", "group_id", "group_size", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near-duplicates of every document: doc_id, group_id, group_size, kept."""
    return group_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays, and all without words.

    Groups are decided on ids, digests and signatures.  A row whose id and
    digest no dropped row has stays where it is; the others, and a few that a
    filter of bounded size can't tell from them, are shuffled once, by id and
    digest, after rows with the same are folded.
    """
    limit_batches(spark)
    key = lambda digest: [F.coalesce("doc_id", F.lit(0)).alias("_sh_id"), F.col("doc_id").isNull().alias("_sh_null"), digest.alias("_sh_digest")]
    names = ["_sh_id", "_sh_null", "_sh_digest"]
    decided = cut(_decided(docs, "doc_id", "text", MAX_DISTANCE).where("sig IS NOT NULL").select(*key(F.col("digest")), "kept"))
    gone = decided.where("NOT kept").select(F.xxhash64(*names).alias("_sh_key"))
    mine = docs.select(*key(F.xxhash64("text")), F.struct(*docs.columns).alias("_sh_row"))
    mine = mine.withColumn("_sh_word", F.coalesce(F.col("_sh_row.text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))).withColumn("_sh_maybe", maybe_among(gone)(F.xxhash64(*names)))
    stay = mine.where("NOT (_sh_word AND _sh_maybe)").select("_sh_row.*")
    once = mine.where("_sh_word AND _sh_maybe").groupBy(*names).agg(F.first("_sh_row").alias("_sh_row"))
    return stay.unionByName(once.join(decided.where("kept").hint("merge"), names, "left_semi").select("_sh_row.*"))
