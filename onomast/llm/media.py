"""Copies of pictures by local descriptors: cropped, turned, resized, brightened or partly overpainted ones are found.

Corners are the local maxima of the Harris response at several scales.  A
corner's descriptor is 128 comparisons of smoothed brightness around it,
turned to the direction of its patch's centroid.  Equal descriptors meet by
grouping, similar ones in four Hamming tables, each keyed by 32 of the bits:
two that differ in at most three bits share a key, and of those that differ in
more most do.  Two pictures are linked if enough of their matching corners
agree on one turn, scale and shift; links make the groups.

This first look needn't find every link.  A descriptor that very many pictures
have isn't expanded into all their pairs: up to SMALL members are compared with
each other, of more each is compared with the LEADERS of least id.  A group of
copies that holds a third of all rows so costs time in proportion to its size.

Then all pictures of different groups are compared, block by block: two
descriptors within MAX_BITS differ in at most one bit of one of six pieces, or
in none of a seventh, so those for which that holds are compared, and no link
that joins two groups is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.llm import files
from onomast.llm.shared import cut, remove, written
from onomast.llm.simhash import connected
from onomast.llm.vec import mix64, raw_bytes, trimmed

#: Each scale halves the picture; corners taken from each 64 x 64 pixels of the first and of the others.
SCALES, CORNERS = 2, (16, 8)
RADIUS, MARGIN = 7, 9
TURNS = 32
TABLES, MAX_BITS = 4, 12
#: Matching corners that must agree, and by how many pixels of the first scale they may be off.
AGREE, OFF = 4, 3.0
SMALL, LEADERS = 8, 4
SHORT_RUN = 32
#: Pixels described at a time.
PIXELS = 1 << 19
#: Corners of a block, descriptors compared and matching corners held at a time.
BLOCK, COMPARED, HELD = 1 << 17, 1 << 15, 1 << 22
#: Counters of matching corners, each for some pairs of pictures: a prime.
CELLS = 4194301
#: Bits of the pieces of a descriptor, three from the start of each word, in which one may differ, and of the piece of what is left of both, which is equal:
#: two descriptors that miss all of these differ in 6 * 2 + 1 bits, more than MAX_BITS.
PIECE = 19
PIECES = 7
#: The order of the tests: those of a piece are as independent as was found by exchanging them, so that fewer descriptors share one.  Any order gives the same matches.
ORDER = [
    80, 1, 85, 106, 4, 83, 113, 109, 84, 9, 43, 51, 12, 7, 14, 27, 2, 11, 6, 88, 20, 21, 25, 23, 16, 118, 99, 15, 28, 29, 13, 8,
    32, 116, 72, 75, 127, 49, 38, 71, 103, 123, 74, 26, 102, 105, 65, 76, 31, 95, 52, 48, 30, 53, 54, 55, 56, 91, 58, 59, 97, 61, 112, 19,
    64, 39, 119, 93, 63, 92, 70, 41, 98, 68, 37, 101, 17, 77, 35, 79, 5, 0, 124, 46, 104, 36, 86, 50, 78, 33, 90, 3, 115, 126, 94, 24,
    62, 111, 34, 10, 100, 87, 120, 40, 82, 89, 125, 96, 114, 57, 45, 122, 107, 60, 18, 73, 67, 117, 44, 66, 42, 108, 121, 22, 47, 81, 110, 69,
]

_rng = np.random.default_rng(128)


def _tests() -> np.ndarray:
    """(TURNS, 128, 2, 2): where the two sides of each comparison are, (y, x) from the corner; quarter turns are exact."""
    base = np.clip(_rng.normal(0, RADIUS / 2, (128, 2, 2)), -RADIUS + 2, RADIUS - 2)[ORDER]
    out = np.zeros((TURNS, 128, 2, 2), np.int64)
    for q in range(TURNS // 4):
        a = 2 * np.pi * q / TURNS
        y, x = base[..., 0], base[..., 1]
        out[q] = np.rint(np.stack([y * np.cos(a) + x * np.sin(a), x * np.cos(a) - y * np.sin(a)], axis=-1))
    for q in range(TURNS // 4, TURNS):
        y, x = out[q - TURNS // 4, ..., 0], out[q - TURNS // 4, ..., 1]
        out[q] = np.stack([x, -y], axis=-1)
    return out


TESTS = _tests()
_grid = np.arange(-RADIUS, RADIUS + 1)
_DY, _DX = (g[(g0 := np.add.outer(_grid**2, _grid**2) <= RADIUS**2)] for g in np.meshgrid(_grid, _grid, indexing="ij"))


def _box(a: np.ndarray) -> np.ndarray:
    """Sums of 3 x 3 pixels; the outermost stay 0."""
    out = np.zeros_like(a)
    rows = a[:, :-2] + a[:, 1:-1] + a[:, 2:]
    out[:, 1:-1, 1:-1] = rows[:, :, :-2] + rows[:, :, 1:-1] + rows[:, :, 2:]
    return out


def corners(images: np.ndarray, height: np.ndarray, width: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, y, x) of the ``many`` strongest corners of each picture in a stack of equal size, as far as it has them."""
    n, h, w = images.shape
    a = images.astype(np.int32)
    dy, dx = np.zeros_like(a), np.zeros_like(a)
    dy[:, 1:-1] = a[:, 2:] - a[:, :-2]
    dx[:, :, 1:-1] = a[:, :, 2:] - a[:, :, :-2]
    yy, xx, yx = (_box(p).astype(np.float64) for p in (dy * dy, dx * dx, dy * dx))
    r = yy * xx - yx * yx - 0.05 * (yy + xx) ** 2
    ys, xs = np.arange(h), np.arange(w)
    inside = ((ys >= MARGIN) & (ys < height[:, None] - MARGIN))[:, :, None] & ((xs >= MARGIN) & (xs < width[:, None] - MARGIN))[:, None, :]
    most = r.copy()
    most[:, 1:-1] = np.maximum(np.maximum(r[:, :-2], r[:, 2:]), r[:, 1:-1])
    m = most.copy()
    most[:, :, 1:-1] = np.maximum(np.maximum(m[:, :, :-2], m[:, :, 2:]), m[:, :, 1:-1])
    image, y, x = np.nonzero(inside & (r >= most) & (r > 1e4))
    order = np.lexsort((x, y, -r[image, y, x], image))
    image, y, x = image[order], y[order], x[order]
    rank = np.arange(len(image)) - np.searchsorted(image, image)
    keep = rank < many[image]
    return image[keep], y[keep], x[keep]


def describe(images: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(128-bit descriptors as two uint64, direction 0 .. TURNS-1) of corners."""
    smooth = _box(images.astype(np.int32))
    patch = smooth[image[:, None], y[:, None] + _DY, x[:, None] + _DX]
    angle = np.arctan2((patch * _DY).sum(axis=1), (patch * _DX).sum(axis=1))
    turn = np.floor(angle / (2 * np.pi) * TURNS + 1e-9).astype(np.int64) % TURNS
    t = TESTS[turn]
    value = smooth[image[:, None, None], y[:, None, None] + t[..., 0], x[:, None, None] + t[..., 1]]
    bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1, bitorder="little")
    return bits.view(np.uint64).reshape(-1, 2), turn


def _halved(images: np.ndarray) -> np.ndarray:
    h, w = images.shape[1] // 2 * 2, images.shape[2] // 2 * 2
    a = images[:, :h, :w].astype(np.uint16)
    return ((a[:, ::2, ::2] + a[:, 1::2, ::2] + a[:, ::2, 1::2] + a[:, 1::2, 1::2]) // 4).astype(np.uint8)


def features(pixels: pa.Array, height: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, packed place, descriptor) of the corners of grey pictures, one byte a pixel.

    A place has y, x (in pixels of the first scale), scale and direction.  A
    row whose bytes aren't height x width has no corners.
    """
    data, offsets = raw_bytes(pixels)
    good = (height > 0) & (width > 0) & (np.diff(offsets) == height.astype(np.int64) * width) & (height < 1 << 15) & (width < 1 << 15)
    rows, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
    box = np.stack([-(-height // 64) * 64, -(-width // 64) * 64], axis=1)
    box[~good] = 0
    for h, w in np.unique(box[good], axis=0) if good.any() else []:
        own = np.flatnonzero((box == (h, w)).all(axis=1))
        step = max(1, PIXELS // int(h * w))
        for a in range(0, len(own), step):
            some = own[a : a + step]
            stack = np.zeros((len(some), h, w), np.uint8)
            for i, row in enumerate(some):
                stack[i, : height[row], : width[row]] = data[offsets[row] : offsets[row + 1]].reshape(height[row], width[row])
            hs, ws = height[some].astype(np.int64), width[some].astype(np.int64)
            many = -(-hs * ws // 4096)
            for scale in range(SCALES):
                if scale:
                    stack, hs, ws = _halved(stack), hs // 2, ws // 2
                image, y, x = corners(stack, hs, ws, many * CORNERS[min(scale, 1)])
                d, turn = describe(stack, image, y, x)
                rows.append(some[image])
                places.append((y << scale) << 40 | (x << scale) << 16 | scale << 8 | turn)
                found.append(d)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(found)


def consensus(a: np.ndarray, b: np.ndarray, enough: int | None = None) -> int:
    """How many of the matches between places ``a`` of a picture and ``b`` of another agree on one turn, scale and shift; each place counts once.  As soon as ``enough`` do, no more are looked for."""
    ya, xa, yb, xb = (v.astype(np.float64) for v in (a >> 40, a >> 16 & 0xFFFFFF, b >> 40, b >> 16 & 0xFFFFFF))
    turn = 2 * np.pi / TURNS * ((b & 255) - (a & 255))
    size = 2.0 ** ((b >> 8 & 255) - (a >> 8 & 255))
    c, s = np.cos(turn) * size, np.sin(turn) * size
    best = 0
    for i in range(len(a)):
        dy, dx = ya - ya[i], xa - xa[i]
        off = np.hypot(yb[i] + c[i] * dy + s[i] * dx - yb, xb[i] + c[i] * dx - s[i] * dy - xb)
        same = np.abs((turn - turn[i] + np.pi) % (2 * np.pi) - np.pi) < 2.5 * 2 * np.pi / TURNS
        fit = (off <= OFF * max(1.0, size[i]) + 0.12 * np.hypot(dy, dx) * size[i]) & same & (size == size[i])
        best = max(best, min(len(np.unique(a[fit] >> 16)), len(np.unique(b[fit] >> 16))))
        if enough is not None and best >= enough:
            break
    return best


def _table_pairs(table: np.ndarray, d: np.ndarray, media: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with one table's key in common whose descriptors differ in at most MAX_BITS."""
    key = (d[np.arange(len(d)), table >> 1] >> (table.astype(np.uint64) % np.uint64(2) * np.uint64(32))) & np.uint64(0xFFFFFFFF)
    key = table.astype(np.uint64) << np.uint64(32) | key
    order = np.lexsort((place, media, key))
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    length = np.diff(edge)

    def close(a, b):
        return (np.bitwise_count(d[a] ^ d[b]).sum(axis=1) <= MAX_BITS) & (media[a] != media[b])

    for i in np.flatnonzero(length > SHORT_RUN):
        left = order[edge[i] : edge[i + 1]]
        while len(left) > 1:
            pivot = np.repeat(left[:1], len(left) - 1)
            near = np.bitwise_count(d[pivot] ^ d[left[1:]]).sum(axis=1) <= MAX_BITS
            hit = left[1:][near & (media[left[1:]] != media[left[0]])]
            yield pivot[: len(hit)], hit
            left = left[1:][~near]
    short = order[np.repeat(length <= SHORT_RUN, length)]
    key = key[np.repeat(length <= SHORT_RUN, length)]
    for step in range(1, min(SHORT_RUN, len(key))):
        at = np.flatnonzero(key[step:] == key[:-step])
        if not len(at):
            return
        a, b = short[at], short[at + step]
        ok = close(a, b)
        yield a[ok], b[ok]


def near_descriptors(heads: DataFrame) -> DataFrame:
    """(a, b, pa, pb): pictures and places of the heads (d0, d1, media, place) of different descriptors that match in one of the tables."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, d0, d1, media, place = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(5))
        d = np.stack([d0, d1], axis=1).view(np.uint64)
        for a, b in _table_pairs(table.astype(np.int64), d, media, place):
            swap = media[a] > media[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.record_batch({"a": pa.array(media[a]), "b": pa.array(media[b]), "pa": pa.array(place[a]), "pb": pa.array(place[b])})

    word = F.when(F.col("table") < 2, F.col("d0")).otherwise(F.col("d1"))
    key = F.shiftrightunsigned(word, 32).bitwiseAND(0xFFFFFFFF)
    part = F.when(F.col("table") % 2 == 1, key).otherwise(word.bitwiseAND(0xFFFFFFFF))
    rows = heads.select(F.explode(F.array(*[F.lit(i) for i in range(TABLES)])).alias("table"), "d0", "d1", "media", "place")
    return rows.repartition(F.xxhash64(part, F.col("table"))).mapInArrow(find, "a bigint, b bigint, pa bigint, pb bigint")


class _Block:
    """Pictures with their corners, and the distinct descriptors of each of their groups."""

    def __init__(self, group: np.ndarray, media: np.ndarray, ends: np.ndarray, place: np.ndarray, d: np.ndarray):
        self.group, self.media, self.ends, self.place, self.d = group, media, ends, place, d
        self.picture = np.repeat(np.arange(len(media)), np.diff(ends))
        own = group[self.picture]
        self.order = np.lexsort((d[:, 1], d[:, 0], own))
        g, x = own[self.order], d[self.order]
        self.begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1]).any(axis=1)])[: len(g)])
        self.count = np.diff(np.concatenate([self.begin, [len(g)]]))
        self.of, self.word = g[self.begin], np.ascontiguousarray(x[self.begin].T)

    def part(self, a: int, b: int) -> _Block:
        s, e = self.ends[a], self.ends[b]
        return _Block(self.group[a:b], self.media[a:b], self.ends[a : b + 1] - s, self.place[s:e], self.d[s:e])

    def by(self, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """Descriptors in order of one piece, and where each of its values begins."""
        value, bits = _piece(self.word, piece)
        return np.argsort(value).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << bits))]).astype(np.int32)


def _piece(word: Sequence[np.ndarray], piece: int) -> tuple[np.ndarray, int]:
    """The value of a piece of each descriptor (or of how two differ), and its bits."""
    left = 64 - 3 * PIECE
    if piece == PIECES - 1:
        return (word[0] >> np.uint64(3 * PIECE) << np.uint64(left) | word[1] >> np.uint64(3 * PIECE)).astype(np.int32), 2 * left
    return (word[piece // 3] >> np.uint64(piece % 3 * PIECE) & np.uint64((1 << PIECE) - 1)).astype(np.int32), PIECE


def _matches(x: _Block, y: _Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of descriptors of different groups that differ in at most MAX_BITS, each once (in one of the orders, within one block)."""
    for piece in range(PIECES):
        (ox, _), (oy, ey) = x.by(piece), y.by(piece)
        wx, wy = x.word[:, ox], y.word[:, oy]
        first = 1 if piece < PIECES // 2 else 0  # the word without the piece, in which most differ too much
        value, bits = _piece(wx, piece)
        for mask in [0] + [1 << k for k in range(bits)] * (piece < PIECES - 1):
            other = value ^ np.int32(mask)
            begin = ey[other]
            n = ey[other + 1] - begin
            if x is y:
                n = n * (value & np.int32(mask) == 0) if mask else ey[other + 1] - np.arange(1, len(value) + 1, dtype=np.int32)
                begin = begin if mask else np.arange(1, len(value) + 1, dtype=np.int32)
            some = np.flatnonzero(n)
            begin, n = begin[some], n[some].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(n)])
            begin = begin - upto[:-1]
            word, row = wx[first, some], some.astype(np.int32)
            edge = np.flatnonzero(np.diff(upto[:-1] // COMPARED, prepend=-1))
            for a, z in zip(edge, [*edge[1:], len(n)]):
                m = np.repeat(begin[a:z], n[a:z])
                m += np.arange(upto[a], upto[z])
                d = wy[first].take(m)
                d ^= np.repeat(word[a:z], n[a:z])
                far = np.bitwise_count(d)
                hit = np.flatnonzero(far <= MAX_BITS)
                k, m = np.repeat(row[a:z], n[a:z])[hit], m[hit]
                rest = wx[1 - first, k] ^ wy[1 - first, m]
                ok = np.flatnonzero(far[hit] + np.bitwise_count(rest) <= MAX_BITS)
                i, j = ox[k[ok]], oy[m[ok]]
                own = np.flatnonzero(x.of[i] != y.of[j])
                if not len(own):
                    continue
                i, j, ok = i[own], j[own], ok[own]
                differ = (rest[ok], d[hit[ok]]) if first else (d[hit[ok]], rest[ok])
                ok = np.ones(len(i), bool)
                for earlier in range(piece):  # found by these already
                    ok &= np.bitwise_count(_piece(differ, earlier)[0]) > 1
                yield i[ok], j[ok]


def _find(label: dict[int, int], x: int) -> int:
    while (to := label.get(x, x)) != x:
        label[x] = label.get(to, to)
        x = to
    return x


def _block_links(x: _Block, y: _Block, label: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Links between pictures of two blocks (or of one) that connect all groups which any two of their pictures connect; ``label`` has what is connected already."""
    one = x is y
    if not len(x.of) or not len(y.of) or len(np.unique(np.concatenate([x.group, y.group]))) < 2:
        return
    left, right, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for i, j in _matches(x, y):
        # all corners that have the two descriptors
        n = x.count[i] * y.count[j]
        held += int(n.sum())
        if held > HELD and max(len(x.media), len(y.media)) > 1:  # smaller blocks, with nothing left out
            if one:
                half = len(x.media) // 2
                first, second = x.part(0, half), x.part(half, len(x.media))
                parts = [(first, first), (first, second), (second, second)]
            elif len(x.media) >= len(y.media):
                parts = [(x.part(0, len(x.media) // 2), y), (x.part(len(x.media) // 2, len(x.media)), y)]
            else:
                parts = [(x, y.part(0, len(y.media) // 2)), (x, y.part(len(y.media) // 2, len(y.media)))]
            for a, b in parts:
                yield from _block_links(a, b, label)
            return
        at = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        p, q = x.order[x.begin[i][at] + k // y.count[j][at]], y.order[y.begin[j][at] + k % y.count[j][at]]
        if one:
            p, q = np.minimum(p, q), np.maximum(p, q)
        left.append(p.astype(np.int32))
        right.append(q.astype(np.int32))
    p, q = np.concatenate(left), np.concatenate(right)
    # enough matches of one size for any to agree
    size = (y.place[q] >> 8 & 255) - (x.place[p] >> 8 & 255) + SCALES
    key = (x.picture[p] * len(y.media) + y.picture[q]) * (2 * SCALES) + size
    cell = key % CELLS
    many = np.flatnonzero((np.bincount(cell, minlength=CELLS) >= AGREE)[cell])  # few pairs of pictures have enough
    order = many[np.argsort(key[many], kind="stable")]
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    for i in np.flatnonzero(np.diff(edge) >= AGREE):
        some = order[edge[i] : edge[i + 1]]
        a, b = x.picture[p[some[0]]], y.picture[q[some[0]]]
        g, h = _find(label, int(x.group[a])), _find(label, int(y.group[b]))
        if g != h and linked(x.place[p[some]], y.place[q[some]]):
            label[max(g, h)] = min(g, h)
            yield int(x.media[a]), int(y.media[b])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether enough matches between places of two pictures agree, seen from either."""
    turn = (b & 255) - (a & 255)
    if (np.abs((turn[:, None] - turn + TURNS // 2) % TURNS - TURNS // 2) < 2.5).sum(axis=1).max() < AGREE:
        return False
    return consensus(a, b, AGREE) >= AGREE or consensus(b, a, AGREE) >= AGREE


def links_between(pictures: DataFrame) -> DataFrame:
    """(a, b): links between pictures (root, media, corners) of different roots, which connect exactly what any two of the pictures connect.

    The pictures are written in order of their roots, in blocks of about BLOCK
    corners, and each task reads two of the blocks and compares all their
    descriptors: nothing is shuffled for it.
    """
    spark = pictures.sparkSession
    n, corners = pictures.agg(F.count("*"), F.sum(F.size("corners"))).first()
    if not n:
        return spark.createDataFrame([], "a bigint, b bigint")
    blocks = -(-corners // BLOCK)
    table, uri = written(pictures.select("root", "media", "corners").repartitionByRange(blocks, "root", "media").sortWithinPartitions("root", "media"), "blocks")
    names = [name for name, _ in files.sizes(uri, (".parquet",))]

    def read(name: str) -> _Block:
        with files.open_read(name) as f:
            t = pq.read_table(f, columns=["root", "media", "corners"]).combine_chunks()
        lists = pa.concat_arrays(t["corners"].chunks) if t.num_rows else pa.array([], t["corners"].type)
        items = lists.flatten()
        place, d0, d1 = (items.field(k).to_numpy() for k in ("place", "d0", "d1"))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        return _Block(t["root"].to_numpy(), t["media"].to_numpy(), ends, place, np.stack([d0, d1], axis=1).view(np.uint64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                j = (math.isqrt(8 * k + 1) - 1) // 2
                y = read(names[j])
                x = y if k - j * (j + 1) // 2 == j else read(names[k - j * (j + 1) // 2])
                found = list(_block_links(x, y, {}))
                yield pa.record_batch({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    pairs = len(names) * (len(names) + 1) // 2
    out = cut(spark.range(0, pairs, 1, min(pairs, 10_000)).mapInArrow(find, "a bigint, b bigint"))
    remove(spark, uri)
    return out


def group_pictures(media: DataFrame, id_col: str = "media_id", pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """(media_id, group_id, group_size, kept) of every row of a table of grey pictures, one byte a pixel.

    Two pictures are linked if AGREE of their corners whose descriptors differ
    in at most MAX_BITS agree (seen from either); groups are what any links
    connect, none is left out.  ``group_id`` is the least id among the copies
    of a picture, whose row is kept (one of them, if that id is repeated).
    Pictures with the same bytes, height and width are one from the start.  A
    picture without corners, a null one, and one whose bytes don't fit its
    size form groups of their own, but for the same bytes; a null picture is
    always alone.  A null id counts as the greatest.  Repeated rows are in one
    group.  An empty table gives an empty result.  Other columns aren't read.
    A large picture is described whole, with corners in proportion to its size.
    """

    @F.arrow_udf("array<struct<place:bigint,d0:bigint,d1:bigint>>")
    def corners_of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for blobs, hs, ws in trimmed(batches):
            h, w = (x.fill_null(0).to_numpy().astype(np.int64) for x in (hs, ws))
            row, place, d = features(blobs, h, w)
            order = np.argsort(row, kind="stable")
            d = d[order].view(np.int64)
            offsets = np.searchsorted(row[order], np.arange(len(h) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(place[order]), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))], names=["place", "d0", "d1"])
            yield pa.ListArray.from_arrays(pa.array(offsets), items)

    blob, h, w = F.col(pixels), F.col(height).cast("int"), F.col(width).cast("int")
    digest = F.when(blob.isNotNull(), F.sha2(F.concat(blob, F.encode(F.format_string(":%s:%s", h, w), "UTF-8")), 256))
    rows, uri = written(media.select(F.col(id_col).cast("bigint").alias("media_id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest"), corners_of(blob, h, w).alias("corners")))
    # a picture's number is the row that stands for all with the same bytes
    first = F.min(F.struct(F.col("media_id").isNull().alias("none"), "media_id", "row"))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"), F.first("corners").alias("corners"))
    classes = cut(classes.select("digest", "first", "n", F.col("first.row").alias("media"), "corners"))
    rows = cut(rows.drop("corners"))
    remove(media.sparkSession, uri)
    each = classes.select("media", F.inline("corners")).select("media", "place", "d0", "d1")
    # equal descriptors: ranks within each; up to SMALL all pairs, beyond with the leaders
    of = Window.partitionBy("d0", "d1").orderBy("media", "place")
    leaders = each.withColumn("r", F.row_number().over(of)).where(f"r <= {SMALL}")
    sizes_ = each.groupBy("d0", "d1").agg(F.count("*").alias("size"))
    heads, uri = written(leaders.join(sizes_, ["d0", "d1"]))
    small = heads.where(f"size > 1 AND (size <= {SMALL} OR r <= {LEADERS})").select("d0", "d1", F.col("media").alias("a"), F.col("place").alias("pa"))
    same = each.join(small, ["d0", "d1"]).where("a < media").select("a", F.col("media").alias("b"), "pa", F.col("place").alias("pb"))
    near = near_descriptors(heads.where("r = 1").select("d0", "d1", "media", "place"))

    @F.arrow_udf("int")
    def agree(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            ends = lists.offsets.to_numpy()
            a, b = (lists.values.field(i).to_numpy() for i in (0, 1))
            yield pa.array([consensus(a[s:e], b[s:e], AGREE) for s, e in zip(ends, ends[1:])], pa.int32())

    votes = same.unionByName(near).groupBy("a", "b").agg(F.collect_set(F.struct("pa", "pb")).alias("places")).where(F.size("places") >= AGREE)
    links = cut(votes.where(agree(F.col("places")) >= AGREE).select("a", "b"))
    remove(media.sparkSession, uri)
    roots = connected(links)
    # these connect most; what they leave apart is compared corner by corner
    of_root = lambda roots: classes.join(roots, F.col("media") == F.col("node"), "left").withColumn("root", F.coalesce("root", "media"))
    found = links_between(of_root(roots).where(F.size("corners") >= AGREE))
    if not found.isEmpty():
        roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    member = of_root(roots).select("digest", "first", "n", "media", "root")
    groups = member.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("group_size"))
    of_class = member.join(groups, "root").select("digest", F.col("best.media_id").alias("group_id"), F.col("best.row").alias("best"), "group_size")
    alone = F.col("best").isNull()
    return rows.join(of_class, "digest", "left").select(
        "media_id", F.when(alone, F.col("media_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("best"))).alias("kept"),
    )


# Pictures for the tables, which have none

SIDE = 64
EDITS = ("none", "crop", "brighter", "turned", "noise", "overpainted", "halved")


def drawn(seed: np.ndarray) -> np.ndarray:
    """(n, SIDE, SIDE) pictures: mosaics of 4 x 4 and 8 x 8 pixels, as unlike as their seeds."""
    cells = np.arange(256, dtype=np.uint64)
    fine = (mix64(mix64(seed.astype(np.uint64))[:, None] + cells) >> np.uint64(56)).reshape(-1, 16, 16)
    coarse = fine[:, ::2, ::2]
    return ((fine.repeat(4, axis=1).repeat(4, axis=2) * np.uint64(3) + coarse.repeat(8, axis=1).repeat(8, axis=2)) // np.uint64(4)).astype(np.uint8)


def subject(page: np.ndarray) -> np.ndarray:
    """Which picture a page shows: a third of all the same one, others one for each four neighbours."""
    return np.where(mix64(page.astype(np.uint64)) % np.uint64(3) == 0, -1, page // 4)


def edited(image: np.ndarray, page: int) -> np.ndarray:
    """A picture as the page shows it: edited in one of the ways of EDITS."""
    h = int(mix64(np.array([page], np.int64).astype(np.uint64) ^ np.uint64(0xABCDEF))[0])
    kind, a, b = EDITS[h % len(EDITS)], h >> 8 & 255, h >> 16 & 255
    if kind == "crop":
        top, left = a % 13, b % 13
        return image[top : top + SIDE - 12, left : left + SIDE - 12]
    if kind == "brighter":
        return np.minimum(255, image.astype(np.int32) * (100 + a % 20) // 100 + b % 16).astype(np.uint8)
    if kind == "turned":
        return np.rot90(image, 1 + a % 3)
    if kind == "noise":
        noise = (mix64(np.arange(SIDE * SIDE, dtype=np.uint64) + np.uint64(h)) % np.uint64(9)).astype(np.int32).reshape(SIDE, SIDE) - 4
        return np.clip(image + noise, 0, 255).astype(np.uint8)
    if kind == "overpainted":
        out = image.copy()
        out[a % 40 : a % 40 + 20, b % 40 : b % 40 + 20] = 128
        return out
    return _halved(image[None])[0] if kind == "halved" else image


def pictures(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(media_id, height, width, pixels): a picture for every page; a null id has a null picture."""

    @F.arrow_udf("struct<height:int,width:int,pixels:binary>")
    def draw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in trimmed(batches):
            null = np.asarray(ids.is_null())
            page = ids.fill_null(0).to_numpy()
            made = []
            for s in range(0, len(page), 256):
                made += [edited(image, int(p)) for image, p in zip(drawn(subject(page[s : s + 256])), page[s : s + 256])]
            yield pa.StructArray.from_arrays([pa.array([x.shape[0] for x in made], pa.int32()), pa.array([x.shape[1] for x in made], pa.int32()), pa.array([None if n else x.tobytes() for x, n in zip(made, null)], pa.binary())], names=["height", "width", "pixels"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("media_id"), draw(F.col(id_col).cast("bigint")).alias("p"))
    return rows.select("media_id", "p.height", "p.width", "p.pixels")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies among the pictures drawn for all pages: media_id, group_id, group_size, kept."""
    return group_pictures(pictures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
