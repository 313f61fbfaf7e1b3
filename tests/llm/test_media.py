import numpy as np
import pyarrow as pa
from onomast.llm import media
from pyspark.sql import functions as F


def made(pages):
    images = media.drawn(media.subject(pages))
    return [media.edited(x, int(p)) for x, p in zip(images, pages)]


def features(images):
    row, place, d = media.features(pa.array([x.tobytes() for x in images]), np.array([x.shape[0] for x in images]), np.array([x.shape[1] for x in images]))
    return [(place[row == i], d[row == i]) for i in range(len(images))]


def linked(a, b):
    near = np.bitwise_count(a[1][:, None] ^ b[1][None]).sum(axis=2) <= media.MAX_BITS
    i, j = np.nonzero(near)
    return len(i) > 0 and media.consensus(a[0][i], b[0][j]) >= media.AGREE


def groups(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def test_every_edit_is_recognised():
    image = media.drawn(np.array([11]))[0]
    wide = media.drawn(np.array([12, 13]))
    edits = [np.rot90(image, k) for k in range(4)] + [image[7:60, 3:59], np.clip(image * 1.1 + 5, 0, 255).astype(np.uint8), media._halved(image[None])[0]]
    found = features([image, *edits, wide[0], wide[1]])
    assert all(linked(found[0], x) for x in found[1:-2])
    assert not any(linked(found[0], x) for x in found[-2:])


def test_groups_against_all_pairs(spark):
    """The groups are those of brute force over all pairs of pictures, but for a few links that no table shows."""
    pages = np.arange(160)
    found = features(made(pages))
    brute = groups(160, [(i, j) for i in range(160) for j in range(i + 1, 160) if linked(found[i], found[j])])
    rows = {r.media_id: r for r in media.group_pictures(media.pictures(spark.createDataFrame([(int(p),) for p in pages], "page_id bigint").repartition(3))).collect()}
    mine = [rows[p].group_id for p in pages]
    together = [(i, j) for i in pages for j in range(i + 1, 160) if brute[i] == brute[j]]
    assert sum(mine[i] == mine[j] for i, j in together) >= 0.97 * len(together)
    assert all(brute[i] == brute[j] for i in pages for j in range(i + 1, 160) if mine[i] == mine[j])
    truth = media.subject(pages)
    assert all(truth[i] == truth[j] for i in pages for j in range(i + 1, 160) if mine[i] == mine[j])
    for g in set(mine):
        own = [r for r in rows.values() if r.group_id == g]
        assert {r.group_size for r in own} == {len(own)} and [r.media_id for r in own if r.kept] == [g]


def either(a, b):
    return linked(a, b) or linked(b, a)


def test_no_link_between_groups_is_left_out(spark):
    """The groups are exactly those of brute force: noisy and repainted copies, of which a few meet in no table, under labels that all share."""
    rng = np.random.default_rng(5)
    images = []
    for image, label in zip(media.drawn(np.arange(40, 52)), np.arange(12)):
        for k in range(8):
            x = np.clip(image.astype(np.int32) + rng.integers(-24 - k, 25 + k, image.shape), 0, 255).astype(np.uint8)
            if k % 2:
                x[rng.integers(0, 24) :][:30, rng.integers(0, 24) :][:, :30] = 90
            images.append(np.rot90(x, k) if label % 3 == 0 else x)
    stamp = media.drawn(np.array([77]))[0][:24, :24]
    for x in images[:40]:
        x[:24, :24] = stamp
    found = features(images)
    n = len(images)
    brute = groups(n, [(i, j) for i in range(n) for j in range(i + 1, n) if either(found[i], found[j])])
    rows = [(i, x.shape[0], x.shape[1], x.tobytes()) for i, x in enumerate(images)]
    df = spark.createDataFrame(rows, "media_id bigint, height int, width int, pixels binary")
    got = {r.media_id: r.group_id for r in media.group_pictures(df.repartition(3)).collect()}
    assert [got[i] for i in range(n)] == brute and 1 < len(set(brute)) < n


def test_blocks_against_all_pairs(monkeypatch):
    """Links between blocks connect what all pairs connect, also if the matches don't fit and the blocks are halved; a group's own pictures aren't compared."""
    found = features(made(np.arange(60)))
    order = [i for i in range(60) if len(found[i][0])]
    brute = groups(60, [(i, j) for i in order for j in order if i < j and either(found[i], found[j])])

    def block(some):
        ends = np.concatenate([[0], np.cumsum([len(found[i][0]) for i in some])]).astype(np.int64)
        return media._Block(np.array(some), np.array(some), ends, np.concatenate([found[i][0] for i in some]), np.concatenate([found[i][1] for i in some]))

    for held, compared in ((1 << 22, 1 << 17), (200, 64)):
        monkeypatch.setattr(media, "HELD", held)
        monkeypatch.setattr(media, "COMPARED", compared)
        x, y = block(order[::2]), block(order[1::2])
        pairs = [p for a, b in ((x, x), (x, y), (y, y)) for p in media._block_links(a, b, {})]
        assert groups(60, pairs) == brute
    same = media._Block(np.zeros(len(x.media), np.int64), x.media, x.ends, x.place, x.d)
    assert not list(media._block_links(same, same, {}))


def test_matches_of_blocks_without_comparing_most(monkeypatch):
    """Exactly the pairs of descriptors within MAX_BITS, each once, among others of which few are looked at: sharing one of 13 short pieces let through seven times as many."""
    rng = np.random.default_rng(9)

    def block(first, n):
        d = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 2), dtype=np.uint64)
        d[: len(near)] = near
        for k in range(len(near)):
            for bit in rng.choice(128, k % 16, replace=False):
                d[k, bit // 64] ^= np.uint64(1 << int(bit) % 64)
        return media._Block(np.arange(first, first + n), np.arange(first, first + n), np.arange(n + 1), np.zeros(n, np.int64), d)

    near = rng.integers(0, 1 << 63, (900, 2), dtype=np.uint64)
    near[450:] = near[:450]
    x, y = block(0, 3000), block(5000, 3000)

    def brute(a, b):
        i, j = np.nonzero(sum(np.bitwise_count(a.word[w][:, None] ^ b.word[w]).astype(int) for w in (0, 1)) <= media.MAX_BITS)
        some = (a.of[i] != b.of[j]) & ((i < j) | (a is not b))
        return sorted(zip(i[some].tolist(), j[some].tolist()))

    looked, count = [0], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda v: looked.__setitem__(0, looked[0] + np.size(v)) or count(v))
    across, within = ([(int(i), int(j)) for part in media._matches(a, b) for i, j in zip(*part)] for a, b in ((x, y), (x, x)))
    assert looked[0] < 2 * 3000 * 3000 * 13 / 1024 / 2
    monkeypatch.undo()
    assert sorted(across) == brute(x, y) and len(across) > 500
    assert sorted((min(p), max(p)) for p in within) == brute(x, x)


def test_edge_cases(spark):
    a, b = made(np.array([8, 9000]))
    flat = bytes(4096)
    rows = [(1, 64, 64, bytes(media.drawn(np.array([3]))[0]), "x"), (None, 64, 64, bytes(media.drawn(np.array([3]))[0]), "x"), (2, 64, 64, flat, None), (3, 64, 64, flat, None), (4, 64, 64, None, "y"), (4, 64, 64, None, "y")]
    rows += [(5, 64, 64, b"short", "z"), (6, None, 3, b"", "z"), (7, 0, 0, b"", "z"), (8, 3, 2, b"abcdef", "z"), (1, 64, 64, bytes(media.drawn(np.array([3]))[0]), "again")]
    df = spark.createDataFrame(rows, "media_id bigint, height int, width int, pixels binary, digest string").withColumn("row", F.lit("clash"))
    got = sorted(map(str, (tuple(r)[:3] + (r.kept,) for r in media.group_pictures(df).collect())))
    want = [(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True)]
    assert got == sorted(map(str, want))
    assert media.group_pictures(df.limit(0)).count() == 0
    large = np.kron(media.drawn(np.array([5]))[0], np.ones((4, 4), np.uint8))
    assert len(features([large])[0][0]) > 100
