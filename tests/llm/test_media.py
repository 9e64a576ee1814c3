import struct
import zlib

import numpy as np
import pytest

from mnemospark.llm import media


def png(grey):
    h, w = grey.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows, last = b"", np.zeros(w, np.int64)
    for y, line in enumerate(grey.astype(np.int64)):
        kind = y % 5
        left = np.concatenate(([0], line[:-1]))
        corner = np.concatenate(([0], last[:-1]))
        p = left + last - corner
        pa_, pb, pc = abs(p - left), abs(p - last), abs(p - corner)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, last, corner))
        guess = [0, left, last, (left + last) // 2, paeth][kind]
        rows += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        last = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def blocky(seed, side=96):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(20, 235, (side // 8, side // 8)), np.ones((8, 8)))


def smooth(seed, side=96):
    x = media.blurred(np.random.default_rng(seed).normal(0, 1, (side, side)).astype(np.float32), 3.0)
    return 20 + 215 * (x - x.min()) / (x.max() - x.min())


def turned(g, degrees):
    h, w = g.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w] - np.asarray([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    ty, tx = y * np.cos(a) + x * np.sin(a) + (h - 1) / 2, x * np.cos(a) - y * np.sin(a) + (w - 1) / 2
    return media.values_at(g[None], np.zeros(y.shape, np.int64), np.clip(ty, 0, h - 1), np.clip(tx, 0, w - 1))


def edited(g, seed):
    h, w = g.shape
    k = h * 5 // 8
    return {
        "turned 90": np.rot90(g),
        "turned 30": turned(g, 30),
        "part scaled 1.5": media.resized(g[h // 6 : h // 6 + h * 2 // 3, w // 6 : w // 6 + w * 2 // 3], h, w),
        "crop to 5/8": g[h // 8 : h // 8 + k, w // 4 : w // 4 + k],
        "blur": media.blurred(g.astype(np.float32), 1.5),
        "halved": g.reshape(h // 2, 2, w // 2, 2).mean((1, 3)),
        "noise": g + np.random.default_rng(seed).normal(0, 8, g.shape),
        "gamma": 255 * (g / 255) ** 1.5,
    }


def rounded(g):
    return np.ascontiguousarray(np.clip(np.rint(g), 0, 255)).astype(np.float32)


def corners(g):
    return media.describe(rounded(g)[None])[1]


def test_readers():
    g = blocky(1, 40)
    assert (media.read_image(png(g)) == g).all() and (media.read_image(media.write_pgm(g)) == g).all()
    for bad in (None, b"", b"P5", b"P5\n4 4\n255\nab", b"\x89PNG\r\n\x1a\nxx", png(g)[:60], b"GIF89a"):
        assert media.read_image(bad) is None


def test_descriptors_turn_with_the_image():
    a, b = corners(smooth(2)), corners(np.rot90(smooth(2)))
    near = 0
    for r in a:
        at = np.flatnonzero((np.abs(b["x"] - r["y"]) < 0.2) & (np.abs(b["y"] - (95 - r["x"])) < 0.2) & (b["level"] == r["level"]))
        near += any(np.bitwise_count(b["d"][k] ^ r["d"]).sum() <= 4 for k in at)
    assert near >= 0.9 * len(a)


def test_many_images_are_described_like_one():
    made = [rounded(smooth(k)) for k in range(5)] + [np.zeros((96, 96), np.float32)]
    i, r = media.describe(np.stack(made))
    for k, g in enumerate(made):
        assert r[i == k].tobytes() == corners(g).tobytes()
    assert not len(corners(made[-1])) and not len(media.describe(np.zeros((2, 3, 1), np.float32))[1])


def test_a_large_image_is_described_in_bounded_memory():
    small = smooth(4, 640)
    large = np.kron(small, np.ones((4, 4)))  # 6.5 million pixels
    assert media.same_picture(corners(large), corners(small)) and not media.same_picture(corners(large), corners(smooth(5, 640)))


def by_hand(a, b):
    """agreement() with loops over corners, for every change that a pair of corners proposes."""
    pairs = []
    differ = [[int(np.bitwise_count(p["d"] ^ q["d"]).sum()) for q in b] for p in a]
    for i, line in enumerate(differ):
        j = line.index(min(line))
        if line[j] <= media.RADIUS and [x[j] for x in differ].index(min(x[j] for x in differ)) == i:
            pairs.append((a[i], b[j]))
    most = 0
    for p, q in pairs:
        size, turn = p["size"] / q["size"], p["angle"] - q["angle"]
        places, n = set(), 0
        for u, v in pairs:
            move = size * np.exp(1j * turn) * (complex(v["x"], v["y"]) - complex(q["x"], q["y"]))
            off = abs(complex(p["x"], p["y"]) + move - complex(u["x"], u["y"]))
            if off <= 3 * max(1, size) + 0.12 * abs(move) and abs(np.log(u["size"] / v["size"] / size)) < 0.35 and np.cos(u["angle"] - v["angle"] - turn) > 0.9:
                places.add((int(u["x"] / 6), int(u["y"] / 6)))
                n += 1
        most = max(most, len(places))
    return most


@pytest.mark.parametrize("kind", [blocky, smooth])
def test_agreement_is_that_of_all_corners_by_hand(kind):
    g = kind(11, 64)
    for x in [*edited(g, 0).values(), kind(12, 64)]:
        want, got = by_hand(corners(g), corners(x)), media.agreement(corners(g), corners(x))
        assert got <= want and (got >= media.CONSENSUS) == (want >= media.CONSENSUS), (got, want)


@pytest.mark.parametrize("kind", [blocky, smooth])
def test_recall_of_each_edit(spark, kind):
    rows, n = [], 20
    for s in range(n):
        g = kind(300 + s)
        rows += [(100 * s, media.write_pgm(g))] + [(100 * s + 1 + k, media.write_pgm(x)) for k, x in enumerate(edited(g, s).values())]
    df = spark.createDataFrame(rows, "image_id long, image binary").repartition(4)
    got = {r.image_id: r.class_id for r in media.copies(df).collect()}
    for k, name in enumerate(edited(kind(0), 0)):
        assert sum(got[100 * s] == got[100 * s + 1 + k] for s in range(n)) >= 0.9 * n, name
    assert all(c // 100 == i // 100 for i, c in got.items())


def test_classes_are_those_of_comparing_all_pairs(spark):
    rng = np.random.default_rng(3)
    made = [g + rng.normal(0, 2, g.shape) for g in (smooth(k % 6, 64) for k in range(24))] + [smooth(100 + k, 64) for k in range(20)]
    # a picture made of two halves links the classes of both
    made.append(np.concatenate((smooth(0, 64)[:, :40], smooth(1, 64)[:, 24:]), 1))
    made = [rounded(g) for g in made]
    found = [corners(g) for g in made]
    root = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if media.same_picture(found[j], found[i]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    df = spark.createDataFrame([(i, media.write_pgm(g)) for i, g in enumerate(made)], "image_id long, image binary").repartition(5)
    got = {r.image_id: r.class_id for r in media.copies(df).collect()}
    assert [got[i] for i in range(len(made))] == root
    assert len(set(root)) < 28


def steps(p, q):
    turn = [int(np.rint(r["angle"] / (2 * np.pi) * 64)) % 64 for r in (p, q)]
    return (turn[0] - turn[1]) % 64, int(p["level"]) - int(q["level"])


def test_candidates_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    found = [corners(g + rng.normal(0, 3, g.shape)) for g in (blocky(k % 8, 64) for k in range(24))]
    cells = []
    for r in found:
        mine = {}
        for c in np.flatnonzero(~r["plain"]).tolist():
            words = [int(r["d"][c, k // 2]) >> 32 * (k % 2) & 0xFFFFFFFF for k in range(4)]
            for i in range(4):
                for j in range(i):
                    mine.setdefault((i, j, words[i], words[j]), []).append(c)
        cells.append(mine)
    want = set()
    for i in range(24):
        for j in range(i):
            hits = set()
            for x in cells[i].keys() & cells[j].keys():
                hits |= {(c, *steps(found[j][c], found[i][e])) for c in cells[j][x] for e in cells[i][x]}
            near = lambda g, h: abs(g[2] - h[2]) <= 1 and min((g[1] - h[1]) % 64, (h[1] - g[1]) % 64) <= 6
            if any(len({h[0] for h in hits if near(g, h)}) >= media.MANY for g in hits):
                want.add((j, i))
    df = spark.createDataFrame([(k, bytearray(r.tobytes()), k) for k, r in enumerate(found)], "row long, corners binary, root long")
    placed = media.table_entries(df).join(df.select("row", "root"), "row")
    got = {(r.a, r.b) for r in media.candidates(media.meetings(placed, placed, True)).collect()}
    assert got == want and len(want) >= 20


def test_copies_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        g = blocky(100 + k)
        rows += [(10 * k, media.write_pgm(g)), (10 * k + 1, media.write_pgm(g * 0.8 + 20)), (10 * k + 2, media.write_pgm(g[16:88, 8:96])), (10 * k + 3, png(g)), (10 * k + 4, media.write_pgm(g + rng.normal(0, 1.0, g.shape))), (10 * k + 5, media.write_pgm(g))]
    rows += [(900, None), (901, None), (902, b"junk"), (903, b"junk"), (None, media.write_pgm(blocky(100))), (904, media.write_pgm(np.zeros((50, 50))))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "image_id long, image binary, key int, row string").repartition(3)
    got = {r.image_id: r for r in media.copies(df).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert {got[10 * k + j].class_id for j in range(6)} == {10 * k}, k
    assert got[None].class_id == 0 and got[0].n_images == 7 and got[10].n_images == 6
    assert [got[i].class_id for i in (900, 901, 902, 903, 904)] == [900, 901, 902, 902, 904]


def test_one_large_group_makes_pairs_in_proportion(spark, monkeypatch):
    g = blocky(7)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, media.write_pgm(g + rng.normal(0, 0.7, g.shape))) for i in range(150)], "image_id long, image binary")
    compared = []
    real = media.confirmed
    monkeypatch.setattr(media, "confirmed", lambda pairs, corners: compared.append(pairs.count()) or real(pairs, corners))
    assert {(r.class_id, r.n_images) for r in media.copies(df).collect()} == {(0, 150)}
    assert sum(compared) < 150 * 40


def test_empty_table_and_rendering(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert media.copies(media.rendered(empty, "vec_id", "embedding")).count() == 0
    df = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [0.1] * 5)], "vec_id long, embedding array<float>")
    assert [r.image is None for r in media.rendered(df, "vec_id", "embedding").orderBy("image_id").collect()] == [False, True, True]
