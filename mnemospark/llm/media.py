"""Cropped and edited copies of images by local descriptors.

An image is looked at on levels, each RATIO times smaller than the one before; images with
a side under SMALL are first doubled. On each level the strongest corners of each tile
(Harris response, the highest in their surroundings, placed between pixels by a parabola)
get an orientation, the direction to the centre of brightness around them, and BITS binary
tests: comparisons of smoothed values at the points of a pattern that is turned by exactly
that angle and read between pixels. The tests are drawn from all pairs of points so that no
two of them agree too often on noise. As corners are kept by tile, those of a crop are
among those of the whole.

Two corners meet in a Hamming table if two of their four 32-bit blocks are equal; only
corners whose patch is not nearly a quadratic surface stand in the table, since simple
edges look alike everywhere. Two images with such meetings at MANY corners that agree on a
turn and a change of scale are candidates. Then all corners of the two are
compared: mutual nearest descriptors each propose a change of scale, turn and place, and
the pair is confirmed if one change is agreed on by corners at CONSENSUS places and by
SHARE of the corners of the image that has fewer.

Links are joined to classes, with the result of comparing all candidates: pairs within a
class need no comparison, so rounds compare each cell's images with one pivot until few
pairs of images in different classes are left, which are then all compared. No cell emits
the pairs of a large group of copies, and joins by cell can be split.

Images with equal bytes (by SHA-256) are one class at once. Images of more than PIXELS
pixels are described after averaging squares of pixels, so that memory is bounded.

Defined results: null or unreadable images, and those with too few corners, are classes
of their own unless their bytes are equal; repeated rows each get a row; null ids keep
their row and never name a class (a class of null ids alone has null); extra columns are
not read. PGM (P5) and 8-bit grey, RGB or RGBA PNG files without interlacing are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.arrow import arrow_map
from mnemospark.operators.components import connected_components
from mnemospark.plans.lineage import cut, forget

RATIO = 2 ** (1 / 3)
#: Images with a shorter side are doubled; images with more pixels are averaged down.
SMALL, PIXELS = 160, 1 << 22
#: Corners kept in each tile of so many pixels a side, on each level.
CORNERS, TILE = 10, 32
BITS = 128
#: Radius of a patch and, with what reading between pixels takes, distance of corners from the border.
PATCH, MARGIN = 14.5, 16
#: Share of a patch's variance that a quadratic surface leaves, below which a corner is too plain for the table.
PLAIN = 0.2
#: Corners that meet in the table, agreeing on a turn and a change of scale, and so make two images candidates.
MANY = 3
#: Differing bits of descriptors that still count as the same corner.
RADIUS = 32
CONSENSUS, SHARE = 6, 0.08
#: Steps of a full turn in the table.
TURNS = 64
#: Pairs are all compared once there are so few for each meeting place, or after so many rounds.
FEW, ROUNDS = 2, 6
#: Digests that a task remembers to describe equal images once.
REMEMBERED = 100_000

CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("size", "<f4"), ("angle", "<f4"), ("level", "i1"), ("plain", "?"), ("d", "<u8", (2,))])


def read_image(data: bytes | None) -> np.ndarray | None:
    """Grey values of an image file, or None if it can't be read."""
    try:
        if data and data[:2] == b"P5":
            head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data)
            if not head:
                return None
            w, h = int(head[1]), int(head[2])
            return np.frombuffer(data, np.uint8, w * h, head.end()).reshape(h, w).astype(np.float32)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _read_png(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        return None
    return None


def _read_png(data: bytes) -> np.ndarray | None:
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        return None
    w, h, depth = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * depth)
    out = np.zeros((h, w, depth), np.uint8)
    above = np.zeros((w, depth), np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].reshape(w, depth).astype(np.int32)
        if kind in (0, 2):
            line = line + above * (kind == 2) & 255
        elif kind == 1:
            line = np.cumsum(line, 0) & 255
        else:
            left, corner = np.zeros(depth, np.int32), np.zeros(depth, np.int32)
            for x in range(w):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x] = left = line[x] + guess & 255
                corner = up
        out[y] = above = line
    return out.astype(np.float32) @ np.asarray({1: [1], 3: [0.299, 0.587, 0.114], 4: [0.299, 0.587, 0.114, 0]}[depth], np.float32)


def _windows(x: np.ndarray, r: int, axis: int, **pad: object) -> list[np.ndarray]:
    """``x`` moved by -r to r along an axis of the last two."""
    sides = [(0, 0)] * x.ndim
    sides[axis] = (r, r)
    p, n = np.pad(x, sides, **pad), x.shape[axis]
    return [p[..., k : k + n, :] if axis == -2 else p[..., k : k + n] for k in range(2 * r + 1)]


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means of the last two axes, edges repeated."""
    r = max(1, int(3 * sigma + 0.5))
    weights = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    weights = (weights / weights.sum()).astype(np.float32)
    for axis in (-2, -1):
        moved = _windows(x, r, axis, mode="edge")
        out = moved[r] * weights[r]
        for k in range(r):
            out += (moved[k] + moved[2 * r - k]) * weights[k]
        x = out
    return x


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """The last two axes at another size, linear between pixels."""
    for axis, n in ((-2, h), (-1, w)):
        size = x.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.minimum(at.astype(np.int64), size - 2)
        part = (at - low).astype(np.float32).reshape([n if a == axis % x.ndim else 1 for a in range(x.ndim)])
        x = np.take(x, low, axis) * (1 - part) + np.take(x, low + 1, axis) * part
    return x


def values_at(images: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of images (n, h, w) at places between pixels."""
    h, w = images.shape[-2:]
    y0, x0 = np.clip(y.astype(np.int64), 0, h - 2), np.clip(x.astype(np.int64), 0, w - 2)
    fy, fx = (y - y0).astype(np.float32), (x - x0).astype(np.float32)
    flat, at = images.reshape(-1), (i * h + y0) * w + x0
    return (flat[at] * (1 - fx) + flat[at + 1] * fx) * (1 - fy) + (flat[at + w] * (1 - fx) + flat[at + w + 1] * fx) * fy


def _points() -> np.ndarray:
    """The pattern's points (y, x): the centre and three rings."""
    rings = ((PATCH / 3, 7, 0.0), (PATCH * 2 / 3, 11, 0.3), (PATCH, 15, 0.1))
    return np.asarray([(0.0, 0.0)] + [(r * np.sin(2 * np.pi * (k + o) / n), r * np.cos(2 * np.pi * (k + o) / n)) for r, n, o in rings for k in range(n)])


POINTS = _points()


@functools.lru_cache(1)
def tests() -> tuple[np.ndarray, np.ndarray]:
    """The two points of each test: pairs far apart, of which no two agree on noise much more than by chance."""
    rng = np.random.default_rng(20240101)
    i, j = np.triu_indices(len(POINTS), 1)
    far = np.hypot(*(POINTS[i] - POINTS[j]).T) >= PATCH * 0.62
    i, j = i[far], j[far]
    noise = blurred(rng.normal(0, 1, (1500, 48, 48)).astype(np.float32), 4.0)
    v = values_at(noise, np.arange(len(noise))[:, None], 24 + POINTS[None, :, 0].repeat(len(noise), 0), 24 + POINTS[None, :, 1].repeat(len(noise), 0))
    signs = np.where(v[:, i] < v[:, j], np.float32(1), np.float32(-1))
    order = rng.permutation(len(i))
    alike = np.abs(signs.T @ signs) / len(noise)
    most = 0.2
    while True:
        kept: list[int] = []
        for k in order.tolist():
            if not kept or alike[k, kept].max() < most:
                kept.append(k)
        if len(kept) >= BITS:
            return i[kept[:BITS]], j[kept[:BITS]]
        most += 0.05


_yy, _xx = (z.ravel() for z in np.mgrid[-13:14:2, -13:14:2])
_WEIGHT = np.where(_yy**2 + _xx**2 <= 169, np.exp(-(_yy**2 + _xx**2) / 162), 0).astype(np.float32)
_SURFACE = np.stack([np.ones(len(POINTS)), *POINTS.T, POINTS[:, 0] ** 2, POINTS[:, 1] ** 2, POINTS[:, 0] * POINTS[:, 1]], 1)
#: What is left of a patch's values beside the nearest quadratic surface.
_REST = (np.eye(len(POINTS)) - _SURFACE @ np.linalg.pinv(_SURFACE)).astype(np.float32)


def _corners_of_level(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the strongest corners of each tile, places between pixels."""
    n, h, w = images.shape
    smooth = blurred(images, 1.0)
    gy, gx = np.gradient(smooth, axis=1), np.gradient(smooth, axis=2)
    a, b, c = blurred(gx * gx, 2.0), blurred(gy * gy, 2.0), blurred(gx * gy, 2.0)
    s = a * b - c * c - 0.05 * (a + b) ** 2
    high = s
    for axis in (-2, -1):
        high = functools.reduce(np.maximum, _windows(high, 3, axis, constant_values=-np.inf))
    ok = np.zeros(s.shape, bool)
    ok[:, MARGIN : h - MARGIN, MARGIN : w - MARGIN] = True
    i, y, x = np.nonzero(ok & (s >= high) & (s > 1.0))
    tile = (i * (h // TILE + 1) + y // TILE) * (w // TILE + 1) + x // TILE
    order = np.lexsort((x, y, -s[i, y, x], tile))
    tile = tile[order]
    order = order[np.arange(len(tile)) - np.searchsorted(tile, tile) < CORNERS]
    i, y, x = i[order], y[order], x[order]

    def peak(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        bend = low + high - 2 * s[i, y, x]
        return np.clip(np.divide(low - high, 2 * bend, out=np.zeros_like(bend), where=bend != 0), -0.5, 0.5)

    return i, y + peak(s[i, y - 1, x], s[i, y + 1, x]), x + peak(s[i, y, x - 1], s[i, y, x + 1])


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The described corners of images of one size (n, height, width): the images' numbers, in order, and CORNER records."""
    n, height, width = images.shape
    shrink = int(np.ceil(np.sqrt(height * width / PIXELS)))
    cur = images.astype(np.float32)
    if shrink > 1:
        cur = cur[:, : height // shrink * shrink, : width // shrink * shrink].reshape(n, height // shrink, shrink, width // shrink, shrink).mean((2, 4))
    h0, w0 = cur.shape[-2:]
    if min(h0, w0) < SMALL and min(h0, w0) > 1:
        h0, w0 = 2 * h0, 2 * w0
        cur = resized(cur, h0, w0)
    out_i, out, level = [np.empty(0, np.int64)], [np.empty(0, CORNER)], 0
    one, two = tests()
    while True:
        h, w = cur.shape[-2:]
        if min(h, w) < 2 * MARGIN + 3:
            break
        i, y, x = _corners_of_level(cur)
        soft = blurred(cur, 2.5)
        for at in range(0, len(i), 4096):
            pi, py, px = i[at : at + 4096], y[at : at + 4096], x[at : at + 4096]
            patch = values_at(soft, pi[:, None], py[:, None] + _yy, px[:, None] + _xx) * _WEIGHT
            angle = np.arctan2(patch @ _yy, patch @ _xx)
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
            v = values_at(soft, pi[:, None], py[:, None] + POINTS[:, 0] * cos + POINTS[:, 1] * sin, px[:, None] + POINTS[:, 1] * cos - POINTS[:, 0] * sin)
            rest, all_ = ((v @ _REST) ** 2).sum(1), ((v - v.mean(1, keepdims=True)) ** 2).sum(1)
            r = np.empty(len(pi), CORNER)
            r["x"], r["y"] = (px + 0.5) * (width / w) - 0.5, (py + 0.5) * (height / h) - 0.5
            r["size"], r["angle"], r["level"] = width / w, angle, level
            r["plain"] = rest < PLAIN * all_
            r["d"] = np.ascontiguousarray(np.packbits(v[:, one] < v[:, two], axis=1)).view(">u8")
            out_i.append(pi)
            out.append(r)
        level += 1
        h, w = round(h0 / RATIO**level), round(w0 / RATIO**level)
        if min(h, w) < 2 * MARGIN + 3:
            break
        cur = resized(blurred(cur, 0.6), h, w)
    i, r = np.concatenate(out_i), np.concatenate(out)
    order = np.argsort(i, kind="stable")
    return i[order], r[order]


def described(images: DataFrame, keep: str, image: str) -> DataFrame:
    """(keep, digest, corners): packed corners where a task sees an image's bytes for the first time, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                data = part.column(1).to_pylist()
                digests = [None if x is None else hashlib.sha256(x).digest() for x in data]
                packed: list[bytes | None] = [None] * len(data)
                by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
                for k, (x, d) in enumerate(zip(data, digests, strict=True)):
                    if d is None or d in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    grey = read_image(x)
                    if grey is not None:
                        by_size.setdefault(grey.shape, []).append((k, grey))
                for shape, group in by_size.items():
                    step = max(1, (1 << 18) // max(1, shape[0] * shape[1]))
                    for lo in range(0, len(group), step):
                        some = group[lo : lo + step]
                        i, r = describe(np.stack([g for _, g in some]))
                        ends = np.searchsorted(i, np.arange(len(some) + 1))
                        for (k, _), a, z in zip(some, ends, ends[1:], strict=False):
                            packed[k] = r[a:z].tobytes() if a < z else None
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], [keep, "digest", "corners"])

    return arrow_map(images.select(keep, image), run, f"`{keep}` {images.schema[keep].dataType.simpleString()}, digest binary, corners binary")


#: The two blocks that make a table's cell.
TABLES = tuple(combinations(range(4), 2))


def table_entries(corners: DataFrame, tables: tuple[tuple[int, int], ...] = TABLES) -> DataFrame:
    """(cell, row, corner, turn, level): each telling corner once for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = np.frombuffer(packed, CORNER)
                at = np.flatnonzero(~r["plain"]).astype(np.int32)
                blocks = [r["d"][at, k // 2] >> np.uint64(32 * (k % 2)) & np.uint64(0xFFFFFFFF) for k in range(4)]
                # a bijection of the 64 bits, another one for each two blocks
                cells = [(((blocks[x] << np.uint64(32)) | blocks[y]) ^ np.uint64(0x9E3779B97F4A7C15 * (4 * x + y) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9) for x, y in tables]
                turn = np.rint(r["angle"][at] / (2 * np.pi) * TURNS).astype(np.int16) % TURNS
                n = len(cells)
                columns = [np.concatenate(cells).view(np.int64), np.full(n * len(at), row, np.int64), np.tile(at, n), np.tile(turn.astype(np.int16), n), np.tile(r["level"][at].astype(np.int16), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "row", "corner", "turn", "level"])

    return arrow_map(corners.select("row", "corners"), run, "cell long, row long, corner int, turn short, level short")


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Places of ``a`` whose corners agree with corners of ``b`` on one change of scale, turn and place."""
    if not len(a) or not len(b):
        return 0
    j = np.empty(len(a), np.int64)
    least, back, back_of = np.empty(len(a), np.int64), np.full(len(b), BITS + 1), np.zeros(len(b), np.int64)
    step = max(1, (1 << 20) // len(b))
    for at in range(0, len(a), step):
        differ = np.bitwise_count(a["d"][at : at + step, None] ^ b["d"][None]).sum(2, dtype=np.int64)
        part = slice(at, at + len(differ))
        j[part] = differ.argmin(1)
        least[part] = differ.min(1)
        low, of = differ.min(0), differ.argmin(0)
        better = low < back
        back[better], back_of[better] = low[better], of[better] + at
    i = np.flatnonzero((least <= RADIUS) & (back_of[j] == np.arange(len(a))))
    if len(i) < CONSENSUS:
        return 0
    p, q = a[i], b[j[i]]
    size, turn = p["size"] / q["size"], p["angle"] - q["angle"]
    za, zb, change = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"], size * np.exp(1j * turn)
    best = 0
    step = max(1, (1 << 20) // len(i))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        moved = change[part, None] * (zb[None] - zb[part, None])
        near = np.abs(za[part, None] + moved - za[None]) <= 3 * np.maximum(1, size[part, None]) + 0.12 * np.abs(moved)
        near &= (np.abs(np.log(size[None] / size[part, None])) < 0.35) & (np.cos(turn[None] - turn[part, None]) > 0.9)
        for k in np.argsort(-near.sum(1))[:5].tolist():
            places = za[near[k]] / 6
            best = max(best, len({(int(z.real), int(z.imag)) for z in places.tolist()}))
    return best


def same_picture(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two images' corners agree at CONSENSUS places and SHARE of the lesser number of corners."""
    return agreement(a, b) >= max(CONSENSUS, SHARE * min(len(a), len(b)))


def candidates(both: DataFrame) -> DataFrame:
    """(a, b) of the meetings (a, b, corner, turn, level: a's corner, differences) in which MANY corners agree."""
    hit = F.struct("corner", "turn", "level")
    pairs = both.groupBy("a", "b").agg(F.min("corner").alias("low"), F.max("corner").alias("high"), F.collect_set(hit).alias("hits")).where("low < high")

    def beside(g: Column, h: Column) -> Column:
        far = F.pmod(g["turn"] - h["turn"], F.lit(TURNS))
        return (F.abs(g["level"] - h["level"]) <= 1) & (F.least(far, TURNS - far) <= TURNS // 10)

    agree = F.exists("hits", lambda g: F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: beside(g, h)), lambda h: h["corner"]))) >= MANY)
    return pairs.where(F.size("hits") >= MANY).where(agree).select("a", "b")


def confirmed(pairs: DataFrame, corners: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of rows whose images are copies; other columns stay."""
    side = lambda k: corners.select(F.col("row").alias(k), F.col("corners").alias(f"corners_{k}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [same_picture(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER)) for x, y in zip(b.column("corners_a").to_pylist(), b.column("corners_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept], kept).filter(pa.array(same, pa.bool_()))

    return arrow_map(full, run, pairs.schema)


def meetings(placed: DataFrame, other: DataFrame, once: bool) -> DataFrame:
    """Rows of different classes in one cell: (a, b, corner, turn, level) with a < b; once: ``other`` is ``placed`` itself."""
    names = ["row", "corner", "turn", "level", "root"]
    met = placed.join(other.select("cell", *(F.col(c).alias(f"{c}_2") for c in names)), "cell").where("root <> root_2 and row < row_2" if once else "root <> root_2")
    first = F.col("row") < F.col("row_2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    sign = F.when(first, 1).otherwise(-1)
    return met.select(
        pick("row", "row_2").alias("a"),
        pick("row_2", "row").alias("b"),
        pick("corner", "corner_2").alias("corner"),
        F.pmod(sign * (F.col("turn") - F.col("turn_2")), F.lit(TURNS)).cast("short").alias("turn"),
        (sign * (F.col("level") - F.col("level_2"))).cast("short").alias("level"),
    )


def classes(corners: DataFrame, roots: DataFrame) -> DataFrame:
    """(row, root): the classes of ``roots`` joined by confirmed candidates of ``corners`` (row, corners)."""
    parts = []
    for table in TABLES:  # one after the other, so that no more than one table's entries are shuffled at a time
        entries = table_entries(corners, (table,))
        shared = entries.groupBy("cell").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("cell")
        parts.append(cut(entries.join(shared, "cell", "left_semi"), "cells"))
    live = functools.reduce(DataFrame.unionByName, parts)
    labels = cut(roots, "labels")
    few = FEW * live.count()
    tried = None
    for k in range(ROUNDS + 1):
        placed = cut(live.join(labels, "row"), "placed")
        pivot = F.struct(F.xxhash64("row", F.lit(k)).alias("order"), "row", "corner", "turn", "level", "root")
        met = placed.groupBy("cell", "root").agg(F.count("*").alias("of"), F.max(pivot).alias("pivot")).groupBy("cell")
        met = cut(met.agg(F.sum("of").alias("all"), F.sum(F.col("of") * F.col("of")).alias("same"), F.max("pivot").alias("pivot")).where("all * all > same"), "met")
        left = met.agg(F.sum(F.expr("all * all - same"))).first()[0] or 0
        if not left:
            break
        last = left <= 2 * few or k == ROUNDS
        mine = placed.join(met.select("cell"), "cell", "left_semi")
        both = meetings(mine, mine if last else met.select("cell", "pivot.*"), last)
        pairs = candidates(both)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = confirmed(pairs, corners)
        ends = links.join(labels.toDF("a", "root_a"), "a").join(labels.toDF("b", "root_b"), "b")
        moved = connected_components(ends.select("root_a", "root_b"), "root_a", "root_b").toDF("root", "to")
        labels, old = cut(labels.join(moved, "root", "left").select("row", F.coalesce("to", "root").alias("root")), "labels"), labels
        for done in (placed, met, old):
            forget(done)
        if last:
            break
    for part in parts:
        forget(part)
    return labels


def copies(images: DataFrame, image_id: str = "image_id", image: str = "image") -> DataFrame:
    """One row per image: (image_id, class_id, n_images), the class's smallest id and number of rows."""
    rows = images.select(F.col(image_id).alias("image_id"), F.col(image).alias("image"))
    found = described(rows, "image_id", "image").withColumn("row", F.monotonically_increasing_id())
    # rows without an image stay apart: each id is a key of its own
    key = F.coalesce(F.hex("digest"), F.concat(F.lit("null "), F.coalesce(F.col("image_id").cast("string"), F.lit(""))))
    found = cut(found.select("row", "image_id", key.alias("key"), "corners"), "images")
    first = cut(found.groupBy("key").agg(F.min("row").alias("root"), F.min("image_id").alias("least"), F.count("*").alias("n")), "keys")
    with_corners = found.where("corners is not null").select("row", "corners")
    roots = found.where("corners is not null").select("row", "key").join(first.select("key", "root"), "key").select("row", "root")
    root = classes(with_corners, roots).join(found.select("row", "key"), "row").groupBy("key").agg(F.min("root").alias("class"))
    placed = first.join(root, "key", "left").select("key", "least", "n", F.coalesce("class", "root").alias("class"))
    top = placed.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_images"))
    of = placed.join(top, "class").select("key", "class_id", "n_images")
    return found.select("image_id", "key").join(of, "key").select("image_id", "class_id", "n_images")


def write_pgm(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def rendered(vectors: DataFrame, vector_id: str, vector: str, cell: int = 8) -> DataFrame:
    """(image_id, image): square vectors drawn as images, a square of ``cell`` pixels for each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                side = int(len(v or ()) ** 0.5)
                ok = side and side * side == len(v) and not any(x is None for x in v)
                out.append(write_pgm(np.kron(128 + 400 * np.asarray(v).reshape(side, side), np.ones((cell, cell)))) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["image_id", "image"])

    return arrow_map(vectors.select(F.col(vector_id).cast("long"), vector), run, "image_id long, image binary")
