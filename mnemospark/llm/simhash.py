"""Near-duplicate documents by SimHash, linked through a segment-popcount grid.

A fingerprint's two halves are each cut into 16 segments of 2 bits; a half's embedding
is the vector of its segments' bit counts. Two fingerprints that differ in at most
three bits have a half that differs in at most one, and the Manhattan distance of two
embeddings never exceeds the number of differing bits. So each pair within the radius
meets in a cell of side one of the grid over half-embeddings: either both lie in it, or
one lies in it and the other's embedding is one step above. Candidates are verified on
all 64 bits. Each group of a cell is reduced to a spanning forest before it leaves its
task, and links are joined to components by star contraction.

Defined results: a null text counts as empty; a text without words has fingerprint 0
and links like any other; repeated rows keep one output row each; a null id takes part
in linking but never becomes a component id (a component of null ids alone has null);
extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.arrow import appended, arrow_map, column, unused
from mnemospark.operators.components import connected_components
from mnemospark.plans.lineage import cut, forget

SEED = 42
#: Words of a shingle, and similarity, of the filter that keeps one of each group.
WIDTH, SIMILARITY = 5, 0.8
#: Similar texts share one in so many of their tokens among those of the least hashes.
PART = 5
#: Pairs are all compared once there are so many for each token, or after so many rounds.
FEW, ROUNDS = 0.5, 3
#: Rows are close to a pivot if at most this part of their tokens, by the sum of both numbers, is in one of them only.
CORE = 0.6
#: Times that one row of each token is compared before all pairs of rows close to the first pivots are.
STARS = 1
#: Rows of a pivot that are compared with it in one task.
BUCKET = 256
#: Rows that are sent to all executors rather than joined by a shuffle of texts.
SENT = 1_000_000
RADIUS = 3
SEGMENTS = 16
#: Binary logarithm of the bits of the largest signature.
LARGEST = 17
#: Shingles whose bits are summed at a time.
CHUNK = 1 << 15


def shingle_digests(text: str | None, width: int) -> list[bytes]:
    """Big-endian XXH64 digests of the word shingles of a text, repeats included."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return [xxhash.xxh64_digest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_digest(b" ".join(z), SEED) for z in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprints_of(texts: list[str | None], width: int) -> np.ndarray:
    """Unsigned 64-bit SimHash fingerprints: a bit is set if it is set in over half of the digests."""
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    rows: list[int] = []
    sizes: list[int] = []
    held: list[bytes] = []
    count = 0

    def flush() -> None:
        nonlocal count
        if count:
            bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            np.add.at(ones, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        rows.clear(), sizes.clear(), held.clear()
        count = 0

    for i, text in enumerate(texts):
        digests = shingle_digests(text, width)
        totals[i] = len(digests)
        for at in range(0, len(digests), CHUNK):
            part = digests[at : at + CHUNK]
            rows.append(i), sizes.append(len(part)), held.extend(part)
            count += len(part)
            if count >= CHUNK:
                flush()
    flush()
    return np.packbits(ones * 2 > totals[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3, out: str = "simhash") -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint column appended; no shuffle."""
    kept = [c for c in docs.columns if c != out]
    rows = docs.select(*map(column, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(text).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fp)], [*kept, out])

    return arrow_map(rows, run, appended(rows.schema, {out: "long"}))


_POWERS = 3 ** np.arange(SEGMENTS, dtype=np.int64)


def half_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in fp, cell, own) of every grid entry of unsigned fingerprints.

    An entry is a fingerprint's own cell in either half, or the cell one step above it.
    """
    at, cells, own = [], [], []
    n = np.arange(len(fp))
    for half in (0, 1):
        bits = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        counts = np.stack([np.bitwise_count((bits >> np.uint64(2 * s)) & np.uint64(3)) for s in range(SEGMENTS)]).astype(np.int64)
        cell = (counts * _POWERS[:, None]).sum(0) * 2 + half
        at.append(n), cells.append(cell), own.append(np.ones(len(fp), bool))
        for s in range(SEGMENTS):
            up = counts[s] < 2
            at.append(n[up]), cells.append(cell[up] + 2 * _POWERS[s]), own.append(np.zeros(int(up.sum()), bool))
    return np.concatenate(at), np.concatenate(cells), np.concatenate(own)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) with the components of the links a-b."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    move = root != np.arange(len(nodes))
    return nodes[move], nodes[root[move]]


def _links(cell: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within radius between entries of one cell, for entries sorted by cell."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    held, first, step = 0, np.arange(len(cell) - 1), 0
    found: list[tuple[np.ndarray, np.ndarray]] = [(a, b)]
    while len(first):
        step += 1
        first = first[first + step < len(cell)]
        first = first[cell[first] == cell[first + step]]
        x, y = fp[first], fp[first + step]
        near = (np.bitwise_count((x ^ y).view(np.uint64)) <= radius) & (own[first] | own[first + step]) & (x != y)
        found.append((x[near], y[near]))
        held += int(near.sum())
        if held > 1 << 20:
            found = [forest(*(np.concatenate(z) for z in zip(*found, strict=True)))]
            held = len(found[0][0])
    a, b = (np.concatenate(z) for z in zip(*found, strict=True))
    return forest(a, b) if len(a) else (a, b)


def near_links(fps: DataFrame, fp: str = "simhash", radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints reachable in steps of at most ``radius`` bits.

    ``fps`` holds distinct signed fingerprints; radius is at most 3, which the grid guarantees.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("the grid of half-embeddings covers radii 0 to 3")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False)
            at, cells, own = half_cells(values.view(np.uint64))
            for lo in range(0, len(at), 1 << 17):
                part = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(cells[part]), pa.array(values[at[part]]), pa.array(own[part])], ["cell", "fp", "own"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            part = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(part[0]):
                continue
            held.append(part)
            if held[0][0][0] == part[0][-1]:
                continue
            cell, value, own = (np.concatenate(z) for z in zip(*held, strict=True))
            end = int(np.searchsorted(cell, cell[-1]))
            x, y = _links(cell[:end], value[:end], own[:end], radius)
            held = [[cell[end:], value[end:], own[end:]]]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
        if held:
            x, y = _links(*(np.concatenate(z) for z in zip(*held, strict=True)), radius)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    entries = arrow_map(fps.select(F.col(fp).alias("fp")), expand, "cell long, fp long, own boolean")
    spread = entries.repartition("cell").sortWithinPartitions("cell")
    return arrow_map(spread, link, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: (doc_id, simhash, component_id), the smallest doc_id that it reaches."""
    marked = cut(with_fingerprint(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")), "text", width).select("doc_id", "simhash"), "simhash")
    return _grouped(marked, radius)


def _grouped(marked: DataFrame, radius: int) -> DataFrame:
    """``marked`` with component_id appended."""
    least = marked.groupBy("simhash").agg(F.min("doc_id").alias("least"))
    root = connected_components(near_links(least, radius=radius)).withColumnRenamed("node", "simhash")
    placed = least.join(root, "simhash", "left").select("simhash", "least", F.coalesce("root", "simhash").alias("root"))
    top = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(top, "root").select("simhash", "component_id")
    return marked.join(of, "simhash")


def similarity(a: str | None, b: str | None, width: int = WIDTH) -> float:
    """Sum of the smaller by sum of the larger counts of the word shingles of two texts."""
    x, y = Counter(shingle_digests(a, width)), Counter(shingle_digests(b, width))
    total = x.total() + y.total()
    both = sum(min(n, y[d]) for d, n in x.items() if d in y)
    return both / (total - both) if total else 1.0


def shingle_tokens(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a text, the k-th repeat of a shingle under a hash of its own."""
    digests = shingle_digests(text, WIDTH)
    if len(set(digests)) < len(digests):
        seen: Counter = Counter()
        for i, d in enumerate(digests):
            if seen[d]:
                digests[i] = xxhash.xxh64_digest(d + seen[d].to_bytes(4, "big"), SEED)
            seen[d] += 1
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


def first_tokens(text: str | None, least: float) -> tuple[int, np.ndarray]:
    """Number of tokens of a text, and those of its least hashes: as many as leave 1 / PART shared with any partner."""
    tokens = shingle_tokens(text)
    n = len(tokens)
    size = min(n, n - math.ceil(least * n - 1e-9) + -(-n // PART))
    return n, np.partition(tokens, size - 1)[:size] if size else tokens[:0]


def candidate_tokens(rows: DataFrame, least: float = SIMILARITY, key: str = "row", text: str = "text") -> DataFrame:
    """(token, row, n, weight): any two rows of at least ``least`` similarity (0.5 or more) have a token in common.

    Two texts of n and m tokens that are so similar share at least least * max(n, m) of them,
    so among the first n - least n + n / PART by hash they share min(n, m) / PART (all
    rounded up). Rows with fewer tokens that any other row has among their first are
    left. Of the others' shared tokens the rarest count, as many as leave no room for a
    pair without a common one; so what many texts repeat makes no candidates unless
    they consist of little else. weight is the sum of the numbers of rows of a row's tokens:
    greatest for the text around which others were edited.
    """
    if least < 0.5:
        raise ValueError("candidates cover similarities of 0.5 and more")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [first_tokens(t, least) for t in b.column(1).to_pylist()]
            sizes = [len(t) for _, t in held]
            keys = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes).astype(np.int64)
            n = np.repeat(np.asarray([n for n, _ in held], np.int32), sizes)
            tokens = np.concatenate([t for _, t in held]).view(np.int64) if held else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(tokens)], ["row", "n", "token"])

    parts = arrow_map(rows.select(key, text), cut_up, "row long, n int, token long")
    common = parts.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    need = F.greatest(F.lit(1), F.ceil(F.floor(F.col("n") * F.lit(least)) / F.lit(PART))).cast("int")
    lists = common.groupBy("row").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"), F.sum("df").alias("weight"))
    lists = lists.withColumn("room", F.size("all") - need + 1).where("room > 0")
    return lists.select(F.explode(F.slice("all", F.lit(1), F.col("room"))).alias("x"), "row", "n", "weight").select("x.token", "row", "n", "weight")


def signature(text: str | None) -> tuple[int, bytes]:
    """Number of tokens of a text, and a bitmap of them by the low bits of their hashes, of so many bits or up to twice as many."""
    tokens = shingle_tokens(text)
    size = 1 << max(3, min(LARGEST, (len(tokens) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return len(tokens), np.packbits(bits, bitorder="little").tobytes()


def most_shared(n: int, a: bytes, m: int, b: bytes) -> int:
    """The tokens that two texts of these signatures can't share more of: each bit that only one has stands for a token that only it has."""
    size = min(len(a), len(b))
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    for _ in range((len(a) // size).bit_length() - 1):
        x = x >> (x_half := 4 * len(a)) | x & (1 << x_half) - 1
        a = a[: len(a) // 2]
    for _ in range((len(b) // size).bit_length() - 1):
        y = y >> (y_half := 4 * len(b)) | y & (1 << y_half) - 1
        b = b[: len(b) // 2]
    return min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())


def most_similar(n: int, a: bytes, m: int, b: bytes) -> float:
    """The similarity that two texts of these signatures can't exceed."""
    both = most_shared(n, a, m, b)
    return both / (n + m - both) if n + m else 1.0


def signatures(texts: DataFrame) -> DataFrame:
    """(row, n, bits) of texts (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [signature(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], ["row", "n", "bits"])

    return arrow_map(texts, run, "row long, n int, bits binary")


def likely_pairs(pairs: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ...) whose signatures leave room for ``least`` similarity; no text is needed to tell."""
    kept = pairs.columns
    full = pairs.join(signs.toDF("a", "n_a", "bits_a"), "a").join(signs.toDF("b", "n_b", "bits_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            room = [most_similar(*x) >= least - 1e-9 for x in zip(*(b.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept], kept).filter(pa.array(room, pa.bool_()))

    return arrow_map(full, run, pairs.schema)


def similar_pairs(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (row, text) are at least ``least`` similar."""
    t = texts.toDF("k", "t")
    full = pairs.join(t.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similarity(x, y) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return arrow_map(full.select("a", "b", "ta", "tb"), compare, "a long, b long")


def differences(pairs: DataFrame, texts: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """(pivot, row, m, n, d, token) of the pairs (row, pivot): how each row's text differs from its pivot's.

    m and n are the numbers of tokens of the pivot and of the row, d is that of the tokens
    that only one of them has. A row less than CORE from its pivot, and any row that may be
    similar to one, is listed with each of these tokens, and once with a null token.
    The texts of a pivot's rows meet the pivot's in buckets of BUCKET rows.
    """
    ring = differing(least)
    far = CORE / least + ring * (1 + 1 / least)

    def in_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            room = [n + m - 2 * most_shared(m, x, n, y) <= far * n + CORE * m + 1e-9 for m, x, n, y in zip(*(b.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("pivot")], ["row", "pivot"]).filter(pa.array(room, pa.bool_()))

    full = pairs.join(signs.toDF("pivot", "n_a", "bits_a"), "pivot").join(signs.toDF("row", "n_b", "bits_b"), "row")
    near = cut(arrow_map(full, in_reach, "row long, pivot long"), "near_pivots")
    buckets = near.groupBy("pivot").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    dealt = near.join(buckets, "pivot").select("row", "pivot", F.pmod(F.xxhash64("row"), "buckets").alias("bucket"))
    dealt = dealt.unionByName(dealt.select(F.col("pivot").alias("row"), "pivot", "bucket").distinct())
    placed = dealt.join(texts.toDF("row", "text"), "row").select("pivot", "bucket", "row", "text")
    placed = placed.repartition("pivot", "bucket").sortWithinPartitions("pivot", "bucket", F.col("row") != F.col("pivot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.empty(0, np.uint64)
        for b in batches:
            found, held = [], 0
            for pivot, row, text in zip(*(b.column(c).to_pylist() for c in ("pivot", "row", "text")), strict=True):
                tokens = shingle_tokens(text)
                if row == pivot:
                    base = tokens
                    continue
                apart = np.setxor1d(base, tokens, assume_unique=True)
                m, n, d = len(base), len(tokens), len(apart)
                if d <= far * n + CORE * m + 1e-9:
                    found.append((pivot, row, m, n, d, apart))
                    held += d
                if held > 1 << 17:
                    yield listed(found)
                    found, held = [], 0
            if found:
                yield listed(found)

    def listed(found: list[tuple]) -> pa.RecordBatch:
        sizes = [len(f[5]) + 1 for f in found]
        many = [pa.array(np.repeat(np.asarray([f[k] for f in found], t), sizes)) for k, t in enumerate((np.int64, np.int64, np.int32, np.int32, np.int32))]
        ends = np.cumsum(sizes) - 1
        tokens, null = np.zeros(sum(sizes), np.int64), np.zeros(sum(sizes), bool)
        null[ends] = True
        tokens[~null] = np.concatenate([f[5] for f in found]).view(np.int64)
        return pa.RecordBatch.from_arrays([*many, pa.array(tokens, mask=null)], ["pivot", "row", "m", "n", "d", "token"])

    apart = cut(arrow_map(placed, run, "pivot long, row long, m int, n int, d int, token long"), "differences")
    forget(near)
    return apart


def differing(least: float) -> float:
    """The greatest part of their tokens, by the sum of both numbers, that only one of two texts of ``least`` similarity has."""
    return (1 - least) / (1 + least)


def close_entries(apart: DataFrame, least: float) -> DataFrame:
    """(pivot, token, row, n, d, c): two similar rows of a pivot, of its ``differences``, have a token in common, if not both are similar to the pivot.

    Two texts differ by the tokens in which just one of them differs from the pivot. So the
    more of its tokens a row has apart from the pivot, the more of these a similar row has as
    well: over d - ring (n + m), divided by 1 + ring. They have one in common among their
    rarest, of which so many fewer are needed. c tokens of a row are not only its own.
    """
    ring = differing(least)
    common = apart.where("token is not null").withColumn("df", F.count("*").over(Window.partitionBy("pivot", "token"))).where("df > 1")
    need = F.greatest(F.lit(1), F.ceil((F.col("d") - (F.col("n") + F.col("m")) * F.lit(ring)) / F.lit(1 + ring) - 1e-9)).cast("int")
    lists = common.groupBy("pivot", "row").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("d").alias("d"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
    lists = lists.withColumn("c", F.size("all")).withColumn("room", F.col("c") - need + 1).where("room > 0")
    return lists.select(F.explode(F.slice("all", F.lit(1), F.col("room"))).alias("x"), "pivot", "row", "n", "d", "c").select("pivot", "x.token", "row", "n", "d", "c")


def close_pairs(entries: DataFrame, labels: DataFrame, least: float, star: int | None) -> DataFrame:
    """(a, b): rows that meet in ``close_entries``, may be similar and have other roots in ``labels`` (row, root): with one row of each token (another for each star), or all pairs."""
    ring = differing(least)
    each = Window.partitionBy("pivot", "token")
    mine = entries.join(labels.select("row", "root"), "row").withColumn("low", F.min("root").over(each)).withColumn("high", F.max("root").over(each)).where("low < high")
    names = ["row", "n", "d", "c", "root"]
    if star is None:
        mine = mine.select("pivot", "token", *names)
        both = mine.join(mine.select("pivot", "token", *(F.col(c).alias(f"{c}_b") for c in names)), ["pivot", "token"]).where("row < row_b")
    else:
        order = F.col("c") if star == 0 else F.xxhash64("row", F.lit(star))
        both = mine.withColumn("top", F.max(F.struct(order.alias("order"), *names)).over(each)).select(*names, *(F.col("top")[c].alias(f"{c}_b") for c in names))
    both = both.where("root <> root_b").where(2 * F.least("c", "c_b") >= F.col("d") + F.col("d_b") - (F.col("n") + F.col("n_b")) * F.lit(ring) - 1e-9)
    both = both.where(F.least("n", "n_b") >= F.greatest("n", "n_b") * F.lit(least) - 1e-9)
    return both.select(F.least("row", "row_b").alias("a"), F.greatest("row", "row_b").alias("b")).distinct()


def similar_roots(rows: DataFrame, roots: DataFrame, least: float = SIMILARITY, key: str = "row", text: str = "text") -> DataFrame:
    """(root, to): where the components ``roots`` (row, root) of ``rows`` go by the pairs of at least ``least`` similarity.

    The result is that of comparing all pairs. Any two similar rows share a token. In a round
    each token's row of greatest weight, in a group around one text that text, is the pivot
    of the token's rows. They are compared with the pivot, and those close to it with one
    another by what differs from it: edited copies of one text share its tokens, but hardly
    their edits. All pairs of rows close to a pivot are found so, and the token is done with
    those rows. Once the pairs of rows in different components that are left are few for the
    number of rows, or after ROUNDS, all are compared. Signatures rule out most pairs before
    their texts are joined.
    """
    ring = differing(least)
    tokens = cut(candidate_tokens(rows, least, key, text), "tokens")
    listed = tokens.select("row").distinct()
    texts = cut(semi(rows.select(F.col(key).alias("row"), F.col(text).alias("text")), listed), "texts")
    signs = cut(signatures(texts), "signatures")
    labels = cut(roots.join(listed, "row", "left_semi").select("row", F.col("root").alias("was"), "root"), "labels")
    few = FEW * tokens.count()
    each = Window.partitionBy("token")
    for k in range(ROUNDS + 1):
        placed = tokens.join(labels.select("row", "root"), "row")
        kinds = placed.groupBy("token", "root").agg(F.count("*").alias("of")).groupBy("token").agg(F.sum("of").alias("all"), F.sum(F.col("of") * F.col("of")).alias("same"))
        left = kinds.agg(F.sum(F.expr("all * all - same"))).first()[0] or 0
        if not left:
            break
        live = placed.withColumn("low", F.min("root").over(each)).withColumn("high", F.max("root").over(each)).where("low < high")
        last = left <= 2 * few or k == ROUNDS
        if last:
            mine = live.select("token", "row", "n", "root")
            both = mine.join(mine.toDF("token", "row_b", "n_b", "root_b"), "token").where("root <> root_b and row < row_b")
            both = both.where(F.least("n", "n_b") >= F.greatest("n", "n_b") * F.lit(least) - 1e-9)
            pairs = cut(both.select(F.col("row").alias("a"), F.col("row_b").alias("b")).distinct(), "pairs")
        else:
            # before labels change: the others of its token decide whether a row is left
            live = cut(live.withColumn("pivot", F.max(F.struct("weight", "row")).over(each)["row"]).select("token", "row", "n", "weight", "pivot").where("row <> pivot"), "live")
            apart = differences(live.select("row", "pivot").distinct(), texts, signs, least)
            met = apart.where("token is null")
            labels = relabelled(labels, met.where(F.col("d") <= (F.col("n") + F.col("m")) * F.lit(ring) + 1e-9).select(F.col("row").alias("a"), F.col("pivot").alias("b")))
            entries = cut(close_entries(apart, least), "entries")
            for star in range(0 if k else STARS):
                some = cut(close_pairs(entries, labels, least, star), "some")
                labels = relabelled(labels, similar_pairs(likely_pairs(some, signs, least), texts, least))
                forget(some)
            pairs = cut(close_pairs(entries, labels, least, None), "pairs")
            close = met.where(F.col("d") <= (F.col("n") + F.col("m")) * F.lit(CORE)).select("row", "pivot")
            tokens, old = cut(live.join(close, ["row", "pivot"], "left_anti").select("token", "row", "n", "weight"), "tokens"), tokens
            for table in (old, live, apart, entries):
                forget(table)
        labels = relabelled(labels, similar_pairs(likely_pairs(pairs, signs, least), texts, least))
        forget(pairs)
        if last:
            break
    for table in (tokens, texts, signs):
        forget(table)
    return labels.select(F.col("was").alias("root"), F.col("root").alias("to")).distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (row, was, root), whose files go, with the roots joined by links (a, b) between rows."""
    ends = links.join(labels.select(F.col("row").alias("a"), F.col("root").alias("root_a")), "a").join(labels.select(F.col("row").alias("b"), F.col("root").alias("root_b")), "b")
    moved = connected_components(ends.select("root_a", "root_b"), "root_a", "root_b").toDF("root", "to")
    new = cut(labels.join(moved, "root", "left").select("row", "was", F.coalesce("to", "root").alias("root")), "labels")
    forget(labels)
    return new


def semi(rows: DataFrame, listed: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose row is, or with left_anti is not, ``listed``: sent to all executors if at most SENT, so that texts need no shuffle."""
    listed = cut(listed, "listed")
    return rows.join(F.broadcast(listed) if listed.count() <= SENT else listed, "row", how)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id's (nulls last).

    Two texts are near copies if their fingerprints over shingles of WIDTH words are within
    ``radius`` bits, or if they are at least ``least`` similar; groups are what such links
    connect, over all different texts. Columns, whatever their names, and texts stay as they
    are. Null, blank and equal texts are copies of one another; of rows that share the
    smallest id one stays.
    """
    fp, row = unused("__fp", docs), unused("__row", docs)
    marked = cut(with_fingerprint(docs, text, WIDTH, fp).withColumn(row, F.monotonically_increasing_id()), "near")
    rows = marked.select(column(row).alias("doc_id"), column(fp).alias("simhash"), column(doc_id).alias("id"))
    grouped = cut(_grouped(rows, radius).select(F.col("doc_id").alias("row"), "id", F.col("component_id").alias("root")), "groups")
    texts = marked.select(column(row).alias("row"), column(text).alias("text"))
    digests = texts.select("row", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    again = digests.withColumn("first", F.min("row").over(Window.partitionBy("digest"))).where("row > first").select("row")
    moved = similar_roots(semi(texts, again, "left_anti"), grouped.select("row", "root"), least)
    placed = grouped.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root"))
    keep = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")).select(F.col("best.row").alias(row))
    return marked.join(keep, row, "left_semi").select(*map(column, docs.columns))
