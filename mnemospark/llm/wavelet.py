"""Token ids in shard files that are wavelet matrices.

A shard's ids are numbered densely by value. Plane by plane, from the highest bit of
the numbers, the file keeps one bit per token, with the tokens stably sorted by the
bits of the planes before; ranks are kept per BLOCK of bits. That gives the token at a
position, the count of a token in a range and its k-th occurrence from one file, whose
blocks are compressed singly and unpacked when they are read.

Shards follow the document ids in ascending order: the table is partitioned by quantiles
of its ids, each task writes files of at most SHARD_TOKENS ids (or one document), and a file's
first position is the sum of what the files before it hold; only one total per
partition reaches the driver for that.

Defined results: a null text counts as empty and holds the end id alone; null ids come
first; repeated ids stay together, in the order of their texts; extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.arrow import arrow_map
from mnemospark.llm import bpe
from mnemospark.llm.files import read_file, spread_files, write_file
from mnemospark.plans.lineage import cut, shared_path

MAGIC = b"WVM1"
#: Ids after which a file is closed.
SHARD_TOKENS = 1 << 21
#: Bytes of a plane that are compressed together and share one rank.
BLOCK = 1 << 13
END = 2


def build(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of documents (their ids and numbers of tokens) and all their token ids in a row."""
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    number = np.cumsum(seen).astype(np.uint16) - np.uint16(1)
    row = number[ids] if len(ids) else np.empty(0, np.uint16)
    depth = max(1, int(len(alphabet) - 1).bit_length())
    pack = zstandard.ZstdCompressor(level=1).compress
    blocks, ranks, zeros = [], [], []
    for level in range(depth - 1, -1, -1):
        bit = (row >> np.uint16(level)).astype(np.uint8) & 1
        plane = np.packbits(bit)
        starts = np.arange(0, max(len(plane), 1), BLOCK)
        if len(plane):
            ones = np.add.reduceat(np.bitwise_count(plane), starts, dtype=np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4"))
            blocks += [pack(plane[s : s + BLOCK].tobytes()) for s in starts]
        high = bit.view(bool)
        low = np.compress(~high, row)
        zeros.append(len(low))
        row = np.concatenate((low, np.compress(high, row)))
    lengths = np.asarray([len(b) for b in blocks], "<u4")
    null = np.packbits(np.asarray([i is None for i in doc_ids], bool)) if doc_ids else np.empty(0, np.uint8)
    head = b"".join(
        np.ascontiguousarray(x, k).tobytes()
        for x, k in (([i or 0 for i in doc_ids], "<i8"), (sizes, "<u4"), (null, "u1"), (alphabet, "<u4"), (zeros, "<u4"), (np.concatenate(ranks) if ranks else [], "<u4"), (lengths, "<u4"))
    )
    head = pack(head)
    return MAGIC + struct.pack("<IIIII", len(doc_ids), len(ids), len(alphabet), depth, len(head)) + head + b"".join(blocks)


class Shard:
    """Reads one file: access, rank, select and whole ranges."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.n_docs, self.n, sigma, self.depth, size = struct.unpack_from("<IIIII", data, 4)
        head, at = zstandard.ZstdDecompressor().decompress(data[24 : 24 + size]), 0
        self.per_plane = -(-(-(-self.n // 8)) // BLOCK)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(head, kind, count, at)
            at += out.nbytes
            return out

        ids, self.sizes = take("<i8", self.n_docs), take("<u4", self.n_docs)
        null = np.unpackbits(take("u1", -(-self.n_docs // 8)))[: self.n_docs].astype(bool)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.alphabet, self.zeros = take("<u4", sigma), take("<u4", self.depth)
        self.ranks = take("<u4", self.depth * self.per_plane).reshape(self.depth, self.per_plane)
        lengths = take("<u4", self.depth * self.per_plane)
        self.ends = 24 + size + np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        self.data, self.unpack = memoryview(data), zstandard.ZstdDecompressor().decompress
        self.held: dict[int, np.ndarray] = {}

    def _block(self, k: int) -> np.ndarray:
        if k not in self.held:
            if len(self.held) >= 256:
                self.held.clear()
            self.held[k] = np.frombuffer(self.unpack(self.data[self.ends[k] : self.ends[k + 1]]), np.uint8)
        return self.held[k]

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if i >= self.n:
            return self.n - int(self.zeros[level])
        byte, bit = divmod(i, 8)
        k, inside = divmod(byte, BLOCK)
        block = self._block(level * self.per_plane + k)
        return int(self.ranks[level, k]) + int(np.bitwise_count(block[:inside]).sum()) + (int(block[inside]) >> (8 - bit)).bit_count()

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.depth):
            byte, bit = divmod(i, 8)
            one = int(self._block(level * self.per_plane + byte // BLOCK)[byte % BLOCK]) >> (7 - bit) & 1
            before = self._ones(level, i)
            i = int(self.zeros[level]) + before if one else i - before
            code = code << 1 | one
        return int(self.alphabet[code])

    def _range(self, token: int, end: int) -> tuple[int, int] | None:
        """Where the occurrences of a token before ``end`` stand below the last plane."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        lo, hi = 0, end
        for level in range(self.depth):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if code >> (self.depth - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before position ``end``."""
        found = self._range(token, end)
        return found[1] - found[0] if found else 0

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of a token, from 0."""
        found = self._range(token, self.n)
        if not found or not 0 <= k < found[1] - found[0]:
            raise IndexError(k)
        at, code = found[0] + k, int(np.searchsorted(self.alphabet, token))
        for level in range(self.depth - 1, -1, -1):
            one = code >> (self.depth - 1 - level) & 1
            want = at - int(self.zeros[level]) if one else at
            lo, hi = 0, self.n - 1
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order, unpacked plane by plane from the last."""
        row = np.zeros(self.n, np.uint16)
        for level in range(self.depth - 1, -1, -1):
            ks = range(level * self.per_plane, (level + 1) * self.per_plane)
            plane = b"".join(self.unpack(self.data[self.ends[k] : self.ends[k + 1]]) for k in ks)
            high = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n).view(bool)
            zeros, above = int(self.zeros[level]), np.empty_like(row)
            above[np.flatnonzero(~high)] = row[:zeros]
            above[np.flatnonzero(high)] = row[zeros:] | np.uint16(1 << (self.depth - 1 - level))
            row = above
        return self.alphabet[row] if self.n else np.empty(0, "<u4")


def write_shards(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end: int = END, folder: str | None = None, limit: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encode all texts into files; one row per file: (shard, part, path, n_docs, n_tokens, start)."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    closing = end.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, part = bpe.encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        count = 0

        def close() -> pa.RecordBatch:
            nonlocal part, count
            path = f"{folder}/{shard:06d}-{part:06d}-{uuid.uuid4().hex}.wvm"
            write_file(path, build(ids, np.asarray([len(h) // 2 for h in held], "<u4"), np.frombuffer(b"".join(held), "<u2")))
            row = {"shard": [shard], "part": [part], "path": [path], "n_docs": [len(ids)], "n_tokens": [count]}
            ids.clear(), held.clear()
            part, count = part + 1, 0
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), e.encode_all(b.column(1).to_pylist()), strict=True):
                x += closing
                if ids and count + len(x) // 2 > limit:
                    yield close()
                ids.append(i)
                held.append(x)
                count += len(x) // 2
        if ids:
            yield close()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the edges come from a scan of the ids alone; a range partitioning by Spark would scan the texts for its sample
    edges = rows.select(F.col("doc_id").cast("double").alias("d")).stat.approxQuantile("d", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e <= F.col("doc_id").cast("double"))), F.lit(0)) if edges else F.lit(0)
    ordered = rows.repartitionById(n, place.cast("int")).sortWithinPartitions("doc_id", "text")
    files = cut(arrow_map(ordered, run, "shard long, part long, path string, n_docs long, n_tokens long"), "shards")
    before, bases = 0, []
    for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        bases.append((r.shard, before))
        before += r.n
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(F.broadcast(spark.createDataFrame(bases, "shard long, base long")), "shard").withColumn("start", F.col("base") + within).drop("base")


def read_shards(files: DataFrame) -> DataFrame:
    """One row per document from the files: (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(read_file(path))
                tokens, ends = shard.tokens(), np.cumsum(shard.sizes, dtype=np.int64)
                starts = ends - shard.sizes
                crc = [zlib.crc32(tokens[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + start), pa.array(shard.sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = spread_files(files.select("path", "start"))
    return arrow_map(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
