"""Benchmark passages in documents, by SimHash of item-sized windows; built-in functions only.

Words are runs of letters and digits in lower case; WIDTH words make a shingle, and of
two windows the similarity is the sum of the smaller by the sum of the larger of the two
counts of each shingle. An item of A shingles can only reach a similarity of 0.8 to a
window that holds 0.8 A of its shingles, and moving a window's start to the first such
shingle never lowers its similarity. So shingles are looked up among the items', and the
windows that get a fingerprint start at a shared shingle of an item and hold enough of
them; no other window could pass for that item. Window fingerprints meet that item's over
RADIUS + 1 blocks of bits, one of which is equal for every pair within RADIUS; pairs
within RADIUS are then compared exactly. Fingerprints of a pair of similarity 0.8
differ in 10 of 64 bits on average with a deviation of 3, so a RADIUS of 24 is near
five deviations away.

Items shorter than WIDTH words are one shingle of their own width. Tables are broadcast
only up to MOST_BROADCAST bytes, measured first, and joined by shuffles beyond.

Defined results: null or wordless texts and items match nothing; an item that occurs
several times in a text is reported where it is most similar, then first; rows that
repeat an id and a text are reported once; null ids are kept; extra columns are not read
by find_leaks and stay, whatever their names, in without_leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.arrow import column, unused
from mnemospark.plans.lineage import cut

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 24
#: Bytes of a table that is broadcast.
MOST_BROADCAST = 32 << 20
#: Windows that a task fingerprints and compares.
WINDOWS = 2000


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: str, width: int) -> Column:
    """Hash of the shingle at each position of an array of words; empty if there are fewer words."""
    n = F.size(words) - F.lit(width - 1)
    at = F.sequence(F.lit(1), n)
    return F.when(n >= 1, F.transform(at, lambda i: F.xxhash64(*(F.element_at(words, i + F.lit(k)) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def _simhash(hashes: Column, most: int) -> tuple[Column, Column]:
    """Counts of bits, and from them, as _sums, the bits set in over half of the hashes, of which there are ``most`` at most.

    Bits that are ``lane`` apart are counted in one fold, in lanes of one long number.
    """
    lane = next(n for n in (8, 16, 32) if most < 1 << n)
    ones = sum(1 << k for k in range(0, 64, lane))
    shift = lambda h, b: F.call_function("shiftrightunsigned", h, F.lit(b)) if b else h

    def counts(b: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + shift(h, b).bitwiseAND(F.lit(ones)))

    sums = [counts(b) for b in range(lane)]

    def bit(b: int) -> Column:
        count = shift(F.get(F.col("_sums"), F.lit(b % lane)), b - b % lane).bitwiseAND(F.lit((1 << lane) - 1))
        return F.when(count * 2 > F.size(hashes), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for b in range(1, 64):
        out = out.bitwiseOR(bit(b))
    return F.array(*sums).alias("_sums"), out


def _with_print(df: DataFrame, hashes: str, most: int, out: str) -> DataFrame:
    sums, bits = _simhash(F.col(hashes), most)
    return df.withColumn("_sums", sums).withColumn(out, bits).drop("_sums")


def _masks(radius: int) -> list[int]:
    """Bit masks of radius + 1 blocks that cover the 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def _overlap(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller of both counts."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    each = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when(once, F.size(F.array_intersect(a, b))).otherwise(each)


def _near(df: DataFrame, size: int) -> DataFrame:
    """``df``, broadcast if its ``size`` in bytes allows that."""
    return F.broadcast(df) if size <= MOST_BROADCAST else df


def _key(doc_id: str, text: str) -> Column:
    """128 bits that stand for a row's id and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), column(c).cast("string")), F.lit("null"))
    return F.md5(F.concat_ws("\n", part(doc_id), part(text)).cast("binary"))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance, doc_key): one row per text and item that it holds.

    start_word counts words from 0; doc_key is a digest of the document's id and text.
    """
    split = items.select(column(item_id).alias("item_id"), column(item_text).alias("text")).select("item_id", _words("text").alias("words")).where(F.size("words") > 0)
    bench = split.withColumn("n_words", F.size("words")).withColumn("width", F.least("n_words", F.lit(WIDTH)))
    texts = docs.select(column(doc_id).alias("doc_id"), _key(doc_id, text).alias("doc_key"), column(text).alias("text"))
    found = None
    for width in sorted(r.width for r in bench.select("width").distinct().collect()):  # five widths at most
        part = _find(texts, bench.where(F.col("width") == width), width, similarity, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _find(texts, bench, WIDTH, similarity, radius)
    return found


def _find(texts: DataFrame, bench: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    of = cut(bench.select(F.monotonically_increasing_id().alias("item"), "item_id", "n_words", _hashes("words", width).alias("item_hashes")), "items")
    size = of.agg(F.count("*").alias("items"), F.sum(F.size("item_hashes")).alias("hashes"), F.max(F.size("item_hashes")).alias("most")).first()
    n_items, n_hashes, most = size.items, size.hashes or 0, size.most or 1
    sets = of.select(
        F.explode(F.array_distinct("item_hashes")).alias("h"), "item", F.size("item_hashes").alias("a"), F.ceil(F.size("item_hashes") * F.lit(similarity) - 1e-9).cast("int").alias("need")
    )
    shingles = texts.select("doc_id", "doc_key", _words("text").alias("words")).select("doc_id", "doc_key", F.posexplode(_hashes("words", width)).alias("p", "h"))
    at = F.col("at")
    windows = (
        shingles.join(_near(sets, 64 * n_hashes), "h")
        .groupBy("doc_key", "doc_id", "item", "a", "need")
        .agg(F.array_sort(F.collect_set("p")).alias("at"))
        .where(F.size("at") >= F.col("need"))
        # the need-th shared shingle from here on still lies in the window
        .select("doc_key", "doc_id", "item", "a", F.explode(F.filter(at, lambda s, i: F.coalesce(F.get(at, i + F.col("need") - 1) - s < F.col("a"), F.lit(False)))).alias("start_word"))
    )
    windows = cut(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    n_windows = windows.count()
    # as many tasks as windows ask for, whatever their bytes
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, -(-n_windows // WINDOWS)))
    # only texts with a window are split again
    few = texts.join(_near(windows.select("doc_key").distinct(), 64 * n_windows), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    hashed = few.select("doc_key", _words("text").alias("words")).select("doc_key", _hashes("words", width).alias("hashes"))
    held = hashed.join(windows, "doc_key").select("window", "doc_key", "doc_id", "item", "start_word", F.slice("hashes", F.col("start_word") + 1, F.col("a")).alias("held"))
    signed = cut(_with_print(held.repartition(tasks, "window"), "held", most, "print"), "prints")
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(radius)))
    blocks = lambda c: F.posexplode(F.transform(masks, lambda m: F.col(c).bitwiseAND(m))).alias("block", "bits")
    prints = cut(_with_print(of.repartition(max(1, min(tasks, n_items // 100 + 1)), "item"), "item_hashes", most, "item_print").select("item", "item_print"), "item_prints")
    table = prints.select("item", "item_print", blocks("item_print"))
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    near = (
        signed.select("window", "item", "print", blocks("print"))
        .join(_near(table, 48 * n_items * (radius + 1)), ["item", "block", "bits"])
        .where(F.bit_count(differ) <= radius)
        # a pair counts at the first of its equal blocks
        .where(F.array_position(F.transform(masks, lambda m: differ.bitwiseAND(m) == 0), True) == F.col("block") + 1)
        .select("window", F.bit_count(differ).alias("distance"))
    )
    both = signed.join(near, "window").join(_near(of, 8 * n_hashes + 64 * n_items), "item").repartition(tasks, "window")
    pairs = (
        both.withColumn("both", _overlap(F.col("item_hashes"), F.col("held")))
        .withColumn("similarity", F.col("both") / (F.size("item_hashes") + F.size("held") - F.col("both")))
        .where(F.col("similarity") >= similarity - 1e-12)
    )
    best = pairs.groupBy("doc_key", "doc_id", "item_id", "n_words").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), (-F.col("distance")).alias("near"))).alias("best"))
    return best.select(
        "doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"), (-F.col("best.near")).cast("long").alias("distance"), "doc_key"
    )


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **more: object) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    key = unused("__key", docs)
    leaks = cut(find_leaks(docs, items, doc_id, text, **more).select(F.col("doc_key").alias(key)).distinct(), "leaks")
    kept = docs.select("*", _key(doc_id, text).alias(key)).join(_near(leaks, 64 * leaks.count()), key, "left_anti")
    return kept.drop(key)
