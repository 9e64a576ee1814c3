"""Collaborative, content-based and mixed recommendation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mnemospark.operators.windows import top_per_key
from mnemospark.plans.lineage import cut

#: Users are compared as rows of a matrix if there are at most so many items; the executors get parts of so many numbers.
ITEMS, PART = 1024, 1 << 22
#: Rows and columns of similarities that a task computes together.
TALL, WIDE = 256, 2048


def similarities(ratings: DataFrame, by: str, over: str, metric: str = "cosine") -> DataFrame:
    """(a, b, sim) of pairs of ``by`` that share an ``over``, sim > 0; both directions.

    Cosine divides by whole norms; Pearson uses the shared keys alone, two at least.
    Each pair is summed once, the lesser key first, and turned around afterwards.
    """
    x = ratings.select(F.col(by).alias("a"), F.col(over).alias("o"), F.col("rating").alias("x"))
    y = ratings.select(F.col(by).alias("b"), F.col(over).alias("o"), F.col("rating").alias("y"))
    pairs = x.join(y, "o").where("a < b").groupBy("a", "b")
    if metric == "pearson":
        # corr itself fails on a constant row under ANSI rules
        sim = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
        found = pairs.agg(sim.alias("sim"), F.count("*").alias("n")).where(F.col("n") >= 2)
        return _both_ways(found.select("a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim")).where("sim > 0"))
    norms = ratings.groupBy(F.col(by).alias("k")).agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"))
    na, nb = norms.select(F.col("k").alias("a"), F.col("norm").alias("na")), norms.select(F.col("k").alias("b"), F.col("norm").alias("nb"))
    found = pairs.agg(F.sum(F.col("x") * F.col("y")).alias("dot")).join(na, "a").join(nb, "b")
    return _both_ways(found.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("sim")).where("sim > 0"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(ends).alias("p"), "sim").select("p.a", "p.b", "sim")


def user_based(ratings: DataFrame, neighbours: int = 20, metric: str = "cosine", digits: int = 9) -> DataFrame:
    """(user_id, item_id, score, confidence) for unseen items: sum of similarity times rating over the nearest users.

    A user rates an item once; rows with a null are left out. Joining users by their items
    makes as many rows as pairs of users for every item that all rate, so ratings of few
    items are compared as a matrix instead, with the same neighbours.
    """
    ratings = cut(ratings.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).dropna(), "ratings")
    items = [r[0] for r in ratings.select("item_id").distinct().limit(ITEMS + 1).collect()]
    # sums of whole numbers are exact in any order, as Pearson's differences of sums need
    whole = metric == "cosine" or ratings.where("rating <> round(rating) or abs(rating) > 1000000").isEmpty()
    if len(items) <= ITEMS and whole and isinstance(ratings.schema["user_id"].dataType, IntegralType):
        unseen = _by_matrix(ratings, sorted(items), neighbours, metric, digits)
    else:
        sim = similarities(ratings, "user_id", "item_id", metric).withColumn("sim", F.round("sim", digits)).where("sim > 0")
        near = top_per_key(sim, ["a"], [F.desc("sim"), F.asc("b")], neighbours)
        others = ratings.select(F.col("user_id").alias("b"), "item_id", "rating")
        score = near.join(others, "b").groupBy(F.col("a").alias("user_id"), "item_id").agg(F.sum(F.col("sim") * F.col("rating")).alias("score"))
        unseen = score.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return unseen.withColumn("confidence", F.least(F.lit(1.0), F.col("score") / 5.0))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` in whole units of the last digit, halves up as Spark rounds the shortest decimals of doubles."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return out.astype(np.int64)


class Rows:
    """Users' ratings as rows over all items, with what similarities need."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, rating: np.ndarray, items: int, metric: str) -> None:
        of = np.repeat(np.arange(len(sizes)), sizes)
        self.x = np.zeros((len(sizes), items))
        self.x[of, at] = rating
        if metric == "pearson":
            self.has = np.zeros_like(self.x)
            self.has[of, at] = 1
            self.square = self.x * self.x
        else:
            self.norm = np.sqrt((self.x * self.x).sum(1))

    def part(self, low: int, high: int) -> Rows:
        out = object.__new__(Rows)
        out.__dict__ = {k: v[low:high] for k, v in self.__dict__.items()}
        return out

    def similarities(self, other: Rows) -> np.ndarray:
        """Of each row with each row of ``other``; not a number, or 0, where there is none."""
        with np.errstate(invalid="ignore", divide="ignore"):
            if hasattr(self, "norm"):
                return self.x @ other.x.T / (self.norm[:, None] * other.norm)
            n, sx, sy = self.has @ other.has.T, self.x @ other.has.T, self.has @ other.x.T
            spread = (n * (self.square @ other.has.T) - sx * sx) * (n * (self.has @ other.square.T) - sy * sy)
            return np.where((n >= 2) & (spread > 0), (n * (self.x @ other.x.T) - sx * sy) / np.sqrt(spread), 0.0)


def nearest_rows(mine: Rows, other: Rows, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, rows of ``other``) of the k nearest to each row, by rounded similarity above 0 and then first; units are 0 where there are fewer."""
    m, n, unit = len(mine.x), len(other.x), 10.0**-digits
    best, which = np.zeros((m, k), np.int64), np.full((m, k), n, np.int64)
    for low in range(0, m, TALL):
        some = mine.part(low, low + TALL)
        top, of = best[low : low + TALL], which[low : low + TALL]
        for at in range(0, n, WIDE):
            s = some.similarities(other.part(at, at + WIDE))
            # a later row must be nearer than the last of those found, as ties go to the first
            least = (top[:, -1:] + 0.49) * unit
            hit = s >= least
            if hit.sum() > 4 * k * len(s) and s.shape[1] > k:
                usable = np.where(s == s, s, -1.0)
                hit = s >= np.maximum(least, np.partition(usable, -k, axis=1)[:, -k, None] - 2 * unit)
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            found = rounded(s[r, c], digits)
            changed = np.unique(r)
            rows = np.concatenate((np.repeat(changed, k), r))
            units, at_ = np.concatenate((top[changed].ravel(), found)), np.concatenate((of[changed].ravel(), c + at))
            order = np.lexsort((at_, -units, rows))
            rows = rows[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = place < k
            top[rows[kept], place[kept]], of[rows[kept], place[kept]] = units[order][kept], at_[order][kept]
    return best, which


def _by_matrix(ratings: DataFrame, items: list, k: int, metric: str, digits: int) -> DataFrame:
    """(user_id, item_id, score) of unseen items.

    Users of equal ratings are one class, named by its least user; each class is compared
    with all classes. A list holds the first k + 1 users for a class. Users of a class
    have seen the same items, so its own users add nothing to scores, and a user who is in
    the list counts all of it, any other the first k.
    """
    spark = ratings.sparkSession
    known = spark.createDataFrame([(x, i) for i, x in enumerate(items)], f"item_id {ratings.schema['item_id'].dataType.simpleString()}, at int")
    pairs = F.array_sort(F.collect_list(F.struct("at", "rating")))
    packed = ratings.join(F.broadcast(known), "item_id").groupBy("user_id").agg(pairs.alias("v")).select("user_id", "v.at", "v.rating")
    packed = cut(packed, "packed")
    classes = cut(packed.groupBy("at", "rating").agg(F.min("user_id").cast("long").alias("c")), "classes")
    users = cut(packed.join(classes, ["at", "rating"]).select("user_id", "c"), "users")
    count = classes.count()
    parts = max(1, -(-count * len(items) // PART))
    tasks = max(1, min(-(-count // TALL), 4 * spark.sparkContext.defaultParallelism))
    left = classes.select("c", "at", "rating").repartition(tasks)
    width = len(items)

    def rows_of(at: pa.ListArray, rating: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (at.value_lengths().to_numpy(zero_copy_only=False), at.flatten().to_numpy(zero_copy_only=False), rating.flatten().to_numpy(zero_copy_only=False))

    def compared(part: int) -> DataFrame:
        some = classes.where(F.pmod(F.xxhash64("c"), F.lit(parts)) == part).orderBy("c").select("c", "at", "rating").toArrow().combine_chunks()  # at most about PART numbers
        c, at, rating = (x.combine_chunks() for x in some.columns)
        sent = spark.sparkContext.broadcast((c.to_numpy(), *rows_of(at, rating)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, *rest = sent.value
            other = Rows(*rest, width, metric)
            for b in batches:
                mine = Rows(*rows_of(b.column(1), b.column(2)), width, metric)
                units, which = nearest_rows(mine, other, k + 1, digits)
                row, place = np.nonzero(units > 0)
                own = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(names[which[row, place]]), pa.array(units[row, place])], ["c", "other", "units"])

        return left.mapInArrow(run, "c long, other long, units long")

    near = top_per_key(reduce(DataFrame.unionByName, map(compared, range(parts))), ["c"], [F.desc("units"), F.asc("other")], k + 1)
    first = top_per_key(users, ["c"], [F.asc("user_id")], k + 1).select(F.col("c").alias("other"), F.col("user_id").alias("b"))
    listed = cut(top_per_key(near.join(first, "other"), ["c"], [F.desc("units"), F.asc("b")], k + 1, rank="n"), "near")
    theirs = classes.select(F.col("c").alias("other"), F.col("at").alias("at_b"), "rating")
    fresh = listed.where("c <> other").join(theirs, "other").join(classes.select("c", "at"), "c")
    fresh = fresh.select("c", "n", (F.col("units") / F.lit(10.0**digits)).alias("sim"), "at_b", "rating", F.explode(F.array_except("at_b", "at")).alias("at"))
    part = F.col("sim") * F.element_at("rating", F.array_position("at_b", F.col("at")).cast("int"))
    scores = fresh.groupBy("c", "at").agg(F.sum(part).alias("all"), F.sum(F.when(F.col("n") <= k, part)).alias("some"))
    within = listed.where("c = other").select(F.col("b").alias("user_id"), F.lit(True).alias("within"))
    score = F.when(F.col("within"), F.col("all")).otherwise(F.col("some"))
    out = users.join(within, "user_id", "left").join(scores, "c").select("user_id", "at", score.alias("score")).where("score is not null")
    return out.join(F.broadcast(known), "at").select("user_id", "item_id", "score")


def item_based(ratings: DataFrame, neighbours: int = 10, digits: int = 9) -> DataFrame:
    """(user_id, item_id, score) for unseen items: mean of similarity times rating over the seen items near them."""
    sim = similarities(ratings, "item_id", "user_id").withColumn("sim", F.round("sim", digits))
    near = top_per_key(sim, ["a"], [F.desc("sim"), F.asc("b")], neighbours)
    seen = ratings.select("user_id", F.col("item_id").alias("a"), "rating")
    score = seen.join(near, "a").groupBy("user_id", F.col("b").alias("item_id")).agg(F.avg(F.col("sim") * F.col("rating")).alias("score"))
    return score.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def content_based(ratings: DataFrame, features: DataFrame, seen: bool = True) -> DataFrame:
    """(user_id, item_id, score): cosine of a user's rating-weighted feature mean and each item's features (item_id, feature, weight).

    Only items that share a feature with the user score; ``seen`` keeps items that the user rated.
    """
    size = features.groupBy("item_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    unit = features.join(size, "item_id").select("item_id", "feature", (F.col("weight") / F.col("n")).alias("w"))
    profile = ratings.join(unit, "item_id").groupBy("user_id", "feature").agg(F.sum(F.col("w") * F.col("rating")).alias("p"))
    length = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("m"))
    score = profile.join(unit, "feature").groupBy("user_id", "item_id").agg(F.sum(F.col("p") * F.col("w")).alias("d"))
    out = score.join(length, "user_id").select("user_id", "item_id", (F.col("d") / F.col("m")).alias("score"))
    return out if seen else out.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def mixed(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """(user_id, item_id, score): weighted sum of several scores."""
    frames = [df.select("user_id", "item_id", (F.col("score") * w).alias("score")) for w, df in parts]
    return reduce(DataFrame.unionByName, frames).groupBy("user_id", "item_id").agg(F.sum("score").alias("score"))


def diversified(candidates: DataFrame, k: int, tradeoff: float = 0.3, pool: int = 30) -> DataFrame:
    """Maximal marginal relevance per user over (user_id, item_id, score, category): score less the share of chosen items of the category.

    The greedy choice folds over a user's pool, at most ``pool`` rows, inside one expression.
    """
    best = top_per_key(candidates, ["user_id"], [F.desc("score"), F.asc("item_id")], pool)
    packed = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id", "category"))).alias("pool"))

    def gain(row: Column, chosen: Column) -> Column:
        same = F.size(F.filter(chosen, lambda c: c["category"] == row["category"])) / F.greatest(F.lit(1), F.size(chosen))
        return -row["s"] * (1 - tradeoff) - same * tradeoff

    def step(chosen: Column, i: Column) -> Column:
        rest = F.filter("pool", lambda r: ~F.exists(chosen, lambda c: c["item_id"] == r["item_id"]))
        ranked = F.array_sort(F.transform(rest, lambda r: F.struct(F.round(-gain(r, chosen), 9).alias("g"), r["item_id"].alias("item_id"), r.alias("r"))))
        return F.when(F.size(ranked) > 0, F.concat(chosen, F.array(ranked[0]["r"]))).otherwise(chosen)

    empty = F.filter("pool", lambda r: F.lit(False))
    out = packed.select("user_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, step).alias("chosen"))
    return out.select("user_id", F.posexplode("chosen").alias("place", "c")).select("user_id", F.col("c.item_id").alias("item_id"), (F.col("place") + 1).alias("place"))


def assigned(users: DataFrame, experiment: str, shares: dict[str, float], user: str = "user_id") -> DataFrame:
    """``users`` with variant, by a hash of experiment and user, so an assignment sticks."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{experiment}:"), F.col(user).cast("string"))), 1, 6), 16, 10).cast("long") / 16777216.0
    out, upto = F.when(F.lit(False), ""), 0.0
    for name, share in shares.items():
        upto += share
        out = out.when(bucket < upto, name)
    return users.withColumn("variant", out)
