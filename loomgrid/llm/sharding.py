"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table

SHARDS = 24
#: Groups below a shard's mean size divided by this travel in chunks of about that size.
GRAIN = 512


class CapacityTree:
    """Open bins in a balanced search tree (a treap with seeded priorities), keyed by remaining capacity, then bin."""

    def __init__(self) -> None:
        self.root: list | None = None
        self._state = 42

    def _priority(self) -> int:
        self._state = (self._state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return self._state >> 33

    def _split(self, node, key):
        """Two trees: keys below ``key``, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, remaining: int, bin_id: int) -> None:
        low, high = self._split(self.root, (remaining, bin_id))
        self.root = self._join(self._join(low, [(remaining, bin_id), self._priority(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (remaining, bin) with the least remaining capacity of at least ``size``."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, rest = self._split(self.root, best)
            _, high = self._split(rest, (best[0], best[1] + 1))
            self.root = self._join(low, high)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size; ``sizes`` must fall. None as soon as more than ``most`` bins would open."""
    tree, bins, opened = CapacityTree(), [], 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if most is not None and opened == most:
                return None
            found, opened = (max(capacity, size), opened), opened + 1
        bins.append(found[1])
        tree.add(found[0] - size, found[1])
    return bins


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to ``shards`` - 1 for falling ``sizes``, at the least capacity that best fit needs.

    Items above the mean of what is left get a bin of their own. For the others the
    capacity is found by bisection: the least one at which best fit needs no more bins
    than there are.
    """
    alone, rest = 0, sum(sizes)
    while alone < len(sizes) and alone < shards - 1 and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    tail, left = sizes[alone:], shards - alone
    low, high = max([-(-rest // left), *tail[:1]]), rest + 1
    best, step = None, max(1, low // 4096)
    high = min(high, low + max(tail, default=0) + step)
    while best is None:
        best = best_fit_decreasing(tail, high, left)
        high *= 1 if best is not None else 2
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(tail, middle, left)
        if tried is None:
            low = middle + step
        else:
            high, best = middle, tried
    return [*range(alone), *(alone + b for b in best)]


def shard(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """``docs`` rows as ``doc_id, size, text_crc32, shard, slot`` with near-equal shard sizes.

    A group of equal texts is indivisible. Groups of at least mean/``grain`` bytes are
    items of the packing; there can be at most ``shards * grain`` of them. Smaller
    groups are first gathered, inside hash buckets by a running sum, into chunks of
    about that size, which are items too: at most ``shards * grain`` plus one for each
    bucket, of which there is one for 200,000 groups. So the driver packs a list that is all but
    bounded (half a million short rows for 10^11 groups), no task sums more than a bucket, and a
    shard's size is off by about a chunk. A group above a shard's mean size cannot
    be made equal without splitting it; it gets a shard of its own.

    ``slot`` counts from 0 without gaps inside a shard; it is made from counts of
    hash buckets of each shard, one for half a million rows and 64 at least, so no task numbers a whole shard.

    Null texts have size 8 and the checksum of no bytes; they and empty texts form two
    groups. Null ids and repeated rows are kept and placed like others. Further columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n")), 256))
    base = durable(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key")), "shard-rows")
    groups = durable(base.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    total, n_groups, top = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*"), F.coalesce(F.max("bytes"), F.lit(0))).first()
    least = max(1, total // (shards * grain))
    buckets = max(64, n_groups // 200_000)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    running = F.sum("bytes").over(W.partitionBy("bucket").orderBy(F.desc("bytes"), "key").rowsBetween(W.unboundedPreceding, -1))
    small = groups.where(F.col("bytes") < least).withColumn("bucket", bucket)
    small = small.select("key", "bytes", F.concat_ws(":", "bucket", F.floor(F.coalesce(running, F.lit(0)) / least).cast("string")).alias("item"))
    items = small.unionByName(groups.where(F.col("bytes") >= least).select("key", "bytes", F.hex("key").alias("item")))
    listed = items.groupBy("item").agg(F.sum("bytes").alias("bytes")).toPandas().sort_values(["bytes", "item"], ascending=[False, True])
    bins = pack([int(x) for x in listed["bytes"]], shards)
    placed = spark.createDataFrame(pd.DataFrame({"item": listed["item"].astype(str), "shard": pd.Series(bins, index=listed.index, dtype="int32")}), "item string, shard int")
    where = items.join(placed, "item").select("key", "shard")  # at most 2 * shards * grain + buckets rows; Spark looks at their size
    parts = max(64, base.count() // (shards * 500_000))
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int")
    rows = durable(base.join(where, "key").withColumn("part", part), "shard-placed")
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "part", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    at = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "key")) - 1
    return rows.withColumn("at", at).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def op1_shard_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law asks of the result, by group of equal texts and in all: whole groups, gapless slots, near-equal sizes."""
    docs = table(spark, sf_dir, "documents")
    out = shard(docs)
    groups = docs.join(out, "doc_id").groupBy(F.md5("text").alias("what")).agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("n"))
    per_shard = out.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    near = F.max("bytes") - F.min("bytes") <= F.avg("bytes") * 0.03
    whole = F.bool_and((F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    in_all = per_shard.agg(F.when(near & whole, "all").otherwise("broken").alias("what"), F.count("*").alias("shards"), F.sum("n").alias("n"))
    return groups.unionByName(in_all)


QUERIES = {"op1_shard_bfd": op1_shard_bfd, "shard_law": shard_law}
ORACLE_SQL = {"shard_law": "SELECT md5(text) AS what, 1::BIGINT AS shards, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'all', 24, count(*) FROM documents"}
