"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, durable, n_words, row_key, table, unused

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 42
#: Hash buckets per source: a running sum never needs more than one of them in a task.
BUCKETS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, take ``weights`` in turn and share the
    sum of all sizes. A share above ``max_epochs`` times the source's size is clamped
    there and its excess goes to the others by weight, until none is above. Sorted by
    the level at which each source is full, that is one running sum: the highest level
    that any number of clamped sources leaves for the others is the final one. One row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    filled = weighed.withColumns(
        {
            "total": F.sum("source_size").over(W.partitionBy()).cast("double"),
            "capped": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # clamping too few sources, or too many, leaves less for each open one than clamping the right ones does
    final = F.max("level").over(W.partitionBy())
    return filled.withColumn("final", final).select("source", "source_size", F.least(F.col("cap"), F.coalesce("final", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep: list[Column] | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, repeats, taken`` and ``keep`` for each row of ``docs``.

    Each document is repeated the whole number of times its source's target holds the
    source's size. The rest of the target goes to the documents that come first in a
    seeded order (md5 of seed and doc_id), up to the nearest document boundary: once
    more each. So a source's taken words differ from its target by half a document at
    most, reruns agree, and nothing passes ``max_epochs``. The running sums run in
    4096 hash buckets per source, so a source with a third of all rows spreads.

    Null texts and texts without words have size 0 and take nothing. A null source is
    a source of its own. Null ids are drawn like any other id. Equal rows are
    interchangeable. Further columns are ignored; an empty table gives no rows.
    """
    keep = keep or []
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), drawn.alias("h"), *keep), "mix").withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    goals = targets(by_bucket.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, max_epochs)
    goals = goals.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(0)).cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = by_bucket.withColumn("before", before).drop("in_bucket").alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source")).select("s.source", "bucket", "before", "source_size", "target", "whole", "need")
    kept = [c for c in sized.columns if c not in ("doc_id", "source", "size", "h", "bucket")]
    joined = sized.alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source AND d.bucket = s.bucket")).select("doc_id", "d.source", "size", "h", "d.bucket", "before", "source_size", "target", "whole", "need", *kept)
    earlier = F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    once_more = F.when(F.col("before") + earlier + F.col("size") / 2.0 <= F.col("need"), 1).otherwise(0)
    return joined.withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + once_more).otherwise(0).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), *kept
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` repeats it.

    Rows find their repeats by id, source and a hash of the text; equal rows share
    theirs as evenly as whole rows allow.
    """
    d, h, s, everything, rows, nth, times, copy = unused(docs, "d", "h", "s", "everything", "rows", "nth", "times", "copy")
    key = row_key("source")
    drawn = mix(docs, weights, max_epochs, seed, keep=[c.alias(n) for c, n in zip(key, ("key_d", "key_h", "key_s"))])
    total = drawn.groupBy("key_d", "key_h", "key_s").agg(F.sum("repeats").alias(everything), F.count("*").alias(rows)).where(F.col(everything) > 0).toDF(d, h, s, everything, rows)
    met = docs.select(*columns_of(docs), *[c.alias(n) for c, n in zip(key, (d, h, s))]).join(total, [d, h, s])
    number = F.when(F.col(rows) > 1, F.row_number().over(W.partitionBy(d, h, s).orderBy(F.lit(1)))).otherwise(1)  # dealt out as the join is
    share = (F.floor(F.col(everything) / F.col(rows)) + F.when(F.col(nth) <= F.col(everything) % F.col(rows), 1).otherwise(0)).cast("int")
    counted = met.withColumn(nth, number).withColumn(times, share).where(F.col(times) > 0)
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns_of(docs))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLE_SQL = {
    "op4_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CAST(3 * source_size AS DOUBLE) AS cap FROM r),
f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
               / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(cap, coalesce(max(level) OVER (), 0.0) * weight) AS target FROM f),
t AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS need,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN earlier + size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""
}
