"""Mixing: water-filling against a plain loop, sampling against its law, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import mixing


def fill(sizes: list[int], weights: list[float], epochs: int) -> list[float]:
    """Clamp what is above its cap, share the rest again, until nothing is above."""
    caps, fixed = [epochs * s for s in sizes], {}
    while True:
        rest = sum(sizes) - sum(fixed.values())
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > caps[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: caps[i] for i in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 5, 40, 300, 9000]) * rnd.randrange(1, 9) for _ in range(1 + seed * 7)]
    names = [f"s{i:03d}" for i in range(len(sizes))]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    want = fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 3)
    assert [got[n] for n in names] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes))


def documents(spark, n=600):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["a", "b", "c", "d", "d", "d", None])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_words_come_near_the_target(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 600 and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)


def test_mixed_rows_follow_the_repeats(spark):
    docs = documents(spark, 200).withColumn("extra", F.lit(7))
    docs = docs.unionByName(docs.where("doc_id < 20"))
    wanted = {r["doc_id"]: r["n"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("repeats").alias("n")).where("n > 0").collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == wanted


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, " \t\n", None), (3, "x y", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == 5 and sum(r["size"] for r in out) == 2
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
