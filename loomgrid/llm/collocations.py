"""Phrases of two to four words that stand together more often than their parts do.

1. Tasks number the words of their chunks of text (``chunks``); words are summed over the corpus.
2. Words that occur often enough get dense ids of four bytes. They come back to the chunks
   by a join, and the streams break at all other words: no phrase with a rare word can be frequent.
3. Every place of a stream gives one key of 16 bytes: the ids of up to four words from there on, zeros after a
   break. A chunk sorts its keys and counts runs; keys are then range-partitioned over the
   corpus and sorted by Spark, whose sorter orders their first eight bytes by radix.
4. Sorted partitions stream by: runs that agree in two, three or four ids are the phrases, so one
   key serves all lengths. Runs that touch a partition's end are summed once more.
5. Parts of phrases are phrases or words of the same table: scores are equi-joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chunks
from .common import durable, table

#: Least number of occurrences, longest phrase, share (in hundredths) at which a longer phrase absorbs, rows a language.
MIN_COUNT, MAX_WORDS, ABSORB, TOP = 30, 4, 80, 2000
_KEYS = "hi long, lo long, n long"
_HALF = np.int64((1 << 32) - 1)


def _runs(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    new = np.ones(len(hi), dtype=bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return np.nonzero(new)[0]


def keys_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys of a stream of ids (0: break), and how often each occurs; places without a second word have none."""
    n = len(ids)
    z = np.concatenate([ids.astype(np.int64), np.zeros(MAX_WORDS - 1, dtype=np.int64)])
    at = np.nonzero((z[:n] > 0) & (z[1 : n + 1] > 0))[0]
    third = z[at + 2]
    hi, lo = (z[at] << 32) | z[at + 1], (third << 32) | np.where(third > 0, z[at + 3], 0)
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = _runs(hi, lo)
    return hi[first], lo[first], np.diff(np.append(first, len(hi)))


def _keys(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """Keys of one chunk; ``found``: number and id of its frequent words."""
    out = []
    for packed in chunk.column("stream").to_pylist():
        stream = chunks.unpack(packed, np.uint32)
        ids = np.zeros(int(stream.max(initial=0)) + 1, dtype=np.int64)
        ids[found.column("number").to_numpy()] = found.column("id").to_numpy()
        out.append(pa.table(dict(zip(("hi", "lo", "n"), keys_of(ids[stream])))))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("hi", "lo", "n")})


def _phrases(least: int):
    """Runs of a sorted partition as ``size, hi, lo, n``: those that occur often enough, and any that touch an end of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {k: None for k in (2, 3, 4)}  # size: [hi, lo, n, whether it began the partition]
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, n = (batch.column(i).to_numpy() for i in range(3))
            sums = np.concatenate([[0], np.cumsum(n)])
            for size in (2, 3, 4):
                low = {2: np.zeros_like(lo), 3: lo & ~_HALF, 4: lo}[size]
                first = _runs(hi, low)
                a, b, total = hi[first], low[first], np.diff(sums[np.append(first, len(hi))])
                edge = np.zeros(len(first), dtype=bool)
                edge[0] = not begun
                if (kept := open_[size]) is not None:
                    if (kept[0], kept[1]) == (a[0], b[0]):
                        total[0] += kept[2]
                        edge[0] = kept[3]
                    else:
                        a, b, total, edge = np.append(kept[0], a), np.append(kept[1], b), np.append(kept[2], total), np.append(kept[3], edge)
                open_[size] = [a[-1], b[-1], total[-1], edge[-1]]
                full = (edge | (total >= least))[:-1] & _whole(b[:-1], size)
                if full.any():
                    yield _batch(size, a[:-1][full], b[:-1][full], total[:-1][full])
            begun = True
        for size, kept in open_.items():
            if kept is not None and _whole(np.array([kept[1]]), size)[0]:
                yield _batch(size, *(np.array([x]) for x in kept[:3]))

    return run


def _whole(lo: np.ndarray, size: int) -> np.ndarray:
    """Whether keys have words in all ``size`` places."""
    return np.ones(len(lo), dtype=bool) if size == 2 else (lo >> 32 if size == 3 else lo & _HALF) > 0


def _batch(size: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), size, dtype=np.int32)), *(pa.array(x.astype(np.int64)) for x in (hi, lo, n))], names=["size", "hi", "lo", "n"])


def _key(ids: Column) -> list[Column]:
    """Both halves of the key of an array of one to four ids."""
    part = [F.coalesce(F.get(ids, F.lit(i)), F.lit(0).cast("long")) for i in range(MAX_WORDS)]
    return [F.shiftleft(part[0], 32).bitwiseOR(part[1]), F.shiftleft(part[2], 32).bitwiseOR(part[3])]


def _exact(a: str) -> Column:
    return F.col(a).cast("decimal(20,0)")


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, absorb: int = ABSORB, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases of ``docs`` (text, lang).

    a, l, r: occurrences of a phrase and of the two parts of its weakest cut (least
    floor(2000000 a / (l + r)), the earliest of equals); n: all words of the language. A phrase inside a
    longer one that has ``absorb`` hundredths of its occurrences is left out. All counts are of the whole corpus, in whole
    numbers. Null languages are ``und``; null and empty texts have no words, and
    repeated rows count each. Words of any length are taken whole. An empty table, or
    one without phrases of ``min_count`` occurrences, gives no rows.
    """
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("mark"), F.coalesce("lang", F.lit("und")).alias("part"), "text")
    held = chunks.encoded(rows, chunks.pieces)
    met = chunks.dictionary(held)
    often = met.groupBy("part", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    known = chunks.numbered(often, "frequent-words")
    ids = met.select("chunk", "part", "number", "word").join(known.select("part", "word", "id"), ["part", "word"]).select("chunk", "number", "id")
    keys = durable(held.select("chunk", "stream").groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_keys, _KEYS), "phrase-keys")
    ranged = keys.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo")
    counted = ranged.mapInArrow(_phrases(min_count), "size int, hi long, lo long, n long").groupBy("size", "hi", "lo").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    found = durable(counted, "phrases").withColumn(
        "ids", F.slice(F.array(F.shiftright("hi", 32), F.col("hi").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("lo", 32), F.col("lo").bitwiseAND(F.lit((1 << 32) - 1))), F.lit(1), F.col("size"))
    )
    parts = found.select("hi", "lo", F.col("a").alias("f")).unionByName(known.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "f"))

    inner = [(i, k) for k in (2, 3) for i in range(1, MAX_WORDS - k + 2)]
    within = found.where("size > 2").select("a", F.explode(F.array(*[F.when((F.lit(i + k - 1) <= F.col("size")) & (F.lit(k) < F.col("size")), F.slice("ids", i, k)) for i, k in inner])).alias("sub")).where("sub IS NOT NULL")
    longer = within.groupBy(*[c.alias(n) for c, n in zip(_key(F.col("sub")), ("hi", "lo"))]).agg(F.max("a").alias("longer"))
    kept = found.join(longer, ["hi", "lo"], "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * absorb)).drop("longer")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    (h1, l1), (h2, l2) = _key(F.slice("ids", F.lit(1), F.col("k"))), _key(F.slice("ids", F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = cuts.select("hi", "lo", "ids", "a", "k", h1.alias("h1"), l1.alias("l1"), h2.alias("h2"), l2.alias("l2"))
    cuts = cuts.join(parts.toDF("h1", "l1", "l"), ["h1", "l1"]).join(parts.toDF("h2", "l2", "r"), ["h2", "l2"])
    score = F.expr("CAST((CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + r) AS LONG)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("hi", "lo").agg(F.first("ids").alias("ids"), F.first("a").alias("a"), weakest)
    scored = scored.withColumn("id", F.col("ids")[0]).join(known.select("id", F.col("part").alias("lang")), "id").select("lang", "ids", "a", "cut.score", "cut.l", "cut.r")
    # rows beyond the first `top`, ties apart, go before words are looked up
    order = [F.desc("score"), F.desc("a")]
    best = scored.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    for i in range(MAX_WORDS):
        best = best.withColumn("id", F.get("ids", F.lit(i))).join(known.select("id", F.decode("word", "UTF-8").alias(f"w{i}")), "id", "left").drop("id")
    named = best.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(MAX_WORDS)]))
    total = held.groupBy(F.col("part").alias("lang")).agg(F.sum("n_words").alias("n"))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of all documents, by language."""
    return phrases(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLE_SQL = {
    "op12_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, doc, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), 1) AS no FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, ws[i:i + k - 1] AS ids, count(*) AS f
      FROM t, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 30),
s AS (SELECT lang, f AS longer, unnest(list_concat(
        CASE WHEN k > 2 THEN [ids[j:j + 1] FOR j IN range(1, k)] ELSE [] END,
        CASE WHEN k > 3 THEN [ids[j:j + 2] FOR j IN range(1, k - 1)] ELSE [] END)) AS sub FROM c),
m AS (SELECT lang, array_to_string(sub, ' ') AS phrase, max(longer) AS longer FROM s GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE m.longer IS NULL OR 100 * CAST(m.longer AS HUGEINT) < 80 * CAST(c.f AS HUGEINT)),
u AS (SELECT lang, phrase, ids, k, f, unnest(range(1, k)) AS cut FROM o),
x AS (SELECT u.lang, u.phrase, u.f AS a, cut, l.f AS l, r.f AS r, CAST((2000000 * CAST(u.f AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
      FROM u JOIN g l ON l.lang = u.lang AND l.k = cut AND l.phrase = array_to_string(u.ids[1:cut], ' ')
             JOIN g r ON r.lang = u.lang AND r.k = u.k - cut AND r.phrase = array_to_string(u.ids[cut + 1:u.k], ' ')),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM x),
z AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y WHERE place = 1)
SELECT z.lang, CAST(z.rank AS BIGINT) AS rank, z.phrase, z.a, z.l, z.r, n.n, z.score FROM z JOIN n USING (lang) WHERE z.rank <= 2000"""
}
