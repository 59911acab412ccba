"""Benchmark decontamination through a distributed positional inverted index.

Built from DataFrame functions only. Steps:

1. One pass over the documents counts every term of the benchmark. For each 10-word window of an item
   the rarest positions become anchors, one more than words may be missing, so one is in place in any match.
   Terms that don't occur are the rarest and surely missing; a window with too many is dropped. Of equal windows of an item one counts.
2. A second pass stores the index of the rarest terms: a posting (term, document, position, surroundings)
   for each occurrence of an anchor's term. The surroundings are four bits of a hash of each of the eight words at either side.
3. Anchor postings, shifted back by the anchor's offset in the item, name the start
   that the item would have in the document. Enough of the surrounding words must agree with the item's at their own
   offsets: this intersects the lists of all terms of a window without moving a posting. An occurrence always passes.
4. Surviving starts name the word that each position of the document should have, within the windows that their anchors stand for. A join
   with the words of those documents leaves the ones in place: windows that are whole give the
   hits, windows with most words in place give proximity matches. No row holds more than a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, durable, row_key, table, unused

WINDOW = 10
#: Words of a window that must be in place for a proximity match.
NEAR = 8
#: Above this many distinct benchmark terms the index is built by a shuffled join.
BROADCAST_TERMS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII that isn't part of a word.
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Words at either side of a posting that its surroundings hold, four bits each.
REACH = 8


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case: one translation turns all gaps into spaces, which is far cheaper than an expression."""
    return F.array_remove(F.split(F.translate(text, _UPPER + _GAPS, _LOWER + " " * len(_GAPS)), " "), "")


def _document_key() -> list[Column]:
    """``d, h``: see ``row_key``."""
    d, h = row_key()
    return [d.alias("d"), h.alias("h")]


def _items(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, words`` for each different benchmark text with a word; to be written down, as ``item`` follows the partitions."""
    named = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    return named.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).select(F.monotonically_increasing_id().alias("item"), "item_id", "words")


def occurrences(docs: DataFrame, terms: DataFrame, around: bool = False) -> DataFrame:
    """``term, d, h, pos`` for each occurrence of a word in ``terms`` (word, term), and its ``around`` if asked for."""
    flat = docs.where("text IS NOT NULL").select(*_document_key(), words_of(F.col("text")).alias("words")).select("d", "h", "words", F.posexplode("words").alias("pos", "word"))
    more = [_around(F.col("words"), F.col("pos")).alias("around")] if around else []
    if terms.count() <= BROADCAST_TERMS:
        return flat.join(F.broadcast(terms), "word").select("term", "d", "h", "pos", *more)
    return flat.select("d", "h", "pos", "word", *more).join(terms, "word").select("term", "d", "h", "pos", *["around"] * around)  # no row takes its document along


def _around(words: Column, at: Column) -> Column:
    """Four bits of a hash of each word from eight before to eight after a place, the place itself left out; where there is no word, zeros."""
    out = F.lit(0).cast("long")
    for k, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        bits = F.coalesce(F.xxhash64(F.get(words, at + step)).bitwiseAND(F.lit(15)) * F.get(words, at + step).isNotNull().cast("long"), F.lit(0))
        out = out.bitwiseOR(F.shiftleft(bits, 4 * k))
    return out


def _inside(words: Column, at: Column) -> Column:
    """A one in the lowest of those four bits for each word that there is."""
    out = F.lit(0).cast("long")
    for k, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        out = out.bitwiseOR(F.shiftleft(((at + step >= 0) & (at + step < F.size(words))).cast("long"), 4 * k))
    return out


def _agreeing(a: Column, b: Column, inside: Column) -> Column:
    """How many of the four-bit groups that ``inside`` names are equal."""
    x = a.bitwiseXOR(b)
    for shift in (1, 2):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(F.bitwise_not(x).bitwiseAND(inside))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``term, d, h, pos, around`` for each occurrence of a word in ``terms`` (word, term)."""
    return occurrences(docs, terms, around=True)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``item, s`` of each different window of each item: of equal ones, the first. What has one has all of them."""
    width = F.least(F.lit(window), F.size("words"))
    placed = items.select("item", "words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("s"))
    content = F.array_join(F.slice("words", F.col("s") + 1, F.col("width")), " ")
    return placed.groupBy("item", content.alias("content")).agg(F.min("s").alias("s")).select("item", "s")


def _anchors(placed: DataFrame, windows: DataFrame, counts: DataFrame, window: int, near: int) -> DataFrame:
    """``term, item, off, around, inside, wanted, low, high`` of the rarest positions of each window that can match at all: one more than may be missing.

    ``wanted``: surrounding words that agree in any match; ``low`` and ``high``: the first and last word of the windows that the position stands for.
    """
    width = F.least(F.lit(window), F.col("n"))
    least = F.ceil(width * near / window)
    starts = placed.join(counts, "term", "left").withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - width + 1), F.least(F.col("off"), F.col("n") - width)))).join(windows, ["item", "s"])
    by = W.partitionBy("item", "s")
    live = starts.withColumn("known", F.count("df").over(by)).where(F.col("known") >= least)
    rarest = live.withColumn("rk", F.row_number().over(by.orderBy(F.asc_nulls_first("df"), "off"))).where(F.col("rk") <= width - least + 1)
    unseen = F.greatest(F.lit(0), width - 1 - REACH)  # a window's words further away than the surroundings reach
    named = rarest.where("df IS NOT NULL").select("term", "item", "off", "around", "inside", (least - 1 - unseen).alias("wanted"), "s", (F.col("s") + width - 1).alias("end"))
    return named.groupBy("term", "item", "off", "around", "inside", "wanted").agg(F.min("s").alias("low"), F.max("end").alias("high"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """``d, h, n_hit, items, n_near`` of each document (see ``_document_key``) with a surviving start."""
    docs = docs.select("doc_id", "text")
    items = durable(_items(benchmark), "items")
    flat = items.select("item", F.size("words").alias("n"), "words", F.posexplode("words").alias("off", "word"))
    terms = durable(flat.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    placed = flat.join(terms, "word").select("item", "n", "off", "term", _around(F.col("words"), F.col("off")).alias("around"), _inside(F.col("words"), F.col("off")).alias("inside"))
    flat = flat.drop("words")
    counts = durable(occurrences(docs, terms).groupBy("term").agg(F.count("*").alias("df")), "counts")
    anchors = durable(_anchors(placed, _windows(items, window), counts, window, near), "anchors")
    index = durable(postings(docs, terms.join(anchors.select("term").distinct(), "term", "left_semi")), "postings")
    agreed = _agreeing(F.col("p.around"), F.col("a.around"), F.col("inside"))
    started = index.alias("p").join(anchors.alias("a"), "term").where(agreed >= F.col("wanted")).select("d", "h", "item", (F.col("pos") - F.col("off")).alias("start"), F.struct("low", "high").alias("span"))
    starts = durable(started.groupBy("d", "h", "item", "start").agg(F.collect_set("span").alias("spans")), "starts")  # of one item's windows

    # both sides grow with the documents: never broadcast
    texts = docs.where("text IS NOT NULL").select(*_document_key(), "text").join(starts.select("d", "h").distinct().hint("merge"), ["d", "h"], "left_semi").dropDuplicates(["d", "h"])
    words = texts.select("d", "h", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    offs = F.explode(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x.low, x.high))))).alias("off")
    expected = starts.select("d", "h", "item", "start", offs).join(flat, ["item", "off"]).withColumn("pos", F.col("start") + F.col("off")).where("pos >= 0")
    placed = expected.join(words.hint("merge"), ["d", "h", "pos", "word"]).select("d", "h", "item", "start", "n", "off", "pos")
    width = F.least(F.lit(window), F.col("n"))
    ahead = W.partitionBy("d", "h", "item", "start").orderBy("off").rangeBetween(0, window - 1)
    held = placed.withColumn("held", F.count("*").over(ahead)).where(F.col("held") >= F.ceil(width * near / window))
    held = durable(held.select("d", "h", "item", "pos", width.alias("width"), (F.col("held") == width).alias("exact")), "held")
    found = held.join(items.select("item", "item_id"), "item").groupBy("d", "h").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.count_distinct("item_id").alias("n_near"))
    hit = held.where("exact").select("d", "h", F.explode(F.sequence("pos", F.col("pos") + F.col("width") - 1)).alias("at")).distinct().groupBy("d", "h").agg(F.count("*").alias("n_hit"))
    return found.join(hit, ["d", "h"], "left").select("d", "h", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "items", "n_near")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """Exact and proximity matches of benchmark windows in each document.

    One row (doc_id, n_words, n_hit, n_items, n_near, items) for each row of ``docs``:
    words, words inside an occurrence of a ``window``-word item window (an item with
    fewer words is one window), items with such a window, items with a window of which
    at least ``near`` in ``window`` words stand in place, and the exact items' ids as
    sorted strings.

    Null and empty texts have no words. Benchmark rows without id or text are ignored;
    an item id with several texts counts once. Repeated document rows, also with one id and
    different texts, are judged apart. Further columns are ignored. An empty benchmark
    hits nothing.
    """
    docs = docs.select("doc_id", "text")
    result = matches(docs, benchmark, window, near)
    counted = docs.select("doc_id", *_document_key(), F.when(F.col("text").isNull(), 0).otherwise(F.size(words_of(F.col("text")))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(result, ["d", "h"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("items", none).alias("items")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs.

    Null and empty texts stay; of repeated rows all go or none; an empty table stays empty, and so does all of
    ``docs`` where the benchmark is empty. Whole texts of any length are searched.
    """
    hit = durable(matches(docs, benchmark, window, near=window).where("n_hit > 0").select("d", "h"), "contaminated")
    d, h = unused(docs, "d", "h")
    own = [c.alias(n) for c, n in zip(_document_key(), (d, h))]
    return docs.select(*columns_of(docs), *own).join(hit.toDF(d, h), [d, h], "left_anti").select(*columns_of(docs))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents; ``n_near`` counts items of which a window has 8 of 10 words in place."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLE_SQL = {
    "op10_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT rid, dw.n, s, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid),
dp AS (SELECT rid, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
ip AS (SELECT iid, item_id, len(w) AS n, unnest(generate_series(1, len(w))) AS o, unnest(w) AS word FROM i WHERE len(w) > 0),
met AS (SELECT rid, iid, item_id, n, count(*) OVER (PARTITION BY rid, iid, p - o ORDER BY o RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS held FROM dp JOIN ip USING (word)),
nr AS (SELECT rid, count(DISTINCT item_id) AS n_near FROM met WHERE held >= ceil(least(10, n) * 0.8) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid) LEFT JOIN nr USING (rid)"""
}
