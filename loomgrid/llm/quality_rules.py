"""Quality rules: counts of words, symbols and repeats, and bands of zstandard ratios."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

MIN_WORDS = 10
#: Percent of the words that may stand in repeated 5-word windows.
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
LEVEL = 3
CHUNK = 4096
#: Fixed values, limits by length: (bytes below which the row holds, least and most bytes per compressed byte).
#: Short frames compress little whatever they hold, so the lower limit starts late and rises; the upper
#: one lies well above prose of that length and below text that repeats itself.
BANDS = (
    (256, 0.0, 2.5),
    (512, 0.9, 2.9),
    (1024, 1.1, 3.1),
    (2048, 1.15, 3.4),
    (8192, 1.2, 3.8),
    (65536, 1.25, 4.5),
    (float("inf"), 1.25, 6.0),
)
#: Share of a text's chunks that may lie outside the band of their own length.
MAX_BAD_CHUNKS = 0.34
SYMBOLS = b"#*$%&|<>"

COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "ratio": "double",
    "bad_chunks": "double",
}


def _numbered(words: list[bytes]) -> np.ndarray:
    """Numbers for words: equal exactly for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside a ``window``-word run found at least twice, the first one included."""
    if len(words) <= window:
        return 0
    ids = _numbered(words)
    key = ids[: len(ids) - window + 1]
    for k in range(1, window):  # renumbered at each step, so that a key stays exact
        key = np.unique(key * (int(ids.max()) + 1) + ids[k : len(ids) - window + 1 + k], return_inverse=True)[1]
    repeated = np.bincount(key)[key] > 1
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.nonzero(repeated)[0]
    covered[at] += 1
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def within(n_bytes: int, ratio: float) -> bool:
    """Whether a ratio lies in the band of its length."""
    for below, least, most in BANDS:
        if n_bytes < below:
            return least <= ratio <= most
    return True


def bands(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole-text ratio, share of chunks out of band, verdict."""
    if not data:
        return 0.0, 0.0, False
    ratio = len(data) / len(packer.compress(data))
    pieces = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    bad = sum(not within(len(p), len(p) / len(packer.compress(p))) for p in pieces) / len(pieces)
    return ratio, bad, within(len(data), ratio) and bad <= MAX_BAD_CHUNKS


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    continuation = len(joined.translate(None, bytes(range(128, 192))))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    ratio, bad, good = bands(data, packer)
    return n, continuation, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, good and not failed, ratio, bad


def _judge_texts():
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return lambda texts: list(zip(*(judge(t, packer) for t in texts)))


def rules(docs: DataFrame) -> DataFrame:
    """Base counts and the verdict for each row of ``docs`` (doc_id, text), in one pass without a shuffle.

    A text fails the base rules with under 10 words or with more than 20 % of its words
    in repeated 5-word windows. The others are kept if the ratio of their bytes to
    their zstandard frame lies in the band of their length, and so do at least two
    thirds of their 4096-byte chunks, of which the last may be shorter: above the band a text
    repeats itself, below it is noise. Null and empty texts have no words and fail. Null ids, repeated rows and
    very long texts are treated like others; further columns are ignored; an empty table gives no rows.
    """
    return map_texts(docs, ["doc_id"], "text", _judge_texts, COLUMNS)


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return rules(table(spark, sf_dir, "documents"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of the rules alone, which SQL can express."""
    return rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op7_compression_bands": op7_compression_bands, "quality_base_counts": quality_base_counts}
ORACLE_SQL = {
    "quality_base_counts": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT rid, s, array_to_string(w[s : s + 4], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS s FROM d WHERE len(w) > 4)),
r AS (SELECT rid, s FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(s, s + 4)) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, E'\n')) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)"""
}
