"""Language identification by a string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, durable, map_texts, table, unused

#: The kernel counts the n-grams of characters, n = 1 to 3, that two pieces of text share.
ORDERS = (1, 2, 3)
#: Code points of a piece. A text is scored piece by piece, so a passage in another language has its share and no more.
PIECE = 256
#: Bounds of the training sample in rows: different texts of a language, and of all (but one of each language). Whole texts are read.
PER_LANGUAGE, SAMPLE = 300, 4000
#: Bounds of the landmarks: pieces of a language, and of all (but one of each language).
LANDMARKS, ALL_LANDMARKS = 64, 1024
#: Pieces that are looked at at once.
STRETCH = 64
#: Tasks at most that sum the kernel over the sample: the driver adds up so many sums.
TASKS = 12
#: Parts of a language that pick their first texts apart, so no task meets more than so many times a language's quota.
PARTS = 32
RIDGE = 1e-3
UNKNOWN = "und"
#: Below this score a text is in none of the languages.
MIN_SCORE = 0.2
_LETTER = re.compile(r"[^\W\d_]")
_SLOT_BITS = 20


def code_points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, counted from 1, white space and control characters alike."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return np.where(codes < 33, np.uint64(32), codes) + np.uint64(1)


def pieces_of(n: int) -> int:
    """Pieces of a text of ``n`` code points. A last piece of under half the length belongs to the one before."""
    return max(1, (n + PIECE // 2) // PIECE)


def grams(codes: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece and number of each n-gram that starts in pieces ``first`` to ``last`` - 1 of a text; lengths of these pieces.

    An n-gram belongs to the piece it starts in. Its number holds its code points, 21 bits each, so different ones differ.
    """
    n = pieces_of(len(codes))
    last = n if last is None else last
    low, high = first * PIECE, len(codes) if last == n else last * PIECE
    part = codes[low : high + max(ORDERS) - 1]
    piece = np.minimum(np.arange(low, high) // PIECE, n - 1) - first
    where, found, gram = [], [], np.zeros(len(part), dtype=np.uint64)
    for k in ORDERS:
        if len(part) < k:
            break
        gram = (gram[: len(part) - k + 1] << np.uint64(21)) | part[k - 1 :]
        own = gram[: high - low]
        where.append(piece[: len(own)])
        found.append(own)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(where or [none]), np.concatenate(found or [none.astype(np.uint64)]), np.bincount(piece, minlength=last - first)


class Vocabulary:
    """Places of known n-grams: a hash table whose hits are compared, and a search for those that share a slot."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.unique(known)
        self.table = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self.table[self._slots(self.known)] = np.arange(len(self.known))

    @staticmethod
    def _slots(gram: np.ndarray) -> np.ndarray:
        return ((gram ^ (gram >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)

    def places(self, gram: np.ndarray) -> np.ndarray:
        """Place of each n-gram, -1 if it isn't known."""
        at = self.table[self._slots(gram)]
        other = np.flatnonzero(at >= 0)
        other = other[self.known[at[other]] != gram[other]]
        place = np.minimum(np.searchsorted(self.known, gram[other]), len(self.known) - 1)
        at[other] = np.where(self.known[place] == gram[other], place, -1)
        return at


def presence(parts: list[tuple], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the n-grams present in each piece of ``parts`` (as of ``grams``), and the pieces' lengths."""
    rows = np.zeros((sum(len(p[2]) for p in parts), len(vocabulary.known)), dtype=np.float32)
    base = 0
    for where, gram, lengths in parts:
        place = vocabulary.places(gram)
        rows[where[place >= 0] + base, place[place >= 0]] = 1
        base += len(lengths)
    rows /= np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]
    return rows, np.concatenate([p[2] for p in parts])


def stretches(texts: list[str]):
    """Lists of (text's place in ``texts``, part as of ``grams``) that cover all texts, each of a bounded number of pieces."""
    held, size = [], 0
    for i, text in enumerate(texts):
        codes = code_points(text)
        n, at = pieces_of(len(codes)), 0
        while at < n:
            to = min(n, at + STRETCH - size)
            held.append((i, grams(codes, at, to)))
            size, at = size + to - at, to
            if size == STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _chosen_pieces(batches):
    """Sample rows (lang, draw, text) to (lang, draw, grams of one piece): which one, the draw decides."""
    for batch in batches:
        out = []
        for draw, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            codes = code_points(text)
            at = draw % pieces_of(len(codes))
            out.append(np.unique(grams(codes, at, at + 1)[1]).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], names=["lang", "draw", "grams"])


def _sums(classes: list[str], known: np.ndarray, base: np.ndarray):
    """Sample rows (lang, draw, text) of a task to one row: pieces, K'K and K'y over them."""

    def run(batches):
        vocabulary, m = Vocabulary(known), len(base)
        kk, ky, pieces = np.zeros((m, m)), np.zeros((m, len(classes))), 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for held in stretches(batch.column(2).to_pylist()):
                rows, lengths = presence([part for _, part in held], vocabulary)
                k = (rows @ base.T).astype(np.float64)
                y = np.repeat([classes.index(langs[i]) for i, _ in held], [len(part[2]) for _, part in held])
                kk, ky, pieces = kk + k.T @ k, ky + k.T @ np.eye(len(classes))[y], pieces + len(lengths)
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([pieces]), pa.array([kk.tobytes()], pa.binary()), pa.array([ky.tobytes()], pa.binary())], names=["pieces", "kk", "ky"])

    return run


def fit(sampled: DataFrame, ridge: float = RIDGE) -> dict:
    """One-versus-rest kernel ridge regression on Nyström landmarks over all pieces of ``sampled`` (lang, draw, text).

    Landmarks are pieces of the first texts of each language by ``draw``; their n-grams are the
    vocabulary. With K the normalised kernel (shared n-grams over the root of both
    counts), the weights solve (Knm' Knm + ridge n Kmm) a = Knm' y; tasks sum Knm' Knm and Knm' y. Scoring K(x,
    landmarks) a is a product of the piece's row and one matrix, which is folded here once.
    """
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    leading = sampled.select("lang", "draw", "text", nth.alias("nth")).where(F.col("nth") <= LANDMARKS)
    found = leading.select("lang", "draw", "text").mapInArrow(_chosen_pieces, "lang string, draw long, grams array<long>").collect()  # 64 pieces a language
    classes = sorted({r["lang"] for r in found})
    if not classes:
        return {"classes": []}
    most = max(1, ALL_LANDMARKS // len(classes))
    by_lang = {c: sorted((r["draw"], r["grams"]) for r in found if r["lang"] == c)[:most] for c in classes}
    chosen = [np.array(g, dtype=np.int64).view(np.uint64) for c in classes for _, g in by_lang[c]]
    known = np.unique(np.concatenate(chosen))
    base, _ = presence([(np.zeros(len(g), dtype=np.int64), g, np.array([len(g)])) for g in chosen], Vocabulary(known))
    dealt = sampled.select("lang", "draw", "text").repartition(TASKS).sortWithinPartitions("lang", "draw")
    sums = dealt.mapInArrow(_sums(classes, known, base), "pieces long, kk binary, ky binary").collect()  # a row a task, of 12 at most
    kk = sum(np.frombuffer(r["kk"]).reshape(len(base), -1) for r in sums)
    ky = sum(np.frombuffer(r["ky"]).reshape(len(base), -1) for r in sums)
    n, kmm = sum(r["pieces"] for r in sums), (base @ base.T).astype(np.float64)
    weights = np.linalg.solve(kk + ridge * n * kmm + 1e-8 * np.eye(len(base)), ky)
    return {"classes": classes, "known": known, "matrix": (base.T @ weights).astype(np.float32)}


def _predict(model: dict):
    def make():
        vocabulary = Vocabulary(model["known"]) if model["classes"] else None

        def run(texts: list[str | None]) -> list[list]:
            langs: list[str] = [UNKNOWN] * len(texts)
            scores = [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and model["classes"] and _LETTER.search(t)]
            sums, total = np.zeros((len(known), len(model["classes"]))), np.zeros(len(known))
            for held in stretches([texts[i] for i in known]):
                rows, lengths = presence([part for _, part in held], vocabulary)
                to = np.repeat([i for i, _ in held], [len(part[2]) for _, part in held])
                np.add.at(sums, to, (rows @ model["matrix"]) * lengths[:, None])
                np.add.at(total, to, lengths)
            for i, values, chars in zip(known, sums, total):
                best = int(values.argmax())
                langs[i], scores[i] = model["classes"][best], float(min(1.0, max(0.0, values[best] / chars)))
            return [langs, scores]

        return run

    return make


def sample(docs: DataFrame, train: Column) -> DataFrame:
    """Labelled sample of whole texts, bounded in rows: ``lang, draw, text``.

    Different texts of a language come in the order of a hash of the text: ``PER_LANGUAGE`` of each, fewer
    if all were above ``SAMPLE``, but one at least. Copies count once, so nothing grows with them.
    """
    usable = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.abs(F.xxhash64("text")).alias("draw"), "text")
    nth = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy("draw"))
    apart = usable.select("lang", "draw").distinct().withColumn("part", F.pmod(F.shiftright("draw", 8), F.lit(PARTS)))
    first = apart.withColumn("nth", nth("part")).where(F.col("nth") <= PER_LANGUAGE).withColumn("nth", nth()).where(F.col("nth") <= PER_LANGUAGE)
    keys = first.select("lang", "draw", "nth").collect()  # 300 rows a language
    quota = max(1, min(PER_LANGUAGE, SAMPLE // max(1, len({r["lang"] for r in keys}))))
    wanted = [(r["lang"], r["draw"]) for r in keys if r["nth"] <= quota]
    drawn = usable.join(F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, draw long")), ["lang", "draw"])  # bounded by SAMPLE
    return durable(drawn.groupBy("lang", "draw").agg(F.min("text").alias("text")), "language-sample")


def identify(docs: DataFrame, train: Column, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``lang_pred`` and ``score`` (0 to 1), or other ``names``, of its ``text``.

    Fitted on a sample of the rows where ``train`` holds and ``lang`` is known, bounded in rows (300 different texts a
    language, 4000 in all, but one of each language) and read as a whole; ``lang`` is no input of a prediction. Null
    texts and texts without a letter get ``und`` and score 0, and so does every text
    if nothing is labelled. Whole texts are scored, n-grams across pieces included. Ties go to the first language in
    code-point order. Null ids and repeated rows are treated like others; an empty table gives no rows.
    """
    return map_texts(docs, keep, "text", _predict(fit(sample(docs, train))), {names[0]: "string", names[1]: "double"})


def held_out(docs: DataFrame) -> Column:
    """Whether a row of ``docs`` is kept from training: crc32 of its id mod 4 is 2. A null id isn't, nor is it learned from."""
    return F.coalesce(F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def recognised(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows in no known language: without a letter, or with a score below ``min_score``.

    Null and empty texts have no letter and go. Equal rows have one score, so all stay or none. Null ids are judged like others but not
    learned from. Where nothing is labelled all go; an empty table stays empty; texts of any length are read as a whole.
    """
    lang, score = unused(docs, "lang_pred", "lang_score")
    judged = identify(docs, ~held_out(docs) & F.col("doc_id").isNotNull(), docs.columns, (lang, score))
    return judged.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*columns_of(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", held_out(docs).alias("held_out"))
    out = identify(docs, ~F.col("held_out") & F.col("doc_id").isNotNull(), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
