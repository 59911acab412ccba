"""Probability of a text over all its segmentations into the pieces of an existing vocabulary.

A text is a sequence of words and one end; a word, led by a space, is a path through the
lattice of vocabulary pieces that spell it. Each piece has one score, the logarithm of its
probability; a word's probability is the sum over all paths, taken by a forward recursion in log space.

1. Tasks number the words of their chunks of text (``chunks``). Words of the corpus are counted once, with how often training texts have them.
2. The vocabulary's own order gives first scores (Zipf's law). Expectation maximisation fits them to the training
   counts: tasks run forward and backward over their share of all different words and send one expected count a piece.
3. Each different word gets its probability once, and goes back to the chunks by a join; a text's score is a sum there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .common import durable, table

#: Public vocabulary of pieces.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of expectation maximisation, and what is added to each piece's expected count.
ROUNDS, PRIOR = 4, 0.1
#: Words and bytes that are taken through the lattice at once.
WORDS_AT_ONCE, BYTES_AT_ONCE = 16384, 1 << 19
_STOP = 10  # a line feed: in no word, in no piece


class Pieces:
    """Pieces of a vocabulary that words can hold, as a table of steps from prefix to prefix; a last piece is the text's end.

    Bytes that are no piece of their own have one each, so every word has a path.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, int] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
                continue
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if not re.search(rb"[A-Z\x09-\x0d]|.\x20", piece, re.S):
                found.setdefault(piece, len(found))
        n = len(found)
        for b in range(256):
            if bytes([b]) not in found:
                found[bytes([b])] = len(found)
        self.n = len(found)
        rank = np.arange(self.n + 1, dtype=float)
        rank[n:] = self.n
        first = 1 / (rank + 2.7)
        self.first = np.log(first / first.sum())
        nodes: dict[tuple[int, int], int] = {}
        final = [-1]
        for piece, i in found.items():
            at = 0
            for b in piece:
                at = nodes.setdefault((at, b), len(final))
                if at == len(final):
                    final.append(-1)
            final[at] = i
        self.steps = np.array([(a, b, c) for (a, b), c in nodes.items()], dtype=np.int32)
        self.final = np.array(final, dtype=np.int32)

    def table(self) -> np.ndarray:
        """Next prefix by prefix and byte; 0 where there is none."""
        out = np.zeros((len(self.final), 256), dtype=np.int32)
        out[self.steps[:, 0], self.steps[:, 1]] = self.steps[:, 2]
        return out


class Lattice:
    """All pieces that stand anywhere in some words: arcs from place to place."""

    def __init__(self, words: list[bytes], steps: np.ndarray, final: np.ndarray) -> None:
        flat = np.frombuffer(b"".join(b" " + w + b"\n" for w in words), dtype=np.uint8)
        self.stop = np.nonzero(flat == _STOP)[0]
        self.start = np.concatenate([[0], self.stop[:-1] + 1])
        self.size = len(flat)
        place, state, starts, ends, pieces, t = np.nonzero(flat != _STOP)[0], np.int32(0), [], [], [], 0
        while len(place):
            state = steps[state, flat[place + t]]  # the stop after each word leads nowhere, so no arc leaves its word
            alive = state > 0
            place, state, t = place[alive], state[alive], t + 1
            piece = final[state]
            whole = piece >= 0
            starts.append(place[whole])
            ends.append(place[whole] + t)
            pieces.append(piece[whole])
        self.a, self.b, self.piece = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, ends, pieces))
        order = np.argsort(self.b, kind="stable")
        self.a, self.b, self.piece = self.a[order], self.b[order], self.piece[order]
        self.word = np.searchsorted(self.stop, self.a)

    def _sweep(self, score: np.ndarray, source: np.ndarray, target: np.ndarray, layer: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log sums over all paths from the places ``begin``, in layers of places that are done together."""
        order = np.lexsort((target, layer))
        source, target, layer, weight = source[order], target[order], layer[order], score[self.piece[order]]
        out = np.full(self.size, -np.inf)
        out[begin] = 0.0
        cuts = np.append(np.nonzero(np.append(True, layer[1:] != layer[:-1]))[0], len(layer)) if len(layer) else [0]
        for i, j in zip(cuts, cuts[1:]):
            to = target[i:j]
            first = np.nonzero(np.append(True, to[1:] != to[:-1]))[0]
            values = out[source[i:j]] + weight[i:j]
            most = np.maximum.reduceat(values, first)
            rest = np.exp(values - np.repeat(most, np.diff(np.append(first, j - i))))
            out[to[first]] = most + np.log(np.add.reduceat(rest, first))
        return out

    def forward(self, score: np.ndarray) -> np.ndarray:
        return self._sweep(score, self.a, self.b, self.b - self.start[self.word], self.start)

    def backward(self, score: np.ndarray) -> np.ndarray:
        return self._sweep(score, self.b, self.a, self.stop[self.word] - self.a, self.stop)

    def likelihood(self, score: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        return self.forward(score)[self.stop]

    def expected(self, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each met ``counts`` times."""
        there, back = self.forward(score), self.backward(score)
        share = np.exp(there[self.a] + score[self.piece] + back[self.b] - there[self.stop][self.word])
        return np.bincount(self.piece, weights=share * counts[self.word], minlength=len(score))


def _in_slices(words: list[bytes]) -> Iterator[np.ndarray]:
    """Places of words, by length, in slices of bounded size; a longer word is one alone."""
    order = np.argsort([len(w) for w in words], kind="stable")
    begin = size = 0
    for i, at in enumerate(order.tolist()):
        if i > begin and (i - begin >= WORDS_AT_ONCE or size + len(words[at]) > BYTES_AT_ONCE):
            yield order[begin:i]
            begin, size = i, 0
        size += len(words[at]) + 2
    if begin < len(order):
        yield order[begin:]


def _lattices(batch: pa.RecordBatch, steps: np.ndarray, final: np.ndarray) -> Iterator[tuple[np.ndarray, Lattice]]:
    words = batch.column(0).to_pylist()
    for some in _in_slices(words):
        yield some, Lattice([words[i] for i in some.tolist()], steps, final)


def _expected(pieces: Pieces, score: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, steps = np.zeros(len(score)), pieces.table()
        for batch in batches:
            counts = batch.column(1).to_numpy()
            for some, lattice in _lattices(batch, steps, pieces.final):
                total += lattice.expected(score, counts[some])
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "n"])

    return run


def _likelihood(pieces: Pieces, score: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = pieces.table()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for some, lattice in _lattices(batch, steps, pieces.final):
                out[some] = lattice.likelihood(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out / np.log(10))], names=["word", "c", "log10p"])

    return run


def fit(words: DataFrame, n_texts: int, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Scores of all pieces, the end last, from ``words`` (word binary, c: occurrences in training texts) and their number of texts."""
    score, known = pieces.first, words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        n = np.full(pieces.n + 1, PRIOR)
        found = known.mapInArrow(_expected(pieces, score), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row a piece at most
        n[[r["piece"] for r in found]] += [r["n"] for r in found]
        n[-1] += n_texts
        score = np.log(n / n.sum())
    return score


def _summed(n_train: int, n_kinds: int, n_texts: int, end: float):
    def run(held: pa.Table, found: pa.Table) -> pa.Table:
        """Scores of the texts of one chunk; ``found``: counts and probabilities of its words."""
        most = n_train + 0.5 * (n_kinds + 1)
        number = found.column("number").to_numpy()
        c, own = np.zeros(len(number) + 1), np.zeros(len(number) + 1)
        c[number], own[number] = found.column("c").to_numpy(), found.column("log10p").to_numpy()
        c[chunks.BREAK], own[chunks.BREAK] = n_texts, end
        base = np.log10((c + 0.5) / most)
        out = []
        for row in held.to_pylist():
            stream, size = chunks.unpack(row["stream"], np.uint32), np.array(row["sizes"], dtype=np.int64) + 1
            first = np.cumsum(size) - size
            sums = [np.add.reduceat(x[stream], first) for x in ((c > 0).astype(np.int64), base, own)]
            out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["marks"], pa.bool_()), *map(pa.array, (size, *sums))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table([[]] * 6, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    return run


def score(docs: DataFrame, held_out: Column, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs`` (doc_id, text).

    ``score`` is the log10 of a text's probability under piece scores learned from all rows where
    ``held_out`` doesn't hold; ``base_score`` that of single words with half a count
    added. A text's tokens are its words, A-Z in lower case, and one end. Null and empty texts
    are an end alone. Repeated rows count each; null ids are ids like others. Words of any length have a probability, in time
    linear in their bytes. Without training texts the vocabulary's own order gives the scores. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("mark"), "text").withColumn("part", F.when(F.col("mark"), "held").otherwise("train"))
    held = chunks.encoded(rows, chunks.words)
    met = chunks.dictionary(held)
    words = durable(met.groupBy("word").agg(F.sum(F.when(F.col("part") == "train", F.col("n")).otherwise(0)).alias("c")), "words")
    n_texts = held.where("part = 'train'").agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    n_words, n_kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_train, n_kinds = n_words + n_texts, n_kinds + (n_texts > 0)
    pieces = Pieces(vocabulary)
    scores = fit(words, n_texts, pieces, rounds)
    known = durable(words.mapInArrow(_likelihood(pieces, scores), "word binary, c long, log10p double"), "word-scores")
    found = met.select("chunk", "number", "word").join(known, "word").select("chunk", "number", "c", "log10p")
    summed = _summed(n_train, n_kinds, n_texts, float(scores[-1] / np.log(10)))
    out = held.select("chunk", "stream", "doc_ids", "marks", "sizes").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_train).cast("long"))


def op11_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 5 == 1)


QUERIES = {"op11_lattice_lm": op11_lattice_lm}
ORACLE_SQL: dict[str, str] = {}
