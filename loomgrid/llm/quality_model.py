"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from operator import eq

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Bounds of the training sample: trusted positives, and unlabelled web texts.
POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.3
STEPS, RATE, DECAY = 600, 0.05, 5e-3
#: Features are cut at so many deviations: beyond them form says no more.
REACH = 3.0
_UPPER, _LOWER, _DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_HIGH = bytes(range(128, 256))
_STOPS, _MARKS = b".,;:?", b"#*$%&|<>~^_=+{}[]\\/@!"
N_FEATURES = 18


def features(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    """Shares and logs that describe a text's form; roots spread the small shares."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), max(1, len(data))
    lines = data.split(b"\n")

    def share(chars: bytes, of: int = size) -> float:
        return ((len(data) - len(data.translate(None, chars))) / max(1, of)) ** 0.5

    distinct = len(set(words))
    twins = sum(map(eq, words, words[1:])) / max(1, n - 1)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    letters = size - len(data.translate(None, _UPPER + _LOWER + _HIGH))
    upper = size - len(data.translate(None, _UPPER))
    ends = sum(w[-1:] in (b"!", b"#", b"*", b"$", b"%", b"&", b"|") for w in words) / max(1, n)
    return [
        float(n == 0),
        np.log1p(n),
        np.log1p(size / max(1, n)),
        (upper / max(1, letters)) ** 0.5,
        share(_MARKS),
        share(_STOPS),
        share(_DIGIT),
        share(b"|"),
        share(b"!"),
        ends**0.5,
        twins**0.5,
        1 - pairs if n > 1 else 0.0,
        np.log1p(distinct) / np.log1p(max(n, 1)),
        np.log1p(size / len(packer.compress(data))) if data else 0.0,
        1 - len(set(lines)) / len(lines),
        np.log1p(size / len(lines)),
        share(_SPACE),
        share(_LOWER),
    ]


def _featurise():
    packer = zstandard.ZstdCompressor(level=1)
    return lambda texts: [[features(t, packer) for t in texts]]


def _wide(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -REACH, REACH)
    return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk under logistic loss (Adam, full batches).

    Risk: prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)]). Where the second part
    falls below zero the step goes up its own slope, as Kiryo et al. (2017) do.
    """
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for t in range(1, STEPS + 1):
        gp, gu = p @ w, u @ w
        sp, su = _sigmoid(gp), _sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        slope_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        slope = prior * (p.T @ (sp - 1)) / len(p) + slope_negative if negative >= 0 else -slope_negative
        slope = slope + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(gp: np.ndarray, gu: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both.

    No set of texts can be rarer among the unlabelled than the prior times its
    share among positives; the top scores, which hold the fewest negatives, bound the
    prior best. The least ratio over upper tails of at least a third of the positives.
    """
    ratios = [(gu > t).mean() / (gp > t).mean() for t in np.quantile(gp, np.linspace(0.02, 0.67, 40)) if (gp > t).any()]
    return float(np.clip(min(ratios, default=1.0), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> dict:
    """Scaling, prior and weights: a first fit at prior 1/2 ranks the texts, its tails give the prior for the final fit."""
    both = np.concatenate([positive, unlabelled])
    model = {"mean": both.mean(axis=0), "scale": both.std(axis=0) + 1e-3}
    p, u = _wide(positive, model), _wide(unlabelled, model)
    w = _descend(p, u, 0.5)
    model["prior"] = estimate_prior(p @ w, u @ w)
    return model | {"weights": _descend(p, u, model["prior"])}


def _score(model: dict | None):
    def make():
        packer = zstandard.ZstdCompressor(level=1)

        def run(texts: list[str | None]) -> list[list]:
            if model is None:
                return [[0.5] * len(texts)]
            return [_sigmoid(_wide(np.array([features(t, packer) for t in texts]), model) @ model["weights"]).tolist()]

        return run

    return make


def _bounded(rows: DataFrame, most: int) -> np.ndarray:
    """Features of about ``most`` ids of ``rows`` (doc_id, text), drawn by a hash of the id, in its order; repeated ids count once."""
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 62)))  # wide enough for ids not to share draws
    n = drawn.agg(F.approx_count_distinct("draw", 0.02)).first()[0]
    one = drawn.where(F.col("draw") < int(min(1.0, most / max(1, n)) * (1 << 62))).groupBy("draw", "doc_id").agg(F.min("text").alias("text"))
    found = sorted((r["draw"], r["doc_id"], tuple(r["x"])) for r in map_texts(one, ["draw", "doc_id"], "text", _featurise, {"x": "array<double>"}).collect())
    return np.array([x for _, _, x in found]).reshape(-1, N_FEATURES)


def score(docs: DataFrame, labels: DataFrame, train: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``score`` (0 to 1; higher: quality 1 likelier) of its ``text``.

    ``labels`` (doc_id, quality): rows of quality 1 are the trusted positives; all
    texts where ``train`` holds count as unlabelled web text, whose share of positives
    is estimated. Bounded samples (4000 and 8000 rows, drawn by a hash of the id) fit
    the model, a repeated id once; every whole text is scored by its form alone. Null and empty texts have
    no words and are scored like any other; without positives all scores are 0.5.
    Repeated label rows count once; null ids aren't learned from. An empty table gives no rows.
    """
    known = docs.where(train & F.col("doc_id").isNotNull()).select("doc_id", "text")
    good = labels.where("quality = 1").select("doc_id").distinct()
    positive, unlabelled = _bounded(known.join(good, "doc_id", "left_semi"), POSITIVES), _bounded(known, UNLABELLED)
    model = fit(positive, unlabelled) if len(positive) and len(unlabelled) else None
    return map_texts(docs, keep, "text", _score(model), {"score": "double"})


def held_out(docs: DataFrame) -> Column:
    """Whether a row of ``docs`` is kept from training: crc32 of its id mod 5 is 0."""
    return F.coalesce(F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", held_out(docs).alias("held_out"))
    out = score(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality_pu": op2_quality_pu}
ORACLE_SQL: dict[str, str] = {}
