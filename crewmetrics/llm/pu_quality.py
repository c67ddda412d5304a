"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text make up a non-negative unbiased risk
    prior * E+[loss(g)] + max(0, E_u[loss(-g)] - prior * E+[loss(-g)])
with the logistic loss, minimised over a linear model of features of the whole text. Labelled negatives
serve the class prior alone. The fit sees a bounded sample; every document is scored by its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positives and unlabelled rows to learn from at most, each: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
STEPS, RATE, DECAY = 600, 0.05, 1e-4

#: Bytes by kind, and lines and words as they come; shares of these are the features.
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?", b".,;:", b"#*$%&", b"|<>", b"\"'()[]{}", b"\n", b"-_=+/\\~^@"]
_KIND = np.zeros(256, dtype=np.int64)
for _i, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _i + 1
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = len(_KINDS) + 1
_KIND[list(b" \t\r\x0b\f")] = len(_KINDS) + 2
_N_KINDS = len(_KINDS) + 3
_SIGNS = b"".join(_KINDS[2:])
N_FEATURES = _N_KINDS + 9


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, of repeats among words and lines, and lengths; of a text without words zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * N_FEATURES
    kinds = np.bincount(_KIND[np.frombuffer(data, dtype=np.uint8)], minlength=_N_KINDS) / len(data)
    n = len(words)
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [line for line in data.split(b"\n") if line.strip()]
    upper = sum(map(bytes.isupper, words)) / n
    signs = sum(not w.strip(_SIGNS) for w in words) / n
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    return [
        *kinds,
        same,
        upper,
        signs,
        distinct / n,
        np.log(distinct + 1) / np.log(n + 1),
        pairs,
        len(set(lines)) / len(lines),
        np.log(n),
        np.log(len(data) / n),
    ]


def design(rows: np.ndarray) -> np.ndarray:
    """Features and their square roots, which tell a few per cent from none."""
    return np.concatenate([rows, np.sqrt(np.abs(rows))], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((design(rows) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Full-batch Adam on the risk; where its bounded part falls below zero, steps lead back up."""
    p, u = design(positive), design(unlabelled)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
    p, u = np.clip((p - mean) / scale, -8, 8), np.clip((u - mean) / scale, -8, 8)
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        gp, gu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        grad = prior * (p.T @ (sp - 1)) / len(p) + grad if rest >= 0 else -grad
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4; a null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def _sample(docs: DataFrame, ids: DataFrame, rows: int) -> np.ndarray:
    """Features of the rows whose ids have the smallest hashes; at most ``rows`` of them are broadcast and collected."""
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.join(F.broadcast(chosen), "doc_id").select(_features("text").alias("f")).collect()
    return np.array([r.f for r in found], dtype=float).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from rows outside the held-out fold only.

    The class prior is the share of quality 1 among their labels (0.01 to 0.99, 0.5 without labels). Without positives or
    without documents the model says the prior for every text.
    """
    ids = docs.select("doc_id").where("doc_id is not null").where(fold(F.col("doc_id")) != HELD_OUT).distinct()
    known = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) != HELD_OUT)
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = min(max(share if share is not None else 0.5, 0.01), 0.99)
    trusted = known.where("quality = 1").select("doc_id").distinct()
    positive, unlabelled = _sample(docs, trusted, rows), _sample(docs, ids, rows)
    if not len(positive) or not len(unlabelled):
        width = 2 * N_FEATURES
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))), prior)
    return fit(positive, unlabelled, prior)


def score_column(text: str, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), -1)
        return pd.Series(model.score(rows) if len(texts) else [], dtype=float)

    return score(text)


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text) given ``labels`` (doc_id, quality).

    Null and empty texts are scored as texts without words. Repeated rows get equal scores. Ties in the sample are
    broken by doc_id. Labels without a document, null labels and null ids teach nothing. No documents give no rows;
    other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    model = train(docs, labels, rows)
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score_column("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    model = train(docs.select("doc_id", "text"), labels, rows)
    return docs.where(score_column("text", model) >= threshold)
