"""Quality rules of every document: counts for simple rules, and an importance ratio of hashed n-grams.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Bucket counts of trusted
documents and of the whole corpus give two multinomials with add-one smoothing; a document's
score is the logarithm of the ratio of its probabilities under them, divided by its number of
n-grams. Documents that pass the simple rules are kept from ``THRESHOLD`` on. Built-in expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.common import WORD, words

BUCKETS = 10_000
THRESHOLD = -0.15
WINDOW = 5
#: Fixed values of the contract.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, REPEAT_SHARE = 10, 20


def _hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _joined(left: Column, right: Column, n: int) -> Column:
    """Hashes of ``left[i]`` with ``right[i + n]``, as many as there are; both arrays are of equal length but for their ends."""
    size = F.greatest(F.size(right) - n, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), size), F.slice(right, F.lit(n + 1), size), lambda a, b: F.xxhash64(a, b))


def _following(h: Column) -> Column:
    """The array without its first element; one shorter."""
    return F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0)))


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets)).cast("int")


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """text of all ``docs``, and trusted: 1 for those among the ids of ``trusted`` (doc_id), else null.

    The texts are shuffled once, however many ids there are, and each task looks its texts up among its own share of the
    ids: texts are neither sorted, which would spill them, nor are ids sent to all tasks.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(1))
    return docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left").select("text", "trusted")


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) of each bucket, from all ``docs`` and all the ``trusted`` ones (doc_id) among them.

    One aggregate over all n-grams, combined before its own shuffle; ``buckets`` numbers come to the driver.
    """
    hashed = marked(docs, trusted).select("trusted", _hashes(words(F.col("text"))).alias("h"))
    h = F.col("h")
    bucket = lambda a: _bucket(a, buckets)
    grams = hashed.select("trusted", F.explode(F.transform(F.concat(h, _joined(h, h, 1)), bucket)).alias("g"))
    rows = grams.groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for g, n, m in rows:
        raw[g] += n
        target[g] += m
    n, m = math.log(sum(raw)), math.log(sum(target))
    if sum(target) == buckets:  # nothing to trust: no document is better than another
        return [0.0] * buckets
    return [math.log(t) - m - math.log(r) + n for t, r in zip(target, raw)]


def _repeats(windows: Column) -> list[Column]:
    """Steps from hashes of all windows to the positions of those found twice or more; null if there are none."""
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(twice, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def measure(docs: DataFrame, log_ratios: list[float]) -> DataFrame:
    """``docs`` (doc_id, text) with the counts and ``score``; null without n-grams."""
    buckets = len(log_ratios)
    table = F.lit(log_ratios)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    cut = docs.select("doc_id", text.alias("text"), words(text).alias("w"))
    first = cut.select(
        "doc_id",
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _hashes(F.col("w")).alias("h"),
    )
    rest = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "score"]
    h, pairs = F.col("h"), F.col("pairs")
    paired = first.select("*", _joined(h, h, 1).alias("pairs"))
    add = lambda total, value: total + F.get(table, _bucket(value, buckets))
    total = F.aggregate(pairs, F.aggregate(h, F.lit(0.0), add), add)
    # Two pairs and a word are a window of five.
    windows = _joined(_joined(pairs, pairs, 2), h, WINDOW - 1)
    second = paired.select(
        *rest[:1], F.size(h).cast("long").alias("n_words"), *rest[2:-1],
        F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).alias("score"),
        windows.alias("windows"),
    )
    third = second.select(*rest, _repeats(F.col("windows")).alias("s"))
    s = F.col("s")
    same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
    fourth = third.select(
        *rest,
        F.sort_array(
            F.filter(F.transform(s, lambda x, j: F.when(F.coalesce(same(x, j), F.lit(False)), x["i"])), lambda i: i.isNotNull())
        ).alias("at"),
    )
    at = F.col("at")
    steps = F.zip_with(at, _following(at), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda x, y: x + y)
    return fourth.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def report(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, the counts, base_failed, kept and score of every row of ``docs`` (doc_id, text).

    A null text has no words. A document without words fails the simple rules and has a null score. Repeated rows
    are scored alike, and each counts in the corpus. Null ids are never trusted. Without trusted documents all
    scores are 0, so the simple rules decide. No documents give no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    found = measure(docs, weights(docs, trusted, buckets))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))).alias("kept"),
        "score",
    )
