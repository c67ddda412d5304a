import math
import random
import re
from collections import Counter

import pytest
import xxhash

from crewmetrics.llm import quality_rules as Q

DOCS = "doc_id long, text string, h string, score double"
BUCKETS = 64


def spark_hash(*values):
    """Spark's xxhash64: each value's hash is the next one's seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def grams(text):
    h = [spark_hash(w) for w in re.findall(Q.WORD, text or "")]
    return [x % BUCKETS for x in h] + [spark_hash(a, b) % BUCKETS for a, b in zip(h, h[1:])]


def base(text):
    text = text or ""
    ws = re.findall(Q.WORD, text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    count = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(Q.WORD, x)]
    failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "aé", "世界", "x|y", "$$", "Foo", "bar."]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 9, 10, 30, 120]))), None, None) for i in range(40)]
    rows += [(40, "a b c d e\n" * 6 + "\n \n\t\n", "x", 1.0), (41, None, None, None), (42, "", None, None), (None, "no id " * 8, None, None)]
    rows += [rows[5], (43, "\x0b\x0c\r", None, None), (44, "one two three four five six one two three four five", None, None)]
    return rows


def brute(rows, trusted, threshold):
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for i, t, *_ in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in trusted
    if sum(target) == BUCKETS:
        ratio = [0.0] * BUCKETS
    else:
        ratio = [math.log(t / sum(target)) - math.log(r / sum(raw)) for t, r in zip(target, raw)]
    out = []
    for i, t, *_ in rows:
        gs = grams(t)
        score = sum(ratio[g] for g in gs) / len(gs) if gs else None
        *counts, failed = base(t)
        out.append((i, *counts, failed, not failed and score >= threshold, score))
    return out


@pytest.mark.parametrize("trusted", [{1, 2, 3, 5, 8, 13, 99}, set()])
def test_equals_brute_force(spark, trusted):
    rows = corpus(4)
    ids = spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long")
    got = Q.report(spark.createDataFrame(rows, DOCS).repartition(3), ids, threshold=0.003, buckets=BUCKETS).collect()
    want = sorted(brute(rows, trusted, 0.003), key=str)
    got = sorted(map(tuple, got), key=str)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want], abs=1e-12)


def test_no_python_in_the_plan(spark):
    df = Q.report(spark.createDataFrame(corpus(4), DOCS), spark.createDataFrame([(1,)], "doc_id long"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_no_documents(spark):
    assert Q.report(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long")).collect() == []


def test_long_repeats_take_time_in_proportion(spark):
    text = "spam ham " * 60_000
    row = Q.report(spark.createDataFrame([(1, text, None, None)], DOCS), spark.createDataFrame([], "doc_id long")).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (120_000, 120_000, True)


def test_every_trusted_document_counts(spark):
    """More ids than were once learnt from: where all are trusted both multinomials are the same."""
    docs = spark.range(201_000).selectExpr("id as doc_id", "concat('w', id % 11, ' x', id % 3) as text")
    ratios = Q.weights(docs, docs.select("doc_id"), BUCKETS)
    assert max(map(abs, ratios)) < 1e-12
    some = Q.weights(docs, docs.where("doc_id >= 1000").select("doc_id"), BUCKETS)
    assert max(map(abs, some)) > 1e-6


@pytest.mark.parametrize("n", [1, 3_000])
def test_texts_meet_the_ids_in_one_way_whatever_their_number(spread, n):
    """Few ids were broadcast and more were not, which then sorted the texts."""
    spark = spread
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2_500, "c"), (None, "d"), (9_000, "e")], "doc_id long, text string")
    ids = spark.range(1, n + 1).selectExpr("id as doc_id").unionByName(spark.createDataFrame([(1,), (None,)], "doc_id long"))
    found = Q.marked(docs, ids)
    rows = sorted((r.text or "", r.trusted) for r in found.collect())
    many = 1 if n > 2 else None
    assert rows == [("", many), ("a", 1), ("b", 1), ("c", many), ("d", None), ("e", None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan
