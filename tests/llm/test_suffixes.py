import hashlib
import random
import re

import pytest

from crewmetrics.llm import suffixes

DOCS = "doc_id long, text string, found string, n_words int"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        doc, hit, found = words(text), set(), set()
        for item_id, item in items:
            item = words(item)
            n = min(13, len(item))
            for q in range(len(item) - n + 1 if item else 0):
                for p in range(len(doc) - n + 1):
                    if doc[p : p + n] == item[q : q + n]:
                        hit |= set(range(p, p + n))
                        found.add("" if item_id is None else str(item_id))
        ids = ",".join(sorted(found))
        out.append((doc_id, len(doc), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(doc)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "dé", "世", "x1", "the"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([1, 5, 12, 13, 14, 40]))) for i in range(12)]
    items += [(3, items[0][1]), (None, text(20)), (50, None), (51, "--- !"), (10, items[2][1])]
    docs = []
    for i in range(60):
        t = text(rng.choice([0, 3, 30, 200]))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1] or ""
            t += rng.choice([" ", "-", ". "]) + item.upper() * (rng.random() < 0.5) + " " + item
        docs.append((i, t, "x", 1))
    docs += [(60, None, None, None), (61, "", None, None), (None, items[1][1], None, None), docs[0], docs[5]]
    return docs, items


@pytest.mark.parametrize("shard, block", [(1_000_000, 1 << 24), (50, 1 << 24), (300, 100)])
def test_equals_brute_force(spark, shard, block):
    docs, items = corpus(3)
    got = suffixes.report(
        spark.createDataFrame(docs, DOCS).repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        shard=shard,
        block_bytes=block,
    )
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_spans_are_the_longest_passages(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"x y {passage} z", None, None), (2, " ".join(passage.split()[:13]) + " and on", None, None)]
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    found = suffixes.scan(spark.createDataFrame(docs, DOCS).drop("found"), items).collect()
    assert {r.doc_id: [tuple(s) for s in r.found.spans] for r in found} == {1: [(2, 30)], 2: [(0, 13)]}
    assert {r.n_words for r in found} == {None}  # a column of the input, kept


def test_removal_keeps_clean_documents_whole(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    clean = " ".join(f"v{i}" for i in range(400))
    docs = spark.createDataFrame([(1, passage, "a", 1), (2, clean + " " + passage, "b", 2), (3, clean, "c", 3), (4, None, None, None)], DOCS)
    kept = suffixes.remove_contaminated(docs, spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(kept.collect()) == sorted(r for r in docs.collect() if r.doc_id != 1)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", None, None)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in suffixes.report(docs, items).collect()] == [(2, 0, 0)]
    assert suffixes.report(docs.limit(0), items).collect() == []
