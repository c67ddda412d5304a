import hashlib
import random
from zlib import crc32

import pytest
from compare import difference, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from crewmetrics.llm import periodic


def by_hand(words, least=6, power=4):
    """Each period against every position."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


words = st.one_of(
    st.lists(st.integers(1, 3), max_size=60),
    st.tuples(st.lists(st.integers(1, 4), max_size=8), st.lists(st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 9)).map(
        lambda x: (x[0] + x[1] * x[2] + x[0])[:80]
    ),
)


@settings(max_examples=400, deadline=None)
@given(words, st.sampled_from([2, 3, 4]))
def test_runs_of_any_words(symbols, power):
    assert periodic.runs_of(symbols, 6, power) == by_hand(symbols, 6, power)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=4), st.sampled_from([2, 4]))
def test_texts_stay_apart_and_lose_nothing_by_the_cutting(texts, power):
    texts = [[b"w%d" % s for s in t] for t in texts]
    assert periodic.runs_of_texts(texts, 6, power) == [by_hand(t, 6, power) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40))
def test_extensions_are_those_of_the_text(symbols):
    import numpy as np

    n = len(symbols)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n + 1)]
    same = lambda a, b: next((k for k in range(n - b) if symbols[a + k] != symbols[b + k]), n - b)
    got = periodic.Extensions(periodic.SuffixTree(symbols))(*np.array(pairs).T)
    assert got.tolist() == [same(a, b) for a, b in pairs]
    up = periodic.SuffixTree(symbols).order()
    assert [symbols[i:] for i in up] == sorted(symbols[i:] for i in range(n + 1))
    down = periodic.SuffixTree(symbols).order(True)
    assert [[-s for s in symbols[i:]] for i in down] == sorted([-s for s in symbols[i:]] for i in range(n + 1))


def expected(doc_id, text):
    """The contract, word for word."""
    words = (text or "").encode().split()
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n, old = h // 10, len(words), list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            words[i] = old[a + (i - a) % p]
    runs = by_hand(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *head, sha(lines.encode()), sha(b" ".join(kept)))


def rows():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta of the to".split()) for _ in range(n))
    texts = [
        None,
        "",
        " \t\n",
        "one",
        "ha ha ha ha ha ha",
        "ha ha ha ha ha",
        "x a b a b a b a b y",
        "a\x0bb a\x0cb a b a b",
        "q q q q q q then r r r r r r",  # equal lengths: the first
        prose(600),
        "line of words\n" * 150,
        prose(50) + " " + "né à Ünder " * 100 + prose(50),
        "v " * 700,
    ]
    return [(i, t) for i, t in enumerate(texts * 12)] + [(4, texts[4]), (4, texts[4]), (None, "u u u u u u u")]


def test_report_equals_the_contract(spark, spread):
    data = rows()
    assert sum(crc32(str(i).encode()) % 10 == 0 for i, t in data if t and t.strip()) > 5
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in data], "doc_id long, text string, runs long, n_runs string")
    found = periodic.report(docs)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in data), key=repr)


def test_find_runs_keeps_rows_and_returns_texts(spark):
    docs = spark.createDataFrame([("a", "go on and on and on and on and on then", 1), ("b", None, 2), ("b", None, 2)], "k string, text string, n int")
    got = sorted(map(tuple, periodic.find_runs(docs).collect()))
    assert got[0][2:] == (1, [(1, 9, 2)], "go on and then")
    assert got[1:] == [("b", None, 2, [], "")] * 2
    with pytest.raises(ValueError):
        periodic.find_runs(docs.withColumn("runs", docs.n))
    assert periodic.find_runs(docs.limit(0)).collect() == []


def test_a_very_long_text(spark):
    words = [f"w{i % 7001}" for i in range(60_000)]
    docs = spark.createDataFrame([(" ".join(words) + " " + "v " * 30_000,)], "text string")
    (row,) = periodic.find_runs(docs).collect()
    assert row.runs == [(0, 60_000, 7001), (60_000, 30_000, 1)] and row.collapsed.split() == words[:7001] + ["v"]


def test_sql_on_rows_of_every_kind(spark, tmp_path):
    data = [(i, t) for i, t in rows() if i is not None and len(t or "") < 3_000]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"create or replace view documents as select * from '{tmp_path}/d/*.parquet'")
    assert difference(periodic.report(spark.read.parquet(f"{tmp_path}/d")), con, periodic.ORACLE) is None
