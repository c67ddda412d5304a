import math
import re

import pytest
from compare import difference, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from crewmetrics.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def by_hand(docs, items, k=10):
    """Every document against every item, one term after the other."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, ws) for i, ws in held if ws]
    n_docs, n_terms = len(held), sum(len(ws) for _, ws in held)
    united = {}
    for i, t in items:
        united.setdefault(i, set()).update(terms(t))
    rows = []
    for item, wanted in united.items():
        found = []
        for doc_id, ws in held:
            m = 100 - 90 + (90 * len(ws) * n_docs) // n_terms
            score = 0
            for t in wanted:
                df = sum(t in other for _, other in held)
                if df:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    tf = ws.count(t)
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        rows += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=repr)


def got(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = lexical.search(d, i, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=repr)


DOCS = [
    (7, "The cat sat on the mat, the CAT"),
    (3, "the cat sat on the mat, the cat"),
    (3, "the cat sat on the mat, the cat"),
    (None, "a cat, a cat"),
    (5, None),
    (6, ""),
    (8, "... --- ..."),
    (9, "émile saw the Émile_x of Ünder9"),
    (10, "cat " * 50_000),
    (11, "dog " + "z" * 200_000),
    (12, "dog mat on"),
]
ITEMS = [
    (1, "The cat on the mat"),
    (2, "a cat and a dog on the mat"),
    (4, None),
    (5, "!!"),
    (6, "Émile Ünder9 dog"),
    (2, "unheard zebra"),
    (None, "cat"),
    (9, "nothing here matches that"),
    (10, "cat on the mat"),
]


@pytest.mark.parametrize("pairs", [8192, 4])
def test_equals_the_plain_scores(spark, spread, pairs):
    assert got(spark, DOCS, ITEMS, block_pairs=pairs) == by_hand(DOCS, ITEMS)
    assert got(spark, DOCS, ITEMS, k=2, block_pairs=pairs) == by_hand(DOCS, ITEMS, 2)


def test_ties_go_by_id_over_many_shards(spark, spread, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 16)
    docs = [((i * 37) % 400, "same words here" if i % 3 else "same words") for i in range(400)]
    docs = [(i, t) for i, t in docs]
    items = [(1, "same here"), (2, "here words"), (3, "same here words")]
    assert got(spark, docs, items) == by_hand(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], ITEMS) == []
    assert got(spark, DOCS, []) == []
    assert got(spark, [(1, None), (2, " ")], ITEMS) == []


def test_other_columns_are_not_read(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "b c", 6, "y")], "doc_id long, text string, score int, term string")
    items = spark.createDataFrame([("q", "b a", 1)], "item_id string, text string, df int")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [("q", 1, 1), ("q", 2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, unique=True), min_size=1, max_size=8))
def test_each_term_counts_once_whatever_is_shared(queries):
    sets, sums, rows = lexical.share(queries)

    def spread_out(symbol):
        if symbol < len(sets):
            return sets[symbol]
        a, b = sums[symbol - len(sets)]
        assert max(a, b) < symbol
        return spread_out(a) + spread_out(b)

    for query, row in zip(queries, rows):
        assert sorted(t for s in row for t in spread_out(s)) == sorted(query)


def test_what_queries_share_is_computed_once():
    shared = [list(range(10)) + [100 + i] for i in range(6)]
    sets, sums, rows = lexical.share(shared)
    assert sorted(map(len, sets)) == [1] * 6 + [10] and all(len(r) == 2 for r in rows)
    chains = [[0, 1, 2, 10], [0, 1, 2, 11], [0, 1, 12], [0, 2, 13], [1, 14]]
    _, sums, rows = lexical.share(chains)
    assert len(sums) >= 2 and sum(map(len, rows)) < sum(map(len, chains))


def test_sql_on_rows_of_every_kind(spark, tmp_path):
    spark.createDataFrame([d for d in DOCS if d[0] is not None], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/i")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"create or replace view documents as select * from '{tmp_path}/d/*.parquet'")
    con.execute(f"create or replace view benchmark as select * from '{tmp_path}/i/*.parquet'")
    found = lexical.search(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/i"))
    assert difference(found, con, lexical.ORACLE) is None
