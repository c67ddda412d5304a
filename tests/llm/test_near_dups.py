import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewmetrics.llm import near_dups as N
from crewmetrics.llm.common import Scratch

DOCS = "doc_id long, text string, size int, id string"


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:]))


def brute(rows):
    """Components by comparing all pairs; equal texts of rows without an id join the named ones."""
    named = [(i, sets_of(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in named}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(named)):
        for b in range(a):
            (i, s), (j, t) = named[a], named[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, t, *_ in rows:
        same = [j for j, s in named if s and s == sets_of(t)]
        component = root(i) if i is not None else root(min(same)) if same else None
        out.append((i, len(sets_of(t)), component, component == i))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocab, k=rng.choice([1, 2, 12, 60, 200])))
        rows.append((i, text.upper() if rng.random() < 0.2 else text, 1, "x"))
    rows += [(n, None, None, None), (n + 1, "", None, None), (n + 2, " \t ", None, None), rows[3], (None, rows[4][1], None, None),
             (None, "on its own", None, None), (n + 3, "the The " * 30_000, None, None), (n + 4, "the the the", None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = N.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [(i, "one two three four five six seven", None, "x") for i in range(5)] + [(9, "another text", 2, None), (10, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9, 10]


def test_no_documents(spark):
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_a_large_group_of_near_copies_is_one_component(spread):
    """Many copies with a few words changed: candidates grow with the group, not with its square."""
    spark = spread
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(1200):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None))
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    got = N.near_duplicates(df).collect()
    assert {r.component_id for r in got} == {0}
    signed = df.select("doc_id", "text").mapInArrow(N._sign, "doc_id long, n_shingles long, set_id binary, signature binary")
    nodes = signed.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "signature", F.col("doc_id").alias("component"))
    pairs, split = N.candidates(nodes, Scratch(spark))
    assert pairs.count() < 1200 * N.ORDERS * N.REGION / 2 < 1200 * 1199 / 2
    assert split.count() > 1000
    # With one component nothing is left to compare.
    pairs, _ = N.candidates(nodes.withColumn("component", F.lit(0).cast("long")), Scratch(spark), 64, 16)
    assert pairs.isEmpty()


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    for share in (0.3, 0.8, 0.95):
        close = []
        for _ in range(20):
            a = rng.sample(words, 300)
            b = [w if rng.random() < share else f"z{w}" for w in a]
            sets = [N.shingles(" ".join(x), N._Words()) for x in (a, b)]
            sig = N.signatures(sets)
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            close.append((sig[0] == sig[1]).mean() - true)
        assert abs(np.mean(close)) < 0.04


def test_long_chains_of_links_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200) if i != 120], "a long, b long")
    got = {r.id: r.component for r in N.components(links, Scratch(spark)).collect()}
    assert got == {i: 0 if i <= 120 else 121 for i in range(201) if i not in (0, 121)}


def test_near_copies_that_only_meet_in_a_hub_are_found(spread):
    """Copies far from each other but close to one of many near copies in a split region."""
    spark = spread
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]

    def changed(n):
        words = list(base)
        for i in rng.sample(range(0, 150, 3), n):
            words[i] = f"x{rng.randrange(10**9)}"
        return " ".join(words)

    rows = [(i, changed(rng.randrange(3)), None, None) for i in range(300)] + [(1000 + i, changed(14), None, None) for i in range(150)]
    got = N.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_pairs_among_many_different_texts_of_one_template_are_found(spread):
    """Texts that share a long passage but stay below 0.8 with each other, and pairs at 0.8 among them."""
    spark = spread
    rng = random.Random(11)
    passage = [f"t{i}" for i in range(165)]
    own = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(300):
        tail = own(35)
        rows.append((len(rows), " ".join(passage + tail), None, None))
        rows.append((len(rows), " ".join(passage + tail[:14] + own(21)), None, None))
    rng.shuffle(rows)
    got = N.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == 300


def test_shingles_of_any_width_and_bytes_for_bits(spark):
    """Sets against plain tuples of words, and candidates by bytes against those by bits."""
    rng = random.Random(5)
    for width in (1, 2, 3, 5):
        for n in (0, 1, 2, 4, 5, 6, 40):
            words = [rng.choice("abc") for _ in range(n)]
            want = {tuple(words[i : i + width]) for i in range(max(1, n - width + 1))} if n else set()
            assert len(N.shingles(" ".join(words), N._Words(), width)) == len(want)
    base = [f"w{i}" for i in range(60)]
    one_off = [*base[:30], "other", *base[31:]]  # 2 of 59 pairs of words, 5 of 56 fives
    far = [w if i % 8 else f"x{i}" for i, w in enumerate(base)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(one_off)), (3, " ".join(far))], "doc_id long, text string")
    for words in (2, 5):
        rows = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, words).collect()}
        assert rows == {1: (61 - words, 1), 2: (61 - words, 1), 3: (61 - words, 3)}
    x = np.zeros((2, N.COLUMNS), dtype=np.uint8)
    y = x.copy()
    y[0, : N.BYTES], y[1, : N.BYTES + 1] = 7, 7
    assert N._close(x, y).tolist() == [True, False]


def test_prefix_filter_joins_only_prefixes_and_finds_all_pairs(spread):
    """Sets of one template in many components: no join looks up every shingle, pairs at 0.8 of different components are found."""
    rng = random.Random(17)
    template = [rng.randrange(-(2**63), 2**63) for _ in range(60)]
    sets = []
    for i in range(120):
        mine = rng.sample(template, rng.randrange(30, 61)) + [rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(8))]
        sets.append((i, sorted(set(mine)), i // 3))
    want = {
        (a, b)
        for a, x, p in sets
        for b, y, q in sets
        if a < b and p != q and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))
    }
    scratch = Scratch(spread)
    saved = scratch.save(spread.createDataFrame(sets, "id long, items array<long>, component long").repartition(3))
    pairs = N.blocked(saved, scratch)
    assert want and want <= {tuple(r) for r in pairs.collect()}
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 1
    # A prefix of a fifth of a set is all that meets.
    known = spread.sparkContext.broadcast(np.ones(N.BUCKETS, dtype=np.uint8))
    rows = saved.select("id", "component", "items").mapInArrow(N._prefixes(known), "item long, id long, component long, size long, at long")
    assert rows.count() == sum(len(x) - (4 * len(x) + 4) // 5 + 1 for _, x, _ in sets)


def test_shingles_of_a_dense_region_are_counted_before_they_become_rows(spread):
    """A task gives a row for each bucket, however many sets hold its shingles, and the counts are those of all shingles."""
    rng = random.Random(23)
    template = [rng.randrange(-(2**63), 2**63) for _ in range(50)]
    kept = [(i, sorted([*rng.sample(template, 40), i << 23]), i % 3) for i in range(200)]  # the last shingles share bucket 0
    kept += [(200, sorted(x ^ 1 for x in template), 7)]  # held by one component alone
    made = []
    for times in (1, 4):
        sets = [(i + 1000 * k, items, c) for i, items, c in kept for k in range(times)]
        df = spread.createDataFrame(sets, "id long, items array<long>, component long").repartition(2)
        rows = df.select("component", "items").mapInArrow(N._counts, "bucket int, n long, component long, shared boolean").collect()
        want, holders = {}, {}
        for _, items, c in sets:
            for x in items:
                want[x % N.BUCKETS] = want.get(x % N.BUCKETS, 0) + 1
                holders.setdefault(x % N.BUCKETS, set()).add(c)
        got, of = {}, {}
        for r in rows:
            got[r.bucket] = got.get(r.bucket, 0) + r.n
            of.setdefault(r.bucket, set()).update([r.component, *([-1] if r.shared else [])])
        assert got == want
        assert {b for b, c in of.items() if len(c) > 1} == {b for b, c in holders.items() if len(c) > 1}
        made.append(len(rows))
        assert len(rows) <= 2 * len(want) < sum(len(x) for _, x, _ in sets) / 20
    assert made[1] < 3 * made[0]  # not in proportion to the sets, which are four times as many


def test_blocked_makes_no_row_for_each_shingle(spread, monkeypatch):
    """Counting reads the sets as they are: nothing explodes them."""
    monkeypatch.setattr(N.F, "explode", None)
    items = [list(range(k, k + 40)) for k in (0, 1, 1000)]
    scratch = Scratch(spread)
    saved = scratch.save(spread.createDataFrame([(i, x, i) for i, x in enumerate(items)], "id long, items array<long>, component long"))
    assert (0, 1) in {tuple(r) for r in N.blocked(saved, scratch).collect()}
