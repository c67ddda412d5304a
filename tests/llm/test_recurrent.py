import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from crewmetrics.llm import recurrent
from crewmetrics.llm.recurrent import Network, Shape


def small(dtype=np.float64, symbols=11):
    shape = Shape(symbols, size=4, inputs=3, hidden=5)
    rng = np.random.default_rng(1)
    network = Network(shape, shape.start(np.arange(symbols, 0, -1)).astype(dtype))
    network.vector += rng.normal(0, 0.3, network.vector.shape).astype(dtype)
    last = symbols - (shape.classes - 1) * 4
    network.w["within_bias"][-1, last:] = -50
    return network


def texts(n, symbols, seed=2):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(1, symbols, int(rng.integers(0, 40))), 0) for _ in range(n)]


def log_likelihood(network, packed):
    tokens, first, begins, sizes = packed
    return network.log_probabilities(tokens, first, begins, sizes)


def test_gradients_are_the_slopes(monkeypatch):
    monkeypatch.setattr(recurrent, "SCORED", 50)  # no truncation, so that the slope is that of the whole sum
    network = small()
    packed, _ = recurrent.pack(texts(6, 11))
    grad = network.shape.cut(gradient := np.zeros_like(network.vector))
    state = np.zeros((len(packed[3]), 5))
    for at, real, before, kept in network.windows(*packed, 50):
        states, saved = network.forward(before, kept, state[: at.shape[1]], network.inputs())
        by_states = np.zeros_like(states)
        _, by_states[real] = network.output(states[real], packed[0][at[real]], grad)
        network.backward(before, kept, saved, by_states, grad)
        state = states[-1]
    assert int(packed[3].max()) <= 50
    for i in range(0, len(gradient), 3):
        slopes = []
        for step in (1e-5, -1e-5):
            network.vector[i] += step
            slopes.append(-log_likelihood(network, packed).sum() / 2e-5)
            network.vector[i] -= step
        assert slopes[0] - slopes[1] == pytest.approx(gradient[i], abs=1e-5, rel=1e-4)


def test_probabilities_add_up_to_one():
    network = small()
    states = np.random.default_rng(0).uniform(-1, 1, (7, 5))
    each = [network.output(states, np.full(7, s)) for s in range(11)]
    assert np.exp(each).sum(axis=0) == pytest.approx(np.ones(7), abs=1e-9)
    calm = network.output(states, np.arange(7), steep=False)
    assert network.output(states, np.arange(7), steep=True) == pytest.approx(calm)
    network.w["classes"] *= 1000
    assert network.steep() and np.isfinite(network.output(states, np.arange(7))).all()


def test_the_state_crosses_windows_and_no_text(monkeypatch):
    network, some = small(np.float32), texts(40, 11)
    some[7] = np.append(np.random.default_rng(5).integers(1, 11, 900), 0)
    monkeypatch.setattr(recurrent, "STREAMS", 8)
    packed, order = recurrent.pack(some)
    found = np.add.reduceat(log_likelihood(network, packed), np.flatnonzero(packed[1]))
    for width in (1, 7, 2_000):
        monkeypatch.setattr(recurrent, "SCORED", width)
        alone = [log_likelihood(network, recurrent.pack([some[i]])[0]).sum() for i in order]
        assert alone == pytest.approx(found.tolist(), rel=1e-4)


def folded(text):
    return (text or "").encode().translate(recurrent.FOLD).split()


def base_by_hand(rows):
    """The contract, word for word."""
    counts = Counter()
    for i, t in rows:
        if i is None or crc32(str(i).encode()) % 5 != 1:
            counts.update([*folded(t), "end"])
    n, v = sum(counts.values()), len(counts)
    found = []
    for i, t in rows:
        tokens = [*folded(t), "end"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out = i is not None and crc32(str(i).encode()) % 5 == 1
        found.append((i, out, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    return sorted(found, key=repr)


def corpus(n=150):
    """Two tongues, each with its words and an order among them."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        tongue = ["ay", "bee", "cee", "dee"] if i % 2 else ["ix", "yps", "zed", "aleph"]
        at, text = 0, []
        for _ in range(rng.randint(5, 80)):
            at = (at + (1 if rng.random() < 0.9 else 2)) % 4
            text.append(tongue[at] if rng.random() < 0.95 else f"rare{rng.randint(0, 300)}")
        rows.append((i, " ".join(text)))
    long = " ".join(rng.choice(["ay", "bee"]) for _ in range(30_000))
    return rows + [(1_000, None), (1_001, ""), (1_002, " \n"), (3, rows[3][1]), (3, rows[3][1]), (None, "Ay BEE Ärger"), (1_003, long), (1_004, "y" * 100 + " ay")]


def report(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, word int, row string")
    out = recurrent.report(docs.repartition(3), **options)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return out.collect()


def test_report_equals_the_contract_and_learns(spark, spread):
    rows = corpus()
    few, many = report(spark, rows, head=8, short=4), report(spark, rows, short=4)
    for got in (few, many):
        assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=repr) == base_by_hand(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # Words that are joined score as those that every task knows; training depends on how tasks are dealt their rows.
    near = {r.doc_id: r.score for r in many}
    assert all(r.score == pytest.approx(near[r.doc_id], rel=0.2, abs=0.5) for r in few)
    out = [r for r in report(spark, rows) if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)  # both below zero


def test_other_words_share_their_symbol_by_smoothed_counts():
    counts = {b"w%d" % i: 40 - i for i in range(30)}
    head = list(counts.items())[:12]
    n = sum(counts.values()) + 9  # and nine ends
    v = recurrent.Vocabulary(head, 9, n, len(counts) + 1, short=5)
    others = list(counts.values())[5:] + [0]  # and one that training never saw
    assert sum(10 ** (math.log10(c + 0.5) - v.log_others) for c in others) == pytest.approx(1)
    assert v.symbol_counts.sum() == n and v.places([b"w0", b"w11", b"w12"]).tolist() == [1, 12, -1, 0]
    assert v.symbols(v.places([b"w0", b"w4", b"w5", b"w12"])).tolist() == [1, 5, 6, 6, 0]


def test_empty_tables_and_no_training_rows(spark):
    assert report(spark, []) == []
    out = next(i for i in range(100) if crc32(str(i).encode()) % 5 == 1)
    (row,) = report(spark, [(out, "a b")])
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and abs(row.base_score) < 1e-9 and math.isfinite(row.score)


def test_texts_are_scored_in_small_packs_with_the_same_scores(spark, monkeypatch):
    rows = [(i, b" ".join(b"w%d" % ((i * j) % 40) for j in range(20 + i % 30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text binary").coalesce(1)
    head = [(b"w%d" % i, 50 - i) for i in range(30)]
    v = recurrent.Vocabulary(head, 9, sum(n for _, n in head) + 9, 31, short=12)
    shape, counts = Shape(v.other + 1), spark.createDataFrame(head, "word binary, n long")
    given, weights = spark.sparkContext.broadcast(v), shape.start(v.symbol_counts)

    def scored():
        return {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in recurrent.score(docs, counts, given, shape, weights).collect()}

    whole, packed = scored(), recurrent.pack

    def watched(held):
        assert sum(map(len, held)) < 500 + 51  # the pack and its last text
        return packed(held)

    monkeypatch.setattr(recurrent, "SCORED_PACK", 500)
    monkeypatch.setattr(recurrent, "pack", watched)
    assert recurrent.PACK > 200 * 51  # by the size of packs for training all texts would be one
    small = scored()
    assert small.keys() == whole.keys() == set(range(200))
    assert all(small[i] == pytest.approx(whole[i], rel=1e-5) for i in whole)


def test_states_without_learning_are_those_of_the_forward_pass():
    rng = np.random.default_rng(5)
    shape = Shape(70)
    network = Network(shape, rng.normal(0, 0.5, len(shape.start(np.ones(70)))).astype(np.float32))
    before = rng.integers(0, 70, (9, 13))
    kept = (rng.random((9, 13, 1)) < 0.8).astype(np.float32)
    state = rng.normal(0, 0.5, (13, shape.hidden)).astype(np.float32)
    expected, _ = network.forward(before, kept, state.copy(), network.inputs())
    assert np.allclose(network.states(before, kept, state.copy(), network.inputs()), expected, atol=1e-6)


def test_a_pack_of_scores_spans_batches(spread, monkeypatch):
    """Rows keep their own scores where packs end within batches and batches within packs."""
    spark = spread
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 40))) for i in range(300)]
    found = []
    for most in (50, 10**9):
        monkeypatch.setattr(recurrent, "SCORED_PACK", most)
        found.append({r.doc_id: r for r in recurrent.report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()})
    for i, text in rows:
        a, b = found[0][i], found[1][i]
        assert a.n_tokens == b.n_tokens == len(text.split()) + 1 and a.n_known == b.n_known
        assert abs(a.base_score - b.base_score) < 1e-9 and abs(a.score - b.score) < 1e-4
