import random

import pytest
import sentencepiece

from crewmetrics.llm import tokens

public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts_of(seed):
    rng = random.Random(seed)
    letters = "abc the in ing on   \n\n\té世界😀ñ▁=-#01.,<s>"
    made = [None, "", "a", " ", "a" * 9000, " " * 5001, "=-" * 4000, "世界" * 3000, "<s></s>" * 900]
    made += ["".join(rng.choices(letters, k=rng.choice([5, 700, 3000]))) for _ in range(12)]
    made += [" ".join(rng.choices(["the", "a", "national", "éé", "世", "foo"], k=2000))]
    return made + made[-2:]


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (256, 8), (300, 64)])
def test_counts_equal_the_library(spark, model, chunk, overlap):
    rows = [(i % 23, t, "clash") for i, t in enumerate(texts_of(1))] + [(None, "no id", None)]
    got = tokens.count_tokens(spark.createDataFrame(rows, SCHEMA), PATH, limit=700, chunk=chunk, overlap=overlap)
    want = [
        (i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 700) for i, t, _ in rows
    ]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(w[3] for w in want)


def test_offsets_cover_the_text(model):
    for text in texts_of(2):
        codes = tokens.spans(text or "", 100, PATH)
        ids = model.encode(text or "")
        assert len(codes) == len(ids)
        for code, i in zip(codes, ids):
            if code >= 0:
                at, n = divmod(int(code), tokens.LONGEST)
                piece = model.id_to_piece(i).replace("▁", " ")
                assert (" " + (text or "").replace("▁", " "))[at - 100 + 1 : at - 100 + 1 + n] == piece


def test_overlaps_widen_where_nothing_is_shared(spark, monkeypatch):
    """A run of one letter has no shared token until a chunk reaches its end."""
    seen = []
    whole = tokens._encode
    monkeypatch.setattr(tokens, "_encode", lambda size, overlap, path: seen.append(overlap) or whole(size, overlap, path))
    df = spark.createDataFrame([(1, "ab" * 3001)], "doc_id long, text string")
    tokens.count_tokens(df, PATH, chunk=128, overlap=3).collect()
    assert seen == sorted(seen) and len(seen) > 1 and seen[0] == 3


def test_no_documents(spark):
    assert tokens.count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_only_chunks_beside_a_failed_seam_are_widened():
    assert tokens.widened([]) == []
    assert tokens.widened([(3, 4, 5)]) == [(3, 5)]
    assert tokens.widened([(4, 5, 6), (0, 1, 2), (1, 2, 4)]) == [(0, 4), (4, 6)]
    # Eight chunks at once; the seam between two such runs waits for the next round.
    run = [(i, i + 1, i + 2) for i in range(20)]
    assert tokens.widened(run) == [(0, 8), (8, 16), (16, 21)]
    assert tokens.widened([(0, 8, 16), (8, 16, 21)]) == [(0, 21)]


def test_copies_of_a_huge_text_are_encoded_once(spark, model):
    """Copies under many ids, under one id and under none; alone, without any id, too."""
    text, other = "the national " * 300, "世界 in the " * 200
    rows = [(i, text) for i in range(5)] + [(2, text), (None, text), (None, other), (None, other)]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, chunk=200, overlap=16)
    want = [(i, len(model.encode(t))) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == sorted(want, key=str)
