import math
import random

import numpy as np
import pytest

from crewmetrics.llm import language as L

WORDS = {
    "en": "the of and water house with from river this that".split(),
    "de": "der die und wasser haus mit aus fluss dieses nicht".split(),
    "fr": "le la et eau maison avec depuis fleuve cette pas".split(),
}
DOCS = "doc_id long, text string, lang string, source string, host string, post string"
PAGES = "page_id long, url string, html string, logs string"


def text(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def docs_of(rng, n=90):
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, text(rng, lang, 30), lang, f"s{i % 3}", "h", "p"))
    return [*rows, (900, None, "en", None, None, None), (901, "x", None, "s1", None, None), (None, "y", "de", None, None, None)]


def pages_of(rng, n=60):
    rows = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else rng.choice(list(WORDS))
        host = "www.haus.de" if i % 3 == 0 else rng.choice(["a.example.com", "b.example.com", "m.example.org"])
        declared = f' lang="{lang}-XX"' if i % 4 else ""
        path = f"/{lang}/x" if i % 5 else "/x"
        body = text(rng, lang, rng.choice([0, 2, 25]))
        rows.append((i, f"http://{host}{path}?q=1", f"<html{declared}><script>the the</script><p>{body}</p>", lang))
    return rows


def brute(pages, model):
    """The same fusion, page by page, with sums over all other pages."""
    import re

    def normal(x):
        return x / x.sum()

    rows = []
    for page_id, url, html, *_ in pages:
        url, html = url or "", html or ""
        host = (re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url) or [None, ""])[1].lower() or None
        code = re.match(r"^[^?#]*?//[^/?#]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:[/?#]|$)", url)
        lang = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", html, re.I | re.S)
        keys = {
            "suffix": host and host.rsplit(".", 1)[-1], "domain": host and ".".join(host.split(".")[-2:]), "host": host,
            "code": code and code[1].lower(), "declared": lang and lang[1].lower(),
        }
        logs = np.array(model.likelihoods(L._HIDDEN.sub(" ", html) if html else html))
        rows.append((page_id, keys, logs, normal(np.exp(logs) * model.prior)))
    out = []
    for i, (page_id, keys, logs, own) in enumerate(rows):
        total = sum(r[3] for j, r in enumerate(rows) if j != i) + L.ALPHA
        same = lambda k: sum((r[3] for j, r in enumerate(rows) if j != i and r[1][k] == keys[k]), np.zeros(len(own)))  # noqa: E731, B023
        p = normal(total)
        for k in ("suffix", "domain", "host"):
            rest = same(k) if keys[k] is not None else 0
            p = normal(rest + L.KAPPA * p)
        joint = np.exp(logs) * p
        for k in ("code", "declared"):
            if keys[k] is not None:
                joint = joint * (same(k) + L.ALPHA / len(own)) / (total + L.ALPHA)
        p = normal(joint)
        out.append((page_id, keys["host"], keys["declared"], model.languages[int(np.argmax(logs))], model.languages[int(np.argmax(p))], p.max()))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame(docs_of(rng), DOCS)
    pages = pages_of(rng) + [(100, None, None, None), (101, "nonsense", "", None), (None, "http://a.example.com/de", "<p>la la", None)]
    pages += [pages[5]]
    got = L.report(spark.createDataFrame(pages, PAGES).repartition(4), docs).collect()
    want = brute(pages, L.train(docs))
    key = lambda r: (str(r[0]), str(r[1]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-9)


def test_evidence_helps_where_texts_are_short(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame(docs_of(rng), DOCS)
    pages = pages_of(rng, 300)
    truth = {p[0]: p[3] for p in pages}
    rows = L.report(spark.createDataFrame(pages, PAGES), docs).collect()
    fused = sum(r.lang == truth[r.page_id] for r in rows)
    assert fused > sum(r.text_lang == truth[r.page_id] for r in rows) and fused > 0.95 * len(rows)


def test_tasks_without_labelled_rows(spark):
    docs = spark.createDataFrame(docs_of(random.Random(5), 3), DOCS).repartition(40)
    assert L.train(docs).languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").select("text", "lang").collect()
    right = [model.languages[int(np.argmax(model.likelihoods(r.text)))] == r.lang for r in rows]
    assert np.mean(right) > 0.97


def test_rows_in_known_languages_stay_whole(spark):
    rng = random.Random(3)
    rows = docs_of(rng)
    docs = spark.createDataFrame(rows, DOCS)
    kept = L.keep_identified(docs, docs)
    assert kept.columns == docs.columns
    left = sorted(map(tuple, kept.collect()), key=str)
    assert all(r in rows for r in left) and sum(r[0] is not None and r[0] < 900 for r in left) == 90
    german = L.keep_identified(docs, docs, languages=["de"])
    assert {r.lang for r in german.collect() if r.doc_id is not None and r.doc_id < 900} == {"de"}


POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem"
RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью"


def test_texts_in_no_known_language_go_whatever_they_declare(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(7)
    salad = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(150))
    odd = [(-1, POLISH), (-2, RUSSIAN), (-3, salad), (-4, salad * 500), (-1, POLISH)]
    # Too little to tell, nothing to tell from, and a known language.
    fine = [(-5, "xqz"), (-6, None), (-7, ""), (-8, "12 34 56"), (-9, docs.where("lang = 'de'").first().text)]
    added = spark.createDataFrame([(i, t, "en") for i, t in odd + fine], "doc_id long, text string, lang string")
    every = docs.unionByName(added, allowMissingColumns=True)
    kept = sorted(r.doc_id for r in L.keep_identified(every, every).select("doc_id").collect())
    assert [i for i in kept if i < 0] == [-9, -8, -7, -6, -5]
    assert len(kept) - 5 > 0.999 * docs.count()


def test_a_text_fits_by_its_mean_alone(spark):
    """Against sums trigram by trigram."""
    model = L.train(spark.createDataFrame(docs_of(random.Random(1)), DOCS))
    text = "the water der qzx"
    letters, total = f" {text} ".encode(), np.zeros(len(model.languages))
    for i in range(len(letters) - 2):
        h = sum(int(f) * c for f, c in zip(L._FACTORS, letters[i : i + 3])) % (1 << 32)
        total += model.logs[h >> 20]
    n = len(letters) - 2
    assert model.evidence(text)[1] == pytest.approx(total.max() / n + math.log(L.BUCKETS) + 3 * L.FIT_SPREAD / math.sqrt(n))


def test_nothing_known(spark):
    docs, pages = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "http://a/", "<p>x", None)], PAGES)
    assert [tuple(r) for r in L.report(pages, docs).collect()] == [(1, "a", None, None, None, 0.0)]
    some = spark.createDataFrame(docs_of(random.Random(4)), DOCS)
    assert L.report(pages.limit(0), some).collect() == []
    assert L.keep_identified(some, docs).count() == some.count()
    assert L.keep_identified(docs, some).collect() == []
    assert math.isclose(sum(L.train(some).prior), 1)
