import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewmetrics.llm import pu_quality as Q

DOCS = "doc_id long, text string, quality int, score double"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def corpus(n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper(), 0, 9.0))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    rows += [(n, None, None, None), (n + 1, "", None, None), (None, "no id at all", None, None), rows[7], (n + 2, "x" * 300_000, None, None)]
    labels += [(None, 1, 0), (n + 50, 1, 0), (3, None, 0)]
    return rows, labels


def test_held_out_accuracy_and_shape(spark):
    rows, labels = corpus()
    got = Q.report(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in rows)
    truth = {i: q for i, q, _ in labels if q is not None}
    scored = {r.doc_id: r for r in got}
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    test = [i for i in truth if i in scored and held_out(i)]
    assert len(test) > 20 and np.mean([scored[i].predicted == truth[i] for i in test]) > 0.95


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus()
    turned = [(i, 1 - q if held_out(i) and q is not None else q, t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, DOCS)
    one, two = (
        {str(r.doc_id): r.score for r in Q.report(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned)
    )
    assert one == pytest.approx(two, abs=1e-9)


def test_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = Q.report(docs, labels).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_risk_is_that_of_the_method():
    """The fit lowers the non-negative risk, and its bounded part stays near or above zero."""
    rng = np.random.default_rng(1)
    p = rng.normal(1, 1, (300, Q.N_FEATURES))
    u = np.concatenate([rng.normal(1, 1, (350, Q.N_FEATURES)), rng.normal(-2, 1, (150, Q.N_FEATURES))])
    model = Q.fit(p, u, 0.7)

    gp, gu = (np.log(s / (1 - s)) for s in (model.score(p), model.score(u)))
    rest = np.logaddexp(0, gu).mean() - 0.7 * np.logaddexp(0, gp).mean()
    risk = 0.7 * np.logaddexp(0, -gp).mean() + max(0.0, rest)
    assert risk < 0.7 * np.log(2) + 0.3 * np.log(2) and rest > -0.1
    assert (model.score(u[:350]) > 0.5).mean() > 0.9 and (model.score(u[350:]) < 0.5).mean() > 0.9


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", None, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in Q.report(docs, none).collect()] == [0.5]
    assert Q.report(docs.limit(0), none).collect() == []


def test_the_prior_is_the_share_of_good_labels_even_if_few_are_good(spark):
    rows = [(i, f"some words of text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int")
    known = labels.where(Q.fold(F.col("doc_id")) != Q.HELD_OUT).agg(F.avg("quality")).first()[0]
    assert known < 0.4
    assert abs(Q.train(docs, labels).prior - known) < 1e-9
