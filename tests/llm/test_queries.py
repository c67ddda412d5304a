import pytest
from compare import difference, duck

import corpus_pipeline
from crewmetrics.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_row_of_the_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    rows = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet").select(key)
    assert sorted(r[0] for r in df.collect()) == sorted(r[0] for r in rows.collect())


def test_pipeline_equals_its_stages_by_hand(spark):
    """Each stage against what its operator's report says of the stage's input."""
    from crewmetrics.llm import mixing, near_dups, pu_quality, suffixes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF)
    assert ids(good) == ids(pu_quality.report(docs, labels).where("predicted = 1"))
    known = stages["language"](spark, good, SF)
    assert set(ids(known)) <= set(ids(good)) and len(ids(known)) > 0.95 * good.count()
    single = stages["near duplicates"](spark, known, SF)
    assert ids(single) == ids(near_dups.near_duplicates(known).where("kept"))
    clean = stages["decontamination"](spark, single, SF)
    assert ids(clean) == ids(suffixes.report(single, benchmark).where("not contaminated"))
    mixed = stages["source mix"](spark, clean, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    assert corpus_pipeline.run(spark, SF).columns == docs.columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, mixed.collect()))
