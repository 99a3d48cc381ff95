import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from helpers import DOCS, awkward, empty, prose, rows
from test_texts import component_of, fingerprint, fixed_formats, hit_words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    bench = [(1, prose(500, 30)), (2, "tiny item")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = [(i, prose(i, 80), "en") for i in range(60)] + [(200 + i, prose(i, 80), "en") for i in range(5)]
    rows += [(300, prose(500, 30) + " end", "en"), (301, "call +1 (555) 555-1234 or ann@mail.example.com " + prose(9, 50), "en"), (302, None, "en"), (303, "??", "en"), (304, prose(3, 5000), "en")]
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    first = stage["language ID"](spark, docs, folder)
    assert {r.doc_id for r in first.collect()} == set(given) - {302, 303} and first.columns == docs.columns
    second = stage["SimHash near-dedup"](spark, docs, folder)
    groups = component_of({i: fingerprint(t) for i, t in given.items()})
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, g in groups.items() if i == g)
    third = stage["benchmark decontamination"](spark, docs, folder)
    items = [(1, prose(500, 30)), (2, "tiny item")]
    assert {r.doc_id for r in third.collect()} == {i for i, t in given.items() if not hit_words(t, items)[4]} != set(given)
    fourth = {r.doc_id: r for r in stage["PII"](spark, docs, folder).collect()}
    assert all(not fixed_formats(r.text) and (r.text is None or r.n_chars == len(r.text)) for r in fourth.values())
    assert all(fourth[i].text == t for i, t in given.items() if not fixed_formats(t))


def test_contamination_is_judged_row_by_row(spark, folder):
    bad, good = prose(500, 30), prose(9, 50)
    given = [(None, bad), (None, good), (7, bad), (7, good), (7, good), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in given], DOCS).withColumn("digest", F.lit("clash"))
    out = corpus_pipeline.decontamination(spark, docs, folder)
    assert out.columns == docs.columns and rows(out, "doc_id", "text") == sorted(((i, t) for i, t in given if t != bad), key=repr)


def test_run_packs_what_the_stages_keep(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert not set(got.doc_id) & {200, 201, 202, 203, 204, 300, 302, 303} and {0, 301, 304} <= set(got.doc_id)
    assert got.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("make", [awkward, empty])
def test_every_stage_handles_awkward_rows(spark, folder, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        if "row" in docs.columns:
            assert out.filter("`row` != 'clash' OR score != 'clash'").count() == 0
        if name == "SimHash near-dedup":
            assert out.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).filter("length > 2048").count() == 0


def test_no_text_is_shuffled_to_drop_rows(spark, tmp_path):
    """Copies and their ids leave without an exchange of the texts, by either way with the same rows."""
    rows = [(1, "the same words in a row here"), (2, "the same words in a row here"), (3, "quite another text with other words"), (4, None), (4, "b second of two rows"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs.filter("doc_id <> 4"), "")
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    by_broadcast = sorted(map(str, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    sent, corpus_pipeline.SENT = corpus_pipeline.SENT, -1
    try:
        by_exchange = sorted(map(str, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    finally:
        corpus_pipeline.SENT = sent
    assert by_broadcast == by_exchange and len(by_broadcast) == 4
