"""The pipeline's stages on small tables with odd rows, and its registered queries on the smallest tables."""

import pytest

import corpus_pipeline as cp
from synchra.llm import queries as q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def docs(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(100_000, None, None, None, None, 1.0), (100_001, "", "en", "s", 0, None), (100_002, "12 34", None, "s", 5, 0.5), (None, "the thing is there and here it was", None, None, 9, 0.1), (100_003, "some words of the text\n" * 3, "en", "s", 69, 0.2), (100_003, "some words of the text\n" * 3, "en", "s", 69, 0.2)]
    from pyspark.sql import functions as F

    return raw.withColumn("score", F.lit(0.5)).unionByName(spark.createDataFrame(odd, SCHEMA).select(*raw.columns, "score"))


def test_stages(spark, docs):
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "repeats", "packing"]
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, SF)
        after = spark.createDataFrame(after.collect(), after.schema)
        assert tuple(after.columns) == cp.COLUMNS
        a, b = [r.doc_id for r in before.collect()], [r.doc_id for r in after.collect()]
        assert set(b) <= set(a)
        if name == "repeats":
            assert sorted(map(str, b)) == sorted(map(str, set(a)))
            assert all(r.n_chars == len(r.text) for r in after.collect())
        if name == "near_duplicates":
            assert len(b) == len(set(b))
        if name == "language":
            assert 100_002 not in b
        before = after
    packed = cp.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_labelled_documents_stay_or_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in cp.keep_quality(spark, docs, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i in kept) == bool(y) for i, y in labels.items()]
    assert sum(right) >= 0.95 * len(right)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_whole_run(spark):
    assert cp.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_queries_give_a_row_for_each_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert q.queries()[name](spark, SF).select("doc_id").distinct().count() == n


def test_rows_without_an_id_of_their_own_stay(spark):
    """Different clean texts of a null or repeated id all stay; only near copies go."""
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(40))
    data = [(None, text(k)) for k in range(12)] + [(7, text(k)) for k in range(20, 32)] + [(None, text(3)), (9, text(25)), (8, text(26) + " more")]
    docs = spark.createDataFrame([(i, t, f"l{k}", f"s{k}", len(t)) for k, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    once = cp.keep_one_of_similar(spark, docs, SF).collect()
    assert sorted(r.text for r in once) == sorted(text(k) for k in [*range(12), *range(20, 32)])
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in once} <= {tuple(r) for r in docs.collect()}
    rest = cp.cut_repeats(spark, docs, SF).collect()
    assert sorted((r.lang, r.source) for r in rest) == sorted((f"l{k}", f"s{k}") for k in range(len(data)))
    assert {r.lang: r.text for r in rest if r.lang in ("l0", "l12", "l24")} == {"l0": text(0), "l12": text(20), "l24": text(3)}
