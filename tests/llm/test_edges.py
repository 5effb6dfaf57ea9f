"""Every stage, and the pipeline, over tables of odd rows and over empty ones."""

import pytest
from helpers import no_documents, odd_documents

import corpus_pipeline
from sparkloom.llm import mixing, topk

DATA = "/root/testdata/sf0.001"


def odd(spark):
    docs = odd_documents(spark)
    return docs.unionByName(docs.filter("doc_id = 9").selectExpr("cast(null as long) doc_id", "'nobody owns this text' text", *[c for c in docs.columns if c not in ("doc_id", "text")]))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage(spark, name, stage):
    docs = odd(spark)
    got, none = stage(spark, docs, DATA), stage(spark, no_documents(spark), DATA)
    assert none.count() == 0 and none.columns == got.columns
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got.select("doc_id").collect())
    if name != "bpe":
        assert got.columns == docs.columns
    if name == "toxicity":
        # none of these texts is toxic to a model of other texts
        assert ids == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11]
    elif name == "exact_dedup":
        assert ids == [-1, 2, 6, 7, 8, 9, 10, 11]
    elif name == "near_dedup":
        assert ids == [-1, 1, 3, 4, 5, 6, 7, 9, 10, 10, 11]
    elif name == "mixing":
        assert len(ids) == sum(len(r["draws"]) for r in mixing.mix(docs).collect()) and max(map(ids.count, set(ids))) <= 4
    else:
        tokens = {r["doc_id"]: r["n_tokens"] for r in got.collect()}
        assert len(ids) == 13 and tokens[4] == tokens[5] == 0 and tokens[7] > 20_000


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_runs(spark, tmp_path, empty):
    (no_documents(spark) if empty else odd(spark)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([] if empty else [(1, 0, 1), (None, 1, None), (2, None, 0)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert (got.count() == 0) if empty else ({r["doc_id"] for r in got.collect()} <= {None, *range(1, 12)} and got.count() > 0)


def test_search_ignores_other_columns(spark):
    rows = [(k, k * 3, "b", 1.0, k) for k in range(30)]
    codes = spark.createDataFrame(rows, "vec_id long, code long, block string, distance double, slice long")
    got = topk.top_k(codes, codes.filter("vec_id < 3"), 2)
    assert got.count() == 6 and set(got.columns) == {"query_id", "vec_id", "distance", "rank"}
