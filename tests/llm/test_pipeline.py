from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from healthloom.llm.common import read


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        seen[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    ids = {n: Counter(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert set(ids["near_duplicates"]) < set(ids["quality_rules"]) < {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert ids["personal_data"] == ids["near_duplicates"]
    assert set(ids["source_mixing"]) <= set(ids["personal_data"])
    packed = seen["sequence_packing"]
    whole = packed.groupBy("doc_id").agg((F.sum("length") / F.max("doc_tokens")).alias("n")).collect()
    assert {r["doc_id"]: round(r["n"]) for r in whole} == dict(ids["source_mixing"])


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


AWKWARD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a few words " * 20, "en", "s", 240), (4, "x " * 60_000, "en", None, 120_000), (5, "Mr John Smith wrote to ana@b.com about " + "many different things of this wide world " * 3, "en", "s", 9), (5, "Mr John Smith wrote to ana@b.com about " + "many different things of this wide world " * 3, "en", "s", 9)]


@pytest.mark.parametrize("rows", [[], AWKWARD[:1], AWKWARD])
def test_stages_of_awkward_tables(spark, rows):
    """Nulls in any column, empty and very long texts, repeated rows, one row, none; a column more with a clashing name."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__host", F.lit(1)).withColumn("copies", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "").collect()
        assert len(found) <= 400 and (rows or not found)
        if name != "sequence_packing" and rows:
            assert all(set(r.asDict()) == set(docs.columns) for r in found)
