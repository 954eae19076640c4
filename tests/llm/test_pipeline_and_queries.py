"""The pipeline's stages against plain versions, its edge rows, and the registered queries with SQL."""

import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
import tools.oracle_check as oc
from shopcast.llm import decontam, pii, queries, simhash
from shopcast.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents").cache()
    named = dict(pipeline.STAGES)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes, name
    clear = named["language ID"](spark, docs, SF)
    assert clear.count() >= 0.98 * docs.count()
    items = [decontam.normalised(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaks = {r["doc_id"] for r in docs.collect() if any(i in decontam.normalised(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in named["benchmark decontamination"](spark, docs, SF).collect()}
    assert leaks and not leaks & kept and len(kept) >= docs.count() - len(leaks) - 5
    auto = pii.anchors()
    for r in named["PII"](spark, docs, SF).join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").collect():
        assert not [s for s in pii.spans_of(r["text"], auto)] and r["n_chars"] == len(r["text"])
        assert r["text"] == r["before"] or pii.spans_of(r["before"], auto)
    components = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert {r["doc_id"] for r in named["SimHash near-dedup"](spark, docs, SF).collect()} == components


def test_edge_rows(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "plain words here and there", "en", "s", 5), (2, "plain words here and there", "en", "s", 5),
            (3, "12 34", "en", "s", 5), (4, "long text of words " * 20000, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit(1)).withColumn("ids", F.lit(2))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(rows), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    last = pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == len(rows) and last(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and 100 < out.count() < 200


def test_registered():
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
    assert len(queries.QUERIES) == 13


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    ok, line = oc.compare(spark, oc.duck(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert ok, line


def test_entry_without_the_text_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and "op1_quality" not in entry.oracle_sql()
