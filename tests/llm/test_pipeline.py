import os

import pytest

import corpus_pipeline
from strokeline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def test_stages_keep_clean_documents(spark):
    docs = queries.table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{n}-{os.getpid()}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        assert 0.5 * before < docs.count() <= before, name
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}


def test_stages_over_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame([(i, t, g, "s", None if t is None else len(t)) for i, t, g in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() > 20 and docs.where("text is null or text = ''").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    rows = queries.QUERIES[name](spark, DATA).collect()
    table = "pages" if name == "op8_arc_to_warc" else "documents"
    if name == "op4_benchmark_leaks":
        assert rows
    elif name == "op13_conversation_repair":
        assert {r.conv_id for r in rows} == {r.conv_id for r in queries.table(spark, DATA, "conversations").collect()} and len({r.conv_id for r in rows}) == len(rows)
    else:
        assert len(rows) == queries.table(spark, DATA, table).count()
