import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hushlake.llm.queries import ORACLES, QUERIES
from hushlake.llm.suffixes import repeated_spans
from hushlake.sources.tables import table
from tests.compare import connect, rows, sql_rows


def test_stages_follow_one_another(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir).cache()
        assert kept.dtypes == docs.dtypes, name
        assert 0 < kept.count() <= before.count()
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    # at most what the cut itself has made is repeated afterwards
    assert repeated_spans(kept).filter(F.size("spans") > 0).count() <= 0.02 * kept.count()
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.select("doc_id").distinct().count() == kept.count()


def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).count()


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), ORACLES[name])
