"""The registered queries against their SQL, and the pipeline, on the smallest tables."""

import pytest

from palisade.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(name, spark, duck, same):
    same(queries.QUERIES[name](spark, str(DATA)), duck.execute(queries.ORACLE[name]).df())


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.S.checkpointed(stage(spark, docs, str(DATA)))
        assert docs.columns == list(pipeline.COLUMNS), name
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and kept.issuperset(ids) and len(ids) > 0.7 * len(kept), name
        kept = set(ids)
    out = pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert {r["doc_id"] for r in out} == kept and all(r["same"] for r in out)
    assert pipeline.STAGES[1][1](spark, docs.limit(0), str(DATA)).count() == 0
