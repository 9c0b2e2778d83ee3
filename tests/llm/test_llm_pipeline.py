import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.dirname(os.path.abspath(__file__))]

import oracle  # noqa: E402
import pytest  # noqa: E402

from conftest_llm import SF, documents  # noqa: E402


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_minhash_near_dedup", "op4_benchmark_decontamination", "op10_quality_rules"])
def test_query_against_sql(spark, entry, name):
    from pitpanel.queries import Query

    ok, message, _ = oracle.compare(spark, oracle.duck(SF), Query(name, entry.queries()[name], "", entry.oracle_sql()[name]), SF)
    assert ok, message


def test_eleven_queries(entry):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages(spark):
    import corpus_pipeline as cp
    from pitpanel.llm import near_dedup, secret_tags

    docs, kept = documents(spark), None
    for (name, stage), k in zip(cp.STAGES[:-1], range(4)):
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        if k == 1:
            want = near_dedup.near_duplicates(docs, percent=80).filter("kept").select("doc_id")
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in want.collect()}
        if k == 2:
            kept = {r.doc_id for r in out.collect()}
        if k == 3:
            assert {r.doc_id for r in out.collect()} == kept
            assert not [r for r in out.collect() if secret_tags.base_spans(r.text)]
        docs = out
    pieces = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == kept
