"""Relational operators against their DuckDB oracles, and hand-made cases."""

import duckdb
import pytest

from segmenta.plans import registry
from segmenta.plans.dialect import SPARK
from segmenta.sources.views import with_views

SF = "/root/testdata/sf0.001"
SOME = "sentence_records chunk_packing chapter_assembly block_submission_parse tsv_submission_parse boundary_merge effective_lenient effective_strict stale_reviews legacy_store_override rule_empty_target rule_outer_quotes rule_placeholders rule_record_sets term_audit glossary_fingerprint normalised_block phrase_candidates candidate_ids bucket_topk forbidden_terms required_terms review_chain export_pick activate_latest task_status json_submission_parse record_view language_policy progress_by_doc budget_prefix budget_overshoot review_snapshot qa_leftovers hyphen_variant_merge style_metrics".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", SOME)
def test_matches_oracle(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(registry.oracles()[name]).df())


def test_every_query_plans(spark):
    for name, query in registry.queries().items():
        assert query(spark, SF).columns, name


def test_budget_keeps_first_row(spark):
    got = registry.queries()["budget_prefix"](spark, SF).groupBy("doc_id").count().toPandas()
    assert (got["count"] >= 1).all()


def test_null_and_empty_documents(spark):
    spark.createDataFrame([(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t", "en", "s"), (4, "A b. C d!", "en", "s")], "doc_id long, text string, lang string, source string").createOrReplaceTempView("documents")
    got = spark.sql(with_views("SELECT doc_id, source FROM v_records ORDER BY record_pos", SPARK)).collect()
    assert [tuple(r) for r in got] == [(4, "A b."), (4, "C d!")]
