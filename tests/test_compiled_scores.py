"""Code that Spark makes of the scores: methods over 8,000 bytes are never compiled by the JVM, and a row then costs many times as much."""

import re

import pytest

from segmenta.plans import registry


@pytest.mark.parametrize("name", ["candidate_scores", "suppressed_counts"])
def test_the_scores_code_is_short_enough_to_be_compiled(spark, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        said = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]
    assert sizes and max(sizes) < 8000
