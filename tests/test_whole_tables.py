"""The text queries read every row of their tables."""

import pytest

from quillspark.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["run_direction", "document_language", "furniture_signature", "list_markers", "escapes", "longest_backticks", "html_entity_lines"])
def test_all_lines(spark, name):
    n = registry.QUERIES["text_to_lines"](spark, SF).count()
    assert registry.QUERIES[name](spark, SF).count() == n + len(registry.SAMPLE_LINES)


def test_all_parts(spark):
    part = spark.read.parquet("/root/testdata/sf0.1/part.parquet")
    assert registry.QUERIES["letter_labels"](spark, "/root/testdata/sf0.1").count() == part.count() > 2000
