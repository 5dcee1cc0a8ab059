"""Whole paragraphs of pages."""

from quillspark.plans import registry


def test_paragraphs_are_whole(spark, tmp_path):
    html = "<head><style>p{}</style></head><p><b>All</b> of <i>it</i>,<br>here</p><p class=x>styled<div>no</div><!-- <p>no --><p>open<pre>no</pre><param><P></p>"
    spark.createDataFrame([(1, html), (2, None), (3, "none")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = sorted((r["page_id"], r["n"], r["paragraph"]) for r in registry.QUERIES["html_paragraph_blocks"](spark, str(tmp_path)).collect())
    assert rows == [(1, 1, "All of it, here"), (1, 2, "styled"), (1, 3, "open"), (1, 4, "")]
