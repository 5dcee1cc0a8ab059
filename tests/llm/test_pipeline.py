"""The pipeline's row-dropping stages on null and repeated identifiers, against brute force."""

import re

import corpus_pipeline
from test_operators import brute_components, fold


def test_null_and_repeated_identifiers(spark, tmp_path):
    passage = " ".join(f"item{k}" for k in range(12))
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "same text"), (1, "same text"), (2, "Same Text"), (None, "same text"), (None, "none"), (None, "none")]
    rows += [(3, f"x {passage}"), (3, "clean"), (None, f"y {passage}"), (None, "also clean"), (-4, "minus"), (-4, "minus")]
    rows += [(5, long), (6, f"{long} a"), (6, "own words"), (None, f"{long} b"), (None, f"{long} c"), (7, None), (None, "")]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    order = lambda i: (i is not None, i or 0)
    copies = {}
    for i, t in rows:
        copies[fold(t)] = max(copies.get(fold(t), i), i, key=order)
    want = sorted(((i, t) for t, i in copies.items()), key=lambda r: order(r[0]))
    near = {k: c for k, (_, c) in brute_components([t for _, t in want]).items()}
    kept = [r for k, r in enumerate(want) if near[k] == k]
    leaked = [r for r in kept if not re.search(passage, r[1])]

    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    ids = lambda df: sorted(((r["doc_id"], fold(r["text"])) for r in df.collect()), key=str)
    df = corpus_pipeline.materialize(corpus_pipeline.drop_copies(spark, df, str(tmp_path)), "test")
    assert ids(df) == sorted(want, key=str)
    df = corpus_pipeline.materialize(corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)), "test")
    got = ids(df)
    # near copies of one identifier: any one may be the least by digest
    short = lambda rows: sorted(((i, t[:-2] if t.startswith(long) and t != long else t) for i, t in rows), key=str)
    assert short(got) == short(kept)
    got = ids(corpus_pipeline.drop_leaks(spark, df, str(tmp_path)))
    assert short(got) == short(leaked)
