"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

A task's rows are its memtable: it is sorted by digest and flushed as one run, a Parquet file with a Bloom filter on the
digest, without a shuffle; a digest stands in as many runs as tasks have met it. Compaction merges runs into the next
level, sorted and with filters again, keeping the smallest and the largest identifier and the count of each digest, combined
before the shuffle, so no digest is hot. lookup() reads only the runs whose statistics and filters let a digest through.
Rows that the index says have a partner are compared with the kept row's bytes; rows of equal digest
but different bytes are grouped anew by the text itself.

Defined results: a null text counts as the empty text; a null identifier can stay only where its whole
group has null identifiers (keep_id is then null and every such row is kept); a repeated row (same
identifier and text) is returned as often as it is given, with equal results; an empty table gives no
rows. Columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bit_filter, discard, filter_hits, fold_ascii, materialize, new_folder


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One index entry for each row: its identifier and the digest of its normalised text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(fold_ascii(F.col(text_col)), 256)).alias("digest"))


def _sorted_run(rows: DataFrame, folder: str) -> None:
    """Appends rows to the index in `folder`: each task's as one run, sorted, with a filter."""
    (
        rows.sortWithinPartitions("digest")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.expected.ndv#digest", "100000")
        .parquet(folder)
    )


def flush(batch: DataFrame, folder: str) -> None:
    """Appends a batch's entries to level 0 in `folder`, one run a task."""
    _sorted_run(batch, folder)


def compact(spark: SparkSession, folder: str, level: str, id_type: str = "long") -> DataFrame:
    """Merges the runs of level 0 into `level`: for each digest the smallest and largest identifier and the number of rows."""
    runs = spark.read.schema(f"doc_id {id_type}, digest binary").parquet(folder)
    _sorted_run(runs.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"), F.count(F.lit(1)).alias("n")), level)
    return spark.read.schema(f"digest binary, least_id {id_type}, most_id {id_type}, n long").parquet(level)


def lookup(index: DataFrame, digests: list[bytes]) -> DataFrame:
    """The index entries of a few digests, by the runs' filters."""
    return index.where(F.col("digest").isin(digests))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: whether the row with the "largest" or the "smallest" identifier of equal texts stays.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    folder, level = new_folder(spark, "dedup-runs"), new_folder(spark, "dedup-level1")
    flush(entries(docs, id_col, text_col), folder)
    small = spark.read.schema(f"doc_id {kind}, digest binary").parquet(folder)
    keeper = "most_id" if keep == "largest" else "least_id"
    index = compact(spark, folder, level, kind).select("digest", F.col(keeper).alias("keep_id"), F.col("n").alias("group_size"))
    shared = index.where("group_size > 1")

    # Only rows that the filter of shared digests lets through carry their text to the comparison.
    texts = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("body"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("body", 256)))
    maybe = filter_hits(texts, bit_filter(shared, "digest"), [F.col("digest")], "maybe").where("maybe").drop("maybe")
    hits = materialize(maybe.join(shared, "digest").select("doc_id", "digest", "body", "keep_id"), "dedup-hits")
    kept = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max("body").alias("kept_body"))
    kept = materialize(kept, "dedup-kept")
    # no distinct here: sharing the join's partitioning, it would keep Spark from splitting a hot digest
    unequal = materialize(hits.join(kept, "digest").where("body <> kept_body").select("digest"), "dedup-unequal")
    discard(kept)

    same = unequal.limit(1).count() == 0
    if same:
        discard(hits)
    out = small.join(index, "digest").select("doc_id", "keep_id", "group_size", "digest")
    if not same:  # digests shared by different texts: those groups go by the text itself
        agg = F.max("doc_id") if keep == "largest" else F.min("doc_id")
        rows = hits.join(unequal, "digest", "left_semi")
        by_text = rows.groupBy("digest", "body").agg(agg.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = rows.select("doc_id", "digest", "body").join(by_text, ["digest", "body"])
        out = out.join(unequal.distinct(), "digest", "left_anti").unionByName(again.select("doc_id", "keep_id", "group_size", "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
