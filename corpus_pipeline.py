"""A training corpus from raw documents, in stages; each keeps the columns of documents but the last.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.

Defined results: rows of one identifier but different texts are decided each by its own text; of rows with the same
identifier (null or not) and equal texts one stays, the least by its columns; a null identifier is less than any other,
so of equal texts it stays only where all have null identifiers, and of near copies it is the one that stays; among
near copies of equal identifier the one of least text digest stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontam, exact_dedup, ngram_join, quality
from quillspark.llm._ship import ship
from quillspark.llm.queries import table, tokenizer_path
from quillspark.llm.runtime import discard, drop_rows, fold_ascii, keep_one, materialize

ORACLE_SQL = None


def row_key() -> Column:
    """A row's identifier and text digest as bytes that sort as the identifiers do, null first."""
    own = F.concat(F.lit("01"), F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.unhex(F.concat(F.coalesce(own, F.lit("00")), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; each row by its own text, so copies stay or go together."""
    ship(spark)
    models = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    good = quality.score(models, F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("double")) >= quality.KEEP_FROM
    return docs.where(good)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) only the document with the largest identifier, once; a null identifier is the smallest."""
    found = materialize(exact_dedup.deduplicate(docs).where("group_size > 1").select("doc_id", "text_sha256", "kept"), "pipeline-copies")
    key = {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(fold_ascii(F.col("text")), 256)}
    repeated = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keep_one(drop_rows(docs, found.where("not kept"), key), repeated, key).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the least identifier, a null one first; texts without words all stay."""
    ship(spark)
    gone = ngram_join.near_duplicates(docs.select(row_key().alias("doc_id"), "text")).where("doc_id <> component_id").select("doc_id")
    return drop_rows(docs, materialize(gone, "pipeline-near"), {"doc_id": row_key()}).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item; a null or empty text holds none and stays."""
    found = decontam.decontaminate(docs.select(row_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return drop_rows(docs, materialize(found, "pipeline-leaks"), {"doc_id": row_key()}).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each kept document's token ids: doc_id, lang, source, n_tokens, ids; a null text has none."""
    ship(spark)
    return bpe.encode(docs, tokenizer_path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source")).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            kept = materialize(kept, "pipeline-stage")
            discard(docs)
        docs = kept
    return docs
