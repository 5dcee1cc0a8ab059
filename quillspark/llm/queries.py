"""The queries of this subpackage, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exact_dedup, html_main, ngram_join, packing, pii, quality, token_cache, toxicity
from ._ship import ship
from .runtime import new_folder


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written id matrix as it is read back: its rows' digests (of the ids without padding, little-endian int32) and segments."""
    folder = new_folder(spark, "packed")
    packing.write_matrix(packing.matrix(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), length=8192, end="<|endoftext|>"), folder)
    n = F.element_at("cu_seqlens", -1)
    return packing.read_matrix(spark, folder).select(
        "pack_id",
        n.cast("long").alias("n_tokens"),
        F.size("doc_ids").cast("long").alias("n_segments"),
        "doc_ids",
        "offsets",
        "cu_seqlens",
        F.sha2(F.substring("matrix_row", F.lit(1), 4 * n), 256).alias("ids_sha256"),
        F.size("position_resets").cast("long").alias("n_resets"),
    )


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op4_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score", "quality_kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = spark.conf.get(token_cache.CACHE_CONF, None) or new_folder(spark, "token-cache")
    return token_cache.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), cache)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_packing": op2_packing,
        "op3_personal_data": op3_personal_data,
        "op4_html_main": op4_html_main,
        "op5_quality": op5_quality,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_ngram_join": op7_ngram_join,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity": op9_toxicity,
        "op10_decontaminate": op10_decontaminate,
    }


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": f"""
            WITH n AS (SELECT doc_id, {FOLDED} AS body FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY body)""",
            "op7_ngram_join": f"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d WHERE len(w) > 0),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
            e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
            r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
            m AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
            SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
            FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id""",
        "op10_decontaminate": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM documents),
            i AS (SELECT item_id, w, least(len(w), 10) AS span FROM (SELECT item_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM benchmark) WHERE len(w) > 0),
            v AS (SELECT DISTINCT item_id, span, array_to_string(w[k:k + span - 1], ' ') AS run FROM i, unnest(range(1, len(w) - span + 2)) AS u(k)),
            t AS (SELECT doc_id, k AS place, span, array_to_string(w[k:k + span - 1], ' ') AS run FROM d, (SELECT DISTINCT span FROM i), unnest(range(1, len(w) - span + 2)) AS u(k)),
            h AS (SELECT DISTINCT doc_id, place, span, item_id FROM t JOIN v USING (span, run)),
            a AS (SELECT doc_id, count(DISTINCT place + k) AS n_hit FROM h, unnest(range(0, span)) AS u(k) GROUP BY 1),
            b AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
            FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""",
    }
