"""Token counts from a digest cache.

The cache is a Parquet table of (digest, version, n_tokens): the SHA-256 of the normalised content (a null
is empty; nothing else is changed, since counts depend on every byte) and of the tokenizer file. Texts are
joined to it by both digests; only distinct misses are encoded, and their counts are appended.

A cache folder serves any number of runs, at the same time too: a run reads what is stored when it begins, and a digest that
two runs append is read once. The query keeps its cache in the folder that the session's CACHE_CONF names, and in a
new one where it names none.

Defined results: an empty or null text has 0 tokens; rows of a null identifier count like others; rows are returned as often as given; an empty table
gives no rows and appends nothing; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import FILTER_BITS, bit_filter, discard, filter_hits, materialize, tidied

#: Segments kept in a worker's table; beyond that it is emptied.
TABLE_SIZE = 400_000
#: The setting that names a lasting cache folder.
CACHE_CONF = "spark.quillspark.tokenCache"
CACHE_SCHEMA = "digest binary, version string, n_tokens long"


class PieceCounter:
    """Counts a sentencepiece model's tokens word by word.

    Where no piece holds the space mark after another character, nothing is merged across a space, so a
    run of spaces and the word after it can be counted alone. Otherwise whole texts are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces) and self._plain()
        self.table: dict[str, int] = {}

    def _plain(self) -> bool:
        """Whether the model changes nothing but adds one space mark in front."""
        probe = "  a  É ﬁ²\t\n x  "
        return self.model.decode(self.model.encode(probe)) == probe and self.model.encode("a b")[:1] == self.model.encode("a")[:1]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def segment(self, segment: str) -> int:
        """A run of spaces and the word after it, its first space left off, as the model adds one."""
        n = self.table.get(segment)
        if n is None:
            n = len(self.model.encode(segment, num_threads=1)) if segment else 1
            if len(self.table) >= TABLE_SIZE:
                self.table.clear()
            if len(segment) <= 64:
                self.table[segment] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.whole([text])[0]
        text = text.replace("▁", " ")
        get, segment = self.table.get, self.segment
        if "  " in text or text[0] == " " or text[-1] == " ":
            # each segment begins with a space, that of the first being the one the model adds
            return sum(get(s) or segment(s) for s in (x[1:] for x in re.findall(" +[^ ]*", " " + text)))
        return sum([get(s) or segment(s) for s in text.split(" ")])


class JsonCounter:
    """Counts the tokens of a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids) if text else 0


@lru_cache(2)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts, one row a digest: runs that missed the same digest at the same time have both appended it."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit. cache: the cache table's folder."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    small = materialize(texts.select("doc_id", "digest", F.octet_length("body").cast("long").alias("n_bytes")), "count-keys")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = _stored(spark, cache, version)
    # The owner of a missing digest is the one row that is encoded for it.
    owners = small.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti")
    owners = materialize(owners, "count-owners")
    if (misses := owners.count()) > 0:
        owned = [F.col("doc_id"), F.col("digest")]
        if misses <= FILTER_BITS // 4:
            # rows that the filter lets through by chance are counted too, and dropped below
            todo = filter_hits(texts, bit_filter(owners, "doc_id", "digest"), owned, "todo").where("todo")
        else:
            todo = texts.join(owners.select(F.col("digest").alias("d"), F.col("doc_id").alias("i")), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count = counter(tokenizer).count
            for batch in batches:
                yield pd.DataFrame({"digest": batch["digest"], "version": version, "n_tokens": [count(t) for t in batch["body"]]})

        counted = todo.select("digest", "body").mapInPandas(tidied(run), CACHE_SCHEMA)
        counted = counted.join(owners.select("digest"), "digest", "left_semi")
        counted.groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache)
        stored = _stored(spark, cache, version)
    discard(owners)
    # written first, so that Spark may split a hot digest of the join
    stored = materialize(stored.join(small.select("digest").distinct(), "digest", "left_semi"), "count-stored")
    return small.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
