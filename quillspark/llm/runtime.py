"""What the operators share: scratch tables, ASCII folding, fixed-size bit filters.

Scratch tables go to the folder that the session names in `spark.checkpoint.dir`, which driver and
executors share, so that a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bits of a bit filter: 4 MB when broadcast, however large the data.
FILTER_BITS = 1 << 25
#: Bits in one value of bitmap_construct_agg.
BITMAP_BITS = 32768


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables; a temporary one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the scratch root, deleted when the session's JVM ends."""
    folder = f"{scratch_root(spark)}/quillspark/{label}-{uuid.uuid4().hex}"
    path, fs = _path(spark, folder)
    fs.deleteOnExit(path)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a scratch table and reads it back: lineage ends there."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._quillspark_folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later step reads."""
    for table in tables:
        folder = getattr(table, "_quillspark_folder", None)
        if folder:
            path, fs = _path(table.sparkSession, folder)
            fs.delete(path, True)


def fold_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # then lower() touches A-Z only, and is fast
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row, even where a lambda reads them.

    The optimizer copies a projected expression into the lambda that reads it, to be computed for every
    element; it does not look into a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def release() -> None:
    """Gives the memory that a worker has freed back to the system: workers live on, for other operators' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow and the like, with what it has freed given back at a task's end."""

    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return out


def spread(key: Column) -> Column:
    """A hash of key from 0 to 2 ** 63 - 1, to sample by."""
    return F.shiftrightunsigned(F.xxhash64(key), 1)


def least_hashed(df: DataFrame, key: str, rows: int, of: int) -> DataFrame:
    """The `rows` rows of df with the least hash of key, where df has about `of` rows or more.

    Rows far above the least are dropped by a bound on the hash before any is sorted or sent, so that the last
    step sees some times `rows` of them, however many df has; by chance, of e ** -rows, it gives fewer.
    """
    share = min(1.0, 4 * rows / max(1, of))
    return df.where(spread(F.col(key)) <= int(share * ((1 << 63) - 1024))).orderBy(spread(F.col(key)), key).limit(rows)


def _slot(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def bit_filter(df: DataFrame, *keys: str) -> DataFrame:
    """A Bloom filter with one hash over the keys: at most FILTER_BITS / 8 bytes, whatever df holds.

    One row for each chunk of bits that has any set.
    """
    slot = _slot([F.col(k) for k in keys])
    return (
        df.select((slot / F.lit(BITMAP_BITS)).cast("int").alias("chunk"), (slot % F.lit(BITMAP_BITS)).alias("bit"))
        .groupBy("chunk")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def filter_hits(df: DataFrame, bits: DataFrame, keys: list[Column], out: str) -> DataFrame:
    """df with the boolean column `out`: false means that the keys are certainly not in the filter."""
    slot = _slot(keys)
    chunk, bit = "__quill_chunk", "__quill_bit"
    table = F.broadcast(bits.select(F.col("chunk").alias(chunk), F.col("bits").alias("__quill_bits")))
    byte = F.conv(F.hex(F.expr("substring(__quill_bits, cast(__quill_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("__quill_byte >> cast(__quill_bit % 8 as int) & 1") == 1
    return (
        df.withColumn(chunk, (slot / F.lit(BITMAP_BITS)).cast("int"))
        .withColumn(bit, slot % F.lit(BITMAP_BITS))
        .join(table, chunk, "left")
        .withColumn("__quill_byte", byte)
        .withColumn(out, F.coalesce(hit, F.lit(False)))
        .drop(chunk, bit, "__quill_bits", "__quill_byte")
    )


def drop_rows(df: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """df without the rows whose keys are in `dropped` (its columns are named as in keys).

    A bit filter passes the rows that are certainly kept; only the others are shuffled for the exact
    anti join, so the texts of kept rows stay where they are.
    """
    bits = bit_filter(dropped, *keys)
    marked = filter_hits(df, bits, list(keys.values()), "__quill_maybe")
    sure = marked.where(~F.col("__quill_maybe")).drop("__quill_maybe")
    maybe = marked.where(F.col("__quill_maybe")).drop("__quill_maybe")
    named = dropped.select(*[F.col(k).alias(f"__quill_{k}") for k in keys]).distinct()
    held = maybe.withColumns({f"__quill_own_{k}": c for k, c in keys.items()})
    on = [F.col(f"__quill_own_{k}").eqNullSafe(F.col(f"__quill_{k}")) for k in keys]
    held = held.join(named, on, "left_anti").drop(*[f"__quill_own_{k}" for k in keys])
    return sure.unionByName(held.select(*sure.columns))


def keep_one(df: DataFrame, repeated: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """df with one row, the least, of those with equal keys; `repeated` holds the keys that may be repeated."""
    marked = filter_hits(df, bit_filter(repeated, *keys), list(keys.values()), "__quill_maybe")
    sure = marked.where(~F.col("__quill_maybe")).drop("__quill_maybe")
    maybe = marked.where(F.col("__quill_maybe")).withColumns({f"__quill_own_{k}": c for k, c in keys.items()})
    one = maybe.groupBy(*[f"__quill_own_{k}" for k in keys]).agg(F.min(F.struct(*df.columns)).alias("row"))
    return sure.unionByName(one.select("row.*"))
