"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.runtime import delete, materialise, remember, scratch, shared_dir, store, table, tidy

__all__ = ["ascii_lower", "bitmap_filter", "bound_batches", "buckets_for", "delete", "fold_null", "give_back", "let", "map_texts", "materialise", "may_contain", "probed", "remember", "scratch", "shared_dir", "store", "table", "tidy", "without_spaces"]

# The six characters of [\x20\x09-\x0D], and the two alphabets.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bits held by one row of a bitmap made by bitmap_construct_agg.
BITMAP_BITS = 32768


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain lower() serves where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def without_spaces(text: Column) -> Column:
    for ch in SPACES:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def fold_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# -- a filter of fixed size, made and probed with built-in functions only ------------------


def bitmap_filter(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """One-hash filter of `key` as rows (bucket, bits) of 4 KB; never over buckets x 4 KB.

    The bound is fixed, so the rows may be broadcast whatever the number of keys:
    a fuller filter only lets more rows through to the exact step after it.
    """
    h = F.xxhash64(key)
    return keys.groupBy(F.pmod(h, F.lit(buckets)).cast("int").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.pmod(F.shiftrightunsigned(h, 24), F.lit(BITMAP_BITS))).alias("_bits")
    )


def buckets_for(keys: int) -> int:
    """Buckets of a filter in which about one place in eight is set, 16 (64 KB) to 8,192 (32 MB)."""
    return min(8192, max(16, 8 * keys // BITMAP_BITS))


def probed(df: DataFrame, key: str, bits: DataFrame, buckets: int) -> DataFrame:
    """df with a column _may: whether the row's key may be in the filter; true for every key that is in it."""
    h = F.xxhash64(key)
    at = F.pmod(F.shiftrightunsigned(h, 24), F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_bucket", F.pmod(h, F.lit(buckets)).cast("int")).join(F.broadcast(bits), "_bucket", "left")
    may = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))
    return found.select(*[f"`{c}`" for c in df.columns], may.alias("_may"))


def may_contain(df: DataFrame, key: str, bits: DataFrame, buckets: int) -> DataFrame:
    """Rows of df whose key may be in the filter; no row whose key is in it is lost."""
    return probed(df, key, bits, buckets).where("_may").drop("_may")


def let(value: Column, body) -> Column:
    """body(value) with value computed once.

    A plain column expression that a lambda mentions is computed anew for each element;
    a lambda's own variable isn't.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows that a Python worker turns into objects at a time.
_AT_ONCE = 500

#: Session settings for long texts: Spark's default, and what takes its place.
_FOR_TEXTS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def bound_batches(spark: SparkSession) -> None:
    """Has Spark read fewer texts at a time and cut Arrow batches at fewer bytes, unless the session has its own bounds.

    Long texts make the usual batches large, in the JVM and in the worker. The settings
    stay in the session, as results are computed later; they change no result.
    """
    for key, (default, ours) in _FOR_TEXTS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def give_back() -> None:
    """Returns what a task has freed to the system: a Python worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def map_texts(df: DataFrame, keep: list[str], schema: str, start: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """The columns `keep` of df, and those of `schema` computed from the column text.

    start() is called once a task and returns what is called with the texts of a batch
    (null: empty); it gives one Arrow-convertible list a column. Kept columns pass through
    as Arrow, so nulls and large numbers are the same afterwards.
    """
    df = df.select(*dict.fromkeys([*keep, "text"]))
    new = T.StructType.fromDDL(schema)
    types = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        try:
            for batch in (b.slice(lo, _AT_ONCE) for b in batches for lo in range(0, b.num_rows, _AT_ONCE)):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                made = [x if isinstance(x, pa.Array) else pa.array(x, types.field(i).type) for i, x in enumerate(compute(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, *types.names])
        finally:
            del compute
            give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + new.fields))
