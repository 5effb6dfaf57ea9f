"""Reading inputs and bounded membership bitmaps; written tables come from the library's scratch folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.scratch import written

__all__ = ["bitmap", "marked", "maybe_in", "table", "written"]

#: Bits of one row of a bitmap table; fixed by Spark's bitmap functions.
ROW_BITS = 32768
#: A broadcast bitmap never exceeds this many bits (16 MB), whatever the input.
MAX_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """A table of bitmap rows that covers every key, and its number of bits (16 a key, 2**20 to MAX_BITS)."""
    bits = min(MAX_BITS, max(1 << 20, 1 << (16 * max(count, 1) - 1).bit_length()))
    slot = keys.select(_slot(F.col(key), bits).alias("slot"))
    rows = slot.groupBy(F.floor(F.col("slot") / ROW_BITS).alias("bm_row")).agg(
        F.bitmap_construct_agg(F.col("slot") % ROW_BITS).alias("bm_bits")
    )
    return rows, bits


def marked(df: DataFrame, key: Column, marks: tuple[DataFrame, int]) -> DataFrame:
    """df with a column bm_maybe: false only where the key is surely not among the bitmap's keys.

    The bitmap is broadcast: MAX_BITS bounds its size. A full bitmap passes more rows, so exact joins must follow.
    """
    rows, bits = marks
    probed = df.withColumn("bm_slot", _slot(key, bits)).join(
        F.broadcast(rows), F.floor(F.col("bm_slot") / ROW_BITS) == F.col("bm_row"), "left"
    )
    byte = f"cast(conv(hex(substring(bm_bits, cast((bm_slot % {ROW_BITS}) div 8 + 1 as int), 1)), 16, 10) as int)"
    bit = F.expr(f"coalesce(shiftright({byte}, cast(bm_slot % 8 as int)) & 1, 0) = 1")
    return probed.withColumn("bm_maybe", bit).drop("bm_slot", "bm_row", "bm_bits")


def maybe_in(df: DataFrame, key: Column, marks: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose key may be among the bitmap's keys; none that is there gets lost."""
    return marked(df, key, marks).filter("bm_maybe").drop("bm_maybe")
