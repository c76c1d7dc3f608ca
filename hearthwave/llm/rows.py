"""Keys of rows whose doc_id may be null or repeated, and rows told apart by them without a shuffle of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap of hashes: 2 MB, whatever it holds; it comes as at most BITS / 32768 rows of 4 KB.
BITS = 1 << 24


def row_key(doc_id: Column, text: Column) -> Column:
    """One value for rows of equal doc_id and text (a null text counts as empty), another for all others."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))


def whole_key(df: DataFrame) -> Column:
    """One value for rows that are equal in every column, another for all others."""

    def told(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("n"))

    return F.md5(F.concat(*map(told, df.columns)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bitmap_rows(fps: DataFrame) -> DataFrame:
    """(bucket, bits): the bitmap of the column ``fp``."""
    position = F.col("fp").bitwiseAND(F.lit(BITS - 1)) + 1
    return fps.groupBy(F.bitmap_bucket_number(position).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits"))


def by_id(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id is not among ``ids``, all others with a few more): only the second need be joined.

    A bitmap of fixed size tells them apart where they are read. ids: column doc_id, nulls too.
    """
    rows = bitmap_rows(ids.select(F.xxhash64("doc_id").alias("fp")))
    bucket, bits = fresh(docs, "bucket"), fresh(docs, "bits")
    position = F.xxhash64("doc_id").bitwiseAND(F.lit(BITS - 1))
    at = position.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")).cast("int"), F.lit(0)) > 0
    met = docs.withColumn(bucket, F.shiftright(position, 15) + 1).join(F.broadcast(rows.toDF(bucket, bits)), bucket, "left")
    return met.where(~held).select(*docs.columns), met.where(held).select(*docs.columns)
