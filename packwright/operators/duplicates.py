"""Repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright import standard as S
from packwright.functions.value_types import blank_nan, column

def _text_form(c: Column, kind: T.DataType) -> Column:
    """A value as text that is equal for equal values of the type."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.MapType):
        # Entries of equal maps may be stored in any order.
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0).cast(kind)).cast("string")  # zero has one sign
    return c.cast("string")


def row_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 digest of a row, equal for equal rows.

    NaN and null count as equal; maps and variants are compared as JSON. Every value goes in
    with its length, a missing one as a mark of its own, so no two rows run together. A
    shuffle on the key carries 32 bytes a row, however wide the table.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns or df.columns:
        text = _text_form(blank_nan(name, types[name]), types[name])
        parts += [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``rows, distinct_rows, duplicates, duplicate_fraction, exceeds`` of a table.

    Rows are counted per key inside each task first, so a row that makes up a
    third of the table costs one partial count per task.
    """
    groups = df.select(row_key(df, columns).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                       F.count(F.lit(1)).alias("distinct_rows"))
    share = (F.when(F.col("rows") > 0,
                    F.col("duplicates").cast("double") / F.col("rows").cast("double"))
             .otherwise(F.lit(0.0)))
    return (
        total.withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))
        .withColumn("duplicate_fraction", share)
        .withColumn("exceeds", F.col("duplicate_fraction") > S.MAX_DUPLICATE_FRACTION)
    )


def flag_duplicates(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Add ``is_duplicate``: the row repeats one with a smaller ``row_id``.

    ``row_id`` must be unique and not null, which is checked as the rows are joined. The first row of every
    group is found by a partial aggregate, and the mask is a join on ``row_id``, so rows
    of one large group are spread evenly instead of meeting in one task.
    """
    firsts = (
        df.select(column(row_id).alias("_row"), row_key(df, columns).alias("_key"))
        .groupBy("_key").agg(F.min("_row").alias("_row"))
        .select("_row", F.lit(True).alias("_first"))
    )
    ids = df.groupBy(column(row_id).alias("_row")).agg(F.count(F.lit(1)).alias("_rows")).join(firsts, "_row", "left")
    wrong = F.raise_error(F.lit(f"{row_id} must be unique and not null")).cast("boolean")
    return (
        df.join(ids, column(row_id) == F.col("_row"), "left")
        .withColumn("is_duplicate", F.when(F.coalesce("_rows", F.lit(0)) != 1, wrong).otherwise(F.col("_first").isNull()))
        .drop("_first", "_rows", "_row")
    )
