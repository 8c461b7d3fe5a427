"""Mixed value types in raw (text) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.value_types import column, filled_value_type


def typed_cells(df: DataFrame, row_id: str, raw_columns: list[str]) -> DataFrame:
    """Cells with a value in long form: ``row, column, value, value_type``."""
    return (
        df.select(column(row_id).alias("row"), F.inline(F.array(*[
            F.struct(F.lit(name).alias("column"), column(name).alias("value")) for name in raw_columns])))
        .where(F.col("value").isNotNull())
        .withColumn("value_type", filled_value_type(F.col("value")))
    )


def type_tally(cells: DataFrame) -> DataFrame:
    """``column, value_type, n, first_row``, counted inside each task before the shuffle."""
    return cells.groupBy("column", "value_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


def expected_type(tally: DataFrame) -> DataFrame:
    """Most frequent type per column; on a tie the type seen first."""
    return tally.groupBy("column").agg(
        F.min_by("value_type", F.struct(-F.col("n"), "first_row")).alias("expected_type"))


def _types_in_order() -> Column:
    seen = F.array_sort(F.collect_list(F.struct("first_row", "value_type")))
    return F.array_join(F.transform(seen, lambda s: s["value_type"]), ", ")


def mixed_type_columns(tally: DataFrame) -> DataFrame:
    """Columns with more than one value type, as errors.

    A tally has at most one row per column and type, so the lists stay short.
    """
    return (
        tally.groupBy("column").agg(
            F.count(F.lit(1)).alias("n_types"),
            _types_in_order().alias("types"),
            (F.sum("n") - F.max("n")).alias("inconsistent"),
        )
        .where("n_types > 1")
        .withColumn("message", F.format_string(
            "Column '%s' has mixed types: %s (%d inconsistent values tracked)",
            "column", "types", "inconsistent"))
    )


def type_inconsistencies(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Every cell whose type is not the expected one of its column.

    ``expected`` has one row per raw column, so its size is bounded by the schema.
    """
    return (
        cells.join(F.broadcast(expected), "column")
        .where(F.col("value_type") != F.col("expected_type"))
        .select("row", "column", "value", F.col("value_type").alias("actual_type"), "expected_type")
    )


def mixed_type_examples(cells: DataFrame, tally: DataFrame) -> DataFrame:
    """Per mixed column the first value of each type; such a column blocks an export.

    The wanted rows are one per column and type, a bounded list.
    """
    wanted = tally.select("column", "value_type", F.col("first_row").alias("row"))
    samples = (
        cells.join(F.broadcast(wanted), ["column", "value_type", "row"])
        .select("column", "value_type", "row", F.concat(
            "value_type", F.lit(": "),
            F.when(F.col("value_type") == "str",
                   F.concat(F.lit("'"), "value", F.lit("'"))).otherwise(F.col("value")),
        ).alias("example"))
    )
    listed = F.array_sort(F.collect_list(F.struct("row", "value_type", "example")))
    return (
        samples.groupBy("column").agg(listed.alias("seen"))
        .where(F.size("seen") > 1)
        .select(
            "column",
            F.array_join(F.transform("seen", lambda s: s["value_type"]), ", ").alias("types"),
            F.array_join(F.transform("seen", lambda s: s["example"]), " | ").alias("examples"),
        )
    )
