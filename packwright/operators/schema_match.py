"""Matching the columns of tables with declared field definitions.

Both sides are DataFrames keyed by ``dataset``, so one call covers one table or
a catalogue of many. Joins use dataset and column name together, which spreads a
dataset with very many columns. A catalogue has about as many fields as columns, and
estimates do not see the rows that its descriptors are exploded to, so joins are merge
joins by hint: neither side is broadcast through the driver.

* columns: ``dataset, pos, column, field_type, is_numeric, is_raw``
* fields: ``dataset, name, type, unit_name``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright import standard as S
from packwright.functions.value_types import field_type_of, is_numeric_type
from packwright.session import local_table

COLUMN_SCHEMA = ("dataset string, pos int, column string, field_type string, is_numeric boolean, "
                 "is_raw boolean")


def infer_fields(df: DataFrame, dataset: str, raw_columns: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a table with the field type their Spark type stands for; reads no data."""
    rows = [
        (dataset, pos, f.name, field_type_of(f.dataType), is_numeric_type(f.dataType),
         f.name in raw_columns)
        for pos, f in enumerate(df.schema.fields)
    ]
    return local_table(df.sparkSession, rows, COLUMN_SCHEMA)


def infer_fields_from_values(tally: DataFrame) -> DataFrame:
    """Field type of raw columns from a type tally: ``column, field_type, is_numeric``.

    Integers with decimals are numbers, any other mixture is text.
    """
    names = {"int": "integer", "float": "number", "bool": "boolean", "date": "date",
             "datetime": "datetime", "time": "time"}
    single = F.when(F.col("least") != F.col("most"), F.lit(None).cast("string"))
    for value_name, field_name in names.items():
        single = single.when(F.col("least") == value_name, field_name)
    kind = F.coalesce(single, F.when(F.col("numeric"), "number"), F.lit("string"))
    return (
        tally.groupBy("column").agg(
            F.min("value_type").alias("least"), F.max("value_type").alias("most"),
            F.bool_and(F.col("value_type").isin("int", "float")).alias("numeric"))
        .select("column", kind.alias("field_type"))
        .withColumn("is_numeric", F.col("field_type").isin(S.NUMERIC_FIELD_TYPES))
    )


def _pairs(columns: DataFrame, fields: DataFrame) -> DataFrame:
    return columns.join(fields.withColumnRenamed("name", "column").hint("merge"), ["dataset", "column"])


def _finding(df: DataFrame, check: str, severity: str, message: Column) -> DataFrame:
    return df.select("dataset", F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                     F.col("column").alias("subject"), message.alias("message"))


def extra_columns(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """Warnings for columns without a declared field."""
    declared = fields.select("dataset", F.col("name").alias("column"))
    return _finding(
        columns.join(declared.hint("merge"), ["dataset", "column"], "left_anti"), "extra_columns", "warning",
        F.format_string("Column '%s' in data but not in schema definition", "column"))


def missing_columns(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """Warnings for declared fields without a column."""
    declared = fields.select("dataset", F.col("name").alias("column"))
    return _finding(
        declared.join(columns.select("dataset", "column").hint("merge"), ["dataset", "column"], "left_anti"),
        "missing_columns", "warning",
        F.format_string("Field '%s' defined in schema but not found in data", "column"))


def type_fits(declared: Column, actual: Column) -> Column:
    """Whether a column of type ``actual`` can carry the declared type.

    Either numeric type carries both; ``any`` and types without an expectation
    (geopoint, geojson, duration, array, object) are unconstrained.
    """
    return (
        F.when(declared.isin(S.NUMERIC_FIELD_TYPES), actual.isin(S.NUMERIC_FIELD_TYPES))
        .when(declared == "date", actual.isin("date", "datetime"))
        .when(declared == "time", actual.isin("time", "datetime"))
        .when(declared.isin("string", "boolean", "datetime"), declared == actual)
        .otherwise(F.lit(True))
    )


def declared_type_match(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """Errors for typed columns that cannot carry their declared type."""
    pairs = _pairs(columns.where(~F.col("is_raw")), fields).where(
        F.coalesce("type", F.lit("")) != "")
    return _finding(
        pairs.where(~type_fits(F.col("type"), F.col("field_type"))), "declared_type_match",
        "error", F.format_string("Column '%s' declared as '%s' but has type '%s'",
                                 "column", "type", "field_type"))


def numeric_needs_unit(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """Errors for numeric fields whose unit has no name."""
    pairs = _pairs(columns, fields).where(
        F.col("type").isin(S.NUMERIC_FIELD_TYPES) & (F.coalesce("unit_name", F.lit("")) == ""))
    return _finding(pairs, "numeric_needs_unit", "error", F.format_string(
        "Numeric field '%s' must have a unit specified in the field definition", "column"))


def expected_value_types(declared: Column) -> Column:
    """Value type names accepted for a declared type; null where unconstrained."""
    out = None
    for name, types in S.EXPECTED_VALUE_TYPES.items():
        accepted = F.array(*[F.lit(t) for t in types])
        out = F.when(declared == name, accepted) if out is None else out.when(
            declared == name, accepted)
    return out


def value_type_match(tally: DataFrame, declared: DataFrame) -> DataFrame:
    """Whether raw columns fit their declared type: ``column, type, actual_types, matched, cells, ok``.

    The tally is that of all values. ``matched`` counts the fitting ones; the
    column is an error when there are none (``ok`` is false). ``declared`` holds
    ``column, type``.
    """
    accepted = expected_value_types(F.col("type"))
    fits = F.coalesce(F.array_contains(accepted, F.col("value_type")), F.lit(True))
    return (
        tally.join(declared, "column")
        .groupBy("column", "type")
        .agg(F.array_join(F.array_sort(F.collect_set("value_type")), ", ").alias("actual_types"),
             F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("matched"),
             F.sum("n").alias("cells"))
        .withColumn("ok", F.col("matched") > 0)
    )
