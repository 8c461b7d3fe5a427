"""Profile of a table that grows by files: one stored state per file and column, merged on demand.

A state holds exact counters and two sketches, HyperLogLog for the number of different
values and KLL for quantiles. States merge in any order, so a file is read once in its life
and a profile of the whole table reads a few kilobytes per file and column.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.functions.value_types import blank_nan, column, is_numeric_type
from packwright.operators.profile import null_fraction
from packwright.sources.package import qualified

# 2^12 registers: the estimate of different values has a standard error of 1.6 %.
DISTINCT_LG_K = 12
# Ranks of estimated quantiles are off by some 1.3 % of the values.
QUANTILE_K = 200
QUANTILES = (0.25, 0.5, 0.75)

_KEY = ["path", "length", "modified"]
STATE_SCHEMA = (
    "path string, length long, modified timestamp, pos int, column string, rows long, nulls long, least double, "
    "greatest double, first_text string, last_text string, different binary, spread binary"
)


def _as_text(value: Column, kind: T.DataType) -> Column:
    """A value as text that is equal for equal values."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def _column_state(pos: int, f: T.StructField) -> list[Column]:
    """Aggregates over the values of one column, named by its place."""
    value = blank_nan(f.name, f.dataType)
    number = value.cast("double") if is_numeric_type(f.dataType) else F.lit(None).cast("double")
    words = value if isinstance(f.dataType, T.StringType) else F.lit(None).cast("string")
    return [
        F.count(F.when(value.isNotNull(), 1)).alias(f"values{pos}"),
        F.min(number).alias(f"least{pos}"), F.max(number).alias(f"greatest{pos}"),
        F.min(words).alias(f"first{pos}"), F.max(words).alias(f"last{pos}"),
        F.hll_sketch_agg(_as_text(value, f.dataType), DISTINCT_LG_K).alias(f"different{pos}"),
        F.kll_sketch_agg_double(number, QUANTILE_K).alias(f"spread{pos}"),
    ]


def file_states(files: DataFrame) -> DataFrame:
    """One state per file and column of a table read from files, in one pass; see ``STATE_SCHEMA``.

    Values are grouped by file alone, with all columns of a row in one aggregate, so a task holds
    the states of the few files it reads. NaN counts as missing. A file without rows has no
    state of its own (``append_states`` notes it without a column).
    """
    fields = [f for f in files.schema.fields if f.name != "_metadata"]
    meta = files.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_length"),
        F.col("_metadata.file_modification_time").alias("_modified"), *[column(f.name) for f in fields])
    grouped = meta.groupBy("_path", "_length", "_modified").agg(
        F.count(F.lit(1)).alias("_rows"), *[c for pos, f in enumerate(fields) for c in _column_state(pos, f)])
    states = F.array(*[
        F.struct(F.lit(pos).alias("pos"), F.lit(f.name).alias("column"), F.col("_rows").alias("rows"),
                 (F.col("_rows") - F.col(f"values{pos}")).alias("nulls"), F.col(f"least{pos}").alias("least"),
                 F.col(f"greatest{pos}").alias("greatest"), F.col(f"first{pos}").alias("first_text"),
                 F.col(f"last{pos}").alias("last_text"), F.col(f"different{pos}").alias("different"),
                 F.when(F.col(f"least{pos}").isNotNull(), F.col(f"spread{pos}")).alias("spread"))
        for pos, f in enumerate(fields)])
    return grouped.select(F.col("_path").alias("path"), F.col("_length").alias("length"),
                          F.col("_modified").alias("modified"), F.inline(states))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified, own`` of the Parquet files of a folder as they are now; none is opened.

    The first three are written as in the states; ``own`` is the path to read the file by.
    """
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(qualified(spark, path))
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
                F.col("_metadata.file_modification_time").alias("modified"), F.col("path").alias("own"))
    )


def _stored(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(STATE_SCHEMA).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE_SCHEMA)


def append_states(spark: SparkSession, path: str, store: str) -> int:
    """Read the files of a folder that have no state yet and store theirs; how many files were read.

    A file written anew under its name (another length or time) gets a new state, and its old one is
    ignored from then on. The names of new files pass through the driver, as they do in any listing
    of Spark; their content does not. Two runs at a time store a state twice, which counts once.
    """
    files = listed(spark, path).join(_stored(spark, store).select(*_KEY).distinct(), _KEY, "left_anti")
    new = [row.own for row in files.select("own").toLocalIterator()]
    if new:
        # Files may differ in their columns, as a table grows in width too.
        file_states(spark.read.option("mergeSchema", True).parquet(*new)).write.mode("append").parquet(store)
        # What has no state now holds no rows; a state without a column says so.
        empty = files.join(_stored(spark, store).select(*_KEY).distinct(), _KEY, "left_anti")
        nothing = {"rows": F.lit(0), "nulls": F.lit(0)}
        schema = T.StructType.fromDDL(STATE_SCHEMA)
        empty.select(*[F.col(f.name) if f.name in _KEY else nothing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields]).write.mode("append").parquet(store)
    return len(new)


def current_states(spark: SparkSession, path: str, store: str) -> DataFrame:
    """Stored states of the files that a folder holds now, each once."""
    return _stored(spark, store).join(listed(spark, path), _KEY, "left_semi").dropDuplicates([*_KEY, "pos", "column"])


def merge_states(states: DataFrame) -> DataFrame:
    """The profile of all files whose states are given, one row per column.

    ``column, rows, nulls, null_fraction, least, greatest, first_text, last_text`` are exact;
    ``distinct_estimate`` and ``quartile_estimates`` (null without a number) come from the sketches.
    A file that lacks a column counts its rows as missing there. Without states there are no rows.
    """
    per_file = states.select(*_KEY, "rows").distinct()
    merged = states.where(F.col("column").isNotNull()).groupBy("column").agg(
        F.min("pos").alias("pos"), F.sum("rows").alias("known"), F.sum("nulls").alias("nulls"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.min("first_text").alias("first_text"), F.max("last_text").alias("last_text"),
        F.hll_sketch_estimate(F.hll_union_agg("different")).alias("distinct_estimate"),
        F.kll_merge_agg_double("spread").alias("spread"))
    whole = merged.withColumn("rows", per_file.agg(F.sum("rows")).scalar())
    nulls = F.col("nulls") + F.col("rows") - F.col("known")
    quartiles = F.kll_sketch_get_quantile_double("spread", F.array(*map(F.lit, QUANTILES)))
    return whole.withColumn("nulls", nulls).select(
        "pos", "column", "rows", "nulls", null_fraction(F.col("nulls"), F.col("rows")), "least", "greatest", "first_text",
        "last_text", "distinct_estimate", F.when(F.col("least").isNotNull(), quartiles).alias("quartile_estimates"))


def growing_profile(spark: SparkSession, path: str, store: str) -> DataFrame:
    """Bring the stored states of a folder up to date and merge them."""
    append_states(spark, path, store)
    return merge_states(current_states(spark, path, store))
