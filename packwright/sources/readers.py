"""Readers by file suffix, and an audit of file sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packwright import standard as S


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             raw: bool = False) -> DataFrame:
    """CSV with a header line.

    With a schema the files are read once. Without one the types are inferred
    by an extra pass, or with ``raw`` every column stays text. A column without
    a header keeps its values under the name ``_c`` and its place.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", not raw).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet file or folder."""
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Choose the reader by the suffix of the path."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema)
    if suffix == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"Unsupported file format: .{suffix}")


def human_size(size: Column) -> Column:
    """Bytes as text with one decimal in B, KB, MB or GB."""
    out = F.format_string("%.1f GB", size / 1024**3)
    for limit, unit, scale in ((1024**3, "MB", 1024**2), (1024**2, "KB", 1024), (1024, "B", 1)):
        out = F.when(size < limit, F.format_string(f"%.1f {unit}", size / scale)).otherwise(out)
    return out


def size_tier(size: Column) -> Column:
    """Tier of a file size: small (10 MB and less), medium, large (over 500 MB)."""
    return (
        F.when(size <= S.SMALL_FILE_BYTES, "small")
        .when(size <= S.LARGE_FILE_BYTES, "medium")
        .otherwise("large")
    )


def file_size_audit(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, bytes, tier, memory_estimate, too_large`` per file; no file content is read."""
    return audit_sizes(
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(path)
        .select("path", F.col("length").alias("bytes")))


def audit_sizes(files: DataFrame) -> DataFrame:
    """The audit of files listed with their ``bytes``; other columns stay."""
    size = F.col("bytes")
    return (
        files
        .withColumn("tier", size_tier(size))
        .withColumn("memory_estimate", human_size((size * S.MEMORY_FACTOR).cast("double")))
        .withColumn("too_large", size > S.MAX_FILE_MB * 1024 * 1024)
    )
