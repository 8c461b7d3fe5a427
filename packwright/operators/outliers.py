"""Exact quartiles and values beyond the interquartile fence.

Spark's exact percentile keeps all distinct values of a group in one task. Here the
cell that holds a quartile is narrowed by histograms, each combined inside the tasks,
until so few values are left that they are ranked one by one. No step depends on an
estimate, and no task sees more than the cells of one histogram, whatever the size of a
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packwright import standard as S
from packwright.functions.value_types import column

_QUARTILES = (0.25, 0.75)
# Cells per doubling of a value in the first histogram: all doubles have 4.3 million such
# cells, values between 1 and 10^9 some 31 000.
OCTAVE_CELLS = 1024
# Cells of equal width in the second one. A cell of the first holds under 2^43 doubles, so one
# of these holds under 2^22 different values for the last ranking.
LINEAR_CELLS = 1 << 21


def _octave_cell(v: Column) -> Column:
    """Cell of a value on a logarithmic scale; a greater value is never in a lower cell."""
    infinite = F.abs(v) == F.lit(float("inf"))
    size = F.when(infinite, F.lit(OCTAVE_CELLS * 4096)).otherwise(
        F.floor(F.log2(F.abs(v)) * OCTAVE_CELLS) + F.lit(OCTAVE_CELLS * 2048))
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def _linear_cell(v: Column, low: Column, high: Column) -> Column:
    """Cell of a value between two others in equal steps; a greater value is never in a lower cell."""
    return F.when(high > low, F.floor((v - low) / (high - low) * LINEAR_CELLS)).otherwise(F.lit(0)).cast("long")


def _ranges(cells: DataFrame) -> DataFrame:
    """The cell of each wanted rank among the cells of its group.

    ``cells`` holds ``g, quartile, rank, above, before, least, most, times``: the number of values
    below all cells, the least value beyond them, and the ends and number of values of each.
    """
    ordered = W.partitionBy("g", "quartile").orderBy("least")
    return (
        cells.withColumn("upto", F.col("before") + F.sum("times").over(ordered))
        .withColumn("above", F.coalesce(F.lead("least").over(ordered), "above"))
        .withColumn("before", F.col("upto") - F.col("times"))
        .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    )


def quartiles(df: DataFrame, value: str, by: str) -> DataFrame:
    """``by, n, q1, q3`` with linear interpolation between the neighbouring ranks.

    Rows without a group form a group of their own, named null. Missing values and NaN do not
    count, and a group of nothing else gives no row; an empty table gives none. The column is read
    three times and, whatever its values, a group's cells number a few millions at most.
    """
    data = df.select(column(by).alias("g"), column(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v"))
    ends = [F.count(F.lit(1)).alias("times"), F.min("v").alias("least"), F.max("v").alias("most")]
    octaves = data.groupBy("g", _octave_cell(F.col("v")).alias("cell")).agg(*ends)
    # Neighbouring ranks of a quartile: floor and ceiling of (n - 1) * q, from 0.
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("quartile"), ((F.col("n") - 1) * F.lit(q)).alias("position"))
        for i, q in enumerate(_QUARTILES)]))
    first = (
        octaves.withColumn("n", F.sum("times").over(W.partitionBy("g"))).withColumn("w", wanted)
        .select("g", "n", "w.*", F.floor("w.position").alias("rank"), F.lit(0).cast("long").alias("before"),
                F.lit(None).cast("double").alias("above"), "least", "most", "times")
    )
    held = ["n", "position", "rank", "before", "above", "least", "most"]

    def inside(ranges: DataFrame, cell: Column) -> DataFrame:
        """Values within the ranges of their group, counted by cell."""
        targets = ranges.groupBy(F.col("g").alias("group")).agg(F.collect_list(
            F.struct("quartile", *held)).alias("ranges"))  # one per quartile
        near = data.join(targets, F.col("g").eqNullSafe(F.col("group"))).select("g", "v", F.inline("ranges")).where(
            (F.col("v") >= F.col("least")) & (F.col("v") <= F.col("most")))
        fixed = ["n", "position", "rank", "before", "above"]
        return near.withColumn("cell", cell).groupBy("g", "quartile", *fixed, "cell").agg(*ends)

    second = inside(_ranges(first), _linear_cell(F.col("v"), F.col("least"), F.col("most")))
    last = _ranges(inside(_ranges(second), F.col("v")))
    # Values are ranked one by one here, so the next one is either the same or the least above.
    low = F.col("least")
    high = F.when(F.ceil("position") < F.col("upto"), low).otherwise(F.col("above"))
    part = F.col("position") - F.floor("position")
    exact = F.when((part == 0) | (high == low), low).otherwise(low + (high - low) * part)
    return last.withColumn("value", exact).groupBy(F.col("g").alias(by)).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("quartile") == i, F.col("value"))).alias(name) for i, name in enumerate(("q1", "q3"))],
    )


def iqr_fences(df: DataFrame, value: str, by: str, fence: float = S.OUTLIER_FENCE) -> DataFrame:
    """Quartiles with ``low`` and ``high`` fences."""
    spread = F.col("q3") - F.col("q1")
    return quartiles(df, value, by).withColumn("low", F.col("q1") - F.lit(fence) * spread).withColumn(
        "high", F.col("q3") + F.lit(fence) * spread)


def iqr_outliers(df: DataFrame, value: str, by: str, fence: float = S.OUTLIER_FENCE) -> DataFrame:
    """Rows whose value lies outside the fence of their group, with ``low`` and ``high``."""
    fences = iqr_fences(df, value, by, fence).select(column(by).alias("_group"), "low", "high")
    return df.join(fences, column(by).eqNullSafe(F.col("_group"))).drop("_group").where(
        (column(value) < F.col("low")) | (column(value) > F.col("high")))


def outlier_profile(df: DataFrame, value: str, by: str, fence: float = S.OUTLIER_FENCE) -> DataFrame:
    """Per group: fences and the number of rows outside them (0 where there are none).

    A group without a number has no fences and ``n`` 0.
    """
    fences = iqr_fences(df, value, by, fence).withColumnRenamed(by, "_group")
    outside = (column(value) < F.col("low")) | (column(value) > F.col("high"))
    return (
        df.select(column(by), column(value)).join(fences, column(by).eqNullSafe(F.col("_group")), "left")
        .groupBy(column(by))
        .agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("q1").alias("q1"), F.max("q3").alias("q3"),
             F.max("low").alias("low"), F.max("high").alias("high"),
             F.count_if(outside).alias("outliers"))
    )
