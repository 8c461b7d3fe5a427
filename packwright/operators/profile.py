"""Profiling: shape, missing values and samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packwright import standard as S
from packwright.functions.value_types import column, is_missing

# Conditions counted per aggregate. A longer list is cut into slices, each of which
# reads only its own columns; that keeps every generated method small.
CHECKS_PER_PASS = 200


@dataclass(frozen=True)
class Check:
    """A condition on one row of a table whose occurrences are counted, or, if ``whole``, one on aggregates of all rows.

    A condition on aggregates counts once where it holds; one that is null, as over an empty table, does not hold.
    """

    kind: str
    pos: int
    subject: str
    check: str
    severity: str
    condition: Column
    whole: bool = False

    def counted(self) -> Column:
        """How often the condition holds, as an aggregate."""
        return F.coalesce(self.condition, F.lit(False)).cast("long") if self.whole else F.count_if(self.condition)


def count_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """``kind, pos, subject, check, severity, n, rows``: how often each condition holds.

    One aggregate counts all conditions, of whatever kind, so a table is read
    once for all of them; only one partial result per task is shuffled.
    """
    out = None
    for i in range(0, len(checks), CHECKS_PER_PASS):
        part = _count_slice(df, checks[i:i + CHECKS_PER_PASS])
        out = part if out is None else out.unionByName(part)
    return out


def _count_slice(df: DataFrame, checks: list[Check]) -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[c.counted().alias(f"n{i}") for i, c in enumerate(checks)],
    )
    lines = F.array(*[
        F.struct(F.lit(c.kind).alias("kind"), F.lit(c.pos).alias("pos"),
                 F.lit(c.subject).alias("subject"), F.lit(c.check).alias("check"),
                 F.lit(c.severity).alias("severity"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(checks)
    ])
    return counts.select("rows", F.inline(lines))


def null_checks(df: DataFrame) -> list[Check]:
    """One check per column: the value is missing."""
    return [Check("nulls", pos, f.name, "nulls", "info", is_missing(f.name, f.dataType))
            for pos, f in enumerate(df.schema.fields)]


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: ``pos, column, rows, nulls, null_fraction``."""
    return null_counts(count_checks(df, null_checks(df)))


def null_counts(counts: DataFrame, *keep: str) -> DataFrame:
    """The null profile held in the result of ``count_checks``, with columns to keep."""
    return counts.where("kind = 'nulls'").select(
        *keep, "pos", F.col("subject").alias("column"), "rows", F.col("n").alias("nulls"),
        null_fraction(F.col("n"), F.col("rows")))


def null_fraction(nulls: Column, rows: Column) -> Column:
    """Share of missing values, 0 for an empty table."""
    return (
        F.when(rows > 0, nulls.cast("double") / rows.cast("double"))
        .otherwise(F.lit(0.0))
        .alias("null_fraction")
    )


def null_severity(profile: DataFrame, parity: bool = False) -> DataFrame:
    """Add ``tier`` and ``message`` to a null profile; columns without nulls are left out.

    Tiers are ``critical`` (over 50 %), ``high`` (over 20 %) and ``present``.
    With ``parity`` the published order of the tests is kept, in which the
    50 % test can never be reached.
    """
    share = F.col("null_fraction")
    high = share > S.MAX_NULL_FRACTION
    critical = share > S.CRITICAL_NULL_FRACTION
    tier = F.when(high, "high") if parity else F.when(critical, "critical").when(high, "high")
    note = (
        F.when(F.col("tier") == "present", F.lit(""))
        .otherwise(F.lit(f" (exceeds recommended max: {S.MAX_NULL_FRACTION:.1%})"))
    )
    return (
        profile.where(share > 0)
        .withColumn("tier", tier.otherwise("present"))
        .withColumn("message", F.concat(
            F.format_string("Column '%s' has %.1f%% missing values", F.col("column"), share * 100),
            note))
    )


def table_shape(df: DataFrame, dataset: str) -> DataFrame:
    """``dataset, rows, columns``; the count comes from file footers alone."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns")
    )


def nonempty_cells(profile: DataFrame) -> DataFrame:
    """Number of cells that hold a value, from a null profile."""
    return profile.agg(F.sum(F.col("rows") - F.col("nulls")).alias("nonempty_cells"))


def column_samples(df: DataFrame, row_id: str, columns: list[str] | None = None,
                   n: int = 10) -> DataFrame:
    """First ``n`` values per column in order of ``row_id``: ``column, ordinal, row_id, value``.

    The table is read once for all columns. Every task ranks its own values and hands
    on the first few of each column, so no task sees a whole column.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = columns or [c for c in df.columns if c != row_id]
    cells = df.select(column(row_id).alias("row_id"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"),
                 F.when(~is_missing(name, types[name]), column(name).cast("string")).alias("value"))
        for name in names])))
    first = W.partitionBy("column").orderBy("row_id", "value")
    return (
        cells.where(F.col("value").isNotNull()).withColumn("ordinal", F.row_number().over(first))
        .where(F.col("ordinal") <= n).select("column", "ordinal", "row_id", "value")
    )


def preview(df: DataFrame, key: str | list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows by key, without a full sort."""
    return df.orderBy(key).limit(n)


def quality_info(profile: DataFrame, duplicates: DataFrame, mixed: DataFrame | None = None,
                 parity: bool = False) -> DataFrame:
    """Information lines of datasets: missing values, duplicates, shape, type inconsistencies.

    The null profile, the duplicate profile and the result of
    ``mixed_type_columns`` carry a ``dataset`` column, so one call serves many
    tables. The profile has one row per column, which gives the shape.
    """
    none = F.lit(None).cast("string").alias("subject")
    nulls = null_severity(profile, parity).select(
        "dataset", F.lit("nulls").alias("check"), F.col("column").alias("subject"), "message")
    share = F.col("duplicate_fraction") * 100
    repeated = duplicates.where("duplicates > 0").select(
        "dataset", F.lit("duplicates").alias("check"), none,
        F.when(F.col("exceeds"), F.concat(
            F.format_string("%d duplicate rows (%.1f%%)", "duplicates", share),
            F.lit(f" exceeds recommended threshold ({S.MAX_DUPLICATE_FRACTION:.1%})")))
        .otherwise(F.format_string("%d duplicate rows found (%.1f%%)", "duplicates", share))
        .alias("message"))
    shape = profile.groupBy("dataset").agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns")).select(
        "dataset", F.lit("shape").alias("check"), none,
        F.format_string("Dataset has %d rows and %d columns", "rows", "columns").alias("message"))
    out = nulls.unionByName(repeated).unionByName(shape)
    if mixed is not None:
        out = out.unionByName(
            mixed.groupBy("dataset").agg(F.sum("inconsistent").alias("n")).where("n > 0").select(
                "dataset", F.lit("inconsistencies").alias("check"), none,
                F.format_string("Found %d type inconsistencies", "n").alias("message")))
    return out.select("dataset", "check", "subject", F.lit("info").alias("severity"), "message")
