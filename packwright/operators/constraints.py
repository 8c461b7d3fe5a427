"""Enforcing declared field constraints and user rules on data.

``Constraint`` values are turned into predicates that are true for a violating
row, so all of a table's constraints are counted in one aggregate pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.functions.value_types import column as named, is_missing
from packwright.operators.duplicates import row_key
from packwright.operators.profile import Check, count_checks


# Types whose values take a few bytes, so that a digest saves nothing.
_NARROW = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Constraint:
    """Constraints of one column, as in a field definition."""

    column: str
    required: bool = False
    unique: bool = False
    minimum: float | None = None
    maximum: float | None = None
    pattern: str | None = None
    enum: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.pattern:
            _check_pattern(self.pattern)


def _check_pattern(pattern: str) -> None:
    """Refuse a pattern that Spark, in whose dialect it is matched, does not take."""
    fault = pattern_fault(pattern)
    if fault is not None:
        raise ValueError(f"Invalid regex pattern: {fault}")


def pattern_fault(pattern: str) -> str | None:
    """Why a regular expression is not taken by the JVM that will match it; None if it is. No job is run."""
    session = SparkSession.getActiveSession()
    try:
        if session is None:
            re.compile(pattern)
        else:
            session._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as problem:  # of either engine
        return str(problem).splitlines()[0]
    return None


def predicates(df: DataFrame, constraints: list[Constraint]) -> list[tuple[str, str, Column]]:
    """``(column, check, violated)`` for every constraint that looks at one row."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in constraints:
        value = named(c.column)
        present = ~is_missing(c.column, types[c.column])
        if c.required:
            out.append((c.column, "required", ~present))
        if c.minimum is not None:
            out.append((c.column, "minimum", present & (value < F.lit(c.minimum))))
        if c.maximum is not None:
            out.append((c.column, "maximum", present & (value > F.lit(c.maximum))))
        if c.pattern is not None:
            # A match is anchored at the start of the text only.
            out.append((c.column, "pattern",
                        present & ~value.cast("string").rlike(f"^(?:{c.pattern})")))
        if c.enum:
            out.append((c.column, "enum", present & ~value.cast("string").isin(list(c.enum))))
    return out


def constraint_checks(df: DataFrame, constraints: list[Constraint],
                      rules: list[tuple[str, str, Column]] = (),
                      table_rules: list[tuple[str, str, Column]] = ()) -> list[Check]:
    """Countable checks of constraints and user rules; a rule is ``(name, severity, violated)``.

    ``violated`` is a condition on a row, in table rules one on aggregates of the table. Aggregates over
    different values make Spark copy every row, so estimates (``approx_count_distinct``) are cheaper there.
    """
    found = [(column, check, "error", violated) for column, check, violated in
             predicates(df, constraints)]
    found += [(name, "custom_rule", severity, violated) for name, severity, violated in rules]
    checks = [Check("constraint", i, *parts) for i, parts in enumerate(found)]
    return checks + [Check("constraint", i, name, "table_rule", severity, violated, True)
                     for i, (name, severity, violated) in enumerate(table_rules, len(checks))]


def constraint_profile(df: DataFrame, constraints: list[Constraint],
                       rules: list[tuple[str, str, Column]] = (),
                       table_rules: list[tuple[str, str, Column]] = ()) -> DataFrame:
    """``subject, check, severity, violations`` per constraint and user rule, in one pass.

    A user rule is ``(name, severity, violated)``; a broken table rule has one violation.
    """
    return constraint_counts(count_checks(df, constraint_checks(df, constraints, rules, table_rules))).drop("rows")


def constraint_counts(counts: DataFrame, *keep: str) -> DataFrame:
    """The constraint profile held in the result of ``count_checks``, with columns to keep."""
    return counts.where("kind = 'constraint'").select(
        *keep, "subject", "check", "severity", F.col("n").alias("violations"), "rows")


def constraint_violations(df: DataFrame, row_id: str, constraints: list[Constraint]) -> DataFrame:
    """Every violating cell: ``row, column, check, value``; a row-by-row pass without a shuffle."""
    hits = [
        F.when(violated, F.struct(F.lit(column).alias("column"), F.lit(check).alias("check"),
                                  named(column).cast("string").alias("value")))
        for column, check, violated in predicates(df, constraints)
    ]
    return df.select(named(row_id).alias("row"),
                     F.inline(F.array_compact(F.array(*hits))))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row, with ``n``; keys with a null part do not count."""
    complete = None
    for name in key:
        part = named(name).isNotNull()
        complete = part if complete is None else complete & part
    return df.where(complete).groupBy(*map(named, key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_profile(df: DataFrame, key: list[str]) -> DataFrame:
    """``rows, null_keys, repeated_keys, surplus_rows`` of a unique column or primary key.

    Keys of whole numbers, dates and the like are compared as they are, others by digest, see ``row_key``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    narrow = all(isinstance(types[name], _NARROW) for name in key)
    own = F.struct(*map(named, key)) if narrow else row_key(df, key)
    missing = F.lit(False)
    for name in key:
        missing = missing | is_missing(name, types[name])
    groups = df.select(own.alias("key"), missing.alias("_null")).groupBy("key", "_null").agg(
        F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(~F.col("_null") & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(~F.col("_null"), F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
    )
