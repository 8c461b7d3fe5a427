"""Validating datasets: descriptor, resources and data, graded together."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packwright.operators import catalog, consistency, duplicates, profile, schema_match
from packwright.operators.constraints import (
    Constraint,
    constraint_checks,
    constraint_counts,
    key_profile,
    pattern_fault,
)
from packwright.session import local_table

FINDING_COLUMNS = ["dataset", "scope", "subject", "check", "severity", "message"]
FINDING_SCHEMA = ", ".join(f"{c} string" for c in FINDING_COLUMNS)


@dataclass
class Dataset:
    """A table with what is declared about it.

    ``raw_columns`` are text columns whose values are typed one by one;
    ``row_id`` is a unique key used to name rows; ``rules`` are those of the
    user on rows, as ``(name, severity, violated)``. ``table_rules`` are the same with a
    condition on aggregates of the table, ``metadata_rules`` with a function that makes
    one from the descriptor, a VARIANT.
    """

    name: str
    df: DataFrame
    descriptor: dict = field(default_factory=dict)
    row_id: str | None = None
    raw_columns: tuple[str, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    primary_key: tuple[str, ...] = ()
    rules: tuple[tuple[str, str, Column], ...] = ()
    table_rules: tuple[tuple[str, str, Column], ...] = ()
    metadata_rules: tuple[tuple[str, str, Callable[[Column], Column]], ...] = ()


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, matched by column name; joined in pairs, which keeps the plan flat."""
    while len(parts) > 1:
        pairs = [parts[i:i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]


def declared_fields(dataset: Dataset) -> list[dict]:
    """Field definitions of the first resource."""
    fields = _first_schema(dataset).get("fields")
    return [f for f in fields if isinstance(f, dict)] if isinstance(fields, list) else []


def _first_schema(dataset: Dataset) -> dict:
    """The schema of the first resource; empty where something else stands, which is a finding."""
    resources = dataset.descriptor.get("resources")
    first = resources[0] if isinstance(resources, list) and resources else None
    schema = first.get("schema") if isinstance(first, dict) else None
    return schema if isinstance(schema, dict) else {}


_BOUNDS = {"minimum": "a number", "maximum": "a number", "required": "true or false", "unique": "true or false",
           "pattern": "a regular expression", "enum": "a list"}


def _takes(key: str, value) -> bool:
    """Whether a declared constraint can be evaluated."""
    if key in ("minimum", "maximum"):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if key in ("required", "unique"):
        return isinstance(value, bool)
    if key == "pattern":
        return isinstance(value, str) and pattern_fault(value) is None
    return isinstance(value, list)


def declaration_faults(dataset: Dataset) -> list[tuple[str, str | None, str, str, str, str]]:
    """Findings on a schema that cannot be read as declared: no list of fields, fields that are none, constraints without a valid value."""
    def line(subject, check, message):
        return dataset.name, "schema_matching", subject, check, "error", message

    out = []
    resources = dataset.descriptor.get("resources")
    first = resources[0] if isinstance(resources, list) and resources else {}
    for what, value, wanted in (("resources", resources, list), ("the first resource", first, dict),
                                ("schema", first.get("schema") if isinstance(first, dict) else None, dict),
                                ("fields", _first_schema(dataset).get("fields"), list)):
        if value is not None and not isinstance(value, wanted):
            out.append(line(what, "schema_unreadable", f"Expected {'a list' if wanted is list else 'an object'} for {what}, got {type(value).__name__}"))
    fields = _first_schema(dataset).get("fields")
    for i, f in enumerate(fields if isinstance(fields, list) else []):
        if not isinstance(f, dict):
            out.append(line(f"field_{i}", "schema_unreadable", f"Expected an object for field_{i}, got {type(f).__name__}"))
            continue
        own = f.get("constraints")
        if own is not None and not isinstance(own, dict):
            out.append(line(f.get("name"), "constraint_invalid", f"Expected an object for constraints, got {type(own).__name__}"))
        for key, wanted in _BOUNDS.items():
            value = own.get(key) if isinstance(own, dict) else None
            if value is not None and not _takes(key, value):
                out.append(line(f.get("name"), "constraint_invalid", f"Constraint '{key}' must be {wanted}, got {json.dumps(value)}"))
    return out


def declared_constraints(dataset: Dataset) -> tuple[Constraint, ...]:
    """Constraints of the dataset and those in the field definitions of its descriptor.

    Those of columns that the table lacks are left out, as a missing column is a finding of its own; so are those without a
    valid value, see ``declaration_faults``.
    """
    found = list(dataset.constraints)
    for f in declared_fields(dataset):
        own = f.get("constraints") if isinstance(f.get("constraints"), dict) else {}
        keep = {k: own[k] for k in _BOUNDS if own.get(k) is not None and _takes(k, own[k])}
        if "enum" in keep:
            keep["enum"] = tuple(str(v) for v in keep["enum"])
        c = Constraint(f["name"] if isinstance(f.get("name"), str) else "", **keep)
        if keep and c.column in dataset.df.columns and c not in found:
            found.append(c)
    return tuple(found)


def unique_keys(dataset: Dataset) -> list[list[str]]:
    """Columns and keys that must be unique: those of constraints, of the dataset and of its descriptor's schema."""
    declared = _first_schema(dataset).get("primaryKey") or []
    declared = [declared] if isinstance(declared, str) else [k for k in declared if isinstance(k, str)] if isinstance(declared, list) else []
    keys = [[c.column] for c in declared_constraints(dataset) if c.unique]
    keys += [list(k) for k in (dataset.primary_key, declared) if k and set(k) <= set(dataset.df.columns)]
    return [k for i, k in enumerate(keys) if k not in keys[:i]]


def fields_table(datasets: list[Dataset]) -> DataFrame:
    """Declared fields as ``dataset, name, type, unit_name``."""
    def unit_name(unit) -> str | None:
        return unit.get("name") if isinstance(unit, dict) else unit

    def text(value) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value)

    rows = [(d.name, text(f.get("name")), text(f.get("type")), text(unit_name(f.get("unit"))))
            for d in datasets for f in declared_fields(d)]
    return local_table(datasets[0].df.sparkSession, rows,
                       "dataset string, name string, type string, unit_name string")


def _named(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    return union_all([df.withColumn("dataset", F.lit(name)) for name, df in parts])


def _finding_rows(df: DataFrame, scope: str, subject: Column, check: Column | str,
                  severity: Column | str, message: Column) -> DataFrame:
    def column(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return df.select("dataset", F.lit(scope).alias("scope"), subject.alias("subject"),
                     column(check).alias("check"), column(severity).alias("severity"),
                     message.alias("message"))


def raw_findings(tally: DataFrame, declared: DataFrame) -> DataFrame:
    """Findings on raw columns, all from one use of their type tally.

    Mixed types and values that never fit the declared type are errors, the
    number of all inconsistent values of a dataset is information. The tally has
    a few rows per raw column, so lists and windows stay short.
    """
    accepted = schema_match.expected_value_types(F.col("type"))
    fits = F.coalesce(F.array_contains(accepted, F.col("value_type")), F.lit(True))
    own = W.partitionBy("dataset")
    columns = (
        tally.join(declared, ["dataset", "column"], "left")
        .groupBy("dataset", "column", "type")
        .agg(F.count(F.lit(1)).alias("n_types"), (F.sum("n") - F.max("n")).alias("inconsistent"),
             F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("matched"),
             F.array_sort(F.collect_list(F.struct("first_row", "value_type"))).alias("seen"))
        .withColumn("types", F.transform("seen", lambda s: s["value_type"]))
        .withColumn("total", F.sum("inconsistent").over(own))
        .withColumn("nth", F.row_number().over(own.orderBy("column")))
    )

    def line(condition, scope, subject, check, severity, message):
        return F.when(condition, F.struct(
            F.lit(scope).alias("scope"), subject.alias("subject"), F.lit(check).alias("check"),
            F.lit(severity).alias("severity"), message.alias("message")))

    column, none = F.col("column"), F.lit(None).cast("string")
    lines = F.array(
        line(F.col("n_types") > 1, "type_consistency", column, "mixed_types", "error",
             F.format_string("Column '%s' has mixed types: %s (%d inconsistent values tracked)",
                             column, F.array_join("types", ", "), "inconsistent")),
        line(F.col("matched") == 0, "schema_matching", column, "value_type_match", "error",
             F.format_string("Column '%s' declared as '%s' but contains %s. Expected: %s", column,
                             "type", F.array_join(F.array_sort("types"), ", "),
                             F.array_join(accepted, ", "))),
        line((F.col("nth") == 1) & (F.col("total") > 0), "data_quality", none, "inconsistencies",
             "info", F.format_string("Found %d type inconsistencies", "total")),
    )
    return columns.select("dataset", F.inline(F.array_compact(lines)))


def schema_findings(datasets: list[Dataset]) -> DataFrame | None:
    """Findings from the schemas of tables with declared fields; no data is read."""
    declared = [d for d in datasets if declared_fields(d)]
    if not declared:
        return None
    columns = union_all([schema_match.infer_fields(d.df, d.name, d.raw_columns) for d in declared])
    fields = fields_table(declared)
    found = union_all([
        schema_match.extra_columns(columns, fields), schema_match.missing_columns(columns, fields),
        schema_match.declared_type_match(columns, fields),
        schema_match.numeric_needs_unit(columns, fields),
    ])
    return found.withColumn("scope", F.lit("schema_matching")).select(*FINDING_COLUMNS)


def constraint_findings(counts: DataFrame) -> DataFrame:
    """Broken constraints and user rules, from the result of ``count_checks`` with a dataset."""
    is_rule = F.col("check").isin("custom_rule", "table_rule")
    return _finding_rows(
        constraint_counts(counts, "dataset").where("violations > 0"), "constraints",
        F.col("subject"),
        F.when(is_rule, F.col("check")).otherwise(F.concat(F.lit("constraint_"), "check")),
        F.col("severity"),
        F.when(F.col("check") == "table_rule", F.format_string("Rule '%s' is broken by the table of %d rows", "subject", "rows"))
        .when(is_rule, F.format_string("Rule '%s' is broken in %d of %d rows", "subject",
                                       "violations", "rows"))
        .otherwise(F.format_string("Column '%s' breaks its %s constraint in %d of %d rows",
                                   "subject", "check", "violations", "rows")))


def key_findings(profiles: DataFrame) -> DataFrame:
    """Keys that are not unique, from key profiles with ``dataset`` and ``key``."""
    return _finding_rows(
        profiles.where("repeated_keys > 0"), "constraints", F.col("key"), "constraint_unique", "error",
        F.format_string("Key is held by more than one row for %d keys", "repeated_keys"))


def data_findings(datasets: list[Dataset], parity: bool = False) -> DataFrame:
    """Findings on the data of datasets.

    Every table is read once for missing values, constraints and user rules
    together, once for repeated rows, once per unique key and once for the types
    of raw columns. The counts of all datasets are put together before findings
    are worded, so the plan grows little with their number.
    """
    counts, duplicate, tallies, keys = [], [], [], []
    for d in datasets:
        checks = profile.null_checks(d.df) + constraint_checks(d.df, declared_constraints(d), d.rules, d.table_rules)
        counts.append((d.name, profile.count_checks(d.df, checks)))
        duplicate.append((d.name, duplicates.duplicate_profile(d.df)))
        if d.raw_columns:
            tallies.append((d.name, consistency.type_tally(
                consistency.typed_cells(d.df, d.row_id, list(d.raw_columns)))))
        keys += [(d.name, key_profile(d.df, key).withColumn("key", F.lit(", ".join(key))))
                 for key in unique_keys(d)]
    all_counts = _named(counts)
    parts = [profile.quality_info(
        profile.null_counts(all_counts, "dataset"), _named(duplicate), parity=parity)
        .withColumn("scope", F.lit("data_quality")).select(*FINDING_COLUMNS)]
    if any(declared_constraints(d) or d.rules or d.table_rules for d in datasets):
        parts.append(constraint_findings(all_counts))
    if keys:
        parts.append(key_findings(_named(keys)))
    if tallies:
        declared = fields_table(datasets).select("dataset", F.col("name").alias("column"), "type")
        parts.append(raw_findings(_named(tallies), declared).select(*FINDING_COLUMNS))
    from_schema = schema_findings(datasets)
    if from_schema is not None:
        parts.append(from_schema)
    faults = [line for d in datasets for line in declaration_faults(d)]
    if faults:
        parts.append(local_table(datasets[0].df.sparkSession, faults, FINDING_SCHEMA))
    return union_all(parts)


def descriptor_table(datasets: list[Dataset]) -> DataFrame:
    """``dataset, descriptor, key_types`` of the datasets."""
    spark = datasets[0].df.sparkSession
    rows = [(d.name, json.dumps(d.descriptor)) for d in datasets]
    return catalog.parse_descriptors(
        local_table(spark, rows, "dataset string, descriptor_json string"), "descriptor_json")


def metadata_rule_findings(datasets: list[Dataset], described: DataFrame) -> list[DataFrame]:
    """Findings of the users' rules on descriptors, in one narrow pass; a rule that is null is not broken."""
    document = F.try_parse_json("descriptor_json")
    lines = [
        F.when((F.col("dataset") == d.name) & violated(document), F.struct(
            F.lit("metadata").alias("scope"), F.lit(name).alias("subject"), F.lit("metadata_rule").alias("check"),
            F.lit(severity).alias("severity"), F.lit(f"Rule '{name}' is broken by the descriptor").alias("message")))
        for d in datasets for name, severity, violated in d.metadata_rules
    ]
    return [described.select("dataset", F.inline(F.array_compact(F.array(*lines)))).select(*FINDING_COLUMNS)] if lines else []


def validate_all(datasets: list[Dataset], parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(findings, levels)`` of the datasets: descriptor, resources and data.

    All findings are kept. ``findings`` has the columns of ``FINDING_COLUMNS``;
    ``levels`` is ``dataset, errors, warnings, level``.
    """
    described = descriptor_table(datasets)
    meta = catalog.explode_findings(
        described, "dataset",
        catalog.descriptor_findings(F.col("descriptor"), F.col("key_types"), resource_types=F.col("resource_types")))
    findings = union_all([meta.select(*FINDING_COLUMNS), *metadata_rule_findings(datasets, described),
                          data_findings(datasets, parity)])
    return findings, catalog.compliance_level(findings, described)


def with_level(findings: DataFrame) -> DataFrame:
    """Add the level of its dataset to every finding, in one pass over the findings.

    A dataset has at most a few findings per column and descriptor entry, so a
    window over one dataset stays small.
    """
    own = W.partitionBy("dataset")
    counts = {s: F.count_if(F.col("severity") == s).over(own) for s in ("error", "warning")}
    return findings.withColumn("level", catalog.level_of(counts["error"], counts["warning"]))
