"""Exporting a table as a package: gates, descriptor, validation, write."""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright import standard as S
from packwright.operators import catalog, descriptors, schema_match, vocab
from packwright.operators.constraints import Constraint
from packwright.plans.validate import Dataset, validate_all
from packwright.session import local_table
from packwright.sources.package import pack_write

MAPPING_SCHEMA = "dataset string, name string, iri string"
DESCRIPTION_SCHEMA = "dataset string, column string, description string"
LABEL_SCHEMA = "id string, label string"


class ExportRefused(ValueError):
    """A gate failed; ``findings`` holds the reasons found by the validation, if it ran."""

    def __init__(self, message: str, findings: DataFrame | None = None):
        super().__init__(message)
        self.findings = findings


def resource_name(file_name: str, sheet_name: str) -> str:
    """Name of the resource for a sheet of a file."""
    base = file_name.rstrip("/").rsplit("/", 1)[-1]
    stem = re.sub(r"^(.+)\.[^.]+$", r"\1", base)
    text = re.sub(r"[^a-z0-9\-_.]", "", f"{stem}_{sheet_name}".lower().replace(" ", "_"))
    return text.strip(".") or "resource"


def build_descriptor(df: DataFrame, mappings: dict[str, str], details: dict, file_name: str,
                     sheet_name: str, labels: dict[str, str] | None = None,
                     descriptions: dict[str, str] | None = None,
                     raw_columns: tuple[str, ...] = (), constraints: tuple[Constraint, ...] = (),
                     primary_key: tuple[str, ...] = ()) -> dict:
    """The descriptor of a package; raises ``ExportRefused`` if it cannot be built.

    Constraints go into the field definitions and the key into the schema.

    Only the schema of the table is looked at, so all lists are as long as the
    table is wide.
    """
    spark = df.sparkSession
    columns = schema_match.infer_fields(df, "_", raw_columns)
    mapped = vocab.apply_mappings(columns, local_table(
        spark, [("_", k, v) for k, v in mappings.items()], MAPPING_SCHEMA))
    rows = vocab.build_fields(
        mapped, local_table(spark, list((labels or {}).items()), LABEL_SCHEMA),
        local_table(spark, [("_", k, v) for k, v in (descriptions or {}).items()],
                            DESCRIPTION_SCHEMA), sheet_name)
    rules: dict[str, dict] = {}
    for c in constraints:
        rules.setdefault(c.column, {}).update({k: v for k, v in (
            ("required", c.required), ("unique", c.unique), ("minimum", c.minimum),
            ("maximum", c.maximum), ("pattern", c.pattern), ("enum", list(c.enum))) if v not in (None, False, [])})
    fields = []
    for r in sorted(rows.collect(), key=lambda r: r.pos):
        unit = {k: v for k, v in (("name", r.unit_name), ("longName", r.unit_long_name),
                                  ("path", r.unit_path)) if v}
        fields.append({k: v for k, v in (
            ("name", r.name), ("type", r.type), ("description", r.description), ("unit", unit),
            ("rdfType", r.rdf_type), ("taxonomyUrl", r.taxonomy_url),
            ("constraints", rules.get(r.name))) if v})
    name = resource_name(file_name, sheet_name)
    resource = {
        "name": name, "path": f"{name}.parquet", "title": details.get("title", file_name),
        "description": details.get("description", f"Data from {sheet_name}"),
        "format": S.PREFERRED_FORMAT, "mediatype": "application/vnd.apache.parquet",
        "encoding": S.DEFAULT_ENCODING, "profile": "tabular-data-resource",
        "schema": {"fields": fields, **({"primaryKey": list(primary_key)} if primary_key else {})},
    }
    given = local_table(
        spark, [(json.dumps(details), json.dumps([resource]))],
        "details_json string, resources_json string"
    ).select(F.from_json("details_json", catalog.DESCRIPTOR).alias("details"),
             F.from_json("resources_json", f"array<{catalog.RESOURCE}>").alias("resources"))
    built = descriptors.descriptor_build(
        given, created=datetime.date.today().isoformat()).select(
        "descriptor_json", "build_error").first()
    if built.build_error:
        raise ExportRefused(built.build_error)
    return json.loads(built.descriptor_json)


def export_package(df: DataFrame, mappings: dict[str, str], details: dict, file_name: str,
                   sheet_name: str, path: str, labels: dict[str, str] | None = None,
                   descriptions: dict[str, str] | None = None, row_id: str | None = None,
                   raw_columns: tuple[str, ...] = (), constraints: tuple[Constraint, ...] = (),
                   primary_key: tuple[str, ...] = (),
                   rules: tuple[tuple[str, str, Column], ...] = ()) -> tuple[str, str, DataFrame]:
    """Run all gates, write the package and return ``(path, level, findings)``.

    Gates: a table with rows and a package name; a descriptor that can be built; no raw
    column of mixed types; a validation without errors. All but the first come from one
    validation. Constraints and the key are written into the descriptor and enforced; ``rules`` are enforced only.
    """
    if df.isEmpty():
        raise ExportRefused("Validation failed: the table is empty")
    descriptor = build_descriptor(df, mappings, details, file_name, sheet_name, labels,
                                  descriptions, raw_columns, constraints, primary_key)
    findings, _ = validate_all([Dataset(
        details["name"], df, descriptor, row_id, raw_columns, rules=tuple(rules))])
    # A dataset has a bounded number of findings; the level is worked out from one run.
    kept = findings.sparkSession.createDataFrame(findings.collect(), findings.schema)
    errors = kept.where("severity = 'error'").collect()
    mixed = [r.message for r in errors if r.check == "mixed_types"]
    if mixed:
        raise ExportRefused("Data quality issues found that prevent Parquet conversion: " + "; ".join(mixed), kept)
    if errors:
        raise ExportRefused("STANDARD VALIDATION FAILED: " + "; ".join(
            f"[{r.subject}] {r.message}" for r in errors), kept)
    level = catalog.compliance_level(kept, kept.select("dataset").distinct()).first().level
    pack_write(df, descriptor, path)
    return path, level, kept
