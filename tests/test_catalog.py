import json

import pytest
from pyspark.sql import functions as F

from packwright import standard as S
from packwright.operators import catalog, descriptors
from packwright.plans.report import findings_report, report_text

FULL = {
    "name": "hive-scales", "title": "Hourly weights of bee hives",
    "description": "Weights of hives on scales beside a wood, with the temperature inside, taken hourly.",
    "version": "2.3.1", "keywords": ["bees", "hives", "weight"],
    "homepage": "https://example.org/hives", "repository": "https://example.org/hives/code",
    "created": "2024-06-30",
    "licenses": [{"name": "MIT", "path": "https://spdx.org/licenses/MIT.html"}],
    "contributors": [{"name": "B. Keeper", "role": "author"}], "sources": [{"title": "Scales"}],
    "resources": [{
        "name": "scales", "path": "scales.parquet", "format": "parquet", "title": "Scales", "description": "One row an hour",
        "encoding": "utf-8", "schema": {"fields": [
            {"name": "hive", "type": "string", "description": "Name of the hive"},
            {"name": "weight", "type": "number", "description": "Weight with frames", "unit": {"name": "KiloGM"}}]}}],
}


def check(spark, *documents, strict_values=False):
    df = spark.createDataFrame(
        [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)],
        "dataset int, json string")
    parsed = catalog.parse_descriptors(df, "json").withColumn(
        "findings", catalog.descriptor_findings(F.col("descriptor"), F.col("key_types"), strict_values,
                                                 F.col("resource_types")))
    graded = catalog.grade(parsed).orderBy("dataset").collect()
    return [(r.level, [(f.severity, f.scope, f.subject, f.message) for f in r.findings]) for r in graded]


def changed(**kw):
    return {k: v for k, v in {**FULL, **kw}.items() if v is not None}


def resource(**kw):
    r = {**FULL["resources"][0], **kw}
    return changed(resources=[{k: v for k, v in r.items() if v is not None}])


def test_faultless_descriptor_is_strict(spark):
    assert check(spark, FULL) == [("strict", [])]


def test_nearly_empty_descriptor(spark):
    ((level, found),) = check(spark, {"name": "test-dataset", "title": "Test"})
    errors = [f for f in found if f[0] == "error"]
    assert level == "basic" and len(errors) == 6 and len(found) - len(errors) == 5
    assert ("error", "metadata", "title", "Minimum length is 5, got 4") in found
    assert {f[2] for f in errors} == {"resources", "licenses", "created", "contributors", "sources", "title"}


def test_units_as_text(spark):
    fields = [{"name": "weight", "type": "integer", "description": "Weight", "unit": "KiloGM"},
              {"name": "n", "type": "number", "description": "N", "unit": {"name": "kg"}},
              {"name": "m", "type": "number", "description": "M"}]
    ((_, found),) = check(spark, resource(schema={"fields": fields}))
    assert [(f[0], f[2]) for f in found] == [("error", "m")]


def test_types_of_resource_values(spark):
    ((_, found),) = check(spark, resource(name=5, format=["parquet"], path=None))
    assert ("error", "Resource '5'", "name", "Expected string, got int") in found
    assert ("error", "Resource '5'", "format", "Expected string, got list") in found
    assert sorted(f[2] for f in found if f[0] == "error") == ["format", "name", "path"]
    ((_, found),) = check(spark, changed(resources=[{**FULL["resources"][0], "path": True}, FULL["resources"][0]]))
    assert [(f[2], f[3]) for f in found] == [("path", "Expected string, got bool")]


def test_value_rules(spark):
    cases = [
        (changed(name="Bad Name"), "name", S.METADATA_REQUIRED[0].message),
        (changed(name="ab"), "name", "Minimum length is 3, got 2"),
        (changed(name="a" * 101), "name", "Maximum length is 100, got 101"),
        (changed(created="2025-10-15T00:00:00"), "created", S.METADATA_REQUIRED[4].message),
        (changed(licenses=[]), "licenses", S.METADATA_REQUIRED[3].message),
        (changed(licenses="MIT"), "licenses", "Expected array, got str"),
        (changed(title=5), "title", "Expected string, got int"),
        (changed(contributors=[{"name": "A", "role": "maintainer"}]), "contributors", S.AUTHOR_MESSAGE),
        (resource(name="Bad Name!"), "name", "Value does not match pattern"),
        (resource(path=None), "path", "Required field 'path' is missing"),
        (resource(format=None), "format", "Parquet format is preferred for performance and metadata"),
    ]
    for (level, found), (_, subject, message) in zip(check(spark, *[c[0] for c in cases]), cases):
        errors = [f for f in found if f[0] == "error"]
        assert [(f[2], f[3]) for f in errors] == [(subject, message)], message
        assert level == "basic"


def test_resource_and_field_warnings(spark):
    field = {"name": "x", "type": "number"}
    docs = [
        resource(name="Bad Name!"), resource(format="csv"), resource(encoding=None),
        resource(schema=None), resource(schema={"fields": [field]}),
        resource(schema={"fields": [{"type": "string", "description": "d"}]}),
        resource(schema={"fields": [{"name": "x", "type": "decimal", "description": "d"}]}),
    ]
    got = check(spark, *docs)
    assert ("warning", "Resource 'Bad Name!'", "name",
            "Resource name 'Bad Name!' contains invalid characters. Suggested name: 'bad_name'") in got[0][1]
    assert got[1] == ("standard", [("warning", "Resource 'scales'", "format",
                                    "Format 'csv' is acceptable, but 'parquet' is preferred")])
    assert got[2][1][0][3] == "Recommended field 'encoding' is missing"
    assert got[3][1][0][3] == "Schema with field definitions improves data quality"
    assert [f[3] for f in got[4][1]] == [S.FIELD_UNIT_MESSAGE, S.FIELD_DESCRIPTION_MESSAGE]
    assert got[5][1] == [("error", "Resource 'scales'", "unknown", S.FIELD_NAME_MESSAGE)]
    assert got[6][1][0][3].startswith("Invalid type 'decimal'. Must be one of: string, number")


def test_recommended_values_only_on_request(spark):
    doc = changed(version="one", homepage="ftp://x", keywords=["a"])
    assert check(spark, doc) == [("strict", [])]
    ((level, found),) = check(spark, doc, strict_values=True)
    assert level == "standard" and {f[2] for f in found} == {"version", "homepage", "keywords"}


def test_broken_json_lacks_everything(spark):
    ((level, found),) = check(spark, "{broken")
    assert len([f for f in found if f[0] == "error"]) == 7 and level == "basic"


@pytest.mark.parametrize("errors,warnings,level", [
    (0, 0, "strict"), (0, 1, "standard"), (0, 5, "standard"), (0, 6, "basic"), (1, 0, "basic"),
    (10, 99, "basic"), (11, 0, "invalid")])
def test_levels(spark, errors, warnings, level):
    rows = [("d", "error")] * errors + [("d", "warning")] * warnings + [("d", "info")] * 3
    found = spark.createDataFrame(rows, "dataset string, severity string")
    datasets = spark.createDataFrame([("d",), ("clean",)], "dataset string")
    got = {r.dataset: r.level for r in catalog.compliance_level(found, datasets).collect()}
    assert got == {"d": level, "clean": "strict"}


def test_parts_of_a_descriptor(spark):
    df = spark.createDataFrame([("MIT", "ftp://x"), (None, None), ("Own", "http://x")], "n string, p string")
    got = {r.license: (r.known_title, r.ok) for r in catalog.license_check(df, "n", "p").collect()}
    assert got == {"MIT": ("MIT License", False), "CC-BY-4.0": ("Creative Commons Attribution 4.0", True),
                   "Own": (None, True)}
    df = spark.createDataFrame([("author", "a@b"), ("boss", None), (None, "no-at")], "r string, e string")
    got = df.select(catalog.contributor_check(F.col("r"), F.col("e"))["ok"].alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False]
    df = spark.createDataFrame([("utf-8",), (None,), ("nonsense",), ("ISO 8859-1",)], "e string")
    got = df.select(catalog.encoding_check(F.col("e")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [("utf-8", True), ("utf-8", True), ("nonsense", False), ("ISO 8859-1", True)]


def build(spark, details, resources=FULL["resources"]):
    df = spark.createDataFrame([(json.dumps(details), json.dumps(resources))], "d string, r string").select(
        F.from_json("d", catalog.DESCRIPTOR).alias("details"),
        F.from_json("r", f"array<{catalog.RESOURCE}>").alias("resources"))
    return descriptors.descriptor_build(df, created="2025-01-01").select(
        "descriptor_json", "build_error").first()


def test_descriptor_build(spark):
    row = build(spark, {k: v for k, v in FULL.items() if k != "created"})
    built = json.loads(row.descriptor_json)
    assert row.build_error is None and built["created"] == "2025-01-01"
    assert built["resources"] == FULL["resources"]
    row = build(spark, changed(licenses=[{}], contributors=[{"name": "A"}], description=""))
    built = json.loads(row.descriptor_json)
    assert built["licenses"][0]["title"] == "Creative Commons Attribution 4.0 International"
    assert built["contributors"][0]["role"] == "author" and "description" not in built
    assert build(spark, changed(name=".x")).build_error.startswith("Invalid package name")
    assert build(spark, changed(version="1")).build_error.startswith("Invalid version")
    assert build(spark, FULL, []).build_error == "At least one resource is required"
    assert build(spark, changed(sources=[])).build_error == "Required field 'sources' is missing"


def test_configs(spark):
    mapping = {"version": "1.0.0", "config_type": "mapping", "column_mappings": {
        "mass": "http://v/mass", "mass_unit": "http://v/kg", "name": "http://v/name"},
        "file_info": {"original_file": "my-data.xlsx", "sheet_name": "S"}}
    df = spark.createDataFrame([(json.dumps(mapping),), ("{x",), ('{"config_type":"metadata"}',),
                                ('{"config_type":"mapping"}',)], "j string")
    got = [r.v.message for r in df.select(descriptors.mapping_config_check(F.col("j")).alias("v")).collect()]
    assert got == ["", "Invalid JSON", "Expected mapping config, got: metadata",
                   "Missing required fields: ['version', 'column_mappings']"]
    one = df.limit(1).select(F.lit(1).alias("k"), descriptors.parse_mapping_config(F.col("j")).alias("mapping"))
    rows = {r.column: (r.concept_id, r.unit_id) for r in descriptors.column_mappings(one, "k").collect()}
    assert rows == {"mass": ("http://v/mass", "http://v/kg"), "name": ("http://v/name", None)}


def test_report(spark):
    found = spark.createDataFrame(
        [("d", i, "error" if i % 2 else "info", f"m{i}") for i in range(25_000)],
        "dataset string, ordinal long, severity string, message string")
    levels = spark.createDataFrame([("d", 12500, 0, 12500, "invalid")],
                                   "dataset string, errors long, warnings long, infos long, level string")
    text = report_text(findings_report(found, levels), "d").split("\n")
    assert text[5] == "Validation Status: FAILED" and text[-1] == "END OF REPORT"
    start = text.index("ERRORS")
    assert text[start + 1] == "1. m1" and text[start + 12500] == "12500. m24999"
    assert text[start + 12501] == "DATA QUALITY METRICS"
