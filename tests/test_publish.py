"""Write, audit, publish; faulty declarations and odd column names in whole validations."""

import os

import pytest
from pyspark.sql import functions as F

from packwright.functions.value_types import value_type  # noqa: F401  (used through the audit)
from packwright.operators import consistency, constraints, duplicates, outliers
from packwright.operators.constraints import Constraint
from packwright.operators.profile import count_checks
from packwright.plans import Dataset, publish, validate_all
from packwright.plans.publish import observe_checks, observed_counts, row_checks
from packwright.sources import pack_read, read_descriptor

DESCRIPTOR = {
    "name": "readings", "title": "Readings of meters", "created": "2025-02-03", "licenses": [{"name": "MIT"}], "sources": [{"title": "meters"}],
    "contributors": [{"name": "A", "role": "author"}], "resources": [{
        "name": "readings", "path": "r.parquet", "format": "parquet", "schema": {"fields": [
            {"name": "id", "type": "integer", "unit": "NUM", "description": "key"},
            {"name": "v.x", "type": "number", "unit": "m", "description": "value", "constraints": {"maximum": 90}},
            {"name": "raw.c", "type": "string", "description": "text"}]}}],
}


def readings(spark, n=40, worst=50.0, raw="'a'"):
    return spark.range(n).select("id", F.when(F.col("id") == 3, worst).otherwise(F.col("id").cast("double")).alias("v.x"), F.expr(raw).alias("raw.c"))


def dataset(df, **changes):
    return Dataset("readings", df, DESCRIPTOR, **({"row_id": "id", "raw_columns": ("raw.c",), "primary_key": ("id",)} | changes))


def folders(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


def test_gate(spark, tmp_path):
    path, findings = str(tmp_path / "pack"), str(tmp_path / "found")
    first = publish(dataset(readings(spark)), path, findings)
    assert first.published and first.rows == 40 and read_descriptor(path)["name"] == "readings"
    assert folders(tmp_path) == ["found", "pack"]
    # A refused run leaves findings, and the data as it was.
    bad = publish(dataset(readings(spark, 50, 99.0, "if(id = 7, '7', 'a')")), path, findings)
    assert not bad.published and bad.level == "basic"
    errors = sorted((r.subject, r.check, r.message) for r in spark.read.parquet(findings).collect() if r.severity == "error")
    assert errors == [("raw.c", "mixed_types", "Column 'raw.c' has mixed types: str, int (1 inconsistent values tracked)"),
                      ("v.x", "constraint_maximum", "Column 'v.x' breaks its maximum constraint in 1 of 50 rows")]
    assert pack_read(spark, path)[0].count() == 40 and folders(tmp_path) == ["found", "pack"]
    # A retry leaves one result.
    for _ in range(2):
        again = publish(dataset(readings(spark, 45)), path, findings)
    assert again.published and spark.read.parquet(path).count() == 45
    assert {r.published for r in spark.read.parquet(findings).collect()} == {True}
    assert publish(dataset(readings(spark, 50, 99.0)), path, findings, max_errors=1).published
    empty = publish(dataset(readings(spark, 0)), path, findings)
    assert not empty.published and [r.check for r in empty.findings.collect()] == ["empty"] and spark.read.parquet(path).count() == 50
    twice = readings(spark).union(readings(spark))
    assert "constraint_unique" in {r.check for r in publish(dataset(twice), path, findings).findings.collect()}


def test_write_that_fails_leaves_nothing(spark, tmp_path):
    broken = readings(spark).withColumn("v.x", F.when(F.col("id") == 30, F.raise_error(F.lit("no"))).otherwise(F.col("`v.x`")).cast("double"))
    with pytest.raises(Exception, match="no"):
        publish(dataset(broken), str(tmp_path / "pack"), str(tmp_path / "found"))
    assert folders(tmp_path) == []


def test_observed_in_the_pass_equals_counted(spark):
    d = dataset(readings(spark, 30, float("nan")), constraints=(Constraint("raw.c", pattern="b"),), rules=(("odd", "warning", F.col("id") % 2 == 1),))
    checks = row_checks(d)
    df, observation = observe_checks(d, checks)
    assert df.columns == d.df.columns
    df.write.format("noop").mode("overwrite").save()
    got, want = observed_counts(spark, checks, observation.get), count_checks(d.df, checks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_findings_equal_those_of_a_validation(spark, tmp_path):
    d = dataset(readings(spark, 60, 99.0, "if(id % 9 = 7, '7', if(id % 4 = 1, null, 'a'))"), rules=(("small", "warning", F.col("id") < 5),))
    columns = ["scope", "subject", "check", "severity", "message"]
    want = sorted(map(str, validate_all([d])[0].select(*columns).collect()))
    got = publish(d, str(tmp_path / "pack"), str(tmp_path / "found")).findings
    assert sorted(map(str, got.select(*columns).collect())) == want and len(want) > 5


def test_faulty_declarations_are_findings(spark):
    odd = {"minimum": "abc", "pattern": "(", "enum": "a", "required": "yes", "maximum": True}
    fields = {
        "text": ("nope", {("fields", "schema_unreadable")}), "scalars": (["x", 3], {("field_0", "schema_unreadable"), ("field_1", "schema_unreadable")}),
        "bounds": ([{"name": "v.x", "type": "number", "constraints": odd}], {("v.x", "constraint_invalid")}),
        "list": ([{"name": "v.x", "constraints": [1]}], {("v.x", "constraint_invalid")}), "types": ([{"name": 7, "type": ["a"], "unit": 4}], set())}
    df = readings(spark)
    given = [Dataset(name, df, {**DESCRIPTOR, "resources": [{"name": "r", "schema": {"fields": f, "primaryKey": {"a": 1}}}]}) for name, (f, _) in fields.items()]
    given += [Dataset(f"resources {i}", df, {**DESCRIPTOR, "resources": r}) for i, r in enumerate(("x", [3], [{"schema": "s"}], {}, None))]
    found, levels = validate_all([*given, dataset(df)])
    rows = found.where("check IN ('schema_unreadable', 'constraint_invalid')").collect()
    for name, (_, checks) in fields.items():
        assert {(r.subject, r.check) for r in rows if r.dataset == name} == checks
    assert sum(r.dataset == "bounds" for r in rows) == len(odd)
    assert {r.dataset: r.subject for r in rows if r.dataset.startswith("resources")} == {
        "resources 0": "resources", "resources 1": "the first resource", "resources 2": "schema", "resources 3": "resources"}
    # A dataset without errors is graded as it is alone, whatever is wrong with its neighbours.
    alone, beside = validate_all([dataset(df)])[1].first(), levels.where("dataset = 'readings'").first()
    assert levels.count() == len(given) + 1 and alone == beside and (beside.errors, beside.warnings, beside.level) == (0, 8, "basic")


def test_names_with_dots(spark):
    df = readings(spark, 20, 9000.0, "if(id = 4, '4', 'a')").withColumnsRenamed({"id": "the.id"})
    cells = consistency.typed_cells(df, "the.id", ["raw.c"])
    tally = consistency.type_tally(cells)
    assert consistency.mixed_type_columns(tally).first().column == "raw.c"
    assert [r.row for r in consistency.type_inconsistencies(cells, consistency.expected_type(tally)).collect()] == [4]
    assert constraints.repeated_keys(df.union(df), ["the.id"]).count() == 20
    assert constraints.constraint_violations(df, "the.id", [Constraint("v.x", maximum=100)]).first().row == 3
    assert outliers.iqr_outliers(df.withColumn("a.g", F.lit(1)), "v.x", "a.g").count() == 1
    assert outliers.outlier_profile(df.withColumn("a.g", F.lit(1)), "v.x", "a.g").first().outliers == 1
    assert duplicates.flag_duplicates(df, "the.id", ["raw.c"]).where("is_duplicate").count() == 18
