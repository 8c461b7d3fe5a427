import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packwright.functions import field_type_of, is_numeric_type
from packwright.operators import consistency, constraints, schema_match
from packwright.operators.constraints import Constraint
from packwright.plans import Dataset, data_findings, inconsistency_sink

FIELDS = [
    {"name": "river", "type": "string"}, {"name": "gauge", "type": "integer", "unit": {"name": "NUM"}},
    {"name": "flow", "type": "number", "unit": {"name": "m3/s"}}, {"name": "tidal", "type": "boolean"},
    {"name": "read_on", "type": "date"},
]
ROWS = [("Ems", 40117, 80.4, True, datetime.date(2023, 3, 9)), ("Isar", 40820, 174.0, False, None),
        ("Saale", 41266, 117.25, False, datetime.date(2022, 11, 30)), ("Oder", 43002, 574.9, True, None)]
DDL = "river string, gauge long, flow double, tidal boolean, read_on date"


def found(df, fields, **kw):
    dataset = Dataset("t", df, {"resources": [{"schema": {"fields": fields}}]}, **kw)
    return [(r.severity, r.check, r.subject, r.message) for r in data_findings([dataset]).collect()
            if r.severity != "info"]


def test_clean_table(spark):
    assert found(spark.createDataFrame(ROWS, DDL), FIELDS) == []


def test_text_in_numeric_column(spark):
    df = spark.createDataFrame(ROWS, DDL).withColumn("gauge", F.lit("upper weir"))
    (one,) = found(df, FIELDS)
    assert one[:3] == ("error", "declared_type_match", "gauge") and "integer" in one[3]


def test_number_without_unit(spark):
    (one,) = found(spark.createDataFrame([(7.25,)], "depth double"), [{"name": "depth", "type": "number"}])
    assert one[0] == "error" and "unit" in one[3] and "depth" in one[3]


def test_missing_and_extra_columns(spark):
    df = spark.createDataFrame(ROWS, DDL)
    got = found(df.select("river", "tidal"), FIELDS)
    assert {g[2] for g in got} == {"gauge", "flow", "read_on"}
    assert {g[0] for g in got} == {"warning"}
    (one,) = found(df.withColumn("remark", F.lit("dry")), FIELDS)
    assert one[:3] == ("warning", "extra_columns", "remark")


def test_flag_as_text_and_integer_for_number(spark):
    (one,) = found(spark.createDataFrame([("ja",)], "frozen string"), [{"name": "frozen", "type": "boolean"}])
    assert one[:2] == ("error", "declared_type_match")
    ok = [{"name": "locks", "type": "integer", "unit": "NUM"}, {"name": "width", "type": "number", "unit": "m"}]
    assert found(spark.createDataFrame([(6, 31)], "locks int, width int"), ok) == []
    small = spark.sql("SELECT CAST(6 AS TINYINT) AS locks, CAST(31 AS DECIMAL(5,2)) AS width")
    assert found(small, ok) == []


def test_unconstrained_types(spark):
    df = spark.sql("SELECT 'x' AS a, array(1) AS b, DATE'2024-01-01' AS c")
    fields = [{"name": "a", "type": "any"}, {"name": "b", "type": "array"}, {"name": "c", "type": "date"}]
    assert found(df, fields) == []


def raw(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row long, name string")


def test_mixed_column_and_inconsistencies(spark, tmp_path):
    cells = consistency.typed_cells(raw(spark, ["mill", "weir", "88", "lock", "9", "ford"]), "row", ["name"])
    tally = consistency.type_tally(cells)
    (mixed,) = consistency.mixed_type_columns(tally).collect()
    assert mixed.message == "Column 'name' has mixed types: str, int (2 inconsistent values tracked)"
    issues = consistency.type_inconsistencies(cells, consistency.expected_type(tally))
    got = sorted(tuple(r) for r in issues.collect())
    assert got == [(2, "name", "88", "int", "str"), (4, "name", "9", "int", "str")]
    out = inconsistency_sink(issues, str(tmp_path / "issues"))
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["row", "column", "value", "actual_type", "expected_type"] and back.count() == 2
    assert inconsistency_sink(issues.where("false"), str(tmp_path / "none")) is None
    (example,) = consistency.mixed_type_examples(cells, tally).collect()
    assert (example.types, example.examples) == ("str, int", "str: 'mill' | int: 88")


def test_two_raw_columns_with_text_ids(spark):
    rows = [("k1", "07:15", "3"), ("k2", "tide", "4"), ("k3", "08:40:30", "4.5"), ("k4", None, "11"), ("k5", "09:00", "2")]
    cells = consistency.typed_cells(
        spark.createDataFrame(rows, "i string, read_at string, boats string"), "i", ["read_at", "boats"])
    issues = consistency.type_inconsistencies(
        cells, consistency.expected_type(consistency.type_tally(cells)))
    assert {tuple(r) for r in issues.collect()} == {
        ("k2", "read_at", "tide", "str", "time"), ("k3", "boats", "4.5", "float", "int")}


def test_tie_goes_to_the_type_seen_first(spark):
    for values, want in ((["a", "1", "2", "b"], "str"), (["1", "a", "b", "2"], "int")):
        tally = consistency.type_tally(consistency.typed_cells(raw(spark, values), "row", ["name"]))
        assert consistency.expected_type(tally).first().expected_type == want


def test_invariants_of_tallies(spark):
    values = [None if i % 7 == 0 else ("x" if i % 5 == 0 else str(i)) for i in range(1000)]
    cells = consistency.typed_cells(raw(spark, values).repartition(4), "row", ["name"])
    tally = consistency.type_tally(cells)
    total = sum(r.n for r in tally.collect())
    assert total == sum(v is not None for v in values)
    expected = consistency.expected_type(tally)
    most = max(r.n for r in tally.collect())
    assert consistency.type_inconsistencies(cells, expected).count() == total - most


def test_value_type_match_of_raw_columns(spark):
    df = raw(spark, ["x"] * 150 + ["1"])
    got = found(df, [{"name": "row", "type": "integer", "unit": "NUM"},
                     {"name": "name", "type": "integer", "unit": "NUM"}], row_id="row", raw_columns=("name",))
    assert {g[1] for g in got} == {"mixed_types"}  # one value fits, so the declaration holds
    cells = consistency.typed_cells(df, "row", ["name"])
    declared = spark.createDataFrame([("name", "integer")], "column string, type string")
    assert schema_match.value_type_match(consistency.type_tally(cells), declared).first().ok


def test_infer_fields(spark):
    df = spark.sql("""SELECT 1 AS i, 1.5D AS d, true AS b, 'x' AS s, TIMESTAMP'2024-01-01 00:00:00' AS t,
        DATE'2024-01-01' AS day, array(1) AS a, named_struct('x', 1) AS o, 1.5BD AS dec""")
    got = {r.column: r.field_type for r in schema_match.infer_fields(df, "t").collect()}
    assert got == {"i": "integer", "d": "number", "b": "boolean", "s": "string", "t": "datetime",
                   "day": "date", "a": "array", "o": "object", "dec": "number"}
    assert not is_numeric_type(df.schema["b"].dataType) and field_type_of(df.schema["i"].dataType) == "integer"


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a1", 5.0), (2, None, 50.0), (2, "b1", None), (3, "a2x", float("nan"))],
                               "id long, code string, v double")
    rules = [Constraint("code", required=True, pattern="a\\d", enum=("a1", "b1")),
             Constraint("v", required=True, minimum=10, maximum=40)]
    got = {(r.subject, r.check): r.violations for r in constraints.constraint_profile(df, rules).collect()}
    assert got == {("code", "required"): 1, ("code", "pattern"): 1, ("code", "enum"): 1,
                   ("v", "required"): 2, ("v", "minimum"): 1, ("v", "maximum"): 1}
    rows = constraints.constraint_violations(df, "id", rules)
    assert rows.count() == sum(got.values())
    key = constraints.key_profile(df, ["id"]).first()
    assert (key.rows, key.null_keys, key.repeated_keys, key.surplus_rows) == (4, 0, 1, 1)
    code = constraints.key_profile(df, ["code"]).first()
    assert (code.null_keys, code.repeated_keys) == (1, 0)
    assert [tuple(r) for r in constraints.repeated_keys(df, ["id"]).collect()] == [(2, 2)]
    for pattern in ("(", r"(?P<year>\d+)"):  # the second is none in the dialect it would be matched in
        with pytest.raises(ValueError, match="Invalid regex"):
            Constraint("code", pattern=pattern)


def test_rules_in_the_descriptor(spark):
    df = spark.createDataFrame([("a", 3, 1), ("b", 7, 1), (None, 5, 2)], "lock string, boats int, day int")
    fields = [{"name": "lock", "type": "string", "constraints": {"required": True, "pattern": "[a-c]"}},
              {"name": "boats", "type": "integer", "unit": "NUM", "constraints": {"maximum": 6, "enum": [3, 5, 7]}},
              {"name": "day", "type": "integer", "unit": "NUM"}]
    descriptor = {"resources": [{"schema": {"fields": fields, "primaryKey": "day"}}]}
    got = {(r.check, r.subject): r.message for r in data_findings([Dataset("t", df, descriptor)]).collect()
           if r.severity == "error"}
    assert set(got) == {("constraint_required", "lock"), ("constraint_maximum", "boats"), ("constraint_unique", "day")}
    assert "1 of 3" in got["constraint_maximum", "boats"]
    again = Dataset("t", df, descriptor, constraints=(Constraint("boats", maximum=6, enum=("3", "5", "7")),), primary_key=("day",))
    assert data_findings([again]).where("severity = 'error'").count() == 3


def test_rules_on_aggregates_and_descriptors(spark, tmp_path):
    from packwright.plans import publish, validate_all
    rules = dict(
        table_rules=(("many", "error", F.count(F.lit(1)) > 9), ("mean", "warning", F.avg("id") > 100), ("half", "info", F.max("id") == 9)),
        metadata_rules=(("title", "warning", lambda d: F.try_variant_get(d, "$.title", "string").isNull()),
                        ("name", "error", lambda d: F.try_variant_get(d, "$.name", "string") == "bad")))
    ten, none = Dataset("ten", spark.range(10), {"name": "ten"}, **rules), Dataset("none", spark.range(0), {"title": "T", "name": "bad"}, **rules)
    findings, levels = validate_all([ten, none])
    own = F.col("check").isin("table_rule", "metadata_rule")
    got = {(r.dataset, r.subject, r.severity) for r in findings.where(own).collect()}
    assert got == {("ten", "many", "error"), ("ten", "half", "info"), ("ten", "title", "warning"), ("none", "name", "error")}
    counted = {r.dataset: r.errors for r in levels.collect()}
    plain = {r.dataset: r.errors for r in validate_all([Dataset("ten", spark.range(10), {"name": "ten"}),
                                                        Dataset("none", spark.range(0), {"title": "T", "name": "bad"})])[1].collect()}
    assert counted == {"ten": plain["ten"] + 1, "none": plain["none"] + 1}
    done = publish(ten, str(tmp_path / "out"), str(tmp_path / "findings"))
    assert not done.published
    written = {r.subject for r in spark.read.parquet(str(tmp_path / "findings")).where(own).collect()}
    assert written == {"many", "half", "title"}


def test_custom_rule(spark):
    df = spark.range(10)
    got = constraints.constraint_profile(df, [], [("even", "warning", F.col("id") % 2 == 0)]).first()
    assert (got.subject, got.check, got.severity, got.violations) == ("even", "custom_rule", "warning", 5)


def exploded_catalogue(spark):
    """(columns, fields) of 3 000 datasets, exploded from rows that estimates take for a few bytes; some keys are null or repeated."""
    datasets = spark.range(3002).selectExpr("CASE WHEN id IN (7, 3000) THEN NULL WHEN id = 3001 THEN 5 ELSE id END AS dataset")
    columns = datasets.selectExpr(
        "dataset", "stack(3, 0, 'size', 'string', 1, 'flow', 'number', 2, 'note', 'string') AS (pos, column, field_type)",
    ).selectExpr("*", "field_type = 'number' AS is_numeric", "false AS is_raw")
    fields = datasets.selectExpr(
        "dataset", "stack(3, 'size', 'integer', 'cm', 'flow', 'number', '', 'gone', 'any', '') AS (name, type, unit_name)")
    return columns, fields


def counts_without_broadcast(found):
    """How many findings each dataset has; no side of the join goes to the driver, as planned or as run."""
    planned = found._jdf.queryExecution().executedPlan().toString()
    counts = Counter(r.dataset for r in found.collect())
    run = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in run and all("SortMergeJoin" in p and "Broadcast" not in p for p in (planned, run))
    return counts


@pytest.mark.parametrize("check", [schema_match.declared_type_match, schema_match.numeric_needs_unit])
def test_pairs_of_a_large_catalogue_are_not_broadcast(spark, check):
    assert counts_without_broadcast(check(*exploded_catalogue(spark))) == Counter({i: 4 if i == 5 else 1 for i in range(3000) if i != 7})


@pytest.mark.parametrize("check", [schema_match.extra_columns, schema_match.missing_columns])
def test_rest_of_a_large_catalogue_is_not_broadcast(spark, check):
    """Rows without a dataset match nothing, so all of them are findings."""
    assert counts_without_broadcast(check(*exploded_catalogue(spark))) == Counter({i: 2 if i == 5 else 1 for i in range(3000) if i != 7} | {None: 6})
