"""Rules as rows: the standard's own, rules of every kind, faulty rules and faulty descriptors."""

import json

import pytest
from pyspark.sql import functions as F

from packwright.operators import catalog, rulebook
from packwright.session import local_table

COLUMNS = ["dataset", "scope", "subject", "check", "severity", "message"]
SCHEMA = "dataset string, version string, descriptor_json string"


def found(spark, documents, rules, version="1.0.0"):
    rows = [(name, version, d if d is None or isinstance(d, str) else json.dumps(d)) for name, d in documents.items()]
    return sorted(tuple(r) for r in rulebook.rule_findings(local_table(spark, rows, SCHEMA), rules).select(*COLUMNS).collect())


def test_standard_equals_the_catalogue_rules(spark):
    """Typed wrongly, absent, null and nested values: the rows say what the expressions say."""
    documents = {
        "empty": {}, "types": {"name": 3, "title": ["x"], "resources": {}, "licenses": "MIT", "created": 20240101, "contributors": 1, "sources": None},
        "texts": {"name": "A b", "title": "abc", "created": "2024/01/01", "resources": [], "licenses": [], "sources": [{}],
                  "contributors": [{"role": "maintainer"}, {"role": None}], "version": "x", "keywords": [], "homepage": "ftp://x"},
        "nested": {"name": "good-name", "title": "A good title", "created": "2024-01-01", "licenses": [{}], "sources": [{}],
                   "contributors": [{"role": "author"}], "resources": [
                       {"name": "Bad Name", "format": "csv", "schema": {"fields": [
                           {"name": "a", "type": "number"}, {"type": "text"}, {"name": "b", "type": "integer", "unit": {"name": "m"}, "description": "d"},
                           {"name": "c", "type": "number", "unit": None}]}},
                       {"path": "p", "format": 7, "title": "t"}, {"name": None, "path": "p", "schema": {}}]},
    }
    rows = [(k, json.dumps(v)) for k, v in documents.items()]
    parsed = catalog.parse_descriptors(local_table(spark, rows, "dataset string, descriptor_json string"), "descriptor_json")
    want = sorted(tuple(r) for r in catalog.explode_findings(parsed, "dataset", catalog.descriptor_findings(
        F.col("descriptor"), F.col("key_types"), resource_types=F.col("resource_types"))).select(*COLUMNS).collect())
    assert found(spark, documents, rulebook.standard_rules(spark)) == want and len(want) > 50


def test_every_kind(spark):
    rules = local_table(spark, [
        ("v", i, scope, path, "s", kind, number, pattern, words, f"c{i}", "warning", message) for i, (scope, path, kind, number, pattern, words, message) in enumerate([
            ("metadata", "$.a.b", "required", None, None, None, "no b"),
            ("metadata", "$.n", "type", None, None, ["int", "whole number"], "{type} not {got}"),
            ("metadata", "$.t", "min_length", 4.0, None, None, "{length} < {number}"),
            ("metadata", "$.t", "max_length", 1.5, None, None, "{length} > {number}"),
            ("metadata", "$.t", "pattern", None, "^z", None, "'{value}'"),
            ("metadata", "$.l", "min_items", 3.0, None, None, "{size}"),
            ("metadata", "$.l", "max_items", 1.0, None, None, "{size}"),
            ("metadata", "$.t", "one_of", None, None, ["q"], "{value}"),
            ("metadata", "$.t", "prefer", None, None, ["q"], "{value}"),
            ("metadata", "$.l", "holds", None, "$.k", ["w"], "no w"),
            ("metadata", "$.t", "needs", None, "$.u", ["abc"], "no u"),
            ("metadata", "$.l[1].k", "required", None, None, None, "second"),
            ("resource", "$.name", "clean_name", None, None, None, "{clean}")])], rulebook.RULE_SCHEMA)
    assert rulebook.rule_faults(rules).count() == 0
    broken = {"n": "x", "t": "abc", "l": [{"k": "v"}, {}], "u": None, "resources": [{"name": "A!"}]}
    got = {check: message for _, _, _, check, _, message in found(spark, {"d": broken}, rules, "v")}
    assert got == {"c0": "no b", "c1": "whole number not str", "c2": "3 < 4", "c3": "3 > 1.5", "c4": "'abc'", "c5": "2", "c6": "2", "c7": "abc",
                   "c8": "abc", "c9": "no w", "c10": "no u", "c11": "second", "c12": "a"}
    fine = {"a": {"b": 1}, "n": 5, "t": "q", "l": [{"k": "w"}], "resources": [{"name": "a"}]}
    assert {f[3] for f in found(spark, {"d": fine}, rules, "v")} == {"c2", "c4", "c5", "c11"}


def test_odd_documents_and_versions(spark):
    rules = rulebook.standard_rules(spark)
    got = found(spark, {"a": None, "b": "{", "c": "[1]", "d": "3"}, rules)
    assert [g[0] for g in got] == ["a", "b", "c", "d"] and {g[3] for g in got} == {"unreadable"}
    assert [g[5] for g in found(spark, {"a": {}}, rules, "9")] == ["No rules for version '9'"]
    assert [g[5] for g in found(spark, {"a": {}}, rules, None)] == ["No rules for version ''"]
    assert found(spark, {"a": {}}, rules.limit(0))[0][3] == "unknown_version" and not found(spark, {}, rules)


def test_faulty_rules_are_refused(spark, tmp_path):
    good = {"version": "v", "pos": 0, "scope": "metadata", "path": "$.a", "subject": "a", "kind": "pattern", "pattern": "^x", "check": "c",
            "severity": "error", "message": "m"}
    faults = {"unknown kind odd": {"kind": "odd"}, "unknown scope null": {"scope": None}, "unknown severity bad": {"severity": "bad"},
              "bad pattern (": {"pattern": "("}, "pattern is missing": {"pattern": None}, "bad path": {"path": "a b"},
              "number is missing": {"kind": "min_items"}, "words is missing": {"kind": "one_of", "words": []}, "version is missing": {"version": None}}
    with open(tmp_path / "rules.json", "w") as f:
        f.write("\n".join(json.dumps({**good, **change, "pos": i}) for i, change in enumerate(faults.values())))
    with pytest.raises(ValueError) as e:
        rulebook.load_rules(spark, str(tmp_path / "rules.json"))
    assert all(f"{i}: {fault}" in str(e.value) for i, fault in enumerate(faults))
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert found(spark, {"d": {"a": "y"}}, rulebook.load_rules(spark, str(tmp_path / "good.json")), "v")[0][5] == "m"
