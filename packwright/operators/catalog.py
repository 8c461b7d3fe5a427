"""Checking package descriptors in bulk.

A catalogue is a DataFrame with one descriptor (a struct) per row. Every rule is
an expression over that row that yields findings as an array of structs, so a
whole catalogue is checked without a shuffle, however many resources one package
has. ``explode_findings`` turns the arrays into rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright import standard as S
from packwright.functions.names import check_resource_name
from packwright.functions.value_types import variant_value_type
from packwright.session import local_table

UNIT = "struct<name:string,longName:string,path:string>"
FIELD = (
    f"struct<name:string,type:string,description:string,unit:{UNIT},rdfType:string,"
    "taxonomyUrl:string,constraints:struct<required:boolean,unique:boolean,minimum:double,"
    "maximum:double,pattern:string,enum:array<string>>>"
)
RESOURCE = (
    "struct<name:string,path:string,title:string,description:string,format:string,"
    "mediatype:string,encoding:string,profile:string,"
    f"schema:struct<primaryKey:array<string>,fields:array<{FIELD}>>>"
)
DESCRIPTOR = (
    "struct<name:string,title:string,description:string,version:string,profile:string,"
    "created:string,modified:string,keywords:array<string>,homepage:string,repository:string,"
    "licenses:array<struct<name:string,title:string,path:string>>,"
    "contributors:array<struct<name:string,role:string,email:string,organization:string>>,"
    "sources:array<struct<title:string,path:string,description:string>>,"
    f"resources:array<{RESOURCE}>>"
)
METADATA_KEYS = [r.key for r in S.METADATA_REQUIRED + S.METADATA_RECOMMENDED]


RESOURCE_KEYS = [r.key for r in S.RESOURCE_REQUIRED]


def _value_types(document: Column, keys: list[str]) -> Column:
    """Map from each present key of a VARIANT object to the name of its value's type."""
    def type_name(key: str) -> Column:
        value = F.try_variant_get(document, f"$.{key}", "variant")
        return F.when(value.isNotNull(), F.coalesce(variant_value_type(value), F.lit("NoneType")))

    pairs = F.array(*[F.struct(F.lit(key).alias("key"), type_name(key).alias("value")) for key in keys])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _read_unit(unit: Column) -> Column:
    """A unit given as an object, or as a text that is its name."""
    none = F.lit(None).cast("string")
    return F.when(unit.startswith("{"), F.from_json(unit, UNIT)).when(
        unit.isNotNull(), F.struct(unit.alias("name"), none.alias("longName"), none.alias("path")))


def read_descriptor_json(json: Column) -> Column:
    """A descriptor as a struct from JSON text, with units of either form."""
    d = F.from_json(json, DESCRIPTOR.replace(f"unit:{UNIT}", "unit:string"))
    fields = lambda s: F.transform(s["fields"], lambda f: f.withField("unit", _read_unit(f["unit"])))
    return d.withField("resources", F.transform(
        d["resources"], lambda r: r.withField("schema", r["schema"].withField("fields", fields(r["schema"])))))


def parse_descriptors(df: DataFrame, json: str) -> DataFrame:
    """Add ``descriptor``, ``key_types`` and ``resource_types`` from JSON text.

    Types are names of value types by present key, of the descriptor and of each resource.
    """
    document = F.try_parse_json(F.col(json))
    resources = F.try_variant_get(document, "$.resources", "array<variant>")
    return (
        df.withColumn("descriptor", read_descriptor_json(F.col(json)))
        .withColumn("key_types", _value_types(document, METADATA_KEYS))
        .withColumn("resource_types", F.transform(resources, lambda r: _value_types(r, RESOURCE_KEYS)))
    )


# ------------------------------------------------------------------ findings
def _finding(condition: Column, scope: str, subject: Column | str, check: str, severity: str,
             message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    name = F.lit(subject) if isinstance(subject, str) else subject
    return F.when(condition, F.struct(
        F.lit(scope).alias("scope"), name.alias("subject"), F.lit(check).alias("check"),
        F.lit(severity).alias("severity"), text.alias("message")))


def _list(findings: list[Column]) -> Column:
    return F.array_compact(F.array(*findings))


class _Keys:
    """Presence and type of the top-level keys of a descriptor."""

    def __init__(self, descriptor: Column, key_types: Column | None):
        self.d = descriptor
        self.types = key_types

    def present(self, key: str) -> Column:
        if self.types is None:
            return self.d[key].isNotNull()
        return self.types[key].isNotNull()

    def value(self, key: str, wanted: str) -> Column:
        """The value, or null where it is of another type, whose text says nothing."""
        if self.types is None:
            return self.d[key]
        return F.when(self.types[key] == wanted, self.d[key])

    def wrong_type(self, key: str, wanted: str, label: str, severity: str) -> list[Column]:
        if self.types is None:
            return []
        actual = self.types[key]
        return [_finding(actual != wanted, "metadata", key, "meta_type", severity,
                         F.concat(F.lit(f"Expected {label}, got "), actual))]


def _presence(keys: _Keys, rule: S.Rule, required: bool) -> list[Column]:
    check, severity = ("meta_required", "error") if required else ("meta_recommended", "warning")
    return [_finding(~keys.present(rule.key), "metadata", rule.key, check, severity, rule.message)]


def _string_findings(value: Column, scope: str, rule: S.Rule, check: str,
                     severity: str) -> list[Column]:
    out = []
    length = F.length(value)
    if rule.min_length is not None:
        out.append(_finding(length < rule.min_length, scope, rule.key, check, severity, F.concat(
            F.lit(f"Minimum length is {rule.min_length}, got "), length.cast("string"))))
    if rule.max_length is not None:
        out.append(_finding(length > rule.max_length, scope, rule.key, check, severity, F.concat(
            F.lit(f"Maximum length is {rule.max_length}, got "), length.cast("string"))))
    if rule.pattern is not None:
        out.append(_finding(~value.rlike("(?dU)" + rule.pattern), scope, rule.key, check, severity,
                            rule.message or S.PATTERN_MESSAGE))
    return out


def _array_findings(value: Column, rule: S.Rule, severity: str) -> list[Column]:
    out = []
    size = F.when(value.isNotNull(), F.size(value))
    if rule.min_items is not None:
        out.append(_finding(size < rule.min_items, "metadata", rule.key, "meta_array_rules",
                            severity, rule.message))
    if rule.max_items is not None:
        out.append(_finding(size > rule.max_items, "metadata", rule.key, "meta_array_rules",
                            severity, f"Maximum {rule.max_items} items allowed"))
    return out


def _values(keys: _Keys, rule: S.Rule, severity: str) -> list[Column]:
    value = keys.value(rule.key, "list" if rule.kind == "array" else "str")
    if rule.kind == "string":
        return keys.wrong_type(rule.key, "str", "string", severity) + _string_findings(
            value, "metadata", rule, "meta_string_rules", severity)
    if rule.kind == "array":
        return keys.wrong_type(rule.key, "list", "array", severity) + _array_findings(
            value, rule, severity)
    if rule.kind == "url":
        return keys.wrong_type(rule.key, "str", "URL string", severity) + [
            _finding(~value.rlike(S.URL_PATTERN), "metadata", rule.key, "meta_url_rules", severity,
                     S.URL_MESSAGE)]
    return []


def required_keys(d: Column, key_types: Column | None = None) -> Column:
    """Errors for absent required keys."""
    keys = _Keys(d, key_types)
    return _list([f for r in S.METADATA_REQUIRED for f in _presence(keys, r, True)])


def recommended_keys(d: Column, key_types: Column | None = None) -> Column:
    """Warnings for absent recommended keys."""
    keys = _Keys(d, key_types)
    return _list([f for r in S.METADATA_RECOMMENDED for f in _presence(keys, r, False)])


def value_rules(d: Column, kind: str, key_types: Column | None = None,
                recommended: bool = False) -> Column:
    """Findings on the values of all keys of one kind: ``string``, ``array`` or ``url``.

    Bad values of required keys are errors, of recommended keys warnings.
    """
    keys = _Keys(d, key_types)
    rules = S.METADATA_RECOMMENDED if recommended else S.METADATA_REQUIRED
    severity = "warning" if recommended else "error"
    return _list([f for r in rules if r.kind == kind for f in _values(keys, r, severity)])


def author_rule(d: Column) -> Column:
    """Error when contributors are listed and none is an author."""
    has_author = F.exists(d["contributors"], lambda c: F.coalesce(c["role"] == "author", F.lit(False)))
    return _list([_finding(~has_author, "metadata", "contributors", "meta_author", "error",
                           S.AUTHOR_MESSAGE)])


def metadata_findings(d: Column, key_types: Column | None = None,
                      check_recommended_values: bool = False) -> Column:
    """All findings on the top level of a descriptor.

    By default bad values of recommended keys are not reported, only absent
    ones; ``check_recommended_values`` adds warnings for them.
    """
    keys = _Keys(d, key_types)
    out = [f for r in S.METADATA_REQUIRED
           for f in _presence(keys, r, True) + _values(keys, r, "error")]
    for r in S.METADATA_RECOMMENDED:
        out += _presence(keys, r, False)
        if check_recommended_values:
            out += _values(keys, r, "warning")
    return F.concat(_list(out), author_rule(d))


# ----------------------------------------------------------------- resources
def resource_required(r: Column) -> Column:
    """Errors for absent resource keys and a bad resource name."""
    out = []
    for rule in S.RESOURCE_REQUIRED:
        out.append(_finding(
            r[rule.key].isNull(), "resource", rule.key, "resource_required", "error",
            rule.message or f"Required field '{rule.key}' is missing"))
        out += _string_findings(r[rule.key], "resource", rule, "resource_required", "error")
    return _list(out)


def resource_name_hint(r: Column) -> Column:
    """Warning with a clean name for a bad resource name."""
    name = r["name"]
    verdict = check_resource_name(name)
    return _list([_finding(
        name.isNotNull() & ~verdict["is_valid"], "resource", "name", "resource_name_hint",
        "warning", F.concat(F.lit("Resource name '"), name,
                            F.lit("' contains invalid characters. Suggested name: '"),
                            verdict["suggestion"], F.lit("'")))])


def format_preference(r: Column) -> Column:
    """Warning for a format other than the preferred one."""
    return _list([_finding(
        r["format"] != S.PREFERRED_FORMAT, "resource", "format", "format_preference", "warning",
        F.concat(F.lit("Format '"), r["format"],
                 F.lit(f"' is acceptable, but '{S.PREFERRED_FORMAT}' is preferred")))])


def resource_recommended(r: Column) -> Column:
    """Warnings for absent recommended resource keys."""
    return _list([
        _finding(r[rule.key].isNull(), "resource", rule.key, "resource_recommended", "warning",
                 rule.message or f"Recommended field '{rule.key}' is missing")
        for rule in S.RESOURCE_RECOMMENDED
    ])


def _field_name(f: Column) -> Column:
    return F.coalesce(f["name"], F.lit("unknown"))


def field_required(f: Column) -> Column:
    """Errors for an absent field name or type and for a type that is not allowed."""
    name = _field_name(f)
    return _list([
        _finding(f["name"].isNull(), "field", name, "field_required", "error", S.FIELD_NAME_MESSAGE),
        _finding(f["type"].isNull(), "field", name, "field_required", "error", S.FIELD_TYPE_MESSAGE),
        _finding(~f["type"].isin(S.FIELD_TYPES), "field", name, "field_required", "error",
                 F.concat(F.lit("Invalid type '"), f["type"],
                          F.lit(f"'. Must be one of: {', '.join(S.FIELD_TYPES)}"))),
    ])


def field_unit_key(f: Column) -> Column:
    """Error for a numeric field without a unit."""
    return _list([_finding(f["type"].isin(S.NUMERIC_FIELD_TYPES) & f["unit"].isNull(), "field",
                           _field_name(f), "field_unit_key", "error", S.FIELD_UNIT_MESSAGE)])


def field_description(f: Column) -> Column:
    """Warning for a field without a description."""
    return _list([_finding(f["description"].isNull(), "field", _field_name(f),
                           "field_description", "warning", S.FIELD_DESCRIPTION_MESSAGE)])


def field_findings(f: Column) -> Column:
    """All findings on one field definition."""
    return F.concat(field_required(f), field_unit_key(f), field_description(f))


def resource_findings(r: Column) -> Column:
    """All findings on one resource, its fields included."""
    fields = F.coalesce(
        F.flatten(F.transform(r["schema"]["fields"], field_findings)), _list([_no_finding()]))
    return F.concat(resource_required(r), resource_name_hint(r), format_preference(r),
                    resource_recommended(r), fields)


def _no_finding() -> Column:
    return _finding(F.lit(False), "", "", "", "", "")


def each_resource(d: Column, rule: Callable[[Column], Column], resource_types: Column | None = None) -> Column:
    """Findings of a rule on every resource; the resource is named in ``scope``.

    With the types of its values, rules on texts say nothing about a value that is none.
    """
    def labelled(r: Column, i: Column) -> Column:
        label = F.concat(F.lit("Resource '"),
                         F.coalesce(r["name"], F.concat(F.lit("resource_"), i.cast("string"))),
                         F.lit("'"))
        found = rule(r)
        if resource_types is not None:
            own = F.get(resource_types, i)
            found = F.filter(found, lambda f: (f["scope"] != "resource") | ~f["subject"].isin(RESOURCE_KEYS)
                             | (F.coalesce(F.try_element_at(own, f["subject"]), F.lit("str")) == "str"))
        return F.transform(found, lambda f: f.withField("scope", label))

    return F.coalesce(F.flatten(F.transform(d["resources"], labelled)), _list([_no_finding()]))


def resource_type_findings(d: Column, resource_types: Column) -> Column:
    """Errors for required keys of a resource whose value is no text."""
    def of(types: Column, i: Column) -> Column:
        name = F.get(d["resources"], i)["name"]
        label = F.concat(F.lit("Resource '"), F.coalesce(name, F.concat(F.lit("resource_"), i.cast("string"))), F.lit("'"))
        return _list([
            _finding(F.try_element_at(types, F.lit(key)) != "str", "resource", key, "resource_type", "error",
                     F.concat(F.lit("Expected string, got "), types[key])).withField("scope", label)
            for key in RESOURCE_KEYS])

    return F.coalesce(F.flatten(F.transform(resource_types, of)), _list([_no_finding()]))


def each_field(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A resource rule that applies a field rule to every field."""
    return lambda r: F.coalesce(
        F.flatten(F.transform(r["schema"]["fields"], rule)), _list([_no_finding()]))


def descriptor_findings(d: Column, key_types: Column | None = None,
                        check_recommended_values: bool = False,
                        resource_types: Column | None = None) -> Column:
    """All findings on a descriptor: its own keys first, then its resources in order.

    The types are those of ``parse_descriptors``; without them values count as of the right type.
    """
    parts = [metadata_findings(d, key_types, check_recommended_values),
             each_resource(d, resource_findings, resource_types)]
    if resource_types is not None:
        parts.append(resource_type_findings(d, resource_types))
    return F.concat(*parts)


def strict_rules(d: Column) -> Column:
    """Warnings for rules the standard declares but leaves unchecked; not part of a level.

    Keys of list entries, length of the description, allowed formats, form of
    field names.
    """
    out = [_list([
        _finding(F.length(d["description"]) < r.min_length, "metadata", r.key, "strict_text",
                 "warning", r.message)
        for r in S.METADATA_RECOMMENDED if r.kind == "text"
    ])]

    def lacks(key: str, part: str) -> Column:
        return F.exists(d[key], lambda x: F.coalesce(x[part], F.lit("")) == "")

    out.append(_list([
        _finding(lacks(key, part), "metadata", key, "strict_items", "warning",
                 f"Every entry of '{key}' needs '{part}'")
        for key, parts in S.ITEM_KEYS.items() for part in parts
    ]))

    def field_rules(f: Column) -> Column:
        return _list([_finding(~f["name"].rlike("(?d)" + S.FIELD_NAME_PATTERN), "field",
                               _field_name(f), "strict_field_name", "warning",
                               S.FIELD_NAME_MESSAGE)])

    def resource_rules(r: Column) -> Column:
        listed = _list([_finding(
            ~r["format"].isin(S.FORMATS), "resource", "format", "strict_format", "warning",
            f"Format must be one of: {', '.join(S.FORMATS)}")])
        return F.concat(listed, each_field(field_rules)(r))

    return F.concat(*out, each_resource(d, resource_rules))


def explode_findings(df: DataFrame, key: str, findings: Column) -> DataFrame:
    """``key, scope, subject, check, severity, message``, one row per finding."""
    return df.select(key, F.inline(findings))


# -------------------------------------------------------------------- levels
def level_of(errors: Column, warnings: Column) -> Column:
    """Compliance level from the numbers of errors and warnings."""
    return (
        F.when((errors == 0) & (warnings == 0), "strict")
        .when((errors == 0) & (warnings <= S.MAX_STANDARD_WARNINGS), "standard")
        .when(errors <= S.MAX_BASIC_ERRORS, "basic")
        .otherwise("invalid")
    )


def level_badge(level: Column) -> Column:
    """Badge text of a level."""
    return F.create_map(*[F.lit(x) for pair in S.LEVEL_BADGES.items() for x in pair])[level]


def severity_count(findings: Column, severity: str) -> Column:
    """Number of findings of one severity in an array of findings."""
    return F.size(F.filter(findings, lambda f: f["severity"] == severity))


def grade(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Add ``errors, warnings, level`` from a column of findings, row by row."""
    return (
        df.withColumn("errors", severity_count(F.col(findings), "error"))
        .withColumn("warnings", severity_count(F.col(findings), "warning"))
        .withColumn("level", level_of(F.col("errors"), F.col("warnings")))
    )


def compliance_level(findings: DataFrame, datasets: DataFrame) -> DataFrame:
    """``dataset, errors, warnings, level`` from findings in rows.

    Counted inside each task first; datasets without findings are strict. As
    information does not count, the optimizer leaves out whole branches of
    ``findings`` that only inform, with their scans.
    """
    counts = findings.where(F.col("severity") != "info").groupBy("dataset").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = F.lit(0).cast("long")
    return (
        datasets.select("dataset").join(counts, "dataset", "left")
        .select("dataset", F.coalesce("errors", zero).alias("errors"),
                F.coalesce("warnings", zero).alias("warnings"))
        .withColumn("level", level_of(F.col("errors"), F.col("warnings")))
    )


# ------------------------------------------------------- parts of a descriptor
def license_check(df: DataFrame, name: str, path: str) -> DataFrame:
    """Add ``known_title, ok`` to licence rows: list of common licences, and the URL rule.

    A licence without a name stands for the default one. The list is a fixed
    few rows.
    """
    spark = df.sparkSession
    common = local_table(spark, [(n, t) for n, t, _ in S.LICENSES],
                         "_license string, known_title string")
    effective = F.when(F.coalesce(F.col(name), F.lit("")) == "", S.DEFAULT_LICENSE[0]).otherwise(
        F.col(name))
    url = F.when(F.coalesce(F.col(name), F.lit("")) == "", S.DEFAULT_LICENSE[2]).otherwise(
        F.col(path))
    return (
        df.withColumn("_license", effective)
        .join(F.broadcast(common), "_license", "left")
        .withColumn("ok", F.coalesce((url == "") | url.rlike(S.URL_PATTERN), F.lit(True)))
        .withColumnRenamed("_license", "license")
    )


def contributor_check(role: Column, email: Column) -> Column:
    """struct(ok, message) of one contributor."""
    bad_email = F.coalesce((email != "") & ~email.contains("@"), F.lit(False))
    bad_role = ~F.coalesce(role, F.lit("author")).isin(S.CONTRIBUTOR_ROLES)
    message = (
        F.when(bad_email, "Email must contain @ symbol")
        .when(bad_role, f"Role must be one of: {', '.join(S.CONTRIBUTOR_ROLES)}")
        .otherwise("")
    )
    return F.struct((message == "").alias("ok"), message.alias("message"))


def unit_check(name: Column, path: Column) -> Column:
    """struct(ok, message) of one unit."""
    message = (
        F.when(name.isNull(), "Unit name is required")
        .when((path != "") & ~path.rlike(S.URL_PATTERN), "path must be a valid URL")
        .otherwise("")
    )
    return F.struct((message == "").alias("ok"), message.alias("message"))


def encoding_check(encoding: Column) -> Column:
    """struct(encoding, ok): the encoding in force and whether its name is known."""
    used = F.coalesce(encoding, F.lit(S.DEFAULT_ENCODING))
    folded = F.regexp_replace(F.lower(used), "[- ]", "_")
    return F.struct(used.alias("encoding"), folded.isin(S.ENCODINGS).alias("ok"))
