"""Rules of a standard as rows, so that a new version is data and not code.

Every rule names a version, a scope (the descriptor itself, its resources or their fields), a path into the element and
what must hold there. Descriptors are joined with the rules of their own version, and every rule is evaluated
by VARIANT paths within the descriptor's row, so catalogues of mixed versions take one narrow pass after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright import standard as S
from packwright.functions.names import check_resource_name
from packwright.functions.value_types import variant_value_type
from packwright.operators.constraints import pattern_fault
from packwright.operators.joins import salted_join
from packwright.session import local_table

RULE_SCHEMA = (
    "version string, pos int, scope string, path string, subject string, kind string, number double, "
    "pattern string, words array<string>, check string, severity string, message string"
)
SCOPES = ("metadata", "resource", "field")
#: What a rule of each kind reports, and which of number, pattern and words it needs.
KINDS = {
    "required": ("the value is absent, or null unless words hold null", ()),
    "type": ("the value is of another type than the first word; the second names the type in messages", ("words",)),
    "min_length": ("a text is shorter than number", ("number",)),
    "max_length": ("a text is longer than number", ("number",)),
    "pattern": ("a text does not match pattern", ("pattern",)),
    "min_items": ("a list has fewer entries than number", ("number",)),
    "max_items": ("a list has more entries than number", ("number",)),
    "one_of": ("a text is none of words", ("words",)),
    "prefer": ("a text is another than the first word", ("words",)),
    "holds": ("no entry of a list has the first word at the path given as pattern", ("pattern", "words")),
    "needs": ("a text is one of words and the path given as pattern is absent", ("pattern", "words")),
    "clean_name": ("a text is no clean resource name", ()),
}
SEVERITIES = ("error", "warning", "info")
_FLAGS = "(?dU)"


def standard_rules(spark: SparkSession, version: str = S.VERSION) -> DataFrame:
    """The rules of the standard in this library as rows."""
    rows: list[tuple] = []

    def add(scope, key, kind, check, severity, message, number=None, pattern=None, words=None):
        rows.append((version, len(rows), scope, f"$.{key}", key, kind, None if number is None else float(number), pattern, words,
                     check, severity, message))

    def texts(scope, rule, check, severity):
        if rule.min_length is not None:
            add(scope, rule.key, "min_length", check, severity, "Minimum length is {number}, got {length}", rule.min_length)
        if rule.max_length is not None:
            add(scope, rule.key, "max_length", check, severity, "Maximum length is {number}, got {length}", rule.max_length)
        if rule.pattern is not None:
            add(scope, rule.key, "pattern", check, severity, rule.message or S.PATTERN_MESSAGE, pattern=_FLAGS + rule.pattern)

    for rule in S.METADATA_REQUIRED:
        add("metadata", rule.key, "required", "meta_required", "error", rule.message, words=["null"])
        kind = {"string": ["str", "string"], "array": ["list", "array"], "url": ["str", "URL string"]}[rule.kind]
        add("metadata", rule.key, "type", "meta_type", "error", "Expected {type}, got {got}", words=kind)
        if rule.kind == "string":
            texts("metadata", rule, "meta_string_rules", "error")
        if rule.min_items is not None:
            add("metadata", rule.key, "min_items", "meta_array_rules", "error", rule.message, rule.min_items)
    for rule in S.METADATA_RECOMMENDED:
        add("metadata", rule.key, "required", "meta_recommended", "warning", rule.message, words=["null"])
    add("metadata", "contributors", "holds", "meta_author", "error", S.AUTHOR_MESSAGE, pattern="$.role", words=["author"])
    for rule in S.RESOURCE_REQUIRED:
        add("resource", rule.key, "required", "resource_required", "error", rule.message or f"Required field '{rule.key}' is missing",
            words=["null"])
        add("resource", rule.key, "type", "resource_type", "error", "Expected {type}, got {got}", words=["str", "string"])
        texts("resource", rule, "resource_required", "error")
    add("resource", "name", "clean_name", "resource_name_hint", "warning",
        "Resource name '{value}' contains invalid characters. Suggested name: '{clean}'")
    add("resource", "format", "prefer", "format_preference", "warning",
        f"Format '{{value}}' is acceptable, but '{S.PREFERRED_FORMAT}' is preferred", words=[S.PREFERRED_FORMAT])
    for rule in S.RESOURCE_RECOMMENDED:
        add("resource", rule.key, "required", "resource_recommended", "warning",
            rule.message or f"Recommended field '{rule.key}' is missing")
    add("field", "name", "required", "field_required", "error", S.FIELD_NAME_MESSAGE)
    add("field", "type", "required", "field_required", "error", S.FIELD_TYPE_MESSAGE)
    add("field", "type", "one_of", "field_required", "error",
        f"Invalid type '{{value}}'. Must be one of: {', '.join(S.FIELD_TYPES)}", words=S.FIELD_TYPES)
    add("field", "type", "needs", "field_unit_key", "error", S.FIELD_UNIT_MESSAGE, pattern="$.unit", words=S.NUMERIC_FIELD_TYPES)
    add("field", "description", "required", "field_description", "warning", S.FIELD_DESCRIPTION_MESSAGE)
    return local_table(spark, rows, RULE_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines or Parquet with the columns of ``RULE_SCHEMA``; faulty rules raise."""
    reader = spark.read.schema(RULE_SCHEMA)
    rules = reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)
    faults = rule_faults(rules).limit(20).collect()
    if faults:
        raise ValueError("faulty rules: " + "; ".join(f"{r.version} {r.pos}: {r.fault}" for r in faults))
    return rules


def rule_faults(rules: DataFrame) -> DataFrame:
    """``version, pos, fault`` of rules that cannot be evaluated: unknown scope, kind or severity, a missing bound, a bad pattern or path.

    Every distinct pattern is compiled once by the JVM that will match it, on the driver; a standard has a few.
    """
    patterns = [r.pattern for r in rules.where((F.col("kind") == "pattern") & F.col("pattern").isNotNull()).select("pattern").distinct().collect()]
    bad = [p for p in patterns if pattern_fault(p)]
    path = r"^\$(\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])*$"

    def lacks(part: str) -> Column:
        kinds = [k for k, (_, needs) in KINDS.items() if part in needs]
        empty = F.col(part).isNull() | ((F.size(part) < 1) if part == "words" else F.lit(False))
        return F.when(F.col("kind").isin(kinds) & empty, f"{part} is missing")

    def unknown(column: str, known) -> Column:
        return F.when(~F.coalesce(F.col(column).isin(list(known)), F.lit(False)), F.concat(F.lit(f"unknown {column} "), F.coalesce(column, F.lit("null"))))

    faults = F.array_compact(F.array(
        F.when(F.col("version").isNull(), "version is missing"), unknown("scope", SCOPES), unknown("kind", KINDS), unknown("severity", SEVERITIES),
        lacks("number"), lacks("pattern"), lacks("words"), F.when(F.col("message").isNull() | F.col("check").isNull(), "message or check is missing"),
        F.when(~F.coalesce(F.col("path").rlike(path), F.lit(False)), "bad path"),
        F.when(F.col("kind").isin("holds", "needs") & ~F.col("pattern").rlike(path), "bad path in pattern"),
        F.when((F.col("kind") == "pattern") & F.col("pattern").isin(bad), F.concat(F.lit("bad pattern "), "pattern"))))
    return rules.select("version", "pos", F.explode(faults).alias("fault"))


def _elements(document: Column) -> Column:
    """What rules look at: the descriptor, its resources and their fields, each with its label and the subject of field rules."""
    none = F.lit(None).cast("string")

    def element(scope: str, label: Column, subject: Column, value: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), label.alias("label"), subject.alias("subject"), value.alias("value"))

    def resource(r: Column, i: Column) -> Column:
        label = F.concat(F.lit("Resource '"), F.coalesce(_text(r, F.lit("$.name")), F.concat(F.lit("resource_"), i.cast("string"))), F.lit("'"))
        fields = F.try_variant_get(r, "$.schema.fields", "array<variant>")
        return F.concat(
            F.array(element("resource", label, none, r)),
            F.coalesce(F.transform(fields, lambda f: element("field", label, F.coalesce(_text(f, F.lit("$.name")), F.lit("unknown")), f)),
                       F.slice(F.array(element("field", label, none, r)), 1, 0)))

    resources = F.transform(F.try_variant_get(document, "$.resources", "array<variant>"), resource)
    top = F.array(element("metadata", F.lit("metadata"), none, document))
    return F.concat(top, F.coalesce(F.flatten(resources), F.slice(top, 1, 0)))


def _text(value: Column, path: Column) -> Column:
    """The text at a path; null where something else stands."""
    own = F.try_variant_get(value, path, "variant")
    return F.when(variant_value_type(own) == "str", F.try_variant_get(value, path, "string"))


def _broken() -> Column:
    """Whether a row's element breaks the row's rule."""
    kind, text, items, first = F.col("kind"), F.col("_text"), F.col("_items"), F.get("words", F.lit(0))
    there = F.col("_own").isNotNull()
    null_is_there = F.coalesce(F.array_contains("words", F.lit("null")), F.lit(False))
    other = F.try_variant_get("value", F.col("pattern"), "variant")
    return F.coalesce(
        F.when(kind == "required", ~there | (F.col("_type").isNull() & ~null_is_there))
        .when(kind == "type", there & (F.coalesce("_type", F.lit("NoneType")) != first))
        .when(kind == "min_length", F.length(text) < F.col("number"))
        .when(kind == "max_length", F.length(text) > F.col("number"))
        .when(kind == "pattern", ~F.regexp_like(text, F.col("pattern")))
        .when(kind == "min_items", F.when(items.isNotNull(), F.size(items) < F.col("number")))
        .when(kind == "max_items", F.when(items.isNotNull(), F.size(items) > F.col("number")))
        .when(kind == "one_of", ~F.array_contains("words", text))
        .when(kind == "prefer", text != first)
        .when(kind == "holds", ~F.exists(items, lambda x: F.coalesce(_text(x, F.col("pattern")) == first, F.lit(False))))
        .when(kind == "needs", F.array_contains("words", text) & (other.isNull() | F.is_variant_null(other)))
        .when(kind == "clean_name", text.isNotNull() & ~check_resource_name(text)["is_valid"])
        .when(kind == "always", F.lit(True)),
        F.lit(False))


def _message() -> Column:
    """The rule's message with its blanks filled in."""
    text, number = F.col("_text"), F.col("number")
    whole = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    blanks = {
        "{number}": whole, "{length}": F.length(text).cast("string"), "{size}": F.size("_items").cast("string"),
        "{got}": F.coalesce("_type", F.lit("NoneType")), "{type}": F.coalesce(F.get("words", F.lit(1)), F.get("words", F.lit(0))),
        "{clean}": check_resource_name(text)["suggestion"], "{version}": F.col("version"), "{value}": text,
    }
    out = F.col("message")
    for blank, value in blanks.items():
        out = F.replace(out, F.lit(blank), F.coalesce(value, F.lit("")))
    return out


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row, however often they are used: a generator is not merged with what follows."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _always(check: str, message: str) -> Column:
    """A rule set of one rule that every descriptor breaks."""
    values = {"scope": "metadata", "path": "$", "kind": "always", "check": check, "severity": "error", "message": message}
    fields = [f.strip().split(" ") for f in RULE_SCHEMA.split(",")][1:]
    return F.array(F.struct(*(F.lit(values.get(name)).cast(kind).alias(name) for name, kind in fields), F.lit("").alias("_one_key")))


def rule_findings(descriptors: DataFrame, rules: DataFrame, key: str = "dataset", json: str = "descriptor_json",
                  version: str = "version") -> DataFrame:
    """``key, version, scope, subject, check, severity, message``: what each descriptor breaks of the rules of its version.

    A descriptor whose version has no rules, or that is no JSON object, gets one finding that says so. All descriptors may be of one
    version: the few rule sets are repeated per salt, so no task holds a version. Elements and rules are exploded within their row,
    so evaluation is generated code without a shuffle.
    """
    columns = [f.strip().split(" ")[0] for f in RULE_SCHEMA.split(",")][1:]
    one_key = F.coalesce(F.regexp_extract("path", r"^\$\.([A-Za-z_][A-Za-z0-9_]*)$", 1), F.lit("")).alias("_one_key")
    sets = rules.groupBy("version").agg(F.array_sort(F.collect_list(F.struct(*columns, one_key))).alias("_rules"))
    parsed = descriptors.select(F.col(key).alias("_key"), F.col(version).alias("version"), F.try_parse_json(json).alias("_parsed"))
    met = salted_join(parsed, sets, ["version"], ["_key"], "left")
    readable = F.coalesce(F.try_variant_get("_parsed", "$", "map<string,variant>").isNotNull(), F.lit(False))
    met = met.select(
        "_key", "version", F.when(readable, F.col("_parsed")).otherwise(F.parse_json(F.lit("{}"))).alias("_document"),
        F.when(F.col("_rules").isNull(), _always("unknown_version", "No rules for version '{version}'"))
        .when(~readable, _always("unreadable", "Descriptor is not a JSON object")).otherwise(F.col("_rules")).alias("_rules"))
    elements = met.select("_key", "version", "_rules", F.inline(_elements(F.col("_document"))))
    elements = _settled(elements, _members=F.try_variant_get("value", "$", "map<string,variant>"))
    pairs = elements.select("_key", "version", "label", F.col("subject").alias("_subject"), "value", "_members", F.inline(
        F.filter("_rules", lambda r: r["scope"] == F.col("scope"))))
    # A path of one key, as nearly all are, is a look-up; only others are parsed.
    own = _settled(pairs, _own=F.when(F.col("_one_key") != "", F.try_element_at("_members", F.col("_one_key")))
                   .otherwise(F.try_variant_get("value", F.col("path"), "variant")))
    own = _settled(own, _type=variant_value_type(F.col("_own")))
    own = _settled(own, _text=F.when(F.col("_type") == "str", F.try_variant_get("_own", "$", "string")),
                   _items=F.when(F.col("_type") == "list", F.try_variant_get("_own", "$", "array<variant>")))
    return own.where(_broken()).select(
        F.col("_key").alias(key), "version", F.col("label").alias("scope"), F.coalesce("_subject", "subject").alias("subject"), "check", "severity",
        _message().alias("message"))
