"""Queries over a catalogue of descriptors: one package per part, with faults of every kind."""

from pyspark.sql import functions as F

from packwright import standard as S
from packwright.functions import package_name_check, version_check
from packwright.operators import catalog, descriptors
from packwright.plans.report import findings_report
from workload.registry import query, table

# ------------------------------------------------------------------ SQL side
_BASE = """pk AS (SELECT p_partkey AS dataset, p_name, p_type, p_size, p_brand,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_name
    WHEN p_partkey % 19 = 0 THEN '.' || replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '-') END AS name,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN CAST(p_size AS VARCHAR)
    ELSE p_type END AS title,
  CASE WHEN p_partkey % 3 = 0 THEN '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')
    WHEN p_partkey % 3 = 1 THEN '2024/01/01' END AS created,
  CASE WHEN p_size % 2 = 0 THEN p_size || '.0.0' WHEN p_size % 3 = 0 THEN 'v' || p_size END AS version,
  CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' ' || p_type END AS description,
  CASE WHEN p_size % 25 > 0 THEN p_size % 25 END AS n_keywords,
  CASE WHEN p_partkey % 4 = 0 THEN 'https://example.org/' || p_partkey
    WHEN p_partkey % 4 = 1 THEN 'ftp://example.org/' || p_partkey END AS homepage,
  CASE WHEN p_partkey % 6 = 0 THEN 'http://example.org/repo' WHEN p_partkey % 6 = 1 THEN 'repo' END AS repository,
  p_size % 2 AS n_licenses, p_size % 3 AS people,
  CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 1 END AS n_sources,
  p_partkey % 4 AS n_resources FROM part),
rs AS (SELECT dataset, i, CASE WHEN i = 0 THEN 'res_' || dataset WHEN i = 1 THEN 'Res ' || dataset || '!' END AS name,
  CASE WHEN (dataset + i) % 8 <> 0 THEN 'data/' || dataset END AS path,
  CASE WHEN (dataset + i) % 4 IN (0, 3) THEN 'parquet' WHEN (dataset + i) % 4 = 1 THEN 'csv' END AS format,
  CASE WHEN (dataset + i) % 2 = 0 THEN 'Title' END AS title,
  CASE WHEN (dataset + i) % 3 = 0 THEN 'Text' END AS description,
  CASE WHEN (dataset + i) % 5 = 0 THEN 'UTF-8' WHEN (dataset + i) % 5 = 1 THEN 'latin-99' END AS encoding,
  (dataset + i) % 6 <> 0 AS has_schema, (dataset + i) % 3 AS n_fields
  FROM (SELECT dataset, unnest(range(n_resources)) AS i FROM pk)),
rl AS (SELECT *, 'Resource ''' || coalesce(name, 'resource_' || i) || '''' AS scope FROM rs),
fs AS (SELECT dataset, i, scope, j, CASE WHEN (dataset + j) % 10 <> 0 THEN 'f' || j END AS name,
  CASE (dataset + i + j) % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'string'
    WHEN 3 THEN 'decimal' END AS type,
  (dataset + j) % 2 = 0 AS has_unit, (dataset + j) % 3 = 0 AS has_description
  FROM (SELECT *, unnest(range(n_fields)) AS j FROM rl WHERE has_schema))"""


def _q(text: str) -> str:
    return text.replace("'", "''")


def _line(check: str, severity: str, subject: str, message: str, source: str, where: str,
          scope: str = "'metadata'") -> str:
    return (f"SELECT dataset, {scope} AS scope, {subject} AS subject, '{check}' AS \"check\", "
            f"'{severity}' AS severity, {message} AS message FROM {source} WHERE {where}")


_ABSENT = {"name": "name IS NULL", "title": "title IS NULL", "resources": "false",
           "licenses": "false", "created": "created IS NULL", "contributors": "people = 0",
           "sources": "false", "description": "description IS NULL", "version": "version IS NULL",
           "keywords": "n_keywords IS NULL", "homepage": "homepage IS NULL",
           "repository": "repository IS NULL"}


def _absent(rules, check, severity):
    return [_line(check, severity, f"'{r.key}'", f"'{_q(r.message)}'", "pk", _ABSENT[r.key])
            for r in rules]


def _message(rules, key):
    return _q(next(r.message for r in rules if r.key == key))


_CLEAN_RES = "trim(regexp_replace(replace(lower(name), ' ', '_'), '[^a-z0-9\\-_.]', '', 'g'), '.')"
_FIELD = "coalesce(name, 'unknown')"
CHECK_SQL = {
    "meta_required": _absent(S.METADATA_REQUIRED, "meta_required", "error"),
    "meta_recommended": _absent(S.METADATA_RECOMMENDED, "meta_recommended", "warning"),
    "meta_string_rules": [
        _line("meta_string_rules", "error", f"'{key}'",
              f"'Minimum length is {low}, got ' || length({key})", "pk", f"length({key}) < {low}")
        for key, low in (("name", 3), ("title", 5))
    ] + [
        _line("meta_string_rules", "error", f"'{key}'",
              f"'Maximum length is {high}, got ' || length({key})", "pk", f"length({key}) > {high}")
        for key, high in (("name", 100), ("title", 200))
    ] + [
        _line("meta_string_rules", "error", f"'{key}'",
              f"'{_message(S.METADATA_REQUIRED, key)}'", "pk",
              f"NOT regexp_full_match({key}, '{pattern}')")
        for key, pattern in (("name", "[a-z0-9\\-_.]+"), ("created", "\\d{4}-\\d{2}-\\d{2}"))
    ],
    "meta_array_rules": [
        _line("meta_array_rules", "error", f"'{key}'", f"'{_message(S.METADATA_REQUIRED, key)}'",
              "pk", f"{n} < 1")
        for key, n in (("resources", "n_resources"), ("licenses", "n_licenses"),
                       ("sources", "n_sources"))
    ],
    "meta_author": [_line("meta_author", "error", "'contributors'", f"'{_q(S.AUTHOR_MESSAGE)}'",
                          "pk", "people = 2")],
    "resource_required": [
        _line("resource_required", "error", "'name'", "'Required field ''name'' is missing'", "rl",
              "name IS NULL", "scope"),
        _line("resource_required", "error", "'name'", "'Value does not match pattern'", "rl",
              "NOT regexp_full_match(name, '[a-z0-9\\-_.]+')", "scope"),
        _line("resource_required", "error", "'path'", "'Required field ''path'' is missing'", "rl",
              "path IS NULL", "scope"),
        _line("resource_required", "error", "'format'",
              "'Parquet format is preferred for performance and metadata'", "rl",
              "format IS NULL", "scope"),
    ],
    "resource_name_hint": [
        _line("resource_name_hint", "warning", "'name'",
              "'Resource name ''' || name || ''' contains invalid characters. Suggested name: '''"
              f" || {_CLEAN_RES} || ''''", "rl", "NOT regexp_full_match(name, '[a-z0-9\\-_.]+')",
              "scope"),
    ],
    "format_preference": [
        _line("format_preference", "warning", "'format'",
              "'Format ''' || format || ''' is acceptable, but ''parquet'' is preferred'", "rl",
              "format <> 'parquet'", "scope"),
    ],
    "resource_recommended": [
        _line("resource_recommended", "warning", f"'{key}'",
              "'" + _q(m or f"Recommended field '{key}' is missing") + "'", "rl", absent, "scope")
        for key, m, absent in (
            ("title", None, "title IS NULL"), ("description", None, "description IS NULL"),
            ("schema", "Schema with field definitions improves data quality", "NOT has_schema"),
            ("encoding", None, "encoding IS NULL"))
    ],
    "field_required": [
        _line("field_required", "error", _FIELD, f"'{_q(S.FIELD_NAME_MESSAGE)}'", "fs",
              "name IS NULL", "scope"),
        _line("field_required", "error", _FIELD, f"'{_q(S.FIELD_TYPE_MESSAGE)}'", "fs",
              "type IS NULL", "scope"),
        _line("field_required", "error", _FIELD,
              f"'Invalid type ''' || type || '''. Must be one of: {', '.join(S.FIELD_TYPES)}'", "fs",
              "type = 'decimal'", "scope"),
    ],
    "field_unit_key": [
        _line("field_unit_key", "error", _FIELD, f"'{_q(S.FIELD_UNIT_MESSAGE)}'", "fs",
              "type IN ('number', 'integer') AND NOT has_unit", "scope"),
    ],
    "field_description": [
        _line("field_description", "warning", _FIELD, f"'{_q(S.FIELD_DESCRIPTION_MESSAGE)}'", "fs",
              "NOT has_description", "scope"),
    ],
}


def _check_sql(*checks: str) -> str:
    lines = [line for c in checks for line in CHECK_SQL[c]]
    return f"WITH {_BASE} " + " UNION ALL ".join(lines)


_ALL_SQL = f"WITH {_BASE}, found AS (" + " UNION ALL ".join(
    line for lines in CHECK_SQL.values() for line in lines) + ") "


# ---------------------------------------------------------------- Spark side
_PACKAGE = """named_struct(
  'name', CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_name
    WHEN p_partkey % 19 = 0 THEN concat('.', replace(p_name, ' ', '-'))
    ELSE replace(p_name, ' ', '-') END,
  'title', CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN string(p_size)
    ELSE p_type END,
  'created', CASE WHEN p_partkey % 3 = 0 THEN concat('2024-01-', lpad(string(p_size % 28 + 1), 2, '0'))
    WHEN p_partkey % 3 = 1 THEN '2024/01/01' END,
  'version', CASE WHEN p_size % 2 = 0 THEN concat(p_size, '.0.0')
    WHEN p_size % 3 = 0 THEN concat('v', p_size) END,
  'description', CASE WHEN p_partkey % 5 <> 0 THEN concat(p_name, ' ', p_type) END,
  'keywords', CASE WHEN p_size % 25 > 0 THEN transform(sequence(1, p_size % 25), k -> concat('k', k)) END,
  'homepage', CASE WHEN p_partkey % 4 = 0 THEN concat('https://example.org/', p_partkey)
    WHEN p_partkey % 4 = 1 THEN concat('ftp://example.org/', p_partkey) END,
  'repository', CASE WHEN p_partkey % 6 = 0 THEN 'http://example.org/repo'
    WHEN p_partkey % 6 = 1 THEN 'repo' END,
  'licenses', slice(array(named_struct('name', 'MIT')), 1, p_size % 2),
  'contributors', CASE WHEN p_size % 3 = 1 THEN array(named_struct('name', 'A', 'role', 'author'))
    WHEN p_size % 3 = 2 THEN array(named_struct('name', 'A', 'role', 'maintainer'),
                                   named_struct('name', 'A', 'role', 'contributor')) END,
  'sources', slice(array(named_struct('title', 'Source')), 1, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 1 END),
  'resources', transform(slice(array(0, 1, 2), 1, int(p_partkey % 4)), i -> named_struct(
    'name', CASE WHEN i = 0 THEN concat('res_', p_partkey) WHEN i = 1 THEN concat('Res ', p_partkey, '!') END,
    'path', CASE WHEN (p_partkey + i) % 8 <> 0 THEN concat('data/', p_partkey) END,
    'title', CASE WHEN (p_partkey + i) % 2 = 0 THEN 'Title' END,
    'description', CASE WHEN (p_partkey + i) % 3 = 0 THEN 'Text' END,
    'format', CASE WHEN (p_partkey + i) % 4 IN (0, 3) THEN 'parquet' WHEN (p_partkey + i) % 4 = 1 THEN 'csv' END,
    'encoding', CASE WHEN (p_partkey + i) % 5 = 0 THEN 'UTF-8' WHEN (p_partkey + i) % 5 = 1 THEN 'latin-99' END,
    'schema', CASE WHEN (p_partkey + i) % 6 <> 0 THEN named_struct('fields',
      transform(slice(array(0, 1), 1, int((p_partkey + i) % 3)), j -> named_struct(
        'name', CASE WHEN (p_partkey + j) % 10 <> 0 THEN concat('f', j) END,
        'type', CASE (p_partkey + i + j) % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'number'
          WHEN 2 THEN 'string' WHEN 3 THEN 'decimal' END,
        'description', CASE WHEN (p_partkey + j) % 3 = 0 THEN 'about' END,
        'unit', CASE WHEN (p_partkey + j) % 2 = 0 THEN named_struct('name', 'cm') END))) END)))"""


def part_packages(spark, sf_dir):
    """``dataset, descriptor`` with one descriptor per part."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS dataset",
                                                   f"{_PACKAGE} AS descriptor")


def _findings(spark, sf_dir, rule):
    packages = part_packages(spark, sf_dir)
    return catalog.explode_findings(packages, "dataset", rule(F.col("descriptor")))


def _register(name, rule):
    @query(name, _check_sql(name))
    def run(spark, sf_dir):
        return _findings(spark, sf_dir, rule)
    return run


_register("meta_required", catalog.required_keys)
_register("meta_recommended", catalog.recommended_keys)
_register("meta_string_rules", lambda d: catalog.value_rules(d, "string"))
_register("meta_array_rules", lambda d: catalog.value_rules(d, "array"))
_register("meta_author", catalog.author_rule)
for _name, _rule in (("resource_required", catalog.resource_required),
                     ("resource_name_hint", catalog.resource_name_hint),
                     ("format_preference", catalog.format_preference),
                     ("resource_recommended", catalog.resource_recommended)):
    _register(_name, lambda d, r=_rule: catalog.each_resource(d, r))
for _name, _rule in (("field_required", catalog.field_required),
                     ("field_unit_key", catalog.field_unit_key),
                     ("field_description", catalog.field_description)):
    _register(_name, lambda d, r=_rule: catalog.each_resource(d, catalog.each_field(r)))


@query("meta_url_rules", f"WITH {_BASE} " + " UNION ALL ".join(
    _line("meta_url_rules", "warning", f"'{k}'", f"'{S.URL_MESSAGE}'", "pk",
          f"NOT regexp_matches({k}, '^https?://')") for k in ("homepage", "repository")))
def meta_url_rules(spark, sf_dir):
    return _findings(spark, sf_dir, lambda d: catalog.value_rules(d, "url", recommended=True))


@query("meta_recommended_values", f"WITH {_BASE} " + " UNION ALL ".join([
    _line("meta_string_rules", "warning", "'version'", f"'{_message(S.METADATA_RECOMMENDED, 'version')}'",
          "pk", "NOT regexp_full_match(version, '\\d+\\.\\d+\\.\\d+(-[a-zA-Z0-9\\-\\.]+)?')"),
    _line("meta_array_rules", "warning", "'keywords'", f"'{_message(S.METADATA_RECOMMENDED, 'keywords')}'",
          "pk", "n_keywords < 3"),
    _line("meta_array_rules", "warning", "'keywords'", "'Maximum 20 items allowed'", "pk",
          "n_keywords > 20"),
]))
def meta_recommended_values(spark, sf_dir):
    return _findings(spark, sf_dir, lambda d: F.concat(
        catalog.value_rules(d, "string", recommended=True),
        catalog.value_rules(d, "array", recommended=True)))


@query("strict_rules", f"WITH {_BASE} " + " UNION ALL ".join([
    _line("strict_text", "warning", "'description'",
          f"'{_message(S.METADATA_RECOMMENDED, 'description')}'", "pk", "length(description) < 50"),
    _line("strict_items", "warning", "'licenses'", "'Every entry of ''licenses'' needs ''path'''",
          "pk", "n_licenses > 0"),
    _line("strict_field_name", "warning", _FIELD, f"'{_q(S.FIELD_NAME_MESSAGE)}'", "fs",
          "NOT regexp_full_match(name, '[a-zA-Z][a-zA-Z0-9_]*')", "scope"),
]))
def strict_rules(spark, sf_dir):
    # Licences of the test catalogue have no path.
    full = part_packages(spark, sf_dir).select("dataset", F.from_json(
        F.to_json("descriptor"), catalog.DESCRIPTOR).alias("descriptor"))
    return catalog.explode_findings(full, "dataset", catalog.strict_rules(F.col("descriptor")))


@query("descriptor_findings", _ALL_SQL + "SELECT * FROM found")
def descriptor_findings(spark, sf_dir):
    return _findings(spark, sf_dir, catalog.descriptor_findings)


_LEVEL_SQL = """counts AS (SELECT pk.dataset,
  count(CASE WHEN severity = 'error' THEN 1 END) AS errors,
  count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings
FROM pk LEFT JOIN found ON pk.dataset = found.dataset GROUP BY pk.dataset)
SELECT dataset, errors, warnings, CASE WHEN errors = 0 AND warnings = 0 THEN 'strict'
  WHEN errors = 0 AND warnings <= 5 THEN 'standard' WHEN errors <= 10 THEN 'basic'
  ELSE 'invalid' END AS level FROM counts"""


@query("compliance_level", _ALL_SQL.rstrip() + ", " + _LEVEL_SQL)
def compliance_level(spark, sf_dir):
    packages = part_packages(spark, sf_dir)
    found = catalog.explode_findings(
        packages, "dataset", catalog.descriptor_findings(F.col("descriptor")))
    return catalog.compliance_level(found, packages)


@query("grade", _ALL_SQL.rstrip() + ", " + _LEVEL_SQL.replace("errors, warnings, CASE",
       "CAST(errors AS INTEGER) AS errors, CAST(warnings AS INTEGER) AS warnings, CASE"))
def grade(spark, sf_dir):
    packages = part_packages(spark, sf_dir).withColumn(
        "findings", catalog.descriptor_findings(F.col("descriptor")))
    return catalog.grade(packages).select("dataset", "errors", "warnings", "level")


# ------------------------------------------------------------ single checks
@query("package_name_check", f"""WITH {_BASE}
SELECT dataset, message = '' AS ok, message FROM (SELECT dataset, CASE
  WHEN name IS NULL OR name = '' THEN 'Package name is required'
  WHEN NOT regexp_full_match(name, '[a-z0-9\\-_.]+') THEN 'Package name can only contain lowercase letters, numbers, hyphens, underscores, and dots'
  WHEN name LIKE '.%' OR name LIKE '%.' THEN 'Package name cannot start or end with a dot'
  ELSE '' END AS message FROM pk)""")
def package_names(spark, sf_dir):
    return part_packages(spark, sf_dir).select(
        "dataset", package_name_check(F.col("descriptor.name")).alias("v")).select("dataset", "v.*")


@query("version_check", f"""WITH {_BASE}
SELECT dataset, coalesce(regexp_full_match(version, '\\d+\\.\\d+\\.\\d+(-[a-zA-Z0-9\\-\\.]+)?'), true) AS ok
FROM pk""")
def versions(spark, sf_dir):
    return part_packages(spark, sf_dir).select(
        "dataset", version_check(F.col("descriptor.version"))["ok"].alias("ok"))


_LICENSE_VALUES = ", ".join(f"('{n}', '{t}')" for n, t, _ in S.LICENSES)


@query("license_check", f"""WITH l AS (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'MIT'
    WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN NULL WHEN 3 THEN 'Own' ELSE 'CC0-1.0' END AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://example.org/l' WHEN o_orderkey % 3 = 1 THEN 'license.txt' END AS path
  FROM orders), known(license, known_title) AS (VALUES {_LICENSE_VALUES}),
e AS (SELECT o_orderkey, coalesce(name, 'CC-BY-4.0') AS license,
  CASE WHEN name IS NULL THEN 'https://spdx.org/licenses/CC-BY-4.0.html' ELSE path END AS path FROM l)
SELECT o_orderkey, e.license, known_title,
  coalesce(path = '' OR regexp_matches(path, '^https?://'), true) AS ok
FROM e LEFT JOIN known ON e.license = known.license""")
def license_check(spark, sf_dir):
    c, o = F.col("o_custkey") % 5, F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(c == 0, "MIT").when(c == 1, "Apache-2.0").when(c == 3, "Own").when(c == 4, "CC0-1.0")
        .alias("name"),
        F.when(o == 0, "https://example.org/l").when(o == 1, "license.txt").alias("path"))
    return catalog.license_check(rows, "name", "path").select(
        "o_orderkey", "license", "known_title", "ok")


@query("contributor_check", """WITH c AS (SELECT c_custkey, lower(c_mktsegment) AS segment,
  CASE WHEN c_custkey % 4 = 0 THEN 'author' WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment)
    WHEN c_custkey % 4 = 2 THEN 'wrangler' END AS role,
  CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) || '@example.org' WHEN c_custkey % 3 = 1 THEN c_name END AS email
  FROM customer),
m AS (SELECT c_custkey, CASE WHEN email <> '' AND NOT contains(email, '@') THEN 'Email must contain @ symbol'
  WHEN coalesce(role, 'author') NOT IN ('author', 'contributor', 'maintainer', 'publisher', 'wrangler')
  THEN 'Role must be one of: author, contributor, maintainer, publisher, wrangler' ELSE '' END AS message FROM c)
SELECT c_custkey, message = '' AS ok, message FROM m""")
def contributor_check(spark, sf_dir):
    k = F.col("c_custkey")
    role = F.when(k % 4 == 0, "author").when(k % 4 == 1, F.lower("c_mktsegment")).when(
        k % 4 == 2, "wrangler")
    email = F.when(k % 3 == 0, F.concat(F.lower("c_name"), F.lit("@example.org"))).when(
        k % 3 == 1, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", catalog.contributor_check(role, email).alias("v")).select("c_custkey", "v.*")


@query("unit_check", """WITH u AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'u' || page_id END AS name,
  CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', 'urn:') ELSE url END AS path FROM pages),
m AS (SELECT page_id, CASE WHEN name IS NULL THEN 'Unit name is required'
  WHEN path <> '' AND NOT regexp_matches(path, '^https?://') THEN 'path must be a valid URL' ELSE '' END AS message FROM u)
SELECT page_id, message = '' AS ok, message FROM m""")
def unit_check(spark, sf_dir):
    k = F.col("page_id")
    name = F.when(k % 5 != 0, F.concat(F.lit("u"), k.cast("string")))
    path = F.when(k % 3 == 0, F.regexp_replace("url", "^https?://", "urn:")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", catalog.unit_check(name, path).alias("v")).select("page_id", "v.*")


@query("encoding_check", f"""WITH {_BASE}
SELECT dataset, coalesce(encoding, 'utf-8') AS encoding, coalesce(encoding, 'utf-8') <> 'latin-99' AS ok FROM rs""")
def encoding_check(spark, sf_dir):
    resources = part_packages(spark, sf_dir).select(
        "dataset", F.explode("descriptor.resources").alias("r"))
    return resources.select("dataset", catalog.encoding_check(F.col("r.encoding")).alias("v")).select(
        "dataset", "v.*")


@query("meta_type", """WITH j AS (SELECT p_partkey AS dataset, p_partkey % 4 AS k, p_size FROM part)
SELECT dataset, 'title' AS subject, 'Expected string, got int' AS message FROM j WHERE k = 0
UNION ALL SELECT dataset, 'licenses', 'Expected array, got str' FROM j WHERE k = 1
UNION ALL SELECT dataset, 'name', 'Expected string, got NoneType' FROM j WHERE k = 2
UNION ALL SELECT dataset, 'sources', 'Expected array, got dict' FROM j WHERE k = 3
UNION ALL SELECT dataset, 'created', 'Expected string, got ' || CASE WHEN p_size % 2 = 0 THEN 'float' ELSE 'bool' END
FROM j""")
def meta_type(spark, sf_dir):
    k = F.col("p_partkey") % 4
    part = (F.when(k == 0, F.concat(F.lit('"title": '), F.col("p_size").cast("string")))
            .when(k == 1, '"licenses": "MIT"').when(k == 2, '"name": null')
            .otherwise('"sources": {"title": "t"}'))
    created = F.when(F.col("p_size") % 2 == 0, "1.5").otherwise("true")
    docs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dataset"),
        F.concat(F.lit("{"), part, F.lit(', "created": '), created, F.lit("}")).alias("json"))
    parsed = catalog.parse_descriptors(docs, "json")
    found = catalog.explode_findings(
        parsed, "dataset", catalog.metadata_findings(F.col("descriptor"), F.col("key_types")))
    return found.where(F.col("check") == "meta_type").select("dataset", "subject", "message")


@query("resource_types", """WITH j AS (SELECT p_partkey AS dataset, p_partkey % 4 AS k FROM part)
SELECT dataset, 'Resource ''' || CASE k WHEN 0 THEN '7' ELSE 'data' END || '''' AS scope, CASE k WHEN 0 THEN 'name'
    WHEN 1 THEN 'path' ELSE 'format' END AS subject, 'Expected string, got ' || CASE k WHEN 0 THEN 'int'
    WHEN 1 THEN 'list' ELSE 'bool' END AS message FROM j WHERE k < 3
UNION ALL SELECT dataset, 'Resource ''' || CASE k WHEN 0 THEN '7' ELSE 'data' END || '''', 'size',
  'Numeric fields MUST have units specified' FROM j WHERE dataset % 3 = 0""")
def resource_types(spark, sf_dir):
    """Values of the wrong type below the top level, and units as text, in catalogues of JSON."""
    key = F.col("p_partkey")
    k = key % 4
    unit = F.when(key % 3 == 1, ', "unit": "cm"').when(key % 3 == 2, ', "unit": {"name": "cm"}').otherwise("")
    docs = table(spark, sf_dir, "part").select(key.alias("dataset"), F.concat(
        F.lit('{"resources": [{"name": '), F.when(k == 0, "7").otherwise('"data"'), F.lit(', "path": '),
        F.when(k == 1, '["a"]').otherwise('"data.parquet"'), F.lit(', "format": '), F.when(k == 2, "true").otherwise('"parquet"'),
        F.lit(', "schema": {"fields": [{"name": "size", "type": "integer", "description": "Size"'), unit,
        F.lit("}]}}]}")).alias("json"))
    parsed = catalog.parse_descriptors(docs, "json")
    found = catalog.explode_findings(parsed, "dataset", catalog.descriptor_findings(
        F.col("descriptor"), F.col("key_types"), resource_types=F.col("resource_types")))
    return found.where((F.col("severity") == "error") & (F.col("scope") != "metadata")).select(
        "dataset", "scope", "subject", "message")


# ------------------------------------------------------- building and configs
@query("descriptor_build", f"""WITH {_BASE}
SELECT dataset, CASE
  WHEN name IS NULL THEN 'Invalid package name: Package name is required'
  WHEN NOT regexp_full_match(name, '[a-z0-9\\-_.]+') THEN 'Invalid package name: Package name can only contain lowercase letters, numbers, hyphens, underscores, and dots'
  WHEN name LIKE '.%' OR name LIKE '%.' THEN 'Invalid package name: Package name cannot start or end with a dot'
  WHEN NOT coalesce(regexp_full_match(version, '\\d+\\.\\d+\\.\\d+(-[a-zA-Z0-9\\-\\.]+)?'), true)
    THEN 'Invalid version: Version must follow semantic versioning (e.g., 1.0.0)'
  WHEN NOT coalesce(regexp_matches(homepage, '^https?://'), true)
    THEN 'Invalid homepage URL: URL must start with http:// or https://'
  WHEN NOT coalesce(regexp_matches(repository, '^https?://'), true)
    THEN 'Invalid repository URL: URL must start with http:// or https://'
  WHEN n_resources = 0 THEN 'At least one resource is required'
  WHEN title IS NULL THEN 'Required field ''title'' is missing'
  WHEN n_licenses = 0 THEN 'Required field ''licenses'' is missing'
  WHEN people = 0 THEN 'Required field ''contributors'' is missing'
  WHEN n_sources = 0 THEN 'Required field ''sources'' is missing' END AS build_error,
  coalesce(created, '2025-10-15') AS created, n_resources AS resources,
  CASE WHEN n_keywords IS NULL THEN 0 ELSE n_keywords END AS keywords FROM pk""")
def descriptor_build(spark, sf_dir):
    packages = part_packages(spark, sf_dir)
    full = packages.select(
        "dataset",
        F.from_json(F.to_json("descriptor"), catalog.DESCRIPTOR).alias("details"))
    built = descriptors.descriptor_build(
        full.withColumn("resources", F.col("details.resources")), created="2025-10-15")
    read = F.from_json("descriptor_json", catalog.DESCRIPTOR)
    return built.select(
        "dataset", "build_error", read["created"].alias("created"),
        F.coalesce(F.size(read["resources"]), F.lit(0)).cast("long").alias("resources"),
        F.coalesce(F.size(read["keywords"]), F.lit(0)).alias("keywords"))


def _mapping_json():
    k = F.col("c_custkey")
    return F.when(k % 10 == 9, "{broken").otherwise(F.to_json(F.struct(
        F.when(k % 5 != 0, F.when(k % 3 == 0, "1.1.0").otherwise("1.0.0")).alias("version"),
        F.when(k % 7 == 0, "metadata").otherwise("mapping").alias("config_type"),
        F.struct(F.concat(F.lower("c_name"), F.lit(".csv")).alias("original_file"),
                 F.lit("Sheet 1").alias("sheet_name")).alias("file_info"),
        F.when(k % 4 != 0, F.create_map(
            F.lit("name"), F.concat(F.lit("http://v/name/"), k.cast("string")),
            F.lit("balance_unit"), F.lit("http://v/unit/EUR"),
            F.lower("c_mktsegment"), F.lit("http://v/segment"))).alias("column_mappings"))))


def _metadata_json():
    k = F.col("c_custkey")
    return F.to_json(F.struct(
        F.lit("1.0.0").alias("version"), F.lit("metadata").alias("config_type"),
        F.struct(F.when(k % 2 == 0, F.lower("c_name")).otherwise("other").alias("name"),
                 F.col("c_mktsegment").alias("title"),
                 F.array(F.lit("a"), F.lit("b")).alias("keywords")).alias("package"),
        F.array(F.struct(F.lit("MIT").alias("name"))).alias("licenses")))


def customer_configs(spark, sf_dir):
    """Mapping and metadata configurations as JSON, one pair per customer."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", _mapping_json().alias("mapping_json"), _metadata_json().alias("metadata_json"))


@query("config_check", """WITH c AS (SELECT c_custkey AS k, c_name FROM customer),
m AS (SELECT k, CASE WHEN k % 10 = 9 THEN 'Invalid JSON'
  WHEN k % 7 = 0 THEN 'Expected mapping config, got: metadata'
  WHEN k % 5 = 0 AND k % 4 = 0 THEN 'Missing required fields: [''version'', ''column_mappings'']'
  WHEN k % 5 = 0 THEN 'Missing required fields: [''version'']'
  WHEN k % 4 = 0 THEN 'Missing required fields: [''column_mappings'']' ELSE '' END AS mapping_message,
  CASE WHEN k % 10 = 9 OR k % 5 = 0 THEN 'unknown' WHEN k % 3 = 0 THEN '1.1.0' ELSE '1.0.0' END AS mv FROM c)
SELECT k AS c_custkey, mapping_message = '' AS mapping_ok, mapping_message, true AS metadata_ok,
  mv = '1.0.0' AS compatible,
  CASE WHEN mv <> '1.0.0' THEN 'Config version mismatch: mapping=' || mv || ', metadata=1.0.0' ELSE '' END AS message,
  k % 10 <> 9 AND k % 2 <> 0 AS name_hint FROM m""")
def config_check(spark, sf_dir):
    configs = customer_configs(spark, sf_dir).select(
        "c_custkey", descriptors.mapping_config_check(F.col("mapping_json")).alias("a"),
        descriptors.metadata_config_check(F.col("metadata_json"))["ok"].alias("metadata_ok"),
        descriptors.parse_mapping_config(F.col("mapping_json")).alias("mapping"),
        descriptors.parse_metadata_config(F.col("metadata_json")).alias("metadata"))
    return configs.withColumn("v", descriptors.compatibility(F.col("mapping"), F.col("metadata"))).select(
        "c_custkey", F.col("a.ok").alias("mapping_ok"), F.col("a.message").alias("mapping_message"),
        "metadata_ok", F.col("v.ok").alias("compatible"), "v.message", "v.name_hint")


@query("config_split", """WITH c AS (SELECT * FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 4 <> 0)
SELECT c_custkey, 'name' AS "column", 'http://v/name/' || c_custkey AS concept_id, NULL AS unit_id,
  lower(c_name) || '.csv' AS original_file, 'Sheet 1' AS sheet_name, c_mktsegment AS title FROM c
UNION ALL SELECT c_custkey, 'balance', NULL, 'http://v/unit/EUR', lower(c_name) || '.csv', 'Sheet 1', c_mktsegment FROM c
UNION ALL SELECT c_custkey, lower(c_mktsegment), 'http://v/segment', NULL, lower(c_name) || '.csv', 'Sheet 1', c_mktsegment FROM c""")
def config_split(spark, sf_dir):
    configs = customer_configs(spark, sf_dir).select(
        "c_custkey", descriptors.parse_mapping_config(F.col("mapping_json")).alias("mapping"),
        descriptors.general_details(descriptors.parse_metadata_config(F.col("metadata_json")))
        .alias("details"))
    return configs.select(
        "c_custkey", F.inline(descriptors.column_entries(F.col("mapping"))), "mapping.file_info.original_file",
        "mapping.file_info.sheet_name", F.col("details.title").alias("title"))


@query("config_build", """SELECT c_custkey, 'mapping' AS mapping_type, lower(c_name) || '.csv' AS original_file,
  'http://v/' || c_nationkey AS concept_id, lower(c_name) AS package, 1 AS licenses, 0 AS sources FROM customer""")
def config_build(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        descriptors.build_mapping_config(
            F.create_map(F.lit("nation"), F.concat(F.lit("http://v/"), F.col("c_nationkey").cast("string"))),
            F.concat(F.lower("c_name"), F.lit(".csv")), F.lit("S")).alias("mapping_json"),
        F.struct(F.lower("c_name").alias("name"),
                 *[none.alias(c) for c in ("title", "description", "version", "profile", "created",
                                           "modified", "homepage", "repository")],
                 F.lit(None).cast("array<string>").alias("keywords"),
                 F.array(F.struct(F.lit("MIT").alias("name"))).alias("licenses"),
                 F.lit(None).cast("array<string>").alias("contributors"),
                 F.array().cast("array<string>").alias("sources")).alias("details"))
    read = rows.select(
        "c_custkey", descriptors.parse_mapping_config(F.col("mapping_json")).alias("m"),
        descriptors.parse_metadata_config(descriptors.build_metadata_config(F.col("details"))).alias("d"))
    return read.select(
        "c_custkey", F.col("m.config_type").alias("mapping_type"), "m.file_info.original_file",
        F.col("m.column_mappings")["nation"].alias("concept_id"), F.col("d.package.name").alias("package"),
        F.coalesce(F.size("d.licenses"), F.lit(0)).alias("licenses"),
        F.when(F.col("d.sources").isNull(), 0).otherwise(F.size("d.sources")).alias("sources"))


# ------------------------------------------------------------------- reports
_REPORT_SQL = """WITH f AS (SELECT o_custkey AS dataset, o_orderkey AS ordinal,
  CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity,
  'Order ' || o_orderkey || ' has priority ' || o_orderpriority AS message FROM orders),
c AS (SELECT dataset, count(CASE WHEN severity = 'error' THEN 1 END) AS errors,
  count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings,
  count(CASE WHEN severity = 'info' THEN 1 END) AS infos FROM f GROUP BY dataset),
l AS (SELECT *, CASE WHEN errors = 0 AND warnings = 0 THEN '✅ STRICT COMPLIANCE'
  WHEN errors = 0 AND warnings <= 5 THEN '✓ STANDARD COMPLIANCE'
  WHEN errors <= 10 THEN '~ BASIC COMPLIANCE' ELSE '✗ NON-COMPLIANT' END AS badge FROM c)
SELECT dataset, CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS section,
  row_number() OVER (PARTITION BY dataset, severity ORDER BY ordinal) AS number,
  row_number() OVER (PARTITION BY dataset, severity ORDER BY ordinal) || '. ' || message AS line FROM f
UNION ALL SELECT dataset, 0, 1, repeat('=', 80) FROM l
UNION ALL SELECT dataset, 0, 2, 'VALIDATION REPORT' FROM l
UNION ALL SELECT dataset, 0, 3, repeat('=', 80) FROM l
UNION ALL SELECT dataset, 0, 4, 'Dataset: ' || dataset FROM l
UNION ALL SELECT dataset, 0, 5, 'Validation Level: ' || badge FROM l
UNION ALL SELECT dataset, 0, 6, 'Validation Status: ' || CASE WHEN errors = 0 THEN 'PASSED' ELSE 'FAILED' END FROM l
UNION ALL SELECT dataset, 0, 7, 'Errors: ' || errors FROM l
UNION ALL SELECT dataset, 0, 8, 'Warnings: ' || warnings FROM l
UNION ALL SELECT dataset, 0, 9, 'Info Messages: ' || infos FROM l
UNION ALL SELECT dataset, 1, 0, 'ERRORS' FROM l WHERE errors > 0
UNION ALL SELECT dataset, 2, 0, 'WARNINGS' FROM l WHERE warnings > 0
UNION ALL SELECT dataset, 3, 0, 'DATA QUALITY METRICS' FROM l WHERE infos > 0
UNION ALL SELECT dataset, 9, 0, 'END OF REPORT' FROM l"""


@query("findings_report", _REPORT_SQL)
def report(spark, sf_dir):
    status = F.col("o_orderstatus")
    found = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("ordinal"),
        F.when(status == "F", "error").when(status == "O", "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" has priority "),
                 "o_orderpriority").alias("message"))
    counts = found.groupBy("dataset").agg(
        *[F.count_if(F.col("severity") == s).alias(s + "s") for s in ("error", "warning", "info")])
    levels = counts.withColumn("level", catalog.level_of(F.col("errors"), F.col("warnings")))
    return findings_report(found, levels)
