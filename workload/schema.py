"""Queries over declared fields, column types and constraints."""

from pyspark.sql import functions as F

from packwright.operators import constraints, profile, schema_match
from packwright.operators.constraints import Constraint
from packwright.plans.validate import Dataset, union_all, validate_all
from workload.profiling import LABELLED_SQL, labelled
from workload.registry import query, table

_LINEITEM = [
    ("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"),
    ("l_linenumber", "integer"), ("l_quantity", "number"), ("l_extendedprice", "number"),
    ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "datetime"),
]


@query("infer_fields", " UNION ALL ".join(
    f"""SELECT {i} AS pos, '{c}' AS "column", '{t}' AS field_type,
 {str(t in ('integer', 'number')).lower()} AS is_numeric, count({c}) AS filled FROM lineitem"""
    for i, (c, t) in enumerate(_LINEITEM)))
def infer_fields(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    inferred = schema_match.infer_fields(df, "lineitem").select(
        "column", "field_type", "is_numeric")
    counts = profile.null_profile(df).select(
        "pos", "column", (F.col("rows") - F.col("nulls")).alias("filled"))
    return counts.join(inferred, "column")


_NUMERIC = {"embeddings": (["vec_id", "label"], ["embedding"]),
            "events": (["event_id", "user_id", "value"], ["ts", "event_type", "props"]),
            "orders": (["o_orderkey", "o_custkey", "o_totalprice"],
                       ["o_orderstatus", "o_orderdate", "o_orderpriority"])}


@query("numeric_flag", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, {flag} AS is_numeric, "
    f"CAST({' + '.join(f'count({c})' for c in cols)} AS BIGINT) AS cells FROM {t}"
    for t, (yes, no) in _NUMERIC.items() for flag, cols in (("true", yes), ("false", no))))
def numeric_flag(spark, sf_dir):
    out = []
    for name in _NUMERIC:
        df = table(spark, sf_dir, name)
        counts = profile.null_profile(df).select("column", (F.col("rows") - F.col("nulls")).alias("n"))
        out.append(schema_match.infer_fields(df, name).join(counts, "column")
                   .groupBy("dataset", "is_numeric").agg(F.sum("n").alias("cells")))
    return union_all(out)


# A catalogue with one dataset per part: which columns it has and which it declares.
_COLUMNS_SQL = """cols AS (
  SELECT p_partkey AS dataset, 0 AS pos, 'id' AS "column", 'integer' AS field_type FROM part
  UNION ALL SELECT p_partkey, 1, 'name', CASE WHEN p_partkey % 5 = 0 THEN 'integer' ELSE 'string' END FROM part
  UNION ALL SELECT p_partkey, 2, 'size', CASE WHEN p_partkey % 4 = 0 THEN 'string' ELSE 'integer' END FROM part
  UNION ALL SELECT p_partkey, 3, 'price', 'number' FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey, 4, 'flag', CASE WHEN p_partkey % 7 = 0 THEN 'string' ELSE 'boolean' END FROM part
  UNION ALL SELECT p_partkey, 5, lower(p_type), 'string' FROM part)"""
_FIELDS_SQL = """fields AS (
  SELECT p_partkey AS dataset, 'id' AS name, 'integer' AS type,
    CASE WHEN p_partkey % 6 <> 0 THEN 'NUM' END AS unit_name FROM part
  UNION ALL SELECT p_partkey, 'name', 'string', NULL FROM part
  UNION ALL SELECT p_partkey, 'size', 'integer', CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'cm' END FROM part
  UNION ALL SELECT p_partkey, 'price', 'number', 'EUR' FROM part
  UNION ALL SELECT p_partkey, 'flag', 'boolean', NULL FROM part
  UNION ALL SELECT p_partkey, 'brand', 'any', NULL FROM part WHERE p_partkey % 2 = 0)"""


def part_columns(spark, sf_dir):
    """Columns of the catalogue, see ``schema_match``."""
    p = F.col("p_partkey")

    def column(pos, name, kind, when=F.lit(True)):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        name = F.lit(name) if isinstance(name, str) else name
        return F.when(when, F.struct(F.lit(pos).alias("pos"), name.alias("column"),
                                     kind.alias("field_type")))

    rows = F.array_compact(F.array(
        column(0, "id", "integer"),
        column(1, "name", F.when(p % 5 == 0, "integer").otherwise("string")),
        column(2, "size", F.when(p % 4 == 0, "string").otherwise("integer")),
        column(3, "price", "number", p % 3 != 0),
        column(4, "flag", F.when(p % 7 == 0, "string").otherwise("boolean")),
        column(5, F.lower("p_type"), "string"),
    ))
    return table(spark, sf_dir, "part").select(p.alias("dataset"), F.inline(rows)).withColumns({
        "is_numeric": F.col("field_type").isin("integer", "number"), "is_raw": F.lit(False)})


def part_fields(spark, sf_dir):
    """Declared fields of the catalogue."""
    p = F.col("p_partkey")

    def declared(name, kind, unit=None, when=F.lit(True)):
        unit = F.lit(unit).cast("string") if unit is None or isinstance(unit, str) else unit
        return F.when(when, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"),
                                     unit.alias("unit_name")))

    rows = F.array_compact(F.array(
        declared("id", "integer", F.when(p % 6 != 0, "NUM")),
        declared("name", "string"),
        declared("size", "integer", F.when(p % 8 == 0, "").otherwise("cm")),
        declared("price", "number", "EUR"),
        declared("flag", "boolean"),
        declared("brand", "any", None, p % 2 == 0),
    ))
    return table(spark, sf_dir, "part").select(p.alias("dataset"), F.inline(rows))


@query("extra_columns", f"""WITH {_COLUMNS_SQL}, {_FIELDS_SQL}
SELECT c.dataset, 'extra_columns' AS "check", 'warning' AS severity, c."column" AS subject,
  'Column ''' || c."column" || ''' in data but not in schema definition' AS message
FROM cols c WHERE NOT EXISTS (
  SELECT 1 FROM fields f WHERE f.dataset = c.dataset AND f.name = c."column")""")
def extra_columns(spark, sf_dir):
    return schema_match.extra_columns(part_columns(spark, sf_dir), part_fields(spark, sf_dir))


@query("missing_columns", f"""WITH {_COLUMNS_SQL}, {_FIELDS_SQL}
SELECT f.dataset, 'missing_columns' AS "check", 'warning' AS severity, f.name AS subject,
  'Field ''' || f.name || ''' defined in schema but not found in data' AS message
FROM fields f WHERE NOT EXISTS (
  SELECT 1 FROM cols c WHERE f.dataset = c.dataset AND f.name = c."column")""")
def missing_columns(spark, sf_dir):
    return schema_match.missing_columns(part_columns(spark, sf_dir), part_fields(spark, sf_dir))


@query("declared_type_match", f"""WITH {_COLUMNS_SQL}, {_FIELDS_SQL}
SELECT c.dataset, 'declared_type_match' AS "check", 'error' AS severity, c."column" AS subject,
  'Column ''' || c."column" || ''' declared as ''' || f.type || ''' but has type ''' || c.field_type || ''''
    AS message
FROM cols c JOIN fields f ON f.dataset = c.dataset AND f.name = c."column"
WHERE CASE WHEN f.type IN ('number', 'integer') THEN c.field_type NOT IN ('number', 'integer')
  WHEN f.type = 'any' THEN false ELSE f.type <> c.field_type END""")
def declared_type_match(spark, sf_dir):
    return schema_match.declared_type_match(part_columns(spark, sf_dir), part_fields(spark, sf_dir))


@query("numeric_needs_unit", f"""WITH {_COLUMNS_SQL}, {_FIELDS_SQL}
SELECT c.dataset, 'numeric_needs_unit' AS "check", 'error' AS severity, c."column" AS subject,
  'Numeric field ''' || c."column" || ''' must have a unit specified in the field definition' AS message
FROM cols c JOIN fields f ON f.dataset = c.dataset AND f.name = c."column"
WHERE f.type IN ('number', 'integer') AND coalesce(f.unit_name, '') = ''""")
def numeric_needs_unit(spark, sf_dir):
    return schema_match.numeric_needs_unit(part_columns(spark, sf_dir), part_fields(spark, sf_dir))


# ------------------------------------------------------------------- constraints
@query("constraint_required", f"""WITH {LABELLED_SQL}
SELECT 'doc_id' AS subject, 'required' AS "check", 'error' AS severity,
  count(*) - count(doc_id) AS violations FROM labelled
UNION ALL SELECT 'quality', 'required', 'error', count(*) - count(quality) FROM labelled""")
def constraint_required(spark, sf_dir):
    return constraints.constraint_profile(labelled(spark, sf_dir), [
        Constraint("doc_id", required=True), Constraint("quality", required=True)])


@query("constraint_range", """
SELECT 'l_discount' AS subject, 'minimum' AS "check", 'error' AS severity,
  count(CASE WHEN l_discount < 0.01 THEN 1 END) AS violations FROM lineitem
UNION ALL SELECT 'l_discount', 'maximum', 'error', count(CASE WHEN l_discount > 0.05 THEN 1 END) FROM lineitem
UNION ALL SELECT 'l_linenumber', 'maximum', 'error', count(CASE WHEN l_linenumber > 4 THEN 1 END) FROM lineitem""")
def constraint_range(spark, sf_dir):
    return constraints.constraint_profile(table(spark, sf_dir, "lineitem"), [
        Constraint("l_discount", minimum=0.01, maximum=0.05), Constraint("l_linenumber", maximum=4)])


@query("constraint_pattern", """
SELECT page_id AS "row", 'url' AS "column", 'pattern' AS "check", url AS value FROM pages
WHERE NOT starts_with(url, 'https://')""")
def constraint_pattern(spark, sf_dir):
    return constraints.constraint_violations(
        table(spark, sf_dir, "pages"), "page_id", [Constraint("url", pattern="https://")])


@query("constraint_enum", """
SELECT event_id AS "row", 'event_type' AS "column", 'enum' AS "check", event_type AS value FROM events
WHERE event_type NOT IN ('click', 'view', 'purchase')""")
def constraint_enum(spark, sf_dir):
    return constraints.constraint_violations(
        table(spark, sf_dir, "events"), "event_id",
        [Constraint("event_type", enum=("click", "view", "purchase"))])


@query("constraint_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def constraint_unique(spark, sf_dir):
    return constraints.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_KEYS = [("lineitem", ["l_orderkey", "l_linenumber"]), ("documents", ["text"]),
         ("orders", ["o_orderkey"])]


@query("primary_key", " UNION ALL ".join(f"""
SELECT '{t}' AS dataset, CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_keys,
  count(CASE WHEN n > 1 THEN 1 END) AS repeated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows
FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)})""" for t, k in _KEYS))
def primary_key(spark, sf_dir):
    return union_all([
        constraints.key_profile(table(spark, sf_dir, t), k).withColumn("dataset", F.lit(t))
        for t, k in _KEYS
    ])


@query("constraint_violations", """
SELECT o_orderkey AS "row", 'o_orderpriority' AS "column", 'pattern' AS "check",
  o_orderpriority AS value FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'enum', o_orderstatus FROM orders
  WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'o_custkey', 'minimum', CAST(o_custkey AS VARCHAR) FROM orders
  WHERE o_custkey < 10""")
def constraint_violations(spark, sf_dir):
    return constraints.constraint_violations(table(spark, sf_dir, "orders"), "o_orderkey", [
        Constraint("o_orderpriority", pattern="[1-3]-"),
        Constraint("o_orderstatus", enum=("F", "O")),
        Constraint("o_custkey", minimum=10),
    ])


@query("table_rules", """WITH n AS (SELECT count(*) AS rows, avg(l_discount) AS share, sum(l_quantity) AS total,
  max(l_shipdate) AS latest, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned FROM lineitem)
SELECT 'constraints' AS scope, 'returns' AS subject, 'table_rule' AS "check", 'error' AS severity,
  'Rule ''returns'' is broken by the table of ' || rows || ' rows' AS message FROM n WHERE returned > 0.2 * rows
UNION ALL SELECT 'constraints', 'average_discount', 'table_rule', 'warning',
  'Rule ''average_discount'' is broken by the table of ' || rows || ' rows' FROM n WHERE share > 0.9
UNION ALL SELECT 'constraints', 'stale', 'table_rule', 'info',
  'Rule ''stale'' is broken by the table of ' || rows || ' rows' FROM n WHERE latest < TIMESTAMP '2030-01-01'
UNION ALL SELECT 'constraints', 'large_lots', 'custom_rule', 'warning', 'Rule ''large_lots'' is broken in ' || k || ' of ' || rows || ' rows'
FROM n, (SELECT count(*) AS k FROM lineitem WHERE l_quantity > 45) WHERE k > 0
UNION ALL SELECT 'metadata', 'has_keywords', 'metadata_rule', 'warning', 'Rule ''has_keywords'' is broken by the descriptor'""")
def table_rules(spark, sf_dir):
    """Rules of the user on rows, on aggregates and on the descriptor, in one validation of a whole table."""
    rows = F.count(F.lit(1))
    dataset = Dataset(
        "lines", table(spark, sf_dir, "lineitem"), {"name": "lines", "title": "Lines"},
        rules=(("large_lots", "warning", F.col("l_quantity") > 45),),
        table_rules=(
            ("returns", "error", F.count_if(F.col("l_returnflag") == "R") > rows * F.lit(0.2)),
            ("average_discount", "warning", F.avg("l_discount") > 0.9),
            ("stale", "info", F.max("l_shipdate") < F.lit("2030-01-01").cast("timestamp_ntz"))),
        metadata_rules=(
            ("has_keywords", "warning", lambda d: F.try_variant_get(d, "$.keywords[0]", "string").isNull()),
            ("has_title", "error", lambda d: F.length(F.try_variant_get(d, "$.title", "string")) < 3)))
    return validate_all([dataset])[0].where(F.col("check").isin("table_rule", "custom_rule", "metadata_rule")).drop("dataset")


@query("custom_rule", """
SELECT 'ships_discounted' AS subject, 'custom_rule' AS "check", 'warning' AS severity,
  count(CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' AND l_discount > 0.08 THEN 1 END) AS violations
FROM lineitem
UNION ALL SELECT 'price_below_quantity', 'custom_rule', 'error',
  count(CASE WHEN l_extendedprice < l_quantity * 950 THEN 1 END) FROM lineitem""")
def custom_rule(spark, sf_dir):
    return constraints.constraint_profile(table(spark, sf_dir, "lineitem"), [], [
        ("ships_discounted", "warning",
         (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
         & (F.col("l_discount") > F.lit(0.08))),
        ("price_below_quantity", "error",
         F.col("l_extendedprice") < F.col("l_quantity") * F.lit(950)),
    ])
