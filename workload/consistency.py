"""Queries over value types and mixed columns."""

from pyspark.sql import functions as F

from packwright.functions import value_type, variant_value_type
from packwright.operators import consistency, schema_match
from packwright.plans.report import inconsistency_sink
from packwright.session import local_table, shared_dir
from workload.registry import query, table

TYPE_SQL = """CASE WHEN regexp_full_match({v}, '[+-]?\\d+') THEN 'int'
 WHEN regexp_full_match({v}, '[+-]?(\\d+\\.\\d*|\\.\\d+)([eE][+-]?\\d+)?|[+-]?\\d+[eE][+-]?\\d+') THEN 'float'
 WHEN regexp_full_match({v}, '[Tt]rue|TRUE|[Ff]alse|FALSE') THEN 'bool'
 WHEN regexp_full_match({v}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date'
 WHEN regexp_full_match({v}, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?(Z|[+-]\\d{{2}}:?\\d{{2}})?') THEN 'datetime'
 WHEN regexp_full_match({v}, '\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?') THEN 'time'
 ELSE 'str' END"""

DIRTY_SQL = f"""dirty AS (SELECT event_id, event_type,
  CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 41 = 0 THEN 'true'
    WHEN event_id % 89 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS code,
  CASE WHEN event_id % 53 = 0 THEN '2024-01-15' WHEN event_id % 59 = 0 THEN '12:30:00' WHEN event_id % 2 = 0 THEN '1.5'
    ELSE CAST(event_id AS VARCHAR) END AS amount
FROM events),
cells AS (SELECT "row", "column", value, {TYPE_SQL.format(v='value')} AS value_type FROM (
  SELECT event_id AS "row", 'code' AS "column", code AS value FROM dirty
  UNION ALL SELECT event_id, 'amount', amount FROM dirty
  UNION ALL SELECT event_id, 'event_type', event_type FROM dirty) WHERE value IS NOT NULL),
tally AS (SELECT "column", value_type, count(*) AS n, min("row") AS first_row FROM cells
  GROUP BY "column", value_type),
expected AS (SELECT "column", value_type AS expected_type FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first_row) AS nth FROM tally)
  WHERE nth = 1)"""
RAW = ["code", "amount", "event_type"]


def dirty(spark, sf_dir):
    """Events with two more columns, of text of mixed content."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "*",
        F.when(i % 97 == 0, "n/a").when(i % 41 == 0, "true").when(i % 89 == 0, F.lit(None))
        .otherwise(F.col("user_id").cast("string")).alias("code"),
        F.when(i % 53 == 0, "2024-01-15").when(i % 59 == 0, "12:30:00").when(i % 2 == 0, "1.5")
        .otherwise(i.cast("string")).alias("amount"))


def cells(spark, sf_dir):
    return consistency.typed_cells(dirty(spark, sf_dir), "event_id", RAW)


def _tally(spark, sf_dir):
    return consistency.type_tally(cells(spark, sf_dir))


@query("value_type", f"""WITH {DIRTY_SQL}
SELECT "row" AS event_id, "column", value_type FROM cells""")
def value_types(spark, sf_dir):
    return cells(spark, sf_dir).select(F.col("row").alias("event_id"), "column", "value_type")


@query("value_type_variant", """
SELECT value_type, count(*) AS n FROM (SELECT CASE
  WHEN event_id % 7 = 0 THEN 'str' WHEN event_id % 7 = 1 THEN 'float' WHEN event_id % 7 = 2 THEN 'bool'
  WHEN event_id % 7 = 3 THEN 'list' WHEN event_id % 7 = 4 THEN 'dict' WHEN event_id % 7 = 5 THEN NULL
  ELSE CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' END
  END AS value_type FROM events) GROUP BY value_type""")
def value_type_variant(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    i = F.col("event_id") % 7
    text = (
        F.when(i == 0, F.concat(F.lit('"'), k, F.lit('"')))
        .when(i == 1, F.concat(k, F.lit(".5"))).when(i == 2, "true")
        .when(i == 3, F.concat(F.lit("["), k, F.lit("]"))).when(i == 4, F.col("props"))
        .when(i == 5, "null").otherwise(k)
    )
    return table(spark, sf_dir, "events").select(
        variant_value_type(F.parse_json(text)).alias("value_type")).groupBy("value_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("mixed_type_columns", f"""WITH {DIRTY_SQL}
SELECT "column", count(*) AS n_types, string_agg(value_type, ', ' ORDER BY first_row) AS types,
  CAST(sum(n) - max(n) AS BIGINT) AS inconsistent,
  'Column ''' || "column" || ''' has mixed types: ' || string_agg(value_type, ', ' ORDER BY first_row)
    || ' (' || CAST(sum(n) - max(n) AS BIGINT) || ' inconsistent values tracked)' AS message
FROM tally GROUP BY "column" HAVING count(*) > 1""")
def mixed_type_columns(spark, sf_dir):
    return consistency.mixed_type_columns(_tally(spark, sf_dir))


@query("expected_type", f"WITH {DIRTY_SQL} SELECT * FROM expected")
def expected_type(spark, sf_dir):
    return consistency.expected_type(_tally(spark, sf_dir))


INCONSISTENCY_SQL = f"""WITH {DIRTY_SQL}
SELECT "row", "column", value, value_type AS actual_type, expected_type
FROM cells JOIN expected USING ("column") WHERE value_type <> expected_type"""


@query("type_inconsistencies", INCONSISTENCY_SQL)
def type_inconsistencies(spark, sf_dir):
    long = cells(spark, sf_dir)
    return consistency.type_inconsistencies(
        long, consistency.expected_type(consistency.type_tally(long)))


@query("inconsistency_sink", INCONSISTENCY_SQL)
def inconsistency_csv(spark, sf_dir):
    path = inconsistency_sink(type_inconsistencies(spark, sf_dir), shared_dir(spark) + "/issues")
    return spark.read.option("header", True).schema(
        "`row` long, `column` string, value string, actual_type string, expected_type string"
    ).csv(path)


@query("mixed_type_examples", f"""WITH {DIRTY_SQL},
ex AS (SELECT c."column", c.value_type, c."row",
  c.value_type || ': ' || CASE WHEN c.value_type = 'str' THEN '''' || c.value || '''' ELSE c.value END
    AS example
FROM cells c JOIN tally t ON c."column" = t."column" AND c.value_type = t.value_type
  AND c."row" = t.first_row)
SELECT "column", string_agg(value_type, ', ' ORDER BY "row") AS types,
  string_agg(example, ' | ' ORDER BY "row") AS examples
FROM ex GROUP BY "column" HAVING count(*) > 1""")
def mixed_type_examples(spark, sf_dir):
    long = cells(spark, sf_dir)
    return consistency.mixed_type_examples(long, consistency.type_tally(long))


_DECLARED = [("code", "integer"), ("amount", "boolean"), ("event_type", "number")]
_ACCEPTED_SQL = """CASE type WHEN 'integer' THEN value_type IN ('int', 'int64', 'int32')
 WHEN 'number' THEN value_type IN ('float', 'float64', 'int', 'int64')
 WHEN 'boolean' THEN value_type IN ('bool') END"""


def _value_match_sql(source: str) -> str:
    declared = ", ".join(f"('{c}', '{t}')" for c, t in _DECLARED)
    return f"""WITH {DIRTY_SQL}, declared("column", type) AS (VALUES {declared}),
t AS (SELECT "column", value_type, count(*) AS n FROM {source} GROUP BY "column", value_type)
SELECT "column", type, string_agg(value_type, ', ' ORDER BY value_type) AS actual_types,
  CAST(sum(CASE WHEN {_ACCEPTED_SQL} THEN n ELSE 0 END) AS BIGINT) AS matched,
  CAST(sum(n) AS BIGINT) AS cells,
  sum(CASE WHEN {_ACCEPTED_SQL} THEN n ELSE 0 END) > 0 AS ok
FROM t JOIN declared USING ("column") GROUP BY "column", type"""


def _declared(spark):
    return local_table(spark, _DECLARED, "column string, type string")


@query("value_type_match", _value_match_sql("cells"))
def value_type_match(spark, sf_dir):
    return schema_match.value_type_match(_tally(spark, sf_dir), _declared(spark))


_TEXTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
          "l_returnflag", "l_linestatus", "l_shipdate"]


@query("infer_fields_from_values", f"""WITH cells AS (
{" UNION ALL ".join(f'''SELECT '{c}' AS "column", {TYPE_SQL.format(v=f"CAST({c} AS VARCHAR)")} AS value_type
FROM lineitem''' for c in _TEXTS)}),
kinds AS (SELECT "column", CASE WHEN min(value_type) = max(value_type) THEN CASE min(value_type)
   WHEN 'int' THEN 'integer' WHEN 'float' THEN 'number' WHEN 'bool' THEN 'boolean'
   WHEN 'date' THEN 'date' WHEN 'datetime' THEN 'datetime' ELSE 'string' END
  WHEN bool_and(value_type IN ('int', 'float')) THEN 'number' ELSE 'string' END AS field_type
FROM cells GROUP BY "column")
SELECT "column", field_type, field_type IN ('number', 'integer') AS is_numeric FROM kinds""")
def infer_fields_from_values(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row"), *[F.col(c).cast("string").alias(c) for c in _TEXTS])
    tally = consistency.type_tally(consistency.typed_cells(raw, "row", _TEXTS))
    return schema_match.infer_fields_from_values(tally)
