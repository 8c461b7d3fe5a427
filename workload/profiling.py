"""Queries over shape, missing values, duplicates, samples and outliers."""

from pyspark.sql import functions as F

from packwright.operators import consistency, duplicates, outliers, profile
from packwright.plans.validate import union_all
from workload.registry import query, table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
COLUMN_COUNTS = [2, 3, 5, 4, 6, 6, 11, 6, 5, 3, 3, 2, 3, 4]

LABELLED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
LABELLED_SQL = ("labelled AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def labelled(spark, sf_dir):
    """Documents with their labels; most have none."""
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        *LABELLED)


def _null_sql(extra: str = "") -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls "
        "FROM labelled" for i, c in enumerate(LABELLED))
    return (f"WITH {LABELLED_SQL}, prof AS (SELECT pos, \"column\", rows, nulls, "
            "CASE WHEN rows > 0 THEN CAST(nulls AS DOUBLE) / CAST(rows AS DOUBLE) "
            f"ELSE CAST(0 AS DOUBLE) END AS null_fraction FROM ({parts})) ")


@query("null_profile", _null_sql() + "SELECT * FROM prof")
def null_profile(spark, sf_dir):
    return profile.null_profile(labelled(spark, sf_dir))


@query("null_severity", _null_sql() + """
SELECT "column", nulls, CASE WHEN null_fraction > 0.5 THEN 'critical'
  WHEN null_fraction > 0.2 THEN 'high' ELSE 'present' END AS tier
FROM prof WHERE nulls > 0""")
def null_severity(spark, sf_dir):
    found = profile.null_severity(profile.null_profile(labelled(spark, sf_dir)))
    return found.select("column", "nulls", "tier")


@query("table_shape", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS rows, {n} AS columns FROM {t}"
    for t, n in zip(TABLES, COLUMN_COUNTS)))
def table_shape(spark, sf_dir):
    return union_all([profile.table_shape(table(spark, sf_dir, t), t) for t in TABLES])


@query("nonempty_cells", f"""WITH {LABELLED_SQL}
SELECT CAST({' + '.join(f'count({c})' for c in LABELLED)} AS BIGINT) AS nonempty_cells
FROM labelled""")
def nonempty_cells(spark, sf_dir):
    return profile.nonempty_cells(profile.null_profile(labelled(spark, sf_dir)))


_DUPLICATES = [
    ("part", ["p_name", "p_brand", "p_type", "p_size"]),
    ("lineitem", ["l_orderkey", "l_linenumber"]),
    ("documents", ["text"]),
]


@query("duplicate_profile", " UNION ALL ".join(f"""
SELECT '{t}' AS dataset, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows,
  CAST(sum(n - 1) AS BIGINT) AS duplicates,
  CAST(sum(n - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS duplicate_fraction,
  CAST(sum(n - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE) > 0.05 AS exceeds
FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(c)})""" for t, c in _DUPLICATES))
def duplicate_profile(spark, sf_dir):
    return union_all([
        duplicates.duplicate_profile(table(spark, sf_dir, t), c).withColumn("dataset", F.lit(t))
        for t, c in _DUPLICATES
    ])


_WHOLE = ["part", "lineitem", "documents", "labels"]


@query("duplicate_rows", " UNION ALL ".join(f"""
SELECT '{t}' AS dataset, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows,
  CAST(sum(n - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM (SELECT {t} AS r FROM {t}) GROUP BY r)""" for t in _WHOLE))
def duplicate_rows(spark, sf_dir):
    """Repeated rows of whole tables."""
    return union_all([
        duplicates.duplicate_profile(table(spark, sf_dir, t)).withColumn("dataset", F.lit(t)) for t in _WHOLE
    ]).select("dataset", "rows", "distinct_rows", "duplicates")


@query("flag_duplicates", """
SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
FROM documents""")
def flag_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return duplicates.flag_duplicates(docs, "doc_id", ["text"]).select("doc_id", "is_duplicate")


_SAMPLED = {"c_name": "c_name", "c_nationkey": "c_nationkey", "c_mktsegment": "c_mktsegment",
            "c_acctbal": "CAST(c_acctbal AS DECIMAL(15, 2))"}


def customers(spark, sf_dir):
    """Customers with the balance as a decimal, which reads alike everywhere."""
    return table(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))


@query("column_samples", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS "column",
  CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS ordinal,
  c_custkey AS row_id, CAST({v} AS VARCHAR) AS value
FROM customer WHERE {c} IS NOT NULL) WHERE ordinal <= 10""" for c, v in _SAMPLED.items()))
def column_samples(spark, sf_dir):
    return profile.column_samples(customers(spark, sf_dir), "c_custkey", list(_SAMPLED))


def _fence_sql(tab: str, value: str, by: str) -> str:
    return f"""fence AS (SELECT {by}, n, q1, q3, q1 - CAST(3.0 AS DOUBLE) * (q3 - q1) AS low,
  q3 + CAST(3.0 AS DOUBLE) * (q3 - q1) AS high
FROM (SELECT {by}, count(*) AS n, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q1,
  quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q3 FROM {tab} GROUP BY {by}))"""


@query("iqr_outliers", f"""WITH {_fence_sql('events', 'value', 'event_type')}
SELECT event_id, event_type, value FROM events JOIN fence USING (event_type)
WHERE value < low OR value > high""")
def iqr_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return outliers.iqr_outliers(events, "value", "event_type").select(
        "event_id", "event_type", "value")


@query("outlier_profile", f"""WITH {_fence_sql('documents', 'n_chars', 'lang')}
SELECT lang, max(fence.n) AS n, round(max(q1), 6) AS q1, round(max(q3), 6) AS q3,
  round(max(low), 6) AS low, round(max(high), 6) AS high,
  count(CASE WHEN n_chars < low OR n_chars > high THEN 1 END) AS outliers
FROM documents JOIN fence USING (lang) GROUP BY lang""")
def outlier_profile(spark, sf_dir):
    found = outliers.outlier_profile(table(spark, sf_dir, "documents"), "n_chars", "lang")
    return found.select("lang", "n", "outliers",
                        *[F.round(c, 6).alias(c) for c in ("q1", "q3", "low", "high")])


@query("quality_info", _null_sql() + """
SELECT 'documents' AS dataset, 'nulls' AS "check", "column" AS subject, 'info' AS severity,
  'Column ''' || "column" || ''' has ' || printf('%.1f', null_fraction * 100) || '% missing values'
  || CASE WHEN null_fraction > 0.2 THEN ' (exceeds recommended max: 20.0%)' ELSE '' END AS message
FROM prof WHERE nulls > 0
UNION ALL SELECT 'documents', 'shape', NULL, 'info',
  'Dataset has ' || count(*) || ' rows and 7 columns' FROM labelled
UNION ALL SELECT dataset, 'duplicates', NULL, 'info', d || CASE WHEN d > 0.05 * n
  THEN ' duplicate rows (' || share || '%) exceeds recommended threshold (5.0%)'
  ELSE ' duplicate rows found (' || share || '%)' END
FROM (SELECT *, printf('%.1f', floor(1000.0 * d / n + 0.5) / 10) AS share FROM (
  SELECT 'documents' AS dataset, CAST(sum(k - 1) AS BIGINT) AS d, sum(k) AS n FROM (
    SELECT count(*) AS k FROM labelled GROUP BY doc_id, text, lang, source, n_chars, quality, toxic)
  UNION ALL SELECT 'texts', CAST(sum(k - 1) AS BIGINT), sum(k) FROM (
    SELECT count(*) AS k FROM documents GROUP BY text, lang)
  UNION ALL SELECT 'events', CAST(sum(k - 1) AS BIGINT), sum(k) FROM (
    SELECT count(*) AS k FROM events GROUP BY user_id, event_type))) WHERE d > 0
UNION ALL SELECT 'texts', 'shape', NULL, 'info', 'Dataset has ' || count(*) || ' rows and 2 columns' FROM documents
UNION ALL SELECT 'events', 'shape', NULL, 'info', 'Dataset has ' || count(*) || ' rows and 2 columns' FROM events
UNION ALL SELECT 'events', 'inconsistencies', NULL, 'info', 'Found ' || n || ' type inconsistencies' FROM (
  SELECT count(*) - max(k) AS n, count(*) AS total FROM (SELECT count(*) OVER (PARTITION BY event_id % 10 = 0) AS k FROM events)) WHERE n > 0""")
def quality_info(spark, sf_dir):
    tables = {"documents": labelled(spark, sf_dir),
              "texts": table(spark, sf_dir, "documents").select("text", "lang"),
              "events": table(spark, sf_dir, "events").select("user_id", "event_type")}
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("code"))
    mixed = consistency.mixed_type_columns(consistency.type_tally(
        consistency.typed_cells(raw, "event_id", ["code"]))).withColumn("dataset", F.lit("events"))
    named = lambda f: union_all([f(df).withColumn("dataset", F.lit(k)) for k, df in tables.items()])
    return profile.quality_info(named(profile.null_profile), named(duplicates.duplicate_profile), mixed)
