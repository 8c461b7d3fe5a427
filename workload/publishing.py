"""Write, audit, publish: one package that passes its gate and one that does not."""

from pyspark.sql import functions as F

from packwright.operators.constraints import Constraint
from packwright.plans import Dataset, publish
from packwright.session import shared_dir
from packwright.sources import make_dir
from workload.consistency import dirty
from workload.packages import _described, _fields
from workload.registry import query, table


def _folder(spark):
    path = shared_dir(spark)
    make_dir(path)
    return path


@query("publish_package", """SELECT o.*, 'strict' AS level, (SELECT count(*) FROM orders) AS audited FROM orders o""")
def published(spark, sf_dir):
    """Orders pass; what is read is what was published, with the rows counted as they were written."""
    orders, path = table(spark, sf_dir, "orders"), _folder(spark)
    done = publish(Dataset("orders", orders, _described("orders", _fields(orders)), constraints=(
        Constraint("o_orderkey", required=True),)), path + "/orders", path + "/findings")
    assert done.published
    return spark.read.parquet(done.path).withColumns({"level": F.lit(done.level), "audited": F.lit(done.rows).cast("long")})


@query("publish_refused", """WITH e AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'str' WHEN event_id % 41 = 0 THEN 'bool'
    WHEN event_id % 89 = 0 THEN NULL ELSE 'int' END AS kind FROM events),
n AS (SELECT count(*) AS all_, count(*) FILTER (value > 50) AS high, count(*) FILTER (kind IS NULL) AS nulls,
  count(DISTINCT kind) AS kinds, count(kind) - max(c) AS odd
  FROM e, (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM e WHERE kind IS NOT NULL GROUP BY kind))),
t AS (SELECT string_agg(kind, ', ' ORDER BY first) AS types FROM (SELECT kind, min(event_id) AS first FROM e WHERE kind IS NOT NULL GROUP BY kind)),
f AS (
  SELECT 'constraints' AS scope, 'value' AS subject, 'constraint_maximum' AS "check", 'error' AS severity,
    'Column ''value'' breaks its maximum constraint in ' || high || ' of ' || all_ || ' rows' AS message FROM n WHERE high > 0
  UNION ALL SELECT 'type_consistency', 'code', 'mixed_types', 'error',
    'Column ''code'' has mixed types: ' || types || ' (' || odd || ' inconsistent values tracked)' FROM n, t WHERE kinds > 1
  UNION ALL SELECT 'data_quality', NULL, 'inconsistencies', 'info', 'Found ' || odd || ' type inconsistencies' FROM n WHERE odd > 0
  UNION ALL SELECT 'data_quality', 'code', 'nulls', 'info', 'Column ''code'' has ' ||
    printf('%.1f', floor(nulls * 1000.0 / all_ + 0.5) / 10) || '% missing values' FROM n WHERE nulls > 0
  UNION ALL SELECT 'data_quality', NULL, 'shape', 'info', 'Dataset has ' || all_ || ' rows and 4 columns' FROM n)
SELECT 'events' AS dataset, f.*, CASE WHEN count(*) FILTER (severity = 'error') OVER () = 0 THEN 'strict' ELSE 'basic' END AS level,
  false AS published, false AS data_there FROM f""")
def refused(spark, sf_dir):
    """Events are refused: their findings are there as a table, their data is not."""
    events, path = dirty(spark, sf_dir).select("event_id", "event_type", "value", "code"), _folder(spark)
    done = publish(Dataset("events", events, _described("events", _fields(events, code="integer")), row_id="event_id",
                           raw_columns=("code",), constraints=(Constraint("value", maximum=50),)), path + "/events", path + "/findings")
    there = spark._jvm.org.apache.hadoop.fs.Path(done.path)
    there = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return spark.read.parquet(path + "/findings").withColumn("data_there", F.lit(there)).select(*done.findings.columns, "data_there")
