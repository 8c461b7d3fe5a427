"""Bad records of CSV files: lines made of all events, some of them broken."""

from pyspark.sql import functions as F

from packwright.session import shared_dir
from packwright.sources import read_csv_records
from workload.registry import query, table

_SCHEMA = "event_id long, user_id long, event_type string, value double, day date"
_BROKEN_SQL = """b AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 101 = 0 THEN 'few' WHEN event_id % 103 = 0 THEN 'many' WHEN event_id % 107 = 0 THEN 'word'
    WHEN event_id % 109 = 0 THEN 'two' ELSE 'good' END AS how FROM events)"""


def _written(spark, sf_dir):
    """All events as CSV, one file a task; lines are broken by the key of the event."""
    key = F.col("event_id")
    how = (F.when(key % 101 == 0, "few").when(key % 103 == 0, "many").when(key % 107 == 0, "word").when(key % 109 == 0, "two").otherwise("good"))
    text = lambda c: F.col(c).cast("string")
    user = F.when(how == "word", F.concat(F.lit("u-"), text("user_id"))).otherwise(text("user_id"))
    kind = F.concat(F.lit('"'), "event_type", F.lit(', quoted"'))
    value = F.when(how == "two", "n/a").otherwise(text("value"))
    day = F.when(how == "two", "yesterday").otherwise(F.col("ts").cast("date").cast("string"))
    line = F.concat_ws(",", key.cast("string"), user, kind, value, F.when(how != "few", day), F.when(how == "many", "extra"))
    path = shared_dir(spark)
    table(spark, sf_dir, "events").repartition(4, "event_id").select(line).write.text(path)
    return read_csv_records(spark, path, _SCHEMA, header=False)


@query("csv_bad_records", f"""WITH {_BROKEN_SQL}
SELECT event_id, 'too_few_fields' AS kind, CAST(NULL AS VARCHAR) AS "column", '4' AS value FROM b WHERE how = 'few'
UNION ALL SELECT event_id, 'too_many_fields', NULL, '6' FROM b WHERE how = 'many'
UNION ALL SELECT event_id, 'bad_value', 'user_id', 'u-' || user_id FROM b WHERE how = 'word'
UNION ALL SELECT event_id, 'bad_value', 'value', 'n/a' FROM b WHERE how = 'two'
UNION ALL SELECT event_id, 'bad_value', 'day', 'yesterday' FROM b WHERE how = 'two'""")
def csv_bad_records(spark, sf_dir):
    return _written(spark, sf_dir).bad.select(
        F.substring_index("text", ",", 1).cast("long").alias("event_id"), "kind", "column", "value")


@query("csv_good_rows", f"""WITH {_BROKEN_SQL}
SELECT event_id, user_id, event_type || ', quoted' AS event_type, value, day FROM b WHERE how = 'good'""")
def csv_good_rows(spark, sf_dir):
    return _written(spark, sf_dir).good


@query("csv_record_findings", f"""WITH {_BROKEN_SQL}, n AS (SELECT count(*) AS all_, count(*) FILTER (how = 'few') AS few,
  count(*) FILTER (how = 'many') AS many, count(*) FILTER (how IN ('word', 'two')) AS bad FROM b),
l AS (SELECT 'csv_too_few_fields' AS "check", few AS k, ' records: too few fields' AS what, * FROM n
  UNION ALL SELECT 'csv_too_many_fields', many, ' records: too many fields', * FROM n
  UNION ALL SELECT 'csv_bad_value', bad, ' records: bad value', * FROM n)
SELECT 'events' AS dataset, 'data_quality' AS scope, CAST(NULL AS VARCHAR) AS subject, "check",
  CASE WHEN few + many + bad > 0.05 * all_ THEN 'error' ELSE 'warning' END AS severity, k || ' of ' || all_ || what AS message
FROM l WHERE k > 0""")
def csv_record_findings(spark, sf_dir):
    return _written(spark, sf_dir).findings("events", 0.05)
