"""Queries over tables that grow by files."""

from pyspark.sql import functions as F

from packwright.plans.growing import append_states, growing_profile
from packwright.session import shared_dir
from workload.registry import query, table

# Column and how its ends are kept: as numbers, as text or not at all.
_COLUMNS = [("event_id", "number"), ("ts", None), ("user_id", "number"), ("event_type", "text"), ("value", "number"),
            ("props", "text")]


def _column_sql(pos, name, kind):
    missing = f"{name} IS NULL" + (f" OR isnan({name})" if name == "value" else "")
    number = f"CAST({{}}({name}) AS DOUBLE)" if kind == "number" else "CAST(NULL AS DOUBLE)"
    text = f"{{}}({name})" if kind == "text" else "CAST(NULL AS VARCHAR)"
    return f"""SELECT CAST({pos} AS INTEGER) AS pos, '{name}' AS "column", count(*) AS rows,
  count(CASE WHEN {missing} THEN 1 END) AS nulls, {number.format('min')} AS least, {number.format('max')} AS greatest,
  {text.format('min')} AS first_text, {text.format('max')} AS last_text, true AS distinct_near FROM events"""


@query("growing_profile", " UNION ALL ".join(_column_sql(pos, *c) for pos, c in enumerate(_COLUMNS)))
def profile_of_appends(spark, sf_dir):
    """The table arrives in three parts; after each the states of the new files alone are added."""
    folder = shared_dir(spark)
    data, store = folder + "/data", folder + "/states"
    events = table(spark, sf_dir, "events")
    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(data)
        append_states(spark, data, store)
    found = growing_profile(spark, data, store)
    # Estimates are held against the exact number: five standard errors of 1.6 %.
    exact = events.agg(*[F.count_distinct(F.col(c)).alias(c) for c, _ in _COLUMNS]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c, _ in _COLUMNS])))
    near = F.abs(F.col("distinct_estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.08)
    return found.join(exact, "column").select(
        "pos", "column", "rows", "nulls", "least", "greatest", "first_text", "last_text", near.alias("distinct_near"))
