"""Queries over names that are not spelt as their concepts are."""

from pyspark.sql import functions as F

from packwright.operators import spelling
from workload.registry import query, table

# A letter is left out, replaced or doubled, or two are left out, by key.
_MISSPELT_SQL = """labels AS (SELECT DISTINCT p_type || ' ' || p_name || ' ' || p_brand AS label FROM part),
spelt AS (SELECT p_type || ' ' || p_name || ' ' || p_brand AS s, p_partkey AS k,
  CAST(1 + p_partkey % length(p_type || ' ' || p_name) AS INTEGER) AS i FROM part),
misspelt AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN left(s, i - 1) || substr(s, i + 1)
  WHEN 1 THEN left(s, i - 1) || 'q' || substr(s, i + 1) WHEN 2 THEN left(s, i) || substr(s, i)
  ELSE substr(left(s, i - 1) || substr(s, i + 1), 2) END AS "column" FROM spelt),
cleaned AS (SELECT "column", lower(trim(regexp_replace("column", '[^A-Za-z0-9_.-]+', ' ', 'g'))) AS a FROM misspelt),
known AS (SELECT label, lower(trim(regexp_replace(label, '[^A-Za-z0-9_.-]+', ' ', 'g'))) AS b FROM labels),
near AS (SELECT "column", 'c/' || label AS id, label, CAST(levenshtein(a, b) AS INTEGER) AS distance
  FROM cleaned JOIN known ON abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2)"""


@query("suggest_similar", f"""WITH {_MISSPELT_SQL}
SELECT "column", CAST(ordinal AS INTEGER) AS ordinal, id, label, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY distance, label, id) AS ordinal FROM near)
WHERE ordinal <= 5""")
def suggest_similar(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    s = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    concepts = part.select(F.concat(F.lit("c/"), s).alias("id"), s.alias("label"), F.lit("en").alias("lang"))
    spelt = part.select(s.alias("s"), F.col("p_partkey").alias("k"),
                        (1 + F.col("p_partkey") % F.length(F.concat_ws(" ", "p_type", "p_name"))).cast("int").alias("i"))
    head, rest, way = F.substring("s", F.lit(1), F.col("i") - 1), F.substring("s", F.col("i") + 1, F.length("s")), F.col("k") % 4
    misspelt = spelt.select(
        F.when(way == 0, F.concat(head, rest)).when(way == 1, F.concat(head, F.lit("q"), rest))
        .when(way == 2, F.concat(F.substring("s", F.lit(1), F.col("i")), F.substring("s", F.col("i"), F.length("s"))))
        .otherwise(F.substring(F.concat(head, rest), F.lit(2), F.length("s"))).alias("name"))
    return spelling.suggest_similar(misspelt, concepts, "name", "en")
