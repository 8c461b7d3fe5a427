"""Queries over names, identifiers and search queries."""

from pyspark.sql import functions as F

from packwright import functions as P
from workload.registry import query, table

VOCABULARY = "https://vocab.example.org"

_RAW_SQL = "'.' || p_name || '! ' || p_brand || '.'"
_CLEAN_SQL = ("coalesce(nullif(trim(regexp_replace(replace(lower({n}), ' ', '_'), "
              "'[^a-z0-9\\-_.]', '', 'g'), '.'), ''), 'resource')")


def _raw():
    return F.concat(F.lit("."), "p_name", F.lit("! "), "p_brand", F.lit("."))


@query("sanitize_name", f"SELECT p_partkey, {_CLEAN_SQL.format(n=_RAW_SQL)} AS name FROM part")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.sanitize_name(_raw()).alias("name"))


_CHOSEN_SQL = (f"CASE WHEN p_partkey % 3 = 0 THEN {_RAW_SQL} WHEN p_partkey % 3 = 1 "
               "THEN replace(p_name, ' ', '-') WHEN p_partkey % 2 = 0 THEN '' END")


@query("validate_name", f"""WITH n AS (SELECT p_partkey, {_CHOSEN_SQL} AS name FROM part),
c AS (SELECT *, coalesce(regexp_full_match(name, '[a-z0-9\\-_.]+'), false) AS ok,
  {_CLEAN_SQL.format(n='name')} AS clean FROM n)
SELECT p_partkey, ok AS is_valid, coalesce(name, '') AS name,
  CASE WHEN NOT ok THEN clean END AS suggestion,
  CASE WHEN ok THEN name ELSE clean END AS fixed FROM c""")
def validate_name(spark, sf_dir):
    p = F.col("p_partkey")
    name = F.when(p % 3 == 0, _raw()).when(p % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("-"))
                                           ).when(p % 2 == 0, "")
    named = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    return named.select("p_partkey", P.check_resource_name(F.col("n")).alias("v"),
                        P.check_resource_name(F.col("n"), auto_fix=True)["name"].alias("fixed")
                        ).select("p_partkey", "v.*", "fixed")


_QUERY_SQL = ("trim(regexp_replace(regexp_replace({q}, '[^\\pL\\pN_\\s\\-.]', ' ', 'g'), "
              "'\\s+', ' ', 'g'))")


@query("clean_query", f"""
SELECT 'page' AS kind, page_id AS id, {_QUERY_SQL.format(q='url')} AS query FROM pages
UNION ALL SELECT 'document', doc_id, {_QUERY_SQL.format(q='text')} FROM documents""")
def clean_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        P.clean_query(F.col("url")).alias("query"))
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        P.clean_query(F.col("text")).alias("query"))
    return pages.unionByName(docs)


@query("first_word", """
SELECT 'part' AS kind, p_partkey AS id, split_part(p_name, ' ', 1) AS word FROM part
UNION ALL SELECT 'turn', conv_id * 1000 + turn, split_part(text, ' ', 1) FROM conversations""")
def first_word(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
        P.first_word(F.col("p_name")).alias("word"))
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        P.first_word(F.col("text")).alias("word"))
    return parts.unionByName(turns)


@query("concept_web_url", f"""
SELECT page_id, '{VOCABULARY}/web/concept/' || url_encode(url) AS web_url FROM pages""")
def concept_web_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", P.concept_web_url(F.col("url"), VOCABULARY).alias("web_url"))


@query("concept_scheme", """WITH s AS (SELECT page_id, url, string_split(url, '/') AS p FROM pages)
SELECT page_id, CASE WHEN len(p) >= 5 AND p[3] LIKE '%.com' THEN array_to_string(p[1:4], '/') || '/'
  WHEN len(p) >= 3 THEN array_to_string(p[1:3], '/') || '/' ELSE url END AS scheme FROM s""")
def concept_scheme(spark, sf_dir):
    # The pages of .com hosts play the part of the vocabulary.
    own = F.get(F.split("url", "/"), F.lit(2))
    host = F.when(own.endswith(".com"), own).otherwise("")
    return table(spark, sf_dir, "pages").select(
        "page_id", P.concept_scheme(F.col("url"), host).alias("scheme"))


@query("iri_tail", "SELECT page_id, string_split(url, '/')[-1] AS tail FROM pages")
def iri_tail(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.iri_tail(F.col("url")).alias("tail"))


_FILE_SQL = """f AS (SELECT doc_id, source, lang, 'in/' || source || '.' || lang || '.csv' AS file,
  'Sheet ' || lang AS sheet, source || '.' || lang AS stem FROM documents)"""


@query("dataset_name", f"""WITH {_FILE_SQL}
SELECT doc_id, stem || '_' || replace(sheet, ' ', '_') AS dataset_name,
  {_CLEAN_SQL.format(n="stem || '_' || sheet")} AS resource,
  {_CLEAN_SQL.format(n="stem || '_' || sheet")} || '.parquet' AS path FROM f""")
def dataset_name(spark, sf_dir):
    file = F.concat(F.lit("in/"), "source", F.lit("."), "lang", F.lit(".csv"))
    sheet = F.concat(F.lit("Sheet "), "lang")
    docs = table(spark, sf_dir, "documents").select("doc_id", file.alias("f"), sheet.alias("s"))
    return docs.select(
        "doc_id", P.dataset_name(F.col("f"), F.col("s")).alias("dataset_name"),
        P.resource_path(F.col("f"), F.col("s")).alias("r"),
    ).select("doc_id", "dataset_name", F.col("r.name").alias("resource"), "r.path")


@query("query_check", """WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN upper(lang)
  WHEN doc_id % 5 = 1 THEN 'xx' WHEN doc_id % 5 = 2 THEN 'eng' ELSE lang END AS language FROM documents),
r AS (SELECT *, CASE WHEN length(text) < 1 THEN 'Query is too short'
  WHEN length(text) > 500 THEN 'Query is too long'
  WHEN regexp_full_match(text, '\\s*') THEN 'Query cannot be empty or only whitespace'
  WHEN length(language) <> 2 THEN 'Language must have two letters'
  WHEN lower(language) NOT IN ('en', 'de', 'es', 'fr', 'pt', 'it', 'da') THEN 'Language is not supported'
  ELSE '' END AS message FROM q)
SELECT doc_id, message = '' AS ok, message, lower(language) AS language FROM r""")
def query_check(spark, sf_dir):
    i = F.col("doc_id") % 5
    language = F.when(i == 0, F.upper("lang")).when(i == 1, "xx").when(i == 2, "eng").otherwise(
        F.col("lang"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", language.alias("language"))
    return docs.select("doc_id", P.query_check(F.col("text"), F.col("language")).alias("v")).select(
        "doc_id", "v.ok", "v.message", "v.language")


@query("config_filename", """WITH f AS (SELECT p_partkey,
  CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '-') END AS package,
  CASE WHEN p_partkey % 5 <> 0 THEN 'in/' || p_brand || '.xlsx' END AS file,
  CASE WHEN p_partkey % 2 = 0 THEN 'Sheet ' || p_size END AS sheet FROM part)
SELECT p_partkey, CASE WHEN package IS NOT NULL THEN package
  WHEN file IS NOT NULL THEN regexp_extract(file, 'in/(.*)\\.xlsx', 1)
    || CASE WHEN sheet IS NOT NULL THEN '_' || replace(sheet, ' ', '_') ELSE '' END
  ELSE 'config' END || '_mapping_config.json' AS file_name FROM f""")
def config_filename(spark, sf_dir):
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", P.config_filename(
        F.lit("mapping"),
        F.when(p % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))),
        F.when(p % 5 != 0, F.concat(F.lit("in/"), "p_brand", F.lit(".xlsx"))),
        F.when(p % 2 == 0, F.concat(F.lit("Sheet "), F.col("p_size").cast("string"))),
    ).alias("file_name"))
