"""Queries joining columns with concepts, units and descriptions."""

from pyspark.sql import functions as F

from packwright.operators import profile, vocab
from packwright.plans.report import information_lines, mapping_lines
from packwright.session import local_table
from workload.profiling import customers
from workload.registry import query, table
from workload.schema import _COLUMNS_SQL, part_columns

# Every part's table maps some of its columns.
_MAPPED_SQL = """maps AS (
  SELECT p_partkey AS dataset, 'id' AS name, 'http://v/id' AS iri FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 'price', 'http://v/price/' || p_size FROM part
  UNION ALL SELECT p_partkey, 'price_unit', 'http://v/unit/EUR' FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 'size_unit', 'http://v/unit/' || p_brand FROM part WHERE p_partkey % 3 = 0),
mapped AS (SELECT c.*, m.iri AS concept_id, u.iri AS unit_id, c.field_type IN ('integer', 'number') AS is_numeric
  FROM cols c LEFT JOIN maps m ON m.dataset = c.dataset AND m.name = c."column"
  LEFT JOIN maps u ON u.dataset = c.dataset AND u.name = c."column" || '_unit')"""
_DESCRIBED_SQL = """descr AS (
  SELECT p_partkey AS dataset, 'name' AS "column", p_name AS description FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT p_partkey, 'flag', '' FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT p_partkey, lower(p_type), p_type FROM part WHERE p_partkey % 3 = 1)"""


def part_mappings(spark, sf_dir):
    p = F.col("p_partkey")

    def entry(name, iri, when=F.lit(True)):
        return F.when(when, F.struct(F.lit(name).alias("name"), iri.alias("iri")))

    rows = F.array_compact(F.array(
        entry("id", F.lit("http://v/id"), p % 2 == 0),
        entry("price", F.concat(F.lit("http://v/price/"), F.col("p_size").cast("string"))),
        entry("price_unit", F.lit("http://v/unit/EUR"), p % 5 != 0),
        entry("size_unit", F.concat(F.lit("http://v/unit/"), "p_brand"), p % 3 == 0),
    ))
    return table(spark, sf_dir, "part").select(p.alias("dataset"), F.inline(rows))


def part_descriptions(spark, sf_dir):
    p = F.col("p_partkey")

    def entry(column, text, when):
        column = F.lit(column) if isinstance(column, str) else column
        return F.when(when, F.struct(column.alias("column"), text.alias("description")))

    rows = F.array_compact(F.array(
        entry("name", F.col("p_name"), p % 2 == 1), entry("flag", F.lit(""), p % 2 == 1),
        entry(F.lower("p_type"), F.col("p_type"), p % 3 == 1),
    ))
    return table(spark, sf_dir, "part").select(p.alias("dataset"), F.inline(rows))


def _mapped(spark, sf_dir):
    return vocab.apply_mappings(part_columns(spark, sf_dir), part_mappings(spark, sf_dir))


@query("apply_mappings", f"""WITH {_COLUMNS_SQL}, {_MAPPED_SQL}
SELECT dataset, pos, "column", concept_id, unit_id FROM mapped""")
def apply_mappings(spark, sf_dir):
    return _mapped(spark, sf_dir).select("dataset", "pos", "column", "concept_id", "unit_id")


@query("mapping_report", f"""WITH {_COLUMNS_SQL}, {_MAPPED_SQL},
n AS (SELECT dataset, count(*) AS columns, count(concept_id) AS mapped FROM mapped GROUP BY dataset)
SELECT dataset, 5 AS section, CAST(pos + 1 AS BIGINT) AS number, '- ' || "column" || ': '
  || coalesce(concept_id, 'Not mapped') || coalesce(' (unit: ' || unit_id || ')', '') AS line FROM mapped
UNION ALL SELECT dataset, 4, 0, 'DATASET INFORMATION' FROM n
UNION ALL SELECT dataset, 4, 1, 'Rows: ' || p_size FROM n JOIN part ON p_partkey = dataset
UNION ALL SELECT dataset, 4, 2, 'Columns: ' || columns FROM n
UNION ALL SELECT dataset, 4, 3, 'Columns mapped: ' || mapped FROM n""")
def mapping_report(spark, sf_dir):
    mapped = _mapped(spark, sf_dir)
    tables = mapped.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"), F.count("concept_id").alias("mapped")
    ).join(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dataset"), F.col("p_size").alias("rows")), "dataset")
    return mapping_lines(mapped).unionByName(information_lines(tables))


@query("build_fields", f"""WITH {_COLUMNS_SQL}, {_MAPPED_SQL}, {_DESCRIBED_SQL},
labels AS (SELECT DISTINCT 'http://v/unit/' || p_brand AS id, 'unit of ' || p_brand AS label FROM part
  WHERE CAST(right(p_brand, 1) AS INTEGER) % 2 = 1)
SELECT m.dataset, m.pos, m."column" AS name, m.field_type AS type,
  coalesce(d.description, 'Column from Sheet 1') AS description,
  CASE WHEN is_numeric THEN coalesce(l.label, string_split(m.unit_id, '/')[-1], 'NUM') END AS unit_name,
  CASE WHEN is_numeric AND m.unit_id IS NULL THEN 'dimensionless number' WHEN is_numeric THEN l.label END
    AS unit_long_name,
  CASE WHEN is_numeric THEN coalesce(m.unit_id, 'http://qudt.org/vocab/unit/NUM') END AS unit_path,
  m.concept_id AS rdf_type, m.concept_id AS taxonomy_url
FROM mapped m LEFT JOIN descr d ON d.dataset = m.dataset AND d."column" = m."column"
LEFT JOIN labels l ON l.id = m.unit_id""")
def build_fields(spark, sf_dir):
    labels = table(spark, sf_dir, "part").where(F.right("p_brand", F.lit(1)).cast("int") % 2 == 1).select(
        F.concat(F.lit("http://v/unit/"), "p_brand").alias("id"),
        F.concat(F.lit("unit of "), "p_brand").alias("label")).distinct()
    return vocab.build_fields(_mapped(spark, sf_dir), labels, part_descriptions(spark, sf_dir),
                              "Sheet 1")


@query("mapping_completeness", f"""WITH {_COLUMNS_SQL}, {_MAPPED_SQL}, {_DESCRIBED_SQL}
SELECT m.dataset, m."column", 'missing_info' AS problem FROM mapped m
WHERE concept_id IS NULL AND NOT EXISTS (SELECT 1 FROM descr d
  WHERE d.dataset = m.dataset AND d."column" = m."column" AND d.description <> '')
UNION ALL SELECT dataset, "column", 'missing_unit' FROM mapped WHERE is_numeric AND unit_id IS NULL""")
def mapping_completeness(spark, sf_dir):
    return vocab.mapping_completeness(_mapped(spark, sf_dir), part_descriptions(spark, sf_dir))


@query("field_templates", f"""WITH {_COLUMNS_SQL},
t("column", type, unit_path, is_required) AS (VALUES
 ('id', 'integer', 'http://qudt.org/vocab/unit/NUM', true), ('name', 'string', NULL, true),
 ('latitude', 'number', 'http://qudt.org/vocab/unit/DEG', NULL),
 ('longitude', 'number', 'http://qudt.org/vocab/unit/DEG', NULL))
SELECT dataset, cols."column", type, unit_path, is_required
FROM cols LEFT JOIN t ON t."column" = cols."column" """)
def field_templates(spark, sf_dir):
    return vocab.field_templates(part_columns(spark, sf_dir)).select(
        "dataset", "column", "type", "unit_path", F.col("required").alias("is_required"))


# ----------------------------------------------------------------- suggestions
_SUGGESTION_SQL = """s AS (SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN 'c/' || user_id WHEN 1 THEN '' ELSE NULL END AS id,
  CASE event_id % 5 WHEN 1 THEN 'u/' || user_id WHEN 2 THEN 'c/' || user_id END AS uri,
  CASE event_id % 5 WHEN 3 THEN 'x/' || user_id END AS concept_id,
  CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '' END AS label,
  CASE event_id % 3 WHEN 1 THEN 'name ' || event_type END AS name FROM events)"""


def _suggestions(spark, sf_dir):
    """Suggestions as JSON, whose id and label sit under varying keys."""
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    k, n = i % 5, i % 3
    json = F.to_json(F.struct(
        F.when(k == 0, F.concat(F.lit("c/"), user)).when(k == 1, "").alias("id"),
        F.when(k == 1, F.concat(F.lit("u/"), user)).when(k == 2, F.concat(F.lit("c/"), user))
        .alias("uri"),
        F.when(k == 3, F.concat(F.lit("x/"), user)).alias("concept_id"),
        F.when(n == 0, F.col("event_type")).when(n == 1, "").alias("label"),
        F.when(n == 1, F.concat(F.lit("name "), "event_type")).alias("name")))
    return table(spark, sf_dir, "events").select("event_id", "user_id", json.alias("suggestion"))


@query("normalize_suggestions", f"""WITH {_SUGGESTION_SQL}, n AS (SELECT event_id,
  coalesce(nullif(id, ''), nullif(uri, ''), nullif(concept_id, '')) AS id,
  coalesce(nullif(label, ''), nullif(name, '')) AS label FROM s)
SELECT * FROM n WHERE id IS NOT NULL AND label IS NOT NULL""")
def normalize_suggestions(spark, sf_dir):
    return _suggestions(spark, sf_dir).select(
        "event_id", vocab.normalize_suggestion(F.col("suggestion")).alias("s")).where(
        F.col("s").isNotNull()).select("event_id", "s.id", "s.label")


@query("label_lookup", f"""WITH {_SUGGESTION_SQL}, e AS (SELECT event_id,
  coalesce(nullif(id, ''), nullif(uri, '')) AS id,
  coalesce(nullif(label, ''), nullif(name, '')) AS label FROM s),
firsts AS (SELECT id, label FROM (SELECT *, row_number() OVER (
  PARTITION BY id ORDER BY event_id // 100, event_id) AS nth FROM e WHERE id IS NOT NULL) WHERE nth = 1),
w AS (SELECT DISTINCT 'c/' || user_id AS id FROM events)
SELECT w.id, label FROM w LEFT JOIN firsts USING (id)""")
def label_lookup(spark, sf_dir):
    cache = _suggestions(spark, sf_dir).select(
        F.floor(F.col("event_id") / 100).alias("cache_order"), F.col("event_id").alias("pos"),
        "suggestion")
    wanted = table(spark, sf_dir, "events").select(
        F.concat(F.lit("c/"), F.col("user_id").cast("string")).alias("id")).distinct()
    return vocab.label_lookup(wanted, cache)


_SUGGEST_SQL = """WITH concepts AS (
  SELECT DISTINCT 'p/' || p_name AS id, p_name AS label FROM part
  UNION SELECT DISTINCT 't/' || p_type, p_type FROM part
  UNION SELECT DISTINCT 'n/' || p_name || '/' || p_type, p_type || ' ' || p_name FROM part),
words AS (SELECT id, label, unnest(string_split(lower(label), ' ')) AS word FROM concepts),
asked AS (SELECT DISTINCT p_name AS "column", split_part(p_name, ' ', 1) AS word FROM part
  UNION SELECT DISTINCT {asked}, lower({word}) FROM part),
hits AS (SELECT a."column", w.id, w.label, max(CASE WHEN lower(w.label) = a.word THEN 3
  WHEN w.word = a.word THEN 2 ELSE 1 END) AS score
FROM asked a JOIN words w ON starts_with(w.word, a.word) GROUP BY ALL)
SELECT "column", CAST(ordinal AS INTEGER) AS ordinal, id, label, score FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY score DESC, label, id) AS ordinal FROM hits)
WHERE ordinal <= 5"""


def _suggested(spark, sf_dir, asked, min_letters):
    part = table(spark, sf_dir, "part")

    def concepts(id_, label):
        return part.select(id_.alias("id"), label.alias("label"), F.lit("en").alias("lang"))

    name, kind = F.col("p_name"), F.col("p_type")
    vocabulary = (
        concepts(F.concat(F.lit("p/"), name), name)
        .unionByName(concepts(F.concat(F.lit("t/"), kind), kind))
        .unionByName(concepts(F.concat(F.lit("n/"), name, F.lit("/"), kind),
                              F.concat(kind, F.lit(" "), name)))
        .distinct()
    )
    queries = part.select(name.alias("c")).union(part.select(asked(kind)))
    return vocab.suggest_concepts(queries, vocabulary, "c", "en", min_letters=min_letters)


@query("suggest_concepts", _SUGGEST_SQL.format(asked="p_type", word="split_part(p_type, ' ', 1)"))
def suggest_concepts(spark, sf_dir):
    """For whole names of columns."""
    return _suggested(spark, sf_dir, lambda kind: kind, 1)


@query("suggest_typed", _SUGGEST_SQL.format(asked="left(p_type, 3)", word="left(p_type, 3)"))
def suggest_typed(spark, sf_dir):
    """For the first letters that a user has typed."""
    return _suggested(spark, sf_dir, lambda kind: F.substring(kind, 1, 3), 2)


@query("concept_definition", """SELECT source, text FROM (SELECT *, row_number() OVER (
  PARTITION BY source ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, doc_id) AS nth FROM documents)
WHERE nth = 1""")
def concept_definition(spark, sf_dir):
    return vocab.pick_definitions(table(spark, sf_dir, "documents"), "source", "doc_id", "lang",
                                  "text", "de")


@query("concept_definition_listed", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL
  WHEN page_id % 4 = 0 OR page_id % 4 = 2 THEN 'en ' || url ELSE 'de ' || url END AS value FROM pages""")
def concept_definition_listed(spark, sf_dir):
    k = F.col("page_id") % 4

    def one(lang):
        return F.struct(F.lit(lang).alias("lang"), F.concat(F.lit(lang + " "), "url").alias("value"))

    listed = (F.when(k == 0, F.array(one("de"), one("en"), one("fr"))).when(k == 1, F.array(one("de")))
              .when(k == 2, F.array(one("en"))))
    return table(spark, sf_dir, "pages").select(
        "page_id", vocab.concept_definition(listed, "en").alias("value"))


_VIEWED = {"c_custkey": "c_custkey", "c_name": "c_name", "c_nationkey": "c_nationkey",
           "c_acctbal": "CAST(c_acctbal AS DECIMAL(15, 2))", "c_mktsegment": "c_mktsegment"}


@query("column_view", f"""WITH cells AS ({" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", c_custkey AS k, CAST({v} AS VARCHAR) AS value FROM customer WHERE {c} IS NOT NULL"""
    for c, v in _VIEWED.items())}),
first3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY k) AS nth FROM cells)
  WHERE nth <= 3),
concepts AS (SELECT 's/' || c_mktsegment AS id, 'c_mktsegment ' || c_mktsegment AS label FROM customer
  UNION SELECT 'b/' || c_mktsegment, 'Balance c_acctbal ' || c_mktsegment FROM customer
  UNION SELECT 'n/' || n_nationkey, 'c_nationkey ' || n_name FROM nation),
options AS (SELECT * FROM (
  SELECT c."column", id, label, row_number() OVER (PARTITION BY c."column" ORDER BY label, id) AS nth
  FROM (SELECT DISTINCT "column" FROM first3) c JOIN concepts ON list_contains(string_split(label, ' '), c."column"))
  WHERE nth <= 5),
picked AS (SELECT c."column", coalesce(o.id, 'none/' || c."column") AS id, o.label
  FROM (SELECT DISTINCT "column" FROM first3) c
  LEFT JOIN options o ON o."column" = c."column" AND o.nth = 1 + length(c."column") % 5)
SELECT f."column", string_agg(value, '|' ORDER BY k) AS "values",
  (SELECT string_agg(label, '|' ORDER BY nth) FROM options o WHERE o."column" = f."column") AS suggestions,
  max(p.id) AS selected_id, max(p.label) AS selected_label
FROM first3 f JOIN picked p ON p."column" = f."column" GROUP BY f."column" """)
def column_view(spark, sf_dir):
    """All columns of a table with the concepts suggested for their names; which one is selected follows from the name."""
    customer = customers(spark, sf_dir)
    samples = profile.column_samples(customer, "c_custkey", list(_VIEWED), 3)
    segment = F.col("c_mktsegment")

    def concept(df, id_, label):
        return df.select(id_.alias("id"), label.alias("label"), F.lit("en").alias("lang"))

    concepts = (
        concept(customer, F.concat(F.lit("s/"), segment), F.concat(F.lit("c_mktsegment "), segment))
        .unionByName(concept(customer, F.concat(F.lit("b/"), segment), F.concat(F.lit("Balance c_acctbal "), segment)))
        .unionByName(concept(table(spark, sf_dir, "nation"), F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")),
                             F.concat(F.lit("c_nationkey "), "n_name")))
        .distinct()
    )
    names = local_table(spark, [(c,) for c in _VIEWED], "column string")
    options = vocab.suggest_concepts(names, concepts, "column", "en")
    picked = options.where(F.col("ordinal") == 1 + F.length("column") % 5).select("column", "id")
    selected = names.join(picked, "column", "left").select(
        "column", F.coalesce("id", F.concat(F.lit("none/"), "column")).alias("concept_id"))
    view = vocab.column_view(samples, options.drop("score"), selected)
    return view.select(
        "column", F.array_join("values", "|").alias("values"),
        F.array_join(F.transform("suggestions", lambda s: s["label"]), "|").alias("suggestions"),
        "selected_id", "selected_label")
