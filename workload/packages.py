"""Queries over sources, packages, whole validations and streams."""

from pyspark.sql import functions as F

from packwright.operators.constraints import Constraint
from packwright.functions import field_type_of
from packwright.functions.value_types import VALUE_TYPES
from packwright.plans import Dataset, export_package, validate_all, with_level
from packwright.session import shared_dir
from packwright.sources import (
    audit_sizes,
    load,
    make_dir,
    pack_catalog,
    pack_read,
    pack_write,
    read_csv,
    read_parquet,
)
from packwright.streaming.quality import (
    drop_repeats,
    latest,
    read_files,
    run_to_parquet,
    run_updates,
    stream_quality,
)
from workload.consistency import dirty
from workload.profiling import labelled
from workload.registry import query, table

DETAILS = {
    "name": "shop-tables", "title": "Tables of a wholesale shop",
    "description": "Customers, orders and suppliers of a wholesale shop, generated for tests.",
    "version": "1.0.0", "keywords": ["orders", "customers", "wholesale"],
    "homepage": "https://example.org/shop", "repository": "https://example.org/shop/code",
    "licenses": [{"name": "CC-BY-4.0", "path": "https://spdx.org/licenses/CC-BY-4.0.html"}],
    "contributors": [{"name": "A. Author", "role": "author"}],
    "sources": [{"title": "Generated data"}], "created": "2025-10-15",
}


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


@query("read_csv", "SELECT * FROM customer")
def csv_round_trip(spark, sf_dir):
    path = shared_dir(spark) + "/customer.csv"
    customer = table(spark, sf_dir, "customer")
    customer.write.option("header", True).csv(path)
    return read_csv(spark, path, customer.schema)


@query("read_parquet", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_discount > 0.05""")
def parquet_scan(spark, sf_dir):
    return read_parquet(spark, _path(sf_dir, "lineitem")).where(
        (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
        & (F.col("l_discount") > F.lit(0.05))
    ).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("read_any", """SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys
FROM orders GROUP BY o_orderstatus""")
def by_suffix(spark, sf_dir):
    return load(spark, _path(sf_dir, "orders")).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(spark, sf_dir):
    from packwright.operators.profile import preview as first_rows

    return first_rows(table(spark, sf_dir, "orders"), "o_orderkey", 10)


@query("pack_write", "SELECT * FROM supplier")
def write_package(spark, sf_dir):
    path = shared_dir(spark)
    make_dir(path)
    pack_write(table(spark, sf_dir, "supplier"), DETAILS, path + "/supplier")
    return spark.read.parquet(path + "/supplier")


@query("pack_read", "SELECT *, 'shop-tables' AS package FROM orders")
def read_package(spark, sf_dir):
    path = shared_dir(spark)
    make_dir(path)
    pack_write(table(spark, sf_dir, "orders"), DETAILS, path + "/orders")
    df, descriptor = pack_read(spark, path + "/orders")
    return df.withColumn("package", F.lit(descriptor["name"]))


_PACKED = {"supplier": 4, "customer": 5, "part": 6}


@query("pack_catalog", " UNION ALL ".join(
    f"SELECT '{t}-pack' AS package, CAST(count(*) AS BIGINT) AS num_rows, {n} AS num_columns FROM {t}"
    for t, n in _PACKED.items()) + " UNION ALL SELECT NULL, count(*), 3 FROM labels")
def catalog_of_packages(spark, sf_dir):
    path = shared_dir(spark)
    make_dir(path)
    for name in _PACKED:
        pack_write(table(spark, sf_dir, name), {**DETAILS, "name": f"{name}-pack"}, f"{path}/{name}")
    table(spark, sf_dir, "labels").write.parquet(path + "/plain")
    return (
        pack_catalog(spark, path)
        .groupBy(F.get_json_object("descriptor_json", "$.name").alias("package"))
        .agg(F.sum("num_rows").alias("num_rows"), F.max("num_columns").alias("num_columns"))
    )


def _size_text(x: str) -> str:
    """A size in words, rounded half up."""
    one = lambda scale: f"printf('%.1f', floor({x} / {scale}.0 * 10 + 0.5) / 10)"
    return (f"CASE WHEN {x} < 1024 THEN {one(1)} || ' B' WHEN {x} < {1024**2} THEN {one(1024)} || ' KB' "
            f"WHEN {x} < {1024**3} THEN {one(1024**2)} || ' MB' ELSE {one(1024**3)} || ' GB' END")


@query("file_size_audit", f"""SELECT o_orderkey, bytes,
  CASE WHEN bytes <= {10 * 1024**2} THEN 'small' WHEN bytes <= {500 * 1024**2} THEN 'medium' ELSE 'large' END AS tier,
  {_size_text('(bytes * 3)')} AS memory_estimate, bytes > {5000 * 1024**2} AS too_large
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey * 5003
  WHEN 2 THEN o_orderkey * 100003 ELSE o_orderkey * 9000011 END AS bytes FROM orders)""")
def audit(spark, sf_dir):
    """The rules on file sizes, over sizes made of the keys of all orders."""
    key = F.col("o_orderkey")
    sizes = F.when(key % 4 == 0, key).when(key % 4 == 1, key * 5003).when(key % 4 == 2, key * 100003).otherwise(key * 9000011)
    return audit_sizes(table(spark, sf_dir, "orders").select("o_orderkey", sizes.alias("bytes")))


@query("export_package", """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
  'strict' AS level, 'integer,string,integer,number,string' AS types FROM customer""")
def export(spark, sf_dir):
    path = shared_dir(spark)
    make_dir(path)
    out, level, _ = export_package(
        table(spark, sf_dir, "customer"),
        {"c_mktsegment": "https://vocab.example.org/segment",
         "c_acctbal_unit": "http://qudt.org/vocab/unit/EUR"},
        DETAILS, "shop.csv", "Customers", path + "/customers")
    df, descriptor = pack_read(spark, out)
    types = ",".join(f["type"] for f in descriptor["resources"][0]["schema"]["fields"])
    return df.withColumn("level", F.lit(level)).withColumn("types", F.lit(types))


# ------------------------------------------------------------------ validation
def _field(name, kind, unit=None):
    out = {"name": name, "type": kind, "description": f"About {name}"}
    if unit:
        out["unit"] = {"name": unit}
    return out


def _described(name, fields, **changes):
    resource = {"name": name, "path": f"{name}.parquet", "format": "parquet", "title": name,
                "description": name, "encoding": "utf-8", "schema": {"fields": fields}}
    return {**DETAILS, "name": name, "resources": [resource], **changes}


def _fields(df, **types):
    """Definitions of all columns of a table; numbers get a unit."""
    kinds = {f.name: types.get(f.name, field_type_of(f.dataType)) for f in df.schema.fields}
    return [_field(c, kind, "NUM" if kind in ("integer", "number") else None) for c, kind in kinds.items()]


def _with_rules(descriptor, rules, primary_key):
    """A descriptor whose schema declares constraints and a primary key."""
    schema = descriptor["resources"][0]["schema"]
    for f in schema["fields"]:
        if f["name"] in rules:
            f["constraints"] = rules[f["name"]]
    schema["primaryKey"] = primary_key
    return descriptor


def datasets(spark, sf_dir):
    """Four whole tables with descriptors, raw columns, constraints and keys, some of them declared in the descriptor."""
    docs = labelled(spark, sf_dir)
    part, lineitem, events = (table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), dirty(spark, sf_dir))
    return [
        Dataset("events", events, _described("events", _fields(events, code="integer", amount="boolean")),
            row_id="event_id", raw_columns=("code", "amount")),
        Dataset("documents", docs, _described("documents", [
            _field("doc_id", "integer", "NUM"), _field("text", "string"), _field("lang", "string"),
            _field("n_chars", "number"), _field("quality", "boolean"), _field("title", "string")],
            version=1), constraints=(
                Constraint("quality", required=True), Constraint("lang", enum=("en", "de")),
                Constraint("doc_id", unique=True))),
        Dataset("part", part, _described("part", _fields(part))),
        Dataset("lineitem", lineitem, _with_rules(_described(
            "lineitem", _fields(lineitem), contributors=[{"name": "B", "role": "maintainer"}]),
            {"l_discount": {"minimum": 0.0, "maximum": 0.05}}, ["l_orderkey", "l_linenumber"])),
    ]


# Errors and warnings that do not hang on the data are given as numbers: a descriptor
# without faults has none, the one of documents declares two wrong types, lacks a unit
# twice and names an unknown field, and two of its columns are not declared.
@query("validate_all", """WITH e AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'n/a'
    WHEN event_id % 41 = 0 THEN 'true' WHEN event_id % 89 = 0 THEN NULL ELSE '1' END AS code,
  CASE WHEN event_id % 53 = 0 THEN 'd' WHEN event_id % 59 = 0 THEN 't' WHEN event_id % 2 = 0 THEN 'f' ELSE 'i' END AS amount FROM events),
d AS (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
counts AS (
  SELECT 'events' AS dataset,
    (SELECT CASE WHEN count(DISTINCT code) > 1 THEN 1 ELSE 0 END FROM e)
    + (SELECT CASE WHEN count(DISTINCT amount) > 1 THEN 1 ELSE 0 END FROM e) + 1 AS errors, 0 AS warnings
  UNION ALL SELECT 'documents', 3
    + (SELECT CASE WHEN count(*) > count(quality) THEN 1 ELSE 0 END FROM d)
    + (SELECT CASE WHEN count(CASE WHEN lang NOT IN ('en', 'de') THEN 1 END) > 0 THEN 1 ELSE 0 END FROM d)
    + (SELECT CASE WHEN count(*) > count(DISTINCT doc_id) THEN 1 ELSE 0 END FROM d), 3
  UNION ALL SELECT 'part', 0, 0
  UNION ALL SELECT 'lineitem', 1
    + (SELECT CASE WHEN count(CASE WHEN l_discount > 0.05 THEN 1 END) > 0 THEN 1 ELSE 0 END FROM lineitem)
    + (SELECT CASE WHEN count(*) > count(DISTINCT (l_orderkey, l_linenumber)) THEN 1 ELSE 0 END FROM lineitem), 0)
SELECT dataset, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings,
  CASE WHEN errors = 0 AND warnings = 0 THEN 'strict' WHEN errors = 0 AND warnings <= 5 THEN 'standard'
    WHEN errors <= 10 THEN 'basic' ELSE 'invalid' END AS level FROM counts""")
def validation(spark, sf_dir):
    return validate_all(datasets(spark, sf_dir))[1]


@query("validation_findings")
def validation_findings(spark, sf_dir):
    return with_level(validate_all(datasets(spark, sf_dir))[0])


# ------------------------------------------------------------------- streaming
_DAY_SQL = """SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type,
  count(*) AS rows, CAST(0 AS BIGINT) AS nulls,
  count(CASE WHEN value < 1.0 OR value > 100.0 THEN 1 END) AS out_of_range,
  count(CASE WHEN kind = 'int' THEN 1 END) AS raw_ints, """ + ", ".join(
    f"count(CASE WHEN kind = '{t}' THEN 1 END) AS types_{t}" for t in VALUE_TYPES) + """
FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'str' WHEN event_id % 41 = 0 THEN 'bool' WHEN event_id % 89 = 0 THEN 'float'
  ELSE 'int' END AS kind FROM events) GROUP BY ALL"""


def _raw():
    """A raw value of an event; most are whole numbers."""
    i = F.col("event_id")
    return F.when(i % 97 == 0, "n/a").when(i % 41 == 0, "true").when(i % 89 == 0, "2.5").otherwise(F.get_json_object("props", "$.k"))


def _types_apart(counts):
    """The counts of every type as a column of its own."""
    return counts.select("*", *(F.col("raw_types")[t].alias(f"types_{t}") for t in VALUE_TYPES)).drop("raw_types")


@query("stream_quality", _DAY_SQL)
def streamed(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    path = shared_dir(spark)
    counts = stream_quality(read_files(spark, sf_dir, schema, "events.parquet"), "ts", "value", _raw(), "event_type", 1.0, 100.0)
    run_updates(_types_apart(counts), path + "/counts", path + "/state")
    return latest(spark.read.parquet(path + "/counts"), ["window_start", "event_type"])


@query("stream_drop_repeats", "SELECT event_id, event_type FROM events")
def without_repeats(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    path = shared_dir(spark)
    stream = read_files(spark, sf_dir, schema, "events.parquet").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    once = drop_repeats(stream.union(stream), ["event_id"], "ts", "1 hour")
    run_to_parquet(once.select("event_id", "event_type"), path + "/rows", path + "/state")
    return spark.read.parquet(path + "/rows")


@query("batch_quality", _DAY_SQL)
def batched(spark, sf_dir):
    return _types_apart(stream_quality(table(spark, sf_dir, "events"), "ts", "value", _raw(), "event_type", 1.0, 100.0))
