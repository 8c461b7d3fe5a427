import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from packwright.operators import vocab
from packwright.operators.constraints import Constraint
from packwright.plans import ExportRefused, export_package
from packwright.sources import (
    annotate,
    file_size_audit,
    load,
    pack_catalog,
    pack_read,
    pack_write,
    read_csv,
    read_descriptor,
)
from packwright.streaming.quality import (
    drop_repeats,
    latest,
    read_files,
    run_to_parquet,
    run_updates,
    stream_quality,
)
from test_catalog import FULL

DETAILS = {k: v for k, v in FULL.items() if k != "resources"}


def sample(spark, n=3):
    return spark.range(n).select(
        F.concat(F.lit("place "), F.col("id").cast("string")).alias("location"),
        F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"), F.col("id").alias("amount"))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "pack")
    pack_write(sample(spark, 1000).repartition(4), {"name": "trip", "list": [1, {"ü": None}]}, path)
    df, descriptor = pack_read(spark, path)
    assert descriptor == {"name": "trip", "list": [1, {"ü": None}]}
    assert df.dtypes == sample(spark).dtypes
    assert df.exceptAll(sample(spark, 1000)).isEmpty() and df.count() == 1000
    files = list((tmp_path / "pack").glob("*.parquet"))
    assert len(files) == 4 and not list((tmp_path / "pack").glob("_staging*"))
    for f in files:
        assert json.loads(pq.read_schema(f).metadata[b"datapackage.json"]) == descriptor
    pack_write(sample(spark, 2), {"name": "again"}, path)
    df, descriptor = pack_read(spark, path)
    assert descriptor == {"name": "again"} and df.count() == 2


def test_large_tasks_roll_over_to_new_files(spark, tmp_path):
    path = tmp_path / "pack"
    df = spark.range(300_000).select(F.rand(1).alias("x")).coalesce(1)
    pack_write(df, {}, str(path), target_bytes=200_000)
    assert len(list(path.glob("*.parquet"))) > 3 and spark.read.parquet(str(path)).count() == 300_000


def test_row_groups_hold_many_batches(spark, tmp_path):
    path = tmp_path / "pack"
    pack_write(spark.range(300_000).coalesce(1), {}, str(path))
    (file,) = path.glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups == 1


def test_empty_table_and_errors(spark, tmp_path):
    pack_write(sample(spark).where("false"), {"name": "empty"}, str(tmp_path / "e"))
    df, descriptor = pack_read(spark, str(tmp_path / "e"))
    assert df.count() == 0 and descriptor == {"name": "empty"}
    with pytest.raises(FileNotFoundError):
        pack_write(sample(spark), {}, str(tmp_path / "no" / "such"))
    with pytest.raises(FileNotFoundError):
        read_descriptor(str(tmp_path / "nothing"))
    with pytest.raises(TypeError):
        pack_write(sample(spark), [], str(tmp_path / "x"))
    sample(spark).write.parquet(str(tmp_path / "plain"))
    assert pack_read(spark, str(tmp_path / "plain"))[1] == {}


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = sample(spark, 100).withColumn("amount", F.when(
        F.col("amount") == 99, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="boom"):
        pack_write(bad, {}, str(tmp_path / "bad"))
    # A task still running at the abort may leave a staging folder, which no reader looks into.
    assert not list(tmp_path.glob("bad/*.parquet")) and not list(tmp_path.glob("bad/*.json"))


def test_catalog_of_files(spark, tmp_path):
    pack_write(sample(spark, 10), {"name": "a"}, str(tmp_path / "a"))
    sample(spark, 5).coalesce(1).write.parquet(str(tmp_path / "plain"))
    got = pack_catalog(spark, str(tmp_path)).collect()
    assert sum(r.num_rows for r in got) == 15 and {r.num_columns for r in got} == {3}
    assert {r.has_descriptor for r in got} == {True, False}
    audit = file_size_audit(spark, str(tmp_path), "*.parquet")
    assert audit.count() == len(got) and {r.tier for r in audit.collect()} == {"small"}


def test_column_metadata(spark, tmp_path):
    field = {"name": "amount", "type": "integer", "unit": {"name": "NUM", "path": "http://v/NUM"}}
    annotate(sample(spark), [field]).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.schema["amount"].metadata == {k: v for k, v in field.items() if k != "name"}
    assert back.schema["location"].metadata == {}


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,_c1,\n1,x,3\n2,y,\n")
    df = load(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes)["a"] == "int" and [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x", 3), (2, "y", None)]
    assert df.columns == ["a", "_c1", "_c2"]
    assert dict(read_csv(spark, str(tmp_path / "t.csv"), raw=True).dtypes)["a"] == "string"
    assert load(spark, str(tmp_path / "t.csv"), "a long, b string").schema["a"].dataType.typeName() == "long"
    with pytest.raises(ValueError, match="Unsupported"):
        load(spark, "table.txt")


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("Ems", 12, 80.4), ("Oder", 31, 574.9)], "river string, locks int, flow double")
    path, level, findings = export_package(
        df, {"river": "http://v/river", "flow_unit": "http://v/unit/Q"}, DETAILS, "gauges.xlsx", "North Sea",
        str(tmp_path / "gauges"), labels={"http://v/unit/Q": "cubic metre per second"}, descriptions={"locks": "Number of locks"})
    assert level == "strict" and {r.severity for r in findings.collect()} == {"info"}
    back, descriptor = pack_read(spark, path)
    assert back.count() == 2
    (resource,) = descriptor["resources"]
    assert resource["name"] == "gauges_north_sea" and resource["path"] == "gauges_north_sea.parquet"
    river, locks, flow = resource["schema"]["fields"]
    assert river == {"name": "river", "type": "string", "description": "Column from North Sea",
                     "rdfType": "http://v/river", "taxonomyUrl": "http://v/river"}
    assert locks["unit"]["name"] == "NUM" and locks["description"] == "Number of locks"
    long_name = "cubic metre per second"
    assert flow["unit"] == {"name": long_name, "longName": long_name, "path": "http://v/unit/Q"}


def test_export_with_constraints(spark, tmp_path):
    df = spark.createDataFrame([("Ems", 12), ("Oder", 31)], "river string, locks int")
    rules = (Constraint("locks", required=True, maximum=40), Constraint("river", unique=True, pattern="[A-Z]"))

    def run(**kw):
        return export_package(df, {"river": "http://v/river"}, DETAILS, "g.csv", "S", str(tmp_path / "g"), **kw)

    path, _, _ = run(constraints=rules, primary_key=("river",))
    schema = pack_read(spark, path)[1]["resources"][0]["schema"]
    assert schema["primaryKey"] == ["river"]
    assert [f["constraints"] for f in schema["fields"]] == [{"unique": True, "pattern": "[A-Z]"}, {"required": True, "maximum": 40.0}]
    with pytest.raises(ExportRefused, match="maximum"):
        run(constraints=(Constraint("locks", maximum=20),))
    with pytest.raises(ExportRefused, match="many locks"):
        run(rules=(("many locks", "error", F.col("locks") > 30),))


def test_export_gates(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "1")], "i long, s string")

    def run(df=df, details=DETAILS, **kw):
        export_package(df, {}, details, "f.csv", "S", str(tmp_path / "out"), **kw)

    with pytest.raises(ExportRefused, match="empty"):
        run(df.where("false"))
    with pytest.raises(ExportRefused, match="Package name is required"):
        run(details={**DETAILS, "name": ""})
    with pytest.raises(ExportRefused, match="mixed types: str, int"):
        run(row_id="i", raw_columns=("s",))
    with pytest.raises(ExportRefused, match="STANDARD VALIDATION FAILED") as refused:
        run(details={**DETAILS, "title": "abc"})
    assert refused.value.findings.where("severity = 'error'").count() == 1
    assert not (tmp_path / "out").exists()


def test_suggestions(spark):
    concepts = spark.createDataFrame(
        [(f"c{i}", "en", f"carbon {i:03d}") for i in range(500)]
        + [("exact", "en", "Carbon"), ("prefix", "en", "carbonate rock"), ("german", "de", "carbon"),
           ("other", "en", "iron")], "id string, lang string, label string")
    queries = spark.createDataFrame([("Carbon footprint",), ("carb",), ("x",), ("@@",), ("zinc",), ("I (A)",)], "c string")
    got = vocab.suggest_concepts(queries, concepts.repartition(6), "c", "en").collect()
    best = {}
    for r in sorted(got, key=lambda r: (r.column, r.ordinal)):
        best.setdefault(r.column, []).append((r.id, r.score))
    assert best["Carbon footprint"] == [("exact", 3), ("c0", 2), ("c1", 2), ("c2", 2), ("c3", 2)]
    assert [i for i, _ in best["carb"]] == ["exact", "c0", "c1", "c2", "c3"] and len(best) == 3
    assert best["I (A)"] == [("other", 1)]
    typed = vocab.suggest_concepts(queries, concepts, "c", "en", min_letters=2)
    assert {r.column for r in typed.collect()} == {"Carbon footprint", "carb"}


def test_definitions_and_labels(spark):
    def one(*pairs):
        return [{"lang": k, "value": v} for k, v in pairs]

    df = spark.createDataFrame(
        [(1, one(("de", "D"), ("en", "English definition"))), (2, one(("de", "Deutsch"))), (3, []), (4, None)],
        "i int, d array<struct<lang:string,value:string>>")
    got = [r.v for r in df.orderBy("i").select(vocab.concept_definition(F.col("d"), "en").alias("v")).collect()]
    assert got == ["English definition", "Deutsch", None, None]
    cache = spark.createDataFrame(
        [(1, 0, '{"id_":"a","name":"second"}'), (0, 1, '{"id":"a","label":"first"}'),
         (0, 0, '{"uri":"b","label":""}'), (2, 0, '{"id":"b","label":"late"}')],
        "cache_order long, pos long, suggestion string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r.id: r.label for r in vocab.label_lookup(wanted, cache).collect()}
    assert got == {"a": "first", "b": None, "c": None}


def test_stream_agrees_with_batch(spark, tmp_path):
    df = spark.range(2000).select(
        F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("ts"),
        F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 150).cast("double").alias("value"),
        F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("id").cast("string")).alias("raw"),
        (F.col("id") % 3).alias("kind"))
    src = str(tmp_path / "in")
    for part in range(3):
        df.where(F.col("ts") >= "2023-11-01").where(
            f"unix_timestamp(ts) BETWEEN {1_700_000_000 + part * 400_000} AND {1_700_000_000 + part * 400_000 + 399_999}"
        ).coalesce(1).write.mode("append").parquet(src)
    stream = read_files(spark, src, df.schema, files_per_batch=1)
    args = ("ts", "value", "raw", "kind", 10.0, 100.0)
    run_to_parquet(stream_quality(stream, *args), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    last = df.agg(F.max("ts") - F.expr("INTERVAL 25 HOURS")).first()[0]
    whole = stream_quality(df, *args).drop("raw_types").collect()
    want = {tuple(r) for r in whole if r.window_start <= last}
    assert {r[:-1] for r in got} == want and want
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert r.raw_types["int"] == r.raw_ints and sum(r.raw_types.values()) == r.rows
    # Updates hold the windows that are still open at the end as well.
    run_updates(stream_quality(stream, *args), str(tmp_path / "up"), str(tmp_path / "cp2"))
    last_state = latest(spark.read.parquet(str(tmp_path / "up")), ["window_start", "kind"]).drop("raw_types")
    assert sorted(map(tuple, last_state.collect())) == sorted(map(tuple, whole)) and len(whole) > len(want)


def test_stream_without_repeats(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 10).alias("k"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = read_files(spark, str(tmp_path / "in"), df.schema)
    run_to_parquet(drop_repeats(stream, ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
