"""Bad records of CSV files, with their kinds and places."""

import pytest

from packwright.sources import BadRecords, read_csv_records
from packwright.sources.records import field_count

SCHEMA = "id int, `a.b` double, note string, day date"


def write(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("id,a.b,note,day\n" + "\n".join(lines) + ("\n" if lines else ""))
    return read_csv_records


def test_kinds_and_places(spark, tmp_path):
    write(tmp_path, one=["1,1.5,fine,2024-01-01", "", "x,1.5,t,2024-01-02", '2,,"a, ""quoted"" text",', "3,1"],
          two=["4,1e3,t,2024-02-30", "5,1,t,2024-01-01,more,most", "6,no,t,never", ",,,"], empty=[])
    records = read_csv_records(spark, str(tmp_path), SCHEMA)
    got = sorted((r.file.rsplit("/", 1)[-1], r.record, r.kind, r.column, r.value) for r in records.bad.collect())
    assert got == [("one.csv", 2, "bad_value", "id", "x"), ("one.csv", 4, "too_few_fields", None, "2"),
                   ("two.csv", 1, "bad_value", "day", "2024-02-30"), ("two.csv", 2, "too_many_fields", None, "6"),
                   ("two.csv", 3, "bad_value", "a.b", "no"), ("two.csv", 3, "bad_value", "day", "never")]
    good = [tuple(r) for r in records.good.orderBy("id").collect()]
    assert [g[0] for g in good] == [None, 1, 2] and good[2][2] == 'a, "quoted" text'
    assert records.good.columns == ["id", "a.b", "note", "day"]
    counts = {(r.file.rsplit("/", 1)[-1], r.kind): (r.records, r.share) for r in records.counts().collect()}
    assert counts["one.csv", "all"] == (4, 1.0) and counts["one.csv", "too_few_fields"] == (1, 0.25) and counts["two.csv", "bad_value"] == (2, 0.5)
    with pytest.raises(BadRecords, match="5 of 8 records.*1 too_few_fields, 1 too_many_fields, 3 bad_value") as e:
        records.require(0.5)
    assert e.value.counts.count() == 10
    assert records.require(0.7).count() == 3
    assert {r.severity for r in records.findings("d", 0.7).collect()} == {"warning"} and records.findings("d").count() == 3


def test_places_across_splits(spark, tmp_path):
    """A file read in many splits numbers its records as one read in order would."""
    lines = [f"{i},{i}.5,{'note' * (i % 7)},2024-01-0{i % 9 + 1}" if i % 13 else f"bad{i},1,n,2024-01-01" for i in range(1, 3000)]
    write(tmp_path, big=lines, small=["1,1,n,never"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = read_csv_records(spark, str(tmp_path), SCHEMA)
        assert records.all.select("_block").distinct().count() > 10
        got = sorted((r.record, r.value) for r in records.bad.where("file like '%big.csv'").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == [(i, f"bad{i}") for i in range(13, 3000, 13)]


def test_nothing_and_refusals(spark, tmp_path):
    write(tmp_path, empty=[])
    records = read_csv_records(spark, str(tmp_path), SCHEMA)
    assert records.good.count() == records.bad.count() == records.counts().count() == records.findings("d").count() == 0
    assert records.require().count() == 0
    with pytest.raises(ValueError, match="_record"):
        read_csv_records(spark, str(tmp_path), "_record string")
    with pytest.raises(ValueError, match="separator"):
        read_csv_records(spark, str(tmp_path), SCHEMA, separator='"')


def test_field_count(spark):
    rows = [("a", 1), ("", 1), (",", 2), ('"a,b",c', 2), ('"a ""x"", b",', 2), ('a"b,c', 2)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert df.where(field_count(df.t) != df.n).collect() == []
