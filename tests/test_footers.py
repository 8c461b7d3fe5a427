"""Counts from footers against scans."""

import datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from packwright.operators.constraints import Constraint, constraint_checks
from packwright.operators.profile import count_checks, null_checks
from packwright.sources import footer_counts, footer_profile, zone_map
from packwright.sources.footers import Rule, rules_of

BOUNDS = [Constraint("k", minimum=0, maximum=49), Constraint("x", required=True, minimum=10), Constraint("d", maximum=12.3),
          Constraint("few", minimum=0)]
SCHEMA = pa.schema([("k", pa.int64()), ("x", pa.float64()), ("s", pa.string()), ("d", pa.decimal128(9, 2)), ("few", pa.int32()),
                    ("at", pa.timestamp("us")), ("l", pa.list_(pa.int64())), ("a.b", pa.int16())])


def rows(n):
    nan = float("nan")
    return pa.Table.from_pylist([{
        "k": i, "x": [None, nan, float(i)][min(i % 7, 2)], "s": None if i < 25 else "t", "d": Decimal(i) / 4,
        "few": i if 30 <= i < 40 else None, "at": datetime.datetime(2020, 1, 1 + i % 28), "l": [i] if i % 2 else None,
        "a.b": None if i % 3 else i % 100} for i in range(n)], schema=SCHEMA)


def scanned(spark, path, constraints):
    df = spark.read.parquet(path)
    found = count_checks(df, null_checks(df) + constraint_checks(df, constraints)).collect()
    return {(r.pos, r.subject, r.check): (r.rows, r.n) for r in found}


def test_footers_say_what_a_scan_says(spark, tmp_path):
    pq.write_table(rows(100), tmp_path / "a.parquet", row_group_size=10)
    pq.write_table(rows(33), tmp_path / "b.parquet", row_group_size=25, write_statistics=["k"])
    pq.write_table(rows(7), tmp_path / "c.parquet", write_statistics=False)
    pq.write_table(rows(0), tmp_path / "d.parquet")
    got = footer_profile(spark, str(tmp_path), BOUNDS).collect()
    assert {(r.pos, r.subject, r.check): (r.rows, r.n) for r in got} == scanned(spark, str(tmp_path), BOUNDS)


def test_only_open_row_groups_are_read(spark, tmp_path):
    pq.write_table(rows(100), tmp_path / "a.parquet", row_group_size=10)
    got = {(r.subject, r.check): (r.row_groups, r.row_groups_read) for r in footer_profile(
        spark, str(tmp_path), [Constraint("k", minimum=15, maximum=49), Constraint("x", minimum=10)], tasks=3).collect()}
    assert got["k", "minimum"] == (10, 1)  # 10 to 19 alone lie on both sides
    assert got["k", "maximum"] == (10, 0)
    assert got["s", "nulls"] == (10, 0)
    assert got["x", "nulls"] == (10, 10)  # NaN is in no footer
    assert got["x", "minimum"] == (10, 1)
    zones = zone_map(spark, str(tmp_path), [Rule(0, "k", "minimum", 15)]).collect()
    assert sorted((r.row_group, r.n) for r in zones if r.decided) == [(0, 10)] + [(i, 0) for i in range(2, 10)]


def test_a_column_that_a_file_lacks_is_null_there(spark, tmp_path):
    pq.write_table(pa.table({"k": [1, 2], "new": [5, None]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"k": [3]}), tmp_path / "b.parquet")
    rules = rules_of(["k", "new"], [Constraint("new", required=True, minimum=6)])
    got = {(r.subject, r.check): (r.rows, r.n) for r in footer_counts(spark, str(tmp_path), rules).collect()}
    assert got == {("k", "nulls"): (3, 0), ("new", "nulls"): (3, 2), ("new", "required"): (3, 2), ("new", "minimum"): (3, 1)}


def test_an_unreadable_file_is_named(spark, tmp_path):
    pq.write_table(pa.table({"k": [1]}), tmp_path / "a.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 nothing else")
    rules = [Rule(0, "k", "nulls")]
    found = zone_map(spark, str(tmp_path), rules).where("problem is not null").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["bad.parquet"]
    with pytest.raises(Exception, match="cannot read .*bad.parquet"):
        footer_counts(spark, str(tmp_path), rules).collect()


def test_rules_that_say_nothing_about_a_footer(spark, tmp_path):
    pq.write_table(rows(3), tmp_path / "a.parquet")
    for refused in (Constraint("s", pattern="a"), Constraint("s", unique=True), Constraint("s", minimum=1)):
        with pytest.raises(ValueError):
            footer_profile(spark, str(tmp_path), [refused])


def test_a_table_without_rows(spark, tmp_path):
    pq.write_table(rows(0), tmp_path / "a.parquet")
    got = footer_profile(spark, str(tmp_path), [Constraint("k", minimum=0)]).collect()
    assert len(got) == len(SCHEMA) + 1 and {(r.rows, r.n, r.row_groups_read) for r in got} == {(0, 0, 0)}
