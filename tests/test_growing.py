"""Stored states of files against the profile of the whole table."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from packwright.operators import profile
from packwright.plans import growing

DDL = "k long, x double, s string, `a.b` array<int>"


def rows(start, n):
    return [(i, [None, float("nan"), i / 7][min(i % 9, 2)], f"s{i % 1000:04d}" if i % 4 else None, [i % 50] if i % 2 else None)
            for i in range(start, start + n)]


def append(spark, path, data):
    spark.createDataFrame(data, DDL).coalesce(1).write.mode("append").parquet(path)


def exact(found):
    return {r.column: (r.pos, r.rows, r.nulls, r.least, r.greatest, r.first_text, r.last_text) for r in found}


def test_three_appends_equal_the_whole(spark, tmp_path):
    data, store, at_once = (str(tmp_path / n) for n in ("data", "states", "at-once"))
    read = []
    for start, n in ((0, 4000), (4000, 1), (4001, 6000)):
        append(spark, data, rows(start, n))
        read.append(growing.append_states(spark, data, store))
    assert read == [1, 1, 1] and growing.append_states(spark, data, store) == 0
    parts = growing.growing_profile(spark, data, store).collect()
    whole = growing.growing_profile(spark, data, at_once).collect()
    assert exact(parts) == exact(whole)
    df = spark.read.parquet(data)
    assert {r.column: (r.rows, r.nulls, r.null_fraction) for r in parts} == {
        r.column: (r.rows, r.nulls, r.null_fraction) for r in profile.null_profile(df).collect()}
    by_name = {r.column: r for r in parts}
    for name, different in (("k", 10_001), ("s", 750), ("a.b", 25)):
        assert by_name[name].distinct_estimate == pytest.approx(different, rel=0.05)
    assert by_name["s"].quartile_estimates is None
    values = np.sort([i / 7 for i in range(10_001) if i % 9 >= 2])
    for q, estimate in zip(growing.QUANTILES, by_name["x"].quartile_estimates):
        assert abs(np.searchsorted(values, estimate) / len(values) - q) < 0.03
    assert (by_name["x"].least, by_name["x"].greatest) == (values[0], values[-1])


def test_files_with_a_state_are_not_opened_again(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "states")
    append(spark, data, rows(0, 50))
    growing.append_states(spark, data, store)
    (old,) = [p for p in (tmp_path / "data").iterdir() if p.suffix == ".parquet"]
    about = old.stat()
    old.write_bytes(b"x" * about.st_size)  # no longer a Parquet file, but of the same size and time
    (tmp_path / "data" / f".{old.name}.crc").unlink(missing_ok=True)
    os.utime(old, ns=(about.st_atime_ns, about.st_mtime_ns))
    append(spark, data, rows(50, 10))
    assert growing.append_states(spark, data, store) == 1
    found = growing.merge_states(growing.current_states(spark, data, store))
    assert {r.rows for r in found.collect()} == {60}


def test_rewritten_and_removed_files(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "states")
    append(spark, data, rows(0, 50))
    growing.append_states(spark, data, store)
    spark.createDataFrame(rows(100, 7), DDL).coalesce(1).write.mode("overwrite").parquet(data)
    found = exact(growing.growing_profile(spark, data, store).collect())
    assert found["k"] == (0, 7, 0, 100.0, 106.0, None, None)


def test_states_stored_twice_count_once(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "states")
    append(spark, data, rows(0, 30))
    growing.append_states(spark, data, store)
    growing.file_states(spark.read.parquet(data)).write.mode("append").parquet(store)
    assert {r.rows for r in growing.growing_profile(spark, data, store).collect()} == {30}


def test_a_new_column_was_missing_before(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "states")
    spark.range(5).write.mode("append").parquet(data)
    before = growing.append_states(spark, data, store)
    assert before >= 5 and growing.append_states(spark, data, store) == 0  # files without rows are known too
    spark.range(3).withColumn("late", F.lit("v")).write.mode("append").parquet(data)
    found = {r.column: (r.rows, r.nulls) for r in growing.growing_profile(spark, data, store).collect()}
    assert found == {"id": (8, 0), "late": (8, 5)}


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    data, store = str(tmp_path / "da ta%20"), str(tmp_path / "states")
    times = []
    for part in ("p=1", "p=2"):
        (tmp_path / "da ta%20" / part).mkdir(parents=True)
        file = tmp_path / "da ta%20" / part / "a.parquet"
        pq.write_table(pa.table({"k": [int(part[-1])]}), file)
        times.append(file.stat().st_size)
        os.utime(file, (10**9, 10**9))
    assert times[0] == times[1]
    found = exact(growing.growing_profile(spark, data, store).collect())
    assert found["k"][1:5] == (2, 0, 1.0, 2.0)
    assert growing.append_states(spark, data, store) == 0


def test_nothing_there(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "states")
    spark.createDataFrame([], DDL).write.parquet(data)
    assert growing.append_states(spark, data, store) == 1 and growing.append_states(spark, data, store) == 0
    assert growing.growing_profile(spark, data, store).collect() == []
