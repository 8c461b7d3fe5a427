import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packwright.operators import duplicates, joins, outliers, profile

NAN = float("nan")


def dirty_rows(n=500, seed=7):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "a", "b", "x" * 200]), rng.choice([None, NAN, 1.0, 2.5]),
             rng.choice([None, 1, 2])) for i in range(n)]


DDL = "id long, s string, d double, n int"


def test_null_profile_matches_brute_force(spark):
    rows = dirty_rows()
    got = {r.column: r for r in profile.null_profile(spark.createDataFrame(rows, DDL)).collect()}
    frame = pd.DataFrame(rows, columns=["id", "s", "d", "n"])
    for name in frame.columns:
        assert got[name].nulls == frame[name].isnull().sum()
        assert got[name].rows == len(rows)
        assert got[name].null_fraction == pytest.approx(frame[name].isnull().mean())
    filled = profile.nonempty_cells(
        profile.null_profile(spark.createDataFrame(rows, DDL))).first().nonempty_cells
    assert filled == int(frame.notna().sum().sum())


def test_null_profile_of_wide_and_empty_tables(spark):
    wide = spark.range(3).select(*[F.lit(i).alias(f"c{i}") for i in range(450)])
    got = profile.null_profile(wide).collect()
    assert len(got) == 450 and {r.rows for r in got} == {3} and {r.nulls for r in got} == {0}
    empty = spark.createDataFrame([], DDL)
    assert {r.null_fraction for r in profile.null_profile(empty).collect()} == {0.0}
    assert duplicates.duplicate_profile(empty).first().duplicate_fraction == 0.0


def test_null_severity(spark):
    rows = [("a", 51, 100), ("b", 50, 100), ("c", 20, 100), ("d", 0, 100), ("e", 21, 100)]
    prof = spark.createDataFrame(rows, "column string, nulls long, rows long").withColumn(
        "null_fraction", F.col("nulls") / F.col("rows"))
    tiers = {r.column: r.tier for r in profile.null_severity(prof).collect()}
    assert tiers == {"a": "critical", "b": "high", "c": "present", "e": "high"}
    parity = {r.column: r.tier for r in profile.null_severity(prof, parity=True).collect()}
    assert parity == {"a": "high", "b": "high", "c": "present", "e": "high"}
    text = {r.column: r.message for r in profile.null_severity(prof).collect()}
    assert text["c"] == "Column 'c' has 20.0% missing values"
    assert text["e"] == "Column 'e' has 21.0% missing values (exceeds recommended max: 20.0%)"


def test_duplicates_treat_nan_as_null(spark):
    rows = [(1.0,), (NAN,), (None,), (NAN,), (None,)]
    got = duplicates.duplicate_profile(spark.createDataFrame(rows, "v double")).first()
    assert (got.rows, got.distinct_rows, got.duplicates, got.exceeds) == (5, 2, 3, True)


def test_duplicates_match_pandas(spark):
    rows = dirty_rows()
    frame = pd.DataFrame(rows, columns=["id", "s", "d", "n"])
    df = spark.createDataFrame(rows, DDL)
    for columns in (["s"], ["s", "d"], ["s", "d", "n"]):
        want = frame.duplicated(subset=columns)
        got = duplicates.duplicate_profile(df, columns).first()
        assert got.duplicates == want.sum() and got.rows == got.distinct_rows + got.duplicates
        flags = duplicates.flag_duplicates(df, "id", columns).orderBy("id").collect()
        assert [r.is_duplicate for r in flags] == list(want)


def test_long_texts_differ_by_digest(spark):
    base = "y" * 5000
    df = spark.createDataFrame([(base + "1",), (base + "2",), (base + "1",), ("#short",)], "t string")
    assert duplicates.duplicate_profile(df).first().distinct_rows == 3


def test_digests_keep_values_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("abc", None), ("", "abc"), ("-", "x"), (None, "x")],
                               "s string, t string")
    assert duplicates.duplicate_profile(df).first().duplicates == 0
    maps = spark.sql("SELECT map('a', 1, 'b', 2) m, 0.0D z UNION ALL SELECT map('b', 2, 'a', 1), -0.0D")
    assert duplicates.duplicate_profile(maps).first().duplicates == 1


def test_row_ids_must_be_unique(spark):
    for ids in ((1, 1), (1, None)):
        df = spark.createDataFrame([(i, "x") for i in ids], "id long, s string")
        with pytest.raises(Exception, match="must be unique"):
            duplicates.flag_duplicates(df, "id", ["s"]).collect()


def test_nested_columns_can_be_compared(spark):
    df = spark.sql("SELECT map('a', 1) m, array(1.0D) a UNION ALL SELECT map('a', 1), array(1.0D)")
    assert duplicates.duplicate_profile(df).first().duplicates == 1


def test_column_samples(spark):
    rows = [(i, None if i % 3 else f"v{i}", i * 2) for i in range(50)]
    got = profile.column_samples(
        spark.createDataFrame(rows, "id long, s string, n int").repartition(5), "id", n=3).collect()
    values = {}
    for r in sorted(got, key=lambda r: (r.column, r.ordinal)):
        values.setdefault(r.column, []).append(r.value)
    assert values == {"s": ["v0", "v3", "v6"], "n": ["0", "2", "4"]}


def _groups(seed=3):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(v)) for v in rng.lognormal(3, 2, 30_000)]  # beyond the sketch
    rows += [("ties", float(v)) for v in rng.integers(0, 3, 25_000)]
    rows += [("few", float(v)) for v in (1.0, 2.0, 10.0)]
    rows += [("one", 5.0)]
    rows += [("wild", v) for v in (-1e300, 0.0, 1.0, 2.0, 3.0, 1e300)]
    return rows


def test_rows_without_a_group_form_one(spark):
    df = spark.createDataFrame([(None, float(v)) for v in (1, 2, 3, 4, 900)] + [("a", 1.0)], "g string, v double")
    assert [r.v for r in outliers.iqr_outliers(df, "v", "g").collect()] == [900.0]
    got = {r.g: (r.n, r.q1, r.q3, r.outliers) for r in outliers.outlier_profile(df, "v", "g").collect()}
    assert got == {None: (5, 2.0, 4.0, 1), "a": (1, 1.0, 1.0, 0)}


def test_third_of_all_rows_equal_in_one_group(spark):
    rows = [("hot", 0.0)] * 10_000 + [("hot", float(v)) for v in range(1, 20_001)]
    got = outliers.quartiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", "g").first()
    want = np.quantile([v for _, v in rows], [0.25, 0.75])
    assert (got.n, got.q1, got.q3) == (30_000, *want)


def test_quartiles_are_exact(spark):
    rows = _groups()
    df = spark.createDataFrame(rows + [("few", NAN), ("few", None)], "g string, v double").repartition(7)
    got = {r.g: r for r in outliers.quartiles(df, "v", "g").collect()}
    frame = pd.DataFrame(rows, columns=["g", "v"])
    for g, values in frame.groupby("g")["v"]:
        assert got[g].n == len(values)
        assert got[g].q1 == pytest.approx(np.quantile(values, 0.25), rel=1e-12)
        assert got[g].q3 == pytest.approx(np.quantile(values, 0.75), rel=1e-12)


@pytest.mark.parametrize("values", [
    np.arange(50_000) + 0.5,                                                        # all different
    np.nextafter(1.0, 2.0) + np.arange(40_000) * 2.0**-52,                          # neighbouring doubles
    -np.random.default_rng(5).lognormal(0, 40, 20_000),                             # all below zero, every size
    np.r_[np.zeros(999), np.full(501, 5e-324), np.full(500, -5e-324)],              # the least doubles there are
    np.r_[np.full(300, -np.inf), np.arange(900.0), np.full(600, np.inf)],
    np.r_[np.full(7, 3.0), 1e308, -1e308],
    np.array([1.0, 2.0]),
])
def test_quartiles_of_odd_values(spark, values):
    rows = pd.DataFrame({"v": np.random.default_rng(1).permutation(values)})
    df = spark.createDataFrame(rows).withColumn("g", F.lit("a"))
    got = outliers.quartiles(df.repartition(6), "v", "g").first()
    ranked = np.sort(values)
    for q, value in ((0.25, got.q1), (0.75, got.q3)):
        at = (len(ranked) - 1) * q
        a, b = ranked[int(np.floor(at))], ranked[int(np.ceil(at))]
        assert value == pytest.approx(a if a == b else a + (b - a) * (at % 1), rel=1e-15, abs=0)


def test_a_group_without_a_number_has_no_fences(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("b", NAN)], "g string, v double")
    got = {r.g: (r.n, r.q1, r.outliers) for r in outliers.outlier_profile(df, "v", "g").collect()}
    assert got == {"a": (1, 1.0, 0), "b": (0, None, 0)}
    assert outliers.quartiles(df.limit(0), "v", "g").collect() == []


def test_histogram_of_a_group_is_bounded(spark):
    """No step hands on more cells of a group than the histograms have, however many values there are."""
    df = spark.range(2_000_000).select(F.lit("a").alias("g"), (F.rand(3) + 1).alias("v"))
    cells = df.groupBy(outliers._octave_cell(F.col("v")).alias("c")).count()
    assert cells.count() == outliers.OCTAVE_CELLS
    wide = spark.createDataFrame(pd.DataFrame({"v": np.random.default_rng(2).lognormal(0, 200, 50_000)}))
    got = wide.select("v", outliers._octave_cell(F.col("v")).alias("c")).toPandas().sort_values("v")
    assert got.c.is_monotonic_increasing


def test_outliers_match_brute_force(spark):
    rows = [(i, *r) for i, r in enumerate(_groups())]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    frame = pd.DataFrame(rows, columns=["id", "g", "v"])
    want = set()
    for g, part in frame.groupby("g"):
        q1, q3 = np.quantile(part.v, 0.25), np.quantile(part.v, 0.75)
        low, high = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
        want |= set(part.id[(part.v < low) | (part.v > high)])
    found = outliers.iqr_outliers(df, "v", "g")
    assert {r.id for r in found.select("id").collect()} == want
    counts = {r.g: r.outliers for r in outliers.outlier_profile(df, "v", "g").collect()}
    assert sum(counts.values()) == len(want) and set(counts) == set(frame.g)


def test_salted_join_keeps_every_row(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i) for i in range(3000)]
    large = spark.createDataFrame(rows, "k string, v long")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("zz", 3)], "k string, w int")
    got = joins.salted_join(large, small, ["k"], ["v"], "left").collect()
    assert Counter(r.k for r in got) == Counter(k for k, _ in rows)
    assert {r.k: r.w for r in got} == {
        k: {"hot": 1, "k0": 2}.get(k) for k in {k for k, _ in rows}}


def test_quality_info(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "n int, s string")
    got = profile.quality_info(profile.null_profile(df).withColumn("dataset", F.lit("t")),
                               duplicates.duplicate_profile(df).withColumn("dataset", F.lit("t")))
    assert {r.message for r in got.collect()} == {
        "Column 's' has 66.7% missing values (exceeds recommended max: 20.0%)",
        "1 duplicate rows (33.3%) exceeds recommended threshold (5.0%)",
        "Dataset has 3 rows and 2 columns"}
