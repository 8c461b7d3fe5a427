from pyspark.sql import functions as F

import corpus_pipeline
from packwright.llm.lines import drop_spread_lines


def test_odd_rows(spark):
    sites = [f"s{i}" for i in range(9)]
    rows = [(i, f"own text number {i} is long enough to stay\n  Cookie notice \n\nend {i}", s) for i, s in enumerate(sites)]
    rows += [(20, "own two that only four sites have\nrare", s) for s in sites[:4]]
    rows += [(30, None, "s0"), (31, "", "s1"), (32, "Cookie notice", None), (None, "long line of its own here\nCookie notice", "s1"),
             (33, "Cookie notice\nshort", "s2"), (34, "a\n" * 50000 + "Cookie notice", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("spread", F.lit(1)).withColumn("row", F.lit(2))
    out = drop_spread_lines(df)
    assert out.columns == [*df.columns, "line_dedup"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.line_dedup.n_lines, r.line_dedup.n_removed))
    for i in range(9):
        assert got[i] == [(f"own text number {i} is long enough to stay\n\nend {i}", 4, 1)]
    assert got[20] == [("own two that only four sites have\nrare", 2, 0)] * 4
    assert got[30] == [(None, 0, 0)] and got[31] == [("", 1, 0)]
    assert got[32] == [("Cookie notice", 1, 0)]  # it would lose all
    assert got[None] == [("long line of its own here", 2, 1)]
    assert got[33] == [("short", 2, 1)]  # it loses over half
    assert got[34][0][1:] == (50001, 1)
    assert drop_spread_lines(df.limit(0)).count() == 0


def test_near_threshold_is_exact(spark):
    rows = [(n * 100 + k, f"line on {n}\n" + f"padding {n} {k} " * 5, f"s{k}") for n in range(1, 12) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.line_dedup.n_removed for r in drop_spread_lines(df).collect()}
    assert got == {d: int(d // 100 >= 5) for d, _, _ in rows}


def test_pipeline_cuts_whatever_the_share(spark):
    """Short texts under a long banner lose it; only copies, which have no line of their own, stay whole."""
    banner = "Accept all of the cookies of this site and of its many partners"
    rows = [(i, f"{banner}\nown {i}", f"s{i}") for i in range(6)] + [(7, f" {banner}\n\n{banner}", "s0"), (8, banner, "s1"), (9, None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "length(text) AS n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert got == {i: (f"own {i}", 5) for i in range(6)} | {i: (t, t and len(t)) for i, t, _ in rows[6:]}
