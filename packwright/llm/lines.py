"""Removal of lines that many sites share, with HyperLogLog sketches of each line's sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import materialize

#: Sites from which on a line is boilerplate.
MIN_SITES = 5
#: Registers of a sketch, as a power of two: a standard error of 3 %.
SKETCH_BITS = 10
#: Lines whose estimate is within this share of the threshold are counted exactly: over ten standard errors.
BAND = 0.5


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" "))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column, part: int) -> Column:
    return F.xxhash64(F.lit(part), line)


def spread_lines(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h0, h1): 128-bit hashes of the lines that occur on ``min_sites`` sites or more.

    Every line hash has one sketch of its sites, merged from the tasks' partial sketches. An
    estimate far from the threshold decides; those near it are decided by an exact count of
    distinct sites, so the result is exact.
    """
    found = (df.select(F.explode(_lines(F.col(text))).alias("line"), F.col(site).cast("string").alias("site"))
             .select(_trimmed(F.col("line")).alias("line"), "site").where("line != ''")
             .select(_hash(F.col("line"), 0).alias("h0"), _hash(F.col("line"), 1).alias("h1"), "site"))
    sketched = materialize(
        found.groupBy("h0", "h1").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
        .select("h0", "h1", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - BAND)))
    near = sketched.where(F.col("sites") < min_sites * (1 + BAND)).select("h0", "h1")
    exact = (found.where("site is not null").join(near, ["h0", "h1"], "left_semi").distinct()
             .groupBy("h0", "h1").count().where(F.col("count") >= min_sites).select("h0", "h1"))
    return materialize(
        sketched.where(F.col("sites") >= min_sites * (1 + BAND)).select("h0", "h1").unionByName(exact))


def drop_spread_lines(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
                      max_loss: float | None = None) -> DataFrame:
    """``df`` with the lines that ``min_sites`` sites or more share cut out of ``text``; all rows stay.

    Lines end at a line feed and are compared without the spaces around them; blank lines are kept and
    never counted. A null site is no site. A document whose lines would all go is a copy of others and left whole, for
    near-duplicate detection to judge; with ``max_loss`` one that would lose more than this share of its characters is as well. A null
    text stays null, an empty one empty. Repeated rows are treated alike; very long texts are read whole. An empty table gives none. Columns that ``df`` has besides are kept
    whatever their names; two are added as a struct ``line_dedup`` (in place of a column of that name): n_lines and n_removed
    (0 for null).
    """
    spread = spread_lines(df, text, site, min_sites)
    # Which hashes a text holds depends on the text alone, so equal texts share one entry.
    held = (df.select(F.xxhash64(text).alias("text_hash"), F.explode(_lines(F.col(text))).alias("line"))
            .select("text_hash", _trimmed(F.col("line")).alias("line")).where("line != ''")
            .select("text_hash", _hash(F.col("line"), 0).alias("h0"), _hash(F.col("line"), 1).alias("h1"))
            .join(spread, ["h0", "h1"], "left_semi").distinct()
            .groupBy("text_hash").agg(F.collect_set("h0").alias("spread")))
    rows = df.select(F.struct("*").alias("row"), F.xxhash64(text).alias("text_hash"))
    # One shuffle of the texts at any size: how many texts hold spread lines grows with the corpus.
    joined = rows.join(materialize(held).hint("merge"), "text_hash", "left")
    body, held_some = F.col("row")[text], F.col("spread").isNotNull()
    cut = lambda line: F.array_contains("spread", _hash(_trimmed(line), 0)) & (_trimmed(line) != "")
    chars = lambda kept: F.aggregate(kept, F.lit(0).cast("long"),
                                     lambda n, line: n + F.length(_trimmed(line)))
    out = joined.select("row", "spread", F.when(held_some, _lines(body)).alias("lines"))
    out = out.select("row", "lines", F.when(held_some, F.filter("lines", lambda line: ~cut(line))).alias("tidy"))
    left = chars(F.col("tidy"))
    fits = left > 0 if max_loss is None else chars(F.col("lines")) - left <= max_loss * chars(F.col("lines"))
    out = out.select("row", "lines", "tidy", F.coalesce(fits, F.lit(False)).alias("cut"))
    out = out.select("row", F.when(F.col("cut"), F.array_join("tidy", "\n")).otherwise(body).alias("body"),
                     F.when(F.col("cut"), F.size("lines") - F.size("tidy")).otherwise(0).alias("n_removed"))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(_lines(body)))
    return out.select(*(F.col("body").alias(text) if c == text else F.col("row")[c].alias(c) for c in df.columns if c != "line_dedup"),
                      F.struct(n_lines.alias("n_lines"), "n_removed").alias("line_dedup"))


#: The digest of ``drop_spread_lines`` in DuckDB.
DIGEST_SQL = f"""
WITH lines AS (
  SELECT source, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
spread AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
numbered AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         unnest(string_split(text, chr(10))) AS line FROM documents),
marked AS (
  SELECT n.*, s.line IS NOT NULL AS cut FROM numbered n LEFT JOIN spread s ON trim(n.line, ' ') = s.line),
judged AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_cut,
         coalesce(sum(length(trim(line, ' '))) FILTER (WHERE NOT cut), 0) > 0 AS fits,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '') AS tidy
  FROM marked GROUP BY doc_id, text)
SELECT doc_id, n_lines, CASE WHEN fits THEN n_cut ELSE 0 END AS n_removed,
       sha256(CASE WHEN fits THEN tidy ELSE text END) AS kept_sha256
FROM judged
"""
