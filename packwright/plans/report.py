"""Reports and sinks for findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packwright.operators.catalog import level_badge

_RULE = "=" * 80
_SECTIONS = [("error", "ERRORS"), ("warning", "WARNINGS"), ("info", "DATA QUALITY METRICS")]
# Numbers of findings per block when lines are numbered.
_BLOCK = 10_000


def number_findings(findings: DataFrame) -> DataFrame:
    """Add ``number``: position of a finding among those of its dataset and severity.

    Findings are ordered by ``ordinal``, an integer unique within a dataset, or, where
    there is none, by scope, check, subject and message. Blocks are counted first and numbered on
    their own, so a dataset with very many findings is spread over its blocks; a block
    is a run of ordinals, or the findings of one scope, check and first letters of a subject.
    """
    if "ordinal" in findings.columns:
        block, order = F.floor(F.col("ordinal") / _BLOCK), ["ordinal"]
    else:
        block = F.struct("scope", "check", F.substring("subject", 1, 4).alias("start"))
        order = ["scope", "check", "subject", "message"]
    blocks = findings.withColumn("_block", block)
    counts = blocks.groupBy("dataset", "severity", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("dataset", "severity").orderBy("_block").rowsBetween(
        W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy("dataset", "severity", "_block").orderBy(*order)
    return (
        blocks.withColumn("_at", F.row_number().over(inside))
        .alias("f").join(offsets.alias("o"), (F.col("f.dataset") == F.col("o.dataset"))
                         & (F.col("f.severity") == F.col("o.severity"))
                         & F.col("f._block").eqNullSafe(F.col("o._block")))
        .select("f.*", "o._before")
        .withColumn("number", F.col("_at") + F.col("_before"))
        .drop("_at", "_before", "_block")
    )


def findings_report(findings: DataFrame, levels: DataFrame) -> DataFrame:
    """Report lines ``dataset, section, number, line`` for every dataset.

    Both are taken as ``validate_all`` gives them: ``findings`` is ``dataset, scope, subject,
    check, severity, message`` (or has an ``ordinal`` to order by), ``levels`` is ``dataset, errors,
    warnings, level``, and ``infos`` are counted where missing. Sorting by dataset, section and
    number gives the text; no dataset's report has to fit into one row or task.
    """
    if "infos" not in levels.columns:
        infos = findings.where("severity = 'info'").groupBy("dataset").agg(F.count(F.lit(1)).alias("infos"))
        levels = levels.join(infos, "dataset", "left").withColumn("infos", F.coalesce("infos", F.lit(0)))

    def line(section: int, number: int, text) -> F.Column:
        return F.struct(F.lit(section).alias("section"), F.lit(number).cast("long").alias("number"),
                        text.alias("line"))

    status = F.when(F.col("errors") == 0, "PASSED").otherwise("FAILED")
    heads = [
        line(0, 1, F.lit(_RULE)),
        line(0, 2, F.lit("VALIDATION REPORT")),
        line(0, 3, F.lit(_RULE)),
        line(0, 4, F.concat(F.lit("Dataset: "), F.col("dataset").cast("string"))),
        line(0, 5, F.concat(F.lit("Validation Level: "), level_badge(F.col("level")))),
        line(0, 6, F.concat(F.lit("Validation Status: "), status)),
        line(0, 7, F.concat(F.lit("Errors: "), F.col("errors").cast("string"))),
        line(0, 8, F.concat(F.lit("Warnings: "), F.col("warnings").cast("string"))),
        line(0, 9, F.concat(F.lit("Info Messages: "), F.col("infos").cast("string"))),
    ]
    for i, (severity, title) in enumerate(_SECTIONS, 1):
        count = F.col({"error": "errors", "warning": "warnings", "info": "infos"}[severity])
        heads.append(F.when(count > 0, line(i, 0, F.lit(title))))
    heads.append(line(9, 0, F.lit("END OF REPORT")))
    head_lines = levels.select("dataset", F.inline(F.array_compact(F.array(*heads))))
    section = F.lit(None).cast("int")
    for i, (severity, _) in enumerate(_SECTIONS, 1):
        section = F.when(F.col("severity") == severity, i).otherwise(section)
    numbered = number_findings(findings).select(
        "dataset", section.alias("section"), F.col("number").cast("long").alias("number"),
        F.concat(F.col("number").cast("string"), F.lit(". "), "message").alias("line"))
    return head_lines.unionByName(numbered)


def information_lines(tables: DataFrame) -> DataFrame:
    """Report lines on the tables: ``dataset, rows, columns, mapped`` gives four lines each."""
    lines = F.array(*[
        F.struct(F.lit(4).alias("section"), F.lit(i).cast("long").alias("number"), text.alias("line"))
        for i, text in enumerate((
            F.lit("DATASET INFORMATION"),
            F.concat(F.lit("Rows: "), F.col("rows").cast("string")),
            F.concat(F.lit("Columns: "), F.col("columns").cast("string")),
            F.concat(F.lit("Columns mapped: "), F.col("mapped").cast("string"))))
    ])
    return tables.select("dataset", F.inline(lines))


def mapping_lines(mapped: DataFrame) -> DataFrame:
    """Report lines on the mapping of every column, see ``apply_mappings``."""
    unit = F.coalesce(F.concat(F.lit(" (unit: "), "unit_id", F.lit(")")), F.lit(""))
    return mapped.select(
        "dataset", F.lit(5).alias("section"), (F.col("pos") + 1).cast("long").alias("number"),
        F.concat(F.lit("- "), "column", F.lit(": "), F.coalesce("concept_id", F.lit("Not mapped")),
                 unit).alias("line"))


def report_text(report: DataFrame, dataset) -> str:
    """Text of one dataset's report."""
    lines = report.where(F.col("dataset") == dataset).orderBy("section", "number")
    return "\n".join(row.line for row in lines.select("line").toLocalIterator())


def inconsistency_sink(inconsistencies: DataFrame, path: str) -> str | None:
    """Write inconsistencies as CSV with a header; None if there are none, and the folder is then empty of rows.

    The rows are computed once; whether there are any is seen in what was written.
    """
    columns = ["row", "column", "value", "actual_type", "expected_type"]
    inconsistencies.select(*columns).write.option("header", True).mode("overwrite").csv(path)
    written = inconsistencies.sparkSession.read.option("header", True).csv(path)
    return None if not written.columns or written.isEmpty() else path
