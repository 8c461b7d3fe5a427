from pyspark.sql import functions as F

from packwright.plans import Dataset, validate_all
from packwright.plans.report import findings_report, report_text


def test_report_of_a_validation(spark):
    """The report takes what a validation gives, as it is."""
    df = spark.createDataFrame([(1, None), (1, "b"), (1, "b")], "n int, s string")
    fields = [{"name": "n", "type": "boolean"}, {"name": "s", "type": "string", "constraints": {"required": True}},
              {"name": "gone", "type": "string"}]
    findings, levels = validate_all([Dataset("t", df, {"name": "t", "resources": [{"schema": {"fields": fields}}]})])
    rows = findings.collect()
    text = report_text(findings_report(findings, levels), "t")
    for severity, title in (("error", "Errors"), ("warning", "Warnings"), ("info", "Info Messages")):
        assert f"{title}: {sum(r.severity == severity for r in rows)}" in text
    for r in rows:
        assert r.message in text
    numbered = findings_report(findings, levels).where("number > 0 AND section BETWEEN 1 AND 3")
    for r in numbered.groupBy("section").agg(F.sort_array(F.collect_list("number")).alias("n")).collect():
        assert r.n == list(range(1, len(r.n) + 1))
