"""Rules as rows: two versions of the standard side by side over the catalogue of parts."""

from pyspark.sql import functions as F

from packwright import standard as S
from packwright.operators.rulebook import RULE_SCHEMA, load_rules, rule_findings, standard_rules
from packwright.session import local_table, shared_dir
from workload.descriptors import _BASE, CHECK_SQL, _line, part_packages
from workload.registry import query

_VERSION_SQL = "CASE WHEN dataset % 50 = 0 THEN '3.0.0' WHEN dataset % 2 = 0 THEN '1.0.0' ELSE '2.0.0' END"
# What version 2.0.0 changes: longer titles, sources may be none, three keywords, homepages with https.
_FEW_KEYWORDS = "At least 3 keywords are needed, got {size}"
_CHANGED = [
    _line("meta_string_rules", "error", "'title'", "'Minimum length is 30, got ' || length(title)", "pk", "length(title) < 30"),
    _line("meta_array_rules", "error", "'keywords'", "'At least 3 keywords are needed, got ' || n_keywords", "pk", "n_keywords < 3"),
    _line("meta_url_rules", "warning", "'homepage'", "'Homepage ''' || homepage || ''' is not safe'", "pk",
          "NOT regexp_matches(homepage, '^https://')"),
]


def _of_version(version: str, lines: list[str]) -> str:
    return (f"SELECT f.*, v.version FROM ({' UNION ALL '.join(lines)}) f JOIN versions v ON f.dataset = v.dataset "
            f"WHERE v.version = '{version}'")


_ONE = [line for lines in CHECK_SQL.values() for line in lines]
_TWO = [line for line in _ONE if not ("'meta_array_rules'" in line and "'sources'" in line)
        and not ("length(title) < 5" in line)] + _CHANGED


@query("versioned_rules", f"""WITH {_BASE}, versions AS (SELECT dataset, {_VERSION_SQL} AS version FROM pk)
{_of_version('1.0.0', _ONE)} UNION ALL {_of_version('2.0.0', _TWO)}
UNION ALL SELECT dataset, 'metadata', NULL, 'unknown_version', 'error', 'No rules for version ''3.0.0''', '3.0.0'
FROM versions WHERE version = '3.0.0'""")
def versioned_rules(spark, sf_dir):
    own = local_table(spark, [
        ("2.0.0", 100, "metadata", "$.title", "title", "min_length", 30.0, None, None, "meta_string_rules", "error",
         "Minimum length is {number}, got {length}"),
        ("2.0.0", 101, "metadata", "$.keywords", "keywords", "min_items", 3.0, None, None, "meta_array_rules", "error", _FEW_KEYWORDS),
        ("2.0.0", 102, "metadata", "$.homepage", "homepage", "pattern", None, "^https://", None, "meta_url_rules", "warning",
         "Homepage '{value}' is not safe"),
    ], RULE_SCHEMA)
    second = standard_rules(spark, "2.0.0").where(~((F.col("kind") == "min_items") & (F.col("subject") == "sources"))
                                                  & ~((F.col("kind") == "min_length") & (F.col("subject") == "title")))
    path = shared_dir(spark)
    standard_rules(spark).unionByName(second).unionByName(own).write.json(path)
    dataset = F.col("dataset")
    packages = part_packages(spark, sf_dir).select(
        dataset, F.when(dataset % 50 == 0, "3.0.0").when(dataset % 2 == 0, S.VERSION).otherwise("2.0.0").alias("version"),
        F.to_json("descriptor").alias("descriptor_json"))
    return rule_findings(packages, load_rules(spark, path))
