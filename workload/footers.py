"""Queries answered from file footers, with reads of what they leave open."""

from pyspark.sql import functions as F

from packwright.operators.constraints import Constraint
from packwright.plans.validate import union_all
from packwright.sources import footer_profile
from workload.registry import query

_COLUMNS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}
# Column, least and greatest value. Keys lie within theirs or wholly beyond, measures partly.
_BOUNDS = {
    "lineitem": [("l_orderkey", 0, None), ("l_partkey", None, -1), ("l_linenumber", 2, 5), ("l_quantity", 10, 40.5),
                 ("l_discount", 0, 0.05), ("l_tax", -1, 1)],
    "orders": [("o_orderkey", 0, None), ("o_custkey", 10, None), ("o_totalprice", 1000, 100000)],
}


def _counted(table, pos, column, check, condition):
    return (f"SELECT '{table}' AS dataset, {pos} AS pos, '{column}' AS subject, '{check}' AS \"check\", "
            f"count(*) AS rows, count(CASE WHEN {condition} THEN 1 END) AS n FROM {table}")


def _footer_sql():
    parts = []
    for table, columns in _COLUMNS.items():
        parts += [_counted(table, pos, c, "nulls", f"{c} IS NULL" + (f" OR isnan({c})" if c in _FLOATS else ""))
                  for pos, c in enumerate(columns)]
        rules = [(c, check, f"{c} {sign} {bound}") for c, low, high in _BOUNDS[table]
                 for check, sign, bound in (("minimum", "<", low), ("maximum", ">", high)) if bound is not None]
        parts += [_counted(table, pos, c, check, condition + (f" AND NOT isnan({c})" if c in _FLOATS else ""))
                  for pos, (c, check, condition) in enumerate(rules)]
    return " UNION ALL ".join(parts)


_FLOATS = {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"}


@query("footer_profile", _footer_sql())
def profile_from_footers(spark, sf_dir):
    return union_all([
        footer_profile(spark, f"{sf_dir.rstrip('/')}/{table}.parquet",
                       [Constraint(c, minimum=low, maximum=high) for c, low, high in bounds])
        .select(F.lit(table).alias("dataset"), "pos", "subject", "check", "rows", "n")
        for table, bounds in _BOUNDS.items()])
