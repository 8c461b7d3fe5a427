"""Missing values and bounds judged from Parquet footers; only undecided row groups are read.

A footer holds the number of nulls, the least and the greatest value of every column in
every row group. That proves most rules without reading a value: a row group whose least
value is above a minimum holds no violation, one whose greatest value is below it holds
nothing else. What the footer leaves open is read, those columns of those row groups alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.value_types import is_numeric_type
from packwright.operators.constraints import Constraint
from packwright.session import local_table
from packwright.sources.package import _filesystem

# Tasks get this module by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that a task holds at a time of a row group that must be read.
READ_ROWS = 1 << 16

_RESULT = ("path string, row_group int, pos int, subject string, check string, rows long, n long, "
           "decided boolean, problem string")
_ARROW = pa.schema([
    ("path", pa.string()), ("row_group", pa.int32()), ("pos", pa.int32()), ("subject", pa.string()),
    ("check", pa.string()), ("rows", pa.int64()), ("n", pa.int64()), ("decided", pa.bool_()), ("problem", pa.string()),
])


@dataclass(frozen=True)
class Rule:
    """One countable rule on a column: ``nulls``, ``required``, ``minimum`` or ``maximum``."""

    pos: int
    column: str
    check: str
    bound: float | None = None


def rules_of(columns: list[str], constraints: list[Constraint] = ()) -> list[Rule]:
    """Missing values of every column, then the required, least and greatest values of constraints.

    Patterns, lists of values and uniqueness say nothing about a footer and are refused.
    """
    out = [Rule(pos, name, "nulls") for pos, name in enumerate(columns)]
    pos = 0
    for c in constraints:
        if c.unique or c.pattern is not None or c.enum:
            raise ValueError(f"Column {c.column}: only required, minimum and maximum can be judged from footers")
        for check, given, bound in (("required", c.required, None), ("minimum", c.minimum is not None, c.minimum),
                                    ("maximum", c.maximum is not None, c.maximum)):
            if given:
                out.append(Rule(pos, c.column, check, bound))
                pos += 1
    return out


def _proven(rule: Rule, rows: int, stats, kind: pa.DataType) -> int | None:
    """Violations that the statistics of a column in a row group prove; None if they leave it open.

    NaN counts as missing but is neither null nor in the bounds of a footer, so the number of
    missing values of a float column is open unless all are null.
    """
    if rows == 0:
        return 0
    if stats is None or not stats.has_null_count:
        return None
    nulls, floating = stats.null_count, pa.types.is_floating(kind)
    if rule.check in ("nulls", "required"):
        return nulls if nulls == rows or not floating else None
    if nulls == rows:
        return 0
    if not stats.has_min_max or not (pa.types.is_integer(kind) or floating):
        return None
    low, high = stats.min, stats.max
    if low != low or high != high:  # a writer that put NaN into the bounds
        return None
    # Every value that counts violates; without NaN these are all that are not null.
    all_of_them = None if floating else rows - nulls
    if rule.check == "minimum":
        return 0 if low >= rule.bound else all_of_them if high < rule.bound else None
    return 0 if high <= rule.bound else all_of_them if low > rule.bound else None


def _counted(rule: Rule, values: pa.Array) -> int:
    """Violations among values that were read."""
    missing = pc.is_null(values, nan_is_null=True)
    if rule.check in ("nulls", "required"):
        hit = missing
    else:
        if pa.types.is_decimal(values.type):
            values = values.cast(pa.float64())
        compare = pc.less if rule.check == "minimum" else pc.greater
        hit = pc.and_(pc.invert(missing), pc.fill_null(compare(values, rule.bound), False))
    return pc.sum(hit).as_py() or 0


def _open_footer(path: str):
    fs, target = _filesystem(path)
    return pq.ParquetFile(fs.open_input_file(target), memory_map=False, pre_buffer=False)


def _judge(rules: list[Rule], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file, row group and rule, proven or open; one row with the problem of an unreadable file."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows: list[dict] = []
            try:
                with _open_footer(path) as footer:
                    places = {footer.schema.column(i).path: i for i in range(len(footer.schema))}
                    kinds = {f.name: f.type for f in footer.schema_arrow}
                    for group in range(footer.metadata.num_row_groups):
                        about = footer.metadata.row_group(group)
                        for r in rules:
                            at = places.get(r.column)
                            if r.column not in kinds:
                                # A file written before the column was added holds only nulls there.
                                n = about.num_rows if r.check in ("nulls", "required") else 0
                            else:
                                stats = None if at is None else about.column(at).statistics
                                n = _proven(r, about.num_rows, stats, kinds[r.column])
                            rows.append({"path": path, "row_group": group, "pos": r.pos, "subject": r.column, "check": r.check,
                                         "rows": about.num_rows, "n": n, "decided": n is not None, "problem": None})
            except (pa.ArrowInvalid, OSError) as problem:
                rows = [{"path": path, "problem": str(problem).splitlines()[0]}]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _settle(rules: list[Rule], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass on what is proven of a row group and count what is open, in one read of the columns asked."""
    by_place = {(r.pos, r.check): r for r in rules}
    for batch in batches:
        for row in batch.to_pylist():
            if row["problem"] is not None:
                raise ValueError(f"cannot read {row['path']}: {row['problem']}")
            found = {(p["pos"], p["check"]): p["n"] for p in row["places"]}
            wanted = [by_place[place] for place, n in found.items() if n is None]
            counts = {r: 0 for r in wanted}
            if wanted:
                with _open_footer(row["path"]) as source:
                    columns = sorted({r.column for r in wanted})
                    for part in source.iter_batches(READ_ROWS, row_groups=[row["row_group"]], columns=columns):
                        for r in wanted:
                            counts[r] += _counted(r, part.column(part.schema.get_field_index(r.column)))
            yield pa.RecordBatch.from_pylist([
                {"path": row["path"], "row_group": row["row_group"], "pos": pos, "subject": by_place[pos, check].column,
                 "check": check, "rows": row["rows"], "n": counts[by_place[pos, check]] if n is None else n,
                 "decided": n is not None, "problem": None} for (pos, check), n in found.items()], schema=_ARROW)


def zone_map(spark: SparkSession, path: str, rules: list[Rule], tasks: int | None = None) -> DataFrame:
    """``path, row_group, pos, subject, check, rows, n, decided, problem`` of every rule in every row group.

    ``n`` is the number of violations where the footer proves it, else null. A file that cannot be
    read is one row with its ``problem``. Footers are read by many tasks; no value is.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True).load(path).select("path")
    ).repartition(tasks or spark.sparkContext.defaultParallelism * 4, "path")
    return files.mapInArrow(lambda batches: _judge(rules, batches), _RESULT)


def footer_counts(spark: SparkSession, path: str, rules: list[Rule], tasks: int | None = None) -> DataFrame:
    """``pos, subject, check, rows, n, row_groups, row_groups_read`` per rule, as a scan would count.

    ``row_groups_read`` of the rule's ``row_groups`` were open and had to be read. An unreadable
    file ends the job, as it would end the scan; ``zone_map`` shows which one it is. A folder
    without row groups gives counts of 0. A row group is read once for all of its open rules.
    """
    # Row groups, each of which may be a long read, are spread one by one.
    spread = zone_map(spark, path, rules, tasks).repartition(
        tasks or spark.sparkContext.defaultParallelism * 4, "path", "row_group")
    groups = spread.groupBy("path", "row_group").agg(
        F.max("rows").alias("rows"), F.max("problem").alias("problem"),
        F.collect_list(F.struct("pos", "check", "n")).alias("places"))
    counted = groups.mapInArrow(lambda batches: _settle(rules, batches), _RESULT).groupBy("pos", "subject", "check").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("row_groups"),
        F.count_if(~F.col("decided")).alias("row_groups_read"))
    named = local_table(spark, [(r.pos, r.column, r.check) for r in rules], "pos int, subject string, check string")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "n", "row_groups", "row_groups_read")]
    return named.join(counted, ["pos", "subject", "check"], "left").select("pos", "subject", "check", *zero)


def footer_profile(spark: SparkSession, path: str, constraints: list[Constraint] = (),
                   tasks: int | None = None) -> DataFrame:
    """Missing values of all columns and violations of bounds in a Parquet file or folder, see ``footer_counts``.

    ``pos`` numbers the columns for ``nulls`` and the rules for the others, as in ``count_checks``.
    Columns are those that Spark reads; one that some files lack is null there. Bounds are for
    columns of numbers.
    """
    schema = spark.read.parquet(path).schema
    for c in constraints:
        if (c.minimum is not None or c.maximum is not None) and not is_numeric_type(schema[c.column].dataType):
            raise ValueError(f"Column {c.column} holds no numbers that bounds could judge")
    return footer_counts(spark, path, rules_of(schema.names, constraints), tasks)
