"""CSV records that do not fit their schema: found, placed, told apart by kind and counted, instead of turned into nulls."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "_record"
KINDS = ("too_few_fields", "too_many_fields", "bad_value", "unreadable")


class BadRecords(ValueError):
    """More records are bad than allowed; ``counts`` says how many of which kind, by file."""

    def __init__(self, message: str, counts: DataFrame):
        super().__init__(message)
        self.counts = counts


@dataclass
class CsvRecords:
    """Records of CSV files with a schema.

    ``all`` holds the schema's columns (values that do not fit are null), ``_record`` (the text of a bad record, else null),
    ``_file``, ``_block`` (where the split that the record was read in begins) and ``_at`` (its place in the order of reading).
    """

    all: DataFrame
    schema: T.StructType
    separator: str

    @property
    def good(self) -> DataFrame:
        """Rows of the records that fit."""
        return self.all.where(F.col(RAW).isNull()).select(*_names(self.schema))

    @property
    def bad(self) -> DataFrame:
        """``file, record, kind, column, value, text``: one row for each bad record, or for each of its bad values.

        ``record`` counts the records of a file from 1, without header and empty lines. Records are counted per split, and splits
        add up per file, so no task reads a file in order.
        """
        splits = self.all.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        # A file has few splits.
        before = F.transform(F.filter("_splits", lambda s: s["_block"] < F.col("_own._block")), lambda s: s["_n"])
        starts = (splits.groupBy("_file").agg(F.collect_list(F.struct("_block", "_n", "_first")).alias("_splits"))
                  .select("_file", "_splits", F.explode("_splits").alias("_own"))
                  .select("_file", F.col("_own._block").alias("_block"), F.col("_own._first").alias("_first"),
                          F.aggregate(before, F.lit(0).cast("long"), lambda a, b: a + b).alias("_before")))
        found = self.all.where(F.col(RAW).isNotNull()).join(starts, ["_file", "_block"])
        place = (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("record")
        return found.select(F.col("_file").alias("file"), place, F.inline(self._faults()), F.col(RAW).alias("text"))

    def _faults(self) -> Column:
        names = [f.name for f in self.schema.fields]
        fields = field_count(F.col(RAW), self.separator)
        raw = F.from_csv(F.col(RAW), F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"sep": self.separator, "escape": '"', "mode": "PERMISSIVE"})

        def line(kind: str, column: Column, value: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), column.alias("column"), value.alias("value"))

        none = F.lit(None).cast("string")
        wrong = F.array_compact(F.array(*(
            F.when(F.col(_quoted(name)).isNull() & raw[f"c{i}"].isNotNull(), line("bad_value", F.lit(name), raw[f"c{i}"]))
            for i, name in enumerate(names))))
        return (F.when(fields < len(names), F.array(line("too_few_fields", none, fields.cast("string"))))
                .when(fields > len(names), F.array(line("too_many_fields", none, fields.cast("string"))))
                .when(F.size(wrong) > 0, wrong).otherwise(F.array(line("unreadable", none, none))))

    def counts(self) -> DataFrame:
        """``file, kind, records, share``: all records of each file, and bad ones by kind, counted in one pass.

        A record counts once, under the first of ``KINDS`` that applies.
        """
        kind = F.coalesce(F.when(F.col(RAW).isNotNull(), self._faults()[0]["kind"]), F.lit("good"))
        per = self.all.select(F.col("_file").alias("file"), kind.alias("kind")).groupBy("file").agg(
            F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
        return per.select("file", F.inline(F.array(*(
            F.struct(F.lit(k).alias("kind"), F.col(k).alias("records"), (F.col(k) / F.col("all")).alias("share")) for k in ("all", *KINDS)))))

    def findings(self, dataset: str, max_share: float = 0.0) -> DataFrame:
        """Bad records by kind as findings over all files: errors where their share of the records exceeds ``max_share``, else warnings."""
        whole = self.counts().groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("records"))), F.lit(0)).alias(k) for k in ("all", *KINDS)))
        bad = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
        lines = F.array_compact(F.array(*(F.when(F.col(k) > 0, F.struct(
            F.lit(f"csv_{k}").alias("check"), F.format_string(f"%d of %d records: {k.replace('_', ' ')}", k, "all").alias("message"))) for k in KINDS)))
        severity = F.when(bad > max_share * F.col("all"), "error").otherwise("warning")
        return whole.select(severity.alias("severity"), F.inline(lines)).select(
            F.lit(dataset).alias("dataset"), F.lit("data_quality").alias("scope"), F.lit(None).cast("string").alias("subject"),
            "check", "severity", "message")

    def require(self, max_share: float = 0.0) -> DataFrame:
        """The good rows; raises ``BadRecords`` if a larger share of the records is bad."""
        counts = self.counts().groupBy("kind").agg(F.sum("records").alias("n")).collect()
        n = {r["kind"]: r["n"] for r in counts}
        bad = sum(n.get(k, 0) for k in KINDS)
        if bad > max_share * n.get("all", 0):
            raise BadRecords(f"{bad} of {n['all']} records do not fit the schema: " + ", ".join(
                f"{n[k]} {k}" for k in KINDS if n.get(k)), self.counts())
        return self.good


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _names(schema: T.StructType) -> list[Column]:
    return [F.col(_quoted(f.name)) for f in schema.fields]


def field_count(record: Column, separator: str = ",") -> Column:
    """Number of fields of a record's text; separators within quotes do not count, and a quote within quotes is doubled."""
    bare = F.regexp_replace(record, '"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1


def read_csv_records(spark: SparkSession, path: str | list[str], schema: T.StructType | str, header: bool = True,
                     separator: str = ",") -> CsvRecords:
    """CSV files with a schema, bad records kept: too few or too many fields, or values that are not of their column's type.

    Every column is parsed, as a record that is read in part only is not known to be bad. Empty values are nulls and never bad. A header
    is skipped, not compared. Columns of the schema must not be called like those added (``_record``, ``_file``, ``_block``, ``_at``).
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = {RAW, "_file", "_block", "_at"} & {f.name for f in schema.fields}
    if taken:
        raise ValueError(f"columns must not be called {', '.join(sorted(taken))}")
    if len(separator) != 1 or re.match(r'["\\\n\r]', separator):
        raise ValueError("separator must be one character, no quote, backslash or line end")
    nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])
    rows = (spark.read.schema(T.StructType([*nullable.fields, T.StructField(RAW, T.StringType())]))
            .option("header", header).option("sep", separator).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).csv(path))
    # The hash makes every query parse all columns.
    whole = F.coalesce(F.when(F.xxhash64(*_names(nullable)) == 0, F.col(RAW)), F.col(RAW)).alias(RAW)
    rows = rows.select(*_names(nullable), whole, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_at"))
    return CsvRecords(rows, nullable, separator)
