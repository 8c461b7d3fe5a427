"""Write, audit, publish: the audit's counts are taken by the pass that writes, and a gate stands before the result is seen.

A table is written to a staging folder beside its place. Missing values, constraints, user rules and the types of raw columns are
observed in that very pass; what needs a shuffle (repeated rows, keys) is read from the staged files, so what was audited is
what is published. Findings are written in either case; data takes its place only if the gate lets it.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from packwright.functions.value_types import VALUE_TYPES, value_type
from packwright.operators import catalog, duplicates, profile
from packwright.operators.constraints import constraint_checks, key_profile
from packwright.operators.profile import Check
from packwright.plans import validate as V
from packwright.plans.validate import Dataset
from packwright.session import local_table
from packwright.sources.package import pack_write, qualified

COUNTS = "kind string, pos int, subject string, check string, severity string, n long, rows long"
EMPTY_MESSAGE = "The table is empty"


@dataclass
class Published:
    """Outcome of a run: whether the data was published, with what level, and its findings as a written table."""

    path: str
    published: bool
    level: str
    rows: int
    findings: DataFrame


def row_checks(dataset: Dataset) -> list[Check]:
    """All checks of a dataset that one pass over its rows can count."""
    return profile.null_checks(dataset.df) + constraint_checks(dataset.df, V.declared_constraints(dataset), dataset.rules, dataset.table_rules)


def observe_checks(dataset: Dataset, checks: list[Check]) -> tuple[DataFrame, Observation]:
    """The table with an observation of its checks and of the types of its raw columns, taken as its rows stream by."""
    types = {f"_type_{i}": value_type(F.col(f"`{c}`")) for i, c in enumerate(dataset.raw_columns)}
    row = F.col(f"`{dataset.row_id}`") if dataset.row_id else F.lit(None).cast("long")
    metrics = [F.count(F.lit(1)).alias("rows"), *(c.counted().alias(f"n{i}") for i, c in enumerate(checks))]
    for name in types:
        for k, kind in enumerate(VALUE_TYPES):
            metrics += [F.count_if(F.col(name) == kind).alias(f"{name}_{k}"), F.min(F.when(F.col(name) == kind, row)).alias(f"{name}_{k}_first")]
    observation = Observation()
    return dataset.df.withColumns(types).observe(observation, *metrics).drop(*types), observation


def observed_counts(spark: SparkSession, checks: list[Check], seen: dict) -> DataFrame:
    """Observed values in the form of ``count_checks``."""
    return local_table(spark, [(c.kind, c.pos, c.subject, c.check, c.severity, seen[f"n{i}"], seen["rows"])
                               for i, c in enumerate(checks)], COUNTS)


def observed_tally(spark: SparkSession, dataset: Dataset, seen: dict) -> DataFrame:
    """Observed types of raw columns in the form of ``type_tally``; without a row id, types come in the order of their names."""
    rows = [(dataset.name, c, kind, seen[f"_type_{i}_{k}"], seen[f"_type_{i}_{k}_first"])
            for i, c in enumerate(dataset.raw_columns) for k, kind in enumerate(VALUE_TYPES) if seen[f"_type_{i}_{k}"]]
    first = dataset.df.schema[dataset.row_id].dataType.simpleString() if dataset.row_id else "long"
    return local_table(spark, rows, f"dataset string, column string, value_type string, n long, first_row {first}")


def audit(dataset: Dataset, checks: list[Check], seen: dict, staged: DataFrame) -> DataFrame:
    """All findings on a dataset: those of ``validate_all``, row checks from what was observed."""
    spark, named = staged.sparkSession, F.lit(dataset.name).alias("dataset")
    described = V.descriptor_table([dataset])
    parts = [catalog.explode_findings(described, "dataset", catalog.descriptor_findings(
        F.col("descriptor"), F.col("key_types"), resource_types=F.col("resource_types"))).select(*V.FINDING_COLUMNS)]
    counts = observed_counts(spark, checks, seen).withColumn("dataset", named)
    parts.append(profile.quality_info(profile.null_counts(counts, "dataset"), duplicates.duplicate_profile(staged).withColumn("dataset", named))
                 .withColumn("scope", F.lit("data_quality")).select(*V.FINDING_COLUMNS))
    parts.append(V.constraint_findings(counts))
    parts += [V.key_findings(key_profile(staged, key).withColumns({"key": F.lit(", ".join(key)), "dataset": named}))
              for key in V.unique_keys(dataset)]
    if dataset.raw_columns:
        declared = V.fields_table([dataset]).select("dataset", F.col("name").alias("column"), "type")
        parts.append(V.raw_findings(observed_tally(spark, dataset, seen), declared).select(*V.FINDING_COLUMNS))
    from_schema = V.schema_findings([dataset])
    if from_schema is not None:
        parts.append(from_schema)
    faults = V.declaration_faults(dataset)
    if faults:
        parts.append(local_table(spark, faults, V.FINDING_SCHEMA))
    parts += V.metadata_rule_findings([dataset], described)
    return V.union_all(parts)


def publish(dataset: Dataset, path: str, findings_path: str, max_errors: int = 0) -> Published:
    """Write a package, audit it and publish it if it has at most ``max_errors`` errors.

    ``findings_path`` gets a table of the findings with ``level`` and ``published``, in either case, in a folder of the dataset's own that a
    later run of the same dataset replaces; no other dataset is touched. A refused run leaves what was published before as it is and
    removes its staging folder; one that died before the gate leaves nothing but its staging folder, which no reader of the place sees.
    An empty table is refused.
    """
    df, spark = dataset.df, dataset.df.sparkSession
    place = qualified(spark, path.rstrip("/"))
    out = posixpath.join(qualified(spark, findings_path.rstrip("/")), f"dataset={dataset.name}")
    staging = posixpath.join(posixpath.dirname(place), f"_staging-{posixpath.basename(place)}-{uuid.uuid4().hex}")
    files = _Files(spark)
    if df.isEmpty():
        found = local_table(spark, [(dataset.name, "data_quality", None, "empty", "error", EMPTY_MESSAGE)],
                            V.FINDING_SCHEMA)
        return _settle(found, False, "invalid", 0, place, out)
    checks = row_checks(dataset)
    observed, observation = observe_checks(dataset, checks)
    try:
        pack_write(observed, dataset.descriptor, staging)
        seen = observation.get
        # A dataset has a bounded number of findings.
        found = audit(dataset, checks, seen, spark.read.schema(df.schema).parquet(staging))
        kept = spark.createDataFrame(found.collect(), found.schema)
        level = catalog.compliance_level(kept, V.descriptor_table([dataset])).first()
        ok = level["errors"] <= max_errors
        if ok:
            files.replace(staging, place)
        result = _settle(kept, ok, level["level"], seen["rows"], place, out)
    finally:
        files.delete(staging)
    return result


def _settle(found: DataFrame, ok: bool, level: str, rows: int, place: str, out: str) -> Published:
    found.drop("dataset").withColumns({"level": F.lit(level), "published": F.lit(ok)}).coalesce(1).write.mode("overwrite").parquet(out)
    base, _, name = out.rpartition("/dataset=")
    written = found.sparkSession.read.parquet(out).withColumn("dataset", F.lit(name))
    return Published(place, ok, level, rows, written.select(*V.FINDING_COLUMNS, "level", "published"))


class _Files:
    """Renaming and removing folders on whatever file system a path is on."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        own = self.jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.conf), own

    def delete(self, path: str) -> None:
        fs, own = self._at(path)
        fs.delete(own, True)

    def replace(self, source: str, target: str) -> None:
        """Put a folder in the place of another; the old one is there until the new one is ready to take over."""
        fs, new = self._at(source)
        _, place = self._at(target)
        _, old = self._at(f"{source}-old")
        if fs.exists(place) and not fs.rename(place, old):
            raise OSError(f"could not move {target}")
        if not fs.rename(new, place):
            if fs.exists(old):
                fs.rename(old, place)
            raise OSError(f"could not move {source} to {target}")
        fs.delete(old, True)
