"""Building descriptors and the stored configurations they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright import standard as S
from packwright.functions.names import package_name_check, url_check, version_check
from packwright.operators.catalog import DESCRIPTOR

MAPPING_CONFIG = (
    "version string, config_type string, language string, "
    "file_info struct<original_file:string,sheet_name:string>, "
    "column_mappings map<string,string>, created_at string, created_with string"
)
METADATA_CONFIG = (
    "version string, config_type string, package struct<name:string,title:string,"
    "description:string,version:string,profile:string,keywords:array<string>,homepage:string,"
    "repository:string,created:string,modified:string>, "
    "licenses array<struct<name:string,title:string,path:string>>, "
    "contributors array<struct<name:string,role:string,email:string,organization:string>>, "
    "sources array<struct<title:string,path:string,description:string>>, "
    "config_created_at string, config_created_with string"
)
_TEXT_KEYS = ["name", "title", "description", "version", "profile", "created", "modified",
              "homepage", "repository"]
_LIST_KEYS = ["keywords", "licenses", "contributors", "sources", "resources"]


def _filled_text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _filled_list(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def descriptor_build(df: DataFrame, details: str = "details", resources: str = "resources",
                     created: str | None = None) -> DataFrame:
    """Add ``descriptor``, ``descriptor_json`` and ``build_error`` from details and resources.

    Empty texts and lists are left out. A licence without a name becomes the
    default licence, a contributor without a role an author. ``created`` is a
    date (``YYYY-MM-DD``) used where the details give none. ``build_error`` holds
    the first reason why a package cannot be built, else null.
    """
    d = F.col(details)
    default = F.struct(*[F.lit(v).alias(k) for k, v in
                         zip(("name", "title", "path"), S.DEFAULT_LICENSE)])
    licenses = F.transform(d["licenses"], lambda x: F.when(
        F.coalesce(x["name"], F.lit("")) == "", default).otherwise(x))
    contributors = F.transform(d["contributors"], lambda x: x.withField(
        "role", F.coalesce(x["role"], F.lit("author"))))
    values = {k: _filled_text(d[k]) for k in _TEXT_KEYS}
    if created is not None:
        values["created"] = F.coalesce(values["created"], F.lit(created))
    values.update(keywords=_filled_list(d["keywords"]), licenses=_filled_list(licenses),
                  contributors=_filled_list(contributors), sources=_filled_list(d["sources"]),
                  resources=_filled_list(F.col(resources)))
    order = [part.split(":")[0] for part in _top_level(DESCRIPTOR)]
    built = F.struct(*[values[k].alias(k) for k in order]).cast(DESCRIPTOR)
    name = package_name_check(values["name"])
    error = F.when(~name["ok"], F.concat(F.lit("Invalid package name: "), name["message"]))
    version = version_check(values["version"])
    error = error.when(~version["ok"], F.concat(F.lit("Invalid version: "), version["message"]))
    for key in ("homepage", "repository"):
        url = url_check(values[key])
        error = error.when(~url["ok"], F.concat(F.lit(f"Invalid {key} URL: "), url["message"]))
    error = error.when(values["resources"].isNull(), "At least one resource is required")
    for rule in S.METADATA_REQUIRED:
        error = error.when(values[rule.key].isNull(), f"Required field '{rule.key}' is missing")
    return (
        df.withColumn("descriptor", built)
        .withColumn("descriptor_json", F.to_json("descriptor"))
        .withColumn("build_error", error)
    )


def _top_level(ddl: str) -> list[str]:
    """Top-level members of a ``struct<...>`` type text."""
    parts, depth, start = [], 0, len("struct<")
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if (ch == "," and depth == 1) or (ch == ">" and depth == 0):
            parts.append(ddl[start:i])
            start = i + 1
    return parts


def mapping_config_check(json: Column) -> Column:
    """struct(ok, message) of a mapping configuration in JSON."""
    return _config_check(json, "mapping", ["version", "column_mappings"])


def metadata_config_check(json: Column) -> Column:
    """struct(ok, message) of a metadata configuration in JSON."""
    return _config_check(json, "metadata", ["version", "package"])


def _config_check(json: Column, config_type: str, required: list[str]) -> Column:
    document = F.try_parse_json(json)
    kind = F.try_variant_get(document, "$.config_type", "string")
    absent = F.array_compact(F.array(*[
        F.when(F.try_variant_get(document, f"$.{key}", "variant").isNull(), F.lit(f"'{key}'"))
        for key in required
    ]))
    message = (
        F.when(document.isNull(), "Invalid JSON")
        .when(F.coalesce(kind, F.lit("")) != config_type,
              F.concat(F.lit(f"Expected {config_type} config, got: "),
                       F.coalesce(kind, F.lit("None"))))
        .when(F.size(absent) > 0, F.concat(F.lit("Missing required fields: ["),
                                           F.array_join(absent, ", "), F.lit("]")))
        .otherwise("")
    )
    return F.struct((message == "").alias("ok"), message.alias("message"))


def parse_mapping_config(json: Column) -> Column:
    """The mapping configuration as a struct."""
    return F.from_json(json, MAPPING_CONFIG)


def parse_metadata_config(json: Column) -> Column:
    """The metadata configuration as a struct."""
    return F.from_json(json, METADATA_CONFIG)


def compatibility(mapping: Column, metadata: Column) -> Column:
    """struct(ok, message, name_hint) of a mapping and a metadata configuration of one dataset.

    Versions must be equal. ``name_hint`` is true when the package name does
    not occur in the file name, which is only a warning.
    """
    mv, nv = (F.coalesce(c["version"], F.lit("unknown")) for c in (mapping, metadata))
    file, package = mapping["file_info"]["original_file"], metadata["package"]["name"]
    message = F.when(mv != nv, F.concat(
        F.lit("Config version mismatch: mapping="), mv, F.lit(", metadata="), nv)).otherwise("")
    named = (F.coalesce(package, F.lit("")) != "") & file.isNotNull()
    return F.struct(
        (message == "").alias("ok"), message.alias("message"),
        (named & ~F.coalesce(F.contains(F.lower(file), F.lower(package)), F.lit(False))).alias("name_hint"))


def config_compatibility(mappings: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """``key, ok, message, name_hint`` where the configurations are in tables of their own."""
    return mappings.select(key, "mapping").join(metadata.select(key, "metadata"), key).select(
        key, F.inline(F.array(compatibility(F.col("mapping"), F.col("metadata")))))


def column_entries(mapping: Column) -> Column:
    """Array of struct(column, concept_id, unit_id) of a mapping configuration.

    An entry ``<column>_unit`` gives the unit of ``<column>``, whether that column
    is mapped too or not; there is one struct per column.
    """
    iris = mapping["column_mappings"]
    columns = F.array_distinct(F.transform(F.map_keys(iris), lambda n: F.regexp_replace(n, "_unit$", "")))
    return F.transform(columns, lambda c: F.struct(
        c.alias("column"), F.when(~c.endswith("_unit"), F.try_element_at(iris, c)).alias("concept_id"),
        F.try_element_at(iris, F.concat(c, F.lit("_unit"))).alias("unit_id")))


def column_mappings(df: DataFrame, key: str, mapping: str = "mapping") -> DataFrame:
    """``key, column, concept_id, unit_id`` rows of mapping configurations, from within each row."""
    return df.select(key, F.inline(column_entries(F.col(mapping))))


def file_info(df: DataFrame, key: str, mapping: str = "mapping") -> DataFrame:
    """``key, original_file, sheet_name`` of mapping configurations."""
    return df.select(key, F.col(f"{mapping}.file_info.original_file").alias("original_file"),
                     F.col(f"{mapping}.file_info.sheet_name").alias("sheet_name"))


def general_details(metadata: Column) -> Column:
    """Package details of a metadata configuration as one flat struct."""
    package = metadata["package"]
    return F.struct(*[package[k].alias(k) for k in _TEXT_KEYS + ["keywords"]],
                    *[metadata[k].alias(k) for k in ("licenses", "contributors", "sources")])


def build_mapping_config(mappings: Column, file_name: Column, sheet: Column,
                         language: str = "en", created_at: str | None = None) -> Column:
    """A mapping configuration as JSON text."""
    return F.to_json(F.struct(
        F.lit("1.0.0").alias("version"), F.lit("mapping").alias("config_type"),
        F.lit(language).alias("language"),
        F.struct(file_name.alias("original_file"), sheet.alias("sheet_name")).alias("file_info"),
        mappings.alias("column_mappings"), F.lit(created_at).cast("string").alias("created_at"),
        F.lit("packwright").alias("created_with")))


def build_metadata_config(details: Column, created_at: str | None = None) -> Column:
    """A metadata configuration as JSON text; absent details are left out."""
    return F.to_json(F.struct(
        F.lit("1.0.0").alias("version"), F.lit("metadata").alias("config_type"),
        F.struct(*[details[k].alias(k) for k in _TEXT_KEYS + ["keywords"]]).alias("package"),
        *[_filled_list(details[k]).alias(k) for k in ("licenses", "contributors", "sources")],
        F.lit(created_at).cast("string").alias("config_created_at"),
        F.lit("packwright").alias("config_created_with")))
