"""Joining columns with vocabulary concepts, units and descriptions.

Vocabulary tables: ``concepts(id, lang, label)`` and
``definitions(id, pos, lang, value)``. Column tables are those of
``schema_match``, keyed by ``dataset``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packwright import standard as S
from packwright.functions.names import clean_query, first_word, iri_tail
from packwright.operators.joins import salted_join
from packwright.session import local_table

FIELD_TEMPLATE_SCHEMA = (
    "column string, type string, description string, unit_name string, unit_long_name string, "
    "unit_path string, rdf_type string, required boolean, `unique` boolean, minimum double, "
    "maximum double"
)


def apply_mappings(columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Add ``concept_id`` and ``unit_id``; unmapped columns stay.

    ``mappings`` holds ``dataset, name, iri`` where the name is a column or a
    column followed by ``_unit``.
    """
    concept = mappings.select("dataset", F.col("name").alias("column"),
                              F.col("iri").alias("concept_id"))
    unit = mappings.where(F.col("name").endswith("_unit")).select(
        "dataset", F.regexp_replace("name", "_unit$", "").alias("column"),
        F.col("iri").alias("unit_id"))
    return columns.join(concept, ["dataset", "column"], "left").join(
        unit, ["dataset", "column"], "left")


def normalize_suggestion(json: Column) -> Column:
    """struct(id, label) of a suggestion in JSON, from whichever key is filled; null if one is not."""
    def first_filled(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{k}"), F.lit("")) for k in keys])

    found_id = first_filled("id", "id_", "uri", "concept_id")
    label = first_filled("label", "name", "title")
    return F.when(found_id.isNotNull() & label.isNotNull(),
                  F.struct(found_id.alias("id"), label.alias("label")))


def label_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``label`` of the first cached suggestion with the wanted ``id``.

    The ids wanted are distinct; the cache holds ``cache_order, pos,
    suggestion`` (JSON). An empty label of the first hit gives no label. Each
    task hands on one entry per id, so an id that fills a third of the cache
    is no burden.
    """
    def field(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object("suggestion", f"$.{k}"), F.lit(""))
                            for k in keys])

    entries = cache.select("cache_order", "pos", field("id", "id_", "uri").alias("id"),
                           field("label", "name").alias("label")).where(F.col("id").isNotNull())
    firsts = entries.groupBy("id").agg(
        F.min_by("label", F.struct("cache_order", "pos")).alias("label"))
    return wanted.join(firsts, "id", "left")


def _prefix_scores(label: Column, min_letters: int) -> Column:
    """Array of struct(word, score) for every prefix of ``min_letters`` or more letters in a label.

    3 for the whole label, 2 for a whole word, 1 for the start of a word.
    """
    words = F.filter(F.split(F.lower(clean_query(label)), " "),
                     lambda w: F.length(w) >= min_letters)
    starts = F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(min_letters), F.length(w)), lambda k: F.substring(w, 1, k))))
    return F.transform(F.array_distinct(starts), lambda s: F.struct(
        s.alias("word"),
        F.when(s == F.lower(label), 3).when(F.array_contains(words, s), 2).otherwise(1)
        .alias("score")))


def suggest_concepts(queries: DataFrame, concepts: DataFrame, column: str, language: str,
                     limit: int = S.SUGGESTION_LIMIT, min_letters: int = 1) -> DataFrame:
    """Best concepts for the first word of each column name: ``column, ordinal, id, label, score``.

    The vocabulary is cut to the best few concepts per word before it meets the
    columns, and that cut is applied inside every task before any shuffle, so a
    word shared by a third of the vocabulary costs no more than a rare one. Prefixes
    that no column asks for are dropped first. Queries typed by hand may ask for two
    letters or more (``min_letters``); names of columns are searched from one on.
    """
    if min_letters < 1:
        raise ValueError("min_letters must be 1 or more")
    word = F.lower(first_word(clean_query(F.col(column))))
    asked = queries.select(F.col(column).alias("column"), word.alias("word")).distinct().where(
        F.length("word") >= min_letters)
    best = W.partitionBy("word").orderBy(F.col("score").desc(), "label", "id")
    index = (
        concepts.where(F.col("lang") == language)
        .select("id", "label", F.inline(_prefix_scores(F.col("label"), min_letters)))
        .join(asked.select("word").distinct(), "word", "left_semi")
        .withColumn("ordinal", F.row_number().over(best))
        .where(F.col("ordinal") <= limit)
    )
    # A few rows per word are repeated per salt, so a word that very many columns begin with is spread.
    return salted_join(asked, index, ["word"], ["column"]).select("column", "ordinal", "id", "label", "score")


def concept_definition(definitions: Column, language: str) -> Column:
    """Definition in the wanted language, else the first, else null (array of struct(lang, value))."""
    wanted = F.filter(definitions, lambda d: d["lang"] == language)
    return F.when(F.size(wanted) > 0, F.get(wanted, F.lit(0))["value"]).otherwise(
        F.get(definitions, F.lit(0))["value"])


def pick_definitions(df: DataFrame, key: str, pos: str, lang: str, value: str,
                     language: str) -> DataFrame:
    """The same choice where definitions are rows: ``key, value``.

    Only positions are aggregated; the chosen texts are fetched by a join
    afterwards, so long texts are never sorted or shuffled in bulk.
    """
    chosen = df.groupBy(key).agg(
        F.coalesce(F.min(F.when(F.col(lang) == language, F.col(pos))), F.min(pos)).alias(pos))
    return df.select(key, pos, value).join(chosen, [key, pos]).select(key, value)


def build_fields(columns: DataFrame, labels: DataFrame, descriptions: DataFrame,
                 sheet_name: str, dimensionless_path: str = S.DIMENSIONLESS_PATH) -> DataFrame:
    """Field definitions: type, unit, description and concept of every column.

    ``columns`` carries ``concept_id`` and ``unit_id`` (see ``apply_mappings``);
    ``labels`` is ``id, label``; ``descriptions`` is ``dataset, column,
    description``. A numeric column without a unit is dimensionless.
    """
    units = labels.select(F.col("id").alias("unit_id"), F.col("label").alias("unit_label"))
    mapped = F.col("is_numeric") & F.col("unit_id").isNotNull()
    numeric = F.col("field_type").isin(S.NUMERIC_FIELD_TYPES)

    def unit(label: Column, fallback: str) -> Column:
        return F.when(mapped, label).when(numeric, F.lit(fallback))

    return (
        columns.join(units, "unit_id", "left")
        .join(descriptions, ["dataset", "column"], "left")
        .select(
            "dataset", "pos", F.col("column").alias("name"), F.col("field_type").alias("type"),
            F.coalesce("description", F.lit(f"Column from {sheet_name}")).alias("description"),
            unit(F.coalesce("unit_label", iri_tail(F.col("unit_id"))), S.DIMENSIONLESS_NAME)
            .alias("unit_name"),
            unit(F.col("unit_label"), S.DIMENSIONLESS_LONG_NAME).alias("unit_long_name"),
            unit(F.col("unit_id"), dimensionless_path).alias("unit_path"),
            F.col("concept_id").alias("rdf_type"), F.col("concept_id").alias("taxonomy_url"))
    )


def field_templates(columns: DataFrame) -> DataFrame:
    """Add the ready definition of columns with a well-known name (a fixed few)."""
    templates = local_table(columns.sparkSession, S.FIELD_TEMPLATES, FIELD_TEMPLATE_SCHEMA)
    return columns.join(F.broadcast(templates), "column", "left")


def mapping_completeness(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``dataset, column, problem``: no concept and no description, or numeric without a unit."""
    described = descriptions.where(F.coalesce("description", F.lit("")) != "")
    no_info = columns.where(F.col("concept_id").isNull()).join(
        described, ["dataset", "column"], "left_anti").select(
        "dataset", "column", F.lit("missing_info").alias("problem"))
    no_unit = columns.where(F.col("is_numeric") & F.col("unit_id").isNull()).select(
        "dataset", "column", F.lit("missing_unit").alias("problem"))
    return no_info.unionByName(no_unit)


def column_view(samples: DataFrame, suggestions: DataFrame, selected: DataFrame) -> DataFrame:
    """Per column its sample values, suggestions and selected concept.

    Samples and suggestions are limited to a few rows per column beforehand, so
    the lists stay short. A selected concept that is not among the suggestions
    keeps its id and has no label.
    """
    def listed(name: str, *fields: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("ordinal", *fields)))
        keep = (lambda s: s[fields[0]]) if len(fields) == 1 else (
            lambda s: F.struct(*[s[f].alias(f) for f in fields]))
        return F.transform(ordered, keep).alias(name)

    values = samples.groupBy("column").agg(listed("values", "value"))
    options = suggestions.groupBy("column").agg(listed("suggestions", "id", "label"))
    chosen = F.filter("suggestions", lambda s: s["id"] == F.col("concept_id"))
    return (
        values.join(options, "column", "left").join(selected, "column", "left")
        .select("column", "values", "suggestions", F.col("concept_id").alias("selected_id"),
                F.get(chosen, F.lit(0))["label"].alias("selected_label"))
    )
