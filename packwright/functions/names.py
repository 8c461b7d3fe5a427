"""String expressions over names, identifiers and search queries.

All functions take and return Columns, so they stay inside code generation.
``(?d)`` makes ``$`` accept only a final line feed and ``(?U)`` makes the
character classes Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packwright import standard as S

_NAME = "(?d)" + S.NAME_PATTERN
_VERSION = "(?dU)" + S.VERSION_PATTERN


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def _verdict(*failures: tuple[Column, str]) -> Column:
    """struct(ok, message) of the first failure that applies."""
    message = F.lit("")
    for condition, text in reversed(failures):
        message = F.when(condition, F.lit(text)).otherwise(message)
    return F.struct((message == "").alias("ok"), message.alias("message"))


def sanitize_name(name: Column) -> Column:
    """A resource name of lower-case letters, digits, ``-``, ``_`` and ``.``."""
    kept = F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), r"[^a-z0-9\-_.]", "")
    return F.coalesce(F.nullif(F.btrim(kept, F.lit(".")), F.lit("")), F.lit("resource"))


def check_resource_name(name: Column, auto_fix: bool = False) -> Column:
    """struct(is_valid, name, suggestion); with auto_fix the clean name and no suggestion."""
    valid = F.coalesce(name.rlike(_NAME), F.lit(False))
    clean = sanitize_name(name)
    none = F.lit(None).cast("string")
    shown = clean if auto_fix else F.coalesce(name, F.lit(""))
    return F.struct(
        valid.alias("is_valid"),
        F.when(valid, name).otherwise(shown).alias("name"),
        (none if auto_fix else F.when(~valid, clean)).alias("suggestion"),
    )


def package_name_check(name: Column) -> Column:
    """struct(ok, message) for a package name."""
    return _verdict(
        (_empty(name), "Package name is required"),
        (~name.rlike(_NAME), "Package name can only contain lowercase letters, numbers, "
                             "hyphens, underscores, and dots"),
        (name.startswith(".") | name.endswith("."),
         "Package name cannot start or end with a dot"),
    )


def version_check(version: Column) -> Column:
    """struct(ok, message); an absent version is fine."""
    return _verdict(
        (~_empty(version) & ~version.rlike(_VERSION),
         "Version must follow semantic versioning (e.g., 1.0.0)"),
    )


def url_check(url: Column) -> Column:
    """struct(ok, message); an absent URL is fine."""
    return _verdict((~_empty(url) & ~url.rlike(S.URL_PATTERN), S.URL_MESSAGE))


def clean_query(query: Column) -> Column:
    """Replace all but letters, digits, ``_``, ``-``, ``.`` by single blanks, and trim."""
    # White space is among the replaced characters, so one pass also collapses it.
    return F.trim(F.regexp_replace(query, r"[^\p{L}\p{N}_\-.]+", " "))


def first_word(query: Column) -> Column:
    """Text before the first blank; empty for an empty or missing query."""
    return F.coalesce(F.substring_index(query, " ", 1), F.lit(""))


def query_check(query: Column, language: Column) -> Column:
    """struct(ok, message, query, language): length, blankness and language rules.

    The length is that of the text as given, the returned query is trimmed.
    """
    tag = F.trim(F.lower(language))
    text = F.regexp_replace(query, r"(?U)^\s+|\s+\z", "")
    checked = _verdict(
        (query.isNull() | (F.length(query) < S.QUERY_MIN_LENGTH), "Query is too short"),
        (F.length(query) > S.QUERY_MAX_LENGTH, "Query is too long"),
        (text == "", "Query cannot be empty or only whitespace"),
        (language.isNull() | (F.length(language) != 2), "Language must have two letters"),
        (~tag.isin(S.LANGUAGES), "Language is not supported"),
    )
    return F.struct(checked["ok"].alias("ok"), checked["message"].alias("message"),
                    text.alias("query"), tag.alias("language"))


def concept_web_url(iri: Column, base: str) -> Column:
    """Page of a concept: ``<base>/web/concept/`` and the percent-encoded identifier."""
    encoded = F.url_encode(iri)
    for java_form, plain_form in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(java_form), F.lit(plain_form))
    return F.concat(F.lit(base.rstrip("/") + "/web/concept/"), encoded)


def concept_scheme(iri: Column, vocabulary_host: str | Column) -> Column:
    """Scheme of a concept: host and first path segment on the vocabulary host, else the host."""
    host = F.lit(vocabulary_host) if isinstance(vocabulary_host, str) else vocabulary_host
    parts = F.split(iri, "/")
    n = F.size(parts)

    def head(k: int) -> Column:
        return F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))

    return (
        F.when((n >= 5) & (F.get(parts, F.lit(2)) == host), head(4))
        .when(n >= 3, head(3))
        .otherwise(iri)
    )


def iri_tail(iri: Column) -> Column:
    """Text after the last slash, used as a unit name when no label is known."""
    return F.substring_index(iri, "/", -1)


def file_stem(file_name: Column) -> Column:
    """File name without folders and without its last extension."""
    base = F.regexp_extract(F.regexp_replace(file_name, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(base, r"^(.+)\.[^.]+$", "$1")


def dataset_name(file_name: Column, sheet: Column) -> Column:
    """``<stem>_<sheet>`` with blanks of the sheet as underscores."""
    return F.concat(file_stem(file_name), F.lit("_"), F.replace(sheet, F.lit(" "), F.lit("_")))


def resource_path(file_name: Column, sheet: Column) -> Column:
    """struct(name, path) of the resource that holds a sheet of a file."""
    name = sanitize_name(F.concat(file_stem(file_name), F.lit("_"), sheet))
    return F.struct(name.alias("name"), F.concat(name, F.lit(".parquet")).alias("path"))


def config_filename(config_type: Column, package_name: Column, file_name: Column,
                    sheet: Column) -> Column:
    """File name of a stored configuration."""
    from_file = F.when(_empty(sheet), file_stem(file_name)).otherwise(dataset_name(file_name, sheet))
    base = (
        F.when(~_empty(package_name), package_name)
        .when(~_empty(file_name), from_file)
        .otherwise(F.lit("config"))
    )
    return F.concat(base, F.lit("_"), config_type, F.lit("_config.json"))
