"""Column expressions: names, identifiers, queries and value types."""

from packwright.functions.names import (
    check_resource_name,
    clean_query,
    concept_scheme,
    concept_web_url,
    config_filename,
    dataset_name,
    first_word,
    iri_tail,
    package_name_check,
    query_check,
    resource_path,
    sanitize_name,
    url_check,
    version_check,
)
from packwright.functions.value_types import (
    blank_nan,
    field_type_of,
    is_missing,
    is_numeric_type,
    value_type,
    variant_value_type,
)

__all__ = [
    "blank_nan", "check_resource_name", "clean_query", "concept_scheme", "concept_web_url",
    "config_filename", "dataset_name", "field_type_of", "first_word", "iri_tail",
    "is_missing", "is_numeric_type", "package_name_check", "query_check", "resource_path",
    "sanitize_name", "url_check", "value_type", "variant_value_type", "version_check",
]
