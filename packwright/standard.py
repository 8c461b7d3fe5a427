"""Rule values of the packaging standard, version 1.0.0.

Fixed values: patterns, limits, word lists and messages below must equal the
published standard, because they appear in the results.
"""

from __future__ import annotations

from dataclasses import dataclass

VERSION = "1.0.0"

# ---------------------------------------------------------------- fixed values
NAME_PATTERN = r"^[a-z0-9\-_.]+$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
VERSION_PATTERN = r"^\d+\.\d+\.\d+(-[a-zA-Z0-9\-\.]+)?$"
URL_PATTERN = r"^https?://"

FIELD_TYPES = [
    "string", "number", "integer", "boolean", "date", "datetime", "time",
    "duration", "geopoint", "geojson", "object", "array", "any",
]
NUMERIC_FIELD_TYPES = ["number", "integer"]
CONTRIBUTOR_ROLES = ["author", "contributor", "maintainer", "publisher", "wrangler"]
LANGUAGES = ["en", "de", "es", "fr", "pt", "it", "da"]

# Value type names accepted for a declared field type.
EXPECTED_VALUE_TYPES = {
    "string": ["str"],
    "integer": ["int", "int64", "int32"],
    "number": ["float", "float64", "int", "int64"],
    "boolean": ["bool"],
    "date": ["datetime64", "date"],
    "datetime": ["datetime64", "datetime"],
    "time": ["datetime64", "time"],
}

PREFERRED_FORMAT = "parquet"
FORMATS = ["parquet", "csv", "json", "xlsx", "tsv"]
FIELD_NAME_PATTERN = r"^[a-zA-Z][a-zA-Z0-9_]*$"
DEFAULT_ENCODING = "utf-8"

MAX_NULL_FRACTION = 0.20
CRITICAL_NULL_FRACTION = 0.50
MAX_DUPLICATE_FRACTION = 0.05
OUTLIER_FENCE = 3.0
MAX_FILE_MB = 5000
SMALL_FILE_BYTES = 10 * 1024 * 1024
LARGE_FILE_BYTES = 500 * 1024 * 1024
MEMORY_FACTOR = 3

MAX_STANDARD_WARNINGS = 5
MAX_BASIC_ERRORS = 10

QUERY_MIN_LENGTH = 1
QUERY_MAX_LENGTH = 500
SUGGESTION_LIMIT = 5

LEVEL_BADGES = {
    "strict": "✅ STRICT COMPLIANCE",
    "standard": "✓ STANDARD COMPLIANCE",
    "basic": "~ BASIC COMPLIANCE",
    "invalid": "✗ NON-COMPLIANT",
}

LICENSES = [
    ("CC-BY-4.0", "Creative Commons Attribution 4.0", "https://spdx.org/licenses/CC-BY-4.0.html"),
    ("MIT", "MIT License", "https://spdx.org/licenses/MIT.html"),
    ("Apache-2.0", "Apache License 2.0", "https://spdx.org/licenses/Apache-2.0.html"),
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal", "https://spdx.org/licenses/CC0-1.0.html"),
]
DEFAULT_LICENSE = (
    "CC-BY-4.0",
    "Creative Commons Attribution 4.0 International",
    "https://spdx.org/licenses/CC-BY-4.0.html",
)

DIMENSIONLESS_NAME = "NUM"
DIMENSIONLESS_LONG_NAME = "dimensionless number"
DIMENSIONLESS_PATH = "http://qudt.org/vocab/unit/NUM"

# name, type, description, unit name, unit long name, unit path, rdf type,
# required, unique, minimum, maximum
FIELD_TEMPLATES = [
    ("id", "integer", "Unique identifier", DIMENSIONLESS_NAME, DIMENSIONLESS_LONG_NAME,
     DIMENSIONLESS_PATH, None, True, True, None, None),
    ("name", "string", "Name or title", None, None, None, None, True, None, None, None),
    ("latitude", "number", "Decimal latitude (WGS84)", "DEG", "degree",
     "http://qudt.org/vocab/unit/DEG", "http://www.w3.org/2003/01/geo/wgs84_pos#lat",
     None, None, -90.0, 90.0),
    ("longitude", "number", "Decimal longitude (WGS84)", "DEG", "degree",
     "http://qudt.org/vocab/unit/DEG", "http://www.w3.org/2003/01/geo/wgs84_pos#long",
     None, None, -180.0, 180.0),
]

# Text encodings accepted in a resource (names are compared in lower case with
# "-" and " " folded to "_").
ENCODINGS = [
    "ascii", "us_ascii", "646",
    "big5", "big5hkscs", "cp437", "cp850", "cp852", "cp855", "cp866", "cp932", "cp949", "cp950",
    "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258",
    "windows_1250", "windows_1251", "windows_1252", "windows_1253", "windows_1254",
    "windows_1255", "windows_1256", "windows_1257", "windows_1258",
    "euc_jp", "euc_jis_2004", "euc_kr", "gb2312", "gbk", "gb18030", "hz",
    "iso2022_jp", "iso2022_kr", "iso_2022_jp", "iso_2022_kr",
    "latin_1", "latin1", "l1", "iso8859_1", "iso_8859_1", "8859", "cp819",
    "iso8859_2", "iso_8859_2", "latin2", "iso8859_3", "iso_8859_3", "latin3",
    "iso8859_4", "iso_8859_4", "latin4", "iso8859_5", "iso_8859_5", "cyrillic",
    "iso8859_6", "iso_8859_6", "arabic", "iso8859_7", "iso_8859_7", "greek",
    "iso8859_8", "iso_8859_8", "hebrew", "iso8859_9", "iso_8859_9", "latin5",
    "iso8859_10", "iso_8859_10", "latin6", "iso8859_11", "iso_8859_11",
    "iso8859_13", "iso_8859_13", "latin7", "iso8859_14", "iso_8859_14", "latin8",
    "iso8859_15", "iso_8859_15", "latin9", "iso8859_16", "iso_8859_16", "latin10",
    "koi8_r", "koi8_u", "mac_roman", "macroman", "mac_cyrillic", "mac_greek",
    "shift_jis", "sjis", "shiftjis", "s_jis", "shift_jis_2004",
    "utf_7", "utf7", "utf_8", "utf8", "u8", "utf_8_sig", "utf_16", "utf16", "u16",
    "utf_16_be", "utf_16_le", "utf_16be", "utf_16le", "utf_32", "utf32", "u32",
    "utf_32_be", "utf_32_le", "utf_32be", "utf_32le",
]


@dataclass(frozen=True)
class Rule:
    """One key of a descriptor and what its value must look like."""

    key: str
    kind: str
    message: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    min_items: int | None = None
    max_items: int | None = None


METADATA_REQUIRED = [
    Rule("name", "string",
         "Package name must be lowercase, alphanumeric with hyphens, underscores, or dots",
         min_length=3, max_length=100, pattern=NAME_PATTERN),
    Rule("title", "string", "Title must be between 5 and 200 characters",
         min_length=5, max_length=200),
    Rule("resources", "array", "At least one resource (data file) is required", min_items=1),
    Rule("licenses", "array", "At least one license must be specified", min_items=1),
    Rule("created", "string", "Created date must be in ISO 8601 format (YYYY-MM-DD)",
         pattern=DATE_PATTERN),
    Rule("contributors", "array", "At least one contributor with role 'author' is required",
         min_items=1),
    Rule("sources", "array", "At least one data source must be documented", min_items=1),
]

METADATA_RECOMMENDED = [
    Rule("description", "text", "Description should be at least 50 characters for clarity",
         min_length=50, max_length=5000),
    Rule("version", "string", "Version should follow semantic versioning (e.g., 1.0.0)",
         pattern=VERSION_PATTERN),
    Rule("keywords", "array", "At least 3 keywords help improve discoverability",
         min_items=3, max_items=20),
    Rule("homepage", "url", "Homepage should be a valid HTTP(S) URL"),
    Rule("repository", "url", "Repository should be a valid HTTP(S) URL"),
]

# Keys that the entries of a list must have.
ITEM_KEYS = {
    "licenses": ["name", "path"],
    "contributors": ["name", "role"],
    "sources": ["title"],
}

RESOURCE_REQUIRED = [
    Rule("name", "string", pattern=NAME_PATTERN),
    Rule("path", "string"),
    Rule("format", "string", "Parquet format is preferred for performance and metadata"),
]

RESOURCE_RECOMMENDED = [
    Rule("title", "string"),
    Rule("description", "text"),
    Rule("schema", "object", "Schema with field definitions improves data quality"),
    Rule("encoding", "string"),
]

FIELD_NAME_MESSAGE = (
    "Field names must start with a letter and contain only alphanumeric and underscores"
)
FIELD_TYPE_MESSAGE = "Field type must be specified from standard types"
FIELD_UNIT_MESSAGE = "Numeric fields MUST have units specified"
FIELD_DESCRIPTION_MESSAGE = "Field description improves dataset usability"
AUTHOR_MESSAGE = "At least one contributor with role 'author' is required"
URL_MESSAGE = "URL must start with http:// or https://"
PATTERN_MESSAGE = "Value does not match pattern"
