"""Types of columns and of single cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ladder of patterns for the text of one cell; the first that fits names its type.
_TEXT_LADDER = [
    ("int", r"^[+-]?\d+\z"),
    ("float", r"^[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?\z"),
    ("bool", r"^([Tt]rue|TRUE|[Ff]alse|FALSE)\z"),
    ("date", r"^\d{4}-\d{2}-\d{2}\z"),
    ("datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?\z"),
    ("time", r"^\d{2}:\d{2}(:\d{2}(\.\d+)?)?\z"),
]

VALUE_TYPES = [name for name, _ in _TEXT_LADDER] + ["str"]


def value_type(text: Column) -> Column:
    """Type name of a raw text cell: int, float, bool, date, datetime, time or str; null stays null."""
    return F.when(text.isNotNull(), filled_value_type(text))


def filled_value_type(text: Column) -> Column:
    """The same for text known not to be null; the result is never null either."""
    (first, pattern), *rest = _TEXT_LADDER
    ladder = F.when(text.rlike(pattern), first)
    for name, pattern in rest:
        ladder = ladder.when(text.rlike(pattern), name)
    return ladder.otherwise("str")


def variant_value_type(cell: Column) -> Column:
    """Type name of a VARIANT cell: int, float, str, bool, list, dict, or null."""
    shape = F.schema_of_variant(cell)
    return (
        F.when(shape == "VOID", F.lit(None).cast("string"))
        .when(shape == "BIGINT", "int")
        .when((shape == "DOUBLE") | (shape == "FLOAT") | shape.startswith("DECIMAL"), "float")
        .when(shape == "STRING", "str")
        .when(shape == "BOOLEAN", "bool")
        .when(shape.startswith("ARRAY"), "list")
        .when(shape.startswith("OBJECT"), "dict")
        .when(shape == "DATE", "date")
        .when(shape.startswith("TIMESTAMP"), "datetime")
        .otherwise(F.lower(shape))
    )


def field_type_of(data_type: T.DataType) -> str:
    """Declared field type that a Spark type stands for.

    Dates, decimals, arrays and nested types keep a type of their own here.
    """
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.DayTimeIntervalType):
        return "duration"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, (T.StructType, T.MapType, T.VariantType)):
        return "object"
    if data_type.typeName() == "time":
        return "time"
    return "string"


def is_numeric_type(data_type: T.DataType) -> bool:
    """Whether a column needs a unit; a boolean does not count as numeric."""
    return isinstance(data_type, T.NumericType)


def column(name: str) -> Column:
    """The column of exactly this name, which may hold dots and backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def blank_nan(name: str, data_type: T.DataType) -> Column:
    """The column with NaN turned into null, as both count as missing."""
    c = column(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def is_missing(name: str, data_type: T.DataType) -> Column:
    """Null, or NaN in a float column."""
    c = column(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()
