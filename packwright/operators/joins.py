"""Joining a large table with one that holds few rows per key, where one key may be very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(large: DataFrame, small: DataFrame, on: list[str],
                salt_by: list[str | Column], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Shuffle join with ``small`` repeated once per salt.

    The salt of a large row is a hash of ``salt_by``, so a task that is run
    again sends the row to the same place.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    left = large.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on + ["_salt"], how).drop("_salt")
