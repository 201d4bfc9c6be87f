"""Dictionary lookup of structured values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.validators import only_digits


def first_entries(entries: DataFrame, key: str = "lookup_key", priority: str = "priority") -> DataFrame:
    """One entry a key, the one of the best priority: session entries before local ones, first ones first."""
    rest = [c for c in entries.columns if c not in (key, priority)]
    best = entries.groupBy(key).agg(F.min_by(F.struct(*rest), priority).alias("b"))
    return best.select(key, "b.*")


def with_keys(entries: DataFrame, text: str = "text") -> DataFrame:
    """``entries`` with lookup_key: digits alone, and letters and digits in upper case, a row each."""
    digits, alnum = only_digits(F.col(text)), F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    return entries.withColumn("lookup_key", F.explode(F.array_distinct(F.filter(F.array(digits, alnum), lambda x: x != ""))))
