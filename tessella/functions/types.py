"""Rules on values and types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that count as booleans, and as nulls, and the shapes of numbers and dates.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "0", "1", "t", "f"]
BOOLEAN_PAIR_WORDS = ["true", "false", "yes", "no", "0", "1", "t", "f", "y", "n"]
NULL_WORDS = ["null", "none", "nan"]
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
DATETIME = r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})[ T][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
DATE = r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})$"
#: The share of a column's values that decides its type.
VOTE = 0.8


def is_null_like(value: Column) -> Column:
    return value.isNull() | (value == "") | F.trim(F.lower(value)).isin(NULL_WORDS)


def value_class(value: Column) -> Column:
    """integer, float, datetime, date or string: what one value looks like."""
    v = F.trim(value)
    return F.when(v.rlike(INTEGER), "integer").when(v.rlike(NUMBER), "float").when(v.rlike(DATETIME), "datetime").when(v.rlike(DATE), "date").otherwise("string")


def shape(value: Column) -> Column:
    """The value with digits as 9 and letters as A."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\p{L}", "A"), r"\p{N}", "9")


def type_score(a: Column, b: Column) -> Column:
    """1 for equal types, .8 for two numeric ones, .5 if one is a string or unknown, else .3."""
    numeric = ["integer", "float", "decimal"]
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.5).when(a == b, 1.0).when(a.isin(numeric) & b.isin(numeric), 0.8).when((a == "string") | (b == "string"), 0.5).otherwise(0.3)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.95, "extremely_confident").when(score >= 0.85, "strong").when(score >= 0.75, "acceptable").when(score >= 0.6, "weak").otherwise("rejected")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
