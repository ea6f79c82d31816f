"""Types of columns, voted by all their values weighted by frequency: no sample, and one aggregation over the frequency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.functions import types as rules


def physical_types(freq: DataFrame) -> DataFrame:
    """physical_type, semantic_type, whole_numbers, boolean_like and consistent_format per column; a column without values is unknown."""
    v, n = F.col("value"), F.col("freq")
    rows = freq.withColumn("class", rules.value_class(v)).withColumn("shape", rules.shape(v))
    known = v.isNotNull()
    share = lambda cond: F.coalesce(F.sum(F.when(known & cond, n)), F.lit(0))
    word, number = F.lower(F.trim(v)), F.expr("try_cast(value as double)")
    filled = known & (F.trim(v) != "")
    c = rows.groupBy("table_name", "column_name").agg(
        share(F.lit(True)).alias("n"),
        share(word.isin(rules.BOOLEAN_WORDS)).alias("n_bool"),
        *[share(F.col("class") == k).alias(f"n_{k}") for k in ("integer", "float", "datetime", "date")],
        F.bool_and(~known | F.coalesce(number == F.floor(number), F.lit(False))).alias("whole"),
        F.coalesce(F.bool_and(~known | word.isin(rules.BOOLEAN_PAIR_WORDS)), F.lit(False)).alias("pair_words"),
        F.count("value").alias("d"),
        # One shape only, which two extremes show without a distinct count.
        (F.min(F.when(filled, F.col("shape"))) == F.max(F.when(filled, F.col("shape")))).alias("one_shape"),
        share(F.trim(v) != "").alias("n_filled"),
    )
    most = lambda x: x >= F.col("n") * rules.VOTE
    kind = (
        F.when(F.col("n") == 0, "unknown")
        .when(most(F.col("n_bool")), "boolean")
        .when(most(F.col("n_integer")), "integer")
        .when(most(F.col("n_integer") + F.col("n_float")), "float")
        .when(most(F.col("n_datetime")), "datetime")
        .when(most(F.col("n_date")), "date")
        .otherwise("string")
    )
    return c.select(
        "table_name",
        "column_name",
        kind.alias("physical_type"),
        names.semantic_type(F.col("column_name"), kind).alias("semantic_type"),
        (F.coalesce("whole", F.lit(False)) & (F.col("n") > 0)).alias("whole_numbers"),
        (F.col("pair_words") & (F.col("d") == 2)).alias("boolean_like"),
        (F.coalesce("one_shape", F.lit(False)) & (F.col("n_filled") >= 3)).alias("consistent_format"),
    )
