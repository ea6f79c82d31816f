"""Column statistics in long form: one frequency table for all columns, everything else from it.

A table is unpivoted once (column, value as text) and counted by (column, value) with map-side
partial counts; counts, ratios, entropy, top values, numeric and text statistics are then
aggregates over values weighted by their frequency, so no statistic scans the source again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Top values are given for columns of at most so many values, whatever their rows.
TOP_DISTINCT, TOP = 10_000, 10


def kind_of(t: T.DataType) -> str:
    return "number" if isinstance(t, NUMERIC) else "text" if isinstance(t, T.StringType) else "other"


def frequencies(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name, kind, value (text, may be null), freq."""
    cols = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(kind_of(f.dataType)).alias("kind"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in cols]))
    return df.select(pairs.alias("p")).groupBy("p.column_name", "p.kind", "p.value").agg(F.count("*").alias("freq")).select(F.lit(table).alias("table_name"), "column_name", "kind", "value", "freq")


def ratio(a: Column, b: Column) -> Column:
    """a / b within 0 and 1; 0 where b is 0."""
    share = F.try_divide(a.cast("double"), b.cast("double"))
    # least() and greatest() skip nulls, so a missing share must not reach them.
    return F.when(share.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def counts(freq: DataFrame) -> DataFrame:
    """Counts and ratios per column."""
    known = F.col("value").isNotNull()
    c = freq.groupBy("table_name", "column_name", "kind").agg(F.sum("freq").alias("total_count"), F.coalesce(F.sum(F.when(known, F.col("freq"))), F.lit(0)).alias("non_null_count"), F.count("value").alias("distinct_count"))
    n, nn, d = F.col("total_count"), F.col("non_null_count"), F.col("distinct_count")
    return c.select(
        "table_name",
        "column_name",
        "kind",
        n,
        nn,
        (n - nn).alias("null_count"),
        d,
        F.greatest(nn - d, F.lit(0)).alias("duplicate_count"),
        ratio(d, nn).alias("uniqueness"),
        ratio(nn, n).alias("coverage"),
        F.when(nn > 0, 1 - ratio(d, nn)).otherwise(0.0).alias("duplicate_ratio"),
        ratio(n - nn, n).alias("null_ratio"),
        ratio(d, n).alias("cardinality_ratio"),
    )


def entropy(freq: DataFrame) -> DataFrame:
    """Shannon entropy in bits, and over log2 of the non-null count."""
    rows = freq.where("value is not null")
    # -sum(p log p) = log n - sum(f log f) / n, which needs one aggregation only.
    e = rows.groupBy("table_name", "column_name").agg(F.sum("freq").alias("n"), F.sum(F.col("freq") * F.log2(F.col("freq").cast("double"))).alias("s"))
    bits = F.greatest(F.lit(0.0), F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n"))
    return e.select("table_name", "column_name", bits.alias("entropy"), F.when(F.col("n") > 1, F.least(F.lit(1.0), bits / F.log2(F.col("n").cast("double")))).otherwise(0.0).alias("entropy_norm"))


def top_values(freq: DataFrame, k: int = TOP) -> DataFrame:
    """The k most frequent values of each column (ties: the smaller text), unless a column has too many values for that."""
    size = freq.where("value is not null").groupBy("table_name", "column_name").agg(F.count("*").alias("d")).where(F.col("d") <= TOP_DISTINCT)
    w = Window.partitionBy("table_name", "column_name").orderBy(F.desc("freq"), "value")
    return freq.where("value is not null").join(F.broadcast(size.select("table_name", "column_name")), ["table_name", "column_name"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("table_name", "column_name", "rank", "value", "freq")


def numeric(freq: DataFrame) -> DataFrame:
    """min, max, mean, exact interpolated quantiles, sample deviation, and sample-corrected skewness and kurtosis of numeric columns."""
    x = F.expr("try_cast(value as double)")
    rows = freq.where("kind = 'number'").withColumn("x", x).where("x is not null")
    base = rows.groupBy("table_name", "column_name").agg(
        F.sum("freq").alias("n"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        (F.sum(F.col("x") * F.col("freq")) / F.sum("freq")).alias("mean_value"),
        F.expr("percentile(x, array(0.25, 0.5, 0.75, 0.9, 0.99), freq)").alias("q"),
    )
    d = F.col("x") - F.col("mean_value")
    power = lambda k: F.sum(F.pow(d, F.lit(k)) * F.col("freq"))
    m = rows.join(F.broadcast(base.select("table_name", "column_name", "mean_value")), ["table_name", "column_name"]).groupBy("table_name", "column_name").agg(power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"))
    n = F.col("n").cast("double")
    g1 = F.try_divide(F.col("m3") / n, F.pow(F.col("m2") / n, F.lit(1.5)))
    g2 = F.try_divide(F.col("m4") / n, F.pow(F.col("m2") / n, F.lit(2.0))) - 3
    var = F.when(n > 1, F.col("m2") / (n - 1))
    return base.join(F.broadcast(m), ["table_name", "column_name"]).select(
        "table_name",
        "column_name",
        "min_value",
        "max_value",
        "mean_value",
        *[F.col("q")[i].alias(name) for i, name in enumerate(("p25", "median", "p75", "p90", "p99"))],
        F.sqrt(var).alias("stddev"),
        var.alias("variance"),
        F.when((n >= 3) & (F.col("m2") > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when((n >= 4) & (F.col("m2") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
    )


def text_lengths(freq: DataFrame) -> DataFrame:
    n = F.length("value")
    return freq.where("kind = 'text' and value is not null").groupBy("table_name", "column_name").agg(F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), (F.sum(n * F.col("freq")) / F.sum("freq")).alias("avg_length"))


def cardinality_class(uniqueness: Column) -> Column:
    return F.when(uniqueness >= 0.8, "high").when(uniqueness >= 0.2, "medium").otherwise("low")


def column_stats(df: DataFrame, table: str) -> DataFrame:
    """All of the above, one row per column."""
    f = frequencies(df, table)
    key = ["table_name", "column_name"]
    c = counts(f)
    return c.join(entropy(f), key, "left").join(numeric(f), key, "left").join(text_lengths(f), key, "left").withColumn("cardinality_class", cardinality_class(F.col("cardinality_ratio")))
