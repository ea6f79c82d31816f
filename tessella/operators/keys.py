"""Key scores, suppression and choice, quality flags and scores; all narrow expressions over column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators.profile import ratio


def pk_score(stats: DataFrame, type_confidence: float = 0.9) -> DataFrame:
    """pk_score and is_candidate per column; the owner of a key is the table whose singular last name part is the column's entity."""
    root = names.singular(F.element_at(F.split(F.lower("table_name"), "_"), -1))
    owner = (names.entity(F.col("column_name")) == root) & F.lower("column_name").rlike("(id|key)$")
    audit = F.lower("column_name").rlike(r"(edited_?by|created_?by|updated_?by|modified_?by)$")
    n, d = F.col("non_null_count"), F.col("distinct_count")
    base = 0.40 * owner.cast("double") + 0.20 * F.col("uniqueness") + 0.15 * F.col("coverage") + 0.10 * F.col("entropy_norm") + 0.10 * F.when(owner, 1.0).otherwise(0.0) + F.lit(0.05 * type_confidence)
    few = F.when(F.col("total_count") < 20, 0.05).when(F.col("total_count") < 200, 0.03).otherwise(0.0)
    strong = owner & (F.col("uniqueness") >= 0.99) & (F.col("coverage") >= 0.99)
    small = F.when(d < 5, 0.08).when(d < 20, 0.05).when(d < 100, 0.03).otherwise(0.0) * F.when(strong, 0.25).otherwise(1.0)
    penalty = (few + small + F.when((d == 1) & (n > 0), 1.0).otherwise(0.0)) * F.when(owner & ~audit, 0.25).otherwise(1.0)
    score = F.when(audit, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)))
    score = F.when(owner & ~audit & (F.col("coverage") >= 0.6), F.greatest(score, F.lit(0.75))).otherwise(score)
    return stats.withColumn("is_owner", owner).withColumn("pk_score", score).withColumn("is_candidate", (F.col("pk_score") >= 0.7) & owner & ~audit)


def choose_pk(scored: DataFrame) -> DataFrame:
    """One key per table at most: the best candidate, ties by name."""
    w = Window.partitionBy("table_name").orderBy(F.desc("pk_score"), "column_name")
    return scored.where("is_candidate").withColumn("r", F.row_number().over(w)).where("r = 1").select("table_name", "column_name", "pk_score")


def quality_flags() -> Column:
    """The flags of a column, from its statistics."""
    n, d, nulls = F.col("total_count"), F.col("distinct_count"), F.col("null_ratio")
    rules = [
        ("fully_null", nulls >= 1.0),
        ("high_null_ratio", (nulls > 0.5) & (nulls < 1.0)),
        ("sparsity_detected", (nulls > 0.2) & (nulls <= 0.5)),
        ("duplicate_explosion", (d < 0.01 * n) & (n > 100)),
        ("weak_identifier", F.lower("column_name").contains("id") & (F.col("uniqueness") < 0.95)),
        ("constant_column", d == 1),
        ("zero_entropy", (d != 1) & (F.coalesce("entropy_norm", F.lit(0.0)) < 0.01)),
        ("entropy_collapse", (d != 1) & (F.col("entropy_norm") >= 0.01) & (F.col("entropy_norm") < 0.1)),
        ("low_cardinality", (d < 3) & (n > 10)),
        ("high_missingness", nulls > 0.5),
        ("high_duplication", F.col("duplicate_ratio") > 0.5),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())


def quality_score(flags: Column) -> Column:
    """.30 completeness, .20 uniqueness, .20 consistency, .20 validity, .10 without anomalies, to 4 places."""
    validity = F.greatest(F.lit(0.0), 1 - 0.2 * F.array_contains(flags, "zero_entropy").cast("double"))
    return F.round(0.30 * F.col("coverage") + 0.20 * (1 - F.col("duplicate_ratio")) + 0.20 + 0.20 * validity + 0.10 * F.when(F.size(flags) > 0, 0.5).otherwise(1.0), 4)


def containment(fk: DataFrame, pk: DataFrame, fk_col: str, pk_col: str) -> DataFrame:
    """Share of the non-null fk rows whose value is in pk, with orphans. Values are counted before they are joined, so a hot key is one row of the join."""
    left = fk.where(F.col(fk_col).isNotNull()).groupBy(F.col(fk_col).alias("v")).agg(F.count("*").alias("n"))
    right = pk.select(F.col(pk_col).alias("v")).where("v is not null").distinct().withColumn("hit", F.lit(1))
    j = left.join(right, "v", "left")
    agg = j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fk_rows"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("matched_rows"), F.count("*").alias("fk_distinct"), F.count("hit").alias("matched_distinct"))
    share = ratio(F.col("matched_rows"), F.col("fk_rows"))
    return agg.select("fk_rows", "matched_rows", (F.col("fk_rows") - F.col("matched_rows")).alias("orphan_rows"), share.alias("containment"), ratio(F.col("matched_distinct"), F.col("fk_distinct")).alias("distinct_containment"), (share >= 0.85).alias("is_contained"))


def text_containment(fk: DataFrame, pk: DataFrame, fk_col: str, pk_col: str) -> DataFrame:
    """Share of the distinct fk texts (trimmed, lower case, without null words) that are pk texts; 0 if either has none."""

    def texts(df: DataFrame, c: str) -> DataFrame:
        v = F.trim(F.col(c).cast("string"))
        return df.where(F.col(c).isNotNull() & ~v.isin("", "none", "null")).select(F.lower(v).alias("v")).distinct()

    j = texts(fk, fk_col).join(texts(pk, pk_col).withColumn("hit", F.lit(1)), "v", "left")
    return j.agg(F.count("*").alias("fk_values"), F.count("hit").alias("matched_values")).select("fk_values", "matched_values", ratio(F.col("matched_values"), F.col("fk_values")).alias("ratio"))


def join_recommendations(relations: DataFrame, min_confidence: float = 0.7, min_containment: float = 0.9) -> DataFrame:
    """True foreign keys that are sure and contained enough to join on, with the join's type."""
    good = relations.where((F.col("classification") == "TRUE_FK") & (F.col("confidence") >= min_confidence) & (F.col("containment") >= min_containment))
    return good.withColumn("join_type", F.when(F.col("containment") >= 0.9, "INNER").otherwise("LEFT"))


def column_relations(edges: DataFrame) -> DataFrame:
    """Per column: the columns it refers to and those that refer to it."""
    a, b = F.concat_ws(".", "fk_table", "fk_column"), F.concat_ws(".", "pk_table", "pk_column")
    none = F.lit(None).cast("string")
    both = edges.select(a.alias("name"), b.alias("out"), none.alias("in")).unionByName(edges.select(b.alias("name"), none.alias("out"), a.alias("in")))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return both.groupBy("name").agg(listed("out").alias("outgoing"), listed("in").alias("incoming"))
