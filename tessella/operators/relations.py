"""Foreign keys: candidate pairs, suppression, confidence, adjudication and choice.

Metadata frames have a row per column of the catalog, so pairs of columns are made by a join of
two such frames; values are counted per column first and joined on their equality, so a hot
value is one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import names, roles
from tessella.operators.profile import ratio

# Fixed values: (foreign type, key type) -> (score, whether a cast is needed); aliases of types; casts by name.
TYPE_MATRIX = {
    ("INTEGER", "BIGINT"): (0.95, True), ("INTEGER", "FLOAT"): (0.7, True), ("INTEGER", "DOUBLE"): (0.7, True), ("INTEGER", "STRING"): (0.3, True), ("INTEGER", "DECIMAL"): (0.8, True),
    ("BIGINT", "INTEGER"): (0.85, True), ("BIGINT", "FLOAT"): (0.6, True), ("BIGINT", "DOUBLE"): (0.7, True), ("BIGINT", "STRING"): (0.3, True), ("BIGINT", "DECIMAL"): (0.8, True),
    ("FLOAT", "DOUBLE"): (0.95, False), ("DOUBLE", "FLOAT"): (0.9, True), ("FLOAT", "INTEGER"): (0.5, True), ("FLOAT", "STRING"): (0.3, True), ("DOUBLE", "INTEGER"): (0.5, True), ("DOUBLE", "STRING"): (0.3, True),
    ("STRING", "INTEGER"): (0.2, True), ("STRING", "BIGINT"): (0.2, True), ("STRING", "UUID"): (0.85, False), ("STRING", "DATE"): (0.4, True), ("STRING", "TIMESTAMP"): (0.4, True),
    ("UUID", "STRING"): (0.9, False),
    ("DATE", "TIMESTAMP"): (0.85, True), ("TIMESTAMP", "DATE"): (0.75, True), ("DATE", "STRING"): (0.4, True), ("TIMESTAMP", "STRING"): (0.4, True),
    ("DECIMAL", "INTEGER"): (0.7, True), ("DECIMAL", "BIGINT"): (0.7, True), ("DECIMAL", "FLOAT"): (0.8, True), ("DECIMAL", "DOUBLE"): (0.85, True), ("DECIMAL", "STRING"): (0.3, True),
    ("BOOLEAN", "INTEGER"): (0.2, True), ("BOOLEAN", "STRING"): (0.2, True), ("INTEGER", "BOOLEAN"): (0.1, True),
    ("JSON", "STRING"): (0.3, True), ("ARRAY", "STRING"): (0.2, True),
}
TYPE_ALIASES = {"INT": "INTEGER", "INT64": "BIGINT", "LONG": "BIGINT", "FLOAT64": "DOUBLE", "VARCHAR": "STRING", "TEXT": "STRING", "CHAR": "STRING", "DATETIME": "TIMESTAMP", "TIMESTAMP_MS": "TIMESTAMP", "TIMESTAMP_NS": "TIMESTAMP", "BOOL": "BOOLEAN"}
CASTS = {
    ("INTEGER", "BIGINT"): "cast_to_bigint", ("BIGINT", "INTEGER"): "safe_cast_check_overflow", ("INTEGER", "STRING"): "cast_to_string", ("STRING", "UUID"): "parse_uuid", ("UUID", "STRING"): "uuid_to_string",
    ("DATE", "TIMESTAMP"): "date_to_timestamp", ("TIMESTAMP", "DATE"): "truncate_to_date", ("FLOAT", "DOUBLE"): "promote_precision", ("DOUBLE", "FLOAT"): "reduce_precision",
}
INTEGERS, TEXTS = ["integer", "bigint", "smallint", "int"], ["string", "varchar", "text"]
# Name patterns that rule a foreign key out.
OUT_GUID = "rowguid|guid|uuid|uniqueidentifier"
OUT_TEMPORAL = "created.*at|updated.*at|modified.*at|deleted.*at|valid.*from|validfrom|valid.*to|validto|effective.*date|expiry.*date|timestamp|lasteditedby|createdby|modifiedby|.*date"
OUT_MUTABLE = ".*phone.*|.*email.*|.*address.*|.*postal.*code.*|.*zip.*code.*"
OUT_MEASURE = "(amount|price|cost|quantity|population|count|total|sum|average|balance)$"
OUT_GEO = ".*location|.*coordinate.*|.*latitude|.*longitude|.*geom.*|.*point|.*polygon"
DESCRIPTIVE = "(name|title|description|comments?|notes?|text|memo)$"
#: Shares of the confidence.
WEIGHTS = {"containment": 0.35, "overlap": 0.25, "type_score": 0.10, "naming": 0.15, "domain": 0.20}
ACCEPT, CONTAINED = 0.75, 0.85


def normal_type(t: Column) -> Column:
    t = F.upper(F.trim(t))
    known = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(known[t], t)


def type_score(fk: Column, pk: Column) -> Column:
    """1 for the same type, else the pair's score; 0 for an unknown pair."""
    a, b = normal_type(fk), normal_type(pk)
    known = F.create_map(*[x for (p, q), (score, _) in TYPE_MATRIX.items() for x in (F.lit(f"{p}>{q}"), F.lit(score))])
    return F.when(a == b, 1.0).otherwise(F.coalesce(known[F.concat(a, F.lit(">"), b)], F.lit(0.0)))


def cast_of(fk: Column, pk: Column) -> Column:
    """The cast that a pair needs: its name, `automatic`, or null."""
    a, b = normal_type(fk), normal_type(pk)
    known = F.create_map(*[x for k, (_, needed) in TYPE_MATRIX.items() if needed for x in (F.lit(">".join(k)), F.lit(CASTS.get(k, "automatic")))])
    return F.when(a != b, known[F.concat(a, F.lit(">"), b)])


def same_family(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return (a == b) | (a.isin(INTEGERS) & b.isin(INTEGERS)) | (a.isin(TEXTS) & b.isin(TEXTS))


def naming(fk: Column, pk: Column, pk_table: Column) -> Column:
    """1 if equal; .95 and .9 if the foreign column's entity is the table, or its plural; else as names alike."""
    a, b, t = F.lower(fk), F.lower(pk), F.lower(pk_table)
    return F.when(a == b, 1.0).when(names.entity(a) == t, 0.95).when(F.concat(names.entity(a), F.lit("s")) == t, 0.9).otherwise(names.similarity(a, b))


def owners(columns: DataFrame) -> DataFrame:
    """The key columns that carry their own table's name."""
    own = (names.entity(F.col("column_name")) == roles.table_root(F.col("table_name"))) & F.col("column_name").rlike(roles.IDENTIFIER)
    return columns.where(own)


def candidate_pairs(columns: DataFrame, keys: DataFrame, least_naming: float = 0.5, most_ratio: float = 1.05) -> DataFrame:
    """Pairs of a column and another table's key with alike names, fitting types and no more values than the key; audit, guid and flag columns take no part.

    columns, keys: table_name, column_name, physical_type, total_count, non_null_count, distinct_count.
    """
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{n}") for c, n in (("table_name", "table"), ("column_name", "column"), ("physical_type", "type"), ("total_count", "rows"), ("non_null_count", "known"), ("distinct_count", "distinct"))])
    live = columns.where(~names.is_audit(F.col("column_name")) & ~F.lower("column_name").rlike(f"{OUT_GUID}|^is_|^has_"))
    pairs = side(live, "fk").join(side(keys, "pk"), F.col("fk_table") != F.col("pk_table"))
    pairs = pairs.withColumn("naming", naming(F.col("fk_column"), F.col("pk_column"), F.col("pk_table"))).withColumn("type_score", type_score(F.col("fk_type"), F.col("pk_type")))
    pairs = pairs.withColumn("cardinality_ratio", F.try_divide(F.col("fk_distinct").cast("double"), F.col("pk_distinct").cast("double")))
    return pairs.where((F.col("naming") >= least_naming) & (F.col("type_score") >= 0.5) & (F.col("cardinality_ratio") <= most_ratio))


def with_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Adds matched_rows, matched_distinct, containment (of the foreign rows) and overlap (of the key's values). values: table_name, column_name, value, freq."""
    v = values.where("value is not null")
    ids = ["fk_table", "fk_column", "pk_table", "pk_column"]
    left = pairs.select(*ids).join(v.select(F.col("table_name").alias("fk_table"), F.col("column_name").alias("fk_column"), "value", "freq"), ["fk_table", "fk_column"])
    right = v.select(F.col("table_name").alias("pk_table"), F.col("column_name").alias("pk_column"), "value")
    hits = left.join(right, ["pk_table", "pk_column", "value"]).groupBy(*ids).agg(F.sum("freq").alias("matched_rows"), F.count("*").alias("matched_distinct"))
    out = pairs.join(hits, ids, "left").withColumn("matched_rows", F.coalesce("matched_rows", F.lit(0))).withColumn("matched_distinct", F.coalesce("matched_distinct", F.lit(0)))
    return out.withColumn("containment", ratio(F.col("matched_rows"), F.col("fk_known"))).withColumn("overlap", ratio(F.col("matched_distinct"), F.col("pk_distinct")))


def suppression(pairs: DataFrame) -> DataFrame:
    """Adds suppressed and penalty (at most .5)."""
    n, d = F.lower("fk_column"), F.col("fk_distinct")
    same_id = (n == F.lower("pk_column")) & n.rlike(roles.IDENTIFIER)
    near = F.coalesce(F.col("cardinality_ratio").between(0.8, 1.05), F.lit(False))
    hard = n.rlike(OUT_GUID) | n.rlike(f"^({OUT_TEMPORAL})") | (F.col("fk_type") == "BOOLEAN") | (d == 2) | (d == 1) | n.rlike(f"^({OUT_MUTABLE})") | n.rlike(OUT_MEASURE) | n.rlike(f"^({OUT_GEO})")
    soft = F.when(d == 2, 0.20).otherwise(0.0) + F.when(~same_id & ~near & (d > 0) & (d < 10), 0.12).otherwise(0.0) + F.when((F.col("fk_type") == "STRING") & n.rlike(DESCRIPTIVE), 0.30).otherwise(0.0)
    return pairs.withColumn("suppressed", hard).withColumn("penalty", F.least(F.lit(0.5), soft))


def confidence(pairs: DataFrame) -> DataFrame:
    """Adds domain, confidence and accepted."""
    p = pairs.withColumn("domain", F.when(names.entity(F.col("fk_column")) == roles.table_root(F.col("pk_table")), 1.0).otherwise(0.0))
    score = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    score = F.when(F.col("containment") < 0.7, F.least(score, F.lit(0.6))).otherwise(score)
    nulls = 1 - ratio(F.col("fk_known"), F.col("fk_rows"))
    score = score - F.when(nulls > 0.5, (nulls - 0.5) * 0.2).otherwise(0.0)
    over = F.col("cardinality_ratio") - 1
    score = score - F.when(over > 0, F.least(F.lit(0.3), over * 0.5)).otherwise(0.0)
    p = p.withColumn("confidence", F.when(F.col("domain") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
    return p.withColumn("accepted", (F.col("confidence") >= ACCEPT) & (F.col("containment") >= CONTAINED) & ~F.col("suppressed"))


def integrity(pairs: DataFrame) -> DataFrame:
    """Adds strong, acceptable and integrity: containment less half of the orphans' share of it."""
    c = F.col("containment")
    return pairs.withColumn("strong", c >= 0.95).withColumn("acceptable", c >= CONTAINED).withColumn("integrity", c * (1 - 0.5 * (1 - c)))


def production(pairs: DataFrame, transactions: tuple[str, ...] = ("order", "invoice", "transaction"), enums: tuple[str, ...] = ("type", "method", "category")) -> DataFrame:
    """Adds production_score and its class; another entity's key is no match."""
    root = names.entity(F.col("fk_column"))
    entity = root == roles.table_root(F.col("pk_table"))
    exact = F.when(F.col("fk_column") == F.col("pk_column"), 1.0).when(root == names.entity(F.col("pk_column")), 0.85).otherwise(0.0)
    fits = (F.col("pk_distinct") > 0) & (F.col("fk_distinct") <= F.col("pk_distinct")) & (ratio(F.col("fk_distinct"), F.col("fk_known")) <= ratio(F.col("pk_distinct"), F.col("pk_known")) + 1e-9)
    semantic = F.when(F.col("fk_column").rlike(roles.IDENTIFIER), 0.6).otherwise(0.0)
    score = 0.30 * F.col("containment") + 0.25 + 0.20 * exact + 0.10 * same_family(F.col("fk_type"), F.col("pk_type")).cast("double") + 0.10 * fits.cast("double") + 0.05 * semantic
    score = F.when(entity, F.round(score, 4)).otherwise(0.0)
    kind = (
        F.when(~entity | (score < ACCEPT), "INVALID_MATCH")
        .when(roles.table_root(F.col("pk_table")).isin(list(transactions)), "TRANSACTION_REFERENCE")
        .when((F.col("fk_distinct") < 20) & root.rlike("|".join(enums)), "ENUM_REFERENCE")
        .when((F.col("fk_distinct") < 100) & F.lower("pk_table").rlike("^(application_|warehouse_)"), "DIMENSION_REFERENCE")
        .otherwise("FOREIGN_KEY")
    )
    return pairs.withColumn("production_score", score).withColumn("relationship_class", kind)


def adjudicate(containment: Column, semantic: Column, type_score: Column, confidence: Column, same_entity: Column, warned: Column) -> Column:
    """The class of a pair, by the first rule that holds."""
    return (
        F.when((containment >= 0.95) & (semantic >= 0.6), "TRUE_FK")
        .when((containment >= 0.85) & (semantic >= 0.6) & (type_score >= 0.5), "TRUE_FK")
        .when((containment < 0.5) & (semantic >= 0.75), "SEMANTICALLY_RELATED")
        .when(same_entity & (containment < 0.7), "SHARED_ENTITY_DOMAIN")
        .when(warned, "FALSE_POSITIVE")
        .when((containment < 0.5) & (semantic < 0.4) & (confidence < 0.6), "FALSE_POSITIVE")
        .when((containment >= 0.5) & (containment < 0.85), "POSSIBLE_REFERENCE")
        .otherwise("FALSE_POSITIVE")
    )


def best_per_column(pairs: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The most confident pair of each foreign column, if sure enough; ties by the key's name."""
    w = Window.partitionBy("fk_table", "fk_column").orderBy(F.desc("confidence"), "pk_table", "pk_column")
    return pairs.where(F.col("confidence") >= least).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def join_sql(edges: list[dict], base: str) -> str:
    """A query that joins a table with all that it refers to; INNER where nothing is lost, else LEFT."""
    lines = [f"SELECT * FROM {base}"]
    for k, e in enumerate(sorted((e for e in edges if e["fk_table"] == base), key=lambda e: (e["fk_column"], e["pk_table"]))):
        lines.append(f"{'INNER' if e['containment'] >= 1 else 'LEFT'} JOIN {e['pk_table']} AS t{k} ON {base}.{e['fk_column']} = t{k}.{e['pk_column']}")
    return "\n".join(lines)
