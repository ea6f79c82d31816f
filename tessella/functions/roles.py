"""Roles and types of columns from their names, types and statistics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import names

# Name patterns of the families, in order of precedence.
AUDIT = r"(lasteditedby|createdby|modifiedby|updatedby|userid|editorid|creatorid)"
TEMPORAL = r"(validfrom|validto|effective[_]?date|timestamp|date$)"
GEO = r"(location|latitude|longitude|geom|polygon|point)"
MEASURE = r"(amount|price|cost|quantity|count|total|tax|population|rate)$"
IDENTIFIER = r"(id|key)$"
# Roots of enumerations, and name parts of times.
ENUM_ROOTS = ["deliverymethod", "paymentmethod", "suppliercategory", "customercategory", "transactiontype"]
TEMPORAL_PARTS = ["date", "time", "timestamp", "validfrom", "validto", "createdat", "updatedat"]
AUDIT_PARTS = ["createdby", "updatedby", "modifiedby", "lasteditedby", "audit_"]


def table_root(table: Column) -> Column:
    """The singular last part of a table's name."""
    return names.singular(F.element_at(F.split(F.lower(table), "_"), -1))


def family(name: Column) -> Column:
    """The hint that a column's name gives, or null."""
    n = F.lower(name)
    return F.when(n.rlike(AUDIT), "AUDIT_HINT").when(n.rlike(TEMPORAL), "TEMPORAL_HINT").when(n.rlike(GEO), "GEOSPATIAL").when(n.rlike(MEASURE), "MEASURE")


def role(table: Column, name: Column, physical_type: Column) -> Column:
    n, root = F.lower(name), names.entity(name)
    hint, is_id = family(name), n.rlike(IDENTIFIER)
    return (
        F.when(hint == "AUDIT_HINT", "AUDIT_REFERENCE").when(hint == "TEMPORAL_HINT", "SCD_COLUMN").when(hint == "GEOSPATIAL", "GEO").when(hint == "MEASURE", "MEASURE")
        .when(is_id & F.lower(table).rlike("line|bridge|mapping"), "BRIDGE_KEY")
        .when(is_id & (root == table_root(table)), "PRIMARY_OWNER").when(is_id & root.isin(ENUM_ROOTS), "ENUM_REFERENCE").when(is_id, "FOREIGN_REFERENCE")
        .when(F.lower(physical_type).isin("date", "datetime", "timestamp"), "TEMPORAL_COLUMN").otherwise("DESCRIPTIVE")
    )


def looks_temporal(name: Column) -> Column:
    return F.lower(name).rlike("|".join(TEMPORAL_PARTS))


def logical_type(name: Column, physical_type: Column, semantic_type: Column) -> Column:
    s = semantic_type
    return (
        F.when(names.is_audit(name), "audit_reference").when(s == "identifier", "identifier").when(s == "temporal", "timestamp")
        .when(F.lower(name).rlike("|".join(AUDIT_PARTS)), "audit").when(s == "measure", "measure").when(s == "geospatial_coordinate", "geospatial")
        .when(s.isin("description", "name"), "description").when((F.lower(physical_type) == "boolean") | (s == "boolean_flag"), "category").otherwise("unknown")
    )


def hints(physical_type: Column, semantic_type: Column, logical: Column) -> list[Column]:
    """Six flags of a column."""
    return [
        logical.isin("identifier", "audit_reference").alias("is_identifier"),
        (logical == "timestamp").alias("is_temporal"),
        logical.isin("audit", "audit_reference").alias("is_audit"),
        (logical == "measure").alias("is_measure"),
        (logical.isin("category", "description") | (semantic_type == "name")).alias("is_dimension"),
        ((F.lower(physical_type) == "string") & (logical == "description")).alias("is_text"),
    ]


def workload(counts: dict[str, Column], total: Column) -> Column:
    """What a table is used for, from how many of its columns look like what."""
    ids = counts["id"] + counts["fk"]
    return (
        F.when((counts["feature"] >= 5) | (counts["feature"] / total > 0.5), "ml_features")
        .when((counts["text"] >= 3) | (counts["text"] / total > 0.3), "nlp_corpus")
        .when((counts["time"] >= 2) & (counts["measure"] >= 2), "time_series")
        .when((counts["time"] >= 1) & (counts["id"] >= 1) & (counts["measure"] == 0), "event_stream")
        .when((counts["measure"] >= 3) & (ids >= 2), "analytical_olap")
        .when(ids >= 3, "transactional")
        .otherwise("mixed")
    )


# Name patterns that tell workloads.
WORKLOAD = {
    "id": r"(^id$|_id$|^.*id$)",
    "fk": r"(customer|order|product|user|person|account).*id",
    "time": r"(date|time|timestamp|created|updated|when)",
    "measure": r"(amount|price|quantity|total|count|sum|revenue|cost)",
    "pii": r"(email|phone|ssn|address|name|dob|birth)",
    "text": r"(description|comment|note|text|body|content|message)",
    "feature": r"(feature|score|rating|prediction|label|target)",
}


def complexity(size_mb: Column, columns: Column, rows: Column, packed: bool, kind: str, utf8: bool = True) -> Column:
    """0 to 10 points for size, columns, rows, compression, format and encoding."""
    steps = lambda x, *pairs: F.coalesce(*[F.when(x < limit, F.lit(points)) for limit, points in pairs[:-1]], F.lit(pairs[-1][1]))
    formats = {"parquet": 0.0, "csv": 0.5, "tsv": 0.5, "json": 1.0, "jsonl": 0.8, "xml": 1.5, "excel": 0.7}
    fixed = 1.0 * packed + formats.get(kind, 0.5) + 0.5 * (not utf8)
    return (
        steps(size_mb, (1, 0.0), (10, 0.5), (100, 1.0), (1024, 1.5), (10240, 2.0), (None, 3.0))
        + steps(columns, (10, 0.0), (50, 0.5), (200, 1.0), (1000, 1.5), (None, 2.0))
        + steps(rows, (1000, 0.0), (100_000, 0.5), (1_000_000, 1.0), (10_000_000, 1.5), (None, 2.0))
        + F.lit(fixed)
    )
