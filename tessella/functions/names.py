"""Rules on column and table names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(name: Column) -> Column:
    """Lower case, separators to one underscore, other signs dropped."""
    x = F.regexp_replace(F.regexp_replace(F.lower(name), r"[\s\-./]+", "_"), r"[^\w]", "")
    return F.regexp_replace(F.regexp_replace(x, "^_+|_+$", ""), "_+", "_")


def singular(word: Column) -> Column:
    """people, men, women and children; -ies to -y; else one final s (but -ss) off."""
    return (
        F.when(word == "people", "person").when(word == "men", "man").when(word == "women", "woman").when(word == "children", "child")
        .when(word.endswith("ies") & (F.length(word) > 3), F.concat(F.expr("''"), F.regexp_replace(word, "ies$", "y")))
        .when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def is_identifier(name: Column) -> Column:
    return F.lower(name).rlike(r"(^id$|id$|_id$|key$|_key$|code$|identifier$)")


def entity(name: Column) -> Column:
    """The name without a key suffix."""
    return F.regexp_replace(F.lower(name), r"(_id|id|_key|key|_fk|fk)$", "")


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, .8 if one holds the other, else at most .7 by the shared characters."""
    chars = lambda x: F.array_distinct(F.split(x, ""))
    shared = F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).otherwise(F.least(F.lit(0.7), shared))


# Name endings of audit references, and name parts of the semantic types, in order of precedence.
AUDIT_ENDINGS = ["createdby", "modifiedby", "lasteditedby", "editedby", "approvedby", "deletedby", "reviewedby", "insertedby", "updatedby", "userid", "editorid", "creatorid", "user_id", "editor_id", "creator_id"]
SEMANTIC_PARTS = {
    "temporal": ["validfrom", "validto", "createdat", "updatedat", "timestamp", "date"],
    "geospatial_coordinate": ["latitude", "longitude", "location", "geometry", "shape"],
    "measure": ["amount", "price", "quantity", "total", "count", "balance", "population", "revenue", "cost", "rate", "percentage"],
    "description": ["description", "comment", "remarks"],
    "name": ["name", "title", "label"],
}


def is_audit(name: Column) -> Column:
    return F.lower(name).rlike(f"({'|'.join(AUDIT_ENDINGS)})$")


def semantic_type(name: Column, physical_type: Column) -> Column:
    """Keys and audit references are identifiers; then the first type with a part in the name; then flags."""
    out = F.when(is_audit(name) | is_identifier(name), "identifier")
    for kind, parts in SEMANTIC_PARTS.items():
        out = out.when(F.lower(name).rlike("|".join(parts)), kind)
    return out.when(physical_type == "boolean", "boolean_flag").otherwise("unknown")


def token_similarity(a: Column, b: Column) -> Column:
    """1 if equal, .8 if one holds the other, else the Jaccard similarity of their parts."""
    a, b = F.lower(a), F.lower(b)
    parts = lambda x: F.array_distinct(F.filter(F.split(x, r"[_\W]+"), lambda t: t != ""))
    shared, all_parts = F.size(F.array_intersect(parts(a), parts(b))), F.size(F.array_union(parts(a), parts(b)))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).otherwise(F.coalesce(F.try_divide(shared.cast("double"), all_parts.cast("double")), F.lit(0.0)))


def module(table: Column) -> Column:
    """What stands before the first underscore or dot of a table's name; else core."""
    return F.when(table.rlike("[_.]"), F.split(table, "[_.]")[0]).otherwise("core")
