"""Sinks: canonical tables and profiles as JSON, relationships, and the graph as DBML, Mermaid and JSON. Frames of metadata only come to the driver: a row per column or edge."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "2.0.0"
_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "float", "FLOAT": "float", "DECIMAL": "decimal", "STRING": "varchar", "TIMESTAMP": "timestamp", "DATE": "date", "BOOLEAN": "boolean"}


def _word(name: str) -> str:
    return re.sub(r"\W", "_", name)


def canonical(columns: DataFrame) -> DataFrame:
    """table_name and one JSON document per table. columns: table_name, column_name, physical_type, ..."""
    rest = [c for c in columns.columns if c != "table_name"]
    per = columns.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("column_name", *[c for c in rest if c != "column_name"]))).alias("columns"))
    return per.select("table_name", F.to_json(F.struct(F.lit(VERSION).alias("version"), "table_name", F.size("columns").alias("n_columns"), "columns")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """A folder per table, with its document as text."""
    documents.write.mode("overwrite").partitionBy("table_name").text(path)


def append_log(spark: SparkSession, path: str, **values) -> None:
    """A row of a log, after those that are there."""
    spark.createDataFrame([{k: str(v) for k, v in values.items()}]).write.mode("append").option("header", True).csv(path)


def save_relationships(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").json(path)


def load_relationships(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fk_table string, fk_column string, pk_table string, pk_column string, confidence double, containment double").json(path)


def dbml(columns: list[dict], edges: list[dict]) -> str:
    """Tables with their columns, then references."""
    keys = {(e["pk_table"], e["pk_column"]) for e in edges}
    out = []
    for t in sorted({c["table_name"] for c in columns}):
        rows = [f"  {_word(c['column_name'])} {_TYPES.get(c['physical_type'], 'varchar')}{' [pk]' if (t, c['column_name']) in keys else ''}" for c in columns if c["table_name"] == t]
        out.append(f"Table {_word(t)} {{\n" + "\n".join(rows) + "\n}")
    refs = sorted(f"Ref: {_word(e['fk_table'])}.{_word(e['fk_column'])} > {_word(e['pk_table'])}.{_word(e['pk_column'])}" for e in edges)
    return "\n\n".join(out) + "\n\n" + "\n".join(refs) + "\n"


def mermaid(columns: list[dict], edges: list[dict]) -> str:
    lines = ["erDiagram"]
    for t in sorted({c["table_name"] for c in columns}):
        lines += [f"  {_word(t)} {{", *[f"    {_TYPES.get(c['physical_type'], 'varchar')} {_word(c['column_name'])}" for c in columns if c["table_name"] == t], "  }"]
    return "\n".join(lines + sorted(f"  {_word(e['pk_table'])} ||--o{{ {_word(e['fk_table'])} : {_word(e['fk_column'])}" for e in edges)) + "\n"


def graph_json(edges: list[dict]) -> str:
    nodes = sorted({x for e in edges for x in (e["fk_table"], e["pk_table"])})
    links = sorted(({"id": "__".join((e["fk_table"], e["fk_column"], e["pk_table"], e["pk_column"])), "source": e["fk_table"], "target": e["pk_table"], "confidence": e.get("confidence")} for e in edges), key=lambda x: x["id"])
    return json.dumps({"version": "1.0", "nodes": [{"id": n} for n in nodes], "edges": links}, indent=1)


_TABLE = re.compile(r"^\s*Table\s+\"?(\w+)\"?\s*\{(.*?)^\s*\}", re.S | re.M)
_REF = re.compile(r"^\s*Ref[^:]*:\s*\"?(\w+)\"?\.\"?(\w+)\"?\s*([<>-])\s*\"?(\w+)\"?\.\"?(\w+)\"?", re.M)


def parse_dbml(text: str) -> dict:
    """tables (name -> column -> type), refs (foreign side first), duplicates (tables named twice) and unresolved (references to what isn't there)."""
    tables: dict[str, dict[str, str]] = {}
    duplicates = []
    for name, body in _TABLE.findall(text):
        if name in tables:
            duplicates.append(name)
        tables[name] = {p[0].strip('"'): p[1] for line in body.splitlines() if len(p := line.split()) >= 2 and not p[0].startswith("//")}
    refs = [((c, d, a, b) if way == "<" else (a, b, c, d)) for a, b, way, c, d in _REF.findall(text)]
    missing = [r for r in refs if r[1] not in tables.get(r[0], {}) or r[3] not in tables.get(r[2], {})]
    return {"tables": tables, "refs": refs, "duplicates": duplicates, "unresolved": missing}
