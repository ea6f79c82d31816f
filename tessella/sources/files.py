"""File sources by suffix, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The suffix of each format.
FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".ndjson": "json", ".jsonl": "json"}


def read(spark: SparkSession, path: str, sep: str | None = None, strict: bool = False) -> DataFrame:
    """Reads a file or folder; unknown suffixes are read as CSV unless `strict`."""
    low = path.lower().removesuffix(".gz")
    kind = next((k for s, k in FORMATS.items() if low.endswith(s)), None)
    if kind is None and strict:
        raise ValueError(f"no reader for {path}")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.option("multiLine", low.endswith(".json")).json(path)
    return spark.read.option("header", True).option("sep", sep or ("\t" if low.endswith(".tsv") else ",")).csv(path)


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """path and size of supported files, by Spark's own listing, without their contents. Files without bytes aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where("lower(path) rlike '\\\\.(csv|tsv|txt|parquet|json|ndjson|jsonl)(\\\\.gz)?$'").orderBy("path")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    w = df.write.mode(mode)
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)
