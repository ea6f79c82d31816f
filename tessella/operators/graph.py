"""Graph operators on relationship edges (fk_table, pk_table, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each table, outward and inward."""
    e = edges.select("fk_table", "pk_table").distinct()
    out = e.groupBy(F.col("fk_table").alias("node")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy(F.col("pk_table").alias("node")).agg(F.count("*").alias("in_degree"))
    both = out.join(into, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    return both.withColumn("is_root", F.col("in_degree") == 0).withColumn("is_leaf", F.col("out_degree") == 0)


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("fk_table").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("pk_table")), ",").alias("neighbours"))


def dedupe(edges: DataFrame) -> DataFrame:
    """The most confident edge of each pair of columns."""
    w = Window.partitionBy("fk_table", "fk_column", "pk_table", "pk_column").orderBy(F.desc("confidence"))
    return edges.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component (its smallest node): each round hangs larger neighbours, then smaller ones, below the smallest, until nothing changes; a path of n tables takes about log n rounds."""
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = edges.select(F.explode(F.array("fk_table", "pk_table")).alias("node")).distinct()
    links = cut(edges.where("fk_table <> pk_table").select(F.greatest("fk_table", "pk_table").alias("u"), F.least("fk_table", "pk_table").alias("v")).distinct())
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
    before = state(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        links = cut(large.join(down, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = state(links)
        if now == before:
            return nodes.join(links, nodes["node"] == links["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
        before = now
    raise RuntimeError("components did not settle")


def on_cycles(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """The tables that reach themselves: paths double in length each round, until there are no new ones."""
    reach = cut(edges.select(F.col("fk_table").alias("s"), F.col("pk_table").alias("t")).distinct())
    count = reach.count()
    for _ in range(rounds):
        reach = cut(reach.unionByName(reach.join(reach.toDF("t", "u"), "t").select("s", F.col("u").alias("t"))).distinct())
        if (now := reach.count()) == count:
            return reach.where("s = t").select(F.col("s").alias("node")).distinct()
        count = now
    raise RuntimeError("paths did not settle")


def parents_children(edges: DataFrame) -> DataFrame:
    """Per table the tables it refers to and those that refer to it."""
    e = edges.select("fk_table", "pk_table").distinct()
    none = F.lit(None).cast("string")
    both = e.select(F.col("fk_table").alias("node"), F.col("pk_table").alias("p"), none.alias("c")).unionByName(e.select(F.col("pk_table").alias("node"), none.alias("p"), F.col("fk_table").alias("c")))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return both.groupBy("node").agg(listed("p").alias("parents"), listed("c").alias("children"))


def tree(edges: DataFrame, depth: int = 8) -> DataFrame:
    """Paths from the roots (tables that refer to no other) down to the tables that refer to them: root, node, depth, path, truncated (a table on its own path again, which ends it). A loop on itself doesn't count."""
    e = cut(edges.where("fk_table <> pk_table").select(F.col("pk_table").alias("parent"), F.col("fk_table").alias("child")).distinct())
    roots = e.select(F.col("parent").alias("node")).distinct().join(e.select(F.col("child").alias("node")), "node", "left_anti")
    level = cut(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("truncated")))
    out = level
    for k in range(1, depth + 1):
        again = F.array_contains("path", F.col("child"))
        level = cut(level.where("not truncated").join(e, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), F.lit(k).alias("depth"), F.concat("path", F.array("child")).alias("path"), again.alias("truncated")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.withColumn("path", F.array_join("path", ">"))


def expand(edges: DataFrame, node: str, visited: list[str]) -> DataFrame:
    """The tables that refer to one table, and whether they were visited."""
    return edges.where(F.col("pk_table") == node).select(F.col("fk_table").alias("child"), "fk_column", "pk_column").distinct().withColumn("visited", F.col("child").isin(visited) if visited else F.lit(False))


def metrics(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: counts, confidences, components, density and tables without an edge. tables: node."""
    c = edges.agg(F.count("*").alias("relationship_count"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.avg("confidence").alias("avg_confidence"), F.expr("percentile(confidence, 0.5)").alias("median_confidence"))
    linked = edges.select(F.explode(F.array("fk_table", "pk_table")).alias("node")).distinct()
    comps = components(edges).groupBy("component").agg(F.count("*").alias("size"))
    orphans = tables.join(linked, "node", "left_anti").agg(F.count("*").alias("orphan_table_count"))
    sizes = comps.agg(F.count("*").alias("linked_components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_linked"))
    n = tables.agg(F.count("*").alias("table_count"))
    row = n.join(c, F.lit(True)).join(sizes, F.lit(True)).join(orphans, F.lit(True))  # one row each
    most = F.when(F.col("table_count") > 1, F.col("table_count") * (F.col("table_count") - 1)).otherwise(1)
    return row.select(
        "table_count", "relationship_count", "min_confidence", "max_confidence", "avg_confidence", "median_confidence", "orphan_table_count",
        (F.col("linked_components") + F.col("orphan_table_count")).alias("connected_components"),
        F.greatest("largest_linked", F.when(F.col("table_count") > 0, 1).otherwise(0)).cast("long").alias("largest_component_size"),
        F.round(F.col("relationship_count") / most, 6).alias("density"),
    )


def bridges(edges: DataFrame, composite: list[str] | None = None) -> DataFrame:
    """Tables with two foreign keys or more that have a composite key or a line or bridge name."""
    g = edges.groupBy(F.col("fk_table").alias("node")).agg(F.count("*").alias("n_fk"), F.array_join(F.array_sort(F.collect_set("pk_table")), ",").alias("targets"))
    named = F.lower("node").rlike("line|bridge|mapping")
    return g.where((F.col("n_fk") >= 2) & (named | F.col("node").isin(composite) if composite else named))


def search(edges: DataFrame, text: str) -> DataFrame:
    """Tables whose name holds the text: equal ones first, then those that begin with it, then by degree and name."""
    d = degrees(edges).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    n, t = F.lower("node"), text.lower()
    rank = F.when(n == t, 0).when(n.startswith(t), 1).otherwise(2)
    w = Window.orderBy(rank, F.desc("degree"), "node")  # the catalog's tables that match: a small frame
    return d.where(n.contains(t)).select("node", "degree", F.row_number().over(w).alias("rank"))


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """The k edges between the tables of the highest degrees (the sum of both), ties by names."""
    d = degrees(edges).select("node", (F.col("in_degree") + F.col("out_degree")).alias("d"))
    e = edges.join(d.toDF("fk_table", "a"), "fk_table").join(d.toDF("pk_table", "b"), "pk_table")
    return e.withColumn("weight", F.col("a") + F.col("b")).orderBy(F.desc("weight"), "fk_table", "fk_column", "pk_table").limit(k).select("fk_table", "fk_column", "pk_table", "pk_column", "weight")


def page(df: DataFrame, offset: int, size: int, *order: str) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def dot(edges: list[dict]) -> str:
    """The graph in DOT."""
    rows = sorted({(e["fk_table"], e["pk_table"], e["fk_column"]) for e in edges})
    return "digraph relationships {\n" + "".join(f'  "{a}" -> "{b}" [label="{c}"];\n' for a, b, c in rows) + "}\n"
