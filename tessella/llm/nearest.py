"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Equal vectors are one node, so copies never crowd a neighbourhood. The graph starts from
neighbours along random projections, whose order is cut into blocks of a fixed size; each
round then joins every node's neighbours and reversed neighbours, compares those pairs of
which one is new, and keeps each node's nearest. A search starts from the query's own node
(or from given entry nodes), and expands the nearest nodes not expanded yet until a round
brings nothing nearer. Graph and search
compare the vectors themselves: the graph by products in double precision, the search by
exact differences, so one far vector costs the others nothing and near copies stay apart.
Vectors of floats travel as bytes.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor
do those of another length than most (ties: the shortest), nor rows without an id; of rows
with the same id, the smallest vector counts; ties in distance go to the smaller id; with
fewer candidates than asked for, all are returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, pick, prepare

#: Neighbours a node keeps, reversed neighbours it looks at, projections and block size of the start, rounds.
DEGREE, REVERSED, PROJECTIONS, BLOCK, ROUNDS = 24, 16, 4, 200, 6
#: A search keeps and expands so many nodes; rounds of a search.
BEAM, STEPS = 240, 8


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part, one per id."""
    rows = pick(vectors, "vec_id", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("embedding") == (size[0].n if size else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of numbers, from arrays or from the bytes of single-precision numbers."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        flat = np.frombuffer(b"".join(column.to_pylist()), np.float32)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _packed(classes: DataFrame) -> DataFrame:
    """node, v: the vectors without a loss; arrays of floats as bytes, others as they are."""
    if classes.schema["v"].dataType.simpleString() != "array<float>":
        return classes.select("node", "v")

    def run(b: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in _matrix(b.column("v"))], pa.binary())], names=["node", "v"])

    return arrow_map(classes.select("node", "v"), run, "node long, v binary")


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node."""
    w = Window.partitionBy("node").orderBy("dist", "other")
    return edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _start(nodes: DataFrame, projections: int, block: int, degree: int, seed: int = 7) -> DataFrame:
    """node, other, dist: each node's nearest among the blocks it falls in."""
    total = nodes.count()
    # Partitions of several blocks each; what fits in one block is one.
    n = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (4 * block)))
    out = None
    for p in range(projections):

        def key(b: pa.RecordBatch, p=p):
            x = _matrix(b.column("v")).astype(np.float64)
            code, order = np.zeros(len(x), np.int32), np.zeros(len(x))
            if x.shape[1]:
                rng = np.random.default_rng([seed, p])
                y = x @ rng.normal(size=(x.shape[1], 10))
                code, order = ((y[:, :9] > 0) @ (1 << np.arange(9))).astype(np.int32), y[:, 9]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), pa.array(code), pa.array(order)], names=["node", "v", "code", "at"])

        def near(batches):
            ids, rows = [], []

            def out():
                i, x = np.concatenate(ids), np.concatenate(rows).astype(np.float64)
                d = _distances(x, x)
                np.fill_diagonal(d, np.inf)
                k = min(degree, len(i) - 1)
                at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(i), 0), int)
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(i, k)), pa.array(i[at].ravel()), pa.array(np.take_along_axis(d, at, 1).ravel())], names=["node", "other", "dist"])

            held = 0
            for b in batches:
                i, x = b.column("node").to_numpy(), _matrix(b.column("v"))
                a = 0
                while a < len(i):
                    e = min(len(i), a + block - held)
                    ids.append(i[a:e])
                    rows.append(x[a:e])
                    held += e - a
                    a = e
                    if held == block:
                        yield out()
                        ids, rows, held = [], [], 0
            if held:
                yield out()

        kind = nodes.schema["v"].dataType.simpleString()
        keyed = arrow_map(nodes, key, f"node long, v {kind}, code int, at double")
        ranged = keyed.coalesce(1) if total <= block else keyed.repartitionByRange(n, "code", "at")
        part = ranged.sortWithinPartitions("code", "at", "node").mapInArrow(near, "node long, other long, dist double")
        out = part if out is None else out.unionByName(part)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def _local_join(sides: DataFrame) -> DataFrame:
    """sides: centre, node, v, new, worst. Pairs of one centre's nodes, one of them new, that are nearer than the node's worst: node, other, dist.

    A centre has at most DEGREE + REVERSED sides, however large the table is.
    """
    n = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        rest: list = []

        def pairs(c, node, x, new, worst):
            edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
            out = []
            for a, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if e - a < 2 or not new[a:e].any():
                    continue
                d = _distances(x[a:e], x[a:e])
                ok = (d < worst[a:e, None]) & (new[a:e, None] | new[None, a:e])
                i, j = np.nonzero(ok)
                keep = i != j
                i, j = i[keep], j[keep]
                out.append((node[a:e][i], node[a:e][j], d[i, j]))
            return [np.concatenate(z) for z in zip(*out)] if out else None

        def batch(z):
            return pa.RecordBatch.from_arrays([pa.array(z[0]), pa.array(z[1]), pa.array(z[2])], names=["node", "other", "dist"])

        for b in batches:
            got = [b.column("centre").to_numpy(), b.column("node").to_numpy(), _matrix(b.column("v")).astype(np.float64), b.column("new").to_numpy(zero_copy_only=False), b.column("worst").to_numpy()]
            if rest and len(got[0]):
                got = [np.concatenate(z) for z in zip(rest, got)]
            if not len(got[0]):
                continue
            cut = int(np.searchsorted(got[0], got[0][-1]))
            z = pairs(*[g[:cut] for g in got])
            rest = [g[cut:] for g in got]
            if z:
                yield batch(z)
        if rest:
            z = pairs(*rest)
            if z:
                yield batch(z)

    return sides.repartition(n, "centre").sortWithinPartitions("centre", "node").mapInArrow(run, "node long, other long, dist double")


def build(nodes: DataFrame, scratch: Scratch, degree: int = DEGREE, reverse: int = REVERSED, rounds: int = ROUNDS, projections: int = PROJECTIONS, block: int = BLOCK) -> DataFrame:
    """The graph: node, other, dist (squared), new."""
    first = _start(nodes, projections, block, degree).groupBy("node", "other").agg(F.min("dist").alias("dist"))
    graph = scratch.table(_top(first, degree).withColumn("new", F.lit(True)), "nn-graph0")
    total = max(1, nodes.count() * degree)
    for k in range(1, rounds + 1):
        back = graph.select(F.col("other").alias("centre"), F.col("node"), "new")
        w = Window.partitionBy("centre").orderBy(F.desc("new"), F.xxhash64("centre", "node"))
        back = back.withColumn("r", F.row_number().over(w)).where(F.col("r") <= reverse).drop("r")
        sides = graph.select(F.col("node").alias("centre"), F.col("other").alias("node"), "new").unionByName(back).groupBy("centre", "node").agg(F.max("new").alias("new"))
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= degree, F.max("dist")).otherwise(F.lit(float("inf"))).alias("worst"))
        info = nodes.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        better = _local_join(sides.join(info, "node"))
        merged = graph.select("node", "other", "dist", F.lit(False).alias("new")).unionByName(better.withColumn("new", F.lit(True)))
        merged = merged.groupBy("node", "other").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
        graph = scratch.table(_top(merged, degree), f"nn-graph{k}")
        scratch.drop_table(f"nn-graph{k - 1}")
        if graph.where("new").count() < 0.01 * total:
            break
    return graph


def _to_query(pairs: DataFrame) -> DataFrame:
    """q, node, dist from q, node, x (the query's vector), v."""

    def run(b: pa.RecordBatch):
        x, y = _matrix(b.column("x")).astype(np.float64), _matrix(b.column("v")).astype(np.float64)
        d = ((x - y) ** 2).sum(1) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(d)], names=["q", "node", "dist"])

    return arrow_map(pairs.select("q", "node", "x", "v"), run, "q long, node long, dist double")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, scratch: Scratch, beam: int = BEAM, steps: int = STEPS, reverse: int = DEGREE) -> DataFrame:
    """queries: q, x, entry. The `beam` nearest nodes found for each query: q, node, dist (squared)."""
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "dist")
    links = scratch.table(_top(graph.select("node", "other", "dist").unionByName(back).distinct(), DEGREE + reverse).select("node", "other"), "nn-links")
    x = queries.select("q", "x")
    state = _to_query(queries.select("q", "x", F.col("entry").alias("node")).join(nodes, "node")).withColumn("done", F.lit(False))
    state = scratch.table(state, "nn-search0")
    w = Window.partitionBy("q").orderBy("dist", "node")
    for k in range(1, steps + 1):
        front = state.where("not done").select("q", F.col("node").alias("at"))
        if front.isEmpty():
            break
        fresh = front.join(links, front["at"] == links["node"]).select("q", F.col("other").alias("node")).distinct()
        fresh = fresh.join(state.select("q", "node"), ["q", "node"], "left_anti")
        found = _to_query(fresh.join(nodes, "node").join(x, "q")).withColumn("done", F.lit(False))
        both = state.withColumn("done", F.lit(True)).unionByName(found)
        state = scratch.table(both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).drop("r"), f"nn-search{k}")
        scratch.drop_table(f"nn-search{k - 1}")
    return state.select("q", "node", "dist")


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, scratch: Scratch | None = None, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each query (rows of `vectors` with these vec_ids; or those divisible by `every`), without itself."""
    spark = prepare(vectors.sparkSession)
    scratch = scratch or Scratch(spark)
    rows = scratch.table(usable(vectors), "nn-rows")
    # One node per distinct vector, named by its smallest id; the k + 1 smallest ids of each are all that can be among the k nearest.
    classes = scratch.table(rows.groupBy("v").agg(F.min("vec_id").alias("node")), "nn-classes")
    nodes = scratch.table(_packed(classes), "nn-nodes")
    w = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    members = scratch.table(members.join(classes, "v").select("node", "vec_id"), "nn-members")
    graph = build(nodes, scratch)
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asked = asked.join(classes, "v").select(F.col("vec_id").alias("q"), F.col("node").alias("entry"))
    asked = scratch.table(asked.join(nodes, asked.entry == nodes.node).select("q", F.col("v").alias("x"), "entry"), "nn-asked")
    # The search's distances are exact, so all of its nodes take part in the ranking.
    found = search(asked, nodes, graph, scratch)
    hits = found.join(members, "node").where("vec_id <> q").select(F.col("q").alias("query_id"), "vec_id", F.sqrt("dist").alias("score"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
