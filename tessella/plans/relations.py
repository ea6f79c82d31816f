"""Registered queries on columns and relationships of the whole catalog, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import names, roles
from tessella.operators import graph, profile, relations
from tessella.session import cut

#: The catalog: owner-style table names, and per column its source, name and type.
VIEWS = {
    "application_regions": ("region", {"r_regionkey": ("regionid", "INTEGER"), "r_name": ("regionname", "STRING")}),
    "application_nations": ("nation", {"n_nationkey": ("nationid", "INTEGER"), "n_name": ("nationname", "STRING"), "n_regionkey": ("regionid", "INTEGER")}),
    "purchasing_suppliers": ("supplier", {"s_suppkey": ("supplierid", "BIGINT"), "s_name": ("suppliername", "STRING"), "s_nationkey": ("nationid", "INTEGER"), "s_acctbal": ("accountbalance", "DOUBLE")}),
    "sales_customers": ("customer", {"c_custkey": ("customerid", "BIGINT"), "c_name": ("customername", "STRING"), "c_nationkey": ("nationid", "INTEGER"), "c_acctbal": ("accountbalance", "DOUBLE"), "c_mktsegment": ("marketsegment", "STRING")}),
    "warehouse_parts": ("part", {"p_partkey": ("partid", "BIGINT"), "p_name": ("partname", "STRING"), "p_brand": ("brand", "STRING"), "p_type": ("parttype", "STRING"), "p_size": ("partsize", "INTEGER"), "p_retailprice": ("retailprice", "DOUBLE")}),
    "sales_orders": ("orders", {"o_orderkey": ("orderid", "BIGINT"), "o_custkey": ("customerid", "BIGINT"), "o_orderstatus": ("orderstatus", "STRING"), "o_totalprice": ("totalprice", "DOUBLE"), "o_orderdate": ("orderdate", "TIMESTAMP"), "o_orderpriority": ("orderpriority", "STRING")}),
    "sales_orderlines": ("lineitem", {"l_orderkey": ("orderid", "BIGINT"), "l_partkey": ("partid", "BIGINT"), "l_suppkey": ("supplierid", "BIGINT"), "l_linenumber": ("linenumber", "INTEGER"), "l_quantity": ("quantity", "DOUBLE"), "l_extendedprice": ("extendedprice", "DOUBLE"), "l_discount": ("discount", "DOUBLE"), "l_tax": ("taxrate", "DOUBLE"), "l_returnflag": ("returnflag", "STRING"), "l_linestatus": ("linestatus", "STRING"), "l_shipdate": ("shipdate", "TIMESTAMP")}),
    "web_events": ("events", {"event_id": ("eventid", "BIGINT"), "ts": ("createdat", "TIMESTAMP"), "user_id": ("userid", "BIGINT"), "event_type": ("eventtype", "STRING"), "value": ("amount", "DOUBLE"), "props": ("comments", "STRING")}),
}
ALL = [(v, t, c, n, k) for v, (t, cols) in VIEWS.items() for c, (n, k) in cols.items()]
KEYS = ["fk_table", "fk_column", "pk_table", "pk_column"]


def values(spark: SparkSession, d: str, wanted: set[tuple[str, str]] | None = None) -> DataFrame:
    """table_name, column_name, value, freq of the catalog's columns (or of the wanted ones, and no other is read), over whole tables."""
    out = None
    for v, (t, cols) in VIEWS.items():
        some = [(c, n) for c, (n, _) in cols.items() if wanted is None or (v, n) in wanted]
        if some:
            f = profile.frequencies(spark.read.parquet(f"{d}/{t}.parquet").select(*[F.col(c).alias(n) for c, n in some]), v)
            out = f if out is None else out.unionByName(f)
    return out


def columns(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every column, with its type."""
    types = spark.createDataFrame([(v, n, k) for v, _, _, n, k in ALL], "table_name string, column_name string, physical_type string")
    return profile.counts(values(spark, d)).join(F.broadcast(types), ["table_name", "column_name"])


def pairs(spark: SparkSession, d: str) -> DataFrame:
    c = cut(columns(spark, d))
    return relations.candidate_pairs(c, relations.owners(c))


def held(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their containment: values are read of the columns alone that a pair names (metadata: a row per pair of columns comes to the driver)."""
    p = cut(pairs(spark, d))
    wanted = {x for r in p.select(*KEYS).collect() for x in ((r.fk_table, r.fk_column), (r.pk_table, r.pk_column))}
    if not wanted:
        none = spark.createDataFrame([], "table_name string, column_name string, value string, freq long")
        return relations.with_values(p, none)
    return relations.with_values(p, values(spark, d, wanted))


_snapshots: dict[tuple[str, str], DataFrame] = {}


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The scored pairs of a folder's tables, written once per application: a row per pair of columns, on which all relationship queries work. forget() drops it when tables have changed."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _snapshots:
        _snapshots[key] = cut(relations.confidence(relations.suppression(held(spark, d))))
    return _snapshots[key]


def forget() -> None:
    _snapshots.clear()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The accepted relationships, one per foreign column."""
    return relations.best_per_column(scored(spark, d).where("accepted")).select(*KEYS, "confidence", "containment")


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in cols])


def q_column_catalog(spark, d):
    return columns(spark, d).select("table_name", "column_name", "physical_type", "total_count", "non_null_count", "distinct_count")


def _meta(spark):
    return spark.createDataFrame([(v, n, k) for v, _, _, n, k in ALL], "table_name string, column_name string, physical_type string")


def q_column_roles(spark, d):
    return _meta(spark).select("table_name", "column_name", roles.role(F.col("table_name"), F.col("column_name"), F.col("physical_type")).alias("role"), F.coalesce(roles.family(F.col("column_name")), F.lit("UNKNOWN")).alias("hint"), roles.looks_temporal(F.col("column_name")).alias("looks_temporal"))


def q_logical_types(spark, d):
    c, t = F.col("column_name"), F.col("physical_type")
    m = _meta(spark).withColumn("semantic_type", names.semantic_type(c, F.lower(t))).withColumn("logical_type", roles.logical_type(c, t, F.col("semantic_type")))
    return m.select("table_name", "column_name", "logical_type", *roles.hints(t, F.col("semantic_type"), F.col("logical_type")))


def q_workload(spark, d):
    m = _meta(spark).groupBy("table_name").agg(F.count("*").alias("total"), *[F.count_if(F.col("column_name").rlike(p)).alias(k) for k, p in roles.WORKLOAD.items()])
    n = {k: F.col(k) for k in roles.WORKLOAD}
    return m.select("table_name", roles.workload(n, F.col("total")).alias("workload"), (n["id"] + n["fk"] >= 2).alias("is_relational"), (n["time"] >= 1).alias("contains_time_series"), (n["pii"] >= 1).alias("contains_pii"), ((n["text"] >= 3) | (n["text"] / F.col("total") > 0.3)).alias("nlp_heavy"))


def q_complexity(spark, d):
    c = columns(spark, d).groupBy("table_name").agg(F.count("*").alias("cols"), F.max("total_count").alias("n"))
    return c.select("table_name", roles.complexity(F.col("n") * F.col("cols") * 8 / 1e6, F.col("cols"), F.col("n"), False, "parquet").alias("complexity"))


def q_type_compat(spark, d):
    t = spark.createDataFrame([(x,) for x in [*dict.fromkeys(k for pair in relations.TYPE_MATRIX for k in pair), "INT", "text", "bool"]], "t string")
    p = t.select(F.col("t").alias("a")).join(t.select(F.col("t").alias("b")), F.lit(True))  # types by types
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", relations.type_score(a, b).alias("score"), F.coalesce(relations.cast_of(a, b), F.lit("")).alias("cast_needed"), relations.same_family(a, b).alias("same_family"))


def q_candidate_pairs(spark, d):
    return _r(pairs(spark, d), *KEYS, "naming", "type_score", "cardinality_ratio")


def q_pair_containment(spark, d):
    return _r(relations.integrity(held(spark, d)), *KEYS, "matched_rows", "matched_distinct", "containment", "overlap", "strong", "acceptable", "integrity")


def q_fk_suppression(spark, d):
    return _r(relations.suppression(pairs(spark, d)), *KEYS, "suppressed", "penalty")


def q_fk_confidence(spark, d):
    return _r(scored(spark, d), *KEYS, "domain", "confidence", "accepted")


def q_fk_production(spark, d):
    return _r(relations.production(scored(spark, d)), *KEYS, "production_score", "relationship_class")


def q_adjudicate(spark, d):
    s = scored(spark, d).withColumn("semantic", names.token_similarity(F.col("fk_column"), F.col("pk_column")))
    return s.select(*KEYS, relations.adjudicate(F.col("containment"), F.col("semantic"), F.col("type_score"), F.col("confidence"), F.col("domain") > 0, F.col("suppressed")).alias("verdict"))


def q_best_fk(spark, d):
    return _r(relations.best_per_column(scored(spark, d)), *KEYS, "confidence")


def q_fk_edges(spark, d):
    return _r(edges(spark, d), *KEYS, "confidence", "containment")


def q_leakage(spark, d):
    e, leak = scored(spark, d), F.col("fk_column").rlike(roles.AUDIT) | F.col("fk_column").rlike(roles.TEMPORAL)
    stages = [("candidate", F.lit(True)), ("contained", F.col("containment") >= 0.85), ("accepted", F.col("accepted"))]
    rows = e.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in stages]), lambda x: x.isNotNull())).alias("stage"), leak.alias("leak"))
    return rows.groupBy("stage").agg(F.count("*").alias("pairs"), F.count_if("leak").alias("leaked"), F.round(100.0 * F.count_if("leak") / F.count("*"), 6).alias("percent"))


def q_funnel(spark, d):
    s = scored(spark, d)
    return s.agg(F.count("*").alias("candidates"), F.count_if(~F.col("accepted")).alias("not_accepted"), F.count_if(F.col("confidence") < 0.7).alias("low_confidence"), F.count_if(F.col("containment") < 0.9).alias("low_containment"))


def q_score_summary(spark, d):
    s = scored(spark, d)
    return _r(s.agg(*[f(c).alias(f"{n}_{c}") for c in ("confidence", "containment", "naming") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))], F.count_distinct("fk_table").alias("tables")), *[f"{n}_{c}" for c in ("confidence", "containment", "naming") for n in ("min", "max", "avg")], "tables")


def q_relation_classes(spark, d):
    return relations.production(scored(spark, d)).groupBy("relationship_class").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("fk_table")), ",").alias("tables"))


def q_graph_metrics(spark, d):
    t = spark.createDataFrame([(v,) for v in VIEWS], "node string")
    m = graph.metrics(edges(spark, d), t)
    return _r(m, *m.columns)


def q_fk_tree(spark, d):
    return graph.tree(edges(spark, d))


def q_expand_level(spark, d):
    return graph.expand(edges(spark, d), "application_nations", ["sales_customers"])


def q_parents_children(spark, d):
    return graph.parents_children(edges(spark, d))


def q_bridge_tables(spark, d):
    return graph.bridges(edges(spark, d))


def q_search_rank(spark, d):
    return graph.search(edges(spark, d), "sales")


def q_strongest_edges(spark, d):
    return graph.strongest(edges(spark, d), 4)


def q_edge_page(spark, d):
    return graph.page(edges(spark, d).select(*KEYS), 2, 3, *KEYS)


def q_module_degrees(spark, d):
    g = graph.degrees(edges(spark, d)).withColumn("module", names.module(F.col("node")))
    return g.groupBy("module").agg(F.count("*").alias("tables"), F.sum(F.col("in_degree") + F.col("out_degree")).alias("degree"))


def q_edge_ids(spark, d):
    return edges(spark, d).select(F.concat_ws("__", "fk_table", "fk_column", "pk_table", "pk_column").alias("edge_id"), (F.col("containment") < 1).alias("has_orphans"))


def q_set_union_dedupe(spark, d):
    t = lambda x, c: spark.read.parquet(f"{d}/{x}.parquet").select(F.col(c).alias("k"))
    return t("customer", "c_nationkey").union(t("supplier", "s_nationkey")).union(t("nation", "n_nationkey")).distinct()


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_META = "(VALUES " + ", ".join(f"('{v}', '{n}', '{k}')" for v, _, _, n, k in ALL) + ") AS m(table_name, column_name, physical_type)"
_COLS = "cols AS (" + " UNION ALL ".join(f"SELECT '{v}' AS t, '{n}' AS c, '{k}' AS k, count(*) AS n, count({c}) AS nn, count(DISTINCT {c}) AS d FROM {t}" for v, t, c, n, k in ALL) + ")"
_ENTITY = "regexp_replace({}, '(_id|id|_key|key|_fk|fk)$', '')"
_ROOT = "regexp_replace(string_split({}, '_')[-1], 's$', '')"
_OWN = f"{_ENTITY.format('c')} = {_ROOT.format('t')} AND regexp_matches(c, '{roles.IDENTIFIER}')"
_ALIAS = lambda x: f"CASE upper({x}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in relations.TYPE_ALIASES.items()) + f" ELSE upper({x}) END"
_SCORE = lambda a, b: f"(CASE WHEN {_ALIAS(a)} = {_ALIAS(b)} THEN 1 " + " ".join(f"WHEN {_ALIAS(a)} = '{p}' AND {_ALIAS(b)} = '{q}' THEN {s}" for (p, q), (s, _) in relations.TYPE_MATRIX.items()) + " ELSE 0 END)::DOUBLE"
_FAMILY = lambda a, b: f"(lower({a}) = lower({b}) OR (lower({a}) IN {_IN(relations.INTEGERS)} AND lower({b}) IN {_IN(relations.INTEGERS)}) OR (lower({a}) IN {_IN(relations.TEXTS)} AND lower({b}) IN {_IN(relations.TEXTS)}))"
_SIM = "CASE WHEN f.c = p.c THEN 1.0 WHEN contains(f.c, p.c) OR contains(p.c, f.c) THEN .8 ELSE least(.7, len(list_intersect(list_distinct(string_split(f.c, '')), list_distinct(string_split(p.c, ''))))::DOUBLE / greatest(length(f.c), length(p.c))) END"
_AUDIT = "(" + "|".join(names.AUDIT_ENDINGS) + ")$"
_PAIRS = (
    f"WITH {_COLS}, types AS (SELECT a.k AS a, b.k AS b, {_SCORE('a.k', 'b.k')} AS s FROM (SELECT DISTINCT k FROM cols) a, (SELECT DISTINCT k FROM cols) b), pairs AS (SELECT * FROM (SELECT f.t AS fk_table, f.c AS fk_column, p.t AS pk_table, p.c AS pk_column, f.k AS fk_type, p.k AS pk_type, f.n AS fk_rows, f.nn AS fk_known, f.d AS fk_distinct, p.nn AS pk_known, p.d AS pk_distinct, "
    f"({_SIM})::DOUBLE AS naming, s AS type_score, f.d::DOUBLE / nullif(p.d, 0) AS cardinality_ratio FROM cols f, (SELECT * FROM cols WHERE {_OWN}) p, types WHERE f.t <> p.t AND types.a = f.k AND types.b = p.k "
    f"AND NOT regexp_matches(f.c, '{_AUDIT}') AND NOT regexp_matches(f.c, '{relations.OUT_GUID}|^is_|^has_')) WHERE naming >= .5 AND type_score >= .5 AND cardinality_ratio <= 1.05)"
)
_VALS = "vals AS (" + " UNION ALL ".join(f"SELECT '{v}' AS t, '{n}' AS c, {c}::VARCHAR AS v, count(*) AS f FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for v, t, c, n, k in ALL if k in ("INTEGER", "BIGINT", "DOUBLE", "STRING")) + ")"
# Values of different number types are compared as text, as the operator does.
_HELD = f"""{_PAIRS}, {_VALS}, held AS (SELECT pairs.*, coalesce(m, 0)::BIGINT AS matched_rows, coalesce(md, 0)::BIGINT AS matched_distinct, coalesce(coalesce(m, 0)::DOUBLE / nullif(fk_known, 0), 0) AS containment, coalesce(least(1, coalesce(md, 0)::DOUBLE / nullif(pk_distinct, 0)), 0) AS overlap
 FROM pairs LEFT JOIN (SELECT fk_table, fk_column, pk_table, pk_column, sum(a.f) AS m, count(*) AS md FROM (SELECT fk_table, fk_column, pk_table, pk_column FROM pairs) JOIN vals a ON a.t = fk_table AND a.c = fk_column JOIN vals b ON b.t = pk_table AND b.c = pk_column AND a.v = b.v GROUP BY ALL) h USING (fk_table, fk_column, pk_table, pk_column))"""
_SUP = (
    f"(regexp_matches(fk_column, '{relations.OUT_GUID}') OR regexp_matches(fk_column, '^({relations.OUT_TEMPORAL})') OR fk_distinct IN (1, 2) OR regexp_matches(fk_column, '^({relations.OUT_MUTABLE})') OR regexp_matches(fk_column, '{relations.OUT_MEASURE}') OR regexp_matches(fk_column, '^({relations.OUT_GEO})'))"
)
_PEN = f"least(.5, CASE WHEN fk_distinct = 2 THEN .2 ELSE 0 END + CASE WHEN NOT (fk_column = pk_column AND regexp_matches(fk_column, '{roles.IDENTIFIER}')) AND NOT cardinality_ratio BETWEEN .8 AND 1.05 AND fk_distinct > 0 AND fk_distinct < 10 THEN .12 ELSE 0 END + CASE WHEN fk_type = 'STRING' AND regexp_matches(fk_column, '{relations.DESCRIPTIVE}') THEN .3 ELSE 0 END)::DOUBLE"
_SCORED = f"""{_HELD}, dom AS (SELECT *, {_SUP} AS suppressed, CASE WHEN {_ENTITY.format('fk_column')} = {_ROOT.format('pk_table')} THEN 1.0 ELSE 0 END::DOUBLE AS domain, 1 - fk_known::DOUBLE / fk_rows AS nulls FROM held),
raw AS (SELECT *, .35 * containment + .25 * overlap + .1 * type_score + .15 * naming + .2 * domain AS s0 FROM dom),
sc AS (SELECT *, CASE WHEN domain <= 0 THEN 0 ELSE greatest(0, least(1, CASE WHEN containment < .7 THEN least(s0, .6) ELSE s0 END - CASE WHEN nulls > .5 THEN (nulls - .5) * .2 ELSE 0 END - CASE WHEN cardinality_ratio > 1 THEN least(.3, (cardinality_ratio - 1) * .5) ELSE 0 END)) END::DOUBLE AS confidence FROM raw),
scored AS (SELECT *, confidence >= .75 AND containment >= .85 AND NOT suppressed AS accepted FROM sc)"""
_BEST = "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY fk_table, fk_column ORDER BY confidence DESC, pk_table, pk_column) AS r FROM scored WHERE confidence >= .75{}) WHERE r = 1"
_EDGES = f"{_SCORED}, e AS ({_BEST.format(' AND accepted')})"
_PROD = f"""{_SCORED}, pr AS (SELECT *, {_ENTITY.format('fk_column')} = {_ROOT.format('pk_table')} AS ent, round(.3 * containment + .25 + .2 * CASE WHEN fk_column = pk_column THEN 1 WHEN {_ENTITY.format('fk_column')} = {_ENTITY.format('pk_column')} THEN .85 ELSE 0 END + .1 * {_FAMILY('fk_type', 'pk_type')}::INT + .1 * (pk_distinct > 0 AND fk_distinct <= pk_distinct AND fk_distinct::DOUBLE / fk_known <= pk_distinct::DOUBLE / pk_known + 1e-9)::INT + .05 * CASE WHEN regexp_matches(fk_column, '{roles.IDENTIFIER}') THEN .6 ELSE 0 END, 4)::DOUBLE AS ps FROM scored),
prod AS (SELECT *, CASE WHEN ent THEN ps ELSE 0 END AS production_score, CASE WHEN NOT ent OR ps < .75 THEN 'INVALID_MATCH' WHEN {_ROOT.format('pk_table')} IN ('order', 'invoice', 'transaction') THEN 'TRANSACTION_REFERENCE' WHEN fk_distinct < 20 AND regexp_matches({_ENTITY.format('fk_column')}, 'type|method|category') THEN 'ENUM_REFERENCE' WHEN fk_distinct < 100 AND regexp_matches(pk_table, '^(application_|warehouse_)') THEN 'DIMENSION_REFERENCE' ELSE 'FOREIGN_KEY' END AS relationship_class FROM pr)"""
_K = "fk_table, fk_column, pk_table, pk_column"
_DEG = "u AS (SELECT DISTINCT fk_table, pk_table FROM e), deg AS (SELECT node, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i FROM (SELECT fk_table AS node, 1 AS o, 0 AS i FROM u UNION ALL SELECT pk_table, 0, 1 FROM u) GROUP BY node)"
_SEM = "CASE WHEN regexp_matches(column_name, '(" + "|".join(names.AUDIT_ENDINGS) + "|id|key|code|identifier)$') THEN 'identifier' " + " ".join(f"WHEN regexp_matches(column_name, '{'|'.join(p)}') THEN '{k}'" for k, p in names.SEMANTIC_PARTS.items()) + " ELSE 'unknown' END"
_FAM = f"CASE WHEN regexp_matches(column_name, '{roles.AUDIT}') THEN 'AUDIT_HINT' WHEN regexp_matches(column_name, '{roles.TEMPORAL}') THEN 'TEMPORAL_HINT' WHEN regexp_matches(column_name, '{roles.GEO}') THEN 'GEOSPATIAL' WHEN regexp_matches(column_name, '{roles.MEASURE}') THEN 'MEASURE' END"
_STEPS = lambda x, *pairs: "CASE " + " ".join(f"WHEN {x} < {a} THEN {b}" for a, b in pairs[:-1]) + f" ELSE {pairs[-1][1]} END"
_DAY = "strftime({}, '%Y-%m-%d %H:%M:%S')"

ORACLES = {
    "column_catalog": f"WITH {_COLS} SELECT t AS table_name, c AS column_name, k AS physical_type, n AS total_count, nn AS non_null_count, d AS distinct_count FROM cols",
    "column_roles": f"SELECT table_name, column_name, CASE WHEN h = 'AUDIT_HINT' THEN 'AUDIT_REFERENCE' WHEN h = 'TEMPORAL_HINT' THEN 'SCD_COLUMN' WHEN h = 'GEOSPATIAL' THEN 'GEO' WHEN h = 'MEASURE' THEN 'MEASURE' WHEN i AND regexp_matches(table_name, 'line|bridge|mapping') THEN 'BRIDGE_KEY' WHEN i AND {_ENTITY.format('column_name')} = {_ROOT.format('table_name')} THEN 'PRIMARY_OWNER' WHEN i AND {_ENTITY.format('column_name')} IN {_IN(roles.ENUM_ROOTS)} THEN 'ENUM_REFERENCE' WHEN i THEN 'FOREIGN_REFERENCE' WHEN physical_type = 'TIMESTAMP' THEN 'TEMPORAL_COLUMN' ELSE 'DESCRIPTIVE' END AS role, coalesce(h, 'UNKNOWN') AS hint, regexp_matches(column_name, '{'|'.join(roles.TEMPORAL_PARTS)}') AS looks_temporal FROM (SELECT *, {_FAM} AS h, regexp_matches(column_name, '{roles.IDENTIFIER}') AS i FROM {_META})",
    "logical_types": f"SELECT table_name, column_name, l AS logical_type, l IN ('identifier', 'audit_reference') AS is_identifier, l = 'timestamp' AS is_temporal, l IN ('audit', 'audit_reference') AS is_audit, l = 'measure' AS is_measure, l IN ('category', 'description') OR s = 'name' AS is_dimension, physical_type = 'STRING' AND l = 'description' AS is_text FROM (SELECT *, CASE WHEN regexp_matches(column_name, '{_AUDIT}') THEN 'audit_reference' WHEN s = 'identifier' THEN 'identifier' WHEN s = 'temporal' THEN 'timestamp' WHEN regexp_matches(column_name, '{'|'.join(roles.AUDIT_PARTS)}') THEN 'audit' WHEN s = 'measure' THEN 'measure' WHEN s = 'geospatial_coordinate' THEN 'geospatial' WHEN s IN ('description', 'name') THEN 'description' WHEN physical_type = 'BOOLEAN' THEN 'category' ELSE 'unknown' END AS l FROM (SELECT *, {_SEM} AS s FROM {_META}))",
    "workload": "SELECT table_name, CASE WHEN feature >= 5 OR feature / total > .5 THEN 'ml_features' WHEN txt >= 3 OR txt / total > .3 THEN 'nlp_corpus' WHEN tim >= 2 AND measure >= 2 THEN 'time_series' WHEN tim >= 1 AND id >= 1 AND measure = 0 THEN 'event_stream' WHEN measure >= 3 AND id + fk >= 2 THEN 'analytical_olap' WHEN id + fk >= 3 THEN 'transactional' ELSE 'mixed' END AS workload, id + fk >= 2 AS is_relational, tim >= 1 AS contains_time_series, pii >= 1 AS contains_pii, txt >= 3 OR txt / total > .3 AS nlp_heavy FROM (SELECT table_name, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (regexp_matches(column_name, '{p}')) AS {dict(time='tim', text='txt').get(k, k)}" for k, p in roles.WORKLOAD.items())
    + f" FROM {_META} GROUP BY 1)",
    "complexity": f"WITH {_COLS} SELECT table_name, ({_STEPS('n * cols * 8 / 1e6', (1, 0), (10, 0.5), (100, 1), (1024, 1.5), (10240, 2), (0, 3))} + {_STEPS('cols', (10, 0), (50, 0.5), (200, 1), (1000, 1.5), (0, 2))} + {_STEPS('n', (1000, 0), (100000, 0.5), (1000000, 1), (10000000, 1.5), (0, 2))})::DOUBLE AS complexity FROM (SELECT t AS table_name, count(*) AS cols, max(n) AS n FROM cols GROUP BY 1)",
    "type_compat": "WITH t(t) AS (VALUES " + ", ".join(f"('{x}')" for x in [*dict.fromkeys(k for pair in relations.TYPE_MATRIX for k in pair), "INT", "text", "bool"]) + f") SELECT x.t AS a, y.t AS b, {_SCORE('x.t', 'y.t')} AS score, CASE " + " ".join(f"WHEN {_ALIAS('x.t')} = '{p}' AND {_ALIAS('y.t')} = '{q}' THEN '{relations.CASTS.get((p, q), 'automatic')}'" for (p, q), (_, c) in relations.TYPE_MATRIX.items() if c) + f" ELSE '' END AS cast_needed, {_FAMILY('x.t', 'y.t')} AS same_family FROM t x, t y",
    "candidate_pairs": f"{_PAIRS} SELECT {_K}, round(naming, 6) AS naming, type_score, round(cardinality_ratio, 6) AS cardinality_ratio FROM pairs",
    "pair_containment": f"{_HELD} SELECT {_K}, matched_rows, matched_distinct, round(containment, 6) AS containment, round(overlap, 6) AS overlap, containment >= .95 AS strong, containment >= .85 AS acceptable, round(containment * (1 - .5 * (1 - containment)), 6) AS integrity FROM held",
    "fk_suppression": f"{_PAIRS} SELECT {_K}, {_SUP} AS suppressed, {_PEN} AS penalty FROM pairs",
    "fk_confidence": f"{_SCORED} SELECT {_K}, domain, round(confidence, 6) AS confidence, accepted FROM scored",
    "fk_production": f"{_PROD} SELECT {_K}, production_score::DOUBLE AS production_score, relationship_class FROM prod",
    "adjudicate": f"{_SCORED}, s AS (SELECT *, CASE WHEN contains(fk_column, pk_column) OR contains(pk_column, fk_column) THEN CASE WHEN fk_column = pk_column THEN 1 ELSE .8 END ELSE 0 END AS sem FROM scored) SELECT {_K}, CASE WHEN containment >= .95 AND sem >= .6 THEN 'TRUE_FK' WHEN containment >= .85 AND sem >= .6 AND type_score >= .5 THEN 'TRUE_FK' WHEN containment < .5 AND sem >= .75 THEN 'SEMANTICALLY_RELATED' WHEN domain > 0 AND containment < .7 THEN 'SHARED_ENTITY_DOMAIN' WHEN suppressed THEN 'FALSE_POSITIVE' WHEN containment < .5 AND sem < .4 AND confidence < .6 THEN 'FALSE_POSITIVE' WHEN containment >= .5 AND containment < .85 THEN 'POSSIBLE_REFERENCE' ELSE 'FALSE_POSITIVE' END AS verdict FROM s",
    "best_fk": f"{_SCORED} SELECT {_K}, round(confidence, 6) AS confidence FROM ({_BEST.format('')})",
    "fk_edges": f"{_EDGES} SELECT {_K}, round(confidence, 6) AS confidence, round(containment, 6) AS containment FROM e",
    "leakage": f"{_SCORED}, l AS (SELECT *, regexp_matches(fk_column, '{roles.AUDIT}') OR regexp_matches(fk_column, '{roles.TEMPORAL}') AS leak FROM scored), st AS (SELECT 'candidate' AS stage, leak FROM l UNION ALL SELECT 'contained', leak FROM l WHERE containment >= .85 UNION ALL SELECT 'accepted', leak FROM l WHERE accepted) SELECT stage, count(*) AS pairs, count(*) FILTER (leak) AS leaked, round(100.0 * count(*) FILTER (leak) / count(*), 6)::DOUBLE AS percent FROM st GROUP BY stage",
    "funnel": f"{_SCORED} SELECT count(*) AS candidates, count(*) FILTER (NOT accepted) AS not_accepted, count(*) FILTER (confidence < .7) AS low_confidence, count(*) FILTER (containment < .9) AS low_containment FROM scored",
    "score_summary": f"{_SCORED} SELECT " + ", ".join(f"round({n}({c}), 6) AS {n}_{c}" for c in ("confidence", "containment", "naming") for n in ("min", "max", "avg")) + ", count(DISTINCT fk_table) AS tables FROM scored",
    "relation_classes": f"{_PROD} SELECT relationship_class, count(*) AS n, array_to_string(list_sort(list(DISTINCT fk_table)), ',') AS tables FROM prod GROUP BY 1",
    "graph_metrics": f"{_EDGES}, nodes(node) AS (VALUES {', '.join(f'({v!r})' for v in VIEWS)}), bi AS (SELECT fk_table AS s, pk_table AS t FROM e UNION SELECT pk_table, fk_table FROM e UNION SELECT node, node FROM nodes), comp AS (WITH RECURSIVE r AS (SELECT s, t FROM bi UNION SELECT r.s, bi.t FROM r JOIN bi ON r.t = bi.s) SELECT s, min(t) AS c FROM r GROUP BY s), size AS (SELECT c, count(*) AS n FROM comp GROUP BY c) SELECT (SELECT count(*) FROM nodes) AS table_count, count(*) AS relationship_count, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence, round(avg(confidence), 6) AS avg_confidence, round(median(confidence), 6) AS median_confidence, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT fk_table FROM e UNION SELECT pk_table FROM e)) AS orphan_table_count, (SELECT count(*) FROM size) AS connected_components, (SELECT max(n) FROM size) AS largest_component_size, round(count(*) / (SELECT count(*) * (count(*) - 1) FROM nodes), 6) AS density FROM e",
    "fk_tree": f"{_EDGES}, l AS (SELECT DISTINCT pk_table AS p, fk_table AS c FROM e WHERE pk_table <> fk_table), tr AS (WITH RECURSIVE r AS (SELECT DISTINCT p AS root, p AS node, 0 AS depth, [p] AS path, false AS truncated FROM l WHERE p NOT IN (SELECT c FROM l) UNION ALL SELECT root, c, depth + 1, list_append(path, c), list_contains(path, c) FROM r JOIN l ON node = p WHERE NOT truncated AND depth < 8) SELECT * FROM r) SELECT root, node, depth, array_to_string(path, '>') AS path, truncated FROM tr",
    "expand_level": f"{_EDGES} SELECT DISTINCT fk_table AS child, fk_column, pk_column, fk_table = 'sales_customers' AS visited FROM e WHERE pk_table = 'application_nations'",
    "parents_children": f"{_EDGES}, b AS (SELECT fk_table AS node, pk_table AS p, NULL AS c FROM e UNION SELECT pk_table, NULL, fk_table FROM e) SELECT node, coalesce(array_to_string(list_sort(list(DISTINCT p) FILTER (p IS NOT NULL)), ','), '') AS parents, coalesce(array_to_string(list_sort(list(DISTINCT c) FILTER (c IS NOT NULL)), ','), '') AS children FROM b GROUP BY node",
    "bridge_tables": f"{_EDGES} SELECT fk_table AS node, count(*) AS n_fk, array_to_string(list_sort(list(DISTINCT pk_table)), ',') AS targets FROM e GROUP BY 1 HAVING count(*) >= 2 AND regexp_matches(fk_table, 'line|bridge|mapping')",
    "search_rank": f"{_EDGES}, {_DEG} SELECT node, o + i AS degree, (row_number() OVER (ORDER BY CASE WHEN node = 'sales' THEN 0 WHEN starts_with(node, 'sales') THEN 1 ELSE 2 END, o + i DESC, node))::INT AS rank FROM deg WHERE contains(node, 'sales')",
    "strongest_edges": f"{_EDGES}, {_DEG} SELECT {_K}, a.o + a.i + b.o + b.i AS weight FROM e JOIN deg a ON a.node = fk_table JOIN deg b ON b.node = pk_table ORDER BY weight DESC, fk_table, fk_column, pk_table LIMIT 4",
    "edge_page": f"{_EDGES} SELECT {_K} FROM e ORDER BY {_K} LIMIT 3 OFFSET 2",
    "module_degrees": f"{_EDGES}, {_DEG} SELECT regexp_extract(node, '^([^_.]*)', 1) AS module, count(*) AS tables, sum(o + i)::BIGINT AS degree FROM deg GROUP BY 1",
    "edge_ids": f"{_EDGES} SELECT fk_table || '__' || fk_column || '__' || pk_table || '__' || pk_column AS edge_id, containment < 1 AS has_orphans FROM e",
    "set_union_dedupe": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation",
}
