"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.functions import types as rules
from tessella.operators import graph, keys, profile, sampling, types

#: Columns of the profiled tables: name -> kind, as the SQL equivalents need them.
SCHEMAS = {
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderpriority": "text"},
    "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"},
    "part": {"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"},
    "nation": {"n_nationkey": "number", "n_name": "text", "n_regionkey": "number"},
}
#: Owner-style names of the same tables, on which the key rules act.
VIEWS = {
    "application_nations": ("nation", {"n_nationkey": "nationid", "n_name": "nationname", "n_regionkey": "regionid"}),
    "sales_customers": ("customer", {"c_custkey": "customerid", "c_name": "customername", "c_nationkey": "nationid", "c_mktsegment": "marketsegment"}),
    "sales_orders": ("orders", {"o_orderkey": "orderid", "o_custkey": "customerid", "o_orderstatus": "orderstatus", "o_orderpriority": "orderpriority"}),
    "warehouse_parts": ("part", {"p_partkey": "partid", "p_name": "partname", "p_brand": "brand", "p_size": "size"}),
}
EDGES = [("sales_orders", "customerid", "sales_customers", "customerid", 0.98), ("sales_orderlines", "orderid", "sales_orders", "orderid", 0.98), ("sales_orderlines", "orderid", "sales_orders", "orderid", 0.80), ("sales_orderlines", "partid", "warehouse_parts", "partid", 0.97), ("sales_customers", "nationid", "application_nations", "nationid", 0.95), ("application_nations", "regionid", "application_regions", "regionid", 0.94), ("a_left", "x", "a_right", "x", 0.7), ("a_right", "y", "a_left", "y", 0.6)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, cols in SCHEMAS.items():
        f = profile.frequencies(table(spark, sf_dir, t).select(*cols), t)
        out = f if out is None else out.unionByName(f)
    return out


def _view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for v, (t, cols) in VIEWS.items():
        f = profile.frequencies(table(spark, sf_dir, t).select(*[F.col(a).alias(b) for a, b in cols.items()]), v)
        out = f if out is None else out.unionByName(f)
    return profile.counts(out).join(profile.entropy(out), ["table_name", "column_name"], "left").withColumn("entropy_norm", F.coalesce("entropy_norm", F.lit(0.0)))


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "fk_table string, fk_column string, pk_table string, pk_column string, confidence double")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _union(kinds: set[str] | None, make) -> str:
    return " UNION ALL ".join(make(t, c) for t, cols in SCHEMAS.items() for c, k in cols.items() if kinds is None or k in kinds)


_EDGES_SQL = "(VALUES " + ", ".join(str(e) for e in EDGES) + ") AS e(fk_table, fk_column, pk_table, pk_column, confidence)"
_COUNTS = _union(None, lambda t, c: f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_count, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, greatest(count({c}) - count(DISTINCT {c}), 0) AS duplicate_count FROM {t}")
_VIEW_SQL = " UNION ALL ".join(f"SELECT '{v}' AS table_name, '{b}' AS column_name, count(*)::DOUBLE AS n, count({a})::DOUBLE AS nn, count(DISTINCT {a})::DOUBLE AS d, (SELECT -sum(f / s * log2(f / s)) FROM (SELECT count(*)::DOUBLE AS f, sum(count(*)) OVER ()::DOUBLE AS s FROM {t} WHERE {a} IS NOT NULL GROUP BY {a})) AS e FROM {t}" for v, (t, cols) in VIEWS.items() for a, b in cols.items())
_OWNERS = "('application_nations','nationid'),('sales_customers','customerid'),('sales_orders','orderid'),('warehouse_parts','partid')"
_SCORED = f"""
WITH s AS ({_VIEW_SQL}), r AS (
  SELECT *, (table_name, column_name) IN ({_OWNERS}) AS own, d / nn AS u, nn / n AS cov, CASE WHEN nn > 1 THEN least(1, e / log2(nn)) ELSE 0 END AS en FROM s
), p AS (
  SELECT *, .4 * own::INT + .2 * u + .15 * cov + .1 * en + .1 * own::INT + .045 AS base,
    ((CASE WHEN n < 20 THEN .05 WHEN n < 200 THEN .03 ELSE 0 END)
      + (CASE WHEN d < 5 THEN .08 WHEN d < 20 THEN .05 WHEN d < 100 THEN .03 ELSE 0 END) * (CASE WHEN own AND u >= .99 AND cov >= .99 THEN .25 ELSE 1 END)
      + (CASE WHEN d = 1 AND nn > 0 THEN 1 ELSE 0 END)) * (CASE WHEN own THEN .25 ELSE 1 END) AS pen FROM r
), q AS (
  SELECT table_name, column_name, own AS is_owner, CASE WHEN own AND cov >= .6 THEN greatest(greatest(0, least(1, base - pen)), .75) ELSE greatest(0, least(1, base - pen)) END AS pk_score FROM p
)"""


def q_stats_counts(spark, d):
    return profile.counts(_freq(spark, d)).select("table_name", "column_name", "total_count", "non_null_count", "null_count", "distinct_count", "duplicate_count")


def q_stats_ratios(spark, d):
    return _rounded(profile.counts(_freq(spark, d)).select("table_name", "column_name", "uniqueness", "coverage", "duplicate_ratio", "null_ratio", "cardinality_ratio"))


def q_stats_entropy(spark, d):
    return _rounded(profile.entropy(_freq(spark, d)))


def q_stats_top_values(spark, d):
    return profile.top_values(_freq(spark, d).where("kind = 'text'"))


def q_stats_numeric(spark, d):
    return _rounded(profile.numeric(_freq(spark, d)).select("table_name", "column_name", "min_value", "max_value", "mean_value", "stddev"), 4)


def q_stats_quantiles(spark, d):
    return _rounded(profile.numeric(_freq(spark, d)).select("table_name", "column_name", "p25", "median", "p75", "p90", "p99"), 4)


def q_stats_moments(spark, d):
    return _rounded(profile.numeric(_freq(spark, d)).select("table_name", "column_name", "skewness", "kurtosis"), 5)


def q_stats_text(spark, d):
    return _rounded(profile.text_lengths(_freq(spark, d)))


def q_cardinality_class(spark, d):
    return profile.counts(_freq(spark, d)).select("table_name", "column_name", profile.cardinality_class(F.col("cardinality_ratio")).alias("cardinality_class"))


def q_normalize_names(spark, d):
    rows = spark.createDataFrame([("First Name",), ("Date/Time",), ("__x--y__",), ("Order.ID",), ("a(b)c",)], "name string")
    return rows.select("name", names.normalize(F.col("name")).alias("normalized"), names.is_identifier(F.col("name")).alias("is_identifier"))


def q_naming_similarity(spark, d):
    n = table(spark, d, "nation").select(F.lower("n_name").alias("a"))
    r = table(spark, d, "region").select(F.lower("r_name").alias("b"))
    return n.join(F.broadcast(r), F.length("a") >= F.length("b")).select("a", "b", F.round(names.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def q_pk_score(spark, d):
    return _rounded(keys.pk_score(_view_stats(spark, d)).select("table_name", "column_name", "is_owner", "pk_score"))


def q_pk_select(spark, d):
    return _rounded(keys.choose_pk(keys.pk_score(_view_stats(spark, d))))


def q_quality_flags(spark, d):
    return _view_stats(spark, d).select("table_name", "column_name", F.array_join(F.array_sort(keys.quality_flags()), ",").alias("flags"))


def q_quality_score(spark, d):
    s = _view_stats(spark, d).withColumn("flags", keys.quality_flags())
    return s.select("table_name", "column_name", keys.quality_score(F.col("flags")).alias("quality"))


def q_table_profile(spark, d):
    s = _view_stats(spark, d).withColumn("flags", keys.quality_flags())
    return s.groupBy("table_name").agg(F.count("*").alias("n_columns"), F.sum(F.size("flags")).alias("n_flags"), F.count_if(F.size("flags") > 0).alias("columns_with_issues"), F.round(F.avg("coverage"), 6).alias("completeness"))


def q_containment_full(spark, d):
    return _rounded(keys.containment(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey"))


def q_semi_matches(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def q_orphans(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey", "o_custkey")


def q_set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


def q_set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")))


def q_dedupe_edges(spark, d):
    return graph.dedupe(edges(spark))


def q_topk_edges(spark, d):
    return graph.dedupe(edges(spark)).where("confidence >= 0.5").orderBy(F.desc("confidence"), "fk_table", "fk_column", "pk_table").limit(4)


def q_graph_degree(spark, d):
    return graph.degrees(graph.dedupe(edges(spark)))


def q_graph_adjacency(spark, d):
    return graph.adjacency(edges(spark))


def q_graph_components(spark, d):
    return graph.components(edges(spark))


def q_graph_cycles(spark, d):
    return graph.on_cycles(edges(spark))


def q_histogram(spark, d):
    top = table(spark, d, "lineitem").select(F.least(F.floor(F.col("l_discount") / 0.01), F.lit(9)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(top, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def q_size_tier(spark, d):
    mb = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 1.0).alias("mb"))
    return mb.groupBy(F.when(F.col("mb") < 10, "tiny").when(F.col("mb") < 100, "small").when(F.col("mb") < 1024, "medium").when(F.col("mb") < 10240, "large").when(F.col("mb") < 102400, "very_large").otherwise("massive").alias("tier")).agg(F.count("*").alias("n"))


def q_wkt_point(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("POINT ("), F.col("c_custkey").cast("string"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(")")).alias("w"))
    part = lambda i: F.regexp_extract("w", r"POINT \(([-0-9.]+) ([-0-9.]+)\)", i).cast("double")
    return t.agg(F.min(part(1)).alias("min_lon"), F.max(part(1)).alias("max_lon"), F.min(part(2)).alias("min_lat"), F.max(part(2)).alias("max_lat"))


#: Columns whose types are voted.
TYPED = {"orders": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "events": ["event_id", "ts", "event_type", "value"], "customer": ["c_custkey", "c_name", "c_nationkey"]}
TYPED_TEXT = {"orders": ["o_orderstatus", "o_orderpriority"], "customer": ["c_name"], "events": ["event_type", "ts"]}


def _types(spark, d, typed):
    out = None
    for t, cols in typed.items():
        f = profile.frequencies(table(spark, d, t).select(*cols), t)
        out = f if out is None else out.unionByName(f)
    return types.physical_types(out)


def q_physical_types(spark, d):
    return _types(spark, d, TYPED).select("table_name", "column_name", "physical_type")


def q_semantic_types(spark, d):
    return _types(spark, d, TYPED).select("table_name", "column_name", "semantic_type")


def q_whole_numbers(spark, d):
    return _types(spark, d, TYPED).select("table_name", "column_name", "whole_numbers", "boolean_like")


def q_consistent_format(spark, d):
    return _types(spark, d, TYPED_TEXT).select("table_name", "column_name", "consistent_format")


def q_null_like(spark, d):
    v = F.when(F.col("c_custkey") % 4 == 0, F.lit(" NaN ")).when(F.col("c_custkey") % 4 == 1, F.lit("")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(rules.is_null_like(v).alias("x"), "c_nationkey").groupBy("c_nationkey").agg(F.count_if("x").alias("n_null_like"))


def q_token_similarity(spark, d):
    p = table(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit("_id")).alias("a"), F.concat(F.lit("id_"), F.lower("n_name"), F.lit("_key")).alias("b"))
    return _rounded(p.select("a", "b", names.token_similarity(F.col("a"), F.col("b")).alias("similarity")))


def q_type_score(spark, d):
    t = spark.createDataFrame([("integer",), ("float",), ("string",), ("date",), (None,)], "t string")
    return t.select(F.col("t").alias("a")).join(F.broadcast(t.select(F.col("t").alias("b"))), F.coalesce("a", F.lit("")) <= F.coalesce("b", F.lit(""))).select("a", "b", rules.type_score(F.col("a"), F.col("b")).alias("score"))


def q_confidence_levels(spark, d):
    return table(spark, d, "lineitem").select(rules.confidence_level(1 - F.col("l_discount") * 5).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


def q_cosine_next(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(rules.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


def q_containment_text(spark, d):
    return _rounded(keys.text_containment(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey"))


def q_join_recommendations(spark, d):
    r = edges(spark).withColumn("classification", F.when(F.col("confidence") > 0.85, "TRUE_FK").otherwise("WEAK")).withColumn("containment", F.col("confidence"))
    return keys.join_recommendations(r)


def q_column_relations(spark, d):
    return keys.column_relations(edges(spark))


def q_table_modules(spark, d):
    e = edges(spark)
    return e.select(F.col("fk_table").alias("t")).union(e.select("pk_table")).distinct().select("t", names.module(F.col("t")).alias("module"))


def q_remote_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


def q_sample_size(spark, d):
    return sampling.exactly(table(spark, d, "orders"), 100).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_FREQ = "SELECT count(*)::DOUBLE AS f, sum(count(*)) OVER ()::DOUBLE AS s FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
_FLAGS = f"""WITH s AS ({_VIEW_SQL}), r AS (SELECT *, d / nn AS u, 1 - nn / n AS nul, 1 - d / nn AS dup, CASE WHEN nn > 1 THEN least(1, e / log2(nn)) ELSE 0 END AS en FROM s),
f AS (SELECT *, list_filter([CASE WHEN nul >= 1 THEN 'fully_null' END, CASE WHEN nul > .5 AND nul < 1 THEN 'high_null_ratio' END, CASE WHEN nul > .2 AND nul <= .5 THEN 'sparsity_detected' END, CASE WHEN d < .01 * n AND n > 100 THEN 'duplicate_explosion' END, CASE WHEN contains(column_name, 'id') AND u < .95 THEN 'weak_identifier' END, CASE WHEN d = 1 THEN 'constant_column' END, CASE WHEN d <> 1 AND en < .01 THEN 'zero_entropy' END, CASE WHEN d <> 1 AND en >= .01 AND en < .1 THEN 'entropy_collapse' END, CASE WHEN d < 3 AND n > 10 THEN 'low_cardinality' END, CASE WHEN nul > .5 THEN 'high_missingness' END, CASE WHEN dup > .5 THEN 'high_duplication' END], lambda x: x IS NOT NULL) AS fl FROM r)"""
_REACH = "WITH RECURSIVE e AS (SELECT DISTINCT fk_table AS s, pk_table AS t FROM {edges}{both}), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s) "

ORACLES = {
    "stats_counts": _COUNTS,
    "stats_ratios": f"SELECT table_name, column_name, round(distinct_count / non_null_count, 6) AS uniqueness, round(non_null_count / total_count, 6) AS coverage, round(1 - distinct_count / non_null_count, 6) AS duplicate_ratio, round(null_count / total_count, 6) AS null_ratio, round(distinct_count / total_count, 6) AS cardinality_ratio FROM ({_COUNTS})",
    "stats_entropy": _union(None, lambda t, c: f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(greatest(0, -sum(f / s * log2(f / s))), 6) AS entropy, round(least(1, greatest(0, -sum(f / s * log2(f / s))) / log2(max(s))), 6) AS entropy_norm FROM ({_FREQ.format(t=t, c=c)})"),
    "stats_top_values": _union({"text"}, lambda t, c: f"SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, (row_number() OVER (ORDER BY count(*) DESC, {c}))::INT AS rank, {c} AS value, count(*) AS freq FROM {t} WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM {t}) <= 10000 GROUP BY {c}) WHERE rank <= 10"),
    "stats_numeric": _union({"number"}, lambda t, c: f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(min({c})::DOUBLE, 4) AS min_value, round(max({c})::DOUBLE, 4) AS max_value, round(avg({c}), 4) AS mean_value, round(stddev_samp({c}), 4) AS stddev FROM {t}"),
    "stats_quantiles": _union({"number"}, lambda t, c: f"SELECT '{t}' AS table_name, '{c}' AS column_name, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p}), 4) AS {n}" for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"), (0.99, "p99"))) + f" FROM {t}"),
    "stats_moments": _union({"number"}, lambda t, c: f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis FROM {t}"),
    "stats_text": _union({"text"}, lambda t, c: f"SELECT '{t}' AS table_name, '{c}' AS column_name, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length FROM {t}"),
    "cardinality_class": f"SELECT table_name, column_name, CASE WHEN distinct_count / total_count >= .8 THEN 'high' WHEN distinct_count / total_count >= .2 THEN 'medium' ELSE 'low' END AS cardinality_class FROM ({_COUNTS})",
    "normalize_names": r"SELECT name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s\-./]+', '_', 'g'), '[^\w]', '', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g') AS normalized, regexp_matches(lower(name), '(^id$|id$|_id$|key$|_key$|code$|identifier$)') AS is_identifier FROM (VALUES ('First Name'), ('Date/Time'), ('__x--y__'), ('Order.ID'), ('a(b)c')) AS t(name)",
    "naming_similarity": "SELECT a, b, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE least(0.7, len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, ''))))::DOUBLE / greatest(length(a), length(b), 1)) END, 6) AS similarity FROM (SELECT lower(n_name) AS a FROM nation), (SELECT lower(r_name) AS b FROM region) WHERE length(a) >= length(b)",
    "pk_score": _SCORED + " SELECT table_name, column_name, is_owner, round(pk_score, 6) AS pk_score FROM q",
    "pk_select": _SCORED + " SELECT table_name, column_name, round(pk_score, 6) AS pk_score FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY pk_score DESC, column_name) AS r FROM q WHERE is_owner AND pk_score >= .7) WHERE r = 1",
    "quality_flags": _FLAGS + " SELECT table_name, column_name, array_to_string(list_sort(fl), ',') AS flags FROM f",
    "quality_score": _FLAGS + " SELECT table_name, column_name, round(.3 * nn / n + .2 * (1 - dup) + .2 + .2 * greatest(0, 1 - .2 * list_contains(fl, 'zero_entropy')::INT) + .1 * CASE WHEN len(fl) > 0 THEN .5 ELSE 1 END, 4)::DOUBLE AS quality FROM f",
    "table_profile": _FLAGS + " SELECT table_name, count(*) AS n_columns, sum(len(fl))::BIGINT AS n_flags, count(*) FILTER (len(fl) > 0) AS columns_with_issues, round(avg(nn / n), 6) AS completeness FROM f GROUP BY table_name",
    "containment_full": "SELECT fk_rows, matched_rows, fk_rows - matched_rows AS orphan_rows, round(matched_rows / fk_rows, 6) AS containment, round(md / fd, 6) AS distinct_containment, matched_rows / fk_rows >= .85 AS is_contained FROM (SELECT count(o_custkey) AS fk_rows, count(c_custkey) AS matched_rows, count(DISTINCT o_custkey) AS fd, count(DISTINCT c_custkey) AS md FROM orders LEFT JOIN customer ON o_custkey = c_custkey)",
    "semi_matches": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "orphans": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem",
    "dedupe_edges": f"SELECT fk_table, fk_column, pk_table, pk_column, max(confidence)::DOUBLE AS confidence FROM {_EDGES_SQL} GROUP BY ALL",
    "topk_edges": f"SELECT fk_table, fk_column, pk_table, pk_column, max(confidence)::DOUBLE AS confidence FROM {_EDGES_SQL} GROUP BY ALL HAVING max(confidence) >= .5 ORDER BY max(confidence) DESC, fk_table, fk_column, pk_table LIMIT 4",
    "graph_degree": f"WITH d AS (SELECT DISTINCT fk_table, fk_column, pk_table, pk_column FROM {_EDGES_SQL}), u AS (SELECT DISTINCT fk_table, pk_table FROM d), n AS (SELECT fk_table AS node, 1 AS o, 0 AS i FROM u UNION ALL SELECT pk_table, 0, 1 FROM u) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(i) = 0 AS is_root, sum(o) = 0 AS is_leaf FROM n GROUP BY node",
    "graph_adjacency": f"SELECT fk_table AS node, array_to_string(list_sort(list_distinct(list(pk_table))), ',') AS neighbours FROM {_EDGES_SQL} GROUP BY 1",
    "graph_components": _REACH.format(edges=_EDGES_SQL, both=f" UNION SELECT pk_table, fk_table FROM {_EDGES_SQL}") + "SELECT s AS node, least(min(s), min(t)) AS component FROM r GROUP BY s",
    "graph_cycles": _REACH.format(edges=_EDGES_SQL, both="") + "SELECT DISTINCT s AS node FROM r WHERE s = t",
    "histogram": "SELECT b::INT AS bin, count(l_discount) AS n FROM range(10) AS r(b) LEFT JOIN lineitem ON least(floor(l_discount / 0.01), 9) = b GROUP BY b",
    "size_tier": "SELECT CASE WHEN o_totalprice < 10 THEN 'tiny' WHEN o_totalprice < 100 THEN 'small' WHEN o_totalprice < 1024 THEN 'medium' WHEN o_totalprice < 10240 THEN 'large' WHEN o_totalprice < 102400 THEN 'very_large' ELSE 'massive' END AS tier, count(*) AS n FROM orders GROUP BY 1",
    "wkt_point": "SELECT min(c_custkey)::DOUBLE AS min_lon, max(c_custkey)::DOUBLE AS max_lon, min(c_nationkey)::DOUBLE AS min_lat, max(c_nationkey)::DOUBLE AS max_lat FROM customer",
}

_WORDS, _PAIRS = str(tuple(rules.BOOLEAN_WORDS)), str(tuple(rules.BOOLEAN_PAIR_WORDS))
_NUMBER = rules.NUMBER.removeprefix("(?i)")


def _typed(typed: dict, what: str) -> str:
    """One row per column from v, its values as text."""
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {what} FROM (SELECT {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL)" for t, cols in typed.items() for c in cols)


_VOTES = (
    f"CASE WHEN count(*) = 0 THEN 'unknown' WHEN avg((lower(trim(v)) IN {_WORDS})::INT) >= .8 THEN 'boolean' WHEN avg(regexp_matches(v, '{rules.INTEGER}')::INT) >= .8 THEN 'integer' "
    f"WHEN avg(regexp_matches(v, '{_NUMBER}', 'i')::INT) >= .8 THEN 'float' WHEN avg(regexp_matches(v, '{rules.DATETIME}')::INT) >= .8 THEN 'datetime' WHEN avg(regexp_matches(v, '{rules.DATE}')::INT) >= .8 THEN 'date' ELSE 'string' END AS physical_type"
)
_PARTS = " ".join(f"WHEN regexp_matches(column_name, '{'|'.join(parts)}') THEN '{kind}'" for kind, parts in names.SEMANTIC_PARTS.items())
ORACLES |= {
    "physical_types": _typed(TYPED, _VOTES),
    "semantic_types": f"SELECT table_name, column_name, CASE WHEN regexp_matches(column_name, '({'|'.join(names.AUDIT_ENDINGS)}|id|key|code|identifier)$') THEN 'identifier' {_PARTS} WHEN physical_type = 'boolean' THEN 'boolean_flag' ELSE 'unknown' END AS semantic_type FROM ({_typed(TYPED, _VOTES)})",
    "whole_numbers": _typed(TYPED, f"bool_and(coalesce(try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE)), false)) AS whole_numbers, count(DISTINCT v) = 2 AND bool_and(lower(trim(v)) IN {_PAIRS}) AS boolean_like"),
    "consistent_format": _typed(TYPED_TEXT, r"count(*) >= 3 AND count(DISTINCT regexp_replace(regexp_replace(trim(v), '\p{L}', 'A', 'g'), '\p{N}', '9', 'g')) = 1 AS consistent_format"),
    "null_like": "SELECT c_nationkey, count(*) FILTER (c_custkey % 4 < 2) AS n_null_like FROM customer GROUP BY 1",
    "token_similarity": r"""WITH p AS (SELECT lower(n_name) || '_id' AS a, 'id_' || lower(n_name) || '_key' AS b FROM nation), q AS (
  SELECT a, b, list_distinct(list_filter(regexp_split_to_array(a, '[_\W]+'), lambda t: t <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(b, '[_\W]+'), lambda t: t <> '')) AS y FROM p)
SELECT a, b, round(CASE WHEN contains(a, b) OR contains(b, a) THEN .8 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6)::DOUBLE AS similarity FROM q""",
    "type_score": "WITH t(t) AS (VALUES ('integer'), ('float'), ('string'), ('date'), (NULL)) SELECT x.t AS a, y.t AS b, (CASE WHEN x.t IS NULL OR y.t IS NULL THEN .5 WHEN x.t = y.t THEN 1 WHEN x.t IN ('integer', 'float') AND y.t IN ('integer', 'float') THEN .8 WHEN 'string' IN (x.t, y.t) THEN .5 ELSE .3 END)::DOUBLE AS score FROM t x, t y WHERE coalesce(x.t, '') <= coalesce(y.t, '')",
    "confidence_levels": "SELECT CASE WHEN c >= .95 THEN 'extremely_confident' WHEN c >= .85 THEN 'strong' WHEN c >= .75 THEN 'acceptable' WHEN c >= .6 THEN 'weak' ELSE 'rejected' END AS level, count(*) AS n FROM (SELECT 1 - l_discount::DOUBLE * 5 AS c FROM lineitem) GROUP BY 1",
    "cosine_next": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "containment_text": "SELECT count(*) AS fk_values, count(p.v) AS matched_values, round(count(p.v) / count(*), 6) AS ratio FROM (SELECT DISTINCT lower(trim(o_custkey::VARCHAR)) AS v FROM orders WHERE o_custkey IS NOT NULL) f LEFT JOIN (SELECT DISTINCT lower(trim(c_custkey::VARCHAR)) AS v FROM customer) p USING (v)",
    "join_recommendations": f"SELECT fk_table, fk_column, pk_table, pk_column, confidence::DOUBLE AS confidence, 'TRUE_FK' AS classification, confidence::DOUBLE AS containment, 'INNER' AS join_type FROM {_EDGES_SQL} WHERE confidence >= .9",
    "column_relations": f"WITH e AS (SELECT fk_table || '.' || fk_column AS a, pk_table || '.' || pk_column AS b FROM {_EDGES_SQL}), u AS (SELECT a AS n, b AS o, NULL AS i FROM e UNION ALL SELECT b, NULL, a FROM e) SELECT n AS name, coalesce(array_to_string(list_sort(list(DISTINCT o) FILTER (o IS NOT NULL)), ','), '') AS outgoing, coalesce(array_to_string(list_sort(list(DISTINCT i) FILTER (i IS NOT NULL)), ','), '') AS incoming FROM u GROUP BY n",
    "table_modules": f"SELECT t, CASE WHEN regexp_matches(t, '[_.]') THEN regexp_extract(t, '^([^_.]*)', 1) ELSE 'core' END AS module FROM (SELECT fk_table AS t FROM {_EDGES_SQL} UNION SELECT pk_table FROM {_EDGES_SQL})",
    "remote_count": "SELECT count(*) AS n FROM lineitem",
    "sample_size": "SELECT least(100, count(*)) AS n, least(100, count(*)) AS distinct_keys FROM orders",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column statistics, key scores and quality of all profiled tables."""
    s = _view_stats(spark, sf_dir)
    return keys.pk_score(s).withColumn("flags", keys.quality_flags()).select("table_name", "column_name", "total_count", "distinct_count", "uniqueness", "coverage", "entropy", "entropy_norm", "pk_score", "is_candidate", "flags")
