"""Sources, exports, graphs and rules on small fixtures."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import roles
from tessella.operators import graph, keys, profile, relations, sampling, vectors
from tessella.sources import exports, files, intake

EDGE = "fk_table string, fk_column string, pk_table string, pk_column string, confidence double, containment double"


def edges(spark, pairs):
    return spark.createDataFrame([(a, "x", b, "y", 0.9, 1.0) for a, b in pairs], EDGE)


def test_paths_and_cycles_of_any_length(spark):
    path = [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)]
    e = edges(spark, [*path, ("z1", "z2"), ("z2", "z1"), ("solo", "solo")])
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(f"n{i:03}", "n000") for i in range(201)} | {("z1", "z1"), ("z2", "z1"), ("solo", "solo")}
    assert {r.node for r in graph.on_cycles(e).collect()} == {"z1", "z2", "solo"}


def test_trees_stop_at_loops_and_depth(spark):
    e = edges(spark, [("b", "a"), ("c", "b"), ("b", "c"), ("d", "c"), ("a", "a")])
    got = {(r.path, r.truncated) for r in graph.tree(e, 4).collect()}
    assert got == {("a", False), ("a>b", False), ("a>b>c", False), ("a>b>c>b", True), ("a>b>c>d", False)}
    two = spark.createDataFrame([("a", "x", "b", "y", 0.5, 1.0), ("a", "z", "b", "y", 0.5, 1.0)], EDGE)
    assert {r.node: (r.out_degree, r.in_degree) for r in graph.degrees(two).collect()} == {"a": (1, 0), "b": (0, 1)}


def test_containment_counts_orphans_and_nulls(spark):
    fk = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "a long")
    pk = spark.createDataFrame([(1,), (2,), (None,), (2,)], "b long")
    r = keys.containment(fk, pk, "a", "b").collect()[0]
    assert (r.fk_rows, r.matched_rows, r.orphan_rows, r.is_contained) == (4, 3, 1, False)
    none = keys.containment(fk.where("a is null"), pk, "a", "b").collect()[0]
    assert (none.fk_rows, none.containment, none.is_contained) == (0, 0.0, False)


def test_pairs_with_null_values(spark):
    cols = "table_name string, column_name string, physical_type string, total_count long, non_null_count long, distinct_count long"
    c = spark.createDataFrame([("s_orders", "orderid", "BIGINT", 4, 4, 4), ("s_lines", "orderid", "BIGINT", 10, 4, 2), ("s_lines", "createdby", "BIGINT", 10, 10, 3)], cols)
    p = relations.candidate_pairs(c, relations.owners(c))
    assert [(r.fk_table, r.fk_column, r.pk_table) for r in p.collect()] == [("s_lines", "orderid", "s_orders")]
    v = spark.createDataFrame([("s_lines", "orderid", "1", 3), ("s_lines", "orderid", "7", 1), ("s_lines", "orderid", None, 6), ("s_orders", "orderid", "1", 1), ("s_orders", "orderid", None, 1)], "table_name string, column_name string, value string, freq long")
    r = relations.confidence(relations.suppression(relations.with_values(p, v))).collect()[0]
    assert (r.matched_rows, r.containment, r.overlap) == (3, 0.75, 0.25)
    base = 0.35 * 0.75 + 0.25 * 0.25 + 0.1 + 0.15 + 0.2 - (0.6 - 0.5) * 0.2
    assert abs(r.confidence - base) < 1e-9 and r.suppressed and not r.accepted


def test_top_values_of_a_column_of_many_rows(spark):
    freq = spark.createDataFrame([("t", "c", "text", v, n) for v, n in (("b", 9_000_000), ("a", 9_000_000), ("z", 1), (None, 5))], "table_name string, column_name string, kind string, value string, freq long")
    assert sorted((r.rank, r.value, r.freq) for r in profile.top_values(freq).collect()) == [(1, "a", 9_000_000), (2, "b", 9_000_000), (3, "z", 1)]


def test_adjudication(spark):
    f = lambda *x: relations.adjudicate(*[F.lit(v) for v in x])
    cases = {(0.96, 0.6, 0.0, 0.1, False, True): "TRUE_FK", (0.9, 0.7, 0.5, 0.9, False, False): "TRUE_FK", (0.2, 0.8, 1.0, 0.9, True, True): "SEMANTICALLY_RELATED", (0.6, 0.2, 1.0, 0.9, True, True): "SHARED_ENTITY_DOMAIN", (0.9, 0.2, 1.0, 0.9, False, True): "FALSE_POSITIVE", (0.6, 0.2, 1.0, 0.9, False, False): "POSSIBLE_REFERENCE", (0.99, 0.1, 1.0, 0.9, False, False): "FALSE_POSITIVE"}
    got = spark.range(1).select(*[f(*k).alias(str(i)) for i, k in enumerate(cases)]).collect()[0]
    assert list(got) == list(cases.values())


def test_intake(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    a = intake.validate(spark, put("a.csv", "id;name\n1;é\n2;x\n".encode()))
    assert (a["format"], a["encoding"], a["delimiter"], a["compression"], a["bom"]) == ("csv", "utf-8", ";", None, False)
    assert intake.validate(spark, put("b.csv", b"\xef\xbb\xbfa,b\n1,2\n"))["encoding"] == "utf-8-sig"
    assert intake.validate(spark, put("l.csv", "a|b\né|2\n".encode("latin-1")))["encoding"] == "latin-1"
    assert intake.validate(spark, put("g.csv.gz", gzip.compress(b"a,b\n1,2\n")))["compression"] == "gz"
    assert intake.validate(spark, put("x.bin", b"PAR1...."))["format"] == "parquet"
    with pytest.raises(intake.EmptyFile):
        intake.validate(spark, put("e.csv", b""))
    with pytest.raises(FileNotFoundError):
        intake.validate(spark, str(tmp_path / "none.csv"))
    assert [tuple(r) for r in intake.read_validated(spark, a["path"]).collect()] == [("1", "é"), ("2", "x")]
    for name, data in {"o.json": b'{"a": 1}', "r.json": b'[{"a": 1}]', "n.jsonl": b'{"a": 1}\n{"a": 2}\n'}.items():
        assert intake.read_json(spark, put(name, data)).select("a").first().a == 1
    assert intake.open_source(spark, str(tmp_path / "b.csv")).count() == 1
    found = [r.path.rsplit("/", 1)[1] for r in files.list_objects(spark, str(tmp_path)).collect()]
    assert found == ["a.csv", "b.csv", "g.csv.gz", "l.csv", "n.jsonl", "o.json", "r.json"]
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path / "x.bin"), strict=True)


def test_uris():
    p = intake.parse_uri
    assert p("s3://bucket/a/b.csv").spark_path == "s3a://bucket/a/b.csv" == p("minio://bucket/a/b.csv").spark_path
    assert p("abfss://box@host.example/p/q").spark_path == "abfss://box@host.example/p/q"
    db = p("postgres://me:secret@db.example:5433/shop?sslmode=require")
    assert (db.kind, db.host, db.port, db.container, db.user, db.options) == ("postgresql", "db.example", 5433, "shop", "me", {"sslmode": "require"}) and "secret" not in repr(db)
    assert p("host=h port=1 dbname=d user=u password=s") == intake.Source("postgresql", "h", 1, "d", "", "u", {})
    assert p("/tmp/x.csv").spark_path == "/tmp/x.csv"
    with pytest.raises(ValueError):
        p("ftp://x/y")


def test_samples_are_as_large_as_asked_for(spark):
    df = spark.range(1000).toDF("id")
    assert sampling.exactly(df, 10).count() == 10 and sampling.head(df, 5).count() == 5 and sampling.bernoulli(df, 1.0, 20).count() == 20
    assert intake.text_sample(df, 7).dtypes == [("id", "string")] and intake.schema_of(df) == [("id", "bigint")]


def test_exports(spark, tmp_path):
    c = [{"table_name": "a", "column_name": "id", "physical_type": "BIGINT"}, {"table_name": "b", "column_name": "a_id", "physical_type": "BIGINT"}]
    e = [{"fk_table": "b", "fk_column": "a_id", "pk_table": "a", "pk_column": "id", "confidence": 0.9, "containment": 0.5}]
    text = exports.dbml(c, e)
    back = exports.parse_dbml(text)
    assert back["tables"] == {"a": {"id": "bigint"}, "b": {"a_id": "bigint"}} and back["refs"] == [("b", "a_id", "a", "id")] and not back["unresolved"]
    assert exports.parse_dbml(text + "Ref: b.none > c.id\nTable a {\n id int\n}\n")["unresolved"] == [("b", "none", "c", "id")]
    assert "a ||--o{ b : a_id" in exports.mermaid(c, e) and json.loads(exports.graph_json(e))["edges"][0]["id"] == "b__a_id__a__id"
    assert '"b" -> "a"' in graph.dot(e) and relations.join_sql(e, "b") == "SELECT * FROM b\nLEFT JOIN a AS t0 ON b.a_id = t0.id"
    frame = spark.createDataFrame(c, "table_name string, column_name string, physical_type string")
    exports.write_documents(exports.canonical(frame), str(tmp_path / "docs"))
    doc = json.loads(spark.read.text(str(tmp_path / "docs" / "table_name=a")).first().value)
    assert doc["columns"] == [{"column_name": "id", "physical_type": "BIGINT"}]
    exports.save_relationships(edges(spark, [("a", "b")]), str(tmp_path / "rel"))
    assert exports.load_relationships(spark, str(tmp_path / "rel")).first().pk_table == "b"
    for n in (1, 2):
        exports.append_log(spark, str(tmp_path / "log"), step=n)
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2


def test_vectors(spark):
    t = spark.createDataFrame([(1, "the customer id"), (2, "customer id of the"), (3, "zebra"), (4, None), (5, "")], "id long, text string")
    v = vectors.embed(t)
    top = {(r.id, r.other): r.cosine for r in vectors.similar(v, v, 2, 0.5).collect()}
    assert set(top) == {(1, 2), (2, 1)} and abs(top[1, 2] - 3 / (3**0.5 * 2)) < 1e-6
    assert {r.id: r.cluster for r in vectors.clusters(v).collect()} == {1: "1", 2: "1", 3: None, 4: None, 5: None}
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id long, other long")
    assert {r.other: (r.keep, r.reason) for r in vectors.prune(pairs, vectors.similar(v, v)).collect()} == {2: (True, "similar"), 3: (True, "no_embedding")}


def test_complexity(spark):
    got = spark.range(1).select(roles.complexity(F.lit(0.5), F.lit(5), F.lit(10), False, "csv").alias("a"), roles.complexity(F.lit(99999.0), F.lit(5000), F.lit(10**9), True, "xml", False).alias("b")).first()
    assert (got.a, got.b) == (0.5, 10.0)
