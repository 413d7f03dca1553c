"""Operators on tables of a few rows: the cases that the star-schema queries do not reach."""

import pytest
from pyspark.sql import functions as F

from sparkloom import evaluate
from sparkloom.functions import text as X
from sparkloom.operators import delta, graph, intervals, metrics, ranking, rerank, resolve


def test_tokenize(spark):
    got = spark.createDataFrame([("parseHTTPResponse_v2 x1 É9a",)], "t string").select(X.tokenize("t").alias("t")).first()["t"]
    assert got == ["parse", "http", "response", "v2", "x1", "a"] == [t for t in got if t]


def test_clean_docstring(spark):
    df = spark.createDataFrame([('r"""Hi. """',), ("'x'",), ("plain",)], "s string")
    assert [r[0] for r in df.select(X.clean_docstring("s")).collect()] == ["Hi.", "x", "plain"]


def test_fan_out_counts_the_chosen_tier(spark):
    many = [(f"t{i}", "function", "go", f"m{i}.go", f"m{i}") for i in range(9)] + [("c", "function", "f", "m0.f", "m0")]
    sym = spark.createDataFrame(many, "id string, kind string, name string, qualified_name string, scope string")
    site = spark.createDataFrame([(1, "c", "go", False)], "site int, caller string, name string, is_receiver boolean")
    assert [r["dst"] for r in resolve.resolve_calls(site, sym).collect()] == ["t0"]
    alone = sym.where("id <> 't0'").withColumn("scope", F.when(F.col("id") == "c", "m0").otherwise(F.col("scope")))
    assert resolve.resolve_calls(site, alone).count() == 8
    assert resolve.resolve_calls(site, alone, fan_out=7).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank long")
    with pytest.raises(ValueError):
        ranking.rrf([a], weights=[1, 2])
    assert ranking.rrf([a, a], weights=[0, 1]).count() == 2
    assert (ranking.WEIGHTS, ranking.RRF_K, ranking.DEPTH) == ((3.0, 0.5, 0.5), 10, 50)


def test_rerankers():
    assert rerank.parse_order("3, 1 and 3 then 9", 4) == [2, 0, 1, 3]
    items = [("a", "nothing"), ("b", "parse the file"), ("c", "file")]
    assert rerank.LexicalReranker().rerank("parse file", items) == ["b", "c", "a"]
    with pytest.warns(UserWarning):
        assert rerank.ListwiseReranker().rerank("file", items)[0] in "bc"
    assert rerank.ListwiseReranker(lambda p: "3 2").rerank("q", items) == ["c", "b", "a"]


def test_cycles_and_missing_paths(spark):
    e = spark.createDataFrame([("CALLS", s, d, "INFERRED") for s, d in ("ab", "bc", "ca", "xy")], "type string, src string, dst string, confidence string")
    assert {r["id"] for r in graph.closure(e, spark.createDataFrame([("a",)], "id string")).collect()} == {"b", "c"}
    assert graph.shortest_path(e, "a", "x").count() == 0
    with pytest.raises(ValueError):
        graph.relations(e, "a", types=["NOPE"])
    ranks = {r["id"]: r["score"] for r in graph.pagerank(e, e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), spark.createDataFrame([("a", 2.0)], "id string, weight double")).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and set(ranks) == {"a", "b", "c"}


def test_intervals(spark):
    spans = spark.createDataFrame([("f", 1, 500, "m", "module"), ("f", 60, 70, "a", "function"), ("f", 64, 65, "b", "function")], "file string, start long, end long, id string, kind string")
    pts = spark.createDataFrame([("f", 64), ("f", 70), ("f", 71), ("g", 1)], "file string, line long")
    assert {(r["line"], r["id"]) for r in intervals.enclosing(pts, spans).collect()} == {(64, "b"), (70, "a"), (71, "m")}
    chunks = spark.createDataFrame([(1, "f", 1, 200), (2, "f", 66, 66)], "chunk int, file string, start long, end long")
    assert {(r["chunk"], r["id"]) for r in intervals.overlapping(chunks, spans).collect()} == {(1, "m"), (1, "a"), (1, "b"), (2, "m"), (2, "a")}


def test_delta(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, content_sha string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "id string, content_sha string")
    assert sorted((r["id"], r["action"]) for r in delta.row_delta(old, new).collect()) == [("a", "keep"), ("b", "create"), ("b", "delete"), ("c", "create")]


def test_answers_and_terms(spark):
    a = spark.createDataFrame([(1, "it is pkg.save_all", ["save"]), (2, "call save.", ["save"]), (3, "", [])], "task int, answer string, gold array<string>")
    assert [r["success"] for r in metrics.answered(a).orderBy("task").collect()] == [False, True, False]
    assert evaluate.terms("What does the parse_file do?") == ["parse_file"]
