import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing as M


def fill(sizes):
    """Targets by sharing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_takes(spark, documents, texts):
    rows = M.shares(documents).collect()
    again = M.shares(documents.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in documents.select("doc_id", "source").collect()}
    sizes, taken, most = {}, {}, {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) and r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        sizes[s], taken[s], most[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], max(most.get(s, 0), r["size"])
    want = fill(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes)


def test_equals_sql(spark, data, documents):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({M.ORACLE_SQL})").fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in M.shares(documents).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r["doc_id"]: r["__size"] * r["__copies"] for r in M.mix(documents).collect()} == {k: v[3] for k, v in want.items()}


def test_inclusion_frequencies_follow_the_odds_of_each_document(spark):
    """Many sources of the same sizes are as many draws; what a size is taken more often than once is its odds."""
    sizes = [3 + 7 * k for k in range(40)] + [900, 1500]
    df = spark.range(600 * len(sizes)).withColumn("k", F.col("id") % len(sizes))
    size = F.element_at(F.array(*[F.lit(x) for x in sizes]), (F.col("k") + 1).cast("int"))
    docs = df.select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / len(sizes)).cast("string")).alias("source"), F.repeat(F.lit("w "), size).alias("text"))
    mixed = M.mix(docs, weights=(1,), share=1.4)
    got = {r["__size"]: r["p"] for r in mixed.groupBy("__size").agg(F.avg(F.col("__copies") - 1).alias("p")).collect()}
    rest, certain = 0.4 * sum(sizes), set()
    while True:  # the level at which the words expected are the rest, the certain ones taken out first
        level = (rest - sum(certain)) / sum(x**1.5 for x in sizes if x not in certain)
        more = {x for x in sizes if x not in certain and level * x**0.5 >= 1}
        if not more:
            break
        certain |= more
    want = {x: 1 if x in certain else level * x**0.5 for x in sizes}
    assert min(want.values()) < 0.1 and max(want.values()) > 0.6
    assert all(abs(got[x] - want[x]) < 0.09 for x in sizes), {x: (got[x], want[x]) for x in sizes}


def test_a_hot_source_comes_close(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").otherwise(F.concat(F.lit("s"), (F.col("id") % 30).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 97).cast("int")).alias("text"))
    g = M.mix(df).groupBy("source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("took"), F.first("__target").alias("want")).collect()
    assert all(abs(r["took"] - r["want"]) <= 48.5 for r in g)


def test_edge_cases(spark, edge):
    mixed = M.mix(edge)
    assert mixed.columns == [*edge.columns, "__size", "__source_size", "__target", "__copies"]
    rows = mixed.collect()
    assert len(rows) == edge.count() and all(0 <= r["__copies"] <= 2 for r in rows)
    assert M.mix(edge.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [r["taken"] for r in M.shares(empty).collect()] == [0, 0]
