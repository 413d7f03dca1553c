"""Blast radius between code and data: what breaks if a table, column or function changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BRIDGE, DATA_KINDS, Graph
from .graph import closure, reach

# The codes of what a result does not see.
LIMITS = {
    "inferred_calls": "call edges are matched by name and may be wrong or missing",
    "orm_attribute_access": "attribute access on mapped objects is seen on the object itself only",
    "undeclared_schema_links": "links between tables are seen only if declared or joined in a query",
}


def table_dependents(graph: Graph) -> DataFrame:
    """(a, b): b breaks when table a goes, by a foreign key from b or one of its columns, or by a join of the two."""
    e = graph.edges
    contains = e.where("type = 'CONTAINS'").select(F.col("src").alias("owner"), F.col("dst").alias("part"))
    tables = graph.nodes.where("kind = 'table'").select("id")
    refs = e.where("type = 'REFERENCES'").select("src", "dst").join(contains, F.col("src") == F.col("part"), "left")
    keys = refs.select(F.col("dst").alias("a"), F.coalesce("owner", "src").alias("b")).join(tables.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    joins = e.where("type = 'JOINS'")
    return keys.unionByName(joins.select(F.col("src").alias("a"), F.col("dst").alias("b"))).unionByName(joins.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def dependent_tables(graph: Graph, tables: DataFrame) -> DataFrame:
    """(id) of all tables that break, at any distance, when the given ones (id) go."""
    return reach(table_dependents(graph), tables).where("hop > 0").select("id")


def data_to_code(graph: Graph, targets: DataFrame) -> DataFrame:
    """(id, direct): code that a change of the data nodes (id) reaches.

    A table stands for its columns too, a column for its table; dependent tables and their columns join them. Direct
    is what queries or maps those; the rest is what that code contains, and all callers of either.
    """
    e = graph.edges
    contains = e.where("type = 'CONTAINS'").select(F.col("src").alias("owner"), F.col("dst").alias("id"))
    tables = graph.nodes.where("kind = 'table'").select("id")
    given = targets.select("id").distinct()
    own_tables = given.join(tables, "id", "left_semi")
    parents = contains.join(given, "id", "left_semi").select(F.col("owner").alias("id")).join(tables, "id", "left_semi").distinct()
    base = own_tables.unionByName(parents).distinct()
    ripple = dependent_tables(graph, base)
    # the columns of a column's table stay out: only the given column and its table change
    full = own_tables.unionByName(ripple).distinct()
    columns = contains.join(full.withColumnRenamed("id", "owner"), "owner", "left_semi").select("id")
    touched = given.unionByName(base).unionByName(ripple).unionByName(columns).distinct()
    direct = e.where(F.col("type").isin(list(BRIDGE))).join(touched.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    inside = contains.join(direct.withColumnRenamed("id", "owner"), "owner", "left_semi").select("id")
    seeds = direct.unionByName(inside).distinct()
    callers = closure(e.where("type = 'CALLS'"), seeds, reverse=True)
    rest = seeds.join(direct, "id", "left_anti").unionByName(callers).distinct().join(direct, "id", "left_anti")
    return direct.withColumn("direct", F.lit(True)).unionByName(rest.withColumn("direct", F.lit(False)))


def code_to_data(graph: Graph, starts: DataFrame) -> DataFrame:
    """(id, direct): data that the code nodes (id) touch, directly in their scope or through what it calls.

    The scope is what the nodes contain; calls go on from there, without looking into what called nodes contain.
    """
    e = graph.edges
    given = starts.select("id").distinct()
    scope = given.unionByName(closure(e.where("type = 'CONTAINS'"), given)).distinct()
    called = closure(e.where("type = 'CALLS'"), scope)
    bridge = e.where(F.col("type").isin(list(BRIDGE))).select("src", F.col("dst").alias("id"))
    touch = lambda who: bridge.join(who.withColumnRenamed("id", "src"), "src", "left_semi").select("id").distinct()
    direct = touch(scope)
    rest = touch(called).join(direct, "id", "left_anti")
    return direct.withColumn("direct", F.lit(True)).unionByName(rest.withColumn("direct", F.lit(False)))


def completeness(towards_code: bool) -> dict:
    codes = [c for c in LIMITS if towards_code or c != "undeclared_schema_links"]
    return {"exhaustive": False, "advisory_only": True, "limitations": [{"code": c, "detail": LIMITS[c]} for c in codes]}


def is_data(kind: str) -> bool:
    return kind in DATA_KINDS
