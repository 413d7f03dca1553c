"""The library's generic tables (nodes, edges, symbols, rankings, spans) taken from the star-schema test tables, and
the same in SQL as common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions are modules, nations classes, customers functions, suppliers methods, orders functions."""
    r = table(spark, d, "region").select(node_id("region", "r_regionkey").alias("id"), F.lit("module").alias("kind"), F.col("r_name").alias("name"), F.col("r_name").alias("qualified_name"))
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n_ = n.select(node_id("nation", "n_nationkey").alias("id"), F.lit("class").alias("kind"), F.col("n_name").alias("name"), F.concat_ws(".", "r_name", "n_name").alias("qualified_name"))
    c = table(spark, d, "customer").select(node_id("customer", "c_custkey").alias("id"), F.lit("function").alias("kind"), F.col("c_name").alias("name"), F.concat_ws(".", "c_mktsegment", "c_name").alias("qualified_name"))
    s = table(spark, d, "supplier").select(node_id("supplier", "s_suppkey").alias("id"), F.lit("method").alias("kind"), F.col("s_name").alias("name"), F.col("s_name").alias("qualified_name"))
    o = table(spark, d, "orders").select(node_id("order", "o_orderkey").alias("id"), F.lit("function").alias("kind"), F.col("o_orderpriority").alias("name"), F.concat_ws(".", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("qualified_name"))
    return r.unionAll(n_).unionAll(c).unionAll(s).unionAll(o)


NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'class', n_name, r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, 'function', c_name, c_mktsegment || '.' || c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'method', s_name, s_name FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'function', o_orderpriority, o_orderpriority || '.' || o_orderkey FROM orders)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """CONTAINS region to nation to customer and supplier, CALLS customer to order."""
    one = lambda t, kind, a, ak, b, bk, sure: table(spark, d, t).select(F.lit(kind).alias("type"), node_id(a, ak).alias("src"), node_id(b, bk).alias("dst"), F.lit(sure).alias("confidence"))
    return (
        one("nation", "CONTAINS", "region", "n_regionkey", "nation", "n_nationkey", "EXTRACTED")
        .unionAll(one("customer", "CONTAINS", "nation", "c_nationkey", "customer", "c_custkey", "EXTRACTED"))
        .unionAll(one("supplier", "CONTAINS", "nation", "s_nationkey", "supplier", "s_suppkey", "EXTRACTED"))
        .unionAll(one("orders", "CALLS", "customer", "o_custkey", "order", "o_orderkey", "INFERRED"))
    )


EDGES = """edges AS (
  SELECT 'CONTAINS' AS type, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'EXTRACTED' AS confidence FROM nation
  UNION ALL SELECT 'CONTAINS', 'nation:' || c_nationkey, 'customer:' || c_custkey, 'EXTRACTED' FROM customer
  UNION ALL SELECT 'CONTAINS', 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'EXTRACTED' FROM supplier
  UNION ALL SELECT 'CALLS', 'customer:' || o_custkey, 'order:' || o_orderkey, 'INFERRED' FROM orders)"""

BOTH_WAYS = "both_ways AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst)"


def data_graph(spark: SparkSession, d: str) -> Graph:
    """Suppliers are tables and parts their columns; orders are functions that query parts and call the customer's
    order before; parts of size 1 refer to a second supplier."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part, orders = table(spark, d, "part"), table(spark, d, "orders")
    n = (
        table(spark, d, "supplier").select(node_id("supplier", "s_suppkey").alias("id"), F.lit("table").alias("kind"))
        .unionAll(part.select(node_id("part", "p_partkey").alias("id"), F.lit("column").alias("kind")))
        .unionAll(orders.select(node_id("order", "o_orderkey").alias("id"), F.lit("function").alias("kind")))
    )
    ends = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    edge = lambda df, kind, a, b, sure: df.select(F.lit(kind).alias("type"), a.alias("src"), b.alias("dst"), F.lit(sure).alias("confidence"))
    from pyspark.sql import Window

    before = orders.withColumn("prev", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("prev is not null")
    small = ends.join(part.where("p_size = 1"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    e = (
        edge(ends, "CONTAINS", node_id("supplier", "lo"), node_id("part", "l_partkey"), "EXTRACTED")
        .unionAll(edge(li.select("l_orderkey", "l_partkey").distinct(), "QUERIES", node_id("order", "l_orderkey"), node_id("part", "l_partkey"), "INFERRED"))
        .unionAll(edge(before, "CALLS", node_id("order", "o_orderkey"), node_id("order", "prev"), "INFERRED"))
        .unionAll(edge(small, "REFERENCES", node_id("part", "l_partkey"), node_id("supplier", "hi"), "EXTRACTED"))
    )
    return Graph(n, e)


DATA_GRAPH = """ends AS (SELECT l_partkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY l_partkey),
contains AS (SELECT 'supplier:' || lo AS owner, 'part:' || l_partkey AS part FROM ends),
queries AS (SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem),
calls AS (SELECT 'order:' || o_orderkey AS src, 'order:' || prev AS dst FROM
  (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL),
refs AS (SELECT 'part:' || l_partkey AS src, 'supplier:' || hi AS dst FROM ends JOIN part ON l_partkey = p_partkey WHERE p_size = 1),
deps AS (SELECT DISTINCT refs.dst AS a, contains.owner AS b FROM refs JOIN contains ON refs.src = contains.part)"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: names repeat, brands are scopes, and brand and type the owning class."""
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("method")
    return table(spark, d, "part").select(
        node_id("part", "p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_type", "p_name").alias("qualified_name"), F.col("p_brand").alias("scope"), F.col("p_partkey").alias("seq"),
    )


SYMBOLS = """symbols AS (SELECT 'part:' || p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind,
  p_name AS name, p_brand || '.' || p_type || '.' || p_name AS qualified_name, p_brand AS scope, p_brand || '.' || p_type AS owner, p_partkey AS seq FROM part)"""


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    """A line item is a call from its part to the name of the part whose number is that of its supplier."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    named = li.join(part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), F.col("l_suppkey") == F.col("k"))
    rows = named.select(node_id("part", "l_partkey").alias("caller"), "name", (F.col("l_linenumber") % 2 == 0).alias("is_receiver")).distinct()
    return rows.withColumn("site", F.concat_ws("|", "caller", "name", F.col("is_receiver").cast("string")))


CALL_SITES = """sites AS (SELECT DISTINCT 'part:' || l_partkey AS caller, p_name AS name, l_linenumber % 2 = 0 AS is_receiver
  FROM lineitem JOIN part ON l_suppkey = p_partkey)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """A question for each source; its mode from its name's last digit."""
    src = table(spark, d, "documents").select(F.col("source").alias("question")).distinct()
    digit = F.substring("question", -1, 1)
    return src.withColumn("mode", F.when(digit < "3", "STRUCT").when(digit < "6", "STRUCT+EXACT").when(digit < "8", "CROSS+WHY").otherwise("SEMANTIC"))


QUESTIONS = """questions AS (SELECT question, CASE WHEN right(question, 1) < '3' THEN 'STRUCT' WHEN right(question, 1) < '6' THEN 'STRUCT+EXACT'
  WHEN right(question, 1) < '8' THEN 'CROSS+WHY' ELSE 'SEMANTIC' END AS mode FROM (SELECT DISTINCT source AS question FROM documents))"""


def rankings(spark: SparkSession, d: str) -> DataFrame:
    """For each source its documents by length."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select(F.col("source").alias("question"), F.col("doc_id").alias("id"), F.row_number().over(w).cast("bigint").alias("rank"))


RANKINGS = "rankings AS (SELECT source AS question, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The labelled toxic documents of each source."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("question"))
    return docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("question", F.col("doc_id").alias("id"))


GOLD = "gold AS (SELECT source AS question, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"


def turn_spans(spark: SparkSession, d: str) -> DataFrame:
    """In each conversation the stretch of turns of each role."""
    c = table(spark, d, "conversations")
    file = F.col("conv_id").cast("string")
    kind = F.when(F.col("role") == "system", "module").otherwise("function")
    return c.groupBy(file.alias("file"), "role").agg(F.min("turn").alias("start"), F.max("turn").alias("end")).select("file", "start", "end", F.concat_ws("/", "file", "role").alias("id"), kind.alias("kind"))


TURN_SPANS = """spans AS (SELECT conv_id::VARCHAR AS file, min(turn) AS s, max(turn) AS e, conv_id || '/' || role AS id,
  CASE WHEN role = 'system' THEN 'module' ELSE 'function' END AS kind FROM conversations GROUP BY conv_id, role)"""

TOKENS = r"""tokens AS (SELECT doc_id AS id, unnest(string_split(lower(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' ')) AS term
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*')) AS w FROM documents)),
lens AS (SELECT d.doc_id AS id, count(t.term) AS len FROM documents d LEFT JOIN tokens t ON t.id = d.doc_id GROUP BY d.doc_id)"""


def bm25(terms: str, name: str = "bm25") -> str:
    """Needs TOKENS; terms: a list of quoted words. The lower-casing after the split gives the same pieces."""
    return f"""{name}_tf AS (SELECT id, term, count(*) AS tf FROM tokens WHERE term IN ({terms}) GROUP BY id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT id, sum(ln(1 + ((SELECT count(*) FROM lens) - df + 0.5) / (df + 0.5)) * tf * 2.5
    / (tf + 1.5 * (1 - 0.75 + 0.75 * greatest(len, 1) / (SELECT avg(len) FROM lens)))) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN lens USING (id) GROUP BY id)"""
