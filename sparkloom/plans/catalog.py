"""Every query of the library over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import delta, graph, impact, intervals, metrics, ranking, resolve
from ..schema import Graph
from ..sources import files as sources
from . import bindings as B
from . import build, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUESTION = "theIdiot moron of the clown_worthless"
TERMS = "'the', 'idiot', 'moron', 'of', 'clown', 'worthless'"
SECOND = "idiot heating license"
SECOND_TERMS = "'idiot', 'heating', 'license'"
DIM = 64
TOP = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents")


def index(spark: SparkSession, d: str) -> ranking.LexicalIndex:
    return ranking.LexicalIndex(docs(spark, d), "doc_id", "text")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", places))


# Text and lexical ranking


@query(f"WITH {B.TOKENS} SELECT d.doc_id AS id, count(term) AS n_tokens, count(DISTINCT term) AS n_distinct FROM documents d LEFT JOIN tokens t ON t.id = d.doc_id GROUP BY d.doc_id")
def tokenize_terms(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("id"), X.tokenize("text").alias("t"))
    return t.select("id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"WITH {B.TOKENS} SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term")
def inverted_index(spark, d):
    return index(spark, d).terms()


@query(f"WITH {B.TOKENS} SELECT term, count(DISTINCT id) AS df FROM tokens GROUP BY term")
def doc_freq(spark, d):
    return index(spark, d).document_frequency()


@query(f"WITH {B.TOKENS} SELECT count(*) AS n_docs, sum(len)::BIGINT AS total_tokens, (SELECT count(DISTINCT term) FROM tokens) AS n_terms, round(avg(len), 6) AS avg_tokens FROM lens")
def bm25_stats(spark, d):
    return index(spark, d).statistics().withColumn("avg_tokens", F.round("avg_tokens", 6))


BM25_TOP = f"WITH {B.TOKENS}, {B.bm25(TERMS)} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= {TOP}"


@query(BM25_TOP)
def bm25_topk(spark, d):
    return rounded(index(spark, d).rank(QUESTION, TOP))


@query(f"""WITH {B.TOKENS}, {B.bm25(TERMS)}, top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= {TOP})
SELECT rank, doc_id AS id, source AS name, lang, round(score, 4) AS score, left(text, 500) AS docstring FROM top JOIN documents ON doc_id = id""")
def query_hydrated(spark, d):
    top = index(spark, d).rank(QUESTION, TOP)
    both = docs(spark, d).join(F.broadcast(top), F.col("doc_id") == F.col("id"))  # at most TOP rows
    return both.select("rank", "id", F.col("source").alias("name"), "lang", F.round("score", 4).alias("score"), F.substring("text", 1, 500).alias("docstring"))


# Vectors

SLOTS = f"""{B.TOKENS}, hashed AS (SELECT id, md5(term) AS m FROM tokens WHERE term <> ''),
slots AS (SELECT id, ((((('0x' || substr(m, 1, 8))::BIGINT % {DIM}) * ({4294967296 % DIM}) + ('0x' || substr(m, 9, 8))::BIGINT) % {DIM}
  * ({4294967296 % DIM}) + ('0x' || substr(m, 17, 8))::BIGINT) % {DIM} * ({4294967296 % DIM}) + ('0x' || substr(m, 25, 8))::BIGINT) % {DIM} AS slot,
  sum(CASE WHEN ('0x' || substr(m, 30, 1))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM hashed GROUP BY 1, 2)"""


@query(f"WITH {SLOTS}, l AS (SELECT id, sqrt(sum(w * w)) AS len FROM slots WHERE w <> 0 GROUP BY id) SELECT id, slot::INTEGER AS slot, round(w / len, 6) AS weight FROM slots JOIN l USING (id) WHERE w <> 0")
def hash_embed_slots(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("id"), X.tokenize("text").alias("tokens"))
    return V.hash_embed(t, "id", DIM).select("id", F.explode("slots").alias("slot", "weight")).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {SLOTS}, q AS (SELECT slot, w FROM (SELECT ((((('0x' || substr(m, 1, 8))::BIGINT % {DIM}) * ({4294967296 % DIM}) + ('0x' || substr(m, 9, 8))::BIGINT) % {DIM}
  * ({4294967296 % DIM}) + ('0x' || substr(m, 17, 8))::BIGINT) % {DIM} * ({4294967296 % DIM}) + ('0x' || substr(m, 25, 8))::BIGINT) % {DIM} AS slot,
  sum(CASE WHEN ('0x' || substr(m, 30, 1))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w
  FROM (SELECT md5(unnest(['the', 'idiot', 'moron', 'of', 'the', 'clown', 'worthless'])) AS m) GROUP BY 1) WHERE w <> 0),
ql AS (SELECT sqrt(sum(w * w)) AS len FROM q),
s AS (SELECT d.doc_id AS id, coalesce(sum(s.w * q.w), 0) AS dot, coalesce(sqrt(sum(s.w * s.w)), 0) AS len FROM documents d LEFT JOIN slots s ON s.id = d.doc_id LEFT JOIN q ON q.slot = s.slot GROUP BY d.doc_id),
r AS (SELECT id, round(dot / (CASE WHEN s.len = 0 THEN 1e-9 ELSE s.len END) / ql.len, 6) AS score FROM s, ql)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= {TOP}"""
)
def hash_embed_cosine_topk(spark, d):
    scores = ranking.hash_embedding_scores(docs(spark, d), "the idiot moron of theClown worthless", DIM, "doc_id")
    return ranking.top(rounded(scores), TOP)


COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id AS id, round({COSINE}, 6) AS score, row_number() OVER (ORDER BY round({COSINE}, 6) DESC, vec_id) AS rank FROM embeddings e QUALIFY rank <= {TOP}")
def vector_topk(spark, d):
    e = B.table(spark, d, "embeddings")
    probe = e.where("vec_id = 0").first()["embedding"]
    return rounded(ranking.cosine_rank(e, probe, TOP, "vec_id"))


@query("SELECT len(embedding)::INTEGER AS width, count(*) AS n_rows, len(embedding) = 64 AS fits FROM embeddings GROUP BY 1, 3")
def vector_dim_check(spark, d):
    return ranking.check_width(B.table(spark, d, "embeddings"), 64)


# Fusion and reranking

PAIR = f"""{B.TOKENS}, {B.bm25(TERMS, 'a')}, {B.bm25(SECOND_TERMS, 'b')},
ra AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM a QUALIFY rank <= 50),
rb AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 50),
rc AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50)"""


def _signals(spark, d):
    by_length = ranking.top(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")), ranking.DEPTH)
    return index(spark, d).rank(QUESTION, ranking.DEPTH), index(spark, d).rank(SECOND, ranking.DEPTH), by_length


FUSED = """SELECT id, round(score, 8) AS score, row_number() OVER (ORDER BY round(score, 8) DESC, id) AS rank FROM ({}) QUALIFY rank <= {}"""


def _fused(df: DataFrame, k: int) -> DataFrame:
    return ranking.top(df.select("id", F.round("score", 8).alias("score")), k)


@query(f"WITH {PAIR} " + FUSED.format("SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (FROM ra UNION ALL FROM rb) GROUP BY id", TOP))
def rrf_fuse(spark, d):
    a, b, _ = _signals(spark, d)
    return _fused(ranking.rrf([a, b], 1000), TOP)


HYBRID = "SELECT id, sum(s) AS score FROM (SELECT id, 3.0::DOUBLE / (10 + rank) AS s FROM rc UNION ALL SELECT id, 0.5::DOUBLE / (10 + rank) FROM rb UNION ALL SELECT id, 0.5::DOUBLE / (10 + rank) FROM ra) GROUP BY id"


@query(f"WITH {PAIR} " + FUSED.format(HYBRID, TOP))
def hybrid_topk(spark, d):
    a, b, c = _signals(spark, d)
    return _fused(ranking.hybrid({"vector": c, "graph": b, "lexical": a}, 1000), TOP)


SHARED = "(SELECT count(DISTINCT t.term) FROM tokens t WHERE t.id = f.id AND t.term IN (" + TERMS + "))"


@query(
    f"WITH {PAIR}, h AS ({FUSED.format(HYBRID, TOP)}), q AS (SELECT f.id, f.rank AS before, {SHARED} AS shared FROM h f) "
    "SELECT id, shared::DOUBLE AS score, row_number() OVER (ORDER BY shared DESC, before) AS rank FROM q"
)
def rerank_lexical_topk(spark, d):
    texts = docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    return ranking.lexical_rerank(hybrid_topk(spark, d), texts, QUESTION)


@query(
    f"WITH {PAIR}, h AS ({FUSED.format(HYBRID, TOP)}), q AS (SELECT f.id, f.rank AS before, {SHARED} AS shared FROM h f), "
    "l AS (SELECT id, before, row_number() OVER (ORDER BY shared DESC, before) AS after FROM q) "
    + FUSED.format("SELECT id, 1.0::DOUBLE / (60 + before) + 1.0::DOUBLE / (60 + after) AS score FROM l", 10)
)
def rerank_blend_topk(spark, d):
    texts = docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    blended = ranking.reranked(hybrid_topk(spark, d), texts, QUESTION, 1000)
    return _fused(blended, 10)


GRID = "(1, 'a', 3.0, 10), (1, 'b', 0.5, 10), (1, 'c', 0.5, 10), (2, 'a', 1.0, 60), (2, 'b', 1.0, 60), (2, 'c', 1.0, 60), (3, 'a', 0.0, 10), (3, 'b', 1.0, 10), (3, 'c', 1.5, 10)"


@query(
    f"""WITH {PAIR}, r AS (SELECT 'a' AS signal, * FROM ra UNION ALL SELECT 'b', * FROM rb UNION ALL SELECT 'c', * FROM rc),
g(config, signal, weight, rrf_k) AS (VALUES {GRID}),
s AS (SELECT config, id, sum(weight::DOUBLE / (rrf_k + rank)) AS score FROM r JOIN g USING (signal) WHERE weight <> 0 GROUP BY config, id)
SELECT config, 'q' AS question, id, round(score, 8) AS score, row_number() OVER (PARTITION BY config ORDER BY round(score, 10) DESC, id) AS rank FROM s QUALIFY rank <= 10"""
)
def fusion_sweep(spark, d):
    parts = [r.select(F.lit("q").alias("question"), F.lit(n).alias("signal"), "id", "rank") for n, r in zip("abc", _signals(spark, d), strict=True)]
    grid = spark.sql(f"SELECT * FROM VALUES {GRID} AS g(config, signal, weight, rrf_k)").withColumn("weight", F.col("weight").cast("double"))
    return rounded(ranking.sweep(parts[0].unionAll(parts[1]).unionAll(parts[2]), grid), 8)


# Graph

REL = "SELECT DISTINCT type AS relation, {way} AS direction, {other} AS id, confidence FROM edges WHERE {own} = 'nation:3'"
REL_OUT, REL_IN = REL.format(way="'out'", other="dst", own="src"), REL.format(way="'in'", other="src", own="dst")


@query(f"WITH {B.EDGES} SELECT * FROM edges")
def edges_typed(spark, d):
    return B.edges(spark, d)


@query(f"WITH {B.EDGES}, t(type) AS (VALUES ('CALLS'), ('INHERITS'), ('IMPORTS'), ('CONTAINS'), ('DOCUMENTS'), ('REFERENCES'), ('MAPS_TO'), ('QUERIES'), ('JOINS')) SELECT t.type, count(edges.type) AS n FROM t LEFT JOIN edges USING (type) GROUP BY t.type")
def edge_counts(spark, d):
    return graph.edge_counts(B.edges(spark, d))


@query(f"WITH {B.NODES} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def node_counts(spark, d):
    return graph.node_counts(B.nodes(spark, d))


@query(f"WITH {B.NODES}, {B.EDGES}, {B.BOTH_WAYS} SELECT id, count(a) AS degree FROM nodes LEFT JOIN both_ways ON a = id GROUP BY id")
def degree(spark, d):
    return graph.degrees(B.nodes(spark, d), B.edges(spark, d))


@query(f"WITH {B.EDGES} {REL_OUT}")
def relations_out(spark, d):
    return graph.relations(B.edges(spark, d), "nation:3", "out")


@query(f"WITH {B.EDGES} {REL_IN}")
def relations_in(spark, d):
    return graph.relations(B.edges(spark, d), "nation:3", "in")


@query(f"WITH {B.EDGES} {REL_OUT} UNION ALL {REL_IN}")
def relations_both(spark, d):
    return graph.relations(B.edges(spark, d), "nation:3")


@query(f"WITH {B.EDGES} SELECT DISTINCT type AS relation, 'out' AS direction, dst AS id, confidence FROM edges WHERE src = 'customer:5' AND type = 'CALLS'")
def calls_of(spark, d):
    return graph.relations(B.edges(spark, d), "customer:5", "out", ["CALLS"])


@query(f"WITH {B.EDGES} SELECT DISTINCT type AS relation, 'in' AS direction, src AS id, confidence FROM edges WHERE dst = 'order:5' AND type = 'CALLS'")
def callers_of(spark, d):
    return graph.relations(B.edges(spark, d), "order:5", "in", ["CALLS"])


@query(f"WITH {B.NODES}, {B.EDGES}, {B.BOTH_WAYS} SELECT a AS id, count(DISTINCT b) AS n FROM both_ways GROUP BY a")
def distinct_neighbors(spark, d):
    return graph.undirected(B.edges(spark, d)).distinct().groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def _hops(start: str, hops: int, out: str) -> str:
    levels = [f"s0 AS (SELECT '{start}' AS id, 0 AS hop)"]
    for h in range(1, hops + 1):
        levels.append(f"s{h} AS (SELECT * FROM s{h - 1} UNION ALL SELECT DISTINCT b, {h} FROM both_ways WHERE a IN (SELECT id FROM s{h - 1} WHERE hop = {h - 1}) AND b NOT IN (SELECT id FROM s{h - 1}))")
    return f"WITH {B.EDGES}, {B.BOTH_WAYS}, {', '.join(levels)} {out.format(s=f's{hops}')}"


@query(_hops("customer:5", 2, "SELECT id, hop FROM {s} WHERE hop > 0"))
def neighbors_2hop(spark, d):
    return graph.neighbors(B.edges(spark, d), "customer:5", 2)


@query(_hops("order:5", 4, "SELECT id, hop FROM {s} WHERE hop > 0"))
def neighbors_multi_hop(spark, d):
    return graph.neighbors(B.edges(spark, d), "order:5", 4)


@query(f"WITH RECURSIVE {B.EDGES}, c(id) AS (SELECT 'region:1' UNION SELECT dst FROM c JOIN edges ON src = id) SELECT id FROM c WHERE id <> 'region:1'")
def closure_fwd(spark, d):
    return graph.closure(B.edges(spark, d), spark.createDataFrame([("region:1",)], "id string"))


@query(f"WITH RECURSIVE {B.EDGES}, c(id) AS (SELECT 'order:7' UNION SELECT src FROM c JOIN edges ON dst = id) SELECT id FROM c WHERE id <> 'order:7'")
def closure_rev(spark, d):
    return graph.closure(B.edges(spark, d), spark.createDataFrame([("order:7",)], "id string"), reverse=True)


@query(_hops("order:5", 8, "SELECT max(hop)::BIGINT AS length FROM {s} WHERE id = 'order:2'"))
def shortest_path_len(spark, d):
    return graph.shortest_path(B.edges(spark, d), "order:5", "order:2").agg(F.max("step").alias("length"))  # null: no path


@query(
    _hops("order:5", 8, ", r AS (SELECT hop, id FROM {s} WHERE id = 'order:2')")
    + ", ".join(["", *[f"p{k} AS (SELECT * FROM {'r' if k == 8 else f'p{k + 1}'} UNION ALL SELECT hop - 1, (SELECT min(b) FROM both_ways WHERE a = x.id AND b IN (SELECT id FROM s8 WHERE hop = x.hop - 1)) FROM {'r' if k == 8 else f'p{k + 1}'} x WHERE hop = (SELECT min(hop) FROM {'r' if k == 8 else f'p{k + 1}'}) AND hop > 0)" for k in range(8, 0, -1)]])
    + " SELECT hop::BIGINT AS step, id FROM p1"
)
def shortest_path_nodes(spark, d):
    return graph.shortest_path(B.edges(spark, d), "order:5", "order:2")


@query(
    f"""WITH RECURSIVE {B.NODES}, {B.EDGES}, {B.BOTH_WAYS}, deg AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a),
seeds AS (SELECT id, 1.0 / count(*) OVER () AS p FROM nodes WHERE name = 'Customer#000000005' OR id = 'supplier:3' OR id = 'order:11'),
pr(it, id, r) AS (SELECT 0, n.id, coalesce(p, 0)::DOUBLE FROM nodes n LEFT JOIN seeds USING (id)
  UNION ALL SELECT it + 1, id, x + coalesce(p, 0) * (1 - sum(x) OVER ()) FROM
    (SELECT it, id, sum(y) AS x FROM (SELECT pr.it, both_ways.b AS id, 0.85 * r / n AS y FROM pr JOIN both_ways ON both_ways.a = pr.id JOIN deg ON deg.a = pr.id WHERE it < 30 AND r > 0
      UNION ALL SELECT it, id, 0 FROM pr WHERE it < 30) GROUP BY it, id) LEFT JOIN seeds USING (id))
SELECT id, round(r, 8) AS score, row_number() OVER (ORDER BY round(r, 8) DESC, id) AS rank FROM pr WHERE it = 30 AND r > 0 QUALIFY rank <= {TOP}"""
)
def ppr_topk(spark, d):
    seeds = B.nodes(spark, d).where("name = 'Customer#000000005' or id in ('supplier:3', 'order:11')").select("id", F.lit(1.0).alias("weight"))
    ranks = graph.pagerank(B.edges(spark, d), B.nodes(spark, d), seeds)
    return ranking.top(rounded(ranks, 8), TOP)


# Impact


@query(f"WITH {B.DATA_GRAPH} SELECT a, b FROM deps")
def table_dependents(spark, d):
    return impact.table_dependents(B.data_graph(spark, d))


@query(f"WITH RECURSIVE {B.DATA_GRAPH}, c(id) AS (SELECT 'supplier:2' UNION SELECT b FROM c JOIN deps ON a = id) SELECT id FROM c WHERE id <> 'supplier:2'")
def dependent_tables(spark, d):
    return impact.dependent_tables(B.data_graph(spark, d), spark.createDataFrame([("supplier:2",)], "id string"))


@query(
    f"""WITH RECURSIVE {B.DATA_GRAPH}, base(id) AS (SELECT owner FROM contains WHERE part = 'part:7'),
ripple(id) AS (SELECT id FROM base UNION SELECT b FROM ripple JOIN deps ON a = id),
touched AS (SELECT 'part:7' AS id UNION SELECT id FROM ripple UNION SELECT part FROM contains WHERE owner IN (SELECT id FROM ripple EXCEPT SELECT id FROM base)),
direct AS (SELECT DISTINCT src AS id FROM queries WHERE dst IN (SELECT id FROM touched)),
up(id) AS (SELECT id FROM direct UNION SELECT src FROM up JOIN calls ON dst = id)
SELECT id, id IN (SELECT id FROM direct) AS direct FROM up"""
)
def impact_data_to_code(spark, d):
    return impact.data_to_code(B.data_graph(spark, d), spark.createDataFrame([("part:7",)], "id string"))


@query(
    f"""WITH RECURSIVE {B.DATA_GRAPH}, down(id) AS (SELECT 'order:900' UNION SELECT dst FROM down JOIN calls ON src = id),
d AS (SELECT DISTINCT dst AS id FROM queries WHERE src = 'order:900')
SELECT DISTINCT dst AS id, dst IN (SELECT id FROM d) AS direct FROM queries WHERE src IN (SELECT id FROM down)"""
)
def impact_code_to_data(spark, d):
    return impact.code_to_data(B.data_graph(spark, d), spark.createDataFrame([("order:900",)], "id string"))


# Resolution


@query(
    f"""WITH {B.SYMBOLS}, refs AS (SELECT name AS ref FROM symbols UNION SELECT qualified_name FROM symbols UNION SELECT regexp_replace(qualified_name, '^[^.]*[.]', '') FROM symbols UNION SELECT id FROM symbols),
hits AS (SELECT ref, id, 1 AS tier, '' AS q FROM refs JOIN symbols ON id = ref UNION ALL SELECT ref, id, 2, qualified_name FROM refs JOIN symbols ON qualified_name = ref
  UNION ALL SELECT ref, id, 3, qualified_name FROM refs JOIN symbols ON regexp_replace(qualified_name, '^[^.]*[.]', '') = ref OR regexp_replace(qualified_name, '^[^.]*[.][^.]*[.]', '') = ref
  UNION ALL SELECT ref, id, 4, qualified_name FROM refs JOIN symbols ON name = ref)
SELECT ref, id, tier::BIGINT AS tier, row_number() OVER (PARTITION BY ref ORDER BY length(q), id) AS rank FROM (SELECT *, min(tier) OVER (PARTITION BY ref) AS best FROM hits) WHERE tier = best"""
)
def resolve_tiers(spark, d):
    s = B.symbols(spark, d)
    refs = s.select(F.col("name").alias("ref")).union(s.select("qualified_name")).union(s.select(F.regexp_replace("qualified_name", "^[^.]*[.]", ""))).union(s.select("id"))
    return resolve.resolve_refs(s, refs)


@query(
    f"""WITH {B.SYMBOLS}, {B.CALL_SITES},
m AS (SELECT s.caller, s.name, s.is_receiver, t.id AS target, CASE WHEN s.is_receiver AND c.kind = 'method' AND t.kind = 'method' AND c.owner = t.owner THEN 1 WHEN c.scope = t.scope THEN 2 ELSE 3 END AS tier
  FROM sites s JOIN symbols c ON c.id = s.caller JOIN symbols t ON t.name = s.name),
b AS (SELECT *, min(tier) OVER w AS best FROM m WINDOW w AS (PARTITION BY caller, name, is_receiver)),
n AS (SELECT *, count(*) OVER (PARTITION BY caller, name, is_receiver) AS n FROM b WHERE tier = best)
SELECT DISTINCT 'CALLS' AS type, caller AS src, target AS dst, 'INFERRED' AS confidence FROM n WHERE n <= 8 AND caller <> target"""
)
def name_resolution_calls(spark, d):
    return resolve.resolve_calls(B.call_sites(spark, d), B.symbols(spark, d))


@query(
    f"""WITH {B.SYMBOLS}, bases AS (SELECT s.id AS type_id, n.name AS base, s.scope FROM symbols s JOIN symbols n ON n.seq = s.seq + 1 WHERE s.kind = 'class'),
m AS (SELECT type_id, base, t.id AS target, (b.scope = t.scope)::INT AS same FROM bases b JOIN symbols t ON t.name = base AND t.kind = 'class' AND t.id <> type_id),
n AS (SELECT *, sum(same) OVER (PARTITION BY type_id, base) AS n_same FROM m)
SELECT 'INHERITS' AS type, type_id AS src, target AS dst, CASE WHEN n_same = 1 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM n WHERE n_same = 0 OR same = 1"""
)
def inherits_confidence(spark, d):
    s = B.symbols(spark, d)
    after = s.select((F.col("seq") - 1).alias("seq"), F.col("name").alias("base"))
    bases = s.where("kind = 'class'").join(after, "seq").select(F.col("id").alias("type_id"), "base")
    return resolve.resolve_bases(bases, s, ["class"])


@query(
    f"""WITH {B.SYMBOLS}, imports AS (SELECT DISTINCT 'customer:' || c_custkey AS module_id, CASE c_custkey % 3 WHEN 0 THEN p_type || '.' || p_name WHEN 1 THEN p_name ELSE c_mktsegment END AS target
  FROM customer JOIN part ON c_custkey = p_partkey),
keys AS (SELECT id, seq, qualified_name AS target, 0 AS loose FROM symbols UNION ALL SELECT id, seq, regexp_replace(qualified_name, '^[^.]*[.]', ''), 1 FROM symbols UNION ALL SELECT id, seq, name, 1 FROM symbols)
SELECT module_id, target, (SELECT first(id ORDER BY loose, seq) FROM keys k WHERE k.target = i.target) AS dst FROM imports i"""
)
def import_resolution(spark, d):
    return resolve.resolve_imports(_imports(spark, d), B.symbols(spark, d))


def _imports(spark, d):
    k = F.col("c_custkey") % 3
    target = F.when(k == 0, F.concat_ws(".", "p_type", "p_name")).when(k == 1, F.col("p_name")).otherwise(F.col("c_mktsegment"))
    both = B.table(spark, d, "customer").join(B.table(spark, d, "part"), F.col("c_custkey") == F.col("p_partkey"))
    return both.select(B.node_id("customer", "c_custkey").alias("module_id"), target.alias("target"))


@query("SELECT DISTINCT 'ext::' || c_mktsegment AS id, c_mktsegment AS name, c_mktsegment AS qualified_name FROM customer JOIN part ON c_custkey = p_partkey WHERE c_custkey % 3 = 2")
def external_stubs(spark, d):
    return resolve.externals(import_resolution(spark, d))


@query(f"WITH {B.SYMBOLS}, q AS (SELECT DISTINCT p_brand AS question, unnest([p_name, p_type || '.' || p_name]) AS anchor FROM part) SELECT DISTINCT question, anchor, id FROM q JOIN symbols ON qualified_name = anchor OR qualified_name LIKE '%.' || anchor OR name = anchor")
def anchor_match(spark, d):
    q = B.table(spark, d, "part").select(F.col("p_brand").alias("question"), F.explode(F.array("p_name", F.concat_ws(".", "p_type", "p_name"))).alias("anchor")).distinct()
    return resolve.anchors(q, B.symbols(spark, d))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY text")
def dedupe_first_wins(spark, d):
    return resolve.first_wins(docs(spark, d).select("doc_id", X.content_sha("text").alias("sha")), ["sha"], ["doc_id"])


@query(
    f"""WITH {B.SYMBOLS}, keep AS (SELECT id, first_value(id) OVER (PARTITION BY kind, qualified_name ORDER BY seq) AS keeper FROM symbols),
e AS (SELECT 'QUERIES' AS type, 'part:' || l_partkey AS src, 'part:' || l_suppkey AS dst FROM lineitem)
SELECT DISTINCT type, a.keeper AS src, b.keeper AS dst, 'EXTRACTED' AS confidence FROM e JOIN keep a ON a.id = src JOIN keep b ON b.id = dst WHERE a.keeper <> b.keeper"""
)
def edge_remap(spark, d):
    e = B.table(spark, d, "lineitem").select(F.lit("QUERIES").alias("type"), B.node_id("part", "l_partkey").alias("src"), B.node_id("part", "l_suppkey").alias("dst"), F.lit("EXTRACTED").alias("confidence"))
    return resolve.remap(e, resolve.keepers(B.symbols(spark, d), ["kind", "qualified_name"], ["seq"]))


@query(f"WITH {B.EDGES} SELECT type, src, dst, confidence FROM edges WHERE src IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND dst IN (SELECT 'order:' || o_orderkey FROM orders)")
def endpoint_semi_join(spark, d):
    c = B.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(B.node_id("customer", "c_custkey").alias("id"))
    return resolve.with_endpoints(B.edges(spark, d), c.union(B.table(spark, d, "orders").select(B.node_id("order", "o_orderkey"))))


@query(
    f"""WITH {B.SYMBOLS}, r AS (SELECT DISTINCT p_name || '' AS ref FROM part UNION SELECT 'x.' || p_name FROM part UNION SELECT qualified_name FROM symbols)
SELECT ref, coalesce((SELECT max_by(id, seq) FROM symbols WHERE qualified_name = ref), (SELECT min_by(id, seq) FROM symbols WHERE name = regexp_extract(ref, '[^.]*$'))) AS dst FROM r"""
)
def table_refs(spark, d):
    s = B.symbols(spark, d)
    refs = s.select(F.col("name").alias("ref")).union(s.select(F.concat(F.lit("x."), "name"))).union(s.select("qualified_name")).distinct()
    return resolve.by_name_or_last(refs, s)


@query("SELECT relation, count(*) AS n FROM (SELECT 'page' AS relation, page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY relation")
def link_count(spark, d):
    return link_extract(spark, d).groupBy(F.lit("page").alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def link_extract(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT DISTINCT url, replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[.][^./]*$', ''), '/__init__$', ''), '/', '.') AS module FROM pages")
def module_names(spark, d):
    u = B.table(spark, d, "pages").select("url").distinct()
    return u.select("url", X.module_name(F.regexp_replace("url", "^[a-z]+://", "")).alias("module"))


@query("SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)\\b(create\\s+table|insert\\s+into|delete\\s+from|update\\s+\\w+\\s+set|select\\b[\\s\\S]*?\\bfrom)\\b')")
def sql_sniff_count(spark, d):
    from ..operators.extract.python_source import SQL_LIKE

    return docs(spark, d).where(F.col("text").rlike(SQL_LIKE)).agg(F.count(F.lit(1)).alias("n"))


# Deltas


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_sha(spark, d):
    return docs(spark, d).select("doc_id", X.content_sha("text").alias("sha"))


def _snapshots(spark, d):
    """The corpus before: without Spanish texts, and French ones cut; and now: without German ones."""
    t = docs(spark, d)
    was = t.where("lang <> 'es'").select("doc_id", "lang", F.when(F.col("lang") == "fr", F.substring("text", 1, 99)).otherwise(F.col("text")).alias("text"))
    return was, t.where("lang <> 'de'").select("doc_id", "lang", "text")


@query(
    """WITH was AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN left(text, 99) ELSE text END) AS sha FROM documents WHERE lang <> 'es'),
now AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE lang <> 'de')
SELECT doc_id::VARCHAR AS path, CASE WHEN was.sha IS NULL THEN 'added' WHEN now.sha IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM was FULL JOIN now USING (doc_id) WHERE was.sha IS DISTINCT FROM now.sha"""
)
def file_diff(spark, d):
    a, b = (x.select(F.col("doc_id").cast("string").alias("path"), X.content_sha("text").alias("sha")) for x in _snapshots(spark, d))
    return delta.diff_files(a, b)


@query(
    """WITH was AS (SELECT doc_id AS id, sha256(CASE WHEN lang = 'fr' THEN left(text, 99) ELSE text END) AS sha FROM documents WHERE lang <> 'es'),
now AS (SELECT doc_id AS id, sha256(text) AS sha FROM documents WHERE lang <> 'de')
SELECT id, CASE WHEN now.sha IS NULL THEN 'delete' WHEN was.sha IS NULL THEN 'create' ELSE 'keep' END AS action FROM was FULL JOIN now USING (id, sha)"""
)
def delta_keep_create_delete(spark, d):
    a, b = (x.select(F.col("doc_id").alias("id"), X.content_sha("text").alias("content_sha")) for x in _snapshots(spark, d))
    return delta.row_delta(a, b)


@query("SELECT doc_id AS id, sha256(text) AS embed_key, text IN (SELECT text FROM documents WHERE lang <> 'es') AS reused FROM documents")
def embed_cache_reuse(spark, d):
    cache = docs(spark, d).where("lang <> 'es'").select(X.content_sha("text").alias("embed_key"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    got = delta.reuse(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("embed_text")), cache, 1)
    return got.select("id", "embed_key", F.col("embedding").isNotNull().alias("reused"))


# Evaluation

SCORES = f"""{B.QUESTIONS}, {B.RANKINGS}, {B.GOLD}, h AS (SELECT question, min(rank) AS f, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10 FROM rankings JOIN gold USING (question, id) GROUP BY question),
scores AS (SELECT question, mode, CASE WHEN coalesce(h5, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS recall_at_5, CASE WHEN coalesce(h10, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS recall_at_10,
  coalesce(h5, 0) / 5 AS precision_at_5, coalesce(h10, 0) / 10 AS precision_at_10, coalesce(1 / f, 0)::DOUBLE AS reciprocal_rank FROM questions LEFT JOIN h USING (question))"""


def _scores(spark, d):
    return metrics.per_question(B.questions(spark, d), B.rankings(spark, d), B.gold(spark, d))


@query(f"WITH {SCORES} SELECT question, recall_at_5, recall_at_10, precision_at_5, precision_at_10, round(reciprocal_rank, 8) AS reciprocal_rank FROM scores")
def recall_mrr_precision(spark, d):
    return _scores(spark, d).withColumn("reciprocal_rank", F.round("reciprocal_rank", 8))


@query(f"WITH {SCORES} SELECT round(avg(recall_at_5), 3) AS recall_at_5, round(avg(recall_at_10), 3) AS recall_at_10, round(coalesce(avg(precision_at_5) FILTER (mode IN ('STRUCT', 'STRUCT+EXACT')), 0), 3) AS precision_at_5, round(avg(reciprocal_rank), 3) AS mrr FROM scores")
def metric_means(spark, d):
    return metrics.means(_scores(spark, d), B.questions(spark, d))


@query(f"WITH {SCORES} SELECT mode, count(*) AS n, round(avg(recall_at_10), 3) AS recall_at_10 FROM (SELECT unnest(string_split(mode, '+')) AS mode, recall_at_10 FROM scores) GROUP BY mode")
def per_mode_recall(spark, d):
    return metrics.per_mode(_scores(spark, d), B.questions(spark, d))


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'A'), g AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'F'),
f AS (SELECT src, count(*) AS found FROM e GROUP BY src), r AS (SELECT src, count(*) AS hit FROM e JOIN g USING (src, dst) GROUP BY src)
SELECT src, round(CASE WHEN found > 0 THEN coalesce(hit, 0) / found ELSE 0 END, 8) AS precision, round(coalesce(hit, 0) / count(*), 8) AS recall FROM g LEFT JOIN f USING (src) LEFT JOIN r USING (src) GROUP BY src, found, hit"""
)
def edge_precision(spark, d):
    li = B.table(spark, d, "lineitem")
    pair = lambda x: x.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    out = metrics.edge_precision(pair(li.where("l_returnflag = 'A'")), pair(li.where("l_linestatus = 'F'")))
    return out.select("src", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


# Intervals and baselines


@query(
    f"""WITH {B.TURN_SPANS}, p AS (SELECT DISTINCT conv_id::VARCHAR AS file, turn AS line FROM conversations)
SELECT file, line, id FROM p JOIN spans USING (file) WHERE line BETWEEN s AND e QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY (kind = 'module')::INT, e - s, id) = 1"""
)
def line_to_span(spark, d):
    points = B.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line"))
    return intervals.enclosing(points, B.turn_spans(spark, d))


CHUNKS = "c AS (SELECT DISTINCT conv_id || '@' || (turn // 2) AS chunk, conv_id::VARCHAR AS file, turn // 2 * 2 AS c0, turn // 2 * 2 + 2 AS c1 FROM conversations)"


def _chunks(spark, d):
    half = F.floor(F.col("turn") / 2)
    return B.table(spark, d, "conversations").select(
        F.concat_ws("@", F.col("conv_id").cast("string"), half.cast("string")).alias("chunk"), F.col("conv_id").cast("string").alias("file"), (half * 2).alias("start"), (half * 2 + 2).alias("end")
    ).distinct()


@query(f"WITH {B.TURN_SPANS}, {CHUNKS} SELECT DISTINCT chunk, id FROM c JOIN spans USING (file) WHERE s <= c1 AND e >= c0")
def chunk_overlap(spark, d):
    return intervals.overlapping(_chunks(spark, d), B.turn_spans(spark, d))


@query(f"WITH {B.TURN_SPANS}, {CHUNKS}, sc AS (SELECT conv_id || '@' || (turn // 2) AS chunk, max(length(text))::DOUBLE AS score FROM conversations GROUP BY 1) SELECT id, max(score) AS score FROM c JOIN spans USING (file) JOIN sc USING (chunk) WHERE s <= c1 AND e >= c0 GROUP BY id")
def rag_chunks_max(spark, d):
    chunk = F.concat_ws("@", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string"))
    scores = B.table(spark, d, "conversations").groupBy(chunk.alias("chunk")).agg(F.max(F.length("text")).cast("double").alias("score"))
    return intervals.best_chunk(scores, chunk_overlap(spark, d))


@query(
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
k AS (SELECT doc_id, ls, unnest(range(0, CASE WHEN len(ls) > 40 THEN ceil((len(ls) - 40) / 20)::BIGINT ELSE 0 END + 1)) AS k FROM p)
SELECT doc_id AS file, k * 20 + 1 AS start, least(len(ls), k * 20 + 40)::BIGINT AS "end", sha256(array_to_string(ls[k * 20 + 1:k * 20 + 40], chr(10))) AS sha FROM k"""
)
def line_chunks(spark, d):
    c = intervals.line_chunks(docs(spark, d).select(F.col("doc_id").alias("file"), "text"))
    return c.select("file", "start", "end", X.content_sha("text").alias("sha"))


@query(
    f"""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
n AS (SELECT file, max(line) AS n FROM l GROUP BY file),
hit AS (SELECT file, line, term FROM l, (SELECT unnest(['idiot', 'moron', 'worthless']) AS term) WHERE contains(lower(t), term)),
g AS (SELECT CASE WHEN line <= 3 THEN file || ':head' ELSE file || ':all' END AS id, term FROM hit)
SELECT id, count(DISTINCT term) AS n_terms, count(*) AS n_hits, row_number() OVER (ORDER BY count(DISTINCT term) DESC, count(*) DESC, id) AS rank FROM g GROUP BY id QUALIFY rank <= {TOP}"""
)
def grep_rank(spark, d):
    lines = docs(spark, d).select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    head = docs(spark, d).select(F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("start"), F.least(F.lit(3), F.size(F.split("text", "\n"))).alias("end"))
    whole = docs(spark, d).select(F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("start"), F.size(F.split("text", "\n")).alias("end"))
    spans = head.select("*", F.concat("file", F.lit(":head")).alias("id"), F.lit("function").alias("kind")).unionAll(whole.select("*", F.concat("file", F.lit(":all")).alias("id"), F.lit("module").alias("kind")))
    return intervals.grep_rank(lines, spans, ["idiot", "moron", "worthless"], TOP)


# Extraction and the whole build, over a small project in five languages


@query(f"SELECT * FROM (VALUES {samples.NODES}) AS t(lang, kind, qualified_name, start_line, end_line, signature, docstring)")
def extract_nodes(spark, d):
    rows = sources.extract(samples.files(spark)).where("tag = 'node'")
    line = lambda c: F.col(c).cast("int").alias(c)
    return rows.select("lang", "kind", "qualified_name", line("start_line"), line("end_line"), "signature", "docstring")


@query(f"SELECT * FROM (VALUES {samples.REFERENCES}) AS t(lang, tag, a, b, own)")
def extract_references(spark, d):
    rows = sources.extract(samples.files(spark)).where("tag in ('call', 'base', 'import', 'orm', 'fk', 'owns', 'attr', 'sql', 'warning')")
    local = lambda c: F.substring_index(c, "::", -1).alias(c)
    return rows.select("lang", "tag", local("a"), local("b"), F.when(F.col("tag") == "call", F.coalesce("flag", F.lit(False))).alias("own")).distinct()


def _sample_graph(spark) -> Graph:
    return build.from_rows(sources.extract(samples.files(spark)))


@query(f"SELECT * FROM (VALUES {samples.EDGES}) AS t(type, src, dst, confidence)")
def graph_build_edges(spark, d):
    g = _sample_graph(spark)
    name = lambda end: g.nodes.select(F.col("id").alias(end), F.col("qualified_name").alias(f"{end}_name"))
    return g.edges.join(name("src"), "src").join(name("dst"), "dst").select("type", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "confidence")


@query(f"SELECT * FROM (VALUES {samples.EXTERNALS}) AS t(id)")
def graph_build_externals(spark, d):
    return _sample_graph(spark).nodes.where("kind = 'external'").select("id")


# Lookups and the service's limits


def _texts(spark, d):
    return B.nodes(spark, d).select("*", F.concat_ws(" ", "kind", "name").alias("embed_text"), F.lit("").alias("docstring"))


@query(f"WITH {B.NODES} SELECT id, name || ' ' || qualified_name || ' ' || kind || ' ' || name || ' ' AS text FROM nodes")
def node_texts(spark, d):
    return _texts(spark, d).select("id", ranking.node_text().alias("text"))


@query(f"WITH {B.NODES} SELECT id FROM nodes WHERE kind = 'class'")
def ids_of_kind(spark, d):
    return B.nodes(spark, d).where("kind = 'class'").select("id")


@query(f"WITH {B.NODES} SELECT DISTINCT name, qualified_name FROM nodes")
def symbol_names(spark, d):
    return B.nodes(spark, d).where("kind <> 'external'").select("name", "qualified_name").distinct()


@query(f"WITH {B.NODES} SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY length(qualified_name), id) AS rank FROM nodes WHERE name = '1-URGENT' QUALIFY rank <= 25")
def resolve_capped(spark, d):
    """A name that many nodes have: the first 25 by length and id, and how many there are."""
    found = resolve.resolve_refs(B.nodes(spark, d), spark.createDataFrame([("1-URGENT",)], "ref string"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.where("rank <= 25").select("id", "rank").join(F.broadcast(total))  # one row


@query(
    f"""WITH {B.NODES}, l AS (SELECT lower(name) AS low, max(qualified_name) AS qualified_name FROM nodes GROUP BY 1)
SELECT low, qualified_name, levenshtein(low, 'customer#00000005') AS edits FROM l WHERE levenshtein(low, 'customer#00000005') <= 0.4 * (length(low) + 17)
QUALIFY row_number() OVER (ORDER BY levenshtein(low, 'customer#00000005') / (length(low) + 17), low) <= 20"""
)
def near_names(spark, d):
    return resolve.near_names(B.nodes(spark, d), "customer#00000005", 20).select("low", "qualified_name", F.col("edits").cast("bigint").alias("edits"))


@query(f"WITH {B.EDGES}, r AS (SELECT type AS relation, 'out' AS direction, dst AS id FROM edges WHERE src = 'nation:3' UNION SELECT type, 'in', src FROM edges WHERE dst = 'nation:3') SELECT *, count(*) OVER () AS total FROM r QUALIFY row_number() OVER (ORDER BY relation, direction DESC, id) <= 200")
def neighbors_capped(spark, d):
    """At most 200 neighbours in the service's order, and how many there are."""
    found = graph.relations(B.edges(spark, d), "nation:3").select("relation", "direction", "id").distinct()
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("relation", F.desc("direction"), "id").limit(200).join(F.broadcast(total))  # one row


@query(ORACLES["impact_data_to_code"].replace("SELECT id, id IN (SELECT id FROM direct) AS direct FROM up", "SELECT direct, count(*) AS n FROM (SELECT id, id IN (SELECT id FROM direct) AS direct FROM up) GROUP BY direct"))
def impact_totals(spark, d):
    return impact_data_to_code(spark, d).groupBy("direct").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT status, count(*) AS n FROM ({ORACLES['file_diff']}) GROUP BY status")
def update_counts(spark, d):
    return file_diff(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# The weight sweep's verdict: documents by length, by number and by text length, each source being a question of its language's corpus

SIGNAL_ORDERS = {"vector": "n_chars DESC, doc_id", "graph": "doc_id", "lexical": "doc_id DESC"}


def _swept(spark, d) -> DataFrame:
    import itertools

    from .. import evaluate

    configs = [evaluate.CURRENT, *itertools.product(*evaluate.GRID.values())]
    t = docs(spark, d)
    parts = None
    for name, order in SIGNAL_ORDERS.items():
        one = t.select(F.col("lang").alias("corpus"), F.concat_ws("/", "lang", "source").alias("question"), F.lit(name).alias("signal"), F.col("doc_id").alias("id"), F.expr(f"row_number() OVER (PARTITION BY lang, source ORDER BY {order})").cast("bigint").alias("rank")).where("rank <= 50")
        parts = one if parts is None else parts.unionByName(one)
    grid = [(n, s, float(c[k]), c[3], c[4]) for n, c in enumerate(configs) for k, s in enumerate(ranking.SIGNALS)] + [(-1, "vector", 1.0, 1, 10)]
    fused = ranking.sweep(parts.drop("corpus"), spark.createDataFrame(grid, "config long, signal string, weight double, rrf_k long, depth long"), 10)
    good = t.join(B.table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id").select(F.concat_ws("/", "lang", "source").alias("question"), F.col("doc_id").alias("id"))
    first = fused.join(good, ["question", "id"], "left_semi").groupBy("config", "question").agg(F.min("rank").alias("first"))
    questions = t.select(F.col("lang").alias("corpus"), F.concat_ws("/", "lang", "source").alias("question")).distinct()
    names = spark.createDataFrame([(n, *map(float, c[:3]), c[3], c[4]) for n, c in enumerate(configs)] + [(-1, 1.0, 0.0, 0.0, 1, 10)], "config long, w_vector double, w_graph double, w_lexical double, rrf_k long, depth long")
    every = questions.join(F.broadcast(names)).join(first, ["config", "question"], "left")  # the grid has 129 rows
    return every.groupBy("corpus", *names.columns).agg(F.avg((F.coalesce("first", F.lit(99)) <= 5).cast("double")).alias("recall_at_5"), F.avg(F.col("first").isNotNull().cast("double")).alias("recall_at_10"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def _swept_sql() -> str:
    import itertools

    from .. import evaluate

    configs = [evaluate.CURRENT, *itertools.product(*evaluate.GRID.values())]
    rows = ", ".join(f"({n}, '{s}', {float(c[k])}::DOUBLE, {c[3]}, {c[4]})" for n, c in enumerate(configs) for k, s in enumerate(ranking.SIGNALS))
    ranked = " UNION ALL ".join(f"SELECT lang AS corpus, lang || '/' || source AS question, '{n}' AS signal, doc_id AS id, row_number() OVER (PARTITION BY lang, source ORDER BY {o}) AS rank FROM documents" for n, o in SIGNAL_ORDERS.items())
    return f"""WITH grid(config, signal, weight, rrf_k, depth) AS (VALUES {rows}, (-1, 'vector', 1.0::DOUBLE, 1, 10)),
r AS (SELECT * FROM ({ranked}) WHERE rank <= 50),
f AS (SELECT config, question, id, sum(weight / (rrf_k + rank)) AS score FROM r JOIN grid USING (signal) WHERE rank <= depth GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY config, question ORDER BY round(score, 10) DESC, id) AS rank FROM f QUALIFY rank <= 10),
g AS (SELECT lang || '/' || source AS question, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
h AS (SELECT config, question, min(t.rank) AS first FROM t JOIN g USING (question, id) GROUP BY ALL),
q AS (SELECT DISTINCT lang AS corpus, lang || '/' || source AS question FROM documents),
s AS (SELECT corpus, c.config, avg((coalesce(first, 99) <= 5)::INT) AS r5, avg((first IS NOT NULL)::INT) AS r10, avg(coalesce(1.0::DOUBLE / first, 0)) AS m
  FROM q CROSS JOIN (SELECT DISTINCT config FROM grid) c LEFT JOIN h ON h.config = c.config AND h.question = q.question GROUP BY ALL),
d AS (SELECT s.*, s.r5 - b.r5 AS g5, s.m - b.m AS gm FROM s JOIN s b ON b.corpus = s.corpus AND b.config = -1 WHERE s.config >= 0),
e AS (SELECT *, sum(g5) OVER w - g5 AS rest5, sum(gm) OVER w - gm AS restm FROM d WINDOW w AS (PARTITION BY config))
SELECT config, round(avg(r5) + 1e-9, 6) AS recall_at_5, round(avg(r10) + 1e-9, 6) AS recall_at_10, round(avg(m) + 1e-9, 6) AS mrr, count(*) FILTER (g5 >= -1e-12 AND gm >= -1e-12) AS wins,
  avg(g5) >= -1e-12 AND avg(gm) >= -1e-12 AS qualifies, avg(g5) >= -1e-12 AND avg(gm) >= -1e-12 AND bool_and(rest5 >= -1e-12 AND restm >= -1e-12) AS stable FROM e GROUP BY config"""


@query(_swept_sql())
def sweep_summary(spark, d):
    from .. import evaluate

    out = evaluate.summary(_swept(spark, d))
    return out.select("config", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")], "wins", "qualifies", "stable")
