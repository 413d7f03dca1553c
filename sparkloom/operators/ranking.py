"""Ranked retrieval: BM25, cosine, fusion and reranking. A ranking is (id, score, rank), best first, ties by id."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..storage import cut

K1, B = 1.5, 0.75
RRF_K, DEPTH, POOL = 10, 50, 20
RERANK_RRF_K = 60
#: Order of the signals in a hybrid ranking, and their weights.
SIGNALS = ("vector", "graph", "lexical")
WEIGHTS = (3.0, 0.5, 0.5)


def query_tokens(query: str) -> list[str]:
    """The distinct tokens of a query, by the rule of functions.text.tokenize."""
    return sorted({t.lower() for t in re.findall(X.TOKEN, query)})


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of (id, score), with rank from 1."""
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint").alias("rank"))


def node_text() -> Column:
    return F.concat_ws(" ", "name", "qualified_name", "embed_text", "docstring")


class LexicalIndex:
    """BM25 over documents (id, text). Counts of a query's terms are taken in each row, so scoring needs no shuffle;
    corpus statistics are one row a query, of two numbers and one for each term. Texts are tokenized once a query: the
    counts of the rows that have a term are written to the shared folder."""

    def __init__(self, docs: DataFrame, id_: str = "id", text: str | Column = "text"):
        tokens = X.tokenize(text)
        self.docs = docs.select(F.col(id_).alias("id"), tokens.alias("tokens"))

    def terms(self) -> DataFrame:
        """The inverted index (id, term, tf)."""
        return self.docs.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))

    def document_frequency(self) -> DataFrame:
        return self.docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def statistics(self) -> DataFrame:
        """n_docs, total_tokens, avg_tokens, n_terms."""
        one = self.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("tokens").cast("bigint")).alias("total_tokens"))
        return one.crossJoin(self.document_frequency().agg(F.count(F.lit(1)).alias("n_terms"))).withColumn("avg_tokens", F.col("total_tokens") / F.col("n_docs"))

    def score(self, query: str) -> DataFrame:
        """(id, score) of all documents with a term of the query."""
        terms = query_tokens(query)
        spark = self.docs.sparkSession
        if not terms:
            return spark.createDataFrame([], f"id {self.docs.schema['id'].dataType.simpleString()}, score double")
        hits = lambda ts: F.filter(ts, lambda x: x.isin(terms))
        # the generator keeps the tokens of a row one expression: no filter is pushed below it, where it would tokenize again
        once = F.inline(F.transform(F.array("tokens"), lambda ts: F.struct(F.size(ts).alias("len"), hits(ts).alias("hits"))))
        rows = self.docs.select("id", once)
        count = lambda term: F.size(F.filter("hits", lambda x: x == term))
        each = [count(t).alias(f"f{i}") for i, t in enumerate(terms)]
        held = cut(rows.select("id", "len", *each), "bm25")
        stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"f{i}") > 0).cast("bigint")).alias(f"d{i}") for i in range(len(terms))]).first()
        n, avg = max(1, stats["n"]), stats["avg"] or 1.0
        score = F.lit(0.0)
        for i in range(len(terms)):
            df = stats[f"d{i}"] or 0
            if df:
                idf, f = math.log(1 + (n - df + 0.5) / (df + 0.5)), F.col(f"f{i}")
                score = score + F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.greatest(F.col("len"), F.lit(1)) / avg))
        # f = 0 adds nothing, as the numerator is 0
        return held.select("id", score.alias("score")).where("score > 0")

    def rank(self, query: str, k: int = 10) -> DataFrame:
        return top(self.score(query), k)


def cosine_rank(vectors: DataFrame, query: Sequence[float], k: int = 10, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to query by cosine, without a threshold: k rows come even at a score of 0 or less."""
    return top(cosine_scores(vectors, query, id_, vector), k)


def cosine_scores(vectors: DataFrame, query: Sequence[float], id_: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, score) of all rows."""
    q = [float(x) for x in query]
    length = math.sqrt(sum(x * x for x in q))
    # the literal is one constant of the plan, not an array built for each row
    product = F.aggregate(F.zip_with(F.col(vector), V.literal_vector(q), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    bottom = V.norm(F.col(vector)) * F.lit(length)
    return vectors.select(F.col(id_).alias("id"), (product / F.when(bottom == 0, 1e-9).otherwise(bottom)).alias("score"))


def check_width(vectors: DataFrame, expected: int, vector: str = "embedding") -> DataFrame:
    """Rows by whether their width is the index's: (width, n_rows, fits)."""
    return vectors.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("fits", F.col("width") == expected)


def hash_embedding_scores(docs: DataFrame, query: str, dim: int, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, score): cosine of hash embeddings, from the slots of the query only; rows that share none score 0."""
    spark = docs.sparkSession
    q = spark.createDataFrame([(0, query)], "id int, text string").select("id", X.tokenize("text").alias("tokens"))
    own = {r["slot"]: r["w"] for r in V.hash_embed(q, "id", dim).select(F.explode("slots").alias("slot", "w")).collect()}
    each = docs.select(F.col(id_).alias("id"), F.explode_outer(X.tokenize(text)).alias("t"))
    slots = each.groupBy("id", V.hash_slot(F.col("t"), dim).alias("slot")).agg(F.sum(V.hash_sign(F.col("t"))).alias("w"))
    weights = F.create_map(*[F.lit(x) for kv in own.items() for x in kv]) if own else F.create_map().cast("map<int,double>")
    part = F.coalesce(F.col("w") * F.coalesce(F.element_at(weights, F.coalesce("slot", F.lit(-1))), F.lit(0.0)), F.lit(0.0))
    return slots.groupBy("id").agg(F.sum(part).alias("dot"), F.sqrt(F.sum(F.coalesce("w", F.lit(0.0)) * F.coalesce("w", F.lit(0.0)))).alias("len")).select("id", (F.col("dot") / F.when(F.col("len") == 0, 1e-9).otherwise(F.col("len"))).alias("score"))


def rrf(rankings: Sequence[DataFrame], k: int = 10, rrf_k: int = RERANK_RRF_K, weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of rankings (id, rank)."""
    weights = [1.0] * len(rankings) if weights is None else list(weights)
    if len(weights) != len(rankings):
        raise ValueError(f"{len(rankings)} rankings but {len(weights)} weights")
    parts = [r.select("id", (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("s")) for r, w in zip(rankings, weights, strict=True) if w]
    if not parts:
        return rankings[0].select("id", F.lit(0.0).alias("score"), "rank").limit(0)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top(both.groupBy("id").agg(F.sum("s").alias("score")), k)


def hybrid(signals: Mapping[str, DataFrame], k: int = 10, rrf_k: int = RRF_K, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """signals: rankings of depth max(k, 50) by name; absent ones weigh nothing."""
    there = [(signals[n], w) for n, w in zip(SIGNALS, weights, strict=True) if n in signals]
    return rrf([r for r, _ in there], k, rrf_k, [w for _, w in there])


def lexical_rerank(pool: DataFrame, texts: DataFrame, query: str) -> DataFrame:
    """The pool (id, rank) by the number of distinct query tokens in its texts (id, text), then by rank before."""
    q = F.array(*[F.lit(t) for t in query_tokens(query)]).cast("array<string>")
    shared = F.size(F.array_intersect(X.tokenize("text"), q))
    both = pool.join(texts.select("id", "text"), "id").select("id", shared.alias("shared"), F.col("rank").alias("before"))
    return both.select("id", F.col("shared").cast("double").alias("score"), F.row_number().over(Window.orderBy(F.desc("shared"), "before")).cast("bigint").alias("rank"))


def reranked(fused: DataFrame, texts: DataFrame, query: str, k: int = 10, pool: int = POOL, rrf_k: int = RERANK_RRF_K) -> DataFrame:
    """Fused order and reranked order of the pool, blended with equal weights."""
    head = fused.where(F.col("rank") <= max(pool, k))
    return rrf([lexical_rerank(head, texts, query), head], k, rrf_k)


def sweep(rankings: DataFrame, grid: DataFrame, k: int = 10) -> DataFrame:
    """Every configuration (config, signal, weight, rrf_k, and depth if there is one) over rankings (question, signal,
    id, rank): (config, question, id, score, rank). One join and one aggregation for the whole grid."""
    deep = F.col("rank") <= F.col("depth") if "depth" in grid.columns else F.lit(True)
    scored = rankings.join(F.broadcast(grid), "signal").where(deep).where("weight <> 0").groupBy("config", "question", "id").agg(F.sum(F.col("weight") / (F.col("rrf_k") + F.col("rank"))).alias("score"))
    w = Window.partitionBy("config", "question").orderBy(F.desc(F.round("score", 10)), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
