"""The query service over a stored graph: ranked and structural queries, as Python values of bounded size."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedders import Embedder, get_embedder
from ..operators import graph as G
from ..operators import impact as I
from ..operators import ranking as R
from ..operators import resolve
from ..operators.rerank import get_reranker
from ..schema import DATA_KINDS, EDGE_TYPES
from ..sources.store import Store

MODES = ("hybrid", "vector", "lexical", "graph", "rerank")
MOST_HITS, MOST_MATCHES, MOST_NEIGHBORS, DOC, NEAR_NAMES = 100, 25, 200, 500, 500
SHOWN = ("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "signature")


class UnknownRef(KeyError):
    """A reference that no node answers to; args hold the message and suggestions."""


class GraphService:
    def __init__(self, spark: SparkSession, db: str, embedder: Embedder | None = None, reranker=None):
        self.spark, self.store = spark, Store(spark, db)
        self.graph = self.store.open()
        meta = self.store.meta()
        self.embedder = embedder or get_embedder(meta["embedder"])
        self.dim = int(meta["dim"])
        if self.embedder.dim_is_exact and self.embedder.dim != self.dim:
            raise ValueError(f"the embedder gives {self.embedder.dim} numbers, the index has {self.dim}; index again or leave the embedder out")
        self.reranker = get_reranker(reranker) if isinstance(reranker, str) else reranker
        self.docs = self.graph.nodes.where("kind <> 'external'").cache()
        self.lexical_index = R.LexicalIndex(self.docs.withColumn("__text", R.node_text()), "id", "__text")

    def close(self) -> None:
        self.docs.unpersist()

    # ranked queries

    def _vector(self, text: str, k: int) -> DataFrame:
        one = self.spark.createDataFrame([("q", text)], "id string, text string")
        q = self.embedder.embed(one).first()["embedding"]
        if len(q) != self.dim:
            raise ValueError(f"the query has {len(q)} numbers, the index {self.dim}")
        return R.cosine_rank(self.docs, q, k)

    def _graph(self, text: str, k: int) -> DataFrame:
        seeds = self.lexical_index.rank(text, 8).select("id", F.col("score").alias("weight"))
        return R.top(G.pagerank(self.graph.edges, self.docs, seeds), k)

    def ranking(self, text: str, mode: str = "hybrid", k: int = 10) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {list(MODES)}, not {mode!r}")
        if mode == "lexical":
            return self.lexical_index.rank(text, k)
        if mode == "vector":
            return self._vector(text, k)
        if mode == "graph":
            return self._graph(text, k)
        depth = max(k, R.DEPTH)
        signals = {"vector": self._vector(text, depth), "graph": self._graph(text, depth), "lexical": self.lexical_index.rank(text, depth)}
        if mode == "hybrid" or self.reranker is None:
            return R.hybrid(signals, k)
        pool = R.hybrid(signals, max(R.POOL, k))
        rows = pool.join(self.docs.select("id", "embed_text"), "id").orderBy("rank").collect()  # at most 100
        order = self.reranker.rerank(text, [(r["id"], r["embed_text"]) for r in rows])
        again = self.spark.createDataFrame([(i, n) for n, i in enumerate(order, 1)], "id string, rank bigint")
        return R.rrf([again, pool], k)

    def query(self, text: str, mode: str = "hybrid", k: int = 10) -> list[dict]:
        k = max(1, min(MOST_HITS, k))
        top = self.ranking(text, mode, k)
        rows = self.docs.join(F.broadcast(top), "id").orderBy("rank").select(*SHOWN, F.substring("docstring", 1, DOC).alias("docstring"), F.round("score", 4).alias("score"))
        return [r.asDict() for r in rows.collect()]

    def semantic_search(self, text: str, k: int = 10) -> list[dict]:
        return self.query(text, "vector", k)

    # references

    def _ids(self, ref: str) -> list[str]:
        refs = self.spark.createDataFrame([(ref,)], "ref string")
        return [r["id"] for r in resolve.resolve_refs(self.graph.nodes, refs).orderBy("rank").select("id").limit(MOST_MATCHES + 1).collect()]

    def suggest(self, ref: str, limit: int = 5) -> list[str]:
        """Qualified names whose last part is close to the reference's, else those that contain that part.

        A name can only be close if so many edits change one into the other as two fifths of both lengths; the nearest
        NEAR_NAMES of those are compared here.
        """
        last = ref.rsplit(".", 1)[-1].lower()
        by_low = {r["low"]: r["qualified_name"] for r in resolve.near_names(self.docs, last, NEAR_NAMES).collect()}
        close = difflib.get_close_matches(last, list(by_low), limit, 0.6)
        if close:
            return [by_low[c] for c in close]
        found = self.docs.where(F.contains(F.lower("qualified_name"), F.lit(last))).orderBy("qualified_name").limit(limit)
        return [r["qualified_name"] for r in found.collect()]

    def _one(self, ref: str) -> str:
        ids = self._ids(ref)
        if not ids:
            hints = self.suggest(ref)
            raise UnknownRef(f"no node {ref!r}" + (f"; did you mean {', '.join(hints)}?" if hints else ""), hints)
        return ids[0]

    def _nodes(self, ids: list[str]) -> list[dict]:
        """Rows of ids, in their order; ids are bounded by the callers."""
        found = {r["id"]: r.asDict() for r in self.graph.nodes.where(F.col("id").isin(ids)).select(*SHOWN, F.substring("docstring", 1, DOC).alias("docstring")).collect()} if ids else {}
        return [found[i] for i in ids if i in found]

    def get_node(self, ref: str, strict: bool = False) -> dict | None:
        try:
            return self._nodes([self._one(ref)])[0]
        except UnknownRef:
            if strict:
                raise
            return None

    def resolve(self, ref: str) -> list[dict]:
        ids = self._ids(ref)
        out = self._nodes(ids[:MOST_MATCHES])
        return self._capped(out, len(ids), "use a longer dotted name")

    @staticmethod
    def _capped(out: list[dict], total: int, hint: str) -> list[dict]:
        return [*out, {"truncated": True, "total": total, "note": f"{len(out)} of {total} shown; {hint}"}] if total > len(out) else out

    # structure

    def neighbors(self, ref: str, direction: str = "both", relation: str | None = None, hops: int = 1) -> list[dict]:
        """Filters hold for one hop; further ones go over all edges both ways."""
        if direction not in ("in", "out", "both"):
            raise ValueError(f"direction must be in, out or both, not {direction!r}")
        if relation and relation not in EDGE_TYPES:
            raise ValueError(f"unknown relation {relation!r}; there are {sorted(EDGE_TYPES)}")
        node, asked = self._one(ref), hops
        hops = max(1, min(G.MAX_HOPS, hops))
        if hops == 1:
            rel = G.relations(self.graph.edges, node, direction, [relation] if relation else None)
            rows = rel.join(self.graph.nodes.select(*SHOWN), "id").orderBy("relation", F.desc("direction"), "id")
        else:
            rows = G.neighbors(self.graph.edges, node, hops).join(self.graph.nodes.select(*SHOWN), "id").orderBy("hop", "id")
        total = rows.count()
        out = self._capped([r.asDict() for r in rows.limit(MOST_NEIGHBORS).collect()], total, "narrow the relation or direction")
        return [*out, {"note": f"hops limited from {asked} to {hops}"}] if asked != hops else out

    def calls(self, ref: str) -> list[dict]:
        return self.neighbors(ref, "out", "CALLS")

    def callers(self, ref: str) -> list[dict]:
        return self.neighbors(ref, "in", "CALLS")

    def shortest_path(self, src: str, dst: str) -> list[dict]:
        path = G.shortest_path(self.graph.edges, self._one(src), self._one(dst)).orderBy("step").collect()
        return self._nodes([r["id"] for r in path])

    def impact(self, ref: str, max_results: int = 50) -> dict | None:
        ids = self._ids(ref)
        if not ids:
            return None
        node = self._nodes(ids[:1])[0]
        start = self.spark.createDataFrame([(node["id"],)], "id string")
        towards_code = node["kind"] in DATA_KINDS
        found = (I.data_to_code if towards_code else I.code_to_data)(self.graph, start)
        found = found.join(self.graph.nodes.select("id"), "id", "left_semi").cache()
        try:
            n = {r["direct"]: r["count"] for r in found.groupBy("direct").count().collect()}
            first = lambda d: self._nodes([r["id"] for r in found.where(F.col("direct") == d).orderBy("id").limit(max_results).collect()])
            direct, rest = first(True), first(False)
        finally:
            found.unpersist()
        names = ("direct_code", "transitive_callers", "total_code_paths") if towards_code else ("direct_data", "transitive_data", "total_data_touched")
        return {
            "target": node,
            "direction": "data->code" if towards_code else "code->data",
            names[0]: direct,
            names[1]: rest,
            names[2]: sum(n.values()),
            "truncated": max(n.values(), default=0) > max_results,
            "completeness": I.completeness(towards_code),
        }

    def stats(self) -> dict[str, int]:
        kinds = {r["kind"]: r["n"] for r in G.node_counts(self.graph.nodes).collect()}
        return kinds | {r["type"]: r["n"] for r in G.edge_counts(self.graph.edges).collect()}
