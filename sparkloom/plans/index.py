"""Indexing and updating a stored graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedders import Embedder, get_embedder
from ..functions.text import content_sha
from ..functions.vectors import dense
from ..operators import delta
from ..schema import EDGES, FILES, NODES, Graph
from ..sources import files as S
from ..sources.store import Store
from ..storage import cut
from . import build


@dataclass
class Report:
    status: str
    nodes: int = 0
    reused: int = 0
    computed: int = 0
    added: int = 0
    changed: int = 0
    deleted: int = 0
    kept: int = 0
    created: int = 0
    removed: int = 0


def embed(nodes: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """nodes with embedding; how many came from the cache (embed_key, embedding), and how many were computed."""
    dim = embedder.dim if embedder.dim_is_exact else None
    if cache is None:
        cache = nodes.sparkSession.createDataFrame([], "embed_key string, embedding array<float>")
    got = cut(delta.reuse(nodes.select("id", "embed_text"), cache, dim), "cached")
    # equal texts are computed once
    missing = got.where("embedding is null").groupBy("embed_key").agg(F.first("embed_text").alias("text"))
    made = cut(embedder.embed(missing.withColumnRenamed("embed_key", "id")).select(F.col("id").alias("embed_key"), F.col("embedding").alias("made")), "embedded")
    full = got.join(made, "embed_key", "left").select("id", F.coalesce("embedding", "made").alias("embedding"))
    n = got.agg(F.sum(F.col("embedding").isNotNull().cast("bigint")).alias("old"), F.count(F.lit(1)).alias("all")).first()
    width = embedder.dim or 1
    zero = dense(F.create_map().cast("map<int,double>"), width)
    return nodes.join(full, "id", "left").withColumn("embedding", F.coalesce("embedding", zero)), n["old"] or 0, n["all"] - (n["old"] or 0)


def cache_of(nodes: DataFrame) -> DataFrame:
    """The stored vectors by the digest of their texts: the cache of the next run."""
    return nodes.groupBy(content_sha("embed_text").alias("embed_key")).agg(F.first("embedding").alias("embedding"))


def _meta(embedder: Embedder, root: str) -> dict[str, str]:
    return {"embedder": embedder.name, "dim": str(embedder.dim), "source": root}


def _write(store: Store, graph: Graph, embedder: Embedder, root: str, files: DataFrame, cache: DataFrame | None, rows: DataFrame) -> tuple[int, int]:
    nodes, reused, computed = embed(graph.nodes, embedder, cache)
    store.write(Graph(nodes.select(*[F.coalesce(f.name, F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in NODES.fields]), graph.edges), _meta(embedder, root), files, rows)
    return reused, computed


def index(spark: SparkSession, path: str, db: str, embedder: Embedder | None = None, overwrite: bool = False, use_cache: bool = True) -> Report:
    """Digests are taken with the contents that are parsed, so a file that changes meanwhile is seen by the next update."""
    embedder = embedder or get_embedder()
    store = Store(spark, db)
    cache = cut(cache_of(store.open().nodes), "cache") if use_cache and overwrite and store.exists() else None
    store.create(overwrite)
    files = cut(S.scan(spark, path), "files")
    rows = cut(S.extract(files), "extracted")
    reused, computed = _write(store, build.from_rows(rows), embedder, path, S.digests(files), cache, rows)
    return Report("indexed", reused + computed, reused, computed)


def update(spark: SparkSession, path: str, db: str, embedder: Embedder | None = None) -> Report:
    """indexed (nothing was stored), up-to-date, rebuilt (another embedder or width) or updated. A plain update keeps
    the embedder that the store names. A source path that is missing raises.

    Only added and changed files are parsed: what was extracted from the others is stored, and joined with it anew.
    """
    store = Store(spark, db)
    files = cut(S.scan(spark, path), "files")
    if not store.exists():
        return index(spark, path, db, embedder)
    old, meta = store.open(), store.meta()
    embedder = embedder or get_embedder(meta["embedder"])
    same = embedder.name == meta["embedder"] and str(embedder.dim) == meta["dim"]
    diff = cut(delta.diff_files(store.files(), S.digests(files)), "diff")
    changes = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
    counts = {k: changes.get(k, 0) for k in ("added", "changed", "deleted")}
    if same and not changes:
        return Report("up-to-date", old.nodes.count())
    if not files.limit(1).count():
        store.write(Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)), _meta(embedder, path), spark.createDataFrame([], FILES))
        return Report("updated", **counts, removed=0)
    rows = _rows(store, files, diff)
    graph = build.from_rows(rows)
    if not same:
        reused, computed = _write(store, graph, embedder, path, S.digests(files), None, rows)
        return Report("rebuilt", reused + computed, reused, computed, **counts)
    # counted before the old version goes
    moved = {r["action"]: r["count"] for r in delta.row_delta(old.nodes, graph.nodes).groupBy("action").count().collect()}
    cache = cut(cache_of(old.nodes), "cache")
    reused, computed = _write(store, graph, embedder, path, S.digests(files), cache, rows)
    return Report("updated", reused + computed, reused, computed, **counts, kept=moved.get("keep", 0), created=moved.get("create", 0), removed=moved.get("delete", 0))


def _rows(store: Store, files: DataFrame, diff: DataFrame) -> DataFrame:
    """Rows of all files: stored ones of files that are as they were, and new ones of the others."""
    held = store.rows()
    if held is None:
        return cut(S.extract(files), "extracted")
    new = S.extract(files.join(diff.where("status in ('added', 'changed')").select("path"), "path", "left_semi"))
    kept = held.join(diff.select(F.col("path").alias("file")), "file", "left_anti")
    return cut(kept.select(*new.columns).unionByName(new), "extracted")
