"""The stored graph: versioned folders of tables under one root, and pointers, of which the newest holds.

    root/GRAPH                what makes a folder ours; without it nothing is overwritten
    root/CURRENT-<number>     the name of a version; readers take the greatest number
    root/v-<id>/nodes, edges (one folder a type), files, rows (what was extracted from each file), META-<number> (JSON)

A pointer is written beside and renamed to a name that is not there yet, and nothing that readers use is deleted
before: a writer that dies at any point leaves the last whole version in force.
"""

from __future__ import annotations

import json
import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import with_endpoints
from ..schema import EDGES, FILES, NODES, SCHEMA_VERSION, Graph, SchemaError, validate
from ..storage import cut


class StoreError(RuntimeError):
    """The stored graph is missing, of another version, or incomplete."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files by Spark's own file system, so that any path Spark reads will do

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _has(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, folder: str, start: str) -> list[str]:
        fs, p = self._fs(folder)
        if not fs.exists(p):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith(start))

    def _put(self, path: str, text: str) -> None:
        """Written beside and renamed: there whole or not at all; a name that exists is never replaced."""
        fs, new = self._fs(f"{self.root}/.new-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, there = self._fs(path)
        if fs.exists(there) or not fs.rename(new, there):
            fs.delete(new, False)
            raise StoreError(f"{path} is there already: another writer was faster")

    def _get(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path).collect())

    def _put_next(self, folder: str, name: str, text: str) -> None:
        """Under the next number; the one before stays for readers that have it open."""
        there = self._names(folder, f"{name}-")
        number = int(there[-1].rsplit("-", 1)[1]) + 1 if there else 1
        self._put(f"{folder}/{name}-{number:012d}", text)
        for old in there[:-1]:
            fs, p = self._fs(f"{folder}/{old}")
            fs.delete(p, False)

    def _get_last(self, folder: str, name: str) -> str | None:
        there = self._names(folder, f"{name}-")
        return self._get(f"{folder}/{there[-1]}") if there else None

    def current(self) -> str | None:
        return self._get_last(self.root, "CURRENT")

    def exists(self) -> bool:
        return self.current() is not None

    def create(self, overwrite: bool = False) -> None:
        fs, p = self._fs(self.root)
        if fs.exists(p) and not self._has(f"{self.root}/GRAPH"):
            if len(fs.listStatus(p)):
                raise StoreError(f"{self.root} is not a stored graph; it is left alone")
        elif self.exists() and not overwrite:
            raise StoreError(f"{self.root} exists; say overwrite to replace it")
        fs.mkdirs(p)
        if not self._has(f"{self.root}/GRAPH"):
            self._put(f"{self.root}/GRAPH", SCHEMA_VERSION)

    def write(self, graph: Graph, meta: dict[str, str], files: DataFrame, rows: DataFrame | None = None) -> None:
        """A new version: edges without both ends are left out; the pointer moves last."""
        if not self._has(f"{self.root}/GRAPH"):
            self.create()
        version = f"v-{uuid.uuid4().hex[:12]}"
        at = f"{self.root}/{version}"
        validate(graph.nodes, NODES, "nodes").write.parquet(f"{at}/nodes")
        nodes = self.spark.read.schema(NODES).parquet(f"{at}/nodes")
        with_endpoints(validate(graph.edges, EDGES, "edges"), nodes).write.partitionBy("type").parquet(f"{at}/edges")
        types = [x.removeprefix("type=") for x in self._names(f"{at}/edges", "type=")]
        validate(files, FILES, "files").write.parquet(f"{at}/files")
        if rows is not None:
            rows.write.parquet(f"{at}/rows")
        self._put_next(at, "META", json.dumps(meta | {"schema_version": SCHEMA_VERSION, "edge_types": ",".join(types)}))
        before = self.current()
        self._put_next(self.root, "CURRENT", version)
        # the version before stays for readers that have it open
        for name in self._names(self.root, "v-"):
            if name not in (version, before):
                fs, p = self._fs(f"{self.root}/{name}")
                fs.delete(p, True)

    def _version(self) -> str:
        version = self.current()
        if version is None:
            raise StoreError(f"no graph at {self.root}; index a path first")
        return f"{self.root}/{version}"

    def open(self) -> Graph:
        """The current version, after its gate: its tables are there, of this version of the schema, with all columns.

        Only edge tables may be missing: they are written down as empty, with a warning.
        """
        at = self._version()
        missing = [t for t in ("nodes", "files") if not self._has(f"{at}/{t}")]
        if missing:
            raise StoreError(f"the graph at {self.root} has no {' and no '.join(missing)}; index again")
        meta = self.meta()
        if meta.get("schema_version") != SCHEMA_VERSION:
            raise StoreError(f"the graph at {self.root} has schema version {meta.get('schema_version')}, this library {SCHEMA_VERSION}; index again")
        types = [t for t in meta.get("edge_types", "").split(",") if t]
        lost = [t for t in types if not self._has(f"{at}/edges/type={t}")]
        if lost:
            warnings.warn(f"the graph at {self.root} has lost its edges {', '.join(lost)}; they are empty until it is indexed again", stacklevel=2)
            self.put_meta("edge_types", ",".join(t for t in types if t not in lost))
        try:
            validate(self.spark.read.parquet(f"{at}/nodes"), NODES, "nodes")
        except (AnalysisException, SchemaError) as e:
            raise StoreError(f"the graph at {self.root} is incomplete ({e}); index again") from e
        return Graph(self.spark.read.schema(NODES).parquet(f"{at}/nodes"), self._edges(at))

    def _edges(self, at: str) -> DataFrame:
        there = self._names(f"{at}/edges", "type=")
        edges = self.spark.read.schema(EDGES).parquet(f"{at}/edges") if there else self.spark.createDataFrame([], EDGES)
        return edges.select("type", "src", "dst", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), "resolver")

    # meta

    def meta(self) -> dict[str, str]:
        return json.loads(self._get_last(self._version(), "META") or "{}")

    def put_meta(self, key: str, value: str) -> None:
        self._put_next(self._version(), "META", json.dumps(self.meta() | {key: value}))

    def delete_meta(self, key: str) -> None:
        self._put_next(self._version(), "META", json.dumps({k: v for k, v in self.meta().items() if k != key}))

    def files(self) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self._version()}/files")

    def rows(self) -> DataFrame | None:
        """What was extracted from each file, if the version has it."""
        at = f"{self._version()}/rows"
        return self.spark.read.parquet(at) if self._has(at) else None

    def tables(self) -> DataFrame:
        """table, column, type of all tables of the current version."""
        graph = self.open()
        found = [("nodes", graph.nodes), ("edges", graph.edges), ("files", self.files())]
        return self.spark.createDataFrame([(name, c, kind) for name, df in found for c, kind in df.dtypes], "table string, column string, type string")

    # changes: each is a new version, but for new edges, which are added to the tables of the current one

    def _rewrite(self, nodes: DataFrame, edges: DataFrame) -> None:
        meta = {k: v for k, v in self.meta().items() if k not in ("schema_version", "edge_types")}
        self.write(Graph(nodes, edges), meta, self.files(), self.rows())

    def add_edges(self, edges: DataFrame) -> int:
        """Edges whose ends are nodes and which are not there yet; how many those are."""
        graph, at = self.open(), self._version()
        keys = ["type", "src", "dst"]
        new = with_endpoints(validate(edges, EDGES, "edges"), graph.nodes).dropDuplicates(keys).join(graph.edges.select(*keys), keys, "left_anti")
        new = cut(new, "new-edges")
        types = sorted({r["type"] for r in new.select("type").distinct().collect()})
        if types:
            new.write.mode("append").partitionBy("type").parquet(f"{at}/edges")
            known = {t for t in self.meta().get("edge_types", "").split(",") if t}
            self.put_meta("edge_types", ",".join(sorted(known | set(types))))
        return new.count()

    def delete_edges(self, edges: DataFrame) -> None:
        """Edges of (type, src, dst) go."""
        graph = self.open()
        self._rewrite(graph.nodes, graph.edges.join(edges.select("type", "src", "dst"), ["type", "src", "dst"], "left_anti"))

    def delete_nodes(self, ids: DataFrame) -> None:
        """Nodes of (id) go, and the edges at them."""
        graph = self.open()
        self._rewrite(graph.nodes.join(ids.select("id"), "id", "left_anti"), graph.edges)

    def set_embeddings(self, vectors: DataFrame) -> None:
        """Vectors of (id, embedding) replace those of these nodes; widths must be the index's."""
        graph = self.open()
        dim = int(self.meta()["dim"])
        if vectors.where(F.size("embedding") != dim).limit(1).count():
            raise ValueError(f"all vectors must have {dim} numbers")
        new = vectors.select("id", F.col("embedding").cast("array<float>").alias("__new"))
        both = graph.nodes.join(new, "id", "left").withColumn("embedding", F.coalesce("__new", "embedding"))
        self._rewrite(both.select(*[f.name for f in NODES.fields]), graph.edges)
