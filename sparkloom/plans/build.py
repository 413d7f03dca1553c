"""From files to a graph: extraction, resolution within each language, and the bridge between code and tables."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve
from ..schema import EXTRACTED, INFERRED, Graph
from ..sources import files as S
from ..storage import cut

# The kinds that names refer to in each language.
CALLABLE = {"python": ("function", "method", "class"), "java": ("method", "class", "interface"), "go": ("function", "method", "class", "interface"), "ts": ("function", "method", "class", "interface")}
BASES = {"python": ("class",), "java": ("class", "interface"), "go": ("class", "interface"), "ts": ("class", "interface")}
NODE = ("id", "kind", "name", "qualified_name", "module", "file_path", "start_line", "end_line", "signature", "docstring", "code", "embed_text", "content_sha")
RESOLVER = "names"


def _edges(df: DataFrame, kind: str, src: str, dst: str, confidence) -> DataFrame:
    conf = F.lit(confidence) if isinstance(confidence, str) else confidence
    return df.select(F.lit(kind).alias("type"), F.col(src).alias("src"), F.col(dst).alias("dst"), conf.alias("confidence"))


def _place(lang_no: Column, ord_: str, file: str, seq: str) -> Column:
    """Where a row stands in the order of languages, suffixes, files and what comes first in them: a key to compare by,
    so that no task has to number all rows."""
    return F.struct(lang_no.cast("int").alias("lang_no"), F.col(ord_).alias("ord"), F.col(file).alias("file"), F.col(seq).alias("seq"))


def _any(pairs: list[tuple[str, tuple[str, ...]]]):
    return reduce(lambda x, y: x | y, [(F.col("lang") == lang) & F.col("kind").isin(*kinds) for lang, kinds in pairs])


def _symbols(nodes: DataFrame) -> DataFrame:
    """Names and scopes carry their language, so that resolution never crosses languages."""
    return nodes.select("id", "kind", F.concat_ws("\x01", "lang", "name").alias("name"), "qualified_name", F.concat_ws("\x01", "lang", "scope").alias("scope"), "lang")


def _imports(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IMPORTS edges and stubs for what no file provides."""
    imp = rows.where("tag = 'import'").select("lang", F.col("a").alias("module_id"), F.col("b").alias("source")).distinct()
    edges, missing = [], []
    for lang in ("python", "java", "go", "ts"):
        own = imp.where(F.col("lang") == lang)
        last = F.substring_index("source", "/", -1) if lang == "ts" else F.col("source")
        targets = nodes.where(F.col("lang") == lang)
        if lang == "go":
            found = own.select("module_id", "source", F.lit(None).cast("string").alias("dst"))
        else:
            if lang == "java":
                targets = targets.where("kind in ('class', 'interface')")
            else:
                targets = targets.where("kind = 'module'")
            hit = resolve.resolve_imports(own.select("module_id", last.alias("target")), targets.select("id", "qualified_name", F.col("place").alias("seq")), by_suffix=lang != "java")
            found = own.withColumn("target", last).join(hit, ["module_id", "target"]).select("module_id", "source", "dst")
        end = "." if lang in ("python", "java") else "/"
        word = "module" if lang in ("python", "ts") else "import"
        edges.append(_edges(found.withColumn("to", F.coalesce("dst", F.concat(F.lit("ext::"), F.col("source")))), "IMPORTS", "module_id", "to", EXTRACTED))
        missing.append(found.where("dst is null").select("source", F.substring_index("source", end, -1).alias("name"), F.concat_ws(" ", F.lit(word), "source").alias("embed_text"), F.lit(S.ORDER.index(lang)).alias("o")))
    stubs = resolve.first_wins(reduce(DataFrame.unionAll, missing).distinct(), ["source"], ["o"])
    empty = F.lit("")
    made = stubs.select(
        F.concat(F.lit("ext::"), "source").alias("id"), F.lit("external").alias("kind"), "name", F.col("source").alias("qualified_name"), F.col("source").alias("module"), F.lit("<external>").alias("file_path"),
        F.lit(0).cast("bigint").alias("start_line"), F.lit(0).cast("bigint").alias("end_line"), empty.alias("signature"), empty.alias("docstring"), empty.alias("code"), "embed_text", empty.alias("content_sha"),
    )
    return reduce(DataFrame.unionAll, edges), made


def _embedded(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that SQL strings create and no file has; their rows; all tables and columns."""
    units = rows.where("tag = 'sql'").select(F.col("a").alias("owner"), "file", F.col("b").alias("text"), F.xxhash64("file", "seq").alias("seq"))
    got = cut(S.extract_embedded(units), "embedded")
    made = got.where("tag = 'node'").withColumn("file_path", F.col("file")).withColumn("lang", F.lit("embedded"))
    made = resolve.first_wins(made, ["kind", "qualified_name"], ["file", "ord", "seq"])
    there = nodes.where("kind in ('table', 'column')").select("kind", "qualified_name")
    new = made.join(there, ["kind", "qualified_name"], "left_anti").join(nodes.select("id"), "id", "left_anti")
    return new, got, nodes.select(*NODE, "place").unionByName(new.withColumn("place", _place(F.lit(len(S.ORDER) + 1), "ord", "file", "seq")).select(*NODE, "place"))


def build(spark: SparkSession, root: str, languages: tuple[str, ...] = S.ORDER, resolver: str | None = None) -> Graph:
    """Nodes (without embedding) and edges of the files under root. Type inference is no resolver here."""
    if resolver not in (None, "names"):
        raise ValueError(f"resolver {resolver!r} is not available; calls are resolved by name")
    return from_files(S.scan(spark, root), languages)


def from_files(files: DataFrame, languages: tuple[str, ...] = S.ORDER) -> Graph:
    return from_rows(cut(S.extract(files, languages), "extracted"))


def from_rows(rows: DataFrame) -> Graph:
    """The graph of extracted rows, of whatever runs they come from."""
    for r in rows.where("tag = 'warning'").select("a").limit(20).collect():
        warnings.warn(r["a"], stacklevel=2)
    # languages in order, then suffixes, files and what comes first in them
    lang_no = F.array_position(F.array(*[F.lit(x) for x in S.ORDER]), F.col("lang"))
    place = _place(lang_no, "ord", "file", "seq")
    raw = rows.where("tag = 'node'").withColumn("file_path", F.col("file")).withColumn("place", place)
    nodes = cut(resolve.first_wins(raw, ["id"], ["place"]), "nodes")
    keep = resolve.keepers(nodes.where("lang = 'sql'"), ["kind", "qualified_name"], ["place"])
    doubles = keep.where("id <> keeper").select("id")
    nodes = nodes.join(doubles, "id", "left_anti")

    symbols = _symbols(nodes.where(_any(list(CALLABLE.items()))))
    callers = _symbols(nodes)
    sites = rows.where("tag = 'call'").select(
        F.concat_ws("|", "file", F.col("seq").cast("string")).alias("site"), F.col("a").alias("caller"), F.concat_ws("\x01", "lang", "b").alias("name"), F.col("flag").alias("is_receiver")
    )
    calls = resolve.resolve_calls(sites, symbols.drop("lang"))
    bases = rows.where("tag = 'base'").select(F.col("a").alias("type_id"), F.concat_ws("\x01", "lang", "b").alias("base"))
    targets = _symbols(nodes.where(_any(list(BASES.items())))).drop("lang")
    inherits = resolve.resolve_bases(bases, targets.unionByName(callers.drop("lang").where("kind not in ('class', 'interface')")), ["class", "interface"])
    imports, stubs = _imports(rows, nodes)

    owns = rows.where("tag = 'owns'").select(F.col("a").alias("m"), F.col("b").alias("owner"), F.col("c").alias("file_module"))
    types = nodes.where("lang = 'go' and kind in ('class', 'interface')").groupBy(F.col("qualified_name").alias("owner")).agg(F.max_by("id", "place").alias("t"))
    owned = _edges(owns.join(types, "owner", "left").withColumn("src", F.coalesce("t", "file_module")), "CONTAINS", "src", "m", EXTRACTED)

    new, strings, everything = _embedded(rows, nodes)
    everything = cut(everything, "everything")
    tables = everything.where("kind = 'table'").select("id", "name", "qualified_name", F.col("place").alias("seq"))
    columns = everything.where("kind = 'column'").groupBy("qualified_name").agg(F.max_by("id", "place").alias("col"))
    both = rows.unionByName(strings)
    fks = _edges(resolve.by_name_or_last(both.where("tag = 'fk'").select(F.col("a").alias("src"), F.col("b").alias("ref")), tables).where("dst is not null"), "REFERENCES", "src", "dst", EXTRACTED)
    queries = _edges(resolve.by_name_or_last(strings.where("tag = 'query'").select(F.col("a").alias("src"), F.col("b").alias("ref")), tables).where("dst is not null"), "QUERIES", "src", "dst", INFERRED)
    joins = resolve.by_name_or_last(strings.where("tag = 'join'").select("a", F.col("b").alias("ref")), tables).withColumnRenamed("dst", "to")
    joins = resolve.by_name_or_last(joins.select(F.col("a").alias("ref"), "to"), tables).where("dst is not null and to is not null and dst <> to")
    joined = _edges(joins, "JOINS", "dst", "to", INFERRED)
    touched = strings.where("tag = 'query_column'").select(F.col("a").alias("src"), F.concat_ws(".", "b", "c").alias("qualified_name")).join(columns, "qualified_name")
    column_queries = _edges(touched, "QUERIES", "src", "col", INFERRED)

    orm = rows.where("tag = 'orm'").select(F.col("a").alias("class_id"), F.col("b").alias("ref"), F.col("d").alias("sure"))
    mapped = resolve.by_name_or_last(orm, tables).where("dst is not null").join(tables.select(F.col("id").alias("dst"), F.col("name").alias("t_name"), F.col("qualified_name").alias("t_qual")), "dst")
    maps = _edges(mapped, "MAPS_TO", "class_id", "dst", F.col("sure"))

    def column_of(pairs: DataFrame) -> DataFrame:
        """pairs (owner, class_id, attr) with col: of the table's own name, else of its qualified one."""
        full = pairs.join(mapped, "class_id").withColumn("q1", F.concat_ws(".", "t_name", "attr")).withColumn("q2", F.concat_ws(".", "t_qual", "attr"))
        one = full.join(columns.withColumnsRenamed({"qualified_name": "q1", "col": "c1"}), "q1", "left").join(columns.withColumnsRenamed({"qualified_name": "q2", "col": "c2"}), "q2", "left")
        return one.withColumn("col", F.coalesce("c1", "c2")).where("col is not null")

    declared = column_of(rows.where("tag = 'orm_column'").select(F.col("a").alias("owner"), F.col("a").alias("class_id"), F.col("b").alias("attr")))
    column_maps = _edges(declared, "MAPS_TO", "owner", "col", F.col("sure"))
    contains = rows.where("tag = 'edge'").select(F.col("a").alias("type"), F.col("b").alias("src"), F.col("c").alias("dst"), F.col("d").alias("confidence"))
    methods = contains.where("type = 'CONTAINS'").select(F.col("src").alias("class_id"), F.col("dst").alias("owner"))
    reads = rows.where("tag = 'attr'").select(F.col("a").alias("owner"), F.col("b").alias("attr")).distinct().join(methods, "owner").join(nodes.where("kind = 'method'").select(F.col("id").alias("owner")), "owner", "left_semi")
    attribute_queries = _edges(column_of(reads), "QUERIES", "owner", "col", INFERRED)

    made = strings.where("tag = 'edge'").select(F.col("a").alias("type"), F.col("b").alias("src"), F.col("c").alias("dst"), F.col("d").alias("confidence"))
    all_edges = reduce(DataFrame.unionByName, [contains, made, calls, inherits, imports, owned, fks, queries, joined, column_queries, maps, column_maps, attribute_queries])
    moved = resolve.remap(all_edges, keep.where("id <> keeper"))
    final_nodes = everything.select(*NODE).unionByName(stubs.select(*NODE))
    kept = resolve.with_endpoints(moved, final_nodes)
    resolver = F.when(F.col("type") == "CALLS", RESOLVER).otherwise("syntax")
    return Graph(final_nodes, kept.withColumn("resolver", resolver).select("type", "src", "dst", "confidence", "resolver"))
