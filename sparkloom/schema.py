"""The fixed, versioned schema of a graph: nodes, edges, meta and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA_VERSION = "1"
# The names of kinds, edge types and confidences.
NODE_KINDS = ("module", "class", "function", "method", "rationale", "external", "table", "column", "interface")
EDGE_TYPES = ("CALLS", "INHERITS", "IMPORTS", "CONTAINS", "DOCUMENTS", "REFERENCES", "MAPS_TO", "QUERIES", "JOINS")
EXTRACTED, INFERRED = "EXTRACTED", "INFERRED"
DATA_KINDS = ("table", "column")
BRIDGE = ("QUERIES", "MAPS_TO")

_TEXT = T.StringType()
NODES = T.StructType(
    [T.StructField(n, _TEXT, False) for n in ("id", "kind", "name", "qualified_name", "module", "file_path")]
    + [T.StructField(n, T.LongType(), False) for n in ("start_line", "end_line")]
    + [T.StructField(n, _TEXT, False) for n in ("signature", "docstring", "code", "embed_text")]
    + [T.StructField("embedding", T.ArrayType(T.FloatType()), False), T.StructField("content_sha", _TEXT, False)]
)
EDGES = T.StructType([T.StructField(n, _TEXT, False) for n in ("type", "src", "dst", "confidence", "resolver")])
META = T.StructType([T.StructField("key", _TEXT, False), T.StructField("value", _TEXT, False)])
FILES = T.StructType([T.StructField("path", _TEXT, False), T.StructField("sha", _TEXT, False)])


class SchemaError(ValueError):
    """A table does not have the columns that the version of the schema asks for."""


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def validate(df: DataFrame, expected: T.StructType, name: str) -> DataFrame:
    """df in the expected column order; raises on missing columns or other types."""
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in expected.fields if f.name not in found or found[f.name].simpleString() != f.dataType.simpleString()]
    if wrong:
        raise SchemaError(f"{name}: columns missing or of another type: {', '.join(wrong)}")
    return df.select(*[f.name for f in expected.fields])
