"""Source files under a root: which count, their names and digests, and what is extracted from them."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_sha
from ..operators.extract import rows as R

# The suffixes in the order in which languages are read, and folders that are passed over.
SUFFIXES = (".py", ".sql", ".java", ".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
SKIPPED = ("__pycache__", "node_modules", "site-packages", ".eggs", "dist", "build", "vendor", "target")
VENV_NAMES = ("venv", "env")
LANGUAGES = {".py": "python", ".sql": "sql", ".java": "java", ".go": "go"} | dict.fromkeys(SUFFIXES[4:], "ts")
ORDER = ("python", "sql", "java", "go", "ts")
_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[x.split()[1]]) for x in (R.SCHEMA + ", ord bigint").split(", ")])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, lang, ord, sha, content) of the files that count. path is relative to the root's parent.

    Folders are judged below the root only: hidden ones and the usual build and package folders are passed over, and
    venv or env where they hold a pyvenv.cfg.
    """
    root = root.rstrip("/")
    try:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(f"*{s}" for s in SUFFIXES) + "}").load(root)
        marks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "pyvenv.cfg").load(root)
    except AnalysisException as e:
        raise FileNotFoundError(root) from e
    base = root.rsplit("/", 1)[-1]
    alone = any(base.endswith(s) for s in SUFFIXES)
    prefix = f"{root}" if alone else f"{root}/"
    # the reader adds a scheme and, for local paths, slashes
    below = lambda c: F.regexp_replace(F.substring_index(c, prefix, -1), "^$", base)
    rel = below(F.col("path"))
    folders = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    envs = marks.select(F.regexp_replace(below(F.col("path")), "/?pyvenv.cfg$", "").alias("env")).where(F.substring_index("env", "/", -1).isin(*VENV_NAMES))
    suffix = F.concat(F.lit("."), F.substring_index(rel, ".", -1))
    order = F.array_position(F.array(*[F.lit(s) for s in SUFFIXES]), suffix)
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)
    good = read.where(~F.exists(folders, lambda d: d.isin(*SKIPPED) | d.startswith("."))).select(rel.alias("rel"), lang.alias("lang"), order.alias("ord"), "content")
    inside = F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/"))), lambda i: F.array_join(F.slice(F.split("rel", "/"), 1, i), "/"))
    venv = good.select("rel", F.explode(inside).alias("env")).join(envs, "env", "left_semi").select("rel").distinct()
    kept = good.join(venv, "rel", "left_anti")
    path = F.col("rel") if alone else F.concat(F.lit(base + "/"), F.col("rel"))
    return kept.select(path.alias("path"), "lang", F.col("ord").cast("bigint").alias("ord"), content_sha(F.col("content")).alias("sha"), "content")


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", "sha")


def _extract(lang: str, path: str, text: str) -> list[dict]:
    from ..operators.extract import go_source, java_source, python_source, sql_source, ts_source

    return {"python": python_source, "sql": sql_source, "java": java_source, "go": go_source, "ts": ts_source}[lang].extract(path, text)


def extract(files: DataFrame, languages: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows of extract.rows.SCHEMA of every file, and ord, the place of its suffix. Files of other languages are left
    out with a warning."""
    if set(languages) != set(ORDER):
        left_out = [r["lang"] for r in files.where(~F.col("lang").isin(*languages)).select("lang").distinct().collect()]
        for lang in left_out:
            warnings.warn(f"no extractor for {lang} files; they are skipped", stacklevel=2)
        files = files.where(F.col("lang").isin(*languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, order, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [r | {"ord": order} for r in _extract(lang, path, content.decode("utf-8", "replace"))]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "lang", "ord", "content").mapInArrow(run, R.SCHEMA + ", ord bigint")


def extract_embedded(units: DataFrame) -> DataFrame:
    """Rows of SQL strings (owner, file, text, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators.extract.sql_source import extract_embedded as one

        for batch in batches:
            rows = []
            for owner, file, text, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [r | {"ord": seq} for r in one(owner, file, text)]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return units.select("owner", "file", "text", "seq").mapInArrow(run, R.SCHEMA + ", ord bigint")
