"""Interval joins: lines to enclosing spans, chunks to overlapping spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_LINES, STRIDE = 40, 20
#: Lines of one bucket; a span is dealt to each bucket that it reaches, so the joins are equi-joins.
BUCKET = 64


def _buckets(df: DataFrame, start: str, end: str) -> DataFrame:
    lo, hi = F.floor(F.col(start) / BUCKET), F.floor(F.greatest(F.col(start), F.col(end)) / BUCKET)
    return df.withColumn("__b", F.explode(F.sequence(lo, hi)))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line, id): for each point (file, line) the shortest span (file, start, end, id, kind) around it; a module
    only if nothing else is; ties by id. Points without a span are left out."""
    p = points.select("file", "line").distinct().withColumn("__b", F.floor(F.col("line") / BUCKET))
    s = _buckets(spans.select("file", "start", "end", "id", "kind"), "start", "end")
    hit = p.join(s, ["file", "__b"]).where("line between start and end")
    best = F.struct((F.col("kind") == "module").alias("m"), (F.col("end") - F.col("start")).alias("size"), "id")
    return hit.groupBy("file", "line").agg(F.min(best)["id"].alias("id"))


def overlapping(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(chunk, id): spans (file, start, end, id) that share a line with a chunk (chunk, file, start, end)."""
    c = _buckets(chunks.select("chunk", "file", F.col("start").alias("c0"), F.col("end").alias("c1")), "c0", "c1")
    s = _buckets(spans.select("file", F.col("start").alias("s0"), F.col("end").alias("s1"), "id"), "s0", "s1")
    hit = c.join(s, ["file", "__b"]).where("s0 <= c1 and s1 >= c0")
    # both ends of an overlap may lie in several common buckets; it counts in the first
    return hit.where(F.col("__b") == F.floor(F.greatest("c0", "s0") / BUCKET)).select("chunk", "id").distinct()


def line_chunks(files: DataFrame, lines: int = CHUNK_LINES, stride: int = STRIDE) -> DataFrame:
    """(file, start, end, text) windows of files (file, text), from line 1; the last window ends with the file."""
    parts = F.split("text", "\n")
    n = F.size(parts)
    last = F.when(n > lines, F.ceil((n - lines) / stride)).otherwise(0)
    each = files.where("text <> ''").select("file", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    end = F.least(F.size("parts").cast("bigint"), F.col("k") * stride + lines)
    return each.select("file", (F.col("k") * stride + 1).alias("start"), end.alias("end"), F.array_join(F.slice("parts", (F.col("k") * stride + 1).cast("int"), lines), "\n").alias("text"))


def grep_rank(lines: DataFrame, spans: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """(id, n_terms, n_hits, rank): spans by the distinct terms found in their lines (file, line, text), then by hits."""
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")
    hit = lines.select("file", "line", found.alias("terms")).where(F.size("terms") > 0)
    per = hit.join(enclosing(hit, spans), ["file", "line"]).groupBy("id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("terms")))).cast("bigint").alias("n_terms"), F.sum(F.size("terms").cast("bigint")).alias("n_hits"))
    order = [F.desc("n_terms"), F.desc("n_hits"), "id"]
    return per.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def best_chunk(scores: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(id, score): each span's best chunk (chunk, score)."""
    return overlaps.join(scores, "chunk").groupBy("id").agg(F.max("score").alias("score"))
