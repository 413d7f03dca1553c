"""Differences between two states of a table, and reuse of what was computed before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_sha


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of files (path, sha): added, deleted or changed; equal ones are left out."""
    both = old.select("path", F.col("sha").alias("was")).join(new.select("path", F.col("sha").alias("now")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def row_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action) from (id, content_sha): keep where both are equal, delete what only the old state has in that
    form, create what only the new one has; a changed row is deleted and created."""
    a, b = old.select("id", "content_sha").distinct(), new.select("id", "content_sha").distinct()
    keys = ["id", "content_sha"]
    both = a.withColumn("o", F.lit(1)).join(b.withColumn("n", F.lit(1)), keys, "full_outer")
    action = F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull(), "create").otherwise("keep")
    return both.select("id", action.alias("action"))


def reuse(texts: DataFrame, cache: DataFrame, dim: int | None = None) -> DataFrame:
    """texts (id, embed_text) with embedding from the cache (embed_key, embedding); null where it must be computed.
    A width other than dim does not count, if dim is known."""
    held = cache.where(F.size("embedding") == dim) if dim else cache
    key = content_sha("embed_text")
    return texts.withColumn("embed_key", key).join(held.select("embed_key", "embedding").dropDuplicates(["embed_key"]), "embed_key", "left")
