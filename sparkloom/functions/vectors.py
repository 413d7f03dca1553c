"""Column expressions over vectors, and the hashing embedder as an expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_DIM = 768


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors count as of length 1e-9."""
    bottom = norm(a) * norm(b)
    return dot(a, b) / F.when(bottom == 0, 1e-9).otherwise(bottom)


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def hash_slot(token: Column, dim: int) -> Column:
    """The token's md5 as a 128-bit number, modulo dim: by Horner's rule over its 32-bit quarters."""
    digest = F.md5(token)
    out = F.lit(0).cast("long")
    for at in (1, 9, 17, 25):
        out = F.pmod(out * F.lit(4294967296 % dim) + F.pmod(F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), F.lit(dim)), F.lit(dim))
    return out.cast("int")


def hash_sign(token: Column) -> Column:
    """1 or -1 by bit 8 of the md5."""
    return F.when(F.conv(F.substring(F.md5(token), 30, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)


def hash_embed(tokens: DataFrame, key: str = "id", dim: int = DEFAULT_DIM) -> DataFrame:
    """key, slots map<int,double> of unit length; tokens has key and tokens array. Rows without tokens get none."""
    each = tokens.select(key, F.explode("tokens").alias("t"))
    slots = each.groupBy(key, hash_slot(F.col("t"), dim).alias("slot")).agg(F.sum(hash_sign(F.col("t"))).alias("w")).where("w <> 0")
    length = slots.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("slots"))
    return length.select(key, F.transform_values("slots", lambda _, w: w / F.col("len")).alias("slots"))


def dense(slots: Column, dim: int = DEFAULT_DIM) -> Column:
    """A map of slots as array<float> of width dim; null becomes the zero vector."""
    at = lambda i: F.coalesce(F.element_at(slots, i.cast("int")), F.lit(0.0)).cast("float")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)
