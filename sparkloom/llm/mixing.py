"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source whose target is r times its size gives every document floor(r) whole copies. The rest of the target is a
sample of fixed size, in words, with unequal odds: a document's inclusion odds go with size ** TILT (0.5: longer ones
are taken rather than shorter ones), at a level at which the words expected are the rest; those whose odds reach one
are certain and get their further copy first. Documents are ranked by random odds over inclusion odds,
u / (1 - u) / (pi / (1 - pi)), and taken in that order up to the one that brings the words nearest to the rest.

The level comes from sums by classes of size, and the cut from sums over slices of the ranking, in two steps of SLICES,
then inside one slice: a source that holds most rows is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, text_or_empty

# The weights of sources in their order, repeating, and the shares of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
TILT = 0.5
SLICES = 256
#: Classes of size to an octave.
CLASSES = 4
SEED = 20_240_611
#: With at most so many sources (under 2 MB), the cuts are broadcast; beyond it they are joined.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n, target of sources (source, source_size, n): one row a source, ordered in one task.

    Sharing the excess again until no target is above its limit ends where all uncapped sources get the same words
    per unit of weight; that level follows from running sums in the order in which sources reach their limits.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_limit = Window.orderBy("__full", F.col("source").asc_nulls_last())
    upto = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    x = (
        sizes.withColumn("__w", weight)
        .withColumn("__full", most * F.col("source_size") / F.col("__w"))
        .withColumn("__left", share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / (F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(upto), F.lit(0.0))))
        .withColumn("__level", -F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", (-F.col("__level")).alias("l")))).over(all_rows)["l"])
    )
    target = F.least(most * F.col("source_size"), F.coalesce("__level", F.lit(0.0)) * F.col("__w"))
    return x.select("source", "source_size", "n", target.alias("target"))


def _plan(df: DataFrame, key: str, source: str, text: str, weights: tuple[int, ...], share: float, most: float, tilt: float, seed: int) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Of df: h (128 bits that rank a row) and the row's size, as stored columns; a row for each source, with its cut; and
    size and h as columns on df."""
    size = words(text_or_empty(f"`{text}`"))
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(str(seed)), F.md5(text_or_empty(f"`{text}`"))))
    small = Stored(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), h.alias("h")), "mix-sizes").df
    per_source = targets(small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = per_source.withColumn("base", F.floor(ratio + 1e-12).cast("long"))
    sources = Stored(sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size"))), "mix-plan").df
    few = sources.count() <= BROADCAST_SOURCES
    held = F.broadcast if few else (lambda x: x)

    def per(rows: DataFrame, other: DataFrame) -> DataFrame:
        """rows with the columns of other, one row a source."""
        return rows.join(held(other.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    # the level: classes of size from the longest on are certain while the level would take their odds to one
    sums = small.where("size > 0").groupBy("source", _class(F.col("size")).alias("c")).agg(F.sum("size").alias("s"), F.sum(F.pow("size", F.lit(tilt)) * F.col("size")).alias("xs"))
    classes = sums.groupBy("source").agg(F.reverse(F.sort_array(F.collect_list(F.struct("c", F.col("s").cast("double").alias("s"), "xs")))).alias("cs"))
    start = F.struct(F.col("rest").alias("left"), F.aggregate("cs", F.lit(0.0), lambda a, e: a + e["xs"]).alias("xs"), F.lit(1 << 30).alias("cut"), F.lit(False).alias("done"))
    upper = lambda c: F.pow(F.pow(F.lit(2.0), (c + 1) / float(CLASSES)), F.lit(tilt))

    def certain(a: Column, e: Column) -> Column:
        stop = a["done"] | (a["left"] <= 0) | (a["left"] * upper(e["c"]) <= a["xs"])
        return F.when(stop, F.struct(a["left"].alias("left"), a["xs"].alias("xs"), a["cut"].alias("cut"), F.lit(True).alias("done"))).otherwise(
            F.struct((a["left"] - e["s"]).alias("left"), (a["xs"] - e["xs"]).alias("xs"), e["c"].alias("cut"), F.lit(False).alias("done"))
        )

    levels = per(classes, sources.select("source", "rest")).select("source", F.aggregate("cs", start, certain).alias("a"))
    levels = levels.select("source", F.when((F.col("a.left") > 0) & (F.col("a.xs") > 0), F.col("a.left") / F.col("a.xs")).otherwise(0.0).alias("level"), F.col("a.cut").alias("certain"))
    joined = sources.join(held(levels.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s")), "left")
    level = Stored(joined.select("source", "source_size", "target", "base", "rest", F.coalesce("level", F.lit(0.0)).alias("level"), F.coalesce("certain", F.lit(1 << 30)).alias("certain")), "mix-level").df
    ranked = per(small.drop("k"), level.select("source", "rest", "level", "certain")).withColumn("v", rank(F.col("size"), F.col("h"), F.col("level"), F.col("certain"), tilt))

    def crossing(slices: DataFrame) -> DataFrame:
        """source, slice, before: the slice in which the running words reach the rest, and the words before it."""
        in_order = Window.partitionBy("source").orderBy("slice")
        upto = slices.withColumn("before", F.col("start") + F.sum("w").over(in_order) - F.col("w"))
        found = upto.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("w") >= F.col("rest"))).groupBy("source").agg(F.min(F.struct("slice", "before")).alias("c"))
        return found.select("source", F.col("c.slice").alias("at"), "c.before")

    coarse = F.floor(F.col("v") * SLICES).cast("int")
    fine = F.floor(F.col("v") * SLICES * SLICES).cast("int")
    one = crossing(ranked.groupBy("source", coarse.alias("slice")).agg(F.sum("size").alias("w"), F.first("rest").alias("rest")).withColumn("start", F.lit(0)))
    inside = per(ranked, one).where(coarse == F.col("at"))
    two = crossing(inside.groupBy("source", fine.alias("slice")).agg(F.sum("size").alias("w"), F.first("rest").alias("rest"), F.first("before").alias("start")))
    inside = per(ranked, two).where(fine == F.col("at"))
    # equal rows are one rank
    each = inside.groupBy("source", "v", "h", "rest", "before", "at").agg(F.sum("size").alias("size"))
    by_rank = Window.partitionBy("source").orderBy("v", "h")
    passed = F.col("before") + F.sum("size").over(by_rank) - F.col("size")
    # the last document that brings the words nearer to the rest
    cut = each.withColumn("nearer", passed + F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.when(F.col("nearer"), F.struct("v", "h"))).alias("cut"), F.first("at").alias("at"))
    cut = cut.select(F.col("source").alias("__s"), F.coalesce(F.col("cut"), F.struct((F.col("at") / float(SLICES * SLICES)).alias("v"), F.lit("").alias("h"))).alias("cut"))
    # with no crossing slice nothing is left to take
    cuts = level.join(cut, level["source"].eqNullSafe(cut["__s"]), "left").select(*level.columns, F.col("cut.v").alias("cut_v"), F.col("cut.h").alias("cut_h"))
    return small, Stored(cuts, "mix-cuts").df, size, h


def _class(size: Column) -> Column:
    """Classes of sizes, CLASSES to an octave; what is added keeps powers of two on their side."""
    return F.floor(F.log2(size.cast("double")) * CLASSES + 1e-9).cast("int")


def rank(size: Column, h: Column, level: Column, certain: Column, tilt: float) -> Column:
    """Random odds over inclusion odds, as a number in (0, 1): q / (1 + q). Certain documents come first, those without
    words after them."""
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    pi = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), level * F.pow(size.cast("double"), F.lit(tilt))))
    q = (u / (1 - u)) / (pi / (1 - pi))
    return F.when((size > 0) & (_class(size) >= certain), u * 1e-9).otherwise(q / (1 + q))


def _copies(size: Column, h: Column, tilt: float) -> Column:
    v = rank(size, h, F.col("level"), F.col("certain"), tilt)
    before = (v < F.col("cut_v")) | ((v == F.col("cut_v")) & (h <= F.col("cut_h")))
    return F.col("base") + F.when((F.col("rest") > 0) & F.col("cut_v").isNotNull() & before, 1).otherwise(0)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, tilt: float = TILT, seed: int = SEED) -> DataFrame:
    """df with __size, __source_size, __target and __copies (how often the mix takes the document, 0 to most).

    A null source is a source, the last one. A null or empty text has size 0: it costs no words, and is taken as its
    rank has it. Ranks come from a hash of key and text, so reruns agree; rows equal in both count as one rank and are
    taken or left together. A null key is hashed as an empty one. An empty table gives an empty one. Other columns
    pass through, whatever their names; those named like the four above are replaced.
    """
    own = df.drop("__size", "__source_size", "__target", "__copies")
    _, cuts, size, h = _plan(own, key, source, text, weights, share, most, tilt, seed)
    held = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    named = own.select(*[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(own.columns)], size.alias("__size"), h.alias("__h"))
    joined = named.join(held, F.col(f"__c{own.columns.index(source)}").cast("string").eqNullSafe(F.col("source")))
    copies = _copies(F.col("__size"), F.col("__h"), tilt)
    return joined.select(
        *[F.col(f"__c{k}").alias(c) for k, c in enumerate(own.columns)], "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), copies.alias("__copies")
    )


def shares(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, tilt: float = TILT, seed: int = SEED) -> DataFrame:
    """key, size, source_size, target and taken (words, repeats counted) of every row, as mix() has it; texts are read once."""
    small, cuts, _, _ = _plan(df, key, source, text, weights, share, most, tilt, seed)
    held = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    joined = small.join(held.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    return joined.select(F.col("k").alias(key), "size", "source_size", "target", (F.col("size") * _copies(F.col("size"), F.col("h"), tilt)).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}|' || md5(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, [{", ".join(f"{x}.0::DOUBLE" for x in WEIGHTS)}][((r - 1) % {len(WEIGHTS)} + 1)::INT] AS w FROM n),
f AS (SELECT *, {MOST}::DOUBLE * source_size / w AS f FROM w),
l AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum({MOST}::DOUBLE * source_size) OVER o, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM f WINDOW o AS (ORDER BY f, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least({MOST}::DOUBLE * source_size, coalesce((SELECT level FROM l WHERE level <= f ORDER BY f, level DESC LIMIT 1), 0) * w) AS target FROM f),
b AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12)::BIGINT AS base FROM t),
r AS (SELECT *, greatest(0.0::DOUBLE, target - base * source_size) AS rest FROM b),
c AS (
  SELECT source, floor(log2(size::DOUBLE) * {CLASSES} + 1e-9)::INT AS c, sum(size)::DOUBLE AS s, sum(pow(size::DOUBLE, {TILT}::DOUBLE) * size) AS xs
  FROM d WHERE size > 0 GROUP BY 1, 2),
-- what is left for the classes from each one down, if all above are certain
k AS (
  SELECT c.source, c.c, r.rest - coalesce(sum(c.s) OVER a, 0) AS rest, sum(c.xs) OVER (PARTITION BY c.source ORDER BY c.c) AS xs
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
  WINDOW a AS (PARTITION BY c.source ORDER BY c.c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (
  SELECT source, max(c) AS top, max(c) FILTER (WHERE rest <= 0 OR rest * pow(pow(2.0::DOUBLE, (c + 1) / {CLASSES}.0::DOUBLE), {TILT}::DOUBLE) <= xs) AS c FROM k GROUP BY source),
v AS (
  SELECT s.source, coalesce((SELECT min(c) FROM c WHERE c.source IS NOT DISTINCT FROM s.source AND c.c > coalesce(s.c, -1)), 1 << 30) AS certain,
    coalesce((SELECT CASE WHEN rest > 0 AND xs > 0 THEN rest / xs ELSE 0 END FROM k WHERE k.source IS NOT DISTINCT FROM s.source AND k.c = s.c), 0) AS level
  FROM stop s),
x AS (
  SELECT d.*, r.source_size, r.target, r.base, r.rest, coalesce(v.level, 0) AS level, coalesce(v.certain, 1 << 30) AS certain,
    ((('0x' || substr(h, 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source),
p AS (SELECT *, greatest(1e-9::DOUBLE, least(1.0::DOUBLE - 1e-9::DOUBLE, level * pow(size::DOUBLE, {TILT}::DOUBLE))) AS pi FROM x),
q AS (
  SELECT *, CASE WHEN size > 0 AND floor(log2(greatest(size, 1)::DOUBLE) * {CLASSES} + 1e-9)::INT >= certain THEN u * 1e-9::DOUBLE
    ELSE ((u / (1 - u)) / (pi / (1 - pi))) / (1 + (u / (1 - u)) / (pi / (1 - pi))) END AS v FROM p),
z AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, h) AS upto, sum(size) OVER (PARTITION BY source, v, h) AS own FROM q)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN rest > 0 AND upto - own + own / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM z
"""
