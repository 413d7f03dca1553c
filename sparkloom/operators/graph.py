"""Graph operators over edge tables (type, src, dst, confidence): neighbours, closures, paths, PageRank, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE_TYPES, EXTRACTED
from ..storage import cut

MAX_HOPS = 8
ALPHA, ROUNDS = 0.85, 30
#: Rounds whose plans are joined before their result is written.
UNROLLED = 4
RANKS_UNROLLED = 10


def relations(edges: DataFrame, node: str | DataFrame, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """relation, direction, id, confidence of the edges of one node, or of all nodes of a table (node); wrong filters
    raise, as an empty answer would look like a node without edges."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be in, out or both, not {direction!r}")
    if wrong := sorted(set(types or ()) - set(EDGE_TYPES)):
        raise ValueError(f"unknown relations {wrong}; there are {sorted(EDGE_TYPES)}")
    e = edges.where(F.col("type").isin(list(types))) if types else edges
    parts = []
    for way, own, other in (("out", "src", "dst"), ("in", "dst", "src")):
        if direction in (way, "both"):
            hit = e.where(F.col(own) == node) if isinstance(node, str) else e.join(node.select(F.col("node").alias(own)), own, "left_semi")
            parts.append(hit.select(F.col("type").alias("relation"), F.lit(way).alias("direction"), F.col(other).alias("id"), F.coalesce("confidence", F.lit(EXTRACTED)).alias("confidence")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.distinct()


def undirected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b) both ways, with multiplicity and without self-loops; nodes (id) keeps edges between them only."""
    e = edges.select("src", "dst").where("src <> dst")
    if nodes is not None:
        ids = nodes.select("id")
        e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def reach(steps: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """(id, hop) reached from starts (id) over steps (a, b), at the least number of hops, starts at 0.

    A frontier a hop, with what has been seen taken out: paths are never listed, so cycles end. Without hops it goes
    on until nothing new comes.
    """
    seen = starts.select("id").distinct().withColumn("hop", F.lit(0))
    steps, hop, frontier = steps.select("a", "b"), 0, seen
    far = hops is None or hops > 2
    if far:
        steps = cut(steps.distinct(), "steps")
    while hops is None or hop < hops:
        found = None
        at = frontier.select("id")
        for _ in range(UNROLLED if hops is None else min(UNROLLED, hops - hop)):
            hop += 1
            at = steps.join(at.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
            if not far:
                at = at.join(seen.select("id"), "id", "left_anti")
                seen = seen.unionByName(at.withColumn("hop", F.lit(hop)))
            else:
                level = at.withColumn("hop", F.lit(hop))
                found = level if found is None else found.unionByName(level)
        if not far:
            continue
        # several hops a job: what comes again within them keeps its least hop
        new = cut(found.groupBy("id").agg(F.min("hop").alias("hop")).join(seen.select("id"), "id", "left_anti"), "frontier")
        seen = seen.unionByName(new)
        # nodes found before the last hop have had their neighbours looked at
        frontier = new.where(F.col("hop") == hop)
        if not frontier.limit(1).count():
            break
    return seen


def neighbors(edges: DataFrame, node: str, hops: int = 1) -> DataFrame:
    """(id, hop) within 1 to 8 hops of a node, edges taken both ways, the node left out."""
    hops = max(1, min(MAX_HOPS, hops))
    starts = edges.sparkSession.createDataFrame([(node,)], "id string")
    return reach(undirected(edges), starts, hops).where("hop > 0")


def closure(edges: DataFrame, starts: DataFrame, reverse: bool = False) -> DataFrame:
    """(id) reachable along edges (against them with reverse) from starts, which are left out."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return reach(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), starts).where("hop > 0").select("id")


def shortest_path(edges: DataFrame, src: str, dst: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """(step, id) of one shortest path, edges taken both ways; of equal ones that of the least ids from the end back.
    Empty when there is none within max_hops. A path from a node to itself is that node."""
    spark = edges.sparkSession
    if src == dst:
        return spark.createDataFrame([(0, src)], "step bigint, id string")
    steps = undirected(edges).distinct()
    seen = spark.createDataFrame([(src, None, 0)], "id string, parent string, hop int")
    frontier = seen
    for hop in range(1, max_hops + 1):
        found = steps.join(frontier.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        frontier = cut(found.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)).select("id", "parent", "hop"), "path")
        seen = seen.unionByName(frontier)
        ends = frontier.agg(F.max((F.col("id") == dst).cast("int")).alias("hit"), F.count(F.lit(1)).alias("n")).first()
        if ends["hit"]:
            break
        if not ends["n"]:
            return spark.createDataFrame([], "step bigint, id string")
    else:
        return spark.createDataFrame([], "step bigint, id string")
    path, at = [dst], dst
    while at != src:  # at most max_hops point lookups
        at = seen.where(F.col("id") == at).first()["parent"]
        path.append(at)
    return spark.createDataFrame(list(enumerate(reversed(path))), "step bigint, id string")


def pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """(id, score) of personalised PageRank from seeds (id, weight); only nodes with rank.

    Parallel and mutual edges count each. Rank that a node without edges would lose goes back to the seeds. After 30
    rounds at 0.85 less than a hundredth of the start is left, so rounds are counted, not run to a limit.
    """
    steps = undirected(edges, nodes)
    degree = steps.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    # parallel edges as one with their number: fewer rows in each round
    named = cut(steps.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).join(degree, "a").select("a", "b", (F.col("m") / F.col("degree")).alias("w")), "steps")
    # numbers for ids, written down once, so that rounds move 16 bytes a node; every end is some edge's start
    numbers = cut(named.select(F.col("a").alias("id")).distinct().withColumn("no", F.monotonically_increasing_id()), "numbers")
    a, b = (numbers.select(F.col("id").alias(c), F.col("no").alias(f"{c}_no")) for c in "ab")
    numbered = cut(named.join(a, "a").join(b, "b").select(F.col("a_no").alias("a"), F.col("b_no").alias("b"), "w"), "numbered")
    # held in the partitioning of the join of all rounds: only ranks are shuffled; what a lost executor held is read anew
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    weights = numbered.repartition(parts, "a").persist(StorageLevel.MEMORY_AND_DISK)
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    start = cut(seeds.join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("weight").alias("weight")).withColumn("p", F.col("weight") / total).select("id", "p"), "seeds")
    # a node without edges gets rank from the restart only, so what goes back each round follows from the seeds' share
    loose = start.join(numbers, "id", "left_anti").agg(F.sum("p")).first()[0] or 0.0
    fixed = cut(start.join(numbers, "id").select(F.col("no").alias("id"), "p"), "seeds")
    alone = start.join(numbers, "id", "left_anti")
    rank, stuck = fixed.select("id", F.col("p").alias("r")), loose
    for k in range(1, rounds + 1):
        back = 1 - alpha + alpha * stuck
        stuck = loose * back
        moved = weights.join(rank, weights["a"] == rank["id"]).select(F.col("b").alias("id"), (F.col("r") * F.col("w") * alpha).alias("x"))
        rank = moved.unionByName(fixed.select("id", (F.col("p") * back).alias("x"))).groupBy("id").agg(F.sum("x").alias("r"))
        if k % RANKS_UNROLLED == 0 or k == rounds:
            rank = cut(rank, "rank")
    weights.unpersist()
    out = rank.join(numbers.select(F.col("no").alias("n"), F.col("id").alias("name")), F.col("id") == F.col("n")).select(F.col("name").alias("id"), F.col("r").alias("score"))
    # a seed without edges has what the last round gave back
    return out.unionByName(alone.select("id", (F.col("p") * (back if rounds else 1.0)).alias("score"))).where("score > 0")


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(type, n) of all nine types, zeros included."""
    types = edges.sparkSession.createDataFrame([(t,) for t in EDGE_TYPES], "type string")
    counted = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return types.join(counted, "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node, self-loops skipped, edges to unknown nodes skipped."""
    ends = undirected(edges, nodes).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
