"""Evaluation over question sets: gold from anchors, metrics for each retriever, a scorecard, a weight sweep."""

from __future__ import annotations

import csv
import datetime
import itertools
import json
import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import intervals, metrics, ranking, resolve
from .plans.service import MODES, GraphService
from .sources import files as S
from .storage import cut

# Words that a question's search terms leave out, the grid of the sweep, and the setting in force.
STOP_WORDS = (
    "what", "which", "where", "when", "how", "does", "do", "is", "are", "the", "a", "an", "of", "to", "in", "for", "on", "and", "or", "that", "this", "it", "with", "from", "be", "can",
    "as", "at", "by", "its", "their", "there", "if", "then", "into", "about", "not", "any", "all", "one", "two", "via",
)
GRID = {"vector": (1.0, 1.5, 2.0, 3.0), "graph": (0.5, 1.0), "lexical": (0.5, 1.0), "rrf_k": (10, 20, 40, 60), "depth": (20, 50)}
CURRENT = (*ranking.WEIGHTS, ranking.RRF_K, ranking.DEPTH)
BASELINES = ("grep", "naive-rag")


def load_questions(path: str) -> list[dict]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def terms(question: str) -> list[str]:
    import re

    words = (w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]+", question))
    return [w for w in words if len(w) > 2 and w not in STOP_WORDS]


def gold(spark: SparkSession, questions: list[dict], nodes: DataFrame) -> DataFrame:
    rows = [(q["id"], a) for q in questions for a in q["anchors"]]
    return resolve.anchors(spark.createDataFrame(rows, "question long, anchor string"), nodes)


def unresolved(spark: SparkSession, questions: list[dict], nodes: DataFrame) -> list[tuple[int, str]]:
    """Anchors without a node."""
    found = {(r["question"], r["anchor"]) for r in gold(spark, questions, nodes).select("question", "anchor").distinct().collect()}
    return [(q["id"], a) for q in questions for a in q["anchors"] if (q["id"], a) not in found]


def resolved_anchors(spark: SparkSession, questions: list[dict], nodes: DataFrame, path: str) -> None:
    by: dict = {}
    for r in gold(spark, questions, nodes).orderBy("question", "anchor", "id").collect():
        by.setdefault(r["question"], {}).setdefault(r["anchor"], []).append(r["id"])
    with open(path, "w", encoding="utf-8") as f:
        json.dump({str(q["id"]): {"mode": q["mode"], "anchors": {a: by.get(q["id"], {}).get(a, []) for a in q["anchors"]}} for q in questions}, f, indent=2)


def rankings(service: GraphService, questions: list[dict], mode: str, k: int = 10) -> DataFrame:
    parts = [service.ranking(q["question"], mode, k).select(F.lit(q["id"]).cast("bigint").alias("question"), "id", "rank") for q in questions]
    rows = [r for p in parts for r in p.collect()]  # k rows a question
    return service.spark.createDataFrame(rows, "question long, id string, rank long")


def grep_rankings(service: GraphService, lines: DataFrame, questions: list[dict], k: int = 10) -> DataFrame:
    """The baseline without a graph: term hits in lines (file, line, text)."""
    spans = service.docs.select(F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), "id", "kind")
    rows = [(q["id"], r["id"], r["rank"]) for q in questions for r in intervals.grep_rank(lines, spans, terms(q["question"]), k).collect()]
    return service.spark.createDataFrame(rows, "question long, id string, rank long")


class NaiveRag:
    """The baseline that knows no structure: windows of lines of the raw files, ranked by cosine; a node has the score of
    its best window."""

    def __init__(self, service: GraphService, files: DataFrame):
        """files: (file, text)."""
        self.service = service
        chunks = intervals.line_chunks(files).withColumn("chunk", F.concat_ws("@", "file", F.col("start").cast("string")))
        vectors = service.embedder.embed(chunks.select(F.col("chunk").alias("id"), "text")).withColumnRenamed("id", "chunk")
        self.chunks = cut(chunks.select("chunk", "file", "start", "end").join(vectors, "chunk"), "chunks")
        spans = service.docs.select(F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), "id", "kind")
        self.overlaps = cut(intervals.overlapping(self.chunks.select("chunk", "file", "start", "end"), spans), "overlaps")

    def rank(self, question: str, k: int = 10) -> DataFrame:
        one = self.service.spark.createDataFrame([("q", question)], "id string, text string")
        q = self.service.embedder.embed(one).first()["embedding"]
        scores = ranking.cosine_scores(self.chunks, q, "chunk").withColumnRenamed("id", "chunk")
        return ranking.top(intervals.best_chunk(scores, self.overlaps), k)


def baseline_rankings(service: GraphService, files: DataFrame, questions: list[dict], name: str, k: int = 10) -> DataFrame:
    """files: (file, text) of the corpus; name: one of BASELINES."""
    if name == "grep":
        lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
        return grep_rankings(service, lines, questions, k)
    rag = NaiveRag(service, files)
    rows = [(q["id"], r["id"], r["rank"]) for q in questions for r in rag.rank(q["question"], k).collect()]
    return service.spark.createDataFrame(rows, "question long, id string, rank long")


def _row(service: GraphService, questions: list[dict], found: DataFrame, name: str) -> dict:
    spark = service.spark
    q = spark.createDataFrame([(x["id"], x["mode"]) for x in questions], "question long, mode string")
    scores = metrics.per_question(q, found, gold(spark, questions, service.graph.nodes).select("question", "id"))
    row = metrics.means(scores, q).first().asDict()
    by_mode = {f"{r['mode'].lower()}@10": r["recall_at_10"] for r in metrics.per_mode(scores, q).orderBy("mode").collect()}
    return {"run": datetime.date.today().isoformat(), "retriever": name} | row | by_mode


def run(service: GraphService, questions: list[dict], mode: str) -> dict:
    """One row of metrics of one retriever."""
    return _row(service, questions, rankings(service, questions, mode), f"{mode}+{service.embedder.name}")


def scorecard(corpora: dict[str, tuple[GraphService | None, list[dict]]], modes: tuple[str, ...] = MODES[:4], baselines: bool = False) -> list[dict]:
    """A row for each corpus and retriever; with baselines also grep and windows of lines, over the files that the graph
    was made from. A corpus that is not there (None) is left out with a warning."""
    out = []
    for name, (service, questions) in corpora.items():
        if service is None:
            warnings.warn(f"corpus {name} is not there; it is left out", stacklevel=2)
            continue
        out += [{"corpus": name} | run(service, questions, m) for m in modes]
        if baselines:
            files = S.scan(service.spark, service.store.meta()["source"]).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))
            files = cut(files, "texts")
            out += [{"corpus": name} | _row(service, questions, baseline_rankings(service, files, questions, b), b if b == "grep" else f"{b}+{service.embedder.name}") for b in BASELINES]
    return out


def append_csv(path: str, row: dict) -> None:
    new = not os.path.exists(path)
    with open(path, "a", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, list(row))
        if new:
            w.writeheader()
        w.writerow(row)


def append_jsonl(path: str, row: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row, ensure_ascii=False) + "\n")


def sweep(corpora: dict[str, tuple[GraphService, list[dict]]]) -> DataFrame:
    """Every setting of the grid, and the one in force, over rankings that are made once a corpus: corpus, config,
    w_vector, w_graph, w_lexical, rrf_k, depth, recall_at_5, recall_at_10, mrr; config -1 is the vector ranking alone."""
    spark = next(iter(corpora.values()))[0].spark
    configs = [CURRENT, *itertools.product(*GRID.values())]
    grid = spark.createDataFrame([(n, s, float(c[k]), c[3], c[4]) for n, c in enumerate(configs) for k, s in enumerate(ranking.SIGNALS)], "config long, signal string, weight double, rrf_k long, depth long")
    alone = spark.createDataFrame([(-1, "vector", 1.0, 1, 10)], grid.schema)
    names = spark.createDataFrame([(n, *map(float, c[:3]), c[3], c[4]) for n, c in enumerate(configs)] + [(-1, 1.0, 0.0, 0.0, 1, 10)], "config long, w_vector double, w_graph double, w_lexical double, rrf_k long, depth long")
    out = None
    for corpus, (service, questions) in corpora.items():
        parts = [rankings(service, questions, m, max(GRID["depth"])).withColumn("signal", F.lit(m)) for m in ranking.SIGNALS]
        fused = ranking.sweep(parts[0].unionByName(parts[1]).unionByName(parts[2]), grid.unionByName(alone), 10)
        g = gold(spark, questions, service.graph.nodes).select("question", "id").distinct()
        first = fused.join(g, ["question", "id"], "left_semi").groupBy("config", "question").agg(F.min("rank").alias("first"))
        n = len(questions)
        per = first.groupBy("config").agg((F.sum((F.col("first") <= 5).cast("long")) / n).alias("recall_at_5"), (F.count(F.lit(1)) / n).alias("recall_at_10"), (F.sum(1 / F.col("first")) / n).alias("mrr"))
        rows = names.join(per, "config", "left").na.fill(0.0).select(F.lit(corpus).alias("corpus"), "*")
        out = rows if out is None else out.unionByName(rows)
    return cut(out, "sweep")


def summary(swept: DataFrame) -> DataFrame:
    """Of sweep(): each setting's means over the corpora, wins (corpora where it does no worse than vectors alone on
    recall_at_5 and mrr), qualifies (no worse on the means of both) and stable (so with any one corpus left out)."""
    value = ["recall_at_5", "recall_at_10", "mrr"]
    base = swept.where("config = -1").select("corpus", F.col("recall_at_5").alias("b5"), F.col("mrr").alias("bm"))
    both = swept.where("config >= 0").join(base, "corpus")
    eps = 1e-12
    no_worse = (F.col("recall_at_5") >= F.col("b5") - eps) & (F.col("mrr") >= F.col("bm") - eps)
    per = both.groupBy("config", "w_vector", "w_graph", "w_lexical", "rrf_k", "depth").agg(
        *[F.avg(c).alias(c) for c in value], F.avg("b5").alias("b5"), F.avg("bm").alias("bm"), F.sum(no_worse.cast("long")).alias("wins"),
        F.collect_list(F.struct((F.col("recall_at_5") - F.col("b5")).alias("g5"), (F.col("mrr") - F.col("bm")).alias("gm"))).alias("gains"),
    )
    total = lambda f: F.aggregate("gains", F.lit(0.0), lambda a, g: a + g[f])
    held_out = F.forall("gains", lambda g: (total("g5") - g["g5"] >= -eps) & (total("gm") - g["gm"] >= -eps))
    out = per.withColumn("qualifies", no_worse).withColumn("stable", F.col("qualifies") & held_out)
    return out.drop("gains", "b5", "bm").orderBy(F.desc(F.col("recall_at_5") + F.col("mrr")), "config")


def winner(swept: DataFrame) -> dict | None:
    """The setting that qualifies and wins on most corpora, then by its means; None: vectors alone are better."""
    best = summary(swept).where("qualifies").orderBy(F.desc("wins"), F.desc(F.col("recall_at_5") + F.col("mrr")), "config").first()
    return best.asDict() if best else None
