"""Quality classifier by co-training of two views.

One view is the text (its words and what its characters and lines are), the other the page's metadata (source, language,
size). Both are linear models over hashed features, trained on a bounded sample of labelled rows. Over some rounds each
scores all other rows and hands the other view those of which it is surest: the HANDED surest of each class, of those
whose probability, calibrated on a held part of the labelled rows, is at least SURE. At the end the two calibrated
views are combined on the held part, and all documents are scored. Quality and toxicity are two such pairs; a document
is kept if it is good and not toxic.

Features are made once and written to the shared folder; every round, and the last scoring, reads them from there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, claim, small_batches, text_or_empty, trim

#: Bound of the labelled rows that are fitted on, and of the rows that a view hands over a class and round.
LABELLED = 8000
ROUNDS, SURE, HANDED = 3, 0.97, 500
TEXT_BITS, META_BITS = 16, 12
MARKS = re.compile(r"[^\w\s]{2,}")
MARKED = ".,;:!?\"'()*#$%&|"
#: Lengths of the beginnings of words that are features of their own.
STARTS = (6, 8)
CACHE_ENTRIES = 60_000
HEADS = ("quality", "toxic")
ROWS = 512
#: Features that are summed at a time.
PIECE = 1 << 20


class _Slots(dict):
    """Word to feature; the cache is emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        x = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << TEXT_BITS) - 1)
        return x


_slots = _Slots()


def _step(x: float, steps: int = 20) -> int:
    return int(x * steps)


def text_features(text: str) -> np.ndarray:
    words = text.lower().split()
    own = set(words)
    slots = {_slots[w.strip(".,;:!?\"'()")] for w in own}
    # how many words begin alike: what words are built on counts in languages that join words
    starts = Counter([w.strip(MARKED)[:4] for w in own])
    slots.update(_slots["\1" + x] for x in starts)
    slots.update(_slots[f"\2{min(n, 8).bit_length()}{x}"] for x, n in starts.items() if n > 1)
    bare = {w.strip(MARKED) for w in own}
    for size in STARTS:
        slots.update([_slots["\4" + x] for x in {w[:size] for w in bare if len(w) > size}])
    lines = text.count("\n") + 1
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(1, len(text))
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    style = (
        f"\0upper{_step(count[65:91].sum() / n)}",
        f"\0digit{_step(count[48:58].sum() / n)}",
        f"\0marks{_step(marks / n)}",
        f"\0other{_step(count[128:].sum() / n, 10)}",
        f"\0unique{_step(len(own) / max(1, len(words)), 10)}",
        f"\0length{int(np.log2(len(words) + 1))}",
        f"\0word{min(20, int(n / max(1, len(words))))}",
        f"\0lines{int(2 * np.log2(lines))}",
        f"\0line{int(2 * np.log2(n / lines + 1))}",
    )
    slots.update(_slots[s] for s in style)
    slots.update(_slots["\0" + m] for m in set(MARKS.findall(text)))
    return np.sort(np.fromiter(slots, np.uint16, len(slots)))


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = int(2 * np.log2(max(0, n_chars or 0) + 1))
    names = (f"source={source}", f"lang={lang}", f"size={size}", f"lang,size={lang},{size}", f"source,lang={source},{lang}", f"source,size={source},{size // 2}", "bias")
    return np.array(sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << META_BITS) - 1) for x in names}), np.uint16)


class Rows:
    """Sets of features of rows, as one flat array; a row's features share weight 1 / sqrt(their number). Sums go by
    pieces, so that what is held besides stays small."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.uint16)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.scale = 1 / np.sqrt(np.maximum(1, sizes))

    def _pieces(self) -> Iterator[slice]:
        return (slice(at, at + PIECE) for at in range(0, len(self.flat), PIECE))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.row[c], w[self.flat[c]], self.n) for c in self._pieces()), np.zeros(self.n)) * self.scale

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        g = g * self.scale
        return sum((np.bincount(self.flat[c], g[self.row[c]], dims) for c in self._pieces()), np.zeros(dims))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    w: np.ndarray
    b: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.w) + self.b

    def calibrated(self, rows: Rows) -> np.ndarray:
        return self.scale * self.logit(rows) + self.shift


def fit(rows: Rows, y: np.ndarray, dims: int, start: Linear | None = None, newton: int = 8, inner: int = 12, ridge: float = 3e-6) -> Linear:
    """Logistic regression with a ridge, both classes of equal weight in sum, by Newton's steps whose equations
    conjugate gradients solve."""
    w, b = (start.w.copy(), start.b) if start else (np.zeros(dims), 0.0)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def loss(w: np.ndarray, b: float) -> float:
        z = rows.dot(w) + b
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w @ w))

    at = loss(w, b)
    for _ in range(newton):
        p = _sigmoid(rows.dot(w) + b)
        g, s = (p - y) * share, p * (1 - p) * share + 1e-12
        gw, gb = rows.back(g, dims) + ridge * w, g.sum()
        dw, db, rw, rb = np.zeros(dims), 0.0, -gw, -gb
        pw, pb, rr = rw.copy(), rb, rw @ rw + rb * rb
        for _ in range(inner):
            u = s * (rows.dot(pw) + pb)
            hw, hb = rows.back(u, dims) + ridge * pw, u.sum()
            step = rr / max(1e-30, pw @ hw + pb * hb)
            dw, db, rw, rb = dw + step * pw, db + step * pb, rw - step * hw, rb - step * hb
            new = rw @ rw + rb * rb
            pw, pb, rr = rw + new / max(1e-30, rr) * pw, rb + new / max(1e-30, rr) * pb, new
        size = 1.0
        while size > 1e-3 and loss(w + size * dw, b + size * db) > at:
            size /= 2
        w, b = w + size * dw, b + size * db
        was, at = at, loss(w, b)
        if was - at < 1e-6:
            break
    return Linear(w, float(b))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Coefficients of a small logistic regression with an intercept (last), by Newton's steps, slightly shrunk."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1])
        w -= np.linalg.solve(h, a.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class Head:
    text: Linear
    meta: Linear
    join: np.ndarray

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """From the views' plain logits."""
        a = self.text.scale * text + self.text.shift
        b = self.meta.scale * meta + self.meta.shift
        return _sigmoid(self.join[0] * a + self.join[1] * b + self.join[2])


class Cotraining:
    """The two views of one head; held: labelled rows that only calibrate; raw: features of the labelled rows by view."""

    def __init__(self, y: np.ndarray, held: np.ndarray, raw: tuple[list[np.ndarray], list[np.ndarray]]):
        train = np.flatnonzero(~held)
        self.y, self.held = y, held
        self.sets = [([raw[v][i] for i in train], list(y[train])) for v in (0, 1)]
        self.checks = [Rows([raw[v][i] for i in np.flatnonzero(held)]) for v in (0, 1)]
        self.models: list[Linear | None] = [None, None]

    def fit(self) -> None:
        for v, dims in enumerate((1 << TEXT_BITS, 1 << META_BITS)):
            model = fit(Rows(self.sets[v][0]), np.array(self.sets[v][1], float), dims, self.models[v], newton=3 if self.models[v] else 8)
            scale, shift = logistic(model.logit(self.checks[v])[:, None], self.y[self.held])
            model.scale, model.shift = float(max(scale, 0.0)), float(shift)
            self.models[v] = model

    def hand(self, view: int, label: int, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Rows (both views' features) that one view is sure of, to the other one."""
        self.sets[1 - view][0].extend(x[1 - view] for x in rows)
        self.sets[1 - view][1].extend([label] * len(rows))

    def head(self) -> Head:
        both = np.column_stack([self.models[v].calibrated(self.checks[v]) for v in (0, 1)])
        join = logistic(both, self.y[self.held])
        if join[1] < 0:  # a view that would count against itself has nothing to say
            join = np.array([*logistic(both[:, :1], self.y[self.held]), 0.0])[[0, 2, 1]]
        return Head(self.models[0], self.models[1], join)


class Surest:
    """The `handed` surest rows, at least `least` sure, by head, view and label of what passes by; equal rows count
    once, `gone` ones not at all."""

    def __init__(self, models: dict[str, list[Linear]], gone: frozenset[bytes], handed: int = HANDED, least: float = SURE):
        self.models, self.gone, self.handed, self.least = models, gone, handed, least
        self.best: dict[tuple[str, int, int], dict[bytes, tuple]] = {}

    def add(self, text: list[np.ndarray], meta: list[np.ndarray]) -> None:
        digest = [xxhash.xxh3_128_digest(x.tobytes() + b"|" + m.tobytes()) for x, m in zip(text, meta, strict=True)]
        views = Rows(text), Rows(meta)
        for name, pair in self.models.items():
            for v in (0, 1):
                p = _sigmoid(pair[v].calibrated(views[v]))
                for label, sure in ((1, p), (0, 1 - p)):
                    held = self.best.setdefault((name, v, label), {})
                    order = np.argsort(-sure, kind="stable")[: 2 * self.handed]
                    for i in order[sure[order] >= self.least].tolist():
                        if digest[i] not in self.gone:
                            held[digest[i]] = (float(sure[i]), text[i], meta[i])
                    if len(held) > 2 * self.handed:
                        keep = sorted(held, key=lambda d: (-held[d][0], d))[:self.handed]
                        self.best[name, v, label] = {d: held[d] for d in keep}

    def rows(self) -> Iterator[tuple]:
        for (name, v, label), held in self.best.items():
            for d in sorted(held, key=lambda d: (-held[d][0], d))[:self.handed]:
                yield name, v, label, held[d][0], d, held[d][1].tobytes(), held[d][2].tobytes()


def _numbers(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column]


def featured(df: DataFrame, key: str = "doc_id", carry: bool = False) -> DataFrame:
    """__k (the key), __x and __m (features of the text and of the metadata, two bytes each) of every row, as a written
    table; carry: with the columns of df as __c0, __c1, ..."""
    small_batches(df.sparkSession)
    has = set(df.columns)
    column = lambda c: (F.col(f"`{c}`") if c in has else F.lit(None)).cast("string")
    text = text_or_empty()
    more = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(df.columns)] if carry else []
    source = df.select(F.col(f"`{key}`").alias("__k"), *more, text.alias("__t"), column("source").alias("__s"), column("lang").alias("__g"), F.length(text).cast("long").alias("__n"))
    names = source.columns[:-4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _slots.clear)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts, sources, langs, sizes = (c.to_pylist() for c in batch.columns[-4:])
                x = pa.array([text_features(t).tobytes() for t in texts], pa.binary())
                m = pa.array([meta_features(s, g, n).tobytes() for s, g, n in zip(sources, langs, sizes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-4], x, m], names=[*names, "__x", "__m"])
        trim()

    kinds = dict(source.dtypes)
    return Stored(source.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", __x binary, __m binary"), "features").df


def _surest(rows: DataFrame, models: dict[str, list[Linear]], gone: frozenset[bytes], handed: int = HANDED, least: float = SURE) -> list:
    """Of all rows, the `handed` surest by head, view and label: a bounded number from each task, then of those."""
    shipped = rows.sparkSession.sparkContext.broadcast((models, gone, handed, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Surest(*shipped.value)
        for batch in batches:
            found.add(_numbers(batch.column(0).to_pylist()), _numbers(batch.column(1).to_pylist()))
        cols = list(zip(*found.rows(), strict=True)) or [[]] * 7
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["head", "view", "label", "sure", "digest", "x", "m"])

    each = rows.select("__x", "__m").mapInArrow(run, "head string, view int, label int, sure double, digest binary, x binary, m binary").dropDuplicates(["head", "view", "label", "digest"])
    order = Window.partitionBy("head", "view", "label").orderBy(F.desc("sure"), "digest")
    best = each.withColumn("o", F.row_number().over(order)).where(F.col("o") <= handed).orderBy("head", "view", "label", "o").collect()
    shipped.unpersist()
    return best


def train(rows: DataFrame, labels: DataFrame, key: str = "doc_id", labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, Head]:
    """Fits on at most `labelled` labelled rows of featured(), those with the least hashes of their keys, and on what
    the views hand each other of all the rest, whatever its size.

    Only the features of these come to the driver. Labels that are null count as 0 for toxic and leave the row out for
    quality; repeated labels count each.
    """
    rank = F.xxhash64("__k", F.lit(17))
    lab = labels.select(F.col(f"`{key}`").alias("__k"), F.col("quality").cast("double").alias("quality"), F.coalesce(F.col("toxic").cast("double"), F.lit(0.0)).alias("toxic")).where("quality is not null and __k is not null")
    # bounded by the parameter, so small enough to broadcast
    chosen = lab.join(rows.select("__k").distinct(), "__k", "left_semi").orderBy(rank, "__k", "quality", "toxic").limit(labelled)
    picked = rows.select("__k", "__x", "__m").join(F.broadcast(chosen), "__k").orderBy("__k", "quality", "toxic", "__x").collect()
    raw = (_numbers(r["__x"] for r in picked), _numbers(r["__m"] for r in picked))
    held = np.arange(len(picked)) % 4 == 3
    heads, learning = {}, {}
    for name in HEADS:
        y = np.array([r[name] for r in picked], float)
        if len(y) < 8 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            # nothing to learn from: every document gets the share of the labels, or what lets it pass
            share = y.mean() if len(y) else float(name == "quality")
            share = min(max(share, 0.01), 0.99)
            none = Linear(np.zeros(1 << TEXT_BITS)), Linear(np.zeros(1 << META_BITS))
            heads[name] = Head(*none, np.array([0.0, 0.0, np.log(share / (1 - share))]))
        else:
            learning[name] = Cotraining(y, held, raw)
    gone = {xxhash.xxh3_128_digest(x.tobytes() + b"|" + m.tobytes()) for x, m in zip(*raw, strict=True)}
    for r in range(rounds + 1 if learning else 0):
        for one in learning.values():
            one.fit()
        if r == rounds:
            break
        best = _surest(rows, {n: one.models for n, one in learning.items()}, frozenset(gone))
        for name, one in learning.items():
            for v in (0, 1):
                for label in (0, 1):
                    some = [x for x in best if (x["head"], x["view"], x["label"]) == (name, v, label)]
                    one.hand(v, label, list(zip(_numbers(x["x"] for x in some), _numbers(x["m"] for x in some), strict=True)))
        gone |= {bytes(x["digest"]) for x in best}
    return heads | {name: one.head() for name, one in learning.items()}


def score(rows: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """Rows of featured() with quality_score and toxic_score (probabilities) for their features."""
    names = [c for c in rows.columns if c not in ("__x", "__m")]
    shipped = rows.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                text, meta = Rows(_numbers(batch.column(len(names)).to_pylist())), Rows(_numbers(batch.column(len(names) + 1).to_pylist()))
                out = [pa.array(h.probability(h.text.logit(text), h.meta.logit(meta)), pa.float64()) for h in (shipped.value[n] for n in HEADS)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *out], names=[*names, "quality_score", "toxic_score"])
        trim()

    kinds = dict(rows.dtypes)
    source = rows.select(*[F.col(n) for n in names], "__x", "__m")
    return source.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", quality_score double, toxic_score double")


@dataclass
class Limits:
    quality: float = 0.5
    toxic: float = 0.35


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", limits: Limits | None = None) -> DataFrame:
    """key, quality_score, toxic_score and keep of every row of df.

    A null or empty text is scored by its metadata and what an empty text shows; null metadata are values of their
    own. Repeated rows get equal scores. With labels of one class only, or too few, scores are the labels' share and
    with none all documents are kept. An empty table gives an empty one. Other columns are left out.
    """
    rows = featured(df, key)
    return score(rows, train(rows, labels, key)).select(F.col("__k").alias(key), "quality_score", "toxic_score", _passes(limits).alias("keep"))


def _passes(limits: Limits | None):
    limits = limits or Limits()
    return (F.col("quality_score") >= limits.quality) & (F.col("toxic_score") < limits.toxic)


def keep(df: DataFrame, labels: DataFrame, key: str = "doc_id", limits: Limits | None = None) -> DataFrame:
    """The rows of df that classify() keeps, with all their columns; no join is needed."""
    rows = featured(df, key, carry=True)
    passed = score(rows, train(rows, labels, key)).where(_passes(limits))
    return passed.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(df.columns)])
