"""Line dedup by winnowing over line hashes.

A gram is the shortest run of lines from a line on that has LEAST words. Of all grams within a window, the shortest
run that has SURE words, the one with the least hash is a fingerprint; so any repeated run of SURE words has one in
common with its copies. Positions are joined on fingerprints; where one occurs twice, the match is extended both ways:
the shortest runs of SURE words from each line on and up to each line that hold a repeated fingerprint are compared
whole, by 128 bits, each with the first place of that very run. A longer repeated run is the union of those in it, so
an extension goes on to the first unequal line, whichever earlier copy it is equal to. What is deleted is exactly this:
every line in any run of SURE words or more that also starts earlier in the order of rows and lines.

Only hashes of lines and their numbers of words travel; the text is read once for them, and once to be rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, small_batches, text_or_empty, trim

LEAST, SURE = 5, 10
ROWS = 256


def fingerprints(text: str, least: int = LEAST, sure: int = SURE) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Hashes of all lines; and (hash, first line, last line) of the fingerprints, by line."""
    lines = text.split("\n")
    hashes = [xxhash.xxh3_64_intdigest(x.strip().encode("utf-8", "surrogatepass")) for x in lines]
    upto = [0]
    for x in lines:
        upto.append(upto[-1] + len(x.split()))
    n, total = len(lines), upto[-1]
    if total < least:
        return hashes, []
    flat = np.array(hashes, np.uint64)
    grams: list[tuple[int, int]] = []  # hash, last line; for each line from which LEAST words follow
    end = 0
    for i in range(n):
        while end < n and upto[end + 1] - upto[i] < least:
            end += 1
        if end == n:
            break
        grams.append((xxhash.xxh3_64_intdigest(flat[i : end + 1].tobytes()), end))
    chosen: set[int] = set()
    queue: list[int] = []  # gram starts whose hashes rise; the front is the least of the window
    front = added = last = 0
    for i in range(n):
        while last < n and upto[last + 1] - upto[i] < sure:
            last += 1
        if last == n:
            if i:
                break
            last = n - 1  # fewer than SURE words in all: one window
        while added < len(grams) and grams[added][1] <= last:
            while len(queue) > front and grams[queue[-1]][0] >= grams[added][0]:
                queue.pop()
            queue.append(added)
            added += 1
        while queue[front] < i:
            front += 1
        chosen.add(queue[front])
    return hashes, [(grams[i][0], i, grams[i][1]) for i in sorted(chosen)]


def sure_runs(words: list[int], marks: list[tuple[int, int]], sure: int = SURE) -> list[tuple[int, int]]:
    """(first line, last line) of the shortest runs of SURE words from each line on, and up to each line, that hold one
    of the marked stretches (first line, last line); words: of each line."""
    upto = [0]
    for x in words:
        upto.append(upto[-1] + x)
    n, found = len(words), set()
    end = start = 0
    for i in range(n):
        while end < n and upto[end + 1] - upto[i] < sure:
            end += 1
        if end == n:
            break
        found.add((i, end))
    for j in range(n):
        if upto[j + 1] >= sure:
            while upto[j + 1] - upto[start + 1] >= sure:
                start += 1
            found.add((start, j))
    # the least end of a mark that begins at each line or later
    least = [n] * (n + 1)
    for i, e in marks:
        least[i] = min(least[i], e)
    for i in range(n - 1, -1, -1):
        least[i] = min(least[i], least[i + 1])
    return [(i, j) for i, j in sorted(found) if least[i] <= j]


def _lists(values: list, kind: type) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(x) for x in values], out=offsets[1:])
    flat = np.array([y for x in values for y in x], kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if kind is np.uint64 else flat))


def _lines(source: DataFrame, least: int, sure: int) -> DataFrame:
    """k, h, hashes and words of the lines, and fp, at, to of the fingerprints, of rows (k, h, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                hashes, words, prints = [], [], []
                for text in batch.column(2).to_pylist():
                    h, found = fingerprints(text, least, sure)
                    hashes.append(h)
                    words.append([len(x.split()) for x in text.split("\n")])
                    prints.append(found)
                columns = [_lists([[x[c] for x in found] for found in prints], kind) for c, kind in enumerate((np.uint64, np.int32, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(hashes, np.uint64), _lists(words, np.int32), *columns], names=["k", "h", "hashes", "words", "fp", "at", "to"])
        trim()

    return source.mapInArrow(run, f"k {source.dtypes[0][1]}, h bigint, hashes array<bigint>, words array<int>, fp array<bigint>, at array<int>, to array<int>")


def _runs(marked: DataFrame, sure: int) -> DataFrame:
    """a, b (128 bits that stand for its lines), k, h, lo, hi of the runs of SURE words that hold a repeated
    fingerprint; marked: k, h, hashes, words, marks (array of struct<at, to>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lo, hi, digest = [], [], [], []
            for k, (hashes, words, marks) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                flat = np.array(hashes, np.int64)
                for i, j in sure_runs(words, [(m["at"], m["to"]) for m in marks], sure):
                    row.append(k)
                    lo.append(i)
                    hi.append(j)
                    digest.append(xxhash.xxh3_128_digest(flat[i : j + 1].tobytes()))
            ab = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ab[:, 0]), pa.array(ab[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["a", "b", "k", "h", "lo", "hi"]
            )

    return marked.mapInArrow(run, f"a bigint, b bigint, k {dict(marked.dtypes)['k']}, h bigint, lo int, hi int")


def _rebuilt(joined: DataFrame, at: int) -> DataFrame:
    """joined's columns with column number `at`, the text, without the lines from __lo to __hi; n_lines, n_removed."""
    names = joined.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts, total, gone = batch.column(at).to_pylist(), [], []
                for row, (lo, hi) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                    total.append(texts[row].count("\n") + 1)
                    gone.append(0)
                    if lo:
                        keep = np.ones(total[-1], bool)
                        for x, y in zip(lo, hi, strict=True):
                            keep[x : y + 1] = False
                        texts[row] = "\n".join([x for x, y in zip(texts[row].split("\n"), keep, strict=True) if y])
                        gone[-1] = int(total[-1] - keep.sum())
                columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_removed"])

    kinds = dict(joined.dtypes)
    return joined.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", n_lines bigint, n_removed bigint")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, sure: int = SURE) -> DataFrame:
    """df with text without its repeated lines, and __n_lines and __n_removed.

    Every line goes that lies in a run of lines of SURE words or more which also starts earlier, in the order of key
    (null first), hash of the text and line. Lines are compared without the white space at their ends. A null or empty
    text is one empty line and stays (null becomes empty). Rows equal in key and text are one row for this, so one
    repeated in full does not delete its twin; rows of one key, or of no key, with different texts are rows of their
    own. A document all of whose lines are repeats gets an empty text; the row stays. An empty table gives an empty
    one. Other columns pass through, whatever their names; columns named __n_lines and __n_removed are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = df.drop("__n_lines", "__n_removed")
    h = F.xxhash64(text_or_empty(f"`{text}`"))
    lines = Stored(_lines(own.select(F.col(f"`{key}`").alias("k"), h.alias("h"), text_or_empty(f"`{text}`").alias("t")), least, sure), "lines").df
    # counts are combined on the map side, so a frequent line is a row a task. They are written down, so that the join with
    # them stands in a stage of its own, whose hot keys adaptive execution splits
    prints = lines.select("k", "h", F.explode(F.arrays_zip("fp", "at", "to")).alias("x")).select("k", "h", F.col("x.fp").alias("fp"), F.struct("x.at", "x.to").alias("mark"))
    again = Stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "again").df
    marks = prints.join(again, "fp").groupBy("k", "h").agg(F.collect_set("mark").alias("marks")).withColumnsRenamed({"k": "mk", "h": "mh"})
    marked = lines.dropDuplicates(["k", "h"]).join(marks, F.col("k").eqNullSafe(F.col("mk")) & (F.col("h") == F.col("mh"))).select("k", "h", "hashes", "words", "marks")
    runs = Stored(_runs(marked, sure), "runs").df
    first = Stored(runs.groupBy("a", "b").agg(F.min(F.struct("k", "h", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first"), "first").df
    later = runs.join(first, ["a", "b"]).where(~F.struct("k", "h", "lo").eqNullSafe(F.col("first")))
    gone = later.groupBy("k", "h").agg(F.collect_list("lo").alias("__at"), F.collect_list("hi").alias("__to")).withColumnsRenamed({"k": "__gk", "h": "__gh"})
    at = own.columns.index(text)
    named = own.select(*[(text_or_empty(f"`{c}`") if k == at else F.col(f"`{c}`")).alias(f"__c{k}") for k, c in enumerate(own.columns)], h.alias("__h"))
    own_key = F.col(f"__c{own.columns.index(key)}")
    joined = named.join(gone, own_key.eqNullSafe(F.col("__gk")) & (F.col("__h") == F.col("__gh")), "left")
    made = _rebuilt(joined.select(*[f"__c{k}" for k in range(len(own.columns))], "__at", "__to"), at)
    return made.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(own.columns)], F.col("n_lines").alias("__n_lines"), F.col("n_removed").alias("__n_removed"))


def report(deduped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return deduped.select(key, F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))


#: All runs by themselves, without fingerprints: a line goes if a run of SURE words that holds it starts earlier too.
ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM documents),
w AS (SELECT *, list_transform(ls, lambda x: len(regexp_extract_all(x, '\S+'))) AS n FROM l),
c AS (SELECT *, list_transform(range(0, len(n) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)) AS upto FROM w),
i AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM c),
r AS (
  SELECT doc_id, i AS lo, list_position(list_transform(upto, lambda u: u >= upto[i] + {SURE}), true) - 1 AS hi, ls FROM i
  UNION ALL SELECT doc_id, len(list_filter(upto, lambda u: u <= upto[i + 1] - {SURE})), i, ls FROM i),
d AS (SELECT DISTINCT doc_id, lo, hi, array_to_string(ls[lo:hi], chr(10)) AS run FROM r WHERE lo > 0 AND hi >= lo),
k AS (SELECT doc_id, lo, hi FROM d QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, lo) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM k),
s AS (
  SELECT i.doc_id, len(any_value(raw)) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(raw[i.i], chr(10) ORDER BY i.i) FILTER (g.i IS NULL), '') AS kept
  FROM i LEFT JOIN g ON g.doc_id = i.doc_id AND g.i = i.i GROUP BY i.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM s
"""
