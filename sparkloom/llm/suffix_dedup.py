"""Suffix-array dedup by a depth-limited radix sort.

The suffixes of all documents are ordered by their first DEPTH bytes only, most significant digit first; groups that
are equal after the last digit are exactly the windows that repeat. Moving every suffix for every digit would cost many
times the corpus, so a digit is a stretch of bytes chosen by content, and whole groups are settled as early as they can:

1. Each window of 50 bytes names an anchor, a stretch of 31 bytes in it, by the least hash of its 11-byte stretches
   (taken modulo 20); equal windows name the same one. About one position in eighteen is an anchor. The first digit is
   the anchor (40 bits of a hash and the bucket's number; a collision only sends more to step 3); suffixes whose anchor
   no other context has are settled.
2. The second digit is the anchor's context, all bytes of the windows that name it, as 80 more bits. Within equal
   contexts every window repeats in the least document: the others are removed there.
3. Only where an anchor has several contexts, as at the ends of repeated passages, the windows themselves are sorted,
   by the 80 bits of a hash of all their bytes within the buckets of another, and those that also start in a lesser
   document are removed.

Suffixes travel as packed arrays by bucket of their digit, so that one task holds a bucket of bounded size. Each step
first settles what one batch of documents can, so that of a passage that most documents hold only one occurrence a
batch moves: a hot digit is one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, low_bytes, number, packed, release, small_batches, text_or_empty, trim

DEPTH, ANCHOR, SPACING, SEED = 50, 31, 20, 11
#: Bytes that are hashed at a time, and window starts of one piece of a long text.
PIECE = 1 << 20
ROWS = 512
#: Characters of text that are looked at together, and settled among themselves first.
GROUP = 12 << 20
#: Characters of text to a bucket of digits, and the least and greatest number of buckets.
BUCKET_BYTES, BUCKETS = 8 << 20, (64, 1 << 18)
_LOW = np.uint64((1 << 28) - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C[3]
    x = (x ^ (x >> np.uint64(29))) * _C[4]
    return x ^ (x >> np.uint64(32))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 8 and the 4 bytes from each position on, as numbers; past the end come zeros."""
    one = np.frombuffer(data + b"\0" * 16, np.uint8).astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    return eight[: len(data) + 8], four[: len(data) + 8]


def anchors(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie in data: each anchor's hash, its context's two hashes, its text, and its first and last window."""
    eight, four = _words(data)
    n = len(data) - SEED + 1
    h = eight[:n] * _C[0] ^ four[SEED - 4 : SEED - 4 + n] * _C[1]
    h = (h ^ (h >> np.uint64(29))) * _C[2]
    v = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    # least of 40 neighbours by doubling
    least, m8 = v, None
    for k in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-k], least[k:])
        if k == 4:
            m8 = least
    least = np.minimum(least[: len(m8) - 32], m8[32:])
    count = np.maximum(0, sizes - DEPTH + 1)
    owner = np.repeat(np.arange(len(starts)), count)
    w = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    at = (least[w] & _LOW).astype(np.int64)
    at -= np.where(at - w >= SPACING, SPACING, 0)
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[cut[1:], len(at)] - 1
    a, lo, hi, who = at[cut], w[cut], w[last], owner[cut]
    order = np.argsort(a, kind="stable")
    a, lo, hi, who = a[order], lo[order], hi[order], who[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    a, who = a[first], who[first]
    key = eight[a]
    for k in (8, 16, ANCHOR - 8):
        key = _mix(key * _C[0] + eight[a + k])
    end = hi + DEPTH
    size = ((a - lo) << 8 | (end - lo)).astype(np.uint64)
    x, y = size * _C[4], size ^ _C[5]
    for k in range(0, DEPTH + SPACING, 8):
        inside = lo + k + 8 <= end
        word = eight[np.where(inside, lo + k, 0)]
        x, y = np.where(inside, _mix(x * _C[1] + word), x), np.where(inside, _mix(y * _C[3] + (word ^ _C[0])), y)
    word = eight[end - 8]
    return key, _mix(x * _C[2] + word), _mix(y * _C[5] + (word ^ _C[1])), who, lo, hi


def _first_of_batch(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences: which repeat in a lesser document here, and which are in the least one."""
    order = np.lexsort([doc, *keys[::-1]])
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    start = np.flatnonzero(new)
    least = np.repeat(doc[order][start], np.diff(np.r_[start, len(doc)]))
    again = np.zeros(len(doc), bool)
    again[order] = doc[order] > least
    return again, ~again


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching and overlapping stretches of each document as one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort([lo, doc])
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    # ends so far, restarted with each document
    shift = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new[1:] = lo[1:] + shift[1:] > reach[:-1]
    start = np.flatnonzero(new)
    return doc[start], lo[start], np.maximum.reduceat(hi, start)


def _dealt(buckets: int, digit: np.ndarray, keys: list[tuple[np.ndarray, int]], doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch | None:
    """bucket, base, widths, data: occurrences by bucket of their digit; keys: numbers and how many bytes of them go."""
    if not len(doc):
        return None
    bucket = (digit >> np.uint64(40)) & np.uint64(buckets - 1)
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    base = int(doc.min())
    wide = [max(1, (int(x).bit_length() + 7) // 8) for x in (int(doc.max()) - base, pos.max())]
    rows = np.hstack([low_bytes(x[order], n) for x, n in [*keys, (doc.view(np.uint64) - np.uint64(base % (1 << 64)), wide[0]), (pos, wide[1])]])
    count = np.bincount(bucket.astype(np.int64), minlength=buckets)
    there = np.flatnonzero(count)
    many = len(there)
    return pa.RecordBatch.from_arrays(
        [pa.array(there.astype(np.int32)), pa.array(np.full(many, base)), pa.array(np.full(many, wide[0] << 8 | wide[1], np.int32)), packed(rows, np.cumsum(count[there]))], names=["bucket", "base", "widths", "data"]
    )


def _settled(buckets: int, at: int, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """The same columns, of stretches to remove; they pass through the sort (bucket < 0)."""
    rows = np.hstack([low_bytes(x.view(np.uint64), 8) for x in (doc, lo.astype(np.int64), hi.astype(np.int64))])
    return pa.RecordBatch.from_arrays(
        [pa.array([-1 - at % buckets], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), packed(rows, np.array([len(doc)]))], names=["bucket", "base", "widths", "data"]
    )


DEALT = "bucket int, base bigint, widths int, data binary"


def _in_buckets(dealt: DataFrame, sort, keys: list[int], schema: str) -> DataFrame:
    """sort(the keys, doc, pos of all occurrences of a bucket) gives a batch of schema: doc, lo, hi and more."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        now = None

        def finish() -> Iterator[pa.RecordBatch]:
            columns: list[list[np.ndarray]] = [[] for _ in range(len(keys) + 2)]
            for base, widths, data in held:
                each = [*keys, widths >> 8, widths & 255]
                rows = np.frombuffer(data, np.uint8).reshape(-1, sum(each))
                at = 0
                for k, n in enumerate(each):
                    x = number(rows[:, at : at + n])
                    columns[k].append((x + np.uint64(base % (1 << 64))).view(np.int64) if k == len(keys) else x)
                    at += n
            found = sort(*[np.concatenate(c) for c in columns])
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

        for batch in batches:
            for bucket, base, widths, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if bucket < 0:
                    d, lo, hi = np.frombuffer(data, np.int64).reshape(-1, 3).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (d, lo, hi, *[np.zeros(len(d), np.int32)] * (len(names) - 3))], names=names)
                    continue
                if bucket != now and held:
                    yield from finish()
                    held = []
                now = bucket
                held.append((base, widths, data))
        if held:
            yield from finish()
        trim()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of rows whose texts (the second column) have GROUP characters together, or a little more."""
    held: list[list] = []
    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            columns = [c.to_pylist() for c in whole.slice(at, 256).columns]
            held = [h + c for h, c in zip(held, columns, strict=True)] if held else columns
            size += sum(map(len, columns[1]))
            if size >= GROUP:
                yield held
                held, size = [], 0
    if held:
        yield held


def _digits(source: DataFrame, buckets: int) -> DataFrame:
    """Anchors (pos: first window << 7 | number of windows - 1) by bucket, and what the batch has settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number_, (ids, texts) in enumerate(_grouped(batches)):
            ids = np.array(ids, np.int64)
            parts: list[tuple[np.ndarray, ...]] = []
            held: list[bytes] = []
            begins: list[int] = []
            owners: list[tuple[int, int]] = []

            def flush(parts=parts, held=held, begins=begins, owners=owners) -> None:
                if held:
                    starts, sizes = np.array(begins), np.array([len(x) for x in held])
                    key, x, y, who, lo, hi = anchors(b"".join(held), starts, sizes)
                    own = np.array(owners)
                    parts.append((key, x, y & np.uint64(0xFFFF), own[who, 0], lo - starts[who] + own[who, 1], hi - lo))
                for x in (held, begins, owners):
                    x.clear()

            size = 0
            for row, text in enumerate(texts):
                data = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(data) - DEPTH + 1, PIECE):
                    piece = data[at : at + PIECE + DEPTH - 1]
                    begins.append(size)
                    held.append(piece)
                    owners.append((row, at))
                    size += len(piece)
                    if size >= PIECE:
                        flush()
                        size = 0
            flush()
            if not parts:
                continue
            key, x, y, row, lo, more = (np.concatenate(c) for c in zip(*parts, strict=True))
            doc = ids[row]
            again, keep = _first_of_batch([key, x, y], doc)
            # stretches are joined by their windows, not their bytes: a window that bridges two of them may be new
            d, a, b = _merged(doc[again], lo[again], (lo + more + 1)[again])
            if len(d):
                yield _settled(buckets, number_, d, a, b + DEPTH - 1)
            out = _dealt(buckets, key[keep], [(key[keep], 5), (x[keep], 8), (y[keep], 2)], doc[keep], (lo[keep] << 7) | more[keep])
            if out is not None:
                yield out
        trim()

    return source.mapInArrow(run, DEALT)


def _sort_digits(digits: DataFrame) -> DataFrame:
    """doc, lo, hi, fine: stretches to remove (fine 0), and first and last windows that need the last step (fine 1)."""

    def sort(key: np.ndarray, x: np.ndarray, y: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        # anchors that occur once are settled, before the longer digits are looked at
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        key, x, y, doc, pos = key[order], x[order], y[order], doc[order], pos[order].astype(np.int64)
        order = np.lexsort([doc, y, x, key])
        key, x, y, doc, pos = key[order], x[order], y[order], doc[order], pos[order]
        new_key = np.r_[True, key[1:] != key[:-1]][: len(key)]
        new = new_key | np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(key)]
        start, start_key = np.flatnonzero(new), np.flatnonzero(new_key)
        if not len(start):
            return doc, pos, pos, np.zeros(0, np.int32)
        least = np.repeat(doc[start], np.diff(np.r_[start, len(doc)]))
        several = np.repeat(np.add.reduceat(new.astype(np.int64), start_key) > 1, np.diff(np.r_[start_key, len(doc)]))
        lo, hi = pos >> 7, (pos >> 7) + (pos & 127)
        again = doc > least
        fine = ~again & several
        return (
            np.concatenate([doc[again], doc[fine]]),
            np.concatenate([lo[again], lo[fine]]),
            np.concatenate([hi[again] + DEPTH, hi[fine]]),
            np.repeat(np.array([0, 1], np.int32), [int(again.sum()), int(fine.sum())]),
        )

    return _in_buckets(digits, sort, [5, 8, 2], "doc bigint, lo bigint, hi bigint, fine int")


def _windows(source: DataFrame, buckets: int) -> DataFrame:
    """The windows that are left to sort, by bucket of their hash, and what the batch has settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number_, (ids, texts, los, his, fines) in enumerate(_grouped(batches)):
            parts = []
            ids = np.array(ids, np.int64)
            for row, text in enumerate(texts):
                data = text.encode("utf-8", "surrogatepass")
                lo, hi, fine = (np.array(x[row], np.int64) for x in (los, his, fines))
                mark = np.zeros(len(data) + 2, np.int32)
                np.add.at(mark, lo[fine == 1], 1)
                np.add.at(mark, hi[fine == 1] + 1, -1)
                wanted = np.cumsum(mark)[: max(0, len(data) - DEPTH + 1)] > 0
                # a window inside one stretch that goes also starts in a lesser document; one that bridges two may be
                # the first of its kind, to which later documents are compared
                gone = np.zeros(len(data) + 2, np.int32)
                np.add.at(gone, lo[fine == 0], 1)
                np.add.at(gone, hi[fine == 0] - DEPTH + 1, -1)
                w = np.flatnonzero(wanted & (np.cumsum(gone)[: len(wanted)] == 0))
                if len(w):
                    eight, _ = _words(data)
                    x, y = eight[w], eight[w] ^ _C[5]
                    for k in (8, 16, 24, 32, 40, DEPTH - 8):
                        x, y = _mix(x * _C[0] + eight[w + k]), _mix(y * _C[1] + (eight[w + k] ^ _C[2]))
                    parts.append((x, y, np.full(len(w), ids[row]), w))
            if not parts:
                continue
            x, y, doc, w = (np.concatenate(c) for c in zip(*parts, strict=True))
            again, keep = _first_of_batch([x, y], doc)
            if again.any():
                yield _settled(buckets, number_, *_merged(doc[again], w[again], w[again] + DEPTH))
            out = _dealt(buckets, y[keep], [(x[keep], 8), (y[keep], 2)], doc[keep], w[keep])
            if out is not None:
                yield out
        trim()

    return source.mapInArrow(run, DEALT)


def _sort_windows(windows: DataFrame) -> DataFrame:
    def sort(x: np.ndarray, y: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(x, kind="stable")
        s = x[order]
        same = s[1:] == s[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        x, y, doc, pos = x[order], y[order], doc[order], pos[order].astype(np.int64)
        order = np.lexsort([doc, y, x])
        x, y, doc, pos = x[order], y[order], doc[order], pos[order]
        start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)])
        if not len(start):
            return doc, pos, pos
        again = doc > np.repeat(doc[start], np.diff(np.r_[start, len(doc)]))
        return _merged(doc[again], pos[again], pos[again] + DEPTH)

    return _in_buckets(windows, sort, [8, 2], "doc bigint, lo bigint, hi bigint")


def dedup_substrings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (binary) of every row.

    Bytes go that a window of 50 bytes covers which also starts in a document of a lesser key; windows never cross
    documents, and all are judged on the input. A null text counts as empty; texts below 50 bytes stay whole. Rows of
    one key are one document and should have one text; they remove nothing from each other. Rows of a null key stay
    whole and remove nothing. An empty table gives an empty one; other columns are left out.
    """
    source = df.select(F.col(f"`{key}`").cast("long").alias("k"), text_or_empty(f"`{text}`").alias("t"))
    spark = df.sparkSession
    small_batches(spark)
    total = source.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = BUCKETS[0]
    while buckets < BUCKETS[1] and buckets * BUCKET_BYTES < total:
        buckets *= 2
    sorted_ = Stored(_sort_digits(_digits(source.where("k is not null"), buckets)), "digits").df
    release(spark)
    todo = sorted_.groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"), F.collect_list("fine").alias("fine"))
    left = source.join(todo, source["k"] == todo["doc"]).where(F.array_contains("fine", 1)).select("k", "t", "lo", "hi", "fine")
    windows = Stored(_sort_windows(_windows(left, buckets)), "windows").df
    release(spark)
    gone = sorted_.where("fine = 0").select("doc", "lo", "hi").union(windows).groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    final = source.join(gone, source["k"] == gone["doc"], "left").select("k", "t", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = []
                for row in range(batch.num_rows):
                    data = batch.column(1)[row].as_py().encode("utf-8", "surrogatepass")
                    lo, hi = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                    if not lo:
                        rows.append((len(data), 0, 0, data))
                        continue
                    _, a, b = _merged(np.zeros(len(lo), np.int64), np.array(lo), np.array(hi))
                    kept, done = [], 0
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        kept.append(data[done:x])
                        done = y
                    kept.append(data[done:])
                    rows.append((len(data), int((b - a).sum()), len(a), b"".join(kept)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    return final.mapInArrow(run, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def report(deduped: DataFrame, key: str = "doc_id") -> DataFrame:
    return deduped.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows by themselves, as hexadecimal digits; no anchors.
ORACLE_SQL = rf"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, {2 * DEPTH}) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - {DEPTH - 1}))) AS pos FROM h)),
f AS (SELECT w, min(doc_id) AS least FROM p GROUP BY w HAVING count(*) > 1),
g AS (SELECT doc_id, pos FROM p JOIN f USING (w) WHERE doc_id > least),
n AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > {DEPTH}, true) AS new FROM g),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM n),
s AS (SELECT doc_id, span, min(pos) AS lo, max(pos) + {DEPTH} AS hi FROM i GROUP BY doc_id, span),
e AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS done FROM s),
k AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * done + 1, 2 * (lo - done)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM e JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id
"""
