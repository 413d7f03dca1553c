"""N-gram Jaccard join: an exact metric-space join with pivots, Voronoi regions, triangle windows and recursion.

Nearly all pairs of documents are at Jaccard distance 1, where pivots tell nothing apart. So the space is first cut
where distances are below 1, by exact counts over the whole corpus:

1. Every shingle is counted. In one order of all shingles, rarest first, two documents at distance 0.2 or less share
   one of their first n - ceil(0.8 n) + 1 (n: the size of the set). A shingle that one document alone holds links
   nothing, so a document is a suspect only if repeated shingles reach into these first ones. Counts travel as packed
   arrays of 40-bit remainders by bucket, and what comes back to a document are its repeated shingles; as only these
   can be in an intersection, they and n give the exact similarity.
2. Suspects that share one of their first repeated shingles make a block (a connected component); links are within
   blocks only. Equal sets are one class, of which one row stands for all.
3. Within a block, members are drawn as pivots; each document belongs to the Voronoi region of its nearest pivot if
   that is within RADIUS, and to the rest otherwise. By the triangle inequality a document can link into the region
   of pivot p only if its distance to p is at most its own least distance + 0.4 and at most RADIUS + 0.2, and into the
   rest only if its least distance is above RADIUS - 0.2: those boundary documents are replicated. Regions are joined
   recursively the same way, and small ones by search over an index of their shingles.
4. Blocks above LARGE members are divided before any task holds them whole: by the first shingles that members share,
   then by pivots, each where that halves the work (the sum of squared sizes) at least. What still is larger, as a
   large group of near copies, is first joined by links to pivots; then only the members outside of its main component
   are searched for, in chunks, against shares of all members. So a task holds at most 2 * LARGE members or so.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, claim, low_bytes, number, packed, release, small_batches, text_or_empty, trim

WORDS = 5
#: A link needs NEAR[0] * union <= NEAR[1] * intersection; at most this distance.
NEAR = (4, 5)
REACH = 1 - NEAR[0] / NEAR[1]
#: Documents farther than this from all pivots are the rest.
RADIUS = 0.6
PIVOTS = 24
#: Members that are joined by search at once, and members that one task takes of a block.
LEAF, LARGE = 48, 8192
#: Of a shingle's 64 bits: so many travel, besides the number of its bucket.
LOW = np.uint64(40)
#: Bytes of text to a bucket of shingles, and the least and greatest number of buckets.
BUCKET_BYTES, BUCKETS = 8 << 20, (64, 1 << 18)
CACHE_ENTRIES = 50_000
ROWS = 512


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of the whole sequence if there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    out = h[:n] * _POWERS[0]
    for k in range(1, WORDS):
        out += h[k : k + n] * _POWERS[k]
    return np.unique(_mix(out))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(x) for x in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _emitted(source: DataFrame, buckets: int) -> DataFrame:
    """bucket, batch, data: for each batch of documents its shingles by bucket (5 bytes each, and 2 that number the
    document); and one row a document (bucket < 0) with idx, k, n, a, b (128 bits that stand for the set)."""
    flush_at = min(max(1 << 18, buckets << 10), 1 << 22)
    kind = source.schema["k"].dataType.simpleString()
    schema = f"bucket int, batch bigint, data binary, idx int, k {kind}, n bigint, a bigint, b bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", _hashes.clear)
        part, made = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        keys: list[pa.Array] = []
        linkable: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            batch, rows = part << 20 | made, len(held)
            made += 1
            size = np.array([len(x) for x in held])
            ab = np.frombuffer(b"".join(blake2b(x.tobytes(), digest_size=16).digest() for x in held), np.int64).reshape(-1, 2)
            k = pa.concat_arrays(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, -1 - (part + made) % buckets, np.int32)), pa.array(np.full(rows, batch)), pa.nulls(rows, pa.binary()), pa.array(np.arange(rows, dtype=np.int32)), k, pa.array(size), pa.array(ab[:, 0]), pa.array(ab[:, 1])],
                names=["bucket", "batch", "data", "idx", "k", "n", "a", "b"],
            )
            ok = np.repeat(np.concatenate(linkable), size)
            h, idx = np.concatenate(held)[ok], np.repeat(np.arange(rows), size)[ok]
            bucket = (h >> LOW).astype(np.uint64) & np.uint64(buckets - 1)
            order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
            count = np.bincount(bucket.astype(np.int64), minlength=buckets)
            there = np.flatnonzero(count)
            data = packed(np.hstack([low_bytes(h[order], 5), low_bytes(idx[order], 2)]), np.cumsum(count[there]))
            many = len(there)
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), pa.array(np.full(many, batch)), data, pa.nulls(many, pa.int32()), pa.nulls(many, k.type), *[pa.nulls(many, pa.int64())] * 3],
                names=["bucket", "batch", "data", "idx", "k", "n", "a", "b"],
            )
            for x in (held, keys, linkable):
                x.clear()

        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sets = [shingles(x) for x in batch.column(1).to_pylist()]
                held += sets
                keys.append(batch.column(0))
                linkable.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
                size += sum(map(len, sets))
                if size >= flush_at or len(held) + ROWS > 1 << 16:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        trim()

    return source.mapInArrow(run, schema)


def _counted(emitted: DataFrame) -> DataFrame:
    """The same rows, with only the shingles that two documents hold, and 2 bytes of their number of documents."""
    names = emitted.columns
    schema = emitted.schema

    def repeated(rows: list[tuple[int, bytes]], bucket: int) -> Iterator[pa.RecordBatch]:
        size = np.array([len(d) // 7 for _, d in rows])
        raw = np.frombuffer(b"".join(d for _, d in rows), np.uint8).reshape(-1, 7)
        h, source = number(raw[:, :5]), np.repeat(np.arange(len(rows)), size)
        order = np.argsort(h, kind="stable")
        s = h[order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        df = np.diff(np.r_[start, len(s)])
        df = np.repeat(df, df)
        order, df = order[df > 1], df[df > 1]
        if not len(order):
            return
        back = np.argsort(order, kind="stable")
        order, df = order[back], np.minimum(df[back], 65_535)
        data = np.hstack([raw[order], low_bytes(df, 2)])
        count = np.bincount(source[order], minlength=len(rows))
        there = np.flatnonzero(count)
        many = len(there)
        batch = np.array([b for b, _ in rows])[there]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(many, bucket, np.int32)), pa.array(batch), packed(data, np.cumsum(count[there])), *[pa.nulls(many, kinds[c]) for c in names[3:]]], names=names
        )

    kinds: dict[str, pa.DataType] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:
            kinds.update({f.name: f.type for f in batch.schema})
            bucket = batch.column(0).to_numpy()
            own = bucket < 0
            if own.any():
                yield batch.filter(pa.array(own))
            rest = batch.filter(pa.array(~own))
            for b, i, data in zip(bucket[~own].tolist(), rest.column(1).to_pylist(), rest.column(2).to_pylist(), strict=True):
                if b != now and held:
                    yield from repeated(held, now)
                    held = []
                now = b
                held.append((i, data))
        if held:
            yield from repeated(held, now)
        trim()

    return emitted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _described(counted: DataFrame) -> DataFrame:
    """rid (a number of the row), k, n, a, b, and of suspects first (the repeated ones of the first shingles) and
    shared (all that are repeated)."""
    kind = counted.schema["k"].dataType.simpleString()

    def finish(batch: int, docs: list[pa.RecordBatch], parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
        table = pa.Table.from_batches(docs).combine_chunks().sort_by("idx").to_batches()[0]
        n = table.column(5).to_numpy()
        empty = [np.zeros(0, np.int64)] * len(n)
        first, shared = list(empty), list(empty)
        if parts:
            raw = np.frombuffer(b"".join(d for _, d in parts), np.uint8).reshape(-1, 9)
            bucket = np.repeat(np.array([b for b, _ in parts], np.uint64), [len(d) // 9 for _, d in parts])
            g, idx, df = (number(raw[:, :5]) | bucket << LOW).astype(np.int64), number(raw[:, 5:7]).astype(np.int64), number(raw[:, 7:]).astype(np.int64)
            order = np.lexsort([g, df, idx])
            g, count = g[order], np.bincount(idx, minlength=len(n))
            end = np.cumsum(count)
            reach = n - (NEAR[0] * n + NEAR[1] - 1) // NEAR[1] + 1 - (n - count)
            for i in np.flatnonzero((reach > 0) & (count > 0)):
                own = g[end[i] - count[i] : end[i]]
                first[i] = own[: reach[i]]
                shared[i] = np.sort(own)
        rid = pa.array((batch << 16) + table.column(3).to_numpy().astype(np.int64))
        return pa.RecordBatch.from_arrays([rid, *[table.column(c) for c in range(4, 8)], _lists(first), _lists(shared)], names=["rid", "k", "n", "a", "b", "first", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[pa.RecordBatch] = []
        parts: list[tuple[int, bytes]] = []
        now = None
        for block in batches:
            ids = block.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if now is not None and ids[lo] != now:
                    yield finish(now, docs, parts)
                    docs, parts = [], []
                now = int(ids[lo])
                some = block.slice(lo, hi - lo)
                own = some.column(0).to_numpy() < 0
                if own.any():
                    docs.append(some.filter(pa.array(own)))
                rest = some.filter(pa.array(~own))
                parts += zip(rest.column(0).to_pylist(), rest.column(2).to_pylist(), strict=True)
        if now is not None:
            yield finish(now, docs, parts)
        trim()

    return counted.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, f"rid bigint, k {kind}, n bigint, a bigint, b bigint, first array<bigint>, shared array<bigint>")


def describe(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, k, n, a, b, first and shared of every row of df: see _described."""
    source = df.select(F.col(f"`{key}`").alias("k"), text_or_empty(f"`{text}`").alias("t"))
    total = source.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = BUCKETS[0]
    while buckets < BUCKETS[1] and buckets * BUCKET_BYTES < total:
        buckets *= 2
    return _described(_counted(_emitted(source, buckets)))


def components(links: DataFrame) -> DataFrame:
    """k, c: the least number that each linked one reaches. Labels fall along links, then to the label's own label."""
    edges = Stored(links.select("x", "y").union(links.select("y", "x")).distinct(), "links")
    labels = Stored(edges.df.groupBy(F.col("x").alias("k")).agg(F.min(F.least("x", "y")).alias("c")), "labels")
    while True:
        near = edges.df.join(labels.df, edges.df["y"] == labels.df["k"]).groupBy("x").agg(F.min("c").alias("m"))
        step = labels.df.join(near, labels.df["k"] == near["x"]).select("k", "c", F.least("c", "m").alias("m"))
        jump = labels.df.select(F.col("k").alias("j"), F.col("c").alias("cc"))
        after = Stored(step.join(jump, step["m"] == jump["j"]).select("k", F.col("c").alias("was"), F.least("m", "cc").alias("c")), "labels")
        moved = after.df.where("c <> was").limit(1).count()
        labels.drop()
        labels = Stored.of(after, after.df.select("k", "c"))
        if not moved:
            edges.drop()
            return labels.df


def index_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles in order, and the number of the set of each."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order]


def found(index: tuple[np.ndarray, np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all occurrences in the index of all of flat: which of flat, and the numbers of the sets."""
    lo, hi = np.searchsorted(index[0], flat, "left"), np.searchsorted(index[0], flat, "right")
    m = hi - lo
    at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
    return np.repeat(np.arange(len(flat)), m), index[1][at]


def distances(sets: list[np.ndarray], n: np.ndarray, pivots: tuple[np.ndarray, np.ndarray], pn: np.ndarray) -> np.ndarray:
    """Jaccard distances of all sets (their repeated shingles and whole sizes) to all pivots (their index and sizes)."""
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    which, pivot = found(pivots, flat)
    same = np.bincount(of[which] * len(pn) + pivot, minlength=len(sets) * len(pn)).reshape(len(sets), len(pn))
    return 1 - same / np.maximum(1, n[:, None] + pn[None, :] - same)


def separated(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Numbers of the sets that make good pivots: in order, those farther than RADIUS from all taken before."""
    d, taken = distances(sets, n, index_of(sets), n), [0]
    for i in range(1, len(sets)):
        if d[i, taken].min() > RADIUS:
            taken.append(i)
    return np.array(taken)


def cells(d: np.ndarray) -> list[np.ndarray]:
    """Numbers of the documents in each pivot's region, with those that the triangle inequality lets link into it, and
    of those in or near the rest, the last; d: distances to the pivots."""
    eps, least, nearest = 1e-9, d.min(1), d.argmin(1)
    core = least <= RADIUS
    into = core[:, None] & (d <= least[:, None] + 2 * REACH + eps) & (d <= RADIUS + REACH + eps)
    into[np.flatnonzero(core), nearest[core]] = True
    return [np.flatnonzero(into[:, j]) for j in range(d.shape[1])] + [np.flatnonzero(least > RADIUS - REACH - eps)]


class Join:
    """Exact links among the members of one block: roots[i] is the least member that i reaches."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray]):
        self.n, self.sets, self.roots = n, sets, np.arange(len(n))
        self.within(np.arange(len(n)))

    def root(self, i: int) -> int:
        while self.roots[i] != i:
            self.roots[i] = self.roots[self.roots[i]]
            i = int(self.roots[i])
        return i

    def link(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.roots[b] = a

    def within(self, who: np.ndarray) -> None:
        """Region by region; one that its pivots do not divide into less than half the work, or a small one, by search."""
        todo = [who]
        while todo:
            who = todo.pop()
            if len(who) < 2:
                continue
            if len(who) <= LEAF:
                self.search(who)
                continue
            pivots = who[:: max(1, len(who) // PIVOTS)][:PIVOTS]
            pivots = pivots[separated([self.sets[i] for i in pivots], self.n[pivots])]
            parts = cells(distances([self.sets[i] for i in who], self.n[who], index_of([self.sets[i] for i in pivots]), self.n[pivots]))
            if 2 * sum(len(part) ** 2 for part in parts) > len(who) ** 2:
                self.search(who)
                continue
            for part in parts:
                todo.append(who[part])

    def search(self, who: np.ndarray) -> None:
        """Components by breadth first; each document is looked up in an index of the shingles of those not yet reached."""
        open_ = np.ones(len(who), bool)
        n, live, index = self.n[who], 0, None
        queue: list[int] = []
        while queue or open_.any():
            if not queue:
                queue = [int(np.flatnonzero(open_)[0])]
                open_[queue[0]] = False
            left = int(open_.sum())
            if not left:
                return
            if index is None or left <= live // 2:
                there, live = np.flatnonzero(open_), left
                flat, owner = index_of([self.sets[who[i]] for i in there])
                index = (flat, there[owner])
            x = queue.pop()
            same = np.bincount(found(index, self.sets[who[x]])[1], minlength=len(who))
            near = np.flatnonzero(open_ & (same > 0) & (NEAR[1] * same >= NEAR[0] * (n[x] + n - same)))
            open_[near] = False
            for j in near.tolist():
                self.link(int(who[x]), int(who[j]))
            queue += near.tolist()


def _joined(members: DataFrame) -> DataFrame:
    """x, y: a link path from each linked member of a block (block, rid, n, shared) to the least one it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid: list[int] = []
        n: list[int] = []
        sets: list[np.ndarray] = []
        now = None

        def finish() -> Iterator[pa.RecordBatch]:
            if len(rid) > 1:
                ids = np.array(rid)
                order = np.argsort(ids)
                ids = ids[order]
                join = Join(np.array(n)[order], [sets[i] for i in order])
                root = np.array([join.root(i) for i in range(len(ids))])
                y = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[root[y]]), pa.array(ids[y])], names=["x", "y"])

        for batch in batches:
            flat, offsets = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            for i, (b, r, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if now is not None and b != now:
                    yield from finish()
                    rid, n, sets = [], [], []
                now = b
                rid.append(r)
                n.append(m)
                sets.append(flat[offsets[i] : offsets[i + 1]].copy())
        yield from finish()
        trim()

    dealt = members.select("block", "rid", "n", "shared").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "x bigint, y bigint")


def _to_pivots(large: DataFrame, level: int) -> DataFrame:
    """block, rid, regions (numbers of the pivots' regions that it is in or near) and near (rid of the pivots that it
    links with) of the members of large blocks (with size). PIVOTS members of each block are drawn by a hash, and go to
    all shares of LARGE members."""
    h, shares = F.xxhash64("rid", F.lit(level)), F.ceil(F.col("size") / LARGE).cast("int")
    drawn = large.where(F.pmod(h, F.greatest(F.lit(1), F.floor(F.col("size") / (8 * PIVOTS)))) == 0)
    pivots = drawn.withColumn("o", F.row_number().over(Window.partitionBy("block").orderBy(h, "rid"))).where(F.col("o") <= PIVOTS)
    rows = pivots.select("block", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(0).alias("role"), "rid", "n", "shared").unionByName(
        large.select("block", F.pmod(F.hash("rid"), shares).alias("share"), F.lit(1).alias("role"), "rid", "n", "shared")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, held, index, apart = None, [], [], [], None, None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                block, share, role, rid, n = (batch.column(c).to_numpy() for c in range(5))
                sets = [np.array(x, np.int64) for x in batch.column(5).to_pylist()]
                cut = np.flatnonzero((block[1:] != block[:-1]) | (share[1:] != share[:-1]) | (role[1:] != role[:-1])) + 1
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True):
                    if hi == lo:
                        continue
                    if role[lo] == 0:
                        if now != (block[lo], share[lo]):
                            now, ids, sizes, held = (block[lo], share[lo]), [], [], []
                        ids += rid[lo:hi].tolist()
                        sizes += n[lo:hi].tolist()
                        held += sets[lo:hi]
                        index, apart = index_of(held), separated(held, np.array(sizes))
                        continue
                    d = distances(sets[lo:hi], n[lo:hi], index, np.array(sizes))
                    regions: list[list[int]] = [[] for _ in range(lo, hi)]
                    for j, part in enumerate(cells(d[:, apart])):
                        for i in part.tolist():
                            regions[i].append(j)
                    near = [[ids[j] for j in np.flatnonzero(row <= REACH + 1e-12)] for row in d]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[lo:hi]), pa.array(rid[lo:hi]), pa.array(regions, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))], names=["block", "rid", "regions", "near"]
                    )

    dealt = rows.repartition("block", "share").sortWithinPartitions("block", "share", "role", "rid")
    return Stored(dealt.mapInArrow(run, "block bigint, rid bigint, regions array<bigint>, near array<bigint>"), "pivots").df


def _by_first(large: DataFrame, level: int) -> DataFrame:
    """block, rid, to: a block for each of the first shingles; two members that link share one."""
    return large.select("block", "rid", F.explode("first").alias("g")).select("block", "rid", F.xxhash64("block", "g").alias("to"))


def _by_pivots(large: DataFrame, level: int) -> DataFrame:
    """block, rid, to: a block for each pivot's region, and the rest."""
    near = _to_pivots(large, level).select("block", "rid", F.explode("regions").alias("j"))
    return near.select("block", "rid", F.xxhash64("block", F.lit(level), "j").alias("to"))


def _sized(members: DataFrame) -> DataFrame:
    """Sizes are written down first (as are the other small sums by block): a join right after an aggregation on its key
    cannot be split where a block is hot."""
    sizes = Stored(members.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes").df
    return members.join(sizes, "block")


def _divided(large: DataFrame, to: DataFrame) -> DataFrame:
    """Members by their new blocks, where these are less than half the work; else by the old one."""
    to = Stored(to, "divided").df
    work = to.groupBy("block", "to").agg(F.count(F.lit(1)).alias("m")).groupBy("block").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
    good = work.join(large.select("block", "size").distinct(), "block").where("2 * work <= size * size").select("block")
    good = Stored(good, "good").df
    moved = large.join(to.join(good, "block"), ["block", "rid"]).select(F.col("to").alias("block"), "rid", "n", "shared", "first")
    return moved.unionByName(large.join(good, "block", "left_anti").select("block", "rid", "n", "shared", "first"))


def _main_and_others(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links to pivots; and members by blocks in which a chunk of those outside of a block's main component (that of
    most members, by links to pivots) meets a share of all."""
    stars = _to_pivots(large, -1).select("block", F.explode("near").alias("x"), F.col("rid").alias("y")).where("x <> y").select("x", "y")
    stars = Stored(stars, "stars").df
    labels = components(stars).withColumnsRenamed({"k": "rid", "c": "label"})
    named = Stored(large.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid")), "named").df
    most = named.groupBy("block", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("block").agg(F.max(F.struct("m", "label")).alias("t"), F.sum("m").alias("all"))
    most = most.select(F.col("block").alias("b"), F.col("t.label").alias("main"), F.ceil((F.col("all") - F.col("t.m")) / LARGE).cast("int").alias("chunks"))
    most = Stored(most, "most").df
    both = named.join(most, F.col("block") == F.col("b")).where("chunks > 0").withColumn("shares", F.ceil(F.col("size") / LARGE).cast("int"))
    all_ = both.withColumn("share", F.pmod(F.hash("rid"), "shares")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    others = both.where("label <> main").withColumn("chunk", F.pmod(F.hash("rid", F.lit(1)), "chunks")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    met = all_.unionByName(others).select(F.xxhash64("block", "share", "chunk").alias("block"), "rid", "n", "shared").dropDuplicates(["block", "rid"])
    return stars, met


def _links(members: DataFrame) -> DataFrame:
    """x, y of members (block, rid, n, shared, first): links enough to join what any links join."""
    out = None
    for level, step in enumerate((_by_first, _by_pivots, _by_pivots, None)):
        sized = _sized(members)
        part = _joined(sized.where(F.col("size") <= LARGE))
        out = part if out is None else out.unionByName(part)
        large = sized.where(F.col("size") > LARGE)
        if not large.limit(1).count():
            return out
        large = Stored(large, "large").df
        if step is None:
            stars, met = _main_and_others(large)
            return out.unionByName(stars).unionByName(_joined(met))
        members = Stored(_divided(large, step(large, level)), "regions").df


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every row: the least key reachable over links of similarity 0.8 or more.

    A null or empty text, and one of white space only, has no shingles and is linked with nothing; a text of fewer
    than five words is one shingle. Rows of equal sets are one class. Rows of a null key have a null component and
    link nothing; rows of one key are one document whose texts all count. Keys may be of any type that has an order.
    An empty table gives an empty one. Other columns are left out.
    """
    spark = df.sparkSession
    small_batches(spark)
    told = Stored(describe(df, key, text), "described").df
    release(spark)
    some = told.where("n > 0 and k is not null")
    classes = Stored(some.groupBy("a", "b", "n").agg(F.min("rid").alias("rep"), F.min("k").alias("least")), "classes").df
    suspects = some.where(F.size("first") > 0)
    # equal sets have equal first shingles, so the class's one row will do
    suspects = Stored(suspects.join(classes.select(F.col("rep").alias("rid")), "rid").select("rid", "n", "first", "shared"), "suspects").df
    each = suspects.select("rid", F.explode("first").alias("g"))
    regions = each.groupBy("g").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("g", "lo")
    regions = Stored(regions, "regions").df
    blocks = components(each.join(regions, "g").where("rid <> lo").select(F.col("lo").alias("x"), F.col("rid").alias("y")).distinct())
    members = suspects.join(blocks.withColumnRenamed("k", "rid"), "rid").select(F.col("c").alias("block"), "rid", "n", "shared", "first")
    links = _links(Stored(members, "members").df)
    # texts of one key are one document
    reps = some.select("k", "a", "b", "n").join(classes, ["a", "b", "n"]).groupBy("k").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    twice = some.select("k", "a", "b", "n").join(reps.select("k", "x"), "k").join(classes, ["a", "b", "n"]).select("x", F.col("rep").alias("y")).where("x <> y")
    labels = components(links.union(twice.distinct()))
    named = classes.join(labels.withColumnRenamed("k", "rep"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    least = named.groupBy("c").agg(F.min("least").alias("component"))
    named = named.join(least, "c").select("a", "b", "n", "component")
    rest = told.where("n = 0 or k is null").select("k", "n", F.col("k").alias("component"))
    # a document whose texts are empty here and not there is one with its other rows' component only in these
    out = some.select("k", "a", "b", "n").join(named, ["a", "b", "n"]).select("k", "n", "component").unionByName(rest)
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, there) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.there)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(there) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
