"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections. DataFrame functions only.

A leaf is a piece of a paragraph (a line), cut by content: behind the first word that ends in one of ENDS
after LEAST characters or more, or after MOST. A paragraph's node is the digest of its leaves; a section ends with a paragraph
whose digest begins with 0 or 1, or after WIDEST; its node is the digest of its paragraphs, and the root that of the
sections. As all cuts follow the content, an edit changes the leaves that it touches and the nodes above them, and
what is moved by it keeps its nodes.

Trees are compared from the root down. Equal roots are equal texts. Else sections that the other tree has as well are
alike as a whole; in the others paragraphs are looked up, and in paragraphs that differ the leaves. Branches that
differ locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, text_or_empty

# The cuts of leaves and of sections.
LEAST, MOST, WIDEST = 10, 64, 32
ENDS = "adgjmpsvyADGJMPSVY0369.,;:!?)"
LEAF = rf"(?s).{{{LEAST},{MOST}}}?(?:[{ENDS}][\x20\t\r]{{1,8}}|\z)|.{{1,{MOST}}}"
SECTION = rf"(?:[2-9a-f][0-9a-f]{{31}};){{0,{WIDEST - 1}}}(?:[0-9a-f]{{32}};)"
#: Hexadecimal digits that the fingerprint keeps of a node, and digits to the base 64 of a leaf, which its size follows.
KEPT, LEAF_KEPT = 8, 6
#: Documents that one task orders at least, and slices that quantiles are taken for, each cut by quantiles once more.
SLICE_ROWS, SLICES = 1500, 512
BROADCAST_ROWS = 100_000


def _bound(x: Column, f) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.transform(F.array(x), f)[0]


def tree(text: Column) -> Column:
    """struct<root, sections array<struct<node, paragraphs array<struct<node, leaves>>>>> of a text (null: empty)."""
    digests = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.concat(F.md5(x), F.char(F.floor(F.length(x) / 3) + 65)))
    paragraph = lambda p: _bound(digests(p), lambda h: F.struct(F.md5(F.array_join(h, "")).alias("node"), F.transform(h, lambda x: F.concat(F.substring(F.base64(F.unhex(F.substring(x, 1, 10))), 1, LEAF_KEPT), F.substring(x, 33, 1))).alias("leaves")))

    def sections(ps: Column) -> Column:
        nodes = F.concat(F.array_join(F.transform(ps, lambda p: p["node"]), ";"), F.lit(";"))
        groups = F.regexp_extract_all(nodes, F.lit(SECTION), F.lit(0))
        starts = F.aggregate(groups, F.array(F.lit(0)), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + (F.length(g) / 33).cast("int"))))
        return F.zip_with(groups, F.slice(starts, 1, F.size(groups)), lambda g, at: F.struct(F.md5(g).alias("node"), F.slice(ps, at + 1, (F.length(g) / 33).cast("int")).alias("paragraphs")))

    made = _bound(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), paragraph), sections)
    return _bound(made, lambda s: F.struct(F.sha2(F.array_join(F.transform(s, lambda x: x["node"]), ""), 256).alias("root"), s.alias("sections")))


def fingerprint(t: Column) -> Column:
    """The tree as a string: the root, then sections by ;, in each its node and its paragraphs, in each its node and its leaves."""
    short = lambda x: F.substring(x, 1, KEPT)
    paragraph = lambda p: F.concat(short(p["node"]), F.lit(":"), F.array_join(p["leaves"], ""))
    section = lambda s: F.concat(short(s["node"]), F.lit("/"), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(t["root"], F.lit("|"), F.array_join(F.transform(t["sections"], section), ";"))


def _nodes(x: Column) -> Column:
    return F.transform(x, lambda y: y["node"])


def _besides(own: Column, other: Column) -> Column:
    """Those of own whose nodes other lacks."""
    return _bound(F.array_except(_nodes(own), _nodes(other)), lambda new: F.when(F.size(new) == 0, F.slice(own, 1, 0)).otherwise(F.filter(own, lambda x: F.array_contains(new, x["node"]))))


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: s["paragraphs"]))


def _weight(leaves: Column) -> Column:
    """Characters of leaves in threes, as their last characters say."""
    return F.aggregate(leaves, F.lit(0), lambda a, x: a + F.ascii(F.substring(x, LEAF_KEPT + 1, 1)) - 64)


def _leaves(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: p["leaves"]))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else the share of both trees' characters that lie in equal branches or equal leaves.

    Within branches that differ, a leaf that repeats counts once. Different trees are never alike in full.
    """
    down = _bound(
        F.struct(_paragraphs(_besides(a["sections"], b["sections"])).alias("pa"), _paragraphs(_besides(b["sections"], a["sections"])).alias("pb")),
        lambda x: F.struct(_leaves(_besides(x["pa"], x["pb"])).alias("la"), _leaves(_besides(x["pb"], x["pa"])).alias("lb")),
    )
    every = _weight(_leaves(_paragraphs(a["sections"]))) + _weight(_leaves(_paragraphs(b["sections"])))
    sums = _bound(
        down,
        lambda y: F.struct(
            every.alias("all"),
            (every - _weight(y["la"]) - _weight(y["lb"])).alias("same"),
            (_weight(F.array_distinct(y["la"])) + _weight(F.array_distinct(y["lb"]))).alias("differ"),
            _weight(F.array_intersect(y["la"], y["lb"])).alias("both"),
        ),
    )
    of = lambda z: F.when(z["same"] + z["differ"] > 0, F.least((z["same"] + 2.0 * z["both"]) / (z["same"] + z["differ"]), 1 - 0.5 / (z["all"] + 1.0))).otherwise(0.0)
    return F.when(a["root"] == b["root"], 1.0).otherwise(_bound(sums, of))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of tree a whose branches tree b lacks, found from the root down."""
    new = _bound(
        F.struct(_paragraphs(_besides(a["sections"], b["sections"])).alias("pa"), _paragraphs(_besides(b["sections"], a["sections"])).alias("pb")),
        lambda x: F.array_except(_nodes(x["pa"]), _nodes(x["pb"])),
    )
    numbered = lambda ps, n: F.filter(F.transform(ps, lambda p, i: F.when(F.array_contains(n, p["node"]), i)), lambda i: i.isNotNull())
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(_bound(new, lambda n: numbered(_paragraphs(a["sections"]), n)))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and next_text: the text of the row before in the order of keys (that is the next one downwards; of
    the first row, the last). Rows of equal keys are ordered by a hash of their texts, null keys come first.

    Rows are dealt into slices by quantiles of the key, and in each by its own quantiles, so that no task orders the
    whole table however uneven the keys are; the last row of each slice is sent to the next slice too.
    """
    base = df.select(F.col(f"`{key}`").cast("long").alias("k"), text_or_empty(f"`{text}`").alias("t"))
    n = base.count()
    many = max(1, min(SLICES, int((n / SLICE_ROWS) ** 0.5 + 0.999)))
    at = lambda edges: F.size(F.filter(edges, lambda e: e <= F.col("k"))).cast("long")
    if many > 1:
        shares = "array(" + ", ".join(f"{i / many:.9f}D" for i in range(1, many)) + f"), {40 * many}"
        edges = base.agg(F.expr(f"approx_percentile(k, {shares})").alias("q")).first()["q"] or []
        outer = at(F.array(*[F.lit(int(e)).cast("long") for e in edges]).cast("array<bigint>"))
        own = base.where("k is not null").select("k", outer.alias("o")).groupBy("o").agg(F.expr(f"approx_percentile(k, {shares})").alias("q"))
        # at most SLICES rows of SLICES edges
        edges_of = F.broadcast(Stored(own, "quantiles").df)
        sliced = base.withColumn("o_", outer).join(edges_of, F.col("o_") == F.col("o"), "left")
        dealt = sliced.select("k", "t", F.when(F.col("k").isNull(), F.lit(-1)).otherwise(F.col("o") * many + at(F.col("q"))).cast("long").alias("s"))
    else:
        dealt = base.withColumn("s", F.when(F.col("k").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    lasts = Stored(dealt.groupBy("s").agg(F.max("k").alias("last")).withColumn("o", F.floor(F.col("s") / many)), "slices").df
    # the slice after each: within an outer slice, or the first of the next outer slice (at most SLICES + 1 rows), or the very first
    outers = lasts.groupBy("o").agg(F.min("s").alias("first"))
    everywhere = Window.partitionBy(F.lit(1))
    outers = outers.select("o", F.coalesce(F.lead("first").over(Window.orderBy("o")), F.min("first").over(everywhere)).alias("then"))
    after = lasts.withColumn("to", F.lead("s").over(Window.partitionBy("o").orderBy("s"))).join(F.broadcast(outers), "o")
    donors = after.select(F.col("last").alias("d"), F.coalesce("to", "then").alias("to"))
    if many * many <= BROADCAST_ROWS:
        donors = F.broadcast(donors)
    sent = dealt.join(donors, F.col("k").eqNullSafe(F.col("d")), "left")
    own = F.struct(F.col("s").alias("s"), F.lit(False).alias("lent"))
    lent = F.struct(F.col("to").alias("s"), F.lit(True).alias("lent"))
    rows = sent.withColumn("x", F.explode(F.when(F.col("to").isNotNull(), F.array(own, lent)).otherwise(F.array(own))))
    w = Window.partitionBy("x.s").orderBy(F.col("x.lent").desc(), F.col("k").asc_nulls_first(), F.xxhash64("t"))
    return rows.withColumn("next_text", F.lag("t").over(w)).where(~F.col("x.lent")).select(F.col("k").alias(key), F.col("t").alias(text), "next_text")


def edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, text, next_text and edited: the last third of each text replaced by the start of the next one."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    return with_next(df, key, text).withColumns({"n_chars": n.cast("long"), "edited": edited})


def compare(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, how alike they are, and differing: the numbers of the
    paragraphs that the edited text lacks.

    A null text counts as empty: its tree has one empty paragraph and no leaves. Rows with equal texts have equal
    fingerprints; an only row is its own next one. An empty table gives an empty one. Texts are hashed whole.
    """
    e = edits(df, key, text)
    t = e.select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col(text)).alias("a"), tree(F.col("edited")).alias("b"), tree(F.col("next_text")).alias("c"))
    return t.select(
        key,
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
        F.array_join(F.transform(differing_paragraphs(F.col("a"), F.col("b")), lambda i: i.cast("string")), ",").alias("differing"),
    )


#: The same trees by DuckDB's list functions; what differs is looked up in lists of nodes.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lag(t) OVER (ORDER BY doc_id), last_value(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS c, length(t) AS len FROM d),
e AS (SELECT doc_id, len, t AS a, substr(t, 1, len - len // 3) || substr(c, 1, len // 3) AS b, c FROM n),
u AS (SELECT doc_id, 'a' AS v, a AS t FROM e UNION ALL SELECT doc_id, 'b', b FROM e UNION ALL SELECT doc_id, 'c', c FROM e),
p AS (SELECT doc_id, v, list_transform(string_split(t, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: md5(x) || chr((65 + length(x) // 3)::INT))) AS hs FROM u),
m AS (SELECT *, list_transform(hs, lambda h: md5(array_to_string(h, ''))) AS nodes,
  list_transform(hs, lambda h: list_transform(h, lambda x: substr(to_base64(unhex(substr(x, 1, 10))), 1, {LEAF_KEPT}) || substr(x, 33))) AS ls FROM p),
g AS (SELECT *, regexp_extract_all(array_to_string(nodes, ';') || ';', '{SECTION}') AS gs FROM m),
k AS (SELECT *, list_transform(range(1, len(gs) + 1), lambda i: (list_sum(list_transform(gs[1:i], lambda x: length(x))) // 33)::INT) AS ends, list_transform(gs, lambda x: md5(x)) AS snodes FROM g),
w AS (SELECT *, list_transform(range(1, len(gs) + 1), lambda i: coalesce(ends[i - 1], 0) + 1) AS starts FROM k),
t AS (
  SELECT doc_id, v, nodes, ls, snodes, starts, ends, sha256(array_to_string(snodes, '')) AS root,
    list_transform(range(1, len(nodes) + 1), lambda i: len(list_filter(starts, lambda x: x <= i))) AS owner FROM w),
f AS (
  SELECT *, root || '|' || array_to_string(list_transform(range(1, len(snodes) + 1), lambda i: substr(snodes[i], 1, {KEPT}) || '/' || array_to_string(
    list_transform(range(starts[i], ends[i] + 1), lambda j: substr(nodes[j], 1, {KEPT}) || ':' || array_to_string(ls[j], '')), ',')), ';') AS print FROM t),
x AS (
  SELECT a.doc_id, o.v, a.root = o.root AS same, a.nodes AS an, a.ls AS al, o.nodes AS bn, o.ls AS bl,
    list_filter(range(1, len(a.nodes) + 1), lambda i: NOT list_contains(o.snodes, a.snodes[a.owner[i]])) AS pa,
    list_filter(range(1, len(o.nodes) + 1), lambda i: NOT list_contains(a.snodes, o.snodes[o.owner[i]])) AS pb
  FROM f a JOIN f o ON a.doc_id = o.doc_id AND a.v = 'a' AND o.v <> 'a'),
y AS (
  SELECT *, list_filter(pa, lambda i: NOT list_contains(list_transform(pb, lambda j: bn[j]), an[i])) AS qa, list_filter(pb, lambda i: NOT list_contains(list_transform(pa, lambda j: an[j]), bn[i])) AS qb FROM x),
z AS (
  SELECT *, flatten(list_transform(qa, lambda i: al[i])) AS la, flatten(list_transform(qb, lambda i: bl[i])) AS lb, flatten(al) AS fa, flatten(bl) AS fb FROM y),
s AS (
  SELECT doc_id, v, same, an, qa, list_sum(list_transform(list_concat(fa, fb), lambda q: ascii(substr(q, {LEAF_KEPT + 1})) - 64)) AS every,
    coalesce(list_sum(list_transform(list_concat(la, lb), lambda q: ascii(substr(q, {LEAF_KEPT + 1})) - 64)), 0) AS open,
    coalesce(list_sum(list_transform(list_concat(list_distinct(la), list_distinct(lb)), lambda q: ascii(substr(q, {LEAF_KEPT + 1})) - 64)), 0) AS differ,
    coalesce(list_sum(list_transform(list_intersect(la, lb), lambda q: ascii(substr(q, {LEAF_KEPT + 1})) - 64)), 0) AS shared FROM z),
r AS (
  SELECT *, CASE WHEN same THEN 1.0 WHEN coalesce(every, 0) - open + differ > 0 THEN least((every - open + 2.0::DOUBLE * shared) / (every - open + differ), 1 - 0.5::DOUBLE / (every + 1)) ELSE 0.0 END::DOUBLE AS near FROM s)
SELECT e.doc_id, e.len::BIGINT AS n_chars, sha256(e.b) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint, rb.near AS near_edited, rc.near AS near_next,
  CASE WHEN rb.same THEN '' ELSE array_to_string(list_transform(list_filter(range(1, len(rb.an) + 1), lambda i: list_contains(list_transform(rb.qa, lambda j: rb.an[j]), rb.an[i])), lambda i: i - 1), ',') END AS differing
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.v = 'a' JOIN f b ON b.doc_id = e.doc_id AND b.v = 'b'
JOIN r rb ON rb.doc_id = e.doc_id AND rb.v = 'b' JOIN r rc ON rc.doc_id = e.doc_id AND rc.v = 'c'
"""
