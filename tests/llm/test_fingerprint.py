import base64
import hashlib

from pyspark.sql import functions as F

from sparkloom.llm import fingerprint as P


def test_edits_and_likeness(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(P, "SLICE_ROWS", 20)  # several slices
    got = {r["doc_id"]: r for r in P.compare(documents).collect()}
    order = sorted(texts, reverse=True)
    for n, k in enumerate(order):
        t, nxt = texts[k], texts[order[(n + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_next"] <= 1 and (got[k]["near_edited"] > 0.5 or len(t) < 60)
    same = {}
    for k, t in texts.items():
        same.setdefault(t, set()).add(got[k]["fingerprint"])
    assert all(len(x) == 1 for x in same.values()) and len({x for s in same.values() for x in s}) == len(same)
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.97 * len(got)


def test_branches_locate_edits(spark):
    a = "\n".join(f"paragraph {k} of the text" for k in range(30))
    df = spark.createDataFrame([(a, a.replace("paragraph 17 ", "paragraph XX "))], "a string, b string")
    t = df.select(P.tree(F.col("a")).alias("x"), P.tree(F.col("b")).alias("y"))
    assert t.select(P.differing_paragraphs(F.col("x"), F.col("y"))).first()[0] == [17]
    assert t.select("x.root").first()[0] != t.select("y.root").first()[0]


def leaf(x):
    return base64.b64encode(bytes.fromhex(x[:10])).decode()[: P.LEAF_KEPT] + x[-1]


def brute_tree(text):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sections, now = [], []
    for p in text.split("\n"):
        leaves, rest = [], p
        while rest:
            end = min(len(rest), P.MOST)
            for m in range(P.LEAST, min(len(rest), P.MOST) + 1):
                if m == len(rest):
                    end = m
                    break
                if m < len(rest) - 1 and rest[m] in P.ENDS and rest[m + 1] in " \t\r":
                    end = m + 1
                    while end < min(len(rest), m + 9) and rest[end] in " \t\r":
                        end += 1
                    break
            leaves.append(md5(rest[:end]) + chr(65 + end // 3))
            rest = rest[end:]
        now.append((md5("".join(leaves)), leaves))
        if now[-1][0][0] in "01" or len(now) == P.WIDEST:
            sections.append(now)
            now = []
    sections += [now] if now else []
    nodes = [md5("".join(f"{n};" for n, _ in s)) for s in sections]
    return hashlib.sha256("".join(nodes).encode()).hexdigest(), list(zip(nodes, sections, strict=True))


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    down = lambda x, y: [p for n, s in x[1] if n not in {m for m, _ in y[1]} for p in s]
    weight = lambda ls: sum(ord(x[-1]) - 64 for x in ls)
    count = lambda ps: sum(weight(ls) for _, ls in ps)
    every = sum(count(s) for t in (a, b) for _, s in t[1])
    pa, pb = down(a, b), down(b, a)
    pa, pb = [p for p in pa if p[0] not in {n for n, _ in pb}], [p for p in pb if p[0] not in {n for n, _ in pa}]
    la, lb = ({leaf(x) for _, ls in ps for x in ls} for ps in (pa, pb))
    same = every - count(pa) - count(pb)
    out = same + weight(la) + weight(lb)
    return min((same + 2 * weight(la & lb)) / out, 1 - 0.5 / (every + 1)) if out else 0.0


def test_trees_and_likeness_equal_brute_force(spark, documents, texts):
    got = {r["doc_id"]: r for r in P.compare(documents).collect()}
    order = sorted(texts, reverse=True)
    for n, k in enumerate(order):
        t, nxt = texts[k], texts[order[(n + 1) % len(order)]]
        cut = len(t) // 3
        a, b, c = (brute_tree(x) for x in (t, t[: len(t) - cut] + nxt[:cut], nxt))
        said = ";".join(f"{m[: P.KEPT]}/" + ",".join(f"{p[: P.KEPT]}:" + "".join(leaf(x) for x in ls) for p, ls in s) for m, s in a[1])
        assert got[k]["fingerprint"] == f"{a[0]}|{said}", k
        assert abs(got[k]["near_edited"] - brute_likeness(a, b)) < 1e-9 and abs(got[k]["near_next"] - brute_likeness(a, c)) < 1e-9


def test_small_insertions_change_little(spark):
    words = [f"{chr(97 + i * 7 % 26)}{i * 37 % 101}{'etaoinshrdlu'[i % 12]}" for i in range(600)]
    long = " ".join(words)
    lines = [" ".join(words[i : i + 12]) for i in range(0, 600, 12)]
    pairs = [(long, "x" + long), ("\n".join(lines), "\n".join([*lines[:5], "one more line", *lines[5:]])), (long, long[:1000] + "!" + long[1000:])]
    t = spark.createDataFrame(pairs, "a string, b string").select(P.tree(F.col("a")).alias("x"), P.tree(F.col("b")).alias("y"))
    assert all(0.9 < r[0] < 1 for r in t.select(P.likeness(F.col("x"), F.col("y"))).collect())
    assert t.select(P.differing_paragraphs(F.col("y"), F.col("x"))).collect()[1][0] == [5]
    assert len(long) > 2600 and t.select(F.length(P.fingerprint(F.col("x")))).first()[0] < 0.4 * len(long)


def test_uneven_keys_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE_ROWS", 10)
    keys = [1, 2, *range(10**9, 10**9 + 300), 10**15, *range(-50, -40)]
    rows = [(k, f"text {k}") for k in keys]
    got = {r["doc_id"]: r["next_text"] for r in P.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(keys)
    assert got == {k: f"text {order[n - 1]}" for n, k in enumerate(order)}


def test_edge_cases(spark, edge):
    rows = P.compare(edge).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_chars"] == 0 and by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_edited"] == 1.0
    assert by[5]["fingerprint"] == by[6]["fingerprint"]
    assert P.compare(edge.limit(0)).count() == 0
    one = P.compare(spark.createDataFrame([(3, "abcdef" * 40)], "doc_id bigint, text string")).first()
    assert one["near_next"] == 1.0
