import random

from sparkloom.llm import suffix_dedup as S


def brute(rows, depth=S.DEPTH):
    seen, out = set(), {}
    for key, text in sorted(rows):
        b = text.encode()
        gone, own = bytearray(len(b)), set()
        for i in range(len(b) - depth + 1):
            w = b[i : i + depth]
            own.add(w)
            if w in seen:
                gone[i : i + depth] = b"\1" * depth
        seen |= own
        out[key] = (sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), bytes(c for c, g in zip(b, gone) if not g))
    return out


def check(spark, rows):
    got = S.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute(rows)


def test_equals_brute_force_on_documents(spark, texts):
    check(spark, list(texts.items()))


def test_equals_brute_force_on_spliced_texts(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc é") for _ in range(rnd.randint(20, 90)))
    pool = [word() for _ in range(12)]
    rows = [(k, "".join(rnd.choice(pool) if rnd.random() < 0.6 else word() for _ in range(rnd.randint(0, 8)))) for k in range(90)]
    rows += [(200, "a" * 400), (201, "a" * 49), (202, "a" * 50), (203, "ab" * 300), (204, "b" + "ab" * 100)]
    check(spark, rows)


def test_windows_that_bridge_two_repeats_are_sources(spark):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for k in range(0, 400, 4):
        p, x, q, side = word(120), word(rnd.randint(30, 40)), word(120), rnd.randint(8, 12)
        rows += [(k, word(60) + p + x), (k + 1, x + q + word(60)), (k + 2, p + x + q), (k + 3, word(60) + p[-side:] + x + q[:side] + word(60))]
    check(spark, rows)


def test_a_line_of_very_many_documents_takes_nothing_unique(spark):
    """74 bytes that all documents hold, with 30 random letters on each side: contexts of one anchor, as many as documents."""
    rnd = random.Random(11)
    line = "Licensed under the terms that the file of that name gives, see it for all."
    letters = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    assert len(line) == 74
    check(spark, [(k, letters(30) + line + letters(30)) for k in range(12_000)])
    texts = [(letters(30) + line + letters(30)).encode() for _ in range(320_000)]
    seen: dict[tuple, bytes] = {}
    for at in range(0, len(texts), 4000):
        part = texts[at : at + 4000]
        data, size = b"".join(part), len(part[0])
        key, x, y, who, lo, hi = S.anchors(data, S.np.arange(len(part)) * size, S.np.full(len(part), size))
        for k, a, b, i, j in zip(key.tolist(), x.tolist(), (y & S.np.uint64(0xFFFF)).tolist(), lo.tolist(), hi.tolist(), strict=True):
            own = data[i : j + S.DEPTH]
            if line[:40].encode() in own or line[-40:].encode() in own:  # the others are all random
                assert seen.setdefault((k, a, b), own) == own


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    monkeypatch.setattr(S, "PIECE", 1000)
    data = long.encode()
    key, *_ = S.anchors(data, S.np.array([0]), S.np.array([len(data)]))
    assert 0.03 < len(key) / len(data) < 0.12
    check(spark, [(1, long), (2, long[5000:15_000] + "x" + long[:100])])


def test_edge_cases(spark, edge):
    rows = S.dedup_substrings(edge).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge.count() and by[1]["n_bytes"] == 0 and by[6]["n_removed"] == by[6]["n_bytes"] and by[5]["n_removed"] == 0 and by[None]["n_removed"] == 0
    assert S.dedup_substrings(edge.limit(0)).count() == 0
