import random

import pytest

from sparkloom.llm import jaccard_join as J


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = {k: shingles(t) for k, t in rows}
    up = {k: k for k in s}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(s[a] | s[b])
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * both:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: (len(s[k]), top(k)) for k in keys}


def check(spark, rows):
    got = J.near_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_equals_brute_force_on_documents(spark, texts):
    check(spark, list(texts.items()))


@pytest.fixture(scope="module")
def family():
    """Families of near copies around the limit, of all sizes, with a passage that most texts hold."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows, k = [], 0
    for size in (5, 6, 9, 14, 25, 60, 78, 110, 300):
        for _ in range(3):
            own = [word() for _ in range(size)] + (passage if rnd.random() < 0.7 else [])
            for _ in range(8):
                w = list(own)
                for _ in range(rnd.choice([0, 1, 1, 2, max(1, len(w) // 45), max(1, len(w) // 30)])):
                    w[rnd.randrange(len(w))] = word()
                if rnd.random() < 0.3:
                    w = w[: len(w) - len(w) // 8]
                rows.append((k, " ".join(w)))
                k += 1
    rnd.shuffle(rows)
    return rows


def test_equals_brute_force_on_families(spark, family):
    assert len({c for _, c in brute(family).values()}) < len(family)
    check(spark, family)


@pytest.mark.parametrize("steps", ["all", "main component only"])
def test_large_blocks_are_divided(spark, family, monkeypatch, steps):
    """Blocks above LARGE go through every step; a task is never given many more members than that."""
    monkeypatch.setattr(J, "LARGE", 3)
    monkeypatch.setattr(J, "PIVOTS", 3)
    if steps != "all":
        monkeypatch.setattr(J, "_divided", lambda large, to: large.drop("size"))
    given, joined = [], J._joined

    def watched(members):
        given.append(members.groupBy("block").count().agg({"count": "max"}).first()[0] or 0)
        return joined(members)

    monkeypatch.setattr(J, "_joined", watched)
    check(spark, family)
    assert len(given) == 5 and max(given[:4]) <= 3 and 0 < given[4] <= 16


def test_voronoi_regions_lose_no_link():
    rnd = random.Random(3)
    base = [rnd.sample(range(3000), 120) for _ in range(6)]
    sets = []
    for _ in range(400):
        s = set(rnd.choice(base))
        for _ in range(rnd.choice([0, 3, 8, 13, 20, 40])):
            s.discard(rnd.choice(sorted(s)))
            s.add(rnd.randrange(3000))
        sets.append(J.np.array(sorted(s), J.np.int64))
    n = J.np.array([len(s) for s in sets])
    for drawn in (list(range(10)), list(range(300, 330))):
        pivots = [drawn[i] for i in J.separated([sets[i] for i in drawn], n[drawn])]
        parts = J.cells(J.distances(sets, n, J.index_of([sets[i] for i in pivots]), n[pivots]))
        together = [set(p.tolist()) for p in parts]
        assert sum(len(p) ** 2 for p in parts) < len(sets) ** 2 / 2
        for i in range(len(sets)):
            for j in range(i):
                same = len(J.np.intersect1d(sets[i], sets[j]))
                if 5 * same >= 4 * (n[i] + n[j] - same):
                    assert any(i in p and j in p for p in together)


def test_edge_cases(spark, edge):
    rows = J.near_components(edge).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge.count() and by[1]["n_shingles"] == by[2]["n_shingles"] == by[7]["n_shingles"] == 0
    assert by[6]["component_id"] == 5 and by[3]["component_id"] == 3 and by[None]["component_id"] is None and by[1]["component_id"] == 1
    assert J.near_components(edge.limit(0)).count() == 0
