import numpy as np
import pytest

from sparkloom.llm import quality as Q


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learn, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = Q.classify(docs.join(labels.select("doc_id"), "doc_id"), learn).join(rest, "doc_id").toPandas()
    good = got.quality_score >= 0.5
    assert (good == (got.quality == 1)).mean() > 0.97
    assert ((got.toxic_score >= 0.5) == (got.toxic == 1)).mean() > 0.93
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.1 and got[got.toxic == 1].keep.mean() < 0.45


@pytest.mark.parametrize(("known", "right"), [(60, 0.95), (600, 0.98)])
def test_views_teach_each_other(known, right):
    """Labels of few rows or of all: what each view is sure of among all rows reaches the other."""
    rnd = np.random.default_rng(0)
    n = 600
    y = rnd.integers(0, 2, n).astype(float)
    text = [np.array([int(a), 10 + int(rnd.integers(0, 50))], np.uint16) for a in y]
    meta = [np.array([int(a) if rnd.random() < 0.9 else 1 - int(a)], np.uint16) for a in y]
    held = np.arange(known) % 4 == 3
    one = Q.Cotraining(y[:known], held, (text[:known], meta[:known]))
    for _ in range(2):
        one.fit()
        found = Q.Surest({"quality": one.models}, frozenset())
        found.add(text, meta)
        rows = list(found.rows())
        for v in (0, 1):
            for label in (0, 1):
                some = [r for r in rows if r[1:3] == (v, label)]
                one.hand(v, label, list(zip(Q._numbers(r[5] for r in some), Q._numbers(r[6] for r in some), strict=True)))
    one.fit()
    assert len(one.sets[1][1]) > 0.75 * known + 50  # the text view, sure of its rows, has taught the metadata view
    head = one.head()
    p = head.probability(head.text.logit(Q.Rows(text)), head.meta.logit(Q.Rows(meta)))
    assert ((p > 0.5) == (y == 1)).mean() > right


def test_surest_rows_equal_brute_force(spark, documents):
    """Each round looks at all rows: what tasks and the driver choose is what sorting all rows gives."""
    rows = Q.featured(documents.repartition(5))
    rnd = np.random.default_rng(1)
    models = {h: [Q.Linear(rnd.normal(size=1 << Q.TEXT_BITS)), Q.Linear(rnd.normal(size=1 << Q.META_BITS))] for h in Q.HEADS}
    all_ = rows.collect()
    feats = {(bytes(r["__x"]), bytes(r["__m"])) for r in all_}
    digest = lambda f: Q.xxhash.xxh3_128_digest(f[0] + b"|" + f[1])
    gone = frozenset(sorted(map(digest, feats))[:20])
    got = Q._surest(rows, models, gone, 7, 0.6)
    for h in Q.HEADS:
        for v in (0, 1):
            for label in (0, 1):
                want = []
                for f in feats:
                    x = np.frombuffer(f[v], np.uint16)
                    p = 1 / (1 + np.exp(-models[h][v].w[x].sum() / np.sqrt(max(1, len(x)))))
                    sure = p if label else 1 - p
                    if sure >= 0.6 and digest(f) not in gone:
                        want.append((-round(sure, 5), digest(f)))
                mine = [(-round(r["sure"], 5), bytes(r["digest"])) for r in got if (r["head"], r["view"], r["label"]) == (h, v, label)]
                assert len(mine) == min(7, len(want)) and sorted(x for x, _ in mine) == [x for x, _ in sorted(want)[:7]]


def test_calibrated_scores_are_frequencies(spark):
    """Of held-out rows scored about p, about a share of p are good; by thirds of the scores in between."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Q.classify(docs.join(labels.select("doc_id"), "doc_id"), labels.where("doc_id % 3 = 0")).join(labels.where("doc_id % 3 > 0"), "doc_id").toPandas()
    for score, y in ((got.quality_score, got.quality), (got.toxic_score, got.toxic)):
        for lo, hi in ((0, 0.1), (0.1, 0.9), (0.9, 1.01)):
            part = (score >= lo) & (score < hi)
            if part.sum() > 30:
                assert abs(y[part].mean() - score[part].mean()) < (0.05 if lo != 0.1 else 0.2), (lo, part.sum(), y[part].mean(), score[part].mean())


@pytest.mark.parametrize("labels", [[], [(3, 1, 0)], [(3, None, None), (4, 0, 1), (5, 1, None)]])
def test_edge_cases(spark, edge, labels):
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = Q.classify(edge, lab).collect()
    assert len(rows) == edge.count() and all(0 <= r["quality_score"] <= 1 for r in rows)
    if not labels:
        assert all(r.keep for r in rows)
    assert Q.keep(edge, lab).columns == edge.columns
    named = edge.select("*", edge["text"].alias("__k"), edge["text"].alias("__x"))
    assert Q.keep(named, lab).columns == named.columns
    texts = edge.selectExpr("cast(doc_id as string) as doc_id", "text", "lang")
    assert Q.classify(texts, lab.selectExpr("cast(doc_id as string) as doc_id", "quality", "toxic")).count() == edge.count()
    assert Q.classify(edge.limit(0), lab).count() == 0
