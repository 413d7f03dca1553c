import random

from sparkloom.llm import line_dedup as L


def in_earlier_runs(docs, sure=L.SURE):
    """The numbers of the lines that lie in any run of SURE words that starts earlier in the order of (key, line)."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        own, gone = [x.strip() for x in text.split("\n")], set()
        for i in range(len(own)):
            total = 0
            for j in range(i, len(own)):
                total += len(own[j].split())
                if total >= sure:
                    run = tuple(own[i : j + 1])
                    if run in seen:
                        gone.update(range(i, j + 1))
                    else:
                        seen.add(run)
        out[key] = gone
    return out


def brute(docs, sure=L.SURE):
    """The kept lines of (key, text) rows; shares nothing with the operator."""
    gone = in_earlier_runs(docs, sure)
    return {k: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) for k, t in docs}


def run(spark, docs):
    return {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}


def test_equals_brute_force(spark, documents, texts):
    want = brute(list(texts.items()))
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(documents).collect()}
    assert got == want and any(want[k] != texts[k] for k in want)


def test_random_lines_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randint(0, 7))) for _ in range(25)]
    docs = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 30)))) for k in range(60)]
    assert run(spark, docs) == brute(docs)


def test_runs_are_extended_to_the_first_unequal_line_of_any_earlier_copy(spark):
    rnd = random.Random(1)
    line = lambda n=5: " ".join(f"{rnd.random():.9f}" for _ in range(n))
    docs = []
    for k in range(0, 90, 3):
        core, mid = [line() for _ in range(4)], [line() for _ in range(3)]
        docs += [(k, "\n".join(["a only", *core, "z only"])), (k + 1, "\n".join(["b only", *mid, *core])), (k + 2, "\n".join(["c only", *mid, *core]))]
    got = run(spark, docs)
    assert got == brute(docs)
    assert all(got[k + 1].count("\n") == 3 and got[k + 2] == "c only" for k in range(0, 90, 3))


def test_rows_of_one_key_or_none_are_rows_of_their_own(spark):
    run_ = "\n".join(f"a repeated line of words number {n}" for n in range(3))
    rows = [(1, run_), (7, f"{run_}\nkeep me zero"), (7, f"keep me one\nkeep me two\n{run_}"), (None, f"none is first\n{run_}"), (None, "another of none"), (9, run_), (9, run_)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, "another of none"), (0, f"none is first\n{run_}"), (1, ""), (7, "keep me one\nkeep me two"), (7, "keep me zero"), (9, ""), (9, "")]


def test_all_earlier_runs_go(spark):
    rnd = random.Random(9)
    line = lambda n: " ".join(f"{rnd.random():.9f}" for _ in range(n))
    docs = []
    for k in range(0, 150, 3):
        h, s, t = line(12), line(8), line(8)
        docs += [(k, h), (k + 1, "\n".join([line(7), h, s, t, line(6)])), (k + 2, "\n".join([line(9), h, s, t, line(5)]))]
    pool = [line(rnd.randint(1, 14)) for _ in range(30)]
    docs += [(k, "\n".join(rnd.sample(pool, rnd.randint(1, 20)))) for k in range(1000, 1200)]
    assert run(spark, docs) == brute(docs)


def test_edge_cases(spark, edge):
    got = L.dedup_lines(edge)
    assert got.columns == [*edge.columns, "__n_lines", "__n_removed"]
    rows = got.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge.count() and by[1]["text"] == by[2]["text"] == "" and by[6]["text"] == "" and by[5]["text"] != ""
    assert sum(r["doc_id"] == 5 and r["__n_removed"] == 0 for r in rows) == 2
    assert L.dedup_lines(edge.limit(0)).count() == 0
