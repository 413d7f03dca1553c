import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from sparkloom.llm import quality
from tests.llm.conftest import EDGE
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_line_dedup import brute as lines


def test_stages_against_brute_force(spark, data, documents, tmp_path):
    kept = documents
    seen = []
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, kept, data)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(C.STAGES) - 1:
            assert after.columns == documents.columns, name
        seen.append((kept.toPandas(), after.toPandas()))
        kept = after
    before, after = seen[0]
    scored = quality.classify(documents, spark.read.parquet(f"{data}/labels.parquet")).collect()
    want = {r["doc_id"] for r in scored if r["quality_score"] >= 0.5 and r["toxic_score"] < 0.35}
    assert set(after.doc_id) == want and len(after) < len(before)
    before, after = seen[1]
    want = lines(list(zip(before.doc_id, before.text, strict=True)))
    was = dict(zip(before.doc_id, before.text, strict=True))
    assert dict(zip(after.doc_id, after.text, strict=True)) == {k: t for k, t in want.items() if t.strip() or t == was[k]}
    assert (after.n_chars == after.text.str.len()).all()
    before, after = seen[2]
    want = components(list(zip(before.doc_id, before.text, strict=True)))
    assert set(after.doc_id) == {k for k, (_, c) in want.items() if c == k}
    before, after = seen[3]
    times = after.doc_id.value_counts()
    assert times.max() <= 2 and set(after.doc_id) <= set(before.doc_id)
    before, after = seen[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in zip(before.doc_id, before.text, strict=True)}
    assert all(n[k] == x for k, x in zip(after.doc_id, after.n_tokens, strict=True)) and len(after) == len(before)


def test_run_takes_all_stages(spark, data):
    assert C.run(spark, data).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_edge_cases(spark, data, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in C.STAGES:
        rows = stage(spark, docs, data).collect()
        ids = {r["doc_id"] for r in rows}
        assert stage(spark, docs.limit(0), data).count() == 0
        want = {
            "line dedup": {1, 2, 3, 4, 5, 7, 8, None},  # 6 is all repeats
            "n-gram Jaccard join": {1, 2, 3, 4, 5, 7, 8, None},  # 6 is a copy of 5
            "BPE encoding and decoding": {1, 2, 3, 4, 5, 6, 7, 8, None},
        }
        assert ids == want.get(name, ids) and ids <= {1, 2, 3, 4, 5, 6, 7, 8, None} and len(rows) <= 2 * len(EDGE)
