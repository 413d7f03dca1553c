import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library_on_documents(spark, documents, texts, library):
    got = bpe.encode_decode(documents, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_equals_the_library_on_odd_strings(library):
    rnd, mine = random.Random(7), bpe.load(PATH)
    parts = ["a", "th", "in", "er", "'s", "'LL", " ", "\n", "é", "é", "ß", "1", "…", "Σ", "İ", "<|endoftext|>", "<|", "漢", "😀", "aaaa", "__", " ", "　", "\x00"]
    for _ in range(4000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert mine.encode(s) == library.encode(s, add_special_tokens=False).ids, repr(s)
    for _ in range(4000):
        s = "".join(rnd.choice("abdeinorst") for _ in range(rnd.randint(1, 30)))
        assert mine.encode(s) == library.encode(s, add_special_tokens=False).ids, s
    parts += ["\x1c", "\x85", "\u2028", "\xa0", " one, Two", "e\u0301", "\u0301", "x's", "don't"]
    for _ in range(4000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        want = library.encode(s, add_special_tokens=False).ids
        ids, decoded = mine.encode_and_decode(s)
        assert np.frombuffer(ids, np.int32).tolist() == want and decoded == library.decode(want, skip_special_tokens=False), repr(s)
    s = "ab" * 40_000  # one pre-token
    assert mine.encode(s) == library.encode(s, add_special_tokens=False).ids


def test_equals_the_library_on_characters_of_every_unicode_version(library):
    rnd, mine = random.Random(8), bpe.load(PATH)
    unknown = [chr(c) for c in range(0x80, 0x33480) if bpe.UNASSIGNED.match(chr(c))]
    for _ in range(6000):
        s = "ab" + rnd.choice(unknown) + rnd.choice(["", "cd ", " 1"]) + rnd.choice(unknown) + chr(rnd.choice([0x1C89, 0xA7CB, 0x10D50, 0x16D43, 0x61]))
        assert mine.encode(s) == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_edge_cases(spark, edge, library):
    got = bpe.digests(bpe.encode_decode(edge, PATH)).collect()
    assert len(got) == edge.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[7]["n_tokens"] == 0
    assert by[4]["n_tokens"] == len(library.encode(edge.where("doc_id = 4").first()["text"], add_special_tokens=False).ids)
    assert bpe.encode_decode(edge.limit(0), PATH).count() == 0


def test_caches_go_when_another_operator_begins(monkeypatch):
    from sparkloom.llm import common

    monkeypatch.setattr(common, "_caches", {})
    mine, gone = bpe.load(PATH), []
    mine.encode("some words to keep")
    common.claim("bpe", mine.forget)
    common.claim("bpe", mine.forget)
    assert len(mine.words) >= 4
    common.claim("other", lambda: gone.append(1))
    assert not mine.words and not gone
    common.claim("bpe", mine.forget)
    assert gone == [1]
