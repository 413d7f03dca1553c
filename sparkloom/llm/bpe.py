"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is one last token that its encoding can end with. An automaton with suffix
links over the vocabulary lists, for each end position, the tokens that end there, longest first; the first one that
is compatible with the last token of the prefix before it is stored. Following the stored tokens back from the end
gives the exact ids. Two tokens are compatible if encoding their joint string gives the two of them again, which
undoing the merges at their border decides.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import claim, small_batches, text_or_empty, trim

#: Entries of each of the two generations of a worker's cache of pre-tokens.
CACHE_ENTRIES = 200_000
#: Pre-tokens longer than this are encoded each time, so that the cache stays small.
CACHE_LENGTH = 64
UNASSIGNED = regex.compile(r"\p{Cn}")
#: Last characters of a word are moved by this in the automaton's alphabet, as they carry the end-of-word suffix.
LAST = 0x4000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class PrefixBPE:
    """Encoder and decoder of a tokenizers file with word ends (normalizers, pattern and vocabulary are read from it)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        # the same pattern for lower-case ASCII texts, without Unicode tables
        self.ascii_pattern = re.compile(self.pattern.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = r
            self.parts.setdefault(whole, (vocab[a], vocab[b]))
            self.born.setdefault(whole, r)
        self.library = Tokenizer.from_file(path)
        self.split = Split(Regex(self.pattern.pattern), "removed", invert=True)
        self.bytes = byte_alphabet()
        self.as_last = {ord(c): ord(c) + LAST for c in self.bytes}
        self.compatible = lru_cache(maxsize=200_000)(self._compatible)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            key, last = (t[: -len(self.suffix)], True) if self.suffix and t.endswith(self.suffix) and t != self.suffix else (t, False)
            if self._encodes_itself(i):
                self.automaton.add_word(key[:-1] + key[-1].translate(self.as_last) if last else key, (len(key), i))
        self.automaton.make_automaton()
        self.words = _Words(self)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b when their joint string is encoded."""
        until_a = until_b = len(self.rank)  # ranks at which the piece left and right of the border becomes part of a larger one
        while True:
            r = self.rank.get((a, b))
            # of two equal pairs the left one merges first, so a tie saves the pair only against the left piece's own merge
            if r is not None and r < until_a and r <= until_b:
                return False
            ra, rb = self.born.get(a, -1), self.born.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:
                until_a, a = ra, self.parts[a][1]
            else:
                until_b, b = rb, self.parts[b][0]

    def _encodes_itself(self, i: int) -> bool:
        if i not in self.parts:
            return True
        left, right = self.parts[i]
        return self._encodes_itself(left) and self._encodes_itself(right) and self._first_crossing(left, right) == self.born[i]

    def _first_crossing(self, a: int, b: int) -> int | None:
        """The rank of the first merge across the border of a and b, if they are whole by then."""
        until_a = until_b = len(self.rank)
        first = None
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < until_a and r <= until_b:
                first = r
            ra, rb = self.born.get(a, -1), self.born.get(b, -1)
            if ra < 0 and rb < 0:
                return first
            if ra >= rb:
                until_a, a = ra, self.parts[a][1]
            else:
                until_b, b = rb, self.parts[b][0]

    def encode_word(self, word: str) -> list[int]:
        s = "".join(map(self.bytes.__getitem__, word.encode("utf-8", "surrogatepass")))
        if self.suffix:
            s = s[:-1] + s[-1].translate(self.as_last)
        size = len(s) + 1
        last: list[int] = [-1] * size
        length = [0] * size
        compatible = self.compatible
        done = -1
        for end, (n, i) in self.automaton.iter(s):  # for each end the longest token first
            if end == done:
                continue
            start = end + 1 - n
            if not start or ((before := last[start]) >= 0 and compatible(before, i)):
                done = end
                last[end + 1], length[end + 1] = i, n
        ids, at = [], size - 1
        while at:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def _pretokens(self, text: str) -> list[str]:
        if not text.isascii() and UNASSIGNED.search(text):
            # characters that only the library's newer Unicode tables may know: it finds the pre-tokens here
            normal = self.library.normalizer.normalize_str(text)
            return [x for x, _ in self.split.pre_tokenize_str(normal)]
        s = text if text.isascii() else unicodedata.normalize("NFC", text)
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        if "Σ" in s:  # the library lowers each character by itself, without the rule for a final sigma
            s = s.replace("Σ", "σ")
        return self.pattern.findall(s.lower())

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """For each pre-token its ids as 32-bit numbers, and what they decode to."""
        found = self.words.__getitem__
        if not (self.at_special and "<|" in text):
            return list(map(found, self._pretokens(text)))
        out: list[tuple[bytes, str]] = []
        for k, part in enumerate(self.at_special.split(text)):
            if k % 2:
                out.append((np.int32(self.special[part]).tobytes(), part))
            else:
                out.extend(map(found, self._pretokens(part)))
        return out

    def encode_and_decode(self, text: str) -> tuple[bytes, str]:
        """The ids as 32-bit numbers, and what they decode to."""
        found = self.pieces(text)
        return b"".join([x for x, _ in found]), " ".join([d for _, d in found])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_and_decode(text)[0], np.int32).tolist()

    def forget(self) -> None:
        """Empties the caches."""
        self.words.old = {}
        self.words.clear()
        self.compatible.cache_clear()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: the tokens are joined by one space."""
        return " ".join(map(self.token.__getitem__, ids))


class _Words(dict):
    """Pre-token to its ids as bytes and their decoded form. When it is full, it becomes the old generation, from which
    what is asked for again comes back: frequent words stay."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        out = self.old.get(word)
        if out is None:
            ids = self.bpe.encode_word(word)
            out = array("i", ids).tobytes(), self.bpe.decode(ids)
            if len(word) > CACHE_LENGTH:
                return out
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rows: int = 256) -> DataFrame:
    """keys, ids array<int>, decoded string of every row of df; other columns are left out.

    A null text counts as empty and gives no ids and an empty string. Repeated rows are encoded each by itself, an
    empty table gives an empty one. Texts of any length are encoded whole, in time in proportion to their length.
    path must lead to the tokenizer's file on every executor.
    """
    small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{k}`").alias(k) for k in keys], text_or_empty(f"`{text}`").alias("__text"))
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        claim("bpe", bpe.forget)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = [bpe.encode_and_decode(t) for t in batch.column(len(names)).to_pylist()]
                decoded = pa.array([d for _, d in found], pa.large_string()).cast(pa.string())
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x, _ in found], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join([x for x, _ in found]), np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], lists, decoded], names=[*names, "ids", "decoded"])
        trim()

    fields = ", ".join(f"`{n}` {t}" for n, t in source.dtypes if n != "__text")
    return source.mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def digests(df: DataFrame) -> DataFrame:
    """n_tokens and the two digests of what encode_decode returns."""
    keys = [c for c in df.columns if c not in ("ids", "decoded")]
    return df.select(
        *keys,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
