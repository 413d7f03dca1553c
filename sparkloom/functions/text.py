"""Column expressions over text: code tokens, names, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: capitals that no small letter follows, and digits with what they begin; or a word with at most one capital before it.
TOKEN = "[A-Z]+(?![a-z])(?:[0-9][a-z0-9]*)?|[A-Z]?[a-z][a-z0-9]*"


def tokenize(text: Column | str) -> Column:
    """Lower-case code tokens in order: words of letters and digits, split at camel humps; repeats stay.

    One pattern finds the pieces themselves, so a text is gone through once.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def last_segment(name: Column | str) -> Column:
    return F.substring_index(name, ".", -1)


def owner_name(name: Column | str) -> Column:
    """A qualified name without its last segment."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, r"\.?[^.]*$", "")


def dotted_suffixes(name: Column | str) -> Column:
    """The name and what remains of it after each dot."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def content_sha(content: Column | str) -> Column:
    return F.sha2(content, 256)


def module_name(path: Column | str) -> Column:
    """A path with dots for slashes, without its suffix and without a last __init__."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.regexp_replace(F.translate(bare, "/", "."), r"(^|\.)__init__$", "")


def clean_docstring(raw: Column | str) -> Column:
    """A string literal without prefix letters, quotes and outer white space."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    bare = F.regexp_replace(F.trim(raw), r"^[rRbBuUfF]{0,3}(?=[\"'])", "")
    return F.trim(F.regexp_replace(bare, r"(?s)^(\"\"\"|'''|\"|')(.*)\1$", "$2"))


def one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
