"""The one row type that all extractors emit, and how files become rows.

Extraction has two passes: each file by itself gives nodes, certain edges and references by name (this package); joins
over the whole corpus resolve those (operators.resolve, plans.build). A row has a tag, and uses of the other fields
what that tag needs.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

#: Tags: node, edge (a: type, b: src, c: dst, d: confidence), call (a: caller, b: name, flag: own receiver),
#: base (a: type, b: name), import (a: module, b: target), attr (a: method, b: name), sql (a: owner, b: text),
#: orm (a: class, b: table, d: confidence), orm_column (a: class, b: column), fk (a: column or table, b: table),
#: query (a: owner, b: table), join (a: table, b: table), query_column (a: owner, b: table, c: column),
#: owns (a: method, b: owner's name, c: module), warning (a: text).
SCHEMA = (
    "tag string, lang string, file string, seq bigint, a string, b string, c string, d string, flag boolean, scope string, "
    "id string, kind string, name string, qualified_name string, module string, start_line bigint, end_line bigint, "
    "signature string, docstring string, code string, embed_text string, content_sha string"
)
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def first_line(text: str) -> str:
    """The first physical line, white space collapsed, without an opening brace at its end."""
    return re.sub(r"\s+", " ", text.split("\n", 1)[0]).strip().rstrip("{").strip()


@dataclass
class Out:
    """Collects the rows of one file."""

    lang: str
    file: str
    scope: str = ""
    rows: list[dict] = field(default_factory=list)

    def add(self, tag: str, a: str | None = None, b: str | None = None, c: str | None = None, d: str | None = None, flag: bool | None = None, **node) -> None:
        self.rows.append({"tag": tag, "lang": self.lang, "file": self.file, "seq": len(self.rows), "a": a, "b": b, "c": c, "d": d, "flag": flag, "scope": self.scope, **node})

    def edge(self, kind: str, src: str, dst: str, confidence: str = "EXTRACTED") -> None:
        self.add("edge", kind, src, dst, confidence)

    def node(self, id_: str, kind: str, name: str, qualified: str, module: str, start: int, end: int, signature: str = "", docstring: str = "", code: str = "", embed: str = "", digest: str = "") -> str:
        self.add(
            "node", id=id_, kind=kind, name=name, qualified_name=qualified, module=module, start_line=start, end_line=end,
            signature=signature, docstring=docstring, code=code, embed_text=embed, content_sha=digest,
        )
        return id_

    def symbol(self, kind: str, name: str, qualified: str, module: str, start: int, end: int, source: str, docstring: str = "") -> str:
        """A node whose signature is the first line of its source (all languages but Python)."""
        sig = first_line(source)
        embed = "\n".join(x for x in (f"{kind} {qualified}", sig, docstring) if x)
        return self.node(f"{self.file}::{qualified}#{start}", kind, name, qualified, module, start, end, sig, docstring, "", embed, sha(source))

    def file_module(self, name: str, qualified: str, source: str) -> str:
        return self.node(f"{self.file}::{qualified}", "module", name, qualified, qualified, 1, source.count("\n") + 1, embed=f"module {qualified}", digest=sha(source))
