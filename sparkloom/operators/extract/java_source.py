"""Java files: types, methods and constructors, JPA mappings, bases, calls, imports."""

from __future__ import annotations

import re

from .lexer import Source
from .rows import Out

KINDS = {"class": "class", "interface": "interface", "enum": "class", "record": "class", "@interface": "interface"}
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non"}
NO_CALL = {"if", "for", "while", "switch", "catch", "synchronized", "return", "super", "this", "new", "throw", "assert", "try"}


def javadoc(comment: str) -> str:
    """The prose of a /** */ comment, without its gutter and tag lines."""
    if not comment.startswith("/**"):
        return ""
    rows = (x.strip().lstrip("*").strip() for x in comment.removeprefix("/**").removesuffix("*/").splitlines())
    return " ".join(x for x in rows if x and not x.startswith("@"))


class _File:
    def __init__(self, s: Source, out: Out, module: str):
        self.s, self.out, self.module = s, out, module

    def annotations(self, i: int) -> tuple[int, dict[str, dict[str, str]]]:
        """After annotations and modifiers from i on, and the arguments of each annotation."""
        s, found = self.s, {}
        while i < len(s):
            if s.at(i) == "@" and s.at(i + 1) != "interface":
                name = s.at(i + 1)
                i += 2
                while s.at(i) == "." and s.word(i + 1):
                    name = s.at(i + 1)
                    i += 2
                args: dict[str, str] = {}
                if s.at(i) == "(":
                    end = s.tokens[i].match
                    k = i + 1
                    while k < end:
                        if s.word(k) and s.at(k + 1) == "=":
                            args[s.at(k)] = s.at(k + 2).strip('"')
                            k += 3
                        elif s.tokens[k].kind == "text" and s.at(k - 1) in ("(",):
                            args["value"] = s.at(k).strip('"')
                            k += 1
                        else:
                            k = s.after(k)
                    i = end + 1
                found[name] = args
            elif s.at(i) in MODIFIERS:
                i += 3 if s.at(i) == "non" and s.at(i + 1) == "-" else 1
            else:
                break
        return i, found

    def type_names(self, i: int, end: int, stops: set[str]) -> tuple[int, list[str]]:
        names = []
        while i < end and s_not(self.s.at(i), stops):
            if self.s.word(i):
                name = self.s.at(i)
                i += 1
                while self.s.at(i) == "." and self.s.word(i + 1):
                    name += "." + self.s.at(i + 1)
                    i += 2
                i = self.s.generic(i, end)
                names.append(name)
            else:
                i = self.s.after(i)
        return i, names

    def members(self, i: int, end: int, owner: str, scope: str, mapped: bool, enum: bool = False) -> None:
        s = self.s
        if enum:  # constants up to the first semicolon
            while i < end and s.at(i) != ";":
                i = s.after(i)
            i += 1
        while i < end:
            start, doc = i, javadoc(s.comment_before.get(i, ""))
            i, notes = self.annotations(i)
            if i >= end:
                break
            word = s.at(i) + s.at(i + 1) if s.at(i) == "@" else s.at(i)
            if word in KINDS and s.word(i + (2 if word == "@interface" else 1)) and (word != "record" or s.at(i + 2) in ("(", "<")):
                i = self.type_(start, i, word, owner, scope, notes, doc, end)
                continue
            if s.at(i) == "{":  # an initialiser
                i = s.after(i)
                continue
            if s.at(i) in (";", ","):
                i += 1
                continue
            i = s.generic(i, end)
            # a member runs to its semicolon, or to its body when parentheses come before any =
            k, name, is_method = i, None, False
            while k < end and s.at(k) not in (";", "{", "="):
                if s.at(k) == "(" and s.word(k - 1) and name is None:
                    name, is_method = k - 1, True
                k = s.after(k) if s.at(k) in ("(", "[") else k + 1
            if is_method:
                body = k if s.at(k) == "{" else None
                if s.at(k) == "=":  # the default of an annotation's element
                    while k < end and s.at(k) != ";":
                        k = s.after(k)
                last = s.tokens[k].match if body is not None else k
                self.method(start, name, last, body, owner, scope, doc)
                i = last + 1
                continue
            if mapped:
                self.field(notes, i, k, owner)
            while k < end and s.at(k) != ";":
                k = s.after(k)
            i = k + 1

    def field(self, notes: dict, i: int, k: int, owner: str) -> None:
        note = notes.get("Column", notes.get("JoinColumn"))
        if note is None:
            return
        names = [x for x in range(i, k) if self.s.word(x)]
        column = note.get("name") or note.get("value") or (self.s.at(names[-1]) if names else None)
        if column:
            self.out.add("orm_column", owner, column)

    def method(self, start: int, name: int, last: int, body: int | None, owner: str, scope: str, doc: str) -> None:
        s = self.s
        title = s.at(name)
        id_ = self.out.symbol("method", title, f"{scope}.{title}", self.module, s.tokens[start].line, s.tokens[min(last, len(s) - 1)].last_line, s.cut(start, last), doc)
        self.out.edge("CONTAINS", owner, id_)
        if body is not None:
            self.calls(body + 1, s.tokens[body].match, id_)

    def type_(self, start: int, i: int, word: str, owner: str, scope: str, notes: dict, doc: str, end: int) -> int:
        s = self.s
        i += 2 if word == "@interface" else 1
        name = s.at(i)
        qualified = f"{scope}.{name}"
        k = i + 1
        bases: list[str] = []
        while k < end and s.at(k) != "{":
            if s.at(k) in ("extends", "implements"):
                interface_parent = word == "interface" and s.at(k) == "extends"
                k, found = self.type_names(k + 1, end, {"{", "extends", "implements", "permits"})
                bases += [] if interface_parent else [b for b in found if "." not in b]
            elif s.at(k) == ";":
                break
            else:
                k = s.generic(k, end) if s.at(k) == "<" else s.after(k)
        close = s.tokens[k].match if s.at(k) == "{" else min(k, len(s) - 1)
        id_ = self.out.symbol(KINDS[word], name, qualified, self.module, s.tokens[start].line, s.tokens[close].last_line, s.cut(start, close), doc)
        self.out.edge("CONTAINS", owner, id_)
        mapped = "Entity" in notes or "Table" in notes
        if mapped:
            table = notes.get("Table", {}).get("name") or notes.get("Table", {}).get("value")
            guess = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
            self.out.add("orm", id_, table or guess, d="EXTRACTED" if table else "INFERRED")
        for b in bases:
            self.out.add("base", id_, b)
        if s.at(k) == "{":
            self.members(k + 1, close, id_, qualified, mapped, word == "enum")
        return close + 1

    def calls(self, i: int, end: int, owner: str) -> None:
        """Calls up to end; types declared inside have their own."""
        s = self.s
        while i < end:
            word = s.at(i)
            if word in ("class", "interface", "enum", "record") and s.word(i + 1) and s.at(i - 1) != ".":
                k = i + 1
                while k < end and s.at(k) != "{" and s.at(k) != ";":
                    k = s.after(k)
                if s.at(k) == "{" and (word != "record" or s.at(i + 2) in ("(", "<")):
                    i = s.after(k)
                    continue
            if word == "new" and s.word(i + 1):
                k, name = i + 2, s.at(i + 1)
                while s.at(k) == "." and s.word(k + 1):
                    name += "." + s.at(k + 1)
                    k += 2
                if s.at(s.generic(k, end)) == "(":
                    self.out.add("call", owner, name, flag=False)
                i = k
                continue
            if s.word(i) and s.at(i + 1) == "(" and word not in NO_CALL:
                own = s.at(i - 1) != "." or (s.at(i - 2) == "this" and s.at(i - 3) != ".")
                self.out.add("call", owner, word, flag=own)
            i += 1


def s_not(text: str, stops: set[str]) -> bool:
    return text not in stops


def extract(path: str, source: str) -> list[dict]:
    s = Source(source)
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    package, i = "", 0
    f = _File(s, Out("java", path), "")
    k, _ = f.annotations(0)
    if s.at(k) == "package":
        j = k + 1
        while j < len(s) and s.at(j) != ";":
            package += s.at(j)
            j += 1
        i = j + 1
    module = f"{package}.{stem}" if package else stem
    out = f.out
    out.scope = package
    f.module = module
    id_ = out.file_module(stem, module, source)
    while s.at(i) == "import" or s.at(i) == ";":
        j, target = i + 1, ""
        while s.at(i) == "import" and j < len(s) and s.at(j) != ";":
            target += s.at(j) if s.at(j) != "static" else ""
            j += 1
        if target:
            out.add("import", id_, target.removesuffix(".*"))
        i = j + (s.at(i) == "import")
    f.members(i, len(s), id_, package or stem, False)
    # what is no type at the top level is no member either
    if not s.sound:
        out.add("warning", f"syntax errors in {path}; its graph may be partial")
    return out.rows
