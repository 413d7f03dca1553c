"""Go files: types, functions, receiver methods, embedded types, calls, imports."""

from __future__ import annotations

from .lexer import Source
from .rows import Out

NO_CALL = {"if", "for", "switch", "return", "func", "go", "defer", "select", "range", "case", "map", "chan", "interface", "struct", "type"}


class _File:
    def __init__(self, s: Source, out: Out):
        self.s, self.out = s, out

    def imports(self, i: int) -> int:
        s = self.s
        end = s.tokens[i].match if s.at(i) == "(" else i + 1
        while i <= end and i < len(s):
            if s.tokens[i].kind == "text":
                self.out.add("import", self.module_id, s.at(i).strip('"`'))
                if s.at(end) != ")":
                    return i + 1
            elif s.at(end) != ")":
                end += 1  # an alias before the path
            i += 1
        return end + 1

    def type_end(self, i: int, limit: int) -> int:
        """The last token of a type that starts at i: up to the end of its line, brackets taken whole."""
        s = self.s
        k = i
        while k + 1 < limit:
            nxt = s.after(k)
            if nxt >= limit or s.tokens[nxt].line > s.tokens[nxt - 1].last_line or s.at(nxt) == ";":
                return nxt - 1
            k = nxt
        return k

    def type_spec(self, i: int, limit: int, scope: str) -> int:
        s = self.s
        name, k = s.at(i), i + 1
        if s.at(k) == "[" and s.word(k + 1) and s.at(k + 2) != "]" and s.tokens[k].match - k > 1:
            k = s.after(k)  # type parameters
        alias = s.at(k) == "="
        k += alias
        last = self.type_end(k, limit)
        if not alias:
            kind = "interface" if s.at(k) == "interface" else "class"
            id_ = self.out.symbol(kind, name, f"{scope}.{name}", self.module, s.tokens[i].line, s.tokens[last].last_line, s.cut(i, last))
            self.out.edge("CONTAINS", self.module_id, id_)
            if s.at(k) == "struct" and s.at(k + 1) == "{":
                self.embedded(k + 2, s.tokens[k + 1].match, id_)
        return last + 1

    def embedded(self, i: int, end: int, owner: str) -> None:
        """Fields without a name of their own: one type, perhaps behind a star or a package."""
        s = self.s
        while i < end:
            row, k = [], i
            line = s.tokens[i].line
            while k < end and s.tokens[k].line == line and s.at(k) != ";":
                row.append(k)
                k = s.after(k)
            marks = [s.at(x) for x in row if s.tokens[x].kind != "text"]
            words = [x for x in marks if x not in ("*", ".")]
            if len(words) == 1 and all(c in ("*", ".") or c == words[0] for c in marks) and "." not in marks:
                self.out.add("base", owner, words[0])
            elif len(marks) in (3, 4) and marks[-2] == "." and marks[:-3] in ([], ["*"]):
                self.out.add("base", owner, marks[-1])
            i = k + (s.at(k) == ";")

    def func(self, i: int, scope: str) -> int:
        s = self.s
        start, k = i, i + 1
        receiver = variable = None
        if s.at(k) == "(":
            inside = [x for x in range(k + 1, s.tokens[k].match)]
            words = []
            depth_end = -1
            for x in inside:
                if x <= depth_end:
                    continue
                if s.at(x) == "[":
                    depth_end = s.tokens[x].match
                elif s.word(x):
                    words.append(x)
            if words:
                receiver = s.at(words[-1])
                if len(words) > 1 and s.at(words[0] + 1) != ".":
                    variable = s.at(words[0])
            k = s.tokens[k].match + 1
        name = s.at(k)
        while k < len(s) and s.at(k) != "{":
            nxt = s.after(k)
            if nxt < len(s) and s.tokens[nxt].line > s.tokens[nxt - 1].last_line and s.at(nxt) != "{":
                break
            # braces of a result type such as struct{} or interface{}
            if s.at(k) in ("interface", "struct") and s.at(nxt) == "{":
                nxt = s.after(nxt)
            k = nxt
        last = s.tokens[k].match if s.at(k) == "{" else min(k, len(s) - 1)
        qualified = f"{scope}.{receiver}.{name}" if receiver else f"{scope}.{name}"
        id_ = self.out.symbol("method" if receiver else "function", name, qualified, self.module, s.tokens[start].line, s.tokens[last].last_line, s.cut(start, last))
        if receiver:
            self.out.add("owns", id_, f"{scope}.{receiver}", self.module_id)
        else:
            self.out.edge("CONTAINS", self.module_id, id_)
        if s.at(k) == "{":
            for x in range(k + 1, last):
                if s.word(x) and s.at(x + 1) == "(" and s.at(x) not in NO_CALL:
                    own = variable is not None and s.at(x - 1) == "." and s.at(x - 2) == variable and s.at(x - 3) != "."
                    self.out.add("call", id_, s.at(x), flag=own)
        return last + 1


def extract(path: str, source: str) -> list[dict]:
    s = Source(source)
    out = Out("go", path)
    f = _File(s, out)
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    package = s.at(1) if s.at(0) == "package" else ""
    f.module = f"{package}.{stem}" if package else stem
    out.scope = package
    f.module_id = out.file_module(stem, f.module, source)
    scope = package or stem
    i = 2 if package else 0
    while i < len(s):
        word = s.at(i)
        if word == "import":
            i = f.imports(i + 1)
        elif word == "type" and s.at(i + 1) == "(":
            end, i = s.tokens[i + 1].match, i + 2
            while i < end:
                i = f.type_spec(i, end, scope) if s.word(i) else i + 1
            i = end + 1
        elif word == "type" and s.word(i + 1):
            i = f.type_spec(i + 1, len(s), scope)
        elif word == "func":
            i = f.func(i, scope)
        else:
            i = s.after(i)
    if not s.sound:
        out.add("warning", f"syntax errors in {path}; its graph may be partial")
    return out.rows
