"""TypeScript and JavaScript files: functions, classes, interfaces, function values under a name, calls, imports."""

from __future__ import annotations

import re

from .lexer import Source
from .rows import Out

# Segments of an assigned path that name no object.
NOISE = ("module", "exports", "prototype")
NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "super", "await", "new", "import", "require", "throw", "in", "of", "case", "delete", "void", "yield", "async"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "get", "set", "accessor", "*"}


def module_name(path: str) -> str:
    parts = re.sub(r"\.[^./]*$", "", path).split("/")
    return ".".join(parts[:-1] if parts[-1] == "index" else parts)


class _File:
    def __init__(self, s: Source, out: Out, module: str):
        self.s, self.out, self.module = s, out, module

    def statement_end(self, i: int, end: int) -> int:
        """After the statement at i: its semicolon, or the end of a line after which no expression goes on."""
        s = self.s
        while i < end:
            if s.at(i) == ";":
                return i + 1
            nxt = s.after(i)
            if nxt >= end:
                return end
            if s.tokens[nxt].line > s.tokens[nxt - 1].last_line and s.at(nxt) not in (".", "?", ":", "=", "+", "-", "*", "&&", "||", "=>", ",") and s.at(nxt - 1) not in ("=", ",", "=>", "(", "+", "-", "&&", "||", "?", ":"):
                return nxt
            i = nxt
        return end

    def function_value(self, i: int, end: int) -> tuple[int, int, str | None] | None:
        """Of a function or arrow at i: first and last token of its body, and its own name."""
        s = self.s
        i += s.at(i) == "async"
        if s.at(i) == "function":
            i += 1 + (s.at(i + 1) == "*")
            name = s.at(i) if s.word(i) else None
            while i < end and s.at(i) != "(":
                i = s.after(i)
            i = s.after(i) if i < end else end
            while i < end and s.at(i) != "{":
                i += 1
            return (i, s.tokens[i].match, name) if i < end else None
        i = s.generic(i, end)
        if s.at(i) == "(":
            k = s.after(i)
            if s.at(k) == ":":  # a result type, up to the arrow
                while k < end and s.at(k) != "=>" and s.at(k) != ";":
                    k = s.after(k)
        elif s.word(i):
            k = i + 1
        else:
            return None
        if s.at(k) != "=>":
            return None
        k += 1
        if s.at(k) == "{":
            return k, s.tokens[k].match, None
        stop = k
        while stop < end and s.at(stop) not in (",", ";", ")", "]", "}"):
            nxt = s.after(stop)
            if nxt < end and s.tokens[nxt].line > s.tokens[nxt - 1].last_line and s.at(nxt) not in (".", "?", ":", "+", "&&", "||"):
                return k, stop if s.tokens[stop].match < 0 else s.tokens[stop].match, None
            stop = nxt
        return k, stop - 1, None

    def add(self, kind: str, name: str, qualified: str, start: int, last: int, owner: str) -> str:
        s = self.s
        id_ = self.out.symbol(kind, name, qualified, self.module, s.tokens[start].line, s.tokens[min(last, len(s) - 1)].last_line, s.cut(start, last))
        self.out.edge("CONTAINS", owner, id_)
        return id_

    def calls(self, i: int, last: int, owner: str) -> None:
        """Calls from i to last; nested functions with a name of their own and classes are left out, arrows are not."""
        s = self.s
        while i <= last and i < len(s):
            if s.at(i) == "function" and s.word(i + 1) and s.at(i - 1) in (";", "{", "}", "") or s.at(i) == "class" and s.word(i + 1):
                k = i
                while k <= last and s.at(k) != "{":
                    k = s.after(k)
                i = s.after(k) if k <= last else k
                continue
            if s.word(i) and s.at(i + 1) == "(" and s.at(i) not in NO_CALL and s.at(i - 1) not in ("new", "function") or s.word(i) and s.at(i) in ("require", "import", "of", "in", "get", "set") and s.at(i + 1) == "(" and s.at(i - 1) != "function":
                own = s.at(i - 1) == "." and s.at(i - 2) == "this" and s.at(i - 3) != "."
                if s.at(i) != "import":
                    self.out.add("call", owner, s.at(i).lstrip("#") if s.at(i - 1) != "." else s.at(i), flag=own)
            i += 1

    def class_(self, start: int, i: int, owner: str, end: int) -> int:
        s = self.s
        name = s.at(i)
        qualified = f"{self.module}.{name}"
        k, bases, inside = s.generic(i + 1, end), [], False
        while k < end and s.at(k) != "{":
            if s.at(k) in ("extends", "implements"):
                inside = True
            elif inside and s.at(k) == "<":
                k = s.generic(k, end)
                continue
            elif inside and s.word(k) and s.at(k - 1) != ".":
                bases.append(s.at(k))
            k = s.after(k) if s.at(k) in ("(", "[") else k + 1
        close = s.tokens[k].match if k < end else end - 1
        id_ = self.add("class", name, qualified, start, close, owner)
        for b in bases:
            self.out.add("base", id_, b)
        i = k + 1
        while i < close:
            first = i
            while s.at(i) == "@":  # decorators
                i = s.after(i + 1)
                i = s.after(i) if s.at(i) == "(" else i
            while s.at(i) in MODIFIERS and s.at(i + 1) not in ("(", "=", ":", ";", "<"):
                i += 1
            if not s.word(i):
                i = s.after(i)
                continue
            title, k = s.at(i), s.generic(i + 1, close)
            if s.at(k) == "(":
                k = s.after(k)
                while k < close and s.at(k) not in ("{", ";"):
                    if s.tokens[k].line > s.tokens[k - 1].last_line:
                        break
                    k = s.after(k) if s.at(k) != "{" else k
                if s.at(k) == "{":
                    m = self.add("method", title, f"{qualified}.{title}", first, s.tokens[k].match, id_)
                    self.calls(k + 1, s.tokens[k].match - 1, m)
                    i = s.after(k)
                else:
                    i = k + 1 if s.at(k) == ";" else k
                continue
            while k < close and s.at(k) not in ("=", ";"):
                nxt = s.after(k)
                if nxt < close and s.tokens[nxt].line > s.tokens[nxt - 1].last_line:
                    k = nxt
                    break
                k = nxt
            if s.at(k) == "=" and (body := self.function_value(k + 1, close)):
                m = self.add("method", title, f"{qualified}.{title}", first, body[1], id_)
                self.calls(body[0], body[1], m)
                i = body[1] + 1
            elif s.at(k) == "=":
                i = self.statement_end(k, close)
            else:
                i = k + 1 if s.at(k) == ";" else max(k, i + 1)
        return close + 1

    def declarators(self, i: int, end: int, owner: str) -> int:
        s = self.s
        while i < end:
            start, name = i, s.at(i) if s.word(i) else None
            k = s.after(i)
            while k < end and s.at(k) not in ("=", ",", ";") and not (s.tokens[k].line > s.tokens[k - 1].last_line):
                k = s.after(k)
            if s.at(k) == "=":
                body = self.function_value(k + 1, end)
                if name and body:
                    id_ = self.add("function", name, f"{self.module}.{name}", start, body[1], owner)
                    self.calls(body[0], body[1], id_)
                    k = body[1] + 1
                else:
                    if s.at(k + 1) == "require" and s.at(k + 2) == "(" and k + 3 < end and s.tokens[k + 3].kind == "text":
                        self.out.add("import", self.module_id, s.at(k + 3).strip("\"'`"))
                    stop = self.statement_end(k, end)
                    while k < stop and s.at(k) != ",":
                        k = s.after(k)
            if s.at(k) == ",":
                i = k + 1
                continue
            return k + 1 if s.at(k) == ";" else k
        return end

    def assigned(self, i: int, end: int, owner: str) -> int | None:
        """A function put under a dotted path; the token after it, or None."""
        s = self.s
        k, path = i, []
        while s.word(k):
            path.append(s.at(k))
            if s.at(k + 1) != ".":
                break
            k += 2
        if not path or not s.word(k) or s.at(k + 1) != "=" or path[0] == "this":
            return None
        body = self.function_value(k + 2, end)
        if body is None:
            return None
        named = [x for x in path if x not in NOISE] or ([body[2]] if body[2] else [])
        if not named:
            return None
        kind = "method" if "prototype" in path and len(named) > 1 else "function"
        id_ = self.add(kind, named[-1], ".".join([self.module, *named]), i, body[1], owner)
        self.calls(body[0], body[1], id_)
        return body[1] + 1

    def walk(self, i: int, end: int, owner: str) -> None:
        s = self.s
        while i < end:
            start = i
            while s.at(i) in ("export", "default", "declare", "async", "abstract") and i + 1 < end and s.at(i + 1) not in ("=", "(", ".", ";"):
                i += 1
            word = s.at(i)
            if word == "function" and (s.word(i + 1) or s.at(i + 1) == "*" and s.word(i + 2)):
                body = self.function_value(i, end)
                if body is None:  # an overload without a body
                    i = self.statement_end(i, end)
                    continue
                first = i - 1 if s.at(i - 1) == "async" else i
                id_ = self.add("function", body[2], f"{self.module}.{body[2]}", first, body[1], owner)
                self.calls(body[0], body[1], id_)
                i = body[1] + 1
            elif word == "class" and s.word(i + 1):
                i = self.class_(i - 1 if s.at(i - 1) == "abstract" else i, i + 1, owner, end)
            elif word == "interface" and s.word(i + 1):
                k = i
                while k < end and s.at(k) != "{":
                    k = s.after(k)
                self.add("interface", s.at(i + 1), f"{self.module}.{s.at(i + 1)}", i, s.tokens[k].match if k < end else end - 1, owner)
                i = s.after(k) if k < end else end
            elif word in ("const", "let", "var") and s.at(i + 1) != "enum":
                i = self.declarators(i + 1, end, owner)
            elif word == "import" and s.at(i + 1) not in ("(", "."):
                stop = self.statement_end(i, end)
                texts = [k for k in range(i, stop) if s.tokens[k].kind == "text"]
                if texts:
                    self.out.add("import", self.module_id, s.at(texts[0]).strip("\"'`"))
                i = max(stop, i + 1)
            elif s.at(i - 1) != "." and (k := self.assigned(i, end, owner)) is not None:
                i = k
            elif s.at(i) in ("{", "("):  # blocks and calls may hold declarations
                self.walk(i + 1, s.tokens[i].match, owner)
                i = s.after(i)
            else:
                i += 1
            i = max(i, start + 1)


def extract(path: str, source: str) -> list[dict]:
    s = Source(source)
    module = module_name(path)
    out = Out("ts", path, scope=module)
    f = _File(s, out, module)
    f.module_id = out.file_module(module.rsplit(".", 1)[-1], module, source)
    f.walk(0, len(s), f.module_id)
    if not s.sound:
        out.add("warning", f"syntax errors in {path}; its graph may be partial")
    return out.rows
