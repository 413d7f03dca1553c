"""SQL files and strings: CREATE TABLE gives tables, columns and foreign keys; other statements what they touch."""

from __future__ import annotations

import re

from .rows import Out, sha

_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|(?P<text>'(?:''|[^'])*')|(?P<name>"(?:""|[^"])+"|`[^`]+`|\[[A-Za-z_][^\]]*\]|[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>[^\s\w])""", re.DOTALL)
# Words that end a column's type, start a table constraint, or follow a table name without naming an alias.
TYPE_ENDS = {"NOT", "NULL", "PRIMARY", "UNIQUE", "REFERENCES", "DEFAULT", "CHECK", "CONSTRAINT", "COLLATE", "GENERATED", "AUTO_INCREMENT", "AUTOINCREMENT", "COMMENT", "ON", "IDENTITY"}
CONSTRAINTS = {"CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "KEY", "INDEX", "EXCLUDE", "LIKE"}
TABLE_AFTER = {"FROM", "JOIN", "INTO", "UPDATE", "TABLE", "USING"}
NO_TABLE = {"SELECT", "SET", "VALUES", "WHERE", "LATERAL", "ONLY", "UNNEST"}
START = {"SELECT", "INSERT", "UPDATE", "DELETE", "WITH", "MERGE", "CREATE", "DROP", "ALTER", "TRUNCATE"}


class Token(str):
    line: int
    kind: str


def tokens(source: str) -> list[list[Token]]:
    """The tokens of each statement, semicolons left out."""
    out: list[list[Token]] = [[]]
    line, at = 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        if not m.lastgroup:
            continue
        t = Token(m.group())
        t.line, t.kind = line, m.lastgroup
        if t == ";":
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def bare(t: str) -> str:
    return t[1:-1] if t[:1] in '"`[' else t


def _dotted(ts: list[Token], i: int) -> tuple[str, int]:
    name = bare(ts[i])
    while i + 2 < len(ts) and ts[i + 1] == "." and ts[i + 2].kind == "name":
        name += "." + bare(ts[i + 2])
        i += 2
    return name, i + 1


def _close(ts: list[Token], i: int) -> int:
    depth = 0
    for k in range(i, len(ts)):
        depth += {"(": 1, ")": -1}.get(ts[k], 0)
        if not depth:
            return k
    return len(ts)


def _upper(ts: list[Token], i: int) -> str:
    return ts[i].upper() if 0 <= i < len(ts) else ""


def is_create(ts: list[Token]) -> bool:
    head = [t.upper() for t in ts[:5]]
    return head[:1] == ["CREATE"] and "TABLE" in head[:4]


def create_table(ts: list[Token], out: Out, line: int) -> None:
    i = next(k for k, t in enumerate(ts) if t.upper() == "TABLE") + 1
    while _upper(ts, i) in ("IF", "NOT", "EXISTS"):
        i += 1
    if i >= len(ts) or ts[i].kind != "name":
        return
    qualified, i = _dotted(ts, i)
    name = qualified.rsplit(".", 1)[-1]
    columns: list[tuple[str, str]] = []
    keys: list[tuple[str | None, str]] = []
    if i < len(ts) and ts[i] == "(":
        end = _close(ts, i)
        k = i + 1
        while k < end:
            stop = k
            while stop < end and ts[stop] != ",":
                stop = _close(ts, stop) + 1 if ts[stop] == "(" else stop + 1
            part = ts[k:stop]
            if part and not (part[0].upper() in CONSTRAINTS and ts[k].kind == "name" and ts[k][:1] not in '"`['):
                column = bare(part[0])
                cut = next((x for x in range(1, len(part)) if part[x].upper() in TYPE_ENDS), len(part))
                kind = ""
                for x in part[1:cut]:
                    kind += x.upper() if not kind or x in "(),." or kind[-1] in "(." else (" " if kind[-1] == "," or x[0].isalnum() else "") + x.upper()
                columns.append((column, kind.replace("( ", "(")))
                source: str | None = column
            else:
                source = None
            local = []
            for x, t in enumerate(part):
                if t.upper() == "FOREIGN" and x + 2 < len(part) and part[x + 2] == "(":
                    local = [bare(c) for c in part[x + 3 : _close(part, x + 2)] if c != ","]
                if t.upper() == "REFERENCES" and x + 1 < len(part):
                    target, _ = _dotted(part, x + 1)
                    keys += [(c, target) for c in local] if local else [(source, target)]
            k = stop + 1
    summary = ", ".join(f"{c} {t}".strip() for c, t in columns)
    table = f"{out.file}::table.{qualified}"
    out.node(table, "table", name, qualified, out.file, line, line, f"TABLE {qualified} ({summary})", embed=f"table {qualified}\ncolumns: {summary}", digest=sha(f"{qualified}|{summary}|{line}"))
    known = set()
    for c, t in columns:
        q = f"{qualified}.{c}"
        id_ = out.node(f"{table}.{c}", "column", c, q, out.file, line, line, f"{c} {t}".strip(), embed=f"column {q} {t}".strip(), digest=sha(f"{q}|{t}|{line}"))
        out.edge("CONTAINS", table, id_)
        known.add(c)
    for c, target in keys:
        out.add("fk", f"{table}.{c}" if c in known else table, target)


def touched(ts: list[Token], owner: str, out: Out) -> None:
    """Tables that a statement names, those it joins, and columns written with a table's name."""
    names, joined, first, with_names = [], [], None, set()
    for i, t in enumerate(ts):
        if t.upper() == "AS" and _upper(ts, i + 1) == "(" and i:
            with_names.add(bare(ts[i - 1]))
    i = 0
    while i < len(ts):
        word = ts[i].upper()
        if ts[i].kind == "name" and word in TABLE_AFTER and not (word == "UPDATE" and _upper(ts, i - 1) in ("FOR", "ON", "DO", "KEY")):
            k, comma = i + 1, True
            while comma and k < len(ts) and ts[k].kind == "name" and _upper(ts, k) not in NO_TABLE:
                name, k = _dotted(ts, k)
                if not (k < len(ts) and ts[k] == "(" and word != "INTO") and name not in with_names:
                    names.append(name)
                    if word == "FROM" and first is None:
                        first = name
                    elif word == "JOIN":
                        joined.append(name)
                if _upper(ts, k) == "AS":
                    k += 1
                if k < len(ts) and ts[k].kind == "name" and _upper(ts, k) not in NO_TABLE | TABLE_AFTER | {"ON", "LEFT", "RIGHT", "INNER", "OUTER", "CROSS", "FULL", "ORDER", "GROUP", "LIMIT", "HAVING", "UNION", "NATURAL", "RETURNING"}:
                    k += 1
                comma = word == "FROM" and k < len(ts) and ts[k] == ","
                k += comma
            i = max(k if k > i + 1 else i + 1, i + 1)
            continue
        i += 1
    for name in names:
        out.add("query", owner, name)
    if first:
        a = first.rsplit(".", 1)[-1]
        for name in joined:
            if (b := name.rsplit(".", 1)[-1]) != a:
                out.add("join", a, b)
    for i in range(len(ts) - 2):
        if ts[i].kind == "name" and ts[i + 1] == "." and ts[i + 2].kind == "name" and (i == 0 or ts[i - 1] != ".") and _upper(ts, i + 3) != ".":
            if _upper(ts, i - 1) not in TABLE_AFTER:
                out.add("query_column", owner, bare(ts[i]), bare(ts[i + 2]))


def extract(path: str, source: str) -> list[dict]:
    """Rows of one file: its CREATE TABLE statements."""
    out = Out("sql", path)
    for ts in tokens(source):
        if is_create(ts):
            create_table(ts, out, ts[0].line)
    if source.count("(") != source.count(")"):
        out.add("warning", f"SQL parse failed for {path}; its graph may be partial")
    return out.rows


def extract_embedded(owner: str, path: str, text: str) -> list[dict]:
    """Rows of one string in a file: tables that it creates (without a line), or what it touches."""
    out = Out("embedded", path)
    for ts in tokens(text):
        if is_create(ts):
            create_table(ts, out, 0)
        elif ts[0].upper() in START:
            touched(ts, owner, out)
    return out.rows
