"""Python files: modules, classes, functions, methods and marked comments, with calls, bases, imports and SQL strings."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from .rows import Out, sha

# What marks a comment, what looks like SQL, and names that map a class to a table.
MARKS = re.compile(r"#+\s*(NOTE|WHY|HACK|XXX|TODO|FIXME|IMPORTANT)\b", re.IGNORECASE)
SQL_LIKE = r"(?i)\b(create\s+table|insert\s+into|delete\s+from|update\s+\w+\s+set|select\b[\s\S]*?\bfrom)\b"
TABLE_NAMES = ("__tablename__", "db_table")
_SQL = re.compile(SQL_LIKE, re.DOTALL)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def module_name(path: str) -> str:
    parts = re.sub(r"\.[^./]*$", "", path).split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def _name(func: ast.expr) -> str | None:
    return func.id if isinstance(func, ast.Name) else func.attr if isinstance(func, ast.Attribute) else None


def _own(node: ast.expr) -> bool:
    return isinstance(node, ast.Name) and node.id in ("self", "cls")


class _File:
    def __init__(self, source: str, out: Out, module: str):
        self.out, self.module, self.lines = out, module, source.split("\n")
        self.spans: list[tuple[int, int, str]] = []  # of what owns comments
        # byte columns of the parser are not character columns where a line is not ASCII
        self.encoded = [x.encode("utf-8", "surrogatepass") for x in self.lines]

    def text(self, l0: int, c0: int, l1: int, c1: int) -> str:
        rows = self.encoded[l0 - 1 : l1]
        rows[-1] = rows[-1][:c1] if l0 != l1 else rows[-1][c0:c1]
        if l0 != l1:
            rows[0] = rows[0][c0:]
        return b"\n".join(rows).decode("utf-8", "replace")

    def symbol(self, node, kind: str, qualified: str) -> str:
        code = self.text(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)
        body = node.body[0]
        first = body.decorator_list[0] if isinstance(body, _DEFS) and body.decorator_list else body
        head = self.text(node.lineno, node.col_offset, first.lineno, first.col_offset)
        # comments between header and body are no part of the signature
        head = re.sub(r"\s+", " ", re.sub(r"(?m)#.*$", "", head)).strip().rstrip("@").strip().rstrip(":").strip()
        doc = (ast.get_docstring(node, clean=False) or "").strip()
        embed = "\n".join(x for x in (f"{kind} {qualified}", head, doc) if x).strip()
        id_ = self.out.node(f"{self.out.file}::{qualified}#{node.lineno}", kind, node.name, qualified, self.module, node.lineno, node.end_lineno, head, doc, code, embed, sha(code))
        self.spans.append((node.lineno, node.end_lineno, id_))
        return id_

    def walk(self, nodes, owner: str, qualified: str, in_class: bool) -> None:
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                self.class_(node, owner, f"{qualified}.{node.name}")
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{qualified}.{node.name}"
                id_ = self.symbol(node, "method" if in_class else "function", name)
                self.out.edge("CONTAINS", owner, id_)
                for part in node.body:
                    self.calls(part, id_)
                    self.sql(part, id_)
                self.walk(node.body, id_, name, False)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    self.out.add("import", self.module_id, a.name.split(".")[0])
            elif isinstance(node, ast.ImportFrom):
                module = (node.module or "").split(".")[0]
                for target in [module] if module else [a.name for a in node.names]:
                    self.out.add("import", self.module_id, target)
            else:
                self.walk(ast.iter_child_nodes(node), owner, qualified, in_class)

    def class_(self, node: ast.ClassDef, owner: str, qualified: str) -> None:
        id_ = self.symbol(node, "class", qualified)
        self.out.edge("CONTAINS", owner, id_)
        for base in node.bases:
            if name := _name(base):
                self.out.add("base", id_, name)
        for part in node.body:
            if isinstance(part, ast.Assign) and isinstance(part.value, ast.Constant) and isinstance(part.value.value, str) and _name(part.targets[0]) in TABLE_NAMES:
                self.out.add("orm", id_, part.value.value, d="EXTRACTED")
                break
        self.walk(node.body, id_, qualified, True)

    def calls(self, node: ast.AST, owner: str) -> None:
        """Calls and reads of own attributes; nested definitions have their own, lambdas do not."""
        if isinstance(node, _DEFS):
            return
        if isinstance(node, ast.Call) and (name := _name(node.func)):
            own = isinstance(node.func, ast.Attribute) and _own(node.func.value)
            self.out.add("call", owner, name, c=str(node.lineno), d=str(node.col_offset), flag=own)
        if isinstance(node, ast.Attribute) and _own(node.value):
            self.out.add("attr", owner, node.attr)
        for child in ast.iter_child_nodes(node):
            self.calls(child, owner)

    def sql(self, node: ast.AST, owner: str) -> None:
        if isinstance(node, _DEFS):
            return
        if isinstance(node, ast.JoinedStr):
            text = "".join(x.value if isinstance(x, ast.Constant) else "{}" for x in node.values)
            if _SQL.search(text):
                self.out.add("sql", owner, text)
            return
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and _SQL.search(node.value):
            self.out.add("sql", owner, node.value)
        for child in ast.iter_child_nodes(node):
            self.sql(child, owner)

    def comments(self, source: str) -> None:
        try:
            found = [(t.start[0], t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
        except (tokenize.TokenError, IndentationError, SyntaxError):
            return
        for line, text in found:
            if not MARKS.match(text):
                continue
            clean = text.lstrip("#").strip()
            owner = min(((e - s, id_) for s, e, id_ in self.spans if s <= line <= e), default=(0, self.module_id))[1]
            id_ = f"{self.out.file}::rationale@{line}"
            self.out.node(id_, "rationale", clean[:48], id_, self.module, line, line, "", clean, text, f"rationale {clean}", sha(text))
            self.out.edge("DOCUMENTS", id_, owner)


def recovered(source: str, most: int = 200) -> tuple[ast.Module | None, str]:
    """The tree of a source that does not parse, with the lines that keep it from parsing taken out one by one (first
    for `pass`, then for nothing); and the source without them. Lines keep their numbers. None after `most` lines."""
    lines, tried = source.split("\n"), set()
    for _ in range(most):
        try:
            return ast.parse("\n".join(lines)), "\n".join(lines)
        except SyntaxError as e:
            n = min(max(1, e.lineno or 1), len(lines)) - 1
        except ValueError:
            return None, source
        while n and n in tried and not lines[n].strip():
            n -= 1
        indent = lines[n][: len(lines[n]) - len(lines[n].lstrip())]
        lines[n] = "" if n in tried else f"{indent}pass"
        tried.add(n)
    return None, source


def extract(path: str, source: str) -> list[dict]:
    """Rows of one file. One that does not parse gives a warning and what can be read of it."""
    module = module_name(path)
    out = Out("python", path, scope=module)
    f = _File(source, out, module)
    f.module_id = f"{path}::{module}"
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        out.add("warning", f"syntax errors in {path}; its graph may be partial ({e})")
        tree, rest = recovered(source)
        if tree is None:
            out.node(f.module_id, "module", module.rsplit(".", 1)[-1], module, module, 1, len(f.lines), embed=f"module {module}", digest=sha(source))
            f.comments(source)
            return out.rows
        f = _File(rest, out, module)
        f.module_id = f"{path}::{module}"
    doc = (ast.get_docstring(tree, clean=False) or "").strip()
    out.node(f.module_id, "module", module.rsplit(".", 1)[-1], module, module, 1, len(f.lines), "", doc, "", f"module {module}\n{doc}".strip(), sha(source))
    f.walk(tree.body, f.module_id, module, False)
    for part in tree.body:
        f.sql(part, f.module_id)
    f.comments(source)
    return out.rows
