"""What the extractors find in small sources."""

from sparkloom.operators.extract import go_source, java_source, python_source, sql_source, ts_source


def by(rows, tag):
    return [r for r in rows if r["tag"] == tag]


def nodes(rows):
    return {r["qualified_name"]: r for r in by(rows, "node")}


def calls(rows):
    return {(r["a"].split("::")[-1].split("#")[0], r["b"], r["flag"]) for r in by(rows, "call")}


PY = '''# a licence
"""Doc of module."""
from . import near
from .far.away import x
import os.path as p

class A(base.B, C):
    """Doc of A."""
    db_table = "t_a"

    # todo: later
    @property
    def m(self):
        def inner():
            return deep()
        return self.n(lambda: other())

    async def n(self, q):
        return q.run(f"SELECT a FROM {q}")

X = "create table z (id int)"
'''


def test_python_symbols_and_references():
    rows = python_source.extract("pkg/mod.py", PY)
    n = nodes(rows)
    assert n["pkg.mod"]["docstring"] == "Doc of module."
    assert n["pkg.mod.A"]["kind"] == "class" and n["pkg.mod.A"]["signature"] == "class A(base.B, C)"
    assert n["pkg.mod.A.m"]["kind"] == "method" and n["pkg.mod.A.m.inner"]["kind"] == "function"
    assert n["pkg.mod.A.n"]["signature"] == "async def n(self, q)"
    assert calls(rows) == {("pkg.mod.A.m.inner", "deep", False), ("pkg.mod.A.m", "n", True), ("pkg.mod.A.m", "other", False), ("pkg.mod.A.n", "run", False)}
    assert {r["b"] for r in by(rows, "base")} == {"B", "C"}
    assert {r["b"] for r in by(rows, "import")} == {"near", "far", "os"}
    assert [r["b"] for r in by(rows, "orm")] == ["t_a"]
    assert {r["b"] for r in by(rows, "sql")} == {"SELECT a FROM {}", "create table z (id int)"}
    note = next(r for r in by(rows, "node") if r["kind"] == "rationale")
    assert note["docstring"] == "todo: later"
    assert any(r["a"] == "DOCUMENTS" and r["c"] == n["pkg.mod.A"]["id"] for r in by(rows, "edge"))


BROKEN = '''def one():
    return call_one()

class A:
    def good(self):
        return 1

    def bad(self, :
        x = (1,
        return 2

    def later(self):
        return self.good()

def two(a):
    y = [1, 2
    return y

def three():
    return call_three()
'''


def test_what_can_be_read_of_a_broken_file_is_kept():
    rows = python_source.extract("b.py", BROKEN)
    n = nodes(rows)
    assert by(rows, "warning") and {"b", "b.one", "b.A", "b.A.good", "b.three"} <= set(n)
    assert n["b.three"]["start_line"] == 19 and n["b.A.good"]["start_line"] == 5
    assert {("b.one", "call_one", False), ("b.three", "call_three", False)} <= calls(rows)
    assert python_source.extract("z.py", "\0")[-1]["tag"] in ("node", "warning")


def test_python_that_does_not_parse_gives_module_and_warning():
    rows = python_source.extract("a.py", "def f(:\n")
    assert [r["kind"] for r in by(rows, "node")] == ["module"] and by(rows, "warning")
    assert python_source.module_name("a/b/__init__.py") == "a.b"


JAVA = """package com.x;
import java.util.*;
import static a.B.c;
/** Says <b>hi</b>.
 * @see y
 */
@Entity
public final class OrderLine<T extends Comparable<T>> extends Base<T> implements One, Two<String> {
  @Column private int qty;
  @JoinColumn(name = "o_id") Order order = new Order(1);
  public OrderLine(int q) { super(q); this.set(q); }
  /* plain */ <R> R map(Function<T, R> f) { return f.apply(get()); }
  interface In { void a(); }
  record P(int x) { int y() { return x(); } }
}
"""


def test_java():
    rows = java_source.extract("src/OrderLine.java", JAVA)
    n = nodes(rows)
    assert n["com.x.OrderLine"]["kind"] in ("module", "class")
    line = next(r for r in by(rows, "node") if r["kind"] == "class" and r["name"] == "OrderLine")
    assert line["docstring"] == "Says <b>hi</b>." and line["signature"] == "@Entity" and line["start_line"] == 7
    assert {r["qualified_name"] for r in by(rows, "node") if r["kind"] == "method"} == {f"com.x.OrderLine.{m}" for m in ("OrderLine", "map", "In.a", "P.y")}
    assert {r["b"] for r in by(rows, "base")} == {"Base", "One", "Two"}
    assert {(r["b"], r["d"]) for r in by(rows, "orm")} == {("order_line", "INFERRED")}
    assert {r["b"] for r in by(rows, "orm_column")} == {"qty", "o_id"}
    assert {r["b"] for r in by(rows, "import")} == {"java.util", "a.B.c"}
    assert ("com.x.OrderLine.OrderLine", "set", True) in calls(rows) and ("com.x.OrderLine.map", "apply", False) in calls(rows)


def test_go():
    src = 'package p\n\nimport x "a/b"\n\ntype (\n\tA struct {\n\t\t*io.Reader\n\t\tB\n\t\tn, m int\n\t}\n\tI interface{ F() }\n)\n\nfunc (a *A) F() { a.G(); b.H(); J() }\nfunc K[T any](t T) map[string]struct{} {\n\treturn nil\n}\n'
    rows = go_source.extract("d/f.go", src)
    kinds = {r["qualified_name"]: r["kind"] for r in by(rows, "node")}
    assert kinds == {"p.f": "module", "p.A": "class", "p.I": "interface", "p.A.F": "method", "p.K": "function"}
    assert {r["b"] for r in by(rows, "base")} == {"Reader", "B"}
    assert calls(rows) == {("p.A.F", "G", True), ("p.A.F", "H", False), ("p.A.F", "J", False)}
    assert [r["b"] for r in by(rows, "owns")] == ["p.A"] and [r["b"] for r in by(rows, "import")] == ["a/b"]


def test_typescript_and_commonjs():
    src = "export class C extends a.B<X> {\n  m(): void { this.k(); f(() => g()); }\n  h = async () => { z() }\n}\nmodule.exports.run = function () { return q() }\nthis.x = function () {}\nC.prototype.p = () => 1\nmodule.exports = function named() {}\nconst t = require('pkg/u')\nexport const v = (a) => w(a)\n"
    rows = ts_source.extract("s/index.ts", src)
    kinds = {r["qualified_name"]: r["kind"] for r in by(rows, "node")}
    assert kinds == {"s": "module", "s.C": "class", "s.C.m": "method", "s.C.h": "method", "s.run": "function", "s.C.p": "method", "s.named": "function", "s.v": "function"}
    assert {("s.C.m", "k", True), ("s.C.m", "f", False), ("s.C.m", "g", False), ("s.C.h", "z", False), ("s.run", "q", False), ("s.v", "w", False)} <= calls(rows)
    assert [r["b"] for r in by(rows, "import")] == ["pkg/u"]


def test_sql():
    rows = sql_source.extract("s.sql", "-- x;\nCREATE TABLE a.users (id INT PRIMARY KEY, org INT REFERENCES orgs(id));\n\nCREATE TABLE t (x TEXT, CONSTRAINT k FOREIGN KEY (x) REFERENCES a.users (id));\nINSERT INTO t VALUES (1);")
    n = nodes(rows)
    assert set(n) == {"a.users", "a.users.id", "a.users.org", "t", "t.x"}
    assert n["a.users"]["start_line"] == 2 and n["t"]["start_line"] == 4
    assert n["t"]["signature"] == "TABLE t (x TEXT)"
    assert {(r["a"].split("::")[1], r["b"]) for r in by(rows, "fk")} == {("table.a.users.org", "orgs"), ("table.t.x", "a.users")}
    got = sql_source.extract_embedded("o", "f.py", "SELECT users.id, o.x FROM users JOIN orders o ON o.u = users.id WHERE a IN (SELECT b FROM c)")
    assert {r["b"] for r in by(got, "query")} == {"users", "orders", "c"}
    assert {(r["a"], r["b"]) for r in by(got, "join")} == {("users", "orders")}
    assert {(r["b"], r["c"]) for r in by(got, "query_column")} == {("users", "id"), ("o", "x"), ("o", "u")}
