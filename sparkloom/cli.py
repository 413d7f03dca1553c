"""Command line: index, update, query, node, resolve, calls, callers, impact, path, viz, demo, serve, stats."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from dataclasses import asdict

from pyspark.sql import SparkSession

DB = os.environ.get("SPARKLOOM_DB", "graph.loom")


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found:
        return found
    build = SparkSession.builder.appName("sparkloom").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    return build.master(os.environ.get("SPARKLOOM_MASTER", "local[*]")).getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        c.add_argument("--db", default=DB)
        return c

    for name in ("index", "update"):
        c = add(name, "path")
        c.add_argument("--embedder")
        if name == "index":
            c.add_argument("--overwrite", action="store_true")
    c = add("query", "text")
    c.add_argument("--mode", default="hybrid")
    c.add_argument("-k", type=int, default=10)
    c.add_argument("--reranker")
    for name in ("node", "resolve", "calls", "callers"):
        add(name, "ref")
    add("impact", "ref").add_argument("--max-results", type=int, default=50)
    add("path", "src", "dst")
    add("viz").add_argument("--out", default="graph.html")
    add("demo")
    add("serve")
    add("stats")
    return p


def main(argv: list[str] | None = None) -> int:
    from .functions.embedders import get_embedder
    from .plans import index as ix
    from .plans.service import GraphService, UnknownRef
    from .sources.store import StoreError

    a = parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, indent=2, ensure_ascii=False))
    try:
        if a.command == "serve":
            from .toolserver import serve

            return serve(a.db)
        spark = session()
        if a.command == "demo":
            return demo(spark)
        if a.command in ("index", "update"):
            embedder = get_embedder(a.embedder) if a.embedder else None
            made = ix.index(spark, a.path, a.db, embedder, a.overwrite) if a.command == "index" else ix.update(spark, a.path, a.db, embedder)
            show(asdict(made))
            return 0
        s = GraphService(spark, a.db, reranker=getattr(a, "reranker", None))
        if a.command == "query":
            show(s.query(a.text, a.mode, a.k))
        elif a.command == "node":
            show(s.get_node(a.ref, strict=True))
        elif a.command == "resolve":
            found = s.resolve(a.ref)
            show(found)
            return 0 if found else 1
        elif a.command in ("calls", "callers"):
            show(getattr(s, a.command)(a.ref))
        elif a.command == "impact":
            found = s.impact(a.ref, a.max_results)
            if found is None:
                print(f"no node {a.ref!r}", file=sys.stderr)
                return 1
            show(found)
        elif a.command == "path":
            found = s.shortest_path(a.src, a.dst)
            show(found) if found else print("no path")
        elif a.command == "viz":
            from .operators.export import write

            write(s.graph, a.out, a.db)
            print(a.out)
        elif a.command == "stats":
            show(s.stats())
        return 0
    except UnknownRef as e:
        print(e.args[0], file=sys.stderr)
    except (StoreError, ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
    return 1


def demo(spark: SparkSession) -> int:
    """A small project, indexed and asked what breaks when its table changes."""
    from .plans import index as ix
    from .plans.service import GraphService

    with tempfile.TemporaryDirectory() as d:
        os.mkdir(f"{d}/shop")
        files = {
            "schema.sql": "CREATE TABLE users (id INTEGER PRIMARY KEY, email TEXT);\n",
            "app.py": 'def save(db, email):\n    """Store a user."""\n    db.execute("INSERT INTO users (email) VALUES (?)", email)\n\n\ndef sign_up(form):\n    save(form.db, form.email)\n',
        }
        for name, text in files.items():
            with open(f"{d}/shop/{name}", "w") as f:
                f.write(text)
        ix.index(spark, f"{d}/shop", f"{d}/db")
        s = GraphService(spark, f"{d}/db")
        print(json.dumps({"query": s.query("store a user", k=3), "impact": s.impact("users")}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
