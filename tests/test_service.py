"""A small project end to end: index, ask, change, update; and the gates around the stored graph."""

import io
import json

import pytest

from sparkloom import cli, toolserver
from sparkloom.functions.embedders import HashEmbedder, check_host, get_embedder
from sparkloom.operators import export
from sparkloom.plans import index as ix
from sparkloom.plans.service import GraphService, UnknownRef
from sparkloom.sources.store import Store, StoreError

FILES = {
    "schema.sql": "CREATE TABLE users (id INTEGER, email TEXT);\nCREATE TABLE audit (id INTEGER, user_id INTEGER REFERENCES users(id));\n",
    "app/models.py": 'class User:\n    """A person."""\n    __tablename__ = "users"\n\n    def mail(self):\n        return self.email\n',
    "app/store.py": 'def log(db):\n    db.run("INSERT INTO audit VALUES (1)")\n\n\ndef save(db):\n    log(db)\n\n\ndef idle():\n    return 1\n',
    "node_modules/x.js": "function skipped() {}\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work") / "shop"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    db = str(root.parent / "db")
    report = ix.index(spark, str(root), db, HashEmbedder(32))
    return root, db, report


@pytest.fixture(scope="module")
def service(spark, project):
    return GraphService(spark, project[1])


def names(rows):
    return {r["name"] for r in rows}


def test_index_leaves_packages_out(service, project):
    assert project[2].status == "indexed" and project[2].computed == project[2].nodes
    stats = service.stats()
    assert stats["table"] == 2 and stats["column"] == 4 and stats["REFERENCES"] == 1 and stats["JOINS"] == 0
    assert service.get_node("skipped") is None


@pytest.mark.parametrize("mode", ["hybrid", "vector", "lexical", "graph", "rerank"])
def test_modes(service, mode):
    hits = service.query("a person", mode, 3)
    assert 0 < len(hits) <= 3 and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)


def test_query_limits(service):
    with pytest.raises(ValueError):
        service.query("x", "nonsense")
    assert len(service.query("user", "vector", 0)) == 1


def test_references_and_neighbours(service):
    assert [r["name"] for r in service.resolve("User.mail")] == ["mail"]
    with pytest.raises(UnknownRef, match="did you mean"):
        service.get_node("savee", strict=True)
    assert names(service.callers("log")) == {"save"} and names(service.calls("save")) == {"log"}
    with pytest.raises(ValueError):
        service.neighbors("save", direction="up")
    assert service.neighbors("save", hops=20)[-1]["note"] == "hops limited from 20 to 8"


def test_impact_follows_keys_and_calls(service):
    got = service.impact("users")
    assert got["direction"] == "data->code" and not got["completeness"]["exhaustive"]
    assert names(got["direct_code"]) >= {"User", "mail", "log"} and names(got["transitive_callers"]) == {"save"}
    assert {x["code"] for x in got["completeness"]["limitations"]} == {"inferred_calls", "orm_attribute_access", "undeclared_schema_links"}
    back = service.impact("save")
    assert names(back["transitive_data"]) == {"audit"} and back["direct_data"] == []
    assert service.impact("idle")["total_data_touched"] == 0 and service.impact("nobody") is None
    assert service.impact("users", max_results=1)["truncated"]


def test_path(service):
    assert [r["name"] for r in service.shortest_path("save", "audit")] == ["save", "log", "audit"]
    assert [r["name"] for r in service.shortest_path("save", "save")] == ["save"]


def test_map(service, tmp_path):
    data = export.layout(export.graph_data(service.graph), rounds=5)
    assert max(abs(n[a]) for n in data["nodes"] for a in "xyz") <= 100
    assert "</script><b>" not in export.page({"nodes": [{"x": "</script><b>"}], "links": []})


def test_map_data_have_no_limit_but_the_layout_has(service, monkeypatch):
    monkeypatch.setattr(export, "MOST_NODES", 1)
    data = export.graph_data(service.graph)
    assert len(data["nodes"]) == service.graph.nodes.count() > 1
    with pytest.raises(ValueError):
        export.layout(data)


def test_update_states(spark, project):
    root, db, _ = project
    assert ix.update(spark, str(root), db).status == "up-to-date"
    (root / "app/store.py").write_text(FILES["app/store.py"].replace("return 1", "return 2"))
    got = ix.update(spark, str(root), db)
    assert (got.status, got.changed, got.added, got.deleted) == ("updated", 1, 0, 0) and got.removed >= 1 and got.kept > 5
    assert ix.update(spark, str(root), db, HashEmbedder(16)).status == "rebuilt"
    assert ix.update(spark, str(root), db).status == "up-to-date"
    with pytest.raises(FileNotFoundError):
        ix.update(spark, str(root / "gone"), db)


def test_store_gates(spark, tmp_path):
    with pytest.raises(StoreError, match="index a path"):
        Store(spark, str(tmp_path / "none")).open()
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "letter").write_text("x")
    with pytest.raises(StoreError, match="left alone"):
        Store(spark, str(tmp_path / "mine")).create()


def test_embedders():
    assert get_embedder("hash-9").dim == 9
    with pytest.raises(ValueError):
        get_embedder("other")
    assert check_host("http://localhost:1") and check_host("http://[::1]:1")
    for bad in ("http://localhost.evil.com", "http://127.0.0.1.evil.com"):
        with pytest.raises(ValueError):
            check_host(bad)


def test_tool_server(spark, project):
    service, opened = GraphService(spark, project[1]), []

    def open_service():
        opened.append(1)
        if len(opened) == 1:
            raise StoreError("no graph yet")
        return service

    server = toolserver.Server("db", open_service)
    assert len(server.answer({"id": 1, "method": "tools/list"})["result"]["tools"]) == 9
    ask = {"id": 2, "method": "tools/call", "params": {"name": "callers", "arguments": {"ref": "log"}}}
    assert server.answer(ask)["result"]["isError"]
    got = server.answer(ask)["result"]
    assert not got["isError"] and json.loads(got["content"][0]["text"])[0]["name"] == "save"
    assert server.answer({"method": "notifications/initialized"}) is None
    out = io.StringIO()
    toolserver.serve("db", io.StringIO("not json\n\n"), out)
    assert json.loads(out.getvalue())["error"]["code"] == -32700


def test_command_line(spark, project, capsys):
    db = project[1]
    assert cli.main(["resolve", "nobody", "--db", db]) == 1
    assert cli.main(["path", "idle", "users", "--db", db]) == 0
    assert cli.main(["node", "nobody", "--db", db]) == 1
    assert cli.main(["stats", "--db", db]) == 0 and '"table": 2' in capsys.readouterr().out


def test_store_meta_edges_and_deletions(spark, project, tmp_path):
    import shutil

    db = str(tmp_path / "db")
    shutil.copytree(project[1], db)
    store = Store(spark, db)
    graph = store.open()
    store.put_meta("note", "x")
    assert store.meta()["note"] == "x" and Store(spark, db).meta()["dim"] == "32"
    store.delete_meta("note")
    assert "note" not in store.meta()
    ids = sorted(r["id"] for r in graph.nodes.where("kind = 'function'").select("id").collect())
    rows = [("CALLS", ids[0], ids[1], "INFERRED", "hand"), ("CALLS", ids[0], "nowhere", "INFERRED", "hand")]
    new = spark.createDataFrame(rows, graph.edges.schema)
    from sparkloom.schema import EDGES

    new = new.select(*[f.name for f in EDGES.fields])
    assert store.add_edges(new) == 1 and store.add_edges(new) == 0
    assert store.open().edges.where("resolver = 'hand'").count() == 1
    assert {r["table"] for r in store.tables().select("table").distinct().collect()} == {"nodes", "edges", "files"}
    store.set_embeddings(spark.createDataFrame([(ids[0], [1.0] * 32)], "id string, embedding array<float>"))
    assert store.open().nodes.where(f"id = '{ids[0]}'").first()["embedding"] == [1.0] * 32
    with pytest.raises(ValueError):
        store.set_embeddings(spark.createDataFrame([(ids[0], [1.0])], "id string, embedding array<float>"))
    store.delete_edges(new)
    assert store.open().edges.where("resolver = 'hand'").count() == 0
    store.delete_nodes(spark.createDataFrame([(ids[0],)], "id string"))
    after = store.open()
    assert after.nodes.where(f"id = '{ids[0]}'").count() == 0 and after.edges.where(f"src = '{ids[0]}' or dst = '{ids[0]}'").count() == 0


def test_lost_edge_tables_are_healed_and_lost_nodes_are_not(spark, project, tmp_path):
    import shutil

    db = str(tmp_path / "db")
    shutil.copytree(project[1], db)
    store = Store(spark, db)
    at = f"{db}/{store.current()}"
    shutil.rmtree(f"{at}/edges/type=CALLS")
    with pytest.warns(UserWarning, match="CALLS"):
        assert store.open().edges.where("type = 'CALLS'").count() == 0
    assert "CALLS" not in store.meta()["edge_types"] and store.open().edges.count() > 0
    shutil.rmtree(f"{at}/nodes")
    with pytest.raises(StoreError):
        store.open()


def test_a_writer_that_dies_leaves_the_last_whole_version(spark, project, tmp_path, monkeypatch):
    import shutil

    db = str(tmp_path / "db")
    shutil.copytree(project[1], db)
    store = Store(spark, db)
    graph, before = store.open(), store.current()
    monkeypatch.setattr(Store, "_put", lambda *_: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        store.write(graph, {}, store.files())
    monkeypatch.undo()
    assert store.current() == before and store.open().nodes.count() == graph.nodes.count()


def test_updates_parse_changed_files_only(spark, tmp_path, monkeypatch):
    from sparkloom.sources import files as S

    root = tmp_path / "shop"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    db = str(tmp_path / "db")
    ix.index(spark, str(root), db, HashEmbedder(32))
    (root / "app/store.py").write_text(FILES["app/store.py"].replace("idle", "busy"))
    (root / "app/new.py").write_text("from app import store\n\n\ndef go(db):\n    save(db)\n")
    seen, extract = [], S.extract

    def watched(files, *a):
        seen.append(sorted(r["path"] for r in files.select("path").collect()))
        return extract(files, *a)

    monkeypatch.setattr(S, "extract", watched)
    report = ix.update(spark, str(root), db)
    assert seen == [["shop/app/new.py", "shop/app/store.py"]]
    assert (report.status, report.added, report.changed) == ("updated", 1, 1)
    g = Store(spark, db).open()
    again = str(tmp_path / "again")
    monkeypatch.undo()
    ix.index(spark, str(root), again, HashEmbedder(32))
    whole = Store(spark, again).open()
    assert sorted(map(str, g.edges.collect())) == sorted(map(str, whole.edges.collect()))
    assert sorted(map(str, g.nodes.collect())) == sorted(map(str, whole.nodes.collect()))


def test_models_behind_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from sparkloom.functions.embedders import LocalHttpEmbedder
    from sparkloom.operators.rerank import ListwiseReranker, ask_model

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = {"embedding": [float(len(body["prompt"])), 1.0, 2.0]} if self.path == "/api/embeddings" else {"response": "2, 1"}
            if body["model"] == "broken":
                out = {"other": 1}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        model = LocalHttpEmbedder("m", url)
        got = model.embed(spark.createDataFrame([("a", "xyz"), ("b", None)], "id string, text string")).collect()
        assert {r["id"]: r["embedding"] for r in got} == {"a": [3.0, 1.0, 2.0], "b": [0.0, 1.0, 2.0]} and model.dim == 3 and model.dim_is_exact
        with pytest.raises(RuntimeError, match="embedding"):
            LocalHttpEmbedder("broken", url).embed(spark.createDataFrame([("a", "x")], "id string, text string"))
        assert ListwiseReranker(ask_model("m", url)).rerank("q", [("a", "one"), ("b", "two")]) == ["b", "a"]
    finally:
        server.shutdown()
    with pytest.raises(RuntimeError, match="answers"):
        LocalHttpEmbedder("m", url).embed(spark.createDataFrame([("a", "x")], "id string, text string"))


def test_scorecard_baselines_and_sweep(spark, service, project):
    from sparkloom import evaluate

    questions = [{"id": 1, "mode": "STRUCT", "question": "where is an audit row saved", "anchors": ["save"]}, {"id": 2, "mode": "WHY", "question": "what is a person", "anchors": ["User"]}]
    with pytest.warns(UserWarning, match="gone"):
        card = evaluate.scorecard({"shop": (service, questions), "gone": (None, [])}, modes=("lexical",), baselines=True)
    assert [r["retriever"] for r in card] == ["lexical+hash-32", "grep", "naive-rag+hash-32"] and all(0 <= r["mrr"] <= 1 for r in card)
    swept = evaluate.sweep({"shop": (service, questions)})
    rows = evaluate.summary(swept).collect()
    assert len(rows) == 1 + 4 * 2 * 2 * 4 * 2 and all(r["qualifies"] <= (r["wins"] == 1) for r in rows)
    best = evaluate.winner(swept)
    assert best is None or best["qualifies"]


def test_settings_of_the_environment(monkeypatch):
    from sparkloom.functions.embedders import LocalHttpEmbedder
    from sparkloom.operators.rerank import get_reranker

    monkeypatch.setenv("SPARKLOOM_MODEL_URL", "http://localhost:1234")
    assert LocalHttpEmbedder("m").url == "http://localhost:1234" and get_reranker("listwise").ask is None
    monkeypatch.setenv("SPARKLOOM_RERANK_MODEL", "m")
    assert get_reranker("listwise").ask is not None and get_reranker("listwise-x").ask is not None
    monkeypatch.setenv("SPARKLOOM_MODEL_URL", "http://example.com:1")
    with pytest.raises(ValueError):
        LocalHttpEmbedder("m")
    monkeypatch.setenv("SPARKLOOM_EMBEDDER", "hash-16")
    assert get_embedder().dim == 16
