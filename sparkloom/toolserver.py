"""A tool server over standard input and output: JSON-RPC lines, nine tools. The graph is opened at the first call, so
a missing or broken one is that call's error, and the next call tries again."""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

TOOLS: dict[str, tuple[str, dict[str, str], tuple[str, ...]]] = {
    "query": ("Ranked search over symbols, tables and notes", {"text": "string", "mode": "string", "k": "integer"}, ("text",)),
    "semantic_search": ("Search by meaning alone", {"text": "string", "k": "integer"}, ("text",)),
    "get_node": ("One node by id, qualified name, dotted suffix or name", {"ref": "string"}, ("ref",)),
    "resolve": ("All nodes that a reference may mean", {"ref": "string"}, ("ref",)),
    "neighbors": ("Nodes around a node", {"ref": "string", "direction": "string", "relation": "string", "hops": "integer"}, ("ref",)),
    "calls": ("What a function calls", {"ref": "string"}, ("ref",)),
    "callers": ("What calls a function", {"ref": "string"}, ("ref",)),
    "impact": ("What breaks when a table, column or function changes", {"ref": "string", "max_results": "integer"}, ("ref",)),
    "shortest_path": ("A shortest path between two nodes", {"src": "string", "dst": "string"}, ("src", "dst")),
}


class Server:
    def __init__(self, db: str, open_service=None):
        self.db, self.service = db, None
        self.open_service = open_service or self._open

    def _open(self):
        from .cli import session
        from .plans.service import GraphService

        return GraphService(session(), self.db)

    def call(self, name: str, arguments: dict[str, Any]) -> Any:
        if name not in TOOLS:
            raise ValueError(f"unknown tool {name!r}")
        if self.service is None:
            self.service = self.open_service()
        if name == "get_node":
            arguments = arguments | {"strict": True}
        return getattr(self.service, name)(**arguments)

    def answer(self, message: dict) -> dict | None:
        """The response to one message; none to a notification."""
        if "id" not in message:
            return None
        method, params = message.get("method"), message.get("params") or {}
        reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkloom", "version": "0.1"}}}
        if method == "tools/list":
            tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": list(r)}} for n, (d, p, r) in TOOLS.items()]
            return reply | {"result": {"tools": tools}}
        if method == "tools/call":
            try:
                text, failed = json.dumps(self.call(params.get("name", ""), params.get("arguments") or {}), ensure_ascii=False), False
            except Exception as e:  # whatever goes wrong is the tool's answer, and the server goes on
                text, failed = str(e.args[0] if e.args else e), True
            return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
        return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}


def serve(db: str, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> int:
    server = Server(db)
    for line in source:
        if not line.strip():
            continue
        try:
            reply = server.answer(json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
    return 0
