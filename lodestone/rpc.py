"""JSON-RPC over lines: three search tools that answer from an engine object."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from .operators.formatting import as_json, as_text

MOST_BYTES, MOST_RESULTS, MOST_LINE = 10_000, 50, 10 << 20
TOOLS = ("semantic_path_search", "semantic_chunk_search", "structured_path_search")
SCHEMA = {
    "type": "object",
    "properties": {"query": {"type": "string"}, "max_results": {"type": "integer", "default": 5}, "return_nodes": {"type": "integer", "default": 0}, "uncap_file_size": {"type": "boolean", "default": False}},
    "required": ["query"],
}


class Invalid(ValueError):
    pass


def parameters(given: dict) -> tuple[str, int, int, bool]:
    query = str(given.get("query", "")).strip()
    if not query:
        raise Invalid("the query is empty")
    if len(query.encode()) > MOST_BYTES:
        raise Invalid(f"the query has more than {MOST_BYTES} bytes")
    return query, min(max(0, int(given.get("max_results", 5))), MOST_RESULTS), int(given.get("return_nodes", 0)), bool(given.get("uncap_file_size", False))


def handle(line: str, engine) -> dict | None:
    """The response to one request; engine has paths(query, k) and chunks(query, k), both lists of paths."""
    try:
        request = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    method, key = request.get("method"), request.get("id")
    reply = lambda result: {"jsonrpc": "2.0", "id": key, "result": result}
    fail = lambda code, text: {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}}
    if method == "initialize":
        return reply({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "1"}})
    if method in ("initialized", "notifications/initialized"):
        return None
    if method in ("shutdown", "exit"):
        return reply(None)
    if method == "tools/list":
        return reply({"tools": [{"name": n, "inputSchema": SCHEMA} for n in TOOLS]})
    if method != "tools/call":
        return fail(-32601, f"no method {method}")
    given = request.get("params") or {}
    if given.get("name") not in TOOLS:
        return fail(-32602, "no such tool")
    try:
        query, k, shown, uncapped = parameters(given.get("arguments") or {})
    except (Invalid, TypeError, ValueError) as e:
        return fail(-32602, str(e))
    try:
        found = engine.chunks(query, k) if given["name"] == TOOLS[1] else engine.paths(query, k)
        text = (as_json if given["name"] == TOOLS[2] else as_text)(found, shown, uncapped)
    except Exception as e:  # noqa: BLE001  the engine's errors are text for the caller
        text = f"Error: {e}"
    return reply({"content": [{"type": "text", "text": text}]})


def serve(lines: Iterable[str], engine) -> Iterator[str]:
    for line in lines:
        if len(line) > MOST_LINE:
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "line too long"}})
        elif line.strip() and (answer := handle(line, engine)) is not None:
            yield json.dumps(answer, ensure_ascii=False)
