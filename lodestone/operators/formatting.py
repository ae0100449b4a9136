"""Search results as text or JSON, from collected paths (at most 50, so this is driver work)."""

from __future__ import annotations

import json

BODY_CAP = 32_000


def shown_whole(nodes: list[dict], n: int) -> set[int]:
    """Positions whose body is shown: none, the last, middle and last, first middle last, or the n most relevant."""
    size = len(nodes)
    if n <= 0:
        return set()
    if n >= size:
        return set(range(size))
    fixed = {1: {size - 1}, 2: {size // 2, size - 1}, 3: {0, size // 2, size - 1}}
    return fixed.get(n) or set(sorted(range(size), key=lambda i: -nodes[i]["relevance"])[:n])


def cap(body: str, uncapped: bool) -> str:
    return body if uncapped or len(body) <= BODY_CAP else body[:BODY_CAP] + "..."


def as_text(paths: list[dict], return_nodes: int = 0, uncapped: bool = False) -> str:
    if not paths:
        return "No relevant execution paths found."
    out = []
    for k, path in enumerate(paths, 1):
        whole = shown_whole(path["nodes"], return_nodes)
        out.append(f"=== Execution Path {k} (score: {path['score']:.3f}) ===\nPath: {' → '.join(n['name'] for n in path['nodes'])}\n\n")
        for i, n in enumerate(path["nodes"]):
            a, b = n["line_range"]
            shown = cap(n["body"], uncapped) if i in whole else n["skeleton"]
            out.append(f"▸ {n['name']} ({n['file_path']}:{a + 1}-{b + 1}) [{'full' if i in whole else 'skeleton'}]\n```\n{shown}\n```\n\n")
        out.append("\n")
    return "".join(out)


def as_json(paths: list[dict], return_nodes: int = 0, uncapped: bool = False) -> str:
    result = []
    for path in paths:
        whole, size = shown_whole(path["nodes"], return_nodes), len(path["nodes"])
        nodes = []
        for i, n in enumerate(path["nodes"]):
            node = {"symbol_id": n["symbol_id"], "name": n["name"], "symbol_kind": n["kind"], "file_path": n["file_path"], "line_range": list(n["line_range"]), "is_terminal": i == size - 1, "skeleton": n["skeleton"], "relevance": n["relevance"]}
            if i in whole:
                node["full_body"] = cap(n["body"], uncapped)
            nodes.append(node)
        result.append({"score": path["score"], "nodes": nodes})
    return json.dumps({"paths": result}, indent=2, ensure_ascii=False)
