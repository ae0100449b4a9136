"""Tools of a patch-writing agent: search, fixed-string search in files, and handing in a patch, with a budget of calls.

Only the tools are here; the model that calls them isn't."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import matching_lines
from .sources import files

MOST_OUTPUT = 8192


def tool_folder(root: str, path: str) -> str:
    """The folder that a tool may look in: relative to root, with '..' taken out; ValueError if it is absolute or leaves root."""
    if os.path.isabs(path):
        raise ValueError("the folder must be relative")
    parts: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if not parts:
                raise ValueError("the folder lies outside the workspace")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    found = "/".join(parts)
    if not files.inside(root, found or "."):
        raise ValueError("the folder lies outside the workspace")
    return found


def cut(text: str, most: int = MOST_OUTPUT) -> str:
    """At most so many characters, and a mark if there were more."""
    return text if len(text) <= most else text[:most] + "\n... (truncated)"


class Tools:
    """search (paths with whole bodies, each symbol once), grep (lines as path:line:text, any case) and submit_patch. Each call counts; beyond the
    budget, and after a patch, calls are refused. Errors are text for the caller."""

    def __init__(self, spark: SparkSession, root: str, engine, budget: int = 20):
        self.spark, self.root, self.engine, self.budget = spark, root, engine, budget
        self.calls: Counter[str] = Counter()
        self.patch: str | None = None

    def call(self, name: str, **given) -> str:
        tool = {"search": self.search, "grep": self.grep, "submit_patch": self.submit_patch}.get(name)
        if tool is None:
            return f"Error: no tool {name}"
        if self.patch is not None:
            return "Error: a patch was handed in already"
        if sum(self.calls.values()) >= self.budget:
            return "Error: the budget of calls is used up"
        self.calls[name] += 1
        try:
            return tool(**given)
        except (TypeError, ValueError) as e:
            return f"Error: {e}"

    def search(self, query: str, max_results: int = 5) -> str:
        seen: dict[str, str] = {}
        for path in self.engine.paths(query, max_results):
            for n in path["nodes"]:
                seen.setdefault(n["symbol_id"], f"{n['file_path']}::{n['name']}\n{n['body']}")
        return cut("\n\n".join(seen.values())) or "No results."

    def grep(self, pattern: str, path: str = ".", most: int = 50) -> str:
        folder = tool_folder(self.root, path)
        found = files.read(self.spark, self.root).where(F.startswith("path", F.lit(folder + "/" if folder else "")) & F.col("content").isNotNull())
        lines = found.select("path", F.inline(matching_lines(F.col("content"), [pattern]))).orderBy("path", "line").limit(most).collect()
        return cut("\n".join(f"{r['path']}:{r['line']}:{r['text']}" for r in lines)) or "No matches."

    def submit_patch(self, patch: str) -> str:
        self.patch = patch
        return "The patch was handed in."

    def record(self, instance_id: str, model: str) -> dict:
        """The row of the predictions table."""
        return {"instance_id": instance_id, "model_name_or_path": model, "model_patch": self.patch or "", "total_tool_calls_used": sum(self.calls.values()), "tool_call_breakdown": dict(self.calls)}
