"""Source trees: listing on the driver (Spark's file sources hide names that begin with '_' or '.'), reading on the executors."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("rs", "py", "js", "jsx", "ts", "tsx")


class Ignore:
    """Rules of .gitignore files: last match wins, '!' takes back, '/' anchors, a final '/' means directories."""

    def __init__(self, root: str):
        self.root, self.rules = root, []
        self.active = os.path.isdir(os.path.join(root, ".git"))

    def load(self, folder: str) -> None:
        path = os.path.join(folder, ".gitignore")
        if self.active and os.path.isfile(path):
            base = os.path.relpath(folder, self.root)
            with open(path, encoding="utf-8", errors="replace") as f:
                for line in f.read().splitlines():
                    if (rule := line.strip()) and not rule.startswith("#"):
                        self.rules.append(("" if base == "." else base + "/", rule))

    def hides(self, rel: str, is_dir: bool) -> bool:
        hidden = False
        for base, rule in self.rules:
            if not rel.startswith(base):
                continue
            name, take_back = rel[len(base) :], rule.startswith("!")
            rule = rule[take_back:]
            if rule.endswith("/") and not is_dir:
                continue
            rule = rule.rstrip("/")
            anchored = "/" in rule
            if fnmatch.fnmatch(name, rule.lstrip("/")) or (not anchored and fnmatch.fnmatch(name.rsplit("/", 1)[-1], rule)):
                hidden = not take_back
        return hidden


def listed(root: str, extensions: tuple[str, ...] = EXTENSIONS) -> list[tuple[str, int]]:
    """(path below root, seconds of its last change) of visible regular files with one of the extensions, sorted."""
    out, ignore = [], Ignore(root)
    for folder, folders, names in os.walk(root):
        ignore.load(folder)
        rel = lambda n, folder=folder: os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/")
        folders[:] = sorted(d for d in folders if not d.startswith(".") and not ignore.hides(rel(d), True))
        for n in sorted(names):
            full = os.path.join(folder, n)
            if not n.startswith(".") and n.rpartition(".")[2] in extensions and "." in n and os.path.isfile(full) and not ignore.hides(rel(n), False):
                out.append((rel(n), int(os.stat(full).st_mtime)))
    return sorted(out)


def inside(root: str, path: str) -> bool:
    """Whether a relative path stays below root, after '..' and symbolic links."""
    if os.path.isabs(path):
        return False
    real = os.path.realpath(root)
    return os.path.commonpath([real, os.path.realpath(os.path.join(root, path))]) == real


def read(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, paths: list[str] | None = None) -> DataFrame:
    """(path, content, mtime): files as text; those that aren't UTF-8 have null content. root must be visible to the executors."""
    rows = [r for r in listed(root, extensions) if paths is None or r[0] in set(paths)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content: list[str | None] = []
            for p in batch["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        content.append(f.read().decode("utf-8"))
                except (OSError, UnicodeDecodeError):
                    content.append(None)
            yield pd.DataFrame({"path": batch["path"], "content": content, "mtime": batch["mtime"]})

    frame = spark.createDataFrame(rows, "path string, mtime long")
    return frame.repartition(max(1, min(200, len(rows) // 50 + 1))).mapInPandas(run, "path string, content string, mtime long")


def visible(paths: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The rows of a frame of relative paths that aren't hidden and have one of the extensions."""
    return paths.where(~F.startswith("path", F.lit(".")) & ~F.contains("path", F.lit("/.")) & F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*extensions))
