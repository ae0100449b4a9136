"""JSON lines and index tables."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import patch_files

CASE = "instance_id string, id string, repo string, problem_statement string, query string, patch string"
PREDICTION = "instance_id string, model_name_or_path string, model_patch string, method string, eval_correctness string"


def cases(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(id, repo, query, oracle_files); a malformed line fails, blank lines and rows without id, repo or query go. A present null counts as absent."""
    rows = spark.read.schema(CASE).option("mode", "FAILFAST").json(path)
    out = rows.select(F.coalesce("instance_id", "id").alias("id"), "repo", F.coalesce("problem_statement", "query").alias("query"), F.coalesce(patch_files(F.col("patch")), F.array().cast("array<string>")).alias("oracle_files")).dropna(subset=["id", "repo", "query"])
    return out if most is None else out.limit(most)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions; corrupt lines are dropped, eval_correctness is 'unknown' by default."""
    return spark.read.schema(PREDICTION).option("mode", "DROPMALFORMED").json(path).na.fill("unknown", ["eval_correctness"]).where("instance_id is not null")


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


class IndexStore:
    """Versioned index tables: readers keep the version that they opened, a writer adds the next and then names it current."""

    def __init__(self, root: str):
        self.root = root

    def version(self) -> int:
        try:
            with open(os.path.join(self.root, "CURRENT"), encoding="utf-8") as f:
                return json.load(f)["version"]
        except FileNotFoundError:
            return 0

    def exists(self) -> bool:
        return self.version() > 0

    def save(self, **tables: DataFrame) -> int:
        """Writes all tables as the next version and makes it current."""
        version = self.version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(self.root, f"v{version:06d}", name))
        temporary = os.path.join(self.root, f".current-{version}")
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump({"version": version}, f)
        os.replace(temporary, os.path.join(self.root, "CURRENT"))
        return version

    def load(self, spark: SparkSession, name: str, version: int | None = None) -> DataFrame:
        return spark.read.parquet(os.path.join(self.root, f"v{version or self.version():06d}", name))

    def clear(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)


def ensure_ignored(root: str, entry: str) -> bool:
    """Adds a line to root's .gitignore unless it is there (slashes at the ends don't matter); says whether it did."""
    path = os.path.join(root, ".gitignore")
    text = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
    if entry.strip("/") in {x.strip().strip("/") for x in text.splitlines()}:
        return False
    with open(path, "a", encoding="utf-8") as f:
        f.write(("\n" if text and not text.endswith("\n") else "") + entry + "\n")
    return True
