"""The search engine over a stored index: what the RPC tools ask, for one question at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import paths, vectors
from .sources.tables import IndexStore
from .streaming import incremental

NODE = ("symbol_id", "name", "kind", "file_path", "line_range", "body", "skeleton", "relevance")


class Engine:
    """Answers from the version of the index that is current when a question comes, so that updates never change an answer half-way."""

    def __init__(self, spark: SparkSession, store: IndexStore, provider: str = "hashed"):
        self.spark, self.store, self.provider = spark, store, provider

    def _open(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        version = self.store.version()
        return tuple(self.store.load(self.spark, t, version) for t in ("nodes", "edges", "vectors"))

    def _asked(self, query: str) -> DataFrame:
        one = self.spark.createDataFrame([(0, query)], "query long, text string")
        return vectors.embedded(one, "text", "qv", self.provider).select("query", "qv")

    def _paths(self, found: DataFrame, nodes: DataFrame) -> list[dict]:
        """Paths of collected nodes in their order; at most 50 paths are ever asked for. found: path_rank, pos, score, symbol_id, relevance."""
        described = nodes.select(F.col("id").alias("symbol_id"), "name", "kind", "file_path", "line_range", "body", "skeleton")
        out: dict[int, dict] = {}
        for r in found.join(described, "symbol_id").orderBy("path_rank", "pos").collect():
            node = {k: r[k] for k in NODE}
            out.setdefault(r["path_rank"], {"score": r["score"], "nodes": []})["nodes"].append(node)
        return list(out.values())

    def paths(self, query: str, k: int) -> list[dict]:
        """The k best execution paths."""
        if not k:
            return []
        nodes, edges, vecs = self._open()
        return self._paths(paths.search(vecs, edges, self._asked(query), k), nodes)

    def chunks(self, query: str, k: int) -> list[dict]:
        """The k most similar symbols, each as a path of one node."""
        if not k:
            return []
        nodes, _, vecs = self._open()
        best = vectors.top_k_each(vecs, self._asked(query), k)
        return self._paths(best.select((F.col("rank") - 1).alias("path_rank"), F.lit(0).alias("pos"), "score", F.col("id").alias("symbol_id"), F.col("score").alias("relevance")), nodes)


def opened(spark: SparkSession, root: str, store: IndexStore, dimension: int = vectors.DIMENSION) -> Engine:
    """An engine over root's index, which is built first if there is none, if nodes lack vectors, or if vectors have another size."""
    whole = store.exists() and vectors.intact(store.load(spark, "nodes"), store.load(spark, "vectors"), dimension).first()["ok"]
    if not whole:
        incremental.index(spark, root, store)
    return Engine(spark, store)
