"""Incremental maintenance of an index: snapshots of listings, updates by file, and a stream of changes."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph, parse, vectors
from ..sources import files
from ..sources.tables import IndexStore

log = logging.getLogger(__name__)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind) between two listings (path, mtime): created, modified or deleted."""
    both = before.select("path", F.col("mtime").alias("old")).join(after.select("path", F.col("mtime").alias("new")), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", kind.alias("kind")).where("kind is not null")


def described(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with skeletons, their vectors)."""
    embedded = vectors.embedded(nodes.select("id", "body"), "body")
    return parse.with_skeleton(nodes), embedded.select("id", "vector").where("vector is not null")


def tables(symbols: DataFrame) -> dict[str, DataFrame]:
    """All index tables of symbol rows."""
    nodes, edges = graph.build(symbols)
    shown, vecs = described(nodes)
    return {"symbols": symbols, "nodes": shown, "edges": edges, "vectors": vecs}


def index(spark: SparkSession, root: str, store: IndexStore) -> int:
    """Indexes the whole tree; returns the new version."""
    source = files.read(spark, root)
    version = store.save(files=source.select("path", "mtime"), **tables(parse.symbols(source)))
    report_missing(spark, store)
    return version


def report_missing(spark: SparkSession, store: IndexStore) -> int:
    """How many nodes have no vector (the embedder failed on their batch), with a warning if there are any."""
    missing = store.load(spark, "nodes").select("id").join(store.load(spark, "vectors").select("id"), "id", "left_anti").count()
    if missing:
        log.warning("%d nodes have no vector", missing)
    return missing


def replaced(symbols: DataFrame, fresh: DataFrame, paths: list[str]) -> DataFrame:
    """Symbol rows with those of the given files replaced. Edges follow from all rows, so that an update equals a rebuild."""
    return symbols.where(~F.col("file_path").isin(*paths)).unionByName(fresh)


def update(spark: SparkSession, root: str, store: IndexStore, paths: list[str]) -> int:
    """Brings the index up to date for changed paths; those outside the tree are skipped, missing ones deleted. Only the changed files'
    nodes are embedded. Returns the symbols parsed."""
    paths = sorted({p for p in paths if files.inside(root, p)})
    if not paths:
        return 0
    source = files.read(spark, root, paths=paths)
    fresh = parse.symbols(source).persist()
    n = fresh.count()
    old = store.load(spark, "files").where(~F.col("path").isin(*paths))
    # Ids begin with their file, so that other files' nodes and vectors stay as they are; edges follow from all rows.
    new_nodes, new_vectors = described(graph.nodes(fresh))
    kept = store.load(spark, "nodes")
    gone = kept.where(F.col("file_path").isin(*paths)).select("id")
    rows = replaced(store.load(spark, "symbols"), fresh, paths)
    store.save(
        files=old.unionByName(source.select("path", "mtime")), symbols=rows, edges=graph.build(rows)[1],
        nodes=kept.where(~F.col("file_path").isin(*paths)).unionByName(new_nodes.select(*kept.columns)),
        vectors=store.load(spark, "vectors").join(gone, "id", "left_anti").unionByName(new_vectors),
    )
    report_missing(spark, store)
    fresh.unpersist()
    return n


def watch(spark: SparkSession, feed: str, root: str, store: IndexStore, checkpoint: str, every: str = "500 milliseconds") -> StreamingQuery:
    """A stream over a folder of JSON change records (path): each micro-batch updates the index once per distinct visible path."""
    stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", 100).json(feed)

    def apply(batch: DataFrame, _: int) -> None:
        update(spark, root, store, [r["path"] for r in files.visible(batch).distinct().collect()])

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def listing(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(files.listed(root), "path string, mtime long")


def watch_tree(spark: SparkSession, root: str, store: IndexStore, checkpoint: str, every: str = "500 milliseconds") -> StreamingQuery:
    """A stream that compares the tree with the index at each tick (the debounce: a burst of changes to a file within it counts once) and updates
    what was created, modified or deleted in one go; deletions are seen, as listings are compared. At most 100 paths a tick, the rest at the next."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def apply(_: DataFrame, __: int) -> None:
        found = changes(store.load(spark, "files"), listing(spark, root)).orderBy("path").limit(100)
        if paths := [r["path"] for r in found.collect()]:
            update(spark, root, store, paths)

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
