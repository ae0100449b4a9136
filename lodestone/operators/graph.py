"""Symbol graph: node dedup, call resolution, containment, neighbours, reachability. Edges are bags of (src, dst, kind)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import cut


def nodes(symbols: DataFrame) -> DataFrame:
    """The first symbol row (least ordinal) of each id."""
    w = Window.partitionBy("id").orderBy("ordinal")
    return symbols.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def call_edges(symbols: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Each symbol row's calls, resolved by name: within the file, or anywhere if the name is unique among nodes.

    Two equi-joins: on file and name, and on names that one node alone has (from another file), so that a common name never meets
    all its namesakes."""
    named = nodes_.select(F.col("id").alias("dst"), F.col("name").alias("callee"), F.col("file_path").alias("file"))
    made = symbols.select(F.col("id").alias("src"), F.col("file_path").alias("file"), F.explode("calls").alias("callee"))
    near = made.join(named, ["file", "callee"]).where("src <> dst").select("src", "dst")
    unique = named.groupBy("callee").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"), F.min("file").alias("dst_file")).where("n = 1").drop("n")
    far = made.join(unique, "callee").where("file <> dst_file").select("src", "dst")
    return near.unionByName(far).withColumn("kind", F.lit("Calls"))


def containment_edges(symbols: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Each scoped symbol row to all nodes that have its scope's name, in any file."""
    scopes = nodes_.select(F.col("id").alias("dst"), F.col("name").alias("parent_scope"))
    return symbols.select(F.col("id").alias("src"), "parent_scope").join(scopes, "parent_scope").select("src", "dst", F.lit("ContainedIn").alias("kind"))


def build(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all symbol rows."""
    n = nodes(symbols)
    return n, call_edges(symbols, n).unionByName(containment_edges(symbols, n))


def neighbours(edges: DataFrame, ids: DataFrame, outgoing: bool = True) -> DataFrame:
    """(id, neighbour) for each edge at one of the ids, of any kind."""
    a, b = ("src", "dst") if outgoing else ("dst", "src")
    return edges.join(ids, edges[a] == ids["id"]).select(F.col(a).alias("id"), F.col(b).alias("neighbour"))


def degrees(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in) of every node."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    found = ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return nodes_.select("id").join(found, "id", "left").na.fill(0, ["n_out", "n_in"])


def remove_file(nodes_: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the file's nodes and all edges at them."""
    gone = nodes_.where(F.col("file_path") == path).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes_.where(F.col("file_path") != path), kept.select("src", "dst", "kind")


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, depth): all nodes within so many hops of the start ids, at their least depth. One join per hop over distinct edges; each hop is
    written and read again, so that the next doesn't repeat it, and the walk ends where a hop finds nothing new."""
    step = cut(edges.select("src", "dst").distinct())
    frontier = cut(start.select("id", F.lit(0).alias("depth")).distinct())
    seen = [frontier]
    for k in range(1, hops + 1):
        known = functools.reduce(DataFrame.unionByName, seen).select("id")
        frontier = cut(frontier.join(step, frontier["id"] == step["src"]).select(F.col("dst").alias("id"), F.lit(k).alias("depth")).distinct().join(known, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return functools.reduce(DataFrame.unionByName, seen)


def by_id(nodes_: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes with the given ids."""
    return nodes_.join(ids.select("id").distinct(), "id", "left_semi")


def index_counts(files: DataFrame, nodes_: DataFrame) -> DataFrame:
    """One row: files_indexed (all files, parsed or not) and symbols_indexed (nodes, with or without a vector)."""
    return files.agg(F.count(F.lit(1)).alias("files_indexed")).select("files_indexed", nodes_.agg(F.count(F.lit(1)).alias("n")).scalar().alias("symbols_indexed"))
