"""Vector store operators over a frame (id, vector): exact top-k, similarity, upsert, removal, integrity, chunk retrieval."""

from __future__ import annotations

import functools
import hashlib
import logging
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine

DIMENSION = 64
BLOCK_BYTES = 1 << 25
log = logging.getLogger(__name__)


def top_k(vectors: DataFrame, query: Column, k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k rows most similar to the query vector: (key, score), ties by key."""
    asked = vectors.select(key, F.col(vector).alias("v"), query.alias("q"))
    scored = asked.select(key, F.round(cosine(F.col("v"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """(query, key, score, rank) for each query (query, qv), ties by key: queries go through the vectors in blocks of at most `BLOCK_BYTES`, one
    pass for each block. Each task multiplies matrices and sends on the best k rows per query only; no pairs are made."""
    dimension = queries.select(F.max(F.size("qv"))).first()[0]
    if not dimension:
        return vectors.sparkSession.createDataFrame([], f"query long, {key} {vectors.schema[key].dataType.simpleString()}, score double, rank int")
    blocks = -(-queries.count() * dimension * 8 // BLOCK_BYTES)
    kind, out = vectors.schema[key].dataType.simpleString(), []
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "qv").toPandas()
        if not len(rows):
            continue
        matrix = np.array(rows["qv"].tolist(), np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((rows["query"].to_numpy(), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, asked = shared.value
            best = pd.DataFrame({"query": names[:0], key: [], "score": np.empty(0)})
            for batch in batches:
                batch = batch[batch[vector].notna()]
                for a in range(0, len(batch), step := max(64, (1 << 22) // len(names))):
                    part = batch.iloc[a : a + step]
                    held = np.array(part[vector].tolist(), np.float64).reshape(len(part), -1)
                    score = np.round(asked @ (held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-300)).T, 6) + 0.0
                    least = np.sort(score, axis=1)[:, -min(k, len(part))]
                    q, at = np.nonzero(score >= least[:, None])
                    new = pd.DataFrame({"query": names[q], key: part[key].to_numpy()[at], "score": score[q, at]})
                    best = pd.concat([best, new]) if len(best) else new
                    best = best.sort_values(["query", "score", key], ascending=[True, False, True]).groupby("query", sort=False).head(k)
            # Plain objects: joined columns of strings come in chunks, which aren't taken as one array.
            yield best.assign(**{key: pd.Series(best[key].to_numpy(), best.index, object)})

        out.append(vectors.select(key, vector).mapInPandas(run, f"query long, {key} {kind}, score double"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return functools.reduce(DataFrame.unionByName, out).withColumn("rank", rank).where(F.col("rank") <= k)


def similarity(vectors: DataFrame, query: Column, ids: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(key, score) of the given ids; 0 where there is no vector."""
    asked = ids.join(vectors, key, "left").select(key, F.col(vector).alias("v"), query.alias("q"))
    return asked.select(key, F.coalesce(F.round(cosine(F.col("v"), F.col("q")), 6), F.lit(0.0)).alias("score"))


def upsert(vectors: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    return vectors.join(changed.select(key), key, "left_anti").unionByName(changed)


def remove_prefix(vectors: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    return vectors.where(~F.startswith(F.col(key), F.lit(prefix)))


def intact(nodes: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """One row: ok, missing (nodes without a vector) and wrong (vectors of another size)."""
    missing = nodes.select("id").join(vectors.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    wrong = vectors.where(F.size("vector") != dimension).agg(F.count(F.lit(1)).alias("wrong"))
    return missing.select("missing", wrong.scalar().alias("wrong")).select(((F.col("missing") == 0) & (F.col("wrong") == 0)).alias("ok"), "missing", "wrong")


def hashed_tokens(dimension: int = DIMENSION) -> Callable[[list[str]], np.ndarray]:
    """An embedder without weights: sub-words of identifiers, lower-cased, counted in buckets by MD5."""
    known: dict[str, int] = {}

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in enumerate(texts):
            for token in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", text or ""):
                token = token.lower()
                if token not in known:
                    known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimension
                out[row, known[token]] += 1
        return out

    return embed


#: Embedders by name: each value makes a function from texts to a matrix.
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {"hashed": hashed_tokens}


def embedded(frame: DataFrame, text: str, out: str = "vector", provider: str | Callable = "hashed", batch: int = 64) -> DataFrame:
    """frame with a vector column. provider: a name in EMBEDDERS, or what stands there. A batch that the embedder fails on gets nulls instead of failing the job; the reason goes to the
    worker's log, and :func:`without_vector` counts what is missing."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = (EMBEDDERS[provider] if isinstance(provider, str) else provider)()
        for series in batches:
            rows: list = []
            for a in range(0, len(series), batch):
                part = series.iloc[a : a + batch].tolist()
                try:
                    rows += list(embed(part).astype(np.float32))
                except Exception:  # noqa: BLE001  one bad batch isn't fatal
                    log.exception("a batch of %d texts has no vectors", len(part))
                    rows += [None] * len(part)
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return frame.withColumn(out, F.pandas_udf(run, "array<float>")(text))


def dimension_ok(vectors: DataFrame, dimension: int) -> DataFrame:
    return vectors.where(F.size("vector") == dimension)


def without_vector(frame: DataFrame, vector: str = "vector") -> int:
    """How many rows have no vector."""
    return frame.where(F.col(vector).isNull()).count()


def store_facts(vectors: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, contained, stored): whether each of the ids has a vector, and how many vectors there are."""
    have = vectors.select(key, F.lit(True).alias("h"))
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ids.select(key).distinct().join(have, key, "left").select(key, F.coalesce("h", F.lit(False)).alias("contained"), n.alias("stored"))


def chunk_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, file_path, chunk_no, score) of the k best chunks of each query (query, qv). chunks: file_path, chunk_no, vector."""
    # One key that sorts by file and then number.
    keyed = chunks.where("vector is not null").select(F.concat("file_path", F.lit("\0"), F.lpad(F.col("chunk_no").cast("string"), 10, "0")).alias("id"), "vector")
    got = top_k_each(keyed, queries, k)
    return got.select("query", "rank", F.substring_index("id", "\0", 1).alias("file_path"), F.substring_index("id", "\0", -1).cast("int").alias("chunk_no"), "score")


def stale_chunks(cache: DataFrame, files: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(chunks of a cache that are still valid, files to chunk anew). A chunk is valid if it has content and a vector of the right size and its
    file is still there, unchanged since (mtime). cache: file_path, chunk_no, content, vector, mtime; files: path, mtime."""
    sound = cache.where((F.length("content") > 0) & (F.size("vector") == dimension))
    there = files.select(F.col("path").alias("file_path"), "mtime")
    valid = sound.join(there, ["file_path", "mtime"], "left_semi")
    return valid, files.join(valid.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
