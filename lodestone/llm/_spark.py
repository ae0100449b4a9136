"""Session helpers: shared staging tables, names that clash with nothing, null-safe row keys."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folders of staged tables.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: Bytes that separate words, as a character class of Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but only if driver and
    executors are one process (tests): other executors couldn't see it."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="stage-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as a table (in folders by the columns `by`) to the shared folder and read again: lineage is cut and lost executors
    lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        if path := _paths.pop(t, None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def finished(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """df staged, after which the staged tables that it was made of are deleted."""
    out = staged(df, name)
    discard(*used)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def rank_in(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most `value` (null: 0): a literal of the plan, searched through every step-th bound."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    fine, coarse = (F.array(*[F.lit(b).cast("long") for b in some]) for some in (bounds, bounds[step - 1 :: step]))
    begun = F.size(F.filter(coarse, lambda b: b <= value)) * step
    rest = F.size(F.filter(F.slice(fine, begun + 1, step), lambda b: b <= value))
    return F.when(value.isNull(), 0).otherwise(begun + rest)


def on_row(left: DataFrame, right: DataFrame, id_column: str, hash_column: str, right_id: str, right_hash: str) -> Column:
    """Join condition on a document's id (nulls equal each other) and the hash of its text."""
    return left[hash_column].eqNullSafe(right[right_hash]) & left[id_column].eqNullSafe(right[right_id])
