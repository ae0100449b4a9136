"""Operator 3: removal of repeated runs of lines by winnowing over line hashes.

A document's units are its lines (split at line feeds) that have a word, without white space at both ends. A
*run* is two neighbouring units, or one unit of at least `LONG_WORDS` words. A run is *repeated* if an equal one begins
earlier: in a document with a lower doc_id (null first), or further up in the same one. Every line of a
repeated run goes, so that longer matches go as a whole and the first occurrence stays; what is repeated is judged
on the input. Lines without a word stay, as do all others.

Winnowing: of every window of two units the one with the least hash (the later on a tie), and every long unit, is
a fingerprint at a position, its anchor; any two equal runs hence share one at the same offset. Fingerprints that occur once end
there. The others' positions are joined, and each match is extended both ways from its anchor, a unit to the left and one to the
right, by comparing 128-bit hashes of the longer piece with those at the fingerprint's other positions: with the first equal one only,
never within all pairs. The next anchor, at most two units on, extends the match further, so that matched pieces that touch or overlap
make up the maximal runs (:func:`repeated_runs`), which are then deleted.

Cases: a null text stays null and has no lines; rows equal in doc_id and text are one document stored twice
and keep or lose the same lines; a document may become empty, its row stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _vec as V
from ._spark import finished, fresh, on_row, staged, table

LONG_WORDS = 5
U = np.uint64


class Units:
    """Lines with a word of a chunk: document, number within it, words and two hashes of each."""

    def __init__(self, chunk: V.Chunk):
        words = V.Words(chunk)
        feeds = np.flatnonzero(chunk.buf == 10)
        line = np.searchsorted(feeds, words.begin)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
        last = np.append(first[1:], len(line)) - 1 if len(first) else first
        self.doc = words.doc()[first]
        self.words = last - first + 1
        self.number = np.arange(len(first)) - np.searchsorted(self.doc, self.doc)
        self.line = line[first] - np.searchsorted(feeds, chunk.at[self.doc])
        self.hash = [V.substring_hash(chunk.prefix(s, b), words.begin[first], words.end[last], b) for s, b in ((1, V.BASE), (2, 0xD1342543DE82EF95))]


def anchored(units: Units, long_words: int = LONG_WORDS) -> dict[str, np.ndarray]:
    """The pieces to compare (pairs of units, and long ones), each with the fingerprint at the anchor that winnowing selects in it, the number
    of its first unit and the lines of its first and last; lead marks one piece of each anchor."""
    h, g = units.hash
    i = np.flatnonzero(units.doc[1:] == units.doc[:-1])
    anchor = np.where(h[i + 1] <= h[i], i + 1, i)
    single = np.flatnonzero(units.words >= long_words)
    begin, end = np.concatenate([i, single]), np.concatenate([i + 1, single])
    pair = [V.mix(x[i] * U(V.BASE) + x[i + 1]) for x in (h, g)]
    anchor = np.concatenate([anchor, single])
    lead = np.zeros(len(anchor), bool)
    lead[np.unique(anchor, return_index=True)[1]] = True
    return {
        "doc": units.doc[begin], "fingerprint": h[anchor].view(np.int64), "lead": lead, "begin": units.number[begin], "first_line": units.line[begin], "last_line": units.line[end],
        "run1": np.concatenate([pair[0], h[single]]).view(np.int64), "run2": np.concatenate([pair[1], g[single]]).view(np.int64),
    }


def repeated_runs(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_hash, run, lines): the maximal runs of units that repeat earlier ones, numbered in each document from 1, with the numbers
    of their lines (from 0, sorted)."""
    schema = "doc_id long, text_hash long, fingerprint long, lead boolean, begin int, first_line int, last_line int, run1 long, run2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in V.spans([len(t) for t in texts]):
                w = anchored(Units(V.Chunk(texts[a:b])), long_words)
                at = pa.array(w.pop("doc") + a)
                own = [batch.column(k).take(at) for k in (0, 1)]
                types = {"begin": pa.int32(), "first_line": pa.int32(), "last_line": pa.int32()}
                yield pa.RecordBatch.from_arrays(own + [pa.array(v, types.get(k)) for k, v in w.items()], names=[x.split()[0] for x in schema.split(", ")])

    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    pieces = staged(texts.mapInArrow(V.released(run), schema), "line-pieces")
    # Both sides of each join are tables of their own, so that a common fingerprint's or piece's rows can be split among tasks.
    often = staged(pieces.where("lead").groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "often")
    near = staged(pieces.join(often, "fingerprint").drop("fingerprint", "lead"), "near")
    place, size = F.struct("doc_id", "text_hash", "begin"), F.col("last_line") > F.col("first_line")
    first = near.groupBy("run1", "run2", size.alias("pair")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last")).drop("last")
    first = staged(first, "first")
    same = (near["run1"] == first["run1"]) & (near["run2"] == first["run2"]) & (size == first["pair"])
    later = near.join(first, same).where(place > F.col("first")).select("doc_id", "text_hash", "begin", "first_line", "last_line", (F.col("begin") + size.cast("int")).alias("end"))
    row = Window.partitionBy("doc_id", "text_hash").orderBy("begin", "end")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", (reach.isNull() | (F.col("begin") > reach + 1)).cast("int")).withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("first_line", "last_line")))))
    out = runs.groupBy("doc_id", "text_hash", "run").agg(lines.alias("lines"))
    return finished(out, "line-runs", pieces, often, near, first)


def without_repeats(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with one more struct column (its name: the last of the frame's columns) of text, n_lines and n_removed."""
    h, out, rid, rhash, gone = fresh(docs, "text_hash", "deduplicated", "right_id", "right_hash", "gone")
    runs = repeated_runs(docs, long_words).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("lines")).alias("lines")).toDF(rid, rhash, gone)
    left = docs.withColumn(h, F.xxhash64("text"))
    runs = runs.hint("merge")  # grows with the data: never sent to all tasks, however small it is here
    joined = left.join(runs, on_row(left, runs, "doc_id", h, rid, rhash), "left")
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    n_removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return joined.withColumn(out, F.struct(text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))).select(*docs.columns, out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = got.columns[-1]
    return got.select("doc_id", F.col(f"{name}.n_lines").alias("n_lines"), F.col(f"{name}.n_removed").alias("n_removed"), F.col(f"{name}.text").alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with their repeated runs of lines removed; no row goes. n_chars follows the text where there is such a column."""
    got = without_repeats(docs)
    name = got.columns[-1]
    out = got.withColumn("text", F.col(f"{name}.text")).drop(name)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


OP3_SQL = rf"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), marked AS (
  SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM lines
), units AS (
  SELECT doc_id, pos, body, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS n_words,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS u
  FROM marked WHERE body <> ''
), pairs AS (
  SELECT doc_id, u, body, lead(body) OVER (PARTITION BY doc_id ORDER BY u) AS after FROM units
), runs AS (
  SELECT doc_id, u, 2 AS size, body || chr(10) || after AS run FROM pairs WHERE after IS NOT NULL
  UNION ALL SELECT doc_id, u, 1, body FROM units WHERE n_words >= {LONG_WORDS}
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, u) AS k FROM runs
), gone AS (
  SELECT DISTINCT doc_id, u FROM (
    SELECT doc_id, u FROM ordered WHERE k > 1 UNION ALL SELECT doc_id, u + 1 FROM ordered WHERE k > 1 AND size = 2)
), kept AS (
  SELECT m.doc_id, m.pos, m.line, g.u IS NOT NULL AS removed
  FROM marked m LEFT JOIN units s ON m.doc_id = s.doc_id AND m.pos = s.pos
  LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.u = g.u
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed) AS text
  FROM kept GROUP BY doc_id) k ON d.doc_id = k.doc_id
"""
