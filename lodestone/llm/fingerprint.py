"""Operator 1: document fingerprints by one-permutation MinHash with optimal densification.

Shingles are runs of five words. Each is hashed once; its high bits name one of `bins` bins, each bin
keeps its least value, empty bins are filled by optimal densification (:class:`_vec.OnePermutation`), and the
`bits` low-order bits of every bin are packed. Two fingerprints that agree in a share m of their bins
have the likeness (m - C) / (1 - C) with C = 2**-bits, clipped to 0..1: agreement by chance is taken off.

Cases: a null text is the empty text; a text without a word has the empty fingerprint ''; two empty
fingerprints have likeness 1, an empty and another one 0; a text of one to four words is one shingle; equal
texts have equal fingerprints. Rows with equal doc_id stand in the order of their texts; a null doc_id comes first.
An empty table gives no rows. Only doc_id and text are read, so that further columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._spark import rank_in, table

BINS, BITS = 512, 4
#: Rows in a bucket of neighbouring ids, the most ranges of ids whose bounds are a literal of the plan, and the most buckets in each range, whose
#: bounds are sent to the tasks (8 MB at most).
BUCKET_ROWS, MOST_RANGES, MOST_IN_RANGE = 1000, 10_000, 100


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS):
        if bits not in (1, 2, 4, 8):
            raise ValueError("bits must divide a byte")
        self.bins, self.bits, self.hasher = bins, bits, V.OnePermutation(bins)

    def low_bits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(documents x bins low-order bits, whether the document has a shingle)."""
        low, some = np.zeros((len(texts), self.bins), np.uint8), np.zeros(len(texts), bool)
        for a, b in V.spans([len(t) for t in texts]):
            got = self.hasher.values(*V.shingles(V.Words(V.Chunk(texts[a:b]))), b - a)
            some[a:b] = got[:, 0] != V.OnePermutation.EMPTY
            low[a:b] = got & np.uint32((1 << self.bits) - 1)
        return low, some

    def packed(self, low: np.ndarray, some: np.ndarray) -> list[str]:
        per = 8 // self.bits
        cells = low.reshape(len(low), -1, per)
        out = np.zeros(cells.shape[:2], np.uint8)
        for k in range(per):
            out |= cells[:, :, k] << np.uint8(self.bits * (per - 1 - k))
        return [row.tobytes().hex() if ok else "" for row, ok in zip(out, some, strict=True)]

    def likeness(self, a, some_a, b, some_b) -> np.ndarray:
        chance = 2.0**-self.bits
        got = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
        return np.where(some_a & some_b, got, (some_a == some_b).astype(float))


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text): each bucket holds a range of ids and, as its last row, the next bucket's first one as a guest.

    The bounds are quantiles of doc_id (ids of the table itself), of the table and then within each range, so that every bucket's first row is
    known by its id; the whole text is shuffled once and nothing is sorted in one task. Some 10**9 rows have buckets of
    BUCKET_ROWS; beyond, buckets grow, but they are sorted with spilling and read as streams."""
    at = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.count("doc_id").alias("known")).first()
    ranges = max(1, min(MOST_RANGES, at["n"] // BUCKET_ROWS))
    within = min(MOST_IN_RANGE, at["n"] // (ranges * BUCKET_ROWS))
    shares = lambda k: F.array(*[F.lit(i / k) for i in range(1, k)])
    bounds: list[int] = []
    if ranges > 1 and at["known"]:
        found = docs.agg(F.percentile_approx("doc_id", shares(ranges), F.lit(max(10_000, 10 * ranges))).alias("q")).first()["q"]
        bounds = sorted({x for x in found if x != at["low"] or at["known"] < at["n"]})
    known = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("range", rank_in(bounds, F.col("doc_id")).cast("int"))
    number, opens, last = F.col("range"), F.array_contains(known, F.col("doc_id")), len(bounds)
    if within > 1 and at["known"]:
        inner = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").withColumn("range", rank_in(bounds, F.col("doc_id")).cast("int"))
        got = {r["range"]: r["q"] for r in inner.groupBy("range").agg(F.percentile_approx("doc_id", shares(within), F.lit(10 * within)).alias("q")).collect()}
        table_, offset = [], 0
        for r in range(len(bounds) + 1):
            least = bounds[r - 1] if r else None if at["known"] < at["n"] else at["low"]
            cuts = sorted({x for x in got.get(r, ()) if x != least})
            table_.append((r, offset, cuts))
            offset += len(cuts) + 1
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(table_, "range int, offset int, cuts array<bigint>")), "range")
        below = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda b: b <= F.col("doc_id"))))
        number, opens, last = F.col("offset") + below, opens | F.array_contains("cuts", F.col("doc_id")), offset - 1
    rows = rows.withColumn("bucket", number.cast("int"))
    first = F.col("doc_id").isNull() if at["known"] < at["n"] else F.col("doc_id") == F.lit(at["low"])
    place = lambda b, guest: F.struct(b.cast("int").alias("b"), F.lit(guest).alias("g"))
    some = lambda on, b: F.when(F.coalesce(on, F.lit(False)), F.array(place(b, True))).otherwise(F.array().cast("array<struct<b:int,g:boolean>>"))
    places = F.concat(F.array(place(F.col("bucket"), False)), some(opens, F.col("bucket") - 1), some(first, F.lit(last)))
    return rows.select("doc_id", "text", F.explode(places).alias("p")).select(F.col("p.b").alias("bucket"), F.col("p.g").alias("guest"), "doc_id", "text")


def compare_with_next(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the module for the cases."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, names = Fingerprinter(bins, bits), [x.split()[0] for x in schema.split(", ")]

        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            own = [i for i in range(len(rows) - 1) if not rows[i][1]]
            if not own:
                return
            low, some = maker.low_bits([r[3].encode("utf-8", "surrogatepass") for r in rows])
            edited = []
            for i in own:
                text, after = rows[i][3], rows[i + 1][3]
                half = len(text) // 2
                edited.append((text[: len(text) - half] + after[:half]).encode("utf-8", "surrogatepass"))
            low_e, some_e = maker.low_bits(edited)
            at, after = np.array(own), np.array(own) + 1
            columns = [
                pa.array([rows[i][2] for i in own], pa.int64()), pa.array([len(rows[i][3]) for i in own], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(maker.packed(low[at], some[at])), pa.array(maker.packed(low_e, some_e)),
                pa.array(maker.likeness(low[at], some[at], low_e, some_e)), pa.array(maker.likeness(low[at], some[at], low[after], some[after])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (row[0], row[1], row[2], row[3] or "")
                waiting.append(row)
                size += len(row[3])
                if size >= V.CHUNK_BYTES or len(waiting) > V.CHUNK_DOCS:
                    yield from emit(waiting)
                    waiting, size = waiting[-1:], len(row[3])
        yield from emit(waiting)

    rows = neighbours(docs)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(V.released(run), schema)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
