"""Operator 8: removal of repeated byte strings by bucket-pointer refinement over sparse suffixes.

Texts are UTF-8 bytes. A byte goes if it is covered by a string of `LENGTH` bytes, within its document, that also starts anywhere
else; all occurrences go, judged on the input.

Sorting all suffixes isn't needed to find strings of one length, and a row for each byte would shuffle more than ten times the input. Suffixes are
sparse: each string of LENGTH bytes is filed under its *anchor*, the q-gram (`GRAM` bytes) in it with the least hash, so that equal strings
have equal anchors at the same offset.

1. Initial buckets: anchors by q-gram. Buckets with one suffix are finished and leave.
2. Refinement: a suffix's bucket for twice the length is named after its bucket and that of the suffix at the later offset, the length on
   (:class:`Buckets`): names of GRAM, 2 GRAM, 4 GRAM and 8 GRAM bytes, each made of the names before, and, for other lengths, of two
   names that overlap. A name is a hash, equal in all texts, so that no sorted order has to be sent round. The strings of one anchor
   whose starts fall into the same cell of `CELL` offsets share a *core* (their intersection) and lie in one *hull* (their union). Cells
   are sorted into buckets by core and, within those, by hull. A hull bucket of two or more settles all its strings at once
   (repeated); a core bucket of one does, too (not repeated).
3. What is left, the cells at the ends of repeated passages, is refined to the strings themselves, together with
   one member of each settled hull bucket of the same core. Settled buckets are thus reused instead of being sorted again.

All buckets are groups of Spark aggregations (summed before the shuffle), so that a passage in a third of all documents
is no large group in any task. Equal texts are one text of multiplicity two or more, and are removed as a whole (from LENGTH
bytes on). Deciding hashes, of strings and of texts, have 128 bits (two of 64). Documents of any length are read in segments.

Cases: a null text has 0 bytes; shorter texts than LENGTH keep everything; equal rows count as two documents. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._spark import discard, finished, staged, table

LENGTH, GRAM, CELL = 400, 40, 32
SEGMENT = 1 << 20
U = np.uint64
OTHER_BASE = 0xD1342543DE82EF95


KEY = "struct<a:long,b:long>"


def text_key() -> Column:
    """What tells a text from others: two hashes."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width` keys, by minima from both ends of blocks of that size."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, U(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(piece, q-gram hash, anchor, first start, last start) of each run of starts with one anchor; places are within pieces."""
    chunk = V.Chunk(pieces)
    buf, n = chunk.buf, len(chunk.buf)
    if n < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    prefix = chunk.prefix(21)
    inverse = V.powers(V.INVERSE, n)[: n - GRAM + 1]
    gram = V.mix((prefix[GRAM:] - prefix[: n - GRAM + 1]) * inverse)
    bits = U(max(1, n.bit_length()))
    low = (U(1) << bits) - U(1)
    best = least_in_windows((gram & ~low) | np.arange(len(gram), dtype=U), LENGTH - GRAM + 1)
    at = (best & low).astype(np.int64)
    # Starts whose string lies within a piece: the line feed after each piece belongs to none.
    piece = np.searchsorted(chunk.at, np.arange(n - LENGTH + 1), side="right") - 1
    good = np.arange(n - LENGTH + 1) + LENGTH < chunk.at[piece + 1]
    start = np.flatnonzero(good)
    at, piece = at[start], piece[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else start
    last = np.append(first[1:], len(start))[: len(first)] - 1
    base = chunk.at[piece[first]]
    return piece[first], gram[at[first]].view(np.int64), at[first] - base, start[first] - base, start[last] - base


def segments(texts: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(text, offset, bytes): each text in segments that overlap by LENGTH - 1 bytes, so that each string starts in one."""
    return [(i, a, t[a : a + SEGMENT + LENGTH - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - LENGTH + 1), SEGMENT)]


def all_anchors(texts: DataFrame) -> DataFrame:
    """(gram, text_key, place): place packs anchor, anchor - first start and anchor - last start. texts: text_key, text (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = segments(batch.column(1).to_pylist())
            for i, j in V.spans([len(p[2]) for p in parts]):
                piece, gram, at, first, last = anchors([p[2] for p in parts[i:j]])
                offset = np.array([p[1] for p in parts[i:j]], np.int64)[piece]
                place = ((at + offset) << 20) | ((at - first) << 10) | (at - last)
                owner = np.array([p[0] for p in parts[i:j]], np.int64)[piece]
                yield pa.RecordBatch.from_arrays([pa.array(gram), batch.column(0).take(pa.array(owner)), pa.array(place)], ["gram", "text_key", "place"])

    return texts.mapInArrow(V.released(run), f"gram long, text_key {KEY}, place long")


def merged(places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start), each anchor once: runs that segments have cut are put together."""
    p = np.sort(np.array(places, np.int64))
    at = p >> 20
    first, last = at - ((p >> 10) & 1023), at - (p & 1023)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[new], np.minimum.reduceat(first, new), np.maximum.reduceat(last, new)


class Buckets:
    """Names (two of 64 bits) of the buckets of all suffixes of a text, from q-grams on by doubling."""

    def __init__(self, text: bytes):
        chunk = V.Chunk([text])
        n, self.names = len(text), []
        for seed, base in ((31, V.BASE), (32, OTHER_BASE)):
            prefix = chunk.prefix(seed, base)
            inverse = V.powers(pow(base, -1, 1 << 64), n + 1)
            name, length = (prefix[GRAM : n + 1] - prefix[: n + 1 - GRAM]) * inverse[: n + 1 - GRAM], GRAM
            while 2 * length <= LENGTH - CELL + 1:
                name = V.mix(name[:-length] * U(base) + name[length:])
                length *= 2
            self.names.append(name)
        self.length = length

    def _at(self, which: int, begin: np.ndarray, length: int) -> np.ndarray:
        name = self.names[which]
        return V.mix(name[begin] * U(OTHER_BASE) + name[begin + length - self.length] + U(length)).view(np.int64)

    def first(self, begin: np.ndarray, length: int) -> np.ndarray:
        """The first name of the strings of a length, from `length` of the last doubling to twice that, that begin there."""
        return self._at(0, begin, length)

    def second(self, begin: np.ndarray, length: int) -> np.ndarray:
        return self._at(1, begin, length)


def stretches(text: bytes, start: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(begin, end, offset, bytes): the ascending starts begin..end lie in a stretch of the text, from offset on, with all that cells and strings at
    them reach. A stretch has about `SEGMENT` bytes, however long the text is."""
    begin = 0
    while begin < len(start):
        end = int(np.searchsorted(start, start[begin] + SEGMENT))
        offset = max(0, int(start[begin]) - 2 * CELL)
        yield begin, end, offset, text[offset : int(start[end - 1]) + 3 * LENGTH]
        begin = end


def cells_of(text: bytes, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(core, hull, has hull, starts packed as first << 6 | number - 1) of the cells of all anchors of a text."""
    order, parts = np.argsort(first, kind="stable"), []
    at, first, last = at[order], first[order], last[order]
    for a, b, offset, piece in stretches(text, first):
        core, hull, whole, starts = _cells(Buckets(piece), offset, len(text), at[a:b] - offset, first[a:b] - offset, last[a:b] - offset)
        parts.append((core, hull, whole, starts + (offset << 6)))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _cells(buckets: Buckets, offset: int, size: int, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    low, high = (at - last) // CELL, (at - first) // CELL
    times = high - low + 1
    row = np.repeat(np.arange(len(at)), times)
    k = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    a = at[row]
    right, left = a - k * CELL, a - k * CELL - (CELL - 1)
    begin, end = np.maximum(first[row], left), np.minimum(last[row], right)
    core = buckets.first(right, LENGTH - CELL + 1) ^ V.mix(k.astype(U)).view(np.int64)
    whole = (left + offset >= 0) & (right + offset + LENGTH <= size)
    hull = np.zeros(len(left), np.int64)
    hull[whole] = buckets.second(left[whole], LENGTH + CELL - 1)
    return core, hull, whole, (begin << 6) | (end - begin)


def cells(texts: DataFrame) -> DataFrame:
    """(core, hull, text_key, starts, weight): hull is null where it would leave the text. texts: text_key, many, places, text."""
    schema = f"core long, hull long, text_key {KEY}, starts long, weight int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, rows = [[], [], [], [], []], 0

            def flush(columns=columns, batch=batch) -> pa.RecordBatch:
                core, hull, whole, starts, owner = map(np.concatenate, columns)
                owner = pa.array(owner)
                return pa.RecordBatch.from_arrays([pa.array(core), pa.array(hull, mask=~whole), batch.column(0).take(owner), pa.array(starts), batch.column(1).take(owner)], [x.split()[0] for x in schema.split(", ")])

            for i, (places, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                got = cells_of(text, *merged(places))
                for column, values in zip(columns, (*got, np.full(len(got[0]), i)), strict=True):
                    column.append(values)
                rows += len(got[0])
                if rows > 200_000:
                    yield flush()
                    for column in columns:
                        column.clear()
                    rows = 0
            if rows:
                yield flush()

    return texts.select("text_key", "many", "places", "text").mapInArrow(V.released(run), schema)


def strings(texts: DataFrame) -> DataFrame:
    """(one, two, text_key, start, weight) of all strings that begin in the given cells. texts: text_key, wanted (starts, weight), text."""
    schema = f"one long, two long, text_key {KEY}, start long, weight int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (wanted, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                cell, weight = (np.array([w[c] for w in wanted], np.int64) for c in ("starts", "weight"))
                order = np.argsort(cell, kind="stable")
                cell, weight = cell[order], weight[order]
                for a, b, offset, piece in stretches(text, cell >> 6):
                    buckets = Buckets(piece)
                    for j in range(a, b, 4096):
                        some = cell[j : min(j + 4096, b)]
                        times = (some & 63) + 1
                        start = np.repeat(some >> 6, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        heavy = np.repeat(weight[j : min(j + 4096, b)].astype(np.int32), times)
                        owner, at = pa.array(np.full(len(start), i)), start - offset
                        yield pa.RecordBatch.from_arrays([pa.array(buckets.first(at, LENGTH)), pa.array(buckets.second(at, LENGTH)), batch.column(0).take(owner), pa.array(start), pa.array(heavy)], [x.split()[0] for x in schema.split(", ")])

    return texts.select("text_key", "wanted", "text").mapInArrow(V.released(run), schema)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(text_key, whole, spans): for texts that have any, the runs (first, last) of starts of repeated strings; whole: the text itself repeats."""
    texts = docs.where(F.octet_length("text") >= LENGTH).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    many = staged(texts.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner")), "texts")
    found = staged(all_anchors(texts.select("text_key", "text")), "anchors")
    place = F.xxhash64("text_key", F.shiftright("place", 20))
    often = found.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("gram")
    # A table of its own, so that a common q-gram's rows can be split among tasks.
    often = staged(often, "often")
    per_text = found.join(often, "gram").groupBy("text_key").agg(F.collect_set("place").alias("places"))
    per_text = per_text.join(many, "text_key").select("text_key", "places", "owner", F.when(F.col("n") > 1, 2).otherwise(1).cast("int").alias("many"))
    owned = lambda side: (texts["text_key"] == side["text_key"]) & texts["doc_id"].eqNullSafe(side["owner"])
    cell = staged(cells(texts.join(per_text, owned(per_text)).select(per_text["text_key"], "many", "places", "text")), "cells")
    discard(found, often)
    # Buckets by core and hull; a cell without a hull is a bucket by itself.
    hull = cell.where("hull is not null").groupBy("core", "hull").agg(F.sum("weight").alias("w"), F.min("text_key.a").alias("a"), F.min("text_key.b").alias("b"), F.min("starts").alias("starts"))
    settled = staged(hull, "hulls")
    bare = cell.where("hull is null").select("core", F.lit(None).cast("long").alias("hull"), F.col("weight").cast("long").alias("w"), "text_key.a", "text_key.b", "starts")
    every = settled.unionByName(bare)
    cores = every.groupBy("core").agg(F.sum("w").alias("all"), F.max((F.col("hull").isNull() | (F.col("w") < 2)).cast("int")).alias("open")).where("all > 1 and open = 1").select("core")
    # A bucket of one cell has that cell's key and starts; of several cells they may be of different ones, and a member is found by a join.
    open_ = every.join(cores, "core")
    left = open_.where("hull is null or w < 2").select(F.struct("a", "b").alias("text_key"), "starts", F.lit(1).alias("weight"))
    member = open_.where("hull is not null and w >= 2").select("core", "hull", "a")
    same = cell.join(member, ["core", "hull"]).where("text_key.a = a")
    chosen = same.groupBy("core", "hull").agg(F.min(F.struct("text_key", "starts")).alias("m")).select("m.text_key", "m.starts", F.lit(2).alias("weight"))
    wanted = left.unionByName(chosen).groupBy("text_key").agg(F.collect_list(F.struct("starts", "weight")).alias("wanted")).join(many.select("text_key", "owner"), "text_key")
    string = staged(strings(texts.join(wanted, owned(wanted)).select(wanted["text_key"], "wanted", "text")), "strings")
    twice = string.groupBy("one", "two").agg(F.sum("weight").alias("w")).where("w > 1").select("one", "two")
    singles = string.where("weight = 1").join(twice, ["one", "two"]).select("text_key", F.col("start").alias("first"), F.col("start").alias("last"))
    full = cell.join(settled.where("w > 1").select("core", "hull"), ["core", "hull"], "left_semi").select("text_key", F.shiftright("starts", 6).alias("first"), (F.shiftright("starts", 6) + F.col("starts").bitwiseAND(63)).alias("last"))
    spans = singles.unionByName(full).groupBy("text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    whole = many.where("n > 1").select("text_key", F.lit(True).alias("whole"))
    out = spans.join(whole, "text_key", "full_outer").select("text_key", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    return finished(out, "spans", many, cell, settled, string)


def without_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, whole, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                text = text or b""
                if whole:
                    begin, end = np.array([0]), np.array([len(text)])
                elif spans:
                    pairs = np.array([(s["first"], s["last"] + LENGTH) for s in spans], np.int64)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
                    begin, end = pairs[new, 0], reach[np.append(new[1:], len(reach)) - 1]
                else:
                    begin = end = np.empty(0, np.int64)
                kept, at = hashlib.sha256(), 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.update(text[at:b])
                    at = e
                kept.update(text[at:])
                for column, value in zip(out, (len(text), int((end - begin).sum()), len(begin), kept.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], [x.split()[0] for x in schema.split(", ")])

    gone = repeated_starts(docs)
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("k"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(gone, rows["k"] == gone["text_key"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    return joined.mapInArrow(V.released(run), schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated(table(spark, sf_dir, "documents"))
