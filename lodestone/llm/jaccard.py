"""Operator 10: near-duplicate join on five-word shingles with Jaccard similarity of 0.8 or more, by chosen paths.

A document is the set of its shingles (runs of five words; a text of one to four words is one shingle). Documents with equal sets
form a class, told apart by two 64-bit sums over the set, get a number and go on as one. Each class has `COORDINATES` one-permutation
minimum hashes; a token is a coordinate with its value, and two sets share about as large a part of their tokens as their similarity.

Chosen paths: in each of `RUNS` runs every set starts at a root. At a node it takes each of its tokens with the probability
1 / (0.8 * COORDINATES), decided by a hash of node and token alone, and goes on to one child for each. Two sets of similarity
0.8 share one child per node on average, so they meet at depth two of one run with probability 0.47 and, over all runs, with 0.999;
unlike sets part at once. Nodes at depth `DEPTH` are buckets. Buckets of up to `SMALL` sets are compared by brute
force, pair by pair. In larger ones (mostly groups of copies that share nearly every token), which aren't split further as each split
would lose pairs, shingle sets are compared exactly until each set outside the largest component has met all others, in pairs of blocks
where there are more than 2 * `BLOCK`. Only exact links join components. The links told of a large bucket are those that connect it,
so that m close copies give links in proportion to m; op10 then compares all sets of each group with each other, again in blocks,
and counts all links (`complete`), a work that grows with the square of a group's size while the rows grow with the group.

Pairs of small buckets whose estimated similarity is at least `LIKELY` are checked exactly on the shingle sets of the whole texts; those of 0.8 or more
are the links. The estimate is the same in all runs: a pair of similarity 0.8 falls below `LIKELY` with probability 0.0001 (binomial, 128
coordinates), which the recall of 0.999 includes. Classes connected by links form a group (minimum labels with pointer jumping; tables in the
shared folder, nothing at the driver but counts).

Result: per document doc_id, class_id (the least doc_id of its group), n_links (links of its class to classes with other
texts) and n_copies (documents of its class, itself included).

Cases: a text without a word (or null) has no shingle, resembles nothing and is its own group; rows equal in all respects
are copies of each other; a null doc_id takes part and isn't a class_id unless all of its group are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._spark import discard, finished, fresh, on_row, staged, table

THRESHOLD, WIDTH = 0.8, 5
COORDINATES, RUNS, DEPTH, SMALL, BLOCK, LIKELY = 128, 12, 2, 64, 2048, 0.66
U = np.uint64


def distinct_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document), sorted by document and then hash, each once. At most 2048 documents: hashes keep 53 bits."""
    h, doc = V.shingles(V.Words(V.Chunk(texts)), WIDTH)
    key = (doc.astype(U) << U(53)) | (h >> U(11))
    key = np.unique(key)
    return key << U(11), (key >> U(53)).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class, other, size, sketch) per document; class and other, two hashes of the set, are null where there is no shingle."""
    schema = "doc_id long, text_hash long, class long, other long, size int, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = V.OnePermutation(COORDINATES, seed=5)
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for a, b in V.spans([len(t) for t in texts]):
                h, doc = distinct_shingles(texts[a:b])
                n = b - a
                size = np.bincount(doc, minlength=n)
                total = np.zeros((2, n), U)
                for k in range(2):
                    np.add.at(total[k], doc, V.mix(h + U(k)))
                names = [pa.array(V.mix(t + size.astype(U)).view(np.int64), mask=size == 0) for t in total]
                sketch = hasher.values(V.mix(h), doc, n).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(1).slice(a, n), *names, pa.array(size, pa.int32()), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    [x.split()[0] for x in schema.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return rows.mapInArrow(V.released(run), schema)


def children(node: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): the children of each row's node; token has a row of tokens for each."""
    limit = U(int(2**64 / (THRESHOLD * COORDINATES)))
    rows, out = [], []
    for a in range(0, len(node), 4096):
        h = V.mix(token[a : a + 4096] ^ node[a : a + 4096, None])
        r, c = np.nonzero(h < limit)
        rows.append(r + a)
        out.append(V.mix(h[r, c] + token[a : a + 4096][r, c]))
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.empty(0, np.int64), np.empty(0, U))


def tokens(sketches: list[bytes]) -> np.ndarray:
    values = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, COORDINATES).astype(U)
    return V.mix(values + (np.arange(COORDINATES, dtype=U) << U(16)) + U(1))


def paths(frame: DataFrame, levels: int) -> DataFrame:
    """(node, class): the nodes `levels` levels below the roots of all runs. frame: class, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = V.seeds(RUNS, 77)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                token = tokens(part.column(1).to_pylist())
                row, node = np.repeat(np.arange(len(token)), RUNS), np.tile(roots, len(token))
                for _ in range(levels):
                    at, node = children(node, token[row])
                    row = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), part.column(0).take(pa.array(row))], ["node", "class"])

    return frame.select("class", "sketch").mapInArrow(V.released(run), "node long, class long").distinct()


def compared(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of sets of a bucket whose estimate is at least LIKELY. buckets: node, class, sketch. Rows come sorted
    by bucket, and only one bucket is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, names, held, many = None, [], np.empty((SMALL, COORDINATES), np.uint16), 0
        for batch in batches:
            a, b = [], []
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, COORDINATES)
            for i, (node, name) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)):
                if node != bucket:
                    bucket, names, many = node, [], 0
                for k in np.flatnonzero((held[:many] == values[i]).mean(axis=1) >= LIKELY).tolist() if many else ():
                    a.append(min(name, names[k]))
                    b.append(max(name, names[k]))
                if many == len(held):
                    held = np.concatenate([held, np.empty_like(held)])
                held[many] = values[i]
                names.append(name)
                many += 1
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = buckets.select("node", "class", "sketch")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(V.released(run), "a long, b long")


class Sets:
    """Shingle sets side by side. like() compares some of them with all, exactly: shingles of many sets are counted by a product of
    matrices, others by the lists of the sets that have them."""

    MATRIX = 1 << 24

    def __init__(self, texts: list[bytes], kind: np.ndarray | None = None):
        """kind: a number for each set; those of different numbers have nothing in common."""
        self.n = n = len(texts)
        hashes, docs = [], []
        for a, b in V.spans([len(t) for t in texts], max_docs=1000):
            h, doc = distinct_shingles(texts[a:b])
            hashes.append(h if kind is None else V.mix(h + V.mix(kind[a:b].astype(U) + U(1))[doc]))
            docs.append(doc + a)
        h, doc = np.concatenate(hashes), np.concatenate(docs)
        self.size = np.bincount(doc, minlength=n)
        _, token, count = np.unique(h, return_inverse=True, return_counts=True)
        most = np.argsort(-count, kind="stable")[: self.MATRIX // n]
        most = most[count[most] > max(1, n / 16)]
        column = np.full(len(count), -1)
        column[most] = np.arange(len(most))
        at = column[token]
        self.matrix = np.zeros((n, len(most)), np.float32)
        self.matrix[doc[at >= 0], at[at >= 0]] = 1
        rare = (at < 0) & (count[token] > 1)
        self.token, doc = token[rare], doc[rare]
        self.begin = np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(self.token, kind="stable")
        self.having, self.first = doc[order], np.searchsorted(self.token[order], np.arange(len(count) + 1))

    def like(self, rows: np.ndarray) -> np.ndarray:
        """rows x n: which sets have a similarity of THRESHOLD or more with each of the rows (itself not)."""
        common = self.matrix[rows] @ self.matrix.T
        for k, r in enumerate(rows):
            t = self.token[self.begin[r] : self.begin[r + 1]]
            length = self.first[t + 1] - self.first[t]
            at = np.repeat(self.first[t] - np.cumsum(length) + length, length) + np.arange(length.sum())
            common[k] += np.bincount(self.having[at], minlength=self.n)
        out = common >= THRESHOLD * (self.size[rows][:, None] + self.size - common.astype(np.float64)) - 1e-9
        out[np.arange(len(rows)), rows] = False
        return out

    def connecting(self) -> list[tuple[int, int]]:
        """Links that connect whatever all links connect. In the end each set outside the largest component has met all sets."""
        label, met, out, many = np.arange(self.n), np.zeros(self.n, bool), [], 16
        while len(rows := np.flatnonzero(~met & (label != np.argmax(np.bincount(label))))[:many]):
            for x, like in zip(rows.tolist(), self.like(rows), strict=True):
                near = np.flatnonzero(like & (label != label[x]))
                if len(near):
                    other, k = np.unique(label[near], return_index=True)
                    out += [(x, y) for y in near[k].tolist()]
                    label[np.isin(label, other)] = label[x]
            met[rows] = True
            many = min(256, 2 * many)
        return out


def dealt(sets: DataFrame, key: str, count: str) -> DataFrame:
    """sets with columns block, i and j: groups of the key of more than 2 * BLOCK sets are dealt into blocks, and each set goes to all
    pairs of blocks i <= j that have its own."""
    blocks = F.when(F.col(count) <= 2 * BLOCK, 1).otherwise(F.ceil(F.col(count) / BLOCK)).cast("int")
    out = sets.withColumn("block", F.pmod(F.xxhash64(key, "class"), blocks).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k")).drop("k")


def connecting(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact links (a, b), a < b, that connect what all links within the buckets connect. buckets: node, class, count; texts: class, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, held, _, _ in gathered(batches, 1):
            pairs = [sorted((names[x], names[y])) for x, y in Sets(held).connecting()]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    # Pairs of different blocks bring the sets of both, which meet among themselves too; blocks need no pair of their own then.
    rows = dealt(buckets, "node", "count").where(f"i < j OR count <= {2 * BLOCK}").join(texts, "class").select("node", "i", "j", "block", "class", "text")
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(V.released(run), "a long, b long")


def degrees(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, n_links): the number of all links of each class within its group. groups: label, class, count; texts: class, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, held, kind, block in gathered(batches, 512):
            sets, n = Sets(held, kind), np.zeros(len(held), np.int64)
            # Within a pair of different blocks only sets of different ones are counted.
            both = np.array([len(np.unique(block[kind == k])) > 1 for k in range(kind[-1] + 1)])[kind]
            for a in range(0, len(held), 256):
                at = np.arange(a, min(a + 256, len(held)))
                n[at] = (sets.like(at) & (~both[at][:, None] | (block[at][:, None] != block))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n)], ["class", "n"])

    rows = dealt(groups, "label", "count").join(texts, "class").select("label", "i", "j", "block", "class", "text")
    counted = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(V.released(run), "class long, n long")
    return counted.groupBy("class").agg(F.sum("n").alias("n_links"))


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[int], list[bytes], np.ndarray, np.ndarray]]:
    """(classes, texts, number of the key, block) of one key (the first three columns) after the other, of several until they have `least` sets."""
    last, names, held, kind, block = None, [], [], [], []
    for batch in batches:
        for *key, own, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                if len(names) >= least:
                    yield names, held, np.array(kind), np.array(block)
                    names, held, kind, block = [], [], [], []
                last, number = key, kind[-1] + 1 if kind else 0
            names.append(name), held.append(text), kind.append(number), block.append(own)
    if names:
        yield names, held, np.array(kind), np.array(block)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct likely pairs (a, b) of classes that met in a small bucket, and the large buckets (node, class, count). classes: class, sketch."""
    leaves = staged(paths(classes, DEPTH), "paths")
    sizes = leaves.groupBy("node").count().where("count > 1")
    shared = staged(leaves.join(sizes, "node"), "buckets")
    small = shared.where(F.col("count") <= SMALL).join(classes, "class")
    return compared(small).distinct(), shared.where(F.col("count") > SMALL).select("node", "class", "count")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of THRESHOLD or more. texts: class, text (binary), one row per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(len(left), bool)
            for i, j in V.spans([len(x) + len(y) for x, y in zip(left, right, strict=True)], max_docs=1000):
                n = j - i
                h, doc = distinct_shingles(left[i:j] + right[i:j])
                key = np.sort((h >> U(11)) | ((doc % n).astype(U) << U(53)))
                common = np.bincount((key[1:][key[1:] == key[:-1]] >> U(53)).astype(np.int64), minlength=n)
                ok[i:j] = common >= THRESHOLD * (np.bincount(doc % n, minlength=n) - common) - 1e-9
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    one = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("left")), "a")
    both = one.join(texts.select(F.col("class").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(V.released(run), "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """(class, label) of all classes that have a link; label: the least class that it is connected to."""
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    new = labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class"), F.least("a", "m").alias("label")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["class"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(told, labels["class"] == told["a"]).select("class", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("class").alias("c"), F.col("label").alias("over"))
        last, new = new, staged(nearer.join(jump, nearer["label"] == jump["c"], "left").select("class", "old", F.least("label", F.coalesce("over", "label")).alias("label")), "labels")
        labels = new.select("class", "label")
        discard(last)
        if new.where("label <> old").isEmpty():
            discard(both)
            return labels


def grouped(docs: DataFrame, complete: bool = False) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, n_copies, first): one row per document; first marks the one that stays of its group.

    complete: n_links counts all links of each class in its group, not only those found in small buckets and those that connect large ones."""
    signed = staged(signatures(docs), "signatures")
    known = signed.where(F.col("class").isNotNull())
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    # Classes are numbered in a table, so that no two of them share a number.
    named = known.groupBy("class", "other").agg(F.min("doc_id").alias("least"), F.min(place).alias("place"), F.count(F.lit(1)).alias("n_copies"), F.first("sketch").alias("sketch"))
    named = staged(named.withColumn("number", F.monotonically_increasing_id()), "classes")
    classes = named.select(F.col("number").alias("class"), "least", "place", "n_copies")
    sketches = named.select(F.col("number").alias("class"), "sketch")
    rows = signed.drop("sketch", "size").join(named.select("class", "other", "number"), ["class", "other"], "left").select("doc_id", "text_hash", F.col("number").alias("class"))
    rows = finished(rows, "rows", signed)
    pairs, large = candidates(sketches)
    pairs = staged(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(large.select("class")).distinct()
    wanted = wanted.join(classes, "class").select("class", F.col("place.doc_id").alias("wid"), F.col("place.text_hash").alias("wh"))
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = source.join(wanted, on_row(source, wanted, "doc_id", "text_hash", "wid", "wh"))
    texts = staged(texts.groupBy("class").agg(F.first("text").alias("text")), "texts")  # rows equal in all respects are one
    links = staged(verified(pairs, texts).unionByName(connecting(large, texts)).distinct(), "links")
    labels = connected(links)
    if complete:
        degree = degrees(labels.join(labels.groupBy("label").count(), "label"), texts)
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    info = classes.join(labels, "class", "left").join(degree, "class", "left").withColumn("label", F.coalesce("label", "class")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    base = staged(info, "info")
    discard(pairs, links, texts)
    groups = base.groupBy("label").agg(F.min("least").alias("class_id"), F.min("place").alias("stays"))
    info = finished(base.join(groups, "label").select("class", "class_id", "n_links", "n_copies", "stays"), "info", base)
    out = rows.join(info, "class", "left")
    first = F.col("stays").isNull() | (F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash")) == F.col("stays"))
    lone = F.col("class").isNull()
    out = out.select("doc_id", "text_hash", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), first.alias("first"))
    return finished(out, "grouped", rows, info, named)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"), complete=True).select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group the document with the least doc_id stays, once; all columns as they are."""
    h, gid, gh, number = fresh(docs, "text_hash", "group_id", "group_hash", "number")
    plan = grouped(docs)
    stay = plan.where("first").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.first("class_id").alias("c"))
    again = not stay.where("n > 1").isEmpty()
    stay = stay.select(F.col("doc_id").alias(gid), F.col("text_hash").alias(gh))
    left = docs.withColumn(h, F.xxhash64("text"))
    out = left.join(stay, on_row(left, stay, "doc_id", h, gid, gh), "left_semi")
    if again:  # rows equal in doc_id and text: one of them stays if the text has a word
        from pyspark.sql.window import Window

        lone = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        out = out.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", h).orderBy("doc_id"))).where((F.col(number) == 1) | lone)
    return out.select(*docs.columns)
