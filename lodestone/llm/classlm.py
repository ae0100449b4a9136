"""Operator 5: language-model scoring with Brown class-based bigrams.

Tokens: the words of the text with A-Z in lower case, then one end. The *vocabulary*: the tokens that occur at least `LEAST` times, or
so often that at most `VOCABULARY` words do. All other words, known or not, go by a *signature*, hashed from their last two bytes and
whether they are long, one of `SIGNATURES`. Vocabulary and signatures are assigned to `CLASSES` classes by the exchange algorithm,
which moves a word to the class that raises the likelihood of the class bigrams most:

1. One after the other, until a pass moves none (at most `PASSES`), for the `HEAD` most frequent words and the signatures (which
   stand for all other words here); only the bigram matrix of these items, of fixed size, comes to the driver.
2. All other words of the vocabulary at once, each by itself in a task, by its counts of classes before and after, against
   the class bigrams of the time (distributed exchange), at most `ROUNDS` times and as long as the likelihood of all training texts rises.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)), where transitions are interpolated with class frequencies (Witten-Bell). Within a
class, words have their relative frequencies and signatures one count more than theirs; words within a signature are smoothed by
absolute discounting: its unseen words, as many as it has seen words and one, share the mass that the discount frees.
A text's first token follows a begin, which has a class of its own. All counts cover all training texts.

Scoring: counts of all words that occur at least so often that at most `TABLE` words do are sent to the tasks (a fixed
bound); the other words of each document are joined with all counts by hash, so that each count is exact. Words are told
apart by 64-bit hashes.

Cases: null is the empty text (one end token); without training texts N = V = 0 and only the base score's smoothing and
the uniform class model remain; equal rows are scored alike and stay separate rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._spark import crc_mod, staged, table

HEAD, SIGNATURES, CLASSES, PASSES, TABLE = 512, 255, 96, 8, 1 << 20
LEAST, VOCABULARY, ROUNDS = 5, 1 << 20, 1
KEEP = 1 << 19  # distinct words that a counting task holds before it sends them on
U = np.uint64
END, BEGIN = -1, HEAD + SIGNATURES  # the end token's signature; the begin item
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END_HASH = V.mix(np.array([0xE0F], U))[0]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, signature, document) of all tokens in their order; the end token's signature is 0 and its item is by hash."""
    chunk = V.Chunk([t.translate(LOWER) for t in texts])
    w = V.Words(chunk, 3)
    last, before = chunk.buf[w.end - 1].astype(U), chunk.buf[np.maximum(w.end - 2, w.begin)].astype(U)
    long_ = (w.end - w.begin > 6).astype(U)
    signature = (V.mix(last * U(512) + before * U(2) + long_) % U(SIGNATURES)).astype(np.int32)
    ends = w.off[1:]
    n = len(texts)
    return np.insert(w.hash, ends, END_HASH), np.insert(signature, ends, 0), np.insert(w.doc(), ends, np.arange(n))


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = [t or b"" for t in batch.column(column).to_pylist()]
    for a, b in V.spans([len(t) for t in texts]):
        yield a, b, texts[a:b]


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, signature, n): all tokens of a one-column frame of binary texts, added up before they are shuffled."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        k, s, c = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(k, kind="stable")
        k, s, c = k[order], s[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], s[first], np.add.reduceat(c, first)  # the signature belongs to the word

    def flushed(k: np.ndarray, s: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s), pa.array(c)], ["h", "signature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, part in _pieces(batch, 0):
                h, s, _ = tokens(part)
                k, at, c = np.unique(h, return_index=True, return_counts=True)
                parts.append((k, s[at], c.astype(np.int64)))
                held += len(k)
                if held > 2 * KEEP:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > KEEP:
                        yield flushed(*parts[0])
                        parts, held = [], 0
        if parts:
            yield flushed(*merged(parts))

    got = texts.mapInArrow(V.released(run), "h long, signature int, n long")
    return got.groupBy("h").agg(F.first("signature").alias("signature"), F.sum("n").alias("n"))


def item_bigrams(texts: DataFrame, head: np.ndarray) -> np.ndarray:
    """Matrix of counts: row the item before (the last row: the begin), column the item."""
    order = np.argsort(head)
    known, to = head[order], order.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, side = V.SortedHashes(known), BEGIN + 1
        matrix = np.zeros(side * side, np.int64)
        for batch in batches:
            for _, _, part in _pieces(batch, 0):
                h, s, doc = tokens(part)
                item, before = items(lookup, to, h, s, doc)
                matrix += np.bincount(before * side + item, minlength=side * side)
        at = np.flatnonzero(matrix)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(matrix[at])], ["cell", "n"])

    got = texts.mapInArrow(V.released(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((BEGIN + 1) ** 2)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(BEGIN + 1, BEGIN + 1)


def items(lookup: V.SortedHashes, to: np.ndarray, h: np.ndarray, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, item before) of each token."""
    item = HEAD + s.astype(np.int64)
    if lookup.n:
        at, found = lookup.find(h)
        item[found] = to[at[found]]
    before = np.concatenate([[BEGIN], item[:-1]])
    before[np.concatenate([[True], doc[1:] != doc[:-1]])] = BEGIN
    return item, before


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Classes of all items by the exchange algorithm; the begin item has a class of its own, the last."""
    n = len(bigrams) - 1
    count = bigrams.sum(0)[:n]
    order = np.argsort(-count, kind="stable")
    of = np.empty(n + 1, np.int64)
    of[order] = np.arange(n) % classes
    of[n] = classes
    phi = lambda x: x * np.log(np.maximum(x, 1.0))
    table_ = np.zeros((classes + 1, classes + 1))
    np.add.at(table_, (of[:, None], of[None, :]), bigrams)
    every = np.arange(classes)
    for _ in range(passes):
        moved = 0
        for w in order:
            if not count[w]:
                continue
            old, self_ = of[w], bigrams[w, w]
            row, column = np.bincount(of, bigrams[w], classes + 1), np.bincount(of, bigrams[:, w], classes + 1)
            row[old] -= self_
            column[old] -= self_
            table_[old] -= row
            table_[:, old] -= column
            table_[old, old] -= self_
            # Gain of the joint term for each class that could take w, less that of both margins.
            gain = (phi(table_[:classes] + row) - phi(table_[:classes])).sum(1) + (phi(table_[:, :classes] + column[:, None]) - phi(table_[:, :classes])).sum(0)
            d = table_[every, every]
            r, c = row[:classes], column[:classes]
            gain += phi(d + r + c + self_) - phi(d) - (phi(d + r) - phi(d)) - (phi(d + c) - phi(d))
            # Margins hold the other items' bigrams with w, wherever it goes.
            left, right = (table_.sum(1) + column)[:classes], (table_.sum(0) + row)[:classes]
            gain -= phi(left + row.sum() + self_) - phi(left) + phi(right + column.sum() + self_) - phi(right)
            new = int(gain.argmax())
            if gain[old] >= gain[new]:
                new = old
            table_[new] += row
            table_[:, new] += column
            table_[new, new] += self_
            of[w] = new
            moved += new != old
        if not moved:
            break
    return of


class Classes:
    """Words with their counts and classes (-1: by signature), sorted by hash, and the signatures' classes; classes + 1 with the begin."""

    def __init__(self, h: np.ndarray, n: np.ndarray, of: np.ndarray, signs: np.ndarray, begin: int):
        self.h, self.n, self.of = h, np.append(n, 0), np.append(of, -1).astype(np.int16)  # one more than words: absent ones are at 0
        self.signs, self.begin, self.side = signs, begin, begin + 1

    def open(self) -> Classes:
        self.known = V.SortedHashes(self.h)
        return self

    def classes(self, h: np.ndarray, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(class, class before, word, whether it is in the vocabulary, whether it is known) of each token."""
        at, found = self.known.find(h)
        inside = found & (self.of[at] >= 0)
        of = np.where(inside, self.of[at], self.signs[s]).astype(np.int64)
        before = np.concatenate([[self.begin], of[:-1]])
        before[np.concatenate([[True], doc[1:] != doc[:-1]])] = self.begin
        return of, before, at, inside, found


def class_bigrams(texts: DataFrame, shared) -> np.ndarray:
    """Matrix of counts: row the class before, column the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.open()
        matrix = np.zeros(m.side * m.side, np.int64)
        for batch in batches:
            for _, _, part in _pieces(batch, 0):
                of, before, *_ = m.classes(*tokens(part))
                matrix += np.bincount(before * m.side + of, minlength=m.side * m.side)
        at = np.flatnonzero(matrix)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(matrix[at])], ["cell", "n"])

    side = shared.value.side
    got = texts.mapInArrow(V.released(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(side, side)


def contexts(texts: DataFrame, shared, fixed: np.ndarray) -> DataFrame:
    """(w, c, n): how often class c stands before (or, from `side` on, after) word w of the vocabulary, if it isn't one of the fixed ones
    (sorted hashes). Added up before they are shuffled; words lie sorted and whole in partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.open()
        move = (m.of >= 0) & ~np.isin(np.append(m.h, U(0)), fixed)
        keys, counts, held = [], [], 0

        def flush(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((k // (2 * m.side)).astype(np.int32)), pa.array((k % (2 * m.side)).astype(np.int32)), pa.array(n)], ["w", "c", "n"])

        for batch in batches:
            for _, _, part in _pieces(batch, 0):
                h, s, doc = tokens(part)
                of, before, at, inside, _ = m.classes(h, s, doc)
                wanted = np.flatnonzero(inside & move[at])
                after = wanted[wanted + 1 < len(of)]
                after = after[doc[after + 1] == doc[after]]
                k, n = np.unique(np.concatenate([at[wanted] * (2 * m.side) + before[wanted], at[after] * (2 * m.side) + m.side + of[after + 1]]), return_counts=True)
                keys.append(k), counts.append(n)
                held += len(k)
                if held > 2 * KEEP:
                    k, n = V.counted(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k], [n], len(k)
                    if held > KEEP:
                        yield flush(k, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield flush(*V.counted(np.concatenate(keys), np.concatenate(counts)))

    got = texts.mapInArrow(V.released(run), "w int, c int, n long").repartition("w")
    return got.groupBy("w", "c").agg(F.sum("n").alias("n")).sortWithinPartitions("w")


def phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(bigrams: np.ndarray) -> float:
    """The log-likelihood of the class bigrams, but for a term that the classes don't change."""
    return float(phi(bigrams).sum() - phi(bigrams.sum(0)).sum() - phi(bigrams.sum(1)).sum())


def moved(w: np.ndarray, c: np.ndarray, n: np.ndarray, old: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The best class of each word. w: numbers of the words, ascending, for each class c around it and its count n; old: the words' classes."""
    side = len(bigrams)
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    of, n = old[w], n.astype(float)
    after = c >= side
    # For each row, the counts of all classes with the class around the word; those of its own class without it.
    cells = np.where(after[:, None], bigrams[: side - 1, c % side].T, bigrams[c % side, : side - 1])
    cells[np.arange(len(w)), of] -= n
    np.maximum(cells, 0, out=cells)
    gain = np.add.reduceat(phi(cells + n[:, None]) - phi(cells), first, axis=0)
    total = [np.add.reduceat(np.where(x, n, 0.0), first) for x in (after, ~after)]
    for margin, size in zip((bigrams.sum(1), bigrams.sum(0)), total, strict=True):
        margin = np.repeat(margin[None, : side - 1], len(first), axis=0)
        margin[np.arange(len(first)), of[first]] -= size
        np.maximum(margin, 0, out=margin)
        gain -= phi(margin + size[:, None]) - phi(margin)
    stay = gain[np.arange(len(first)), of[first]]
    best = gain.argmax(1)
    return np.where(gain[np.arange(len(first)), best] > stay, best, of[first])


def reassigned(found: DataFrame, shared, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, their new classes). found: what contexts() returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = shared.value.of.astype(np.int64)
        rest = [np.empty(0, np.int64)] * 3

        def emit(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            w = columns[0]
            if not len(w):
                return
            starts = np.append(np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])), len(w))
            # Pieces of whole words: a word has at most 2 * side rows.
            cuts = np.unique(starts[np.searchsorted(starts, np.append(np.arange(0, len(w), 4096), len(w)))])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = [x[a:b] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(part[0]).astype(np.int32)), pa.array(moved(*part, old, bigrams).astype(np.int16))], ["w", "class"])

        for batch in batches:
            rest = [np.concatenate([r, batch.column(k).to_numpy().astype(np.int64)]) for k, r in enumerate(rest)]
            if len(rest[0]):
                whole = int(np.searchsorted(rest[0], rest[0][-1]))  # the last word may go on in the next batch
                yield from emit([r[:whole] for r in rest])
                rest = [r[whole:] for r in rest]
        yield from emit(rest)

    got = found.mapInArrow(V.released(run), "w int, class short").toArrow()
    return got["w"].to_numpy(), got["class"].to_numpy()


def transitions(bigrams: np.ndarray) -> np.ndarray:
    """log10 P(class | class before): Witten-Bell, interpolated with the classes' frequencies."""
    table_ = bigrams[:, :-1]  # nothing is followed by the begin
    share = (table_.sum(0) + 1) / (table_.sum() + len(bigrams) - 1)
    kinds = (table_ > 0).sum(1, keepdims=True)
    total = table_.sum(1, keepdims=True)
    return np.log10(np.where(total > 0, (table_ + kinds * share) / np.maximum(total + kinds, 1), share))


def score(docs: DataFrame, held_out, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The model learns where not held_out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = staged(word_counts(train), "word-counts")
    facts = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos")).first()
    total, kinds = int(facts["n"] or 0), int(facts["v"])
    head = np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(HEAD).collect()], np.int64).view(U)
    # Words sent to the tasks: the vocabulary, and all that occur so often that at most TABLE words do.
    steps = counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).count().orderBy(F.desc("step")).collect()

    def at_most(words: int):
        """The condition of words that occur so often that at most `words` do."""
        have, least = 0, 1 << 30
        for r in steps:
            have += r["count"]
            if have > words:
                break
            least = r["step"]
        return F.floor(F.log2("n") * 4) >= least

    is_head = F.col("h").isin([int(x) for x in head.view(np.int64)])
    vocabulary = is_head | (at_most(VOCABULARY) & (F.col("n") >= LEAST))
    frequent = vocabulary | at_most(TABLE)
    common = counts.where(frequent).select("h", "n", "signature", vocabulary.alias("inside")).toArrow()
    h, n, sign, inside = (common[c].to_numpy() for c in ("h", "n", "signature", "inside"))
    order = np.argsort(h.view(U))
    h, n, sign, inside = h.view(U)[order], n[order], sign[order], inside[order].astype(bool)
    # The vocabulary's classes: the head's from its exchange, the others' first by signature.
    bigrams = item_bigrams(train, head)
    of = exchange(bigrams, classes)
    signs, is_first = of[HEAD : HEAD + SIGNATURES], np.isin(h, head)
    first = np.where(inside, signs[sign], -1)
    first[is_first] = of[np.argsort(head)[np.searchsorted(np.sort(head), h[is_first])]]
    told, got = spark.sparkContext.broadcast(Classes(h, n, first, signs, classes)), np.zeros((classes + 1, classes + 1))
    np.add.at(got, (of[:, None], of[None, :]), bigrams)
    for round_ in range(rounds + 1):
        model, bigrams = told, got
        if round_ == rounds or not (inside & ~is_first).any():
            break
        w, new = reassigned(contexts(train, model, np.sort(head)), model, bigrams)
        of = model.value.of[:-1].copy()
        of[w] = new
        told = spark.sparkContext.broadcast(Classes(h, n, of, signs, classes))
        got = class_bigrams(train, told)
        if likelihood(got) <= likelihood(bigrams):
            break
    of, move = model.value.of[:-1], transitions(bigrams)
    # Emission: words of the vocabulary by their counts, signatures by one more than the counts of the other words they stand for.
    tail = counts.where(~vocabulary)
    per = {r["signature"]: (int(r["n"]), int(r["v"])) for r in tail.groupBy("signature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ones, twos = int(facts["ones"] or 0), int(facts["twos"] or 0)
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    mass = np.array([per.get(i, (0, 0)) for i in range(SIGNATURES)], float)
    size = np.bincount(signs, mass[:, 0] + 1, classes) + np.bincount(of[inside], n[inside], classes)
    emit = np.append(np.where(inside, np.log10(np.maximum(n, 1)) - np.log10(np.maximum(size, 1))[np.maximum(of, 0)], 0), 0)
    emit_sign = np.log10(mass[:, 0] + 1) - np.log10(size[signs])
    shared = spark.sparkContext.broadcast((model.value, move, emit, emit_sign, mass))
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, signature int, n long"

    def within(c: np.ndarray, s: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """log10 P(word | signature)."""
        seen, v = mass[s, 0], mass[s, 1]
        free = np.where(seen > 0, discount * v / np.maximum(seen, 1), 1.0) / (v + 1)
        return np.log10(np.where(c > 0, (c - discount) / np.maximum(seen, 1), free))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, move, emit, emit_sign, mass = shared.value
        m.open()
        for batch in batches:
            for a, b, part in _pieces(batch, 3):
                n = b - a
                h, s, doc = tokens(part)
                of, before, at, inside, found = m.classes(h, s, doc)
                logs = move[before, of] + np.where(inside, emit[at], emit_sign[s])
                c = np.where(found, m.n[at], 0)
                base = np.where(found, np.log10((c + 1) / (total + kinds + 1)), 0)
                word = found & ~inside
                logs[word] += within(c[word], s[word], mass)
                sums = [np.bincount(doc, x, n) for x in (base, logs)]
                rid, own = batch.column(0).slice(a, n), (batch.column(k).slice(a, n) for k in (1, 2))
                key = V.mix(np.asarray(rid).astype(U)).view(np.int64)
                none = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([rid, *own, pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, found, n).astype(np.int64)), *map(pa.array, sums), pa.array(key), none, pa.array(np.zeros(n, np.int64))], [x.split()[0] for x in schema.split(", ")])
                # Each document's other words, once each with their number there.
                rest = np.flatnonzero(~found)
                rest = rest[np.lexsort((h[rest], doc[rest]))]
                if len(rest):
                    first = np.flatnonzero(np.concatenate([[True], (h[rest[1:]] != h[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])]))
                    times, rest, k = np.diff(np.append(first, len(rest))), rest[first], len(first)
                    nulls = [pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(doc[rest])), *nulls, pa.array(h[rest].view(np.int64)), pa.array(s[rest]), pa.array(times)], [x.split()[0] for x in schema.split(", ")])

    parts = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(V.released(run), schema)
    rare = counts.where(~frequent).select(F.col("h").alias("key"), F.col("n").alias("c"))
    joined = parts.join(rare, parts["h"] == rare["key"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    by_signature = F.array(*[F.struct(F.lit(float(x)).alias("seen"), F.lit(float(y)).alias("v")) for x, y in mass])
    sig = F.get(by_signature, F.col("signature"))
    free = F.when(sig["seen"] > 0, discount * sig["v"] / F.greatest(sig["seen"], F.lit(1.0))).otherwise(1.0) / (sig["v"] + 1)
    word = F.log10(F.when(F.col("c") > 0, (F.col("c") - discount) / F.greatest(sig["seen"], F.lit(1.0))).otherwise(free))
    word_base = F.log10((F.col("c") + 1) / F.lit(float(total + kinds + 1)))
    is_word = F.col("signature").isNotNull()
    sums = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_word, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(is_word, F.col("n") * word_base).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(is_word, F.col("n") * word).otherwise(F.col("score"))).alias("score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
