"""Operator 7: packing documents into sequences by first-fit decreasing.

Documents are dealt at random (by hash of doc_id, text and place in the table, so that equal rows part) and each task cuts what
it gets into groups of at most `GROUP_BYTES` of text, or `GROUP_ROWS` documents; a document alone may be longer. In each group
every document is tokenised and the id `END` is added; full pieces of `SIZE` ids make sequences of their own, and what is left of
each document is packed by first-fit decreasing: a tournament tree over the bins' free room finds the first bin that fits in
logarithmic time. The result isn't first-fit decreasing's in the end: as documents may be cut freely, the emptiest bins are then
dissolved and their pieces (cut where needed) fill the room left in the others, so that a group wastes less than about one sequence.

Token ids are those of the tokenizer file (byte-level BPE; special tokens' strings become special ids, as the tokenizers
library does by default). Texts are split into pre-tokens with numpy, each distinct pre-token is encoded once and its ids
are looked up; texts with a code point that Unicode has added or moved to another class since its version 3.2 (where libraries may differ), or
with a special token's string, go through the tokenizers library itself. The ids are the same either way (tests compare them).

Cases: null is the empty text (the end id alone); equal rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._spark import table

SIZE, END, GROUP_ROWS, GROUP_BYTES = 2048, 1, 2000, 1 << 22
CACHE = 1 << 18  # distinct pre-tokens that a worker remembers
U = np.uint64
_encoders: dict[str, Encoder] = {}  # noqa: F821  one per Python worker and file


def byte_of() -> dict[str, int]:
    """The byte for each character by which byte-level vocabularies write it: printable Latin-1 as it is, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        to_byte = byte_of()
        vocabulary = spec["model"]["vocab"]
        ranks = {bytes(to_byte[c] for c in k): v for k, v in vocabulary.items() if k not in self.special}
        # The fast way merges by rank in the vocabulary; that is the file's order of merges only if the merged tokens' ids ascend.
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.ranked = all(a < b for a, b in zip(merged, merged[1:]))
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.kind = self.kinds()
        self.forget()

    @functools.cached_property
    def slow(self):
        """The tokenizers library's own tokenizer: loaded where a text needs it, as it takes tens of MB in each worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def kinds(self) -> np.ndarray:
        """The kind of each code point, -1 where it may depend on the version of Unicode; last the edge between texts."""
        kinds, old, out = {"L": self.LETTER, "N": self.NUMBER}, unicodedata.ucd_3_2_0, np.empty(0x110001, np.int8)
        for i in range(0x110000):
            c, was = unicodedata.category(chr(i)), old.category(chr(i))
            out[i] = self.SPACE if chr(i).isspace() and not 0x1C <= i <= 0x1F else kinds.get(c[0], self.OTHER) if c[0] == was[0] != "C" or i < 256 else -1
        out[0x110000] = self.EDGE
        return out

    def forget(self) -> None:
        self.known, self.at, self.length, self.ids = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        fast = []
        for i, t in enumerate(texts):
            if self.ranked and (t.isascii() or (self.kind[np.frombuffer(t.encode("utf-32-le"), np.uint32)] >= 0).all()) and not any(s in t for s in self.special):
                fast.append(i)
            else:
                out[i] = np.array(self.slow.encode(t, add_special_tokens=False).ids, np.uint32)
        for a, b in V.spans([len(texts[i]) for i in fast], 1 << 18):
            for i, ids in zip(fast[a:b], self._fast([texts[i] for i in fast[a:b]]), strict=True):
                out[i] = ids
        return out

    def _starts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a pre-token (or an edge between texts) starts at each code point.

        As the byte-level pattern splits: runs of letters, of numbers and of other characters, each with one blank before
        it; white space otherwise, where the last one before another character stands alone or is that blank;
        and the English contractions, at an apostrophe that is a run by itself and has no blank before it.
        """
        kind = self.kind[codes]
        before = np.concatenate([[self.EDGE], kind[:-1]])
        after = np.concatenate([kind[1:], [self.EDGE]])
        change = kind != before
        space = kind == self.SPACE
        blank_before = np.concatenate([[False], codes[:-1] == 32])
        start = np.where(space, change | ((after != self.SPACE) & (after != self.EDGE)), change & ~blank_before) | (kind == self.EDGE)
        for i in np.flatnonzero(start & (codes == 39) & (after == self.LETTER) & change).tolist():
            two = bytes(min(c, 255) for c in codes[i + 1 : i + 3].tolist())
            size = 1 if two[:1] in (b"s", b"t", b"m", b"d") else 2 if two in (b"re", b"ve", b"ll") else 0
            if size:
                start[i + 1] = False
                start[i + 1 + size] |= kind[i + 1 + size] == self.LETTER
        return start

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[ends] = 0x110000
        start = np.flatnonzero(self._starts(codes))
        end = np.append(start[1:], len(codes))
        prefix = np.zeros(len(codes) + 1, U)
        np.cumsum(V.mix(codes.astype(U)) * V.powers(V.BASE, len(codes)), out=prefix[1:])
        h = V.substring_hash(prefix, start, end)
        distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            single, edge = self.bpe.encode_ordinary, codes == 0x110000
            got = [[] if edge[a] else single(joined[a:b]) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            at = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.fromiter((x for g in got for x in g), np.uint32, int(sizes.sum()))])
            order = np.argsort(known := np.concatenate([self.known, distinct[new]]), kind="stable")
            self.known, self.at, self.length = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.length, sizes])[order]
            place = np.searchsorted(self.known, distinct)
        at, length = self.at[place][of], self.length[place][of]
        stop = np.cumsum(length)
        flat = self.ids[np.repeat(at - (stop - length), length) + np.arange(stop[-1])]
        cut = stop[np.searchsorted(start, ends)]
        if len(self.known) > CACHE:
            self.forget()
        return np.split(flat, cut[:-1])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def first_fit_decreasing(sizes: list[int], room: int = SIZE) -> list[list[int]]:
    """Bins of indices, none over `room`: pieces by falling size (the earlier first on ties), each into the first bin it fits.

    tree[1] is the root of a tournament over the bins' free room, in which each node has the greater of its two;
    the first bin that fits is found by going left where the left winner is large enough.
    """
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(i)
        tree[node] -= need
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins


def pack(lengths: list[int], room: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); every document is cut into pieces without gap or overlap."""
    out: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        full = n - n % room
        out += [[(d, s, room)] for s in range(0, full, room)]
        if n > full:
            rest.append((d, full, n - full))
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([p[2] for p in rest], room)]
    free = sorted((room - sum(p[2] for p in b), k) for k, b in enumerate(bins))
    # Dissolve as many of the emptiest bins as the others have room for.
    total, keep = sum(f for f, _ in free), len(free)
    while keep and total - free[keep - 1][0] >= room - free[keep - 1][0]:
        total -= room  # its own room goes and its pieces take as much as they need
        keep -= 1
    pool = [p for _, k in free[keep:] for p in bins[k]]
    pool.sort(key=lambda p: p[2])
    for gap, k in reversed(free[:keep]):
        while gap and pool:
            d, s, n = pool.pop()
            take = min(gap, n)
            bins[k].append((d, s, take))
            gap -= take
            if n > take:
                pool.append((d, s + take, n - take))
    assert not pool
    return out + [bins[k] for _, k in free[:keep]]


def packed(docs: DataFrame, path: str | None = None, room: int = SIZE, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. sequence_id: the task's number and, from bit 32 down, the sequence's."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def emit(names: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal number
            ids = [np.append(x, np.uint32(END)).astype("<u4") for x in encoder(path).encode(texts)]
            rows = [[] for _ in range(7)]
            for sequence in pack([len(x) for x in ids], room):
                offset = 0
                for d, s, n in sequence:
                    for column, value in zip(rows, (names[d], s, n, zlib.crc32(ids[d][s : s + n].tobytes()), len(ids[d]), number, offset), strict=True):
                        column.append(value)
                    offset += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], [x.split()[0] for x in schema.split(", ")])

        names, texts, size = [], [], 0
        for batch in batches:
            for name, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                text = text or ""
                if texts and (size + len(text) > group_bytes or len(texts) == group_rows):
                    yield emit(names, texts)
                    names, texts, size = [], [], 0
                names.append(name)
                texts.append(text)
                size += len(text)
        if texts:
            yield emit(names, texts)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("deal", F.xxhash64("doc_id", "text", "row"))
    return rows.repartition("deal").sortWithinPartitions("deal", "row").mapInArrow(V.released(run), schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
