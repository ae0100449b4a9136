"""Vectorised text kernels shared by the operators: words, rolling hashes, shingles, sketches.

Everything works on a *chunk*: a list of byte strings (one per document) that is laid out in one
buffer, each document followed by a line feed. Chunks are bounded in bytes and documents
(:func:`spans`), so that the memory of a task doesn't depend on its partition's size.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES, CHUNK_DOCS = 1 << 19, 2000
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Gives memory that the allocators keep back to the system: workers outlive their tasks, and other stages' would add up."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(kernel):
    """A kernel over record batches that gives memory back when its task ends."""

    @functools.wraps(kernel)
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection whose bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + mix(np.array([seed], U)))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, (n - 1).bit_length())
        got = np.empty(size, U)
        got[0] = 1
        have = 1
        while have < size:
            got[have : 2 * have] = got[:have] * U(pow(base, have, 1 << 64))
            have *= 2
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = got
    return got[:n]


def spans(sizes, max_bytes: int = CHUNK_BYTES, max_docs: int = CHUNK_DOCS):
    """Consecutive (begin, end) ranges of documents: at most max_docs, and max_bytes unless one alone has more."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > max_bytes or i - begin >= max_docs):
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


class Chunk:
    """buf: all bytes; at[d]..at[d+1]-1: document d's bytes (the byte before at[d+1] is the line feed)."""

    def __init__(self, parts: list[bytes]):
        self.n = len(parts)
        self.buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.at = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, self.n), out=self.at[1:])

    def prefix(self, seed: int = 0, base: int = BASE) -> np.ndarray:
        """Prefix sums of byte * base**position, one longer than the buffer."""
        table = mix(np.arange(256, dtype=U) + mix(np.array([seed + 1], U)))
        out = np.zeros(len(self.buf) + 1, U)
        np.cumsum(table[self.buf] * powers(base, len(self.buf)), out=out[1:])
        return out


def substring_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of buf[begin:end], the same wherever these bytes stand."""
    inverse = powers(pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(U))


class Words:
    """Words (maximal runs of bytes that are no ASCII white space) of a chunk. off[d]..off[d+1]: document d's words."""

    def __init__(self, chunk: Chunk, seed: int = 0):
        inside = ~SEPARATOR[chunk.buf]
        edge = np.empty(len(inside), bool)
        edge[0] = inside[0]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        edges = np.flatnonzero(edge)
        self.begin, self.end = edges[0::2], edges[1::2]
        self.off = np.searchsorted(self.begin, chunk.at)
        self.count = np.diff(self.off)
        self.hash = substring_hash(chunk.prefix(seed), self.begin, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of `width` words; a shorter text that has a word is one shingle by itself."""
    h, n = words.hash, len(words.hash)
    doc = words.doc()
    if n >= width:
        total = np.zeros(n - width + 1, U)
        for k in range(width):
            total = total * U(BASE) + h[k : n - width + 1 + k]
        whole = doc[: n - width + 1] == doc[width - 1 :]
        got, at = mix(total[whole]), doc[: n - width + 1][whole]
    else:
        got, at = np.empty(0, U), np.empty(0, np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        extra = np.zeros(len(short), U)
        for i, d in enumerate(short):
            value = 0
            for x in h[words.off[d] : words.off[d + 1]]:
                value = (value * BASE + int(x)) % (1 << 64)
            extra[i] = (value + int(words.count[d])) % (1 << 64)
        got, at = np.concatenate([got, mix(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        got, at = got[order], at[order]
    return got, at


class OnePermutation:
    """One-permutation minimum hashes with optimal densification.

    Each shingle is hashed once; its high bits choose one of k bins, which keeps its least value. An
    empty bin takes the value of the first non-empty bin in its own pseudo-random order of bins: `ROUNDS`
    hashed probes, then (for sparse rows) a fixed random ranking, so that any two sets with the same
    non-empty bins choose the same donors.
    """

    ROUNDS, EMPTY = 8, np.uint32(0xFFFFFFFF)

    def __init__(self, bins: int, seed: int = 0):
        if bins & (bins - 1):
            raise ValueError("bins must be a power of two")
        self.k, self.shift = bins, U(64 - bins.bit_length() + 1)
        self.probe = (seeds(self.ROUNDS * bins, seed + 11) % U(bins)).astype(np.int64).reshape(self.ROUNDS, bins)
        self.rank = np.argsort(np.argsort(seeds(bins * bins, seed + 12).reshape(bins, bins), axis=1), axis=1).astype(np.uint16)

    def values(self, shingle: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """n x k values; the rows of documents without a shingle are EMPTY throughout."""
        flat = np.full(n * self.k, self.EMPTY, np.uint32)
        low = np.minimum((shingle & U(0xFFFFFFFF)).astype(np.uint32), self.EMPTY - np.uint32(1))
        np.minimum.at(flat, doc * self.k + (shingle >> self.shift).astype(np.int64), low)
        got = flat.reshape(n, self.k)
        full = got != self.EMPTY
        todo = np.flatnonzero(full.any(1) & ~full.all(1))
        if len(todo):
            base, known = got[todo], full[todo]
            out, filled = base.copy(), known.copy()
            for t in range(self.ROUNDS):
                give = ~filled & known[:, self.probe[t]]
                out[give] = base[:, self.probe[t]][give]
                filled |= give
            for r in np.flatnonzero(~filled.all(1)):
                have, lack = np.flatnonzero(known[r]), np.flatnonzero(~filled[r])
                out[r, lack] = base[r, have[np.argmin(self.rank[lack][:, have], axis=1)]]
            got[todo] = out
        return got


class SortedHashes:
    """Look-up in a sorted array of hashes through a directory of their high bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, min(24, int(len(keys)).bit_length()))
        self.n, self.shift = len(keys), U(64 - bits)
        self.keys = np.append(keys, U(0xFFFFFFFFFFFFFFFF))
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=U) << self.shift)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, found): the position is 0 where the key is absent."""
        at = self.first[(x >> self.shift).astype(np.int64)]
        less = np.flatnonzero(self.keys[at] < x)
        while len(less):
            at[less] += 1
            less = less[self.keys[at[less]] < x[less]]
        found = (self.keys[at] == x) & (at < self.n)
        at[~found] = 0
        return at, found


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)
