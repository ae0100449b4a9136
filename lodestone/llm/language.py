"""Operator 2: language identification by interpolated Kneser-Ney character models.

Training: of every language at most `TRAIN_ROWS` labelled rows (those with the least hash of their id; a
documented bound for fitting the classifier) go to the driver, where one model per language is fitted on four
fifths of them. Texts are lower-cased, runs of anything but letters become one blank. Models have the orders 1 to
`ORDER`; the highest uses counts, the lower ones continuation counts, all with absolute discounting and
interpolation down to a uniform distribution. All probabilities are stored in sorted arrays of n-gram hashes.

Prediction: every character of the whole text is scored by every model. The language with the lowest
cross-entropy per character wins (ties: the first by code point). score is the winner's posterior among the languages times the
probability that the text is of any of them, both calibrated on the remaining fifth of the sample:

* The posterior is a softmax of the entropies; its temperature and the length at which a text's length begins to saturate are the
  likeliest ones on whole texts and pieces of 8 to 128 characters, for Platt's targets (short of 1 by what so few rows can't tell).
* A logistic function of the winner's excess (nats per character over its language's mean, times sqrt(n / (n + k)) for
  n characters) tells those texts and pieces from foreign ones: the same
  under the models of all other languages, with their characters shuffled, and random letters. Foreign texts are taken to be
  `FOREIGN` of all. A text is rejected where that probability is below a half, so that a rejected text's score is below
  a half too; or if it has no letter or is null (prediction 'und', score 0).

Cases: rows without a language aren't trained on but predicted; if nothing can be learned, all predictions are
'und'. Rows without a doc_id aren't trained on. Equal texts get equal predictions. An empty table gives no rows.
"""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _vec as V
from ._spark import crc_mod, fresh, table

ORDER, TRAIN_ROWS, FOREIGN, FOLDS = 4, 400, 0.05, 5
#: Shares of a language in which rows are ranked before the best of all shares are.
SALTS = 16
U = np.uint64
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter (Unicode category L*)."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts: letters in lower case, one blank for each other run, ORDER-1 blanks before and one after each text; the document of each)."""
    flat = np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    size = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), size)
    good = letters()[flat]
    last = np.zeros(len(flat), bool)
    last[np.cumsum(size) - 1] = True
    before = np.concatenate([[False], good[:-1]])
    keep = good | before | last
    codes, doc, last = np.where(good, flat, 32)[keep].astype(U), doc[keep], last[keep]
    codes = codes + U(1)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return np.insert(codes, np.repeat(first, ORDER - 1), U(33)), np.insert(doc, np.repeat(first, ORDER - 1), np.repeat(doc[first], ORDER - 1))


def grams(codes: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(for n = 0..ORDER the hashes of the n-grams that end at each scored position, where index 0 is of the empty one; the scored positions)."""
    at = np.flatnonzero(np.concatenate([np.zeros(min(len(doc), ORDER - 1), bool), doc[ORDER - 1 :] == doc[: -(ORDER - 1)]])) if len(doc) >= ORDER else np.empty(0, np.int64)
    out, value, power = [np.zeros(len(at), U)], np.zeros(len(at), U), 1
    for n in range(ORDER):
        value = value + codes[at - n] * U(power)
        power = power * V.BASE % (1 << 64)
        out.append(V.mix(value + U(n + 1)))
    return out, at


def contexts(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER the hash of the n-1 characters before each position (index n-1)."""
    out, value, power = [np.zeros(len(at), U)], np.zeros(len(at), U), 1
    for n in range(ORDER - 1):
        value = value + codes[at - 1 - n] * U(power)
        power = power * V.BASE % (1 << 64)
        out.append(V.mix(value + U(n + 1)))
    return out


class KneserNey:
    """One language's model: for each order sorted hashes with probabilities, and of contexts with weights of the lower order."""

    def __init__(self, texts: list[str], alphabet: int):
        codes, doc = normalised(texts)
        gram, at = grams(codes, doc)
        context = contexts(codes, at)
        self.gram, self.weight = [], []
        # Types of each order, with one place where each occurs; lower orders count the types one character longer.
        types = [np.unique(gram[n], return_index=True) for n in range(ORDER + 1)]
        lower = np.full(1, 1.0 / alphabet)
        lower_keys = V.SortedHashes(np.zeros(1, U))
        for n in range(1, ORDER + 1):
            keys, place = types[n]
            if n == ORDER:
                count = np.bincount(np.searchsorted(keys, gram[n]), minlength=len(keys)).astype(float)
            else:
                longer = types[n + 1][1]
                count = np.bincount(np.searchsorted(keys, gram[n][longer]), minlength=len(keys)).astype(float)
            count = np.maximum(count, 1.0)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2.0 * twos) if ones else 0.5
            parent = context[n - 1][place]
            ckeys, of = np.unique(parent, return_inverse=True)
            total, kinds = np.bincount(of, count), np.bincount(of)
            weight = discount * kinds / total
            pos, found = lower_keys.find(gram[n - 1][place])
            assert found.all()
            prob = np.maximum(count - discount, 0) / total[of] + weight[of] * lower[pos]
            self.gram.append((V.SortedHashes(keys), np.log(prob)))
            self.weight.append((V.SortedHashes(ckeys), np.log(np.maximum(weight, 1e-300))))
            lower, lower_keys = prob, V.SortedHashes(keys)
        self.floor = -np.log(alphabet)

    def score(self, gram: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
        """Log probability of each position's character after its context."""
        out, rest = np.zeros(len(gram[0])), np.arange(len(gram[0]))
        for n in range(ORDER, 0, -1):
            keys, prob = self.gram[n - 1]
            at, found = keys.find(gram[n][rest])
            out[rest[found]] += prob[at[found]]
            rest = rest[~found]
            if not len(rest):
                return out
            keys, weight = self.weight[n - 1]
            at, found = keys.find(context[n - 1][rest])
            out[rest[found]] += weight[at[found]]
        out[rest] += self.floor
        return out


class Identifier:
    """All languages' models. The highest-order n-grams of any of them share one sorted array with a column per language."""

    def __init__(self, samples: dict[str, list[str]]):
        samples = {k: [t for t in v if any(map(str.isalpha, t))] for k, v in samples.items()}
        self.langs = sorted(k for k, v in samples.items() if v)
        if not self.langs:
            return
        held = {k: v[:: FOLDS] if len(v) >= FOLDS else v for k, v in samples.items()}
        fit = {k: [t for i, t in enumerate(v) if i % FOLDS] if len(v) >= FOLDS else v for k, v in samples.items()}
        alphabet = len(set().union(*(set(t.lower()) for k in self.langs for t in samples[k]))) + 1
        self.models = [KneserNey(fit[k], alphabet) for k in self.langs]
        # The types of all languages, language by language: each with the n-grams and contexts of one of its places.
        parts = []
        for k in self.langs:
            codes, doc = normalised(fit[k])
            gram, at = grams(codes, doc)
            _, place = np.unique(gram[ORDER], return_index=True)
            parts.append([x[place] for x in gram + contexts(codes, at)])
        every = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keys, place = np.unique(every[ORDER], return_index=True)
        every = [x[place] for x in every]
        gram, context = every[: ORDER + 1], every[ORDER + 1 :]
        self.table = V.SortedHashes(keys)
        self.columns = np.stack([m.score(gram, context) for m in self.models], axis=1).astype(np.float32)
        self.calibrate(held)

    def calibrate(self, held: dict[str, list[str]]) -> None:
        """The temperature and the logistic function of the excess, from texts that were kept apart."""
        entropy, size, truth = [], [], []
        for i, k in enumerate(self.langs):
            h, n = self.entropies(held[k])
            entropy.append(h), size.append(n), truth.append(np.full(len(n), i))
        self.mean = np.array([np.average(h[:, i], weights=n) for i, (h, n) in enumerate(zip(entropy, size, strict=True))])
        h, n, y = np.concatenate(entropy), np.concatenate(size), np.concatenate(truth)
        rng = random.Random(17)
        whole = [t for k in self.langs for t in held[k]]
        pieces = [t[(a := rng.randrange(max(1, len(t) - width + 1))) : a + width] for t in whole for width in (8, 16, 32, 64, 128)]
        keep = [j for j, t in enumerate(pieces) if any(map(str.isalpha, t))]
        pieces, owner = [pieces[j] for j in keep], np.array([y[j // 5] for j in keep], np.int64)
        every = sorted({c for t in whole for c in t.lower() if c.isalpha()})
        junk = ["".join(rng.sample(t, len(t))) for t in whole + pieces] + ["".join(rng.choices(every, k=min(len(t), 400))) for t in whole + pieces]
        hp, m = self.entropies(pieces)
        h, n, y = np.concatenate([h, hp]), np.concatenate([n, m]), np.concatenate([y, owner])
        # The likeliest temperature and bound of the length that counts, for Platt's targets.
        sure = (np.bincount(y)[y] + 1) / (np.bincount(y)[y] + 2)

        def loss(scale: tuple[float, float]) -> float:
            self.temperature, self.reach = scale
            z = np.log(self.posteriors(h, n))
            right = z[np.arange(len(y)), y]
            return -float(np.mean(sure * right + (1 - sure) * (z.sum(1) - right) / max(1, len(self.langs) - 1)))

        self.temperature, self.reach = min(((2.0 ** (k / 2), r) for k in range(-10, 7) for r in (4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0)), key=loss)
        own, foreign = [self.excess(h, n)], [self.excess(*self.entropies(junk))]
        if len(self.langs) > 1:
            other = h.copy()
            other[np.arange(len(y)), y] = np.inf
            foreign.append(self.excess(other, n))
        x, n = (np.concatenate([g[i] for g in own + foreign]) for i in (0, 1))
        good = np.arange(len(x)) < len(own[0][0])
        # Whole texts and pieces, which each list above holds in this order, weigh the same.
        entire, weight = np.arange(len(x)) % good.sum() < len(whole), np.empty(len(x))
        for kind, share in ((good, 1 - FOREIGN), (~good, FOREIGN)):
            for part in (kind & entire, kind & ~entire):
                weight[part] = share / 2 / max(1, part.sum())
        self.short, self.logit = 0, np.zeros(2)
        best = np.inf
        for k in (0, 8, 16, 32, 64, 128):
            found, cost = logistic(x * np.sqrt(n / np.maximum(n + k, 1)), good, weight)
            if cost < best:
                best, self.short, self.logit = cost, k, found

    def posteriors(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """documents x languages: softmax of the negative cross-entropies, times the temperature and the length, which saturates."""
        z = -h * (self.temperature * n / (1 + n / self.reach))[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return np.maximum(z / z.sum(1, keepdims=True), 1e-300)

    def excess(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = h.argmin(1)
        return h[np.arange(len(best)), best] - self.mean[best], n

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages nats per character, characters). The whole texts are scored, in lots of bounded size."""
        lots = [self._entropies(texts[a:b]) for a, b in V.spans([len(t) for t in texts], 1 << 18)]
        return tuple(map(np.concatenate, zip(*lots, strict=True))) if lots else (np.zeros((0, len(self.langs))), np.zeros(0, np.int64))

    def _entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, doc = normalised(texts)
        gram, at = grams(codes, doc)
        pos, found = self.table.find(gram[ORDER])
        logs = self.columns[pos]
        rest = np.flatnonzero(~found)
        if len(rest):
            some, context = [g[rest] for g in gram], [c for c in contexts(codes, at[rest])]
            for i, m in enumerate(self.models):
                logs[rest, i] = m.score(some, context)
        n = np.bincount(doc[at], minlength=len(texts))
        begin = np.searchsorted(doc[at], np.arange(len(texts)))
        sums = np.add.reduceat(np.vstack([logs, np.zeros((1, len(self.langs)), np.float32)]).astype(np.float64), begin, axis=0)
        sums[n == 0] = 0
        return -sums / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected)."""
        h, n = self.entropies(texts)
        best = h.argmin(1)
        posterior = self.posteriors(h, n).max(1)
        low = h[np.arange(len(best)), best]
        z = self.logit[0] + self.logit[1] * (low - self.mean[best]) * np.sqrt(n / np.maximum(n + self.short, 1))
        accepted = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return [self.langs[i] for i in best], posterior * accepted, low, accepted < 0.5


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """(intercept and a slope of at most 0, cost) of the weighted logistic regression of y on x, by Newton's method with halved steps."""
    features = np.stack([np.ones(len(x)), x], axis=1)
    sign = np.where(y, 1.0, -1.0)

    def cost(b: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, -sign * (features @ b)) + ridge * b @ b / 2)

    b = np.array([0.0, -1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ b, -700, 700)))
        gradient = features.T @ (weight * (p - y)) + ridge * b
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(2)
        step, rate = np.linalg.solve(hessian, gradient), 1.0
        while rate > 1e-6 and cost(b - rate * step) > cost(b):
            rate /= 2
        if rate * np.abs(step).max() < 1e-9:
            break
        b = b - rate * step
    if b[1] > 0:  # foreign texts aren't less likely: the excess tells nothing
        b = np.array([np.log((weight @ y + 1e-9) / (weight @ ~y + 1e-9)), 0.0])
    return b, cost(b)


def fitted(docs: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> Identifier:
    """Fits on at most `rows` rows per language among those where `train` holds, chosen by hash of the id: whole texts.

    Rows are ranked within `SALTS` shares of each language first, so that no task meets more than SALTS * rows of one language
    at the end, however common it is. Rows equal in id, language and text are taken once.
    """
    h, doc_hash = F.xxhash64("doc_id"), F.xxhash64("text")
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", h.alias("h"), doc_hash.alias("t"))
    known = known.withColumn("salt", F.pmod(F.xxhash64("h", "t"), F.lit(SALTS)))
    best = known
    for keys in (("lang", "salt"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id", "t"))
        best = best.withColumn("r", rank).where(F.col("r") <= rows).drop("r")
    chosen = best.select("doc_id", "lang", "t").distinct()
    got = docs.where(train).select("doc_id", "lang", "text", doc_hash.alias("t")).join(F.broadcast(chosen), ["doc_id", "lang", "t"], "left_semi")
    samples: dict[str, list[str]] = {}
    for r in sorted(got.groupBy("doc_id", "lang", "t").agg(F.first("text").alias("text")).collect(), key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Identifier(samples)


def predicted(spark: SparkSession, model: Identifier):
    """A column function: struct(lang, score, cross_entropy, rejected) of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, cross_entropy double, rejected boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = pd.DataFrame({"lang": "und", "score": 0.0, "cross_entropy": np.nan, "rejected": True}, index=range(len(batch)))
            texts = batch.tolist()
            have = [i for i, t in enumerate(texts) if t and model.langs and any(map(str.isalpha, t))]
            lang, columns = np.array(["und"] * len(texts), object), [np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)]
            for a, b in V.spans([len(texts[i]) for i in have], 1 << 18):
                got, *rest = model.predict([texts[i] for i in have[a:b]])
                lang[have[a:b]] = got
                for column, values in zip(columns, rest, strict=True):
                    column[have[a:b]] = values
            V.release()
            out["lang"], out["score"], out["cross_entropy"], out["rejected"] = lang, *columns
            yield out

    return identify


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    identify = predicted(spark, fitted(docs, ~held_out))
    got = docs.select("doc_id", held_out.alias("held_out"), identify("text").alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.cross_entropy").alias("cross_entropy"), F.col("p.rejected").alias("rejected"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the identifier doesn't reject, with the columns they have."""
    identify = predicted(docs.sparkSession, fitted(docs, F.lit(True)))
    (name,) = fresh(docs, "prediction")
    return docs.withColumn(name, identify("text")).where(~F.col(f"{name}.rejected")).drop(name)
