"""Operators 1 to 7 against brute force, on the edge cases and on the sample tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import classlm, fingerprint, language, linededup, mixing, packing, quality

from .cases import edge, edge_rows, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_follow_the_true_similarity(spark, sf):
    got = rows(fingerprint.op1_fingerprints(spark, sf))
    docs = sorted(rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")), key=lambda r: r["doc_id"])
    text = {r["doc_id"]: r["text"] for r in docs}
    after = {r["doc_id"]: docs[(i + 1) % len(docs)]["text"] for i, r in enumerate(docs)}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    errors, prints = [], defaultdict(set)
    for r in got:
        t, n = text[r["doc_id"]], after[r["doc_id"]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(shingle_set(t), shingle_set(edited)), r["near_next"] - jaccard(shingle_set(t), shingle_set(n))]
        prints[t].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean(np.abs(errors)) < 0.03 and np.max(np.abs(errors)) < 0.25


def test_fingerprints_across_buckets_and_edges(spark, monkeypatch):
    one = sorted(map(str, rows(fingerprint.compare_with_next(edge(spark)))))
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    assert sorted(map(str, rows(fingerprint.compare_with_next(edge(spark))))) == one
    monkeypatch.setattr(fingerprint, "MOST_RANGES", 2)
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 2)
    assert sorted(map(str, rows(fingerprint.compare_with_next(edge(spark))))) == one
    without = edge(spark).where("doc_id is not null")
    got = sorted(map(str, rows(fingerprint.compare_with_next(without))))
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 1000)
    assert got == sorted(map(str, rows(fingerprint.compare_with_next(without))))
    assert len(one) == len(edge_rows())
    assert not rows(fingerprint.compare_with_next(empty(spark)))


def test_densification_fills_all_bins_alike():
    from lodestone.llm import _vec as V

    hasher = V.OnePermutation(64)
    few = V.mix(np.arange(1, 4, dtype=np.uint64))
    got = hasher.values(np.concatenate([few, few]), np.array([0, 0, 0, 1, 1, 1]), 3)
    assert (got[0] == got[1]).all() and (got[0] != hasher.EMPTY).all() and (got[2] == hasher.EMPTY).all()


def test_language(spark, sf):
    got = rows(language.op2_language(spark, sf))
    docs = {r["doc_id"]: r for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and len(docs[r["doc_id"]]["text"]) > 40]
    assert np.mean([docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_sample_is_the_least_by_hash_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "Identifier", lambda samples: samples)
    monkeypatch.setattr(language, "SALTS", 4)
    data = [(i, "xy"[i % 3 == 0], f"text {i}") for i in range(300)] + [(None, "x", "no id"), (1, None, "no lang"), (2, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string")
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = {k: {t for _, t in sorted((hashes[i], t) for i, lang, t in data if i is not None and lang == k and t)[:20]} for k in "xy"}
    got = language.fitted(docs, F.lit(True), 20)
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == 20 for v in got.values())
    copies = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("lang"), F.lit("one text").alias("text"))
    assert language.fitted(copies, F.lit(True), 20) == {"x": ["one text"]}


def test_kneser_ney_sums_to_one():
    m = language.KneserNey(["abab abba", "baab"], 6)
    context = "ab"
    total = 0.0
    for c in "ab ":
        codes = np.array([33] * 3 + [ord(x) + 1 if x != " " else 33 for x in context + c], np.uint64)
        gram, at = language.grams(codes, np.zeros(len(codes), np.int64))
        total += math.exp(m.score([g[-1:] for g in gram], [x[-1:] for x in language.contexts(codes, at)])[0])
    assert 0.9 < total <= 1 + 1e-9


def test_language_edges(spark):
    model = language.fitted(edge(spark), F.lit(True))
    identify = language.predicted(spark, model)
    got = edge(spark).select("text", identify("text").alias("p")).collect()
    assert {r["p"]["lang"] for r in got if not r["text"] or not any(map(str.isalpha, r["text"]))} == {"und"}
    assert all(r["p"]["lang"] != "und" for r in got if r["text"] and any(map(str.isalpha, r["text"])))
    kept = language.accepted(edge(spark))
    assert kept.columns == edge(spark).columns and not kept.where("text is null").count()
    assert not language.accepted(empty(spark)).count()


def line_dedup_model(docs):
    """Brute force: docs is a list of (id, text), by id."""
    seen, out = set(), {}
    for i, text in docs:
        lines = [] if text is None else text.split("\n")
        units = [x.strip(" \t\n\v\f\r") for x in lines if WORD.search(x)]
        gone = set()
        for k, u in enumerate(units):
            for run in ((tuple(units[k : k + 2]), 2), ((u,), 1)):
                if len(run[0]) < run[1] or run[1] == 1 and len(WORD.findall(u)) < linededup.LONG_WORDS:
                    continue
                if run[0] in seen:
                    gone |= set(range(k, k + run[1]))
                seen.add(run[0])
        kept, u = [], 0
        for x in lines:
            if WORD.search(x):
                if u not in gone:
                    kept.append(x)
                u += 1
            else:
                kept.append(x)
        out[i] = (len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept))
    return out


def test_line_dedup(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/documents.parquet")))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in rows(linededup.op3_line_dedup(spark, sf))}
    assert got == line_dedup_model(docs) and sum(v[1] for v in got.values())


def test_line_dedup_finds_maximal_runs_and_short_boilerplate(spark):
    long_run = "\n".join(f"line {k} of a run" for k in range(6))
    docs = [(1, "own first\n" + long_run + "\nown last"), (2, "other\n" + long_run.replace("\n", "\n\n") + "\nend"), (3, "x\nAll rights reserved by the owners\ny"), (4, "z\nAll rights reserved by the owners\nw"), (5, "a b\nx"), (6, "a b\nc")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    runs = {(r["doc_id"], r["run"]): r["lines"] for r in rows(linededup.repeated_runs(frame))}
    assert runs == {(2, 1): [1, 3, 5, 7, 9, 11], (4, 1): [1]}
    assert {r["doc_id"]: r["text"] for r in rows(linededup.deduplicated(frame))} == {k: v[2] for k, v in line_dedup_model(docs).items()}


def test_line_dedup_edges(spark):
    once = edge(spark).where("doc_id is not null and doc_id <> 3").dropDuplicates(["doc_id"])
    want = line_dedup_model(sorted((r["doc_id"], r["text"]) for r in rows(once)))
    assert {r["doc_id"]: r["text"] for r in rows(linededup.deduplicated(once))} == {k: v[2] for k, v in want.items()}
    all_ = linededup.deduplicated(edge(spark))
    assert all_.columns == edge(spark).columns and all_.count() == len(edge_rows())
    assert not linededup.deduplicated(empty(spark)).count()


def test_mixing(spark, sf):
    got = rows(mixing.op4_mixing(spark, sf))
    docs = {r["doc_id"]: r for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    taken, goal, total = Counter(), {}, 0
    for r in got:
        d = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
        goal[d["source"]] = r["target"]
        total += r["size"]
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-3 * total
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 3 for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.op4_mixing(spark, sf))))


def test_mixing_targets_stop_and_share_again():
    got = mixing.targets([100, 10, 100], (3, 1, 2))
    assert sum(got) == 315 and got[1] == 20 and got[0] == 177 and got[2] == 118


def test_mixing_edges(spark):
    docs = edge(spark)
    got = rows(mixing.mix(docs))
    assert len(got) == len(edge_rows())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words_of = lambda found: sum(len(WORD.findall(r["text"] or "")) for r in found)
    # Rows equal in doc_id and text share evenly, in whole words.
    assert abs(words_of(rows(mixed)) - sum(r["taken"] for r in got)) <= 3
    assert not rows(mixing.mix(empty(spark))) and not mixing.mixed(empty(spark)).count()


def class_lm_model(docs):
    toks = {i: [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in WORD.findall(t or "")] + [None] for i, t in docs}
    train = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    return {i: (len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks.items()}


@pytest.mark.parametrize("table", [1 << 20, 300])
def test_class_lm(spark, sf, monkeypatch, table):
    monkeypatch.setattr(classlm, "TABLE", table)
    want = class_lm_model([(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))])
    got = rows(classlm.op5_class_lm(spark, sf))
    assert len(got) == len(want)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - base) < 1e-6 * abs(base)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_lm_scores_alike_with_and_without_the_table(spark, sf, monkeypatch):
    one = {r["doc_id"]: r["score"] for r in rows(classlm.op5_class_lm(spark, sf))}
    monkeypatch.setattr(classlm, "TABLE", 300)
    two = {r["doc_id"]: r["score"] for r in rows(classlm.op5_class_lm(spark, sf))}
    assert all(abs(one[k] - two[k]) < 1e-6 * abs(one[k]) for k in one)


def test_class_lm_edges(spark):
    got = rows(classlm.score(edge(spark), F.col("doc_id") % 5 == 2))
    assert len(got) == len(edge_rows()) and all(math.isfinite(r["score"]) for r in got)
    assert not rows(classlm.score(empty(spark), F.lit(False)))
    lone = rows(classlm.score(edge(spark), F.lit(True)))
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in lone)


def test_exchange_puts_words_of_one_kind_together():
    m = np.zeros((5, 5))
    m[0, 2] = m[0, 3] = m[1, 2] = m[1, 3] = m[2, 0] = m[2, 1] = m[3, 0] = m[3, 1] = 10
    of = classlm.exchange(m, 2)
    assert of[0] == of[1] != of[2] == of[3]


def quality_model(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    for r in rows(quality.op6_quality(spark, sf)):
        want = quality_model(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])


def test_quality_edges(spark):
    got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows(quality.judged(edge(spark))))
    assert got == sorted(quality_model(r[1]) for r in edge_rows())
    assert not rows(quality.judged(empty(spark)))


TRICKY = ["", "a", "  a  b \n\n c\n", "it's we'll 're they're 'tis ''s", "x\n\ny \t\n z", "123abc, 4.5%% é'été n'est", "<|endoftext|> hi", "日本 a", "\xa0\xa0x\x85y", " \x1c\x1d a", " 's", "\n's", "'S 'LL'll'l", "\ufb01 x"]


def test_token_ids_are_those_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, rng = Tokenizer.from_file(path), np.random.default_rng(1)
    alphabet = list(" \n\t'stmdrevl aB1é.,!\xa0")
    texts = TRICKY + ["".join(rng.choice(alphabet, 40)) for _ in range(300)]
    got = packing.Encoder(path).encode(texts)
    assert [g.tolist() for g in got] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def check_pieces(found, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_sequence, crc = defaultdict(list), defaultdict(list)
    for p in found:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        crc[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for d, text in docs:
        ids = np.array(slow.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for start, length, value, n in sorted(crc[d]):
            assert start == at and n == len(ids) and value == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    return by_sequence


def test_packing(spark, sf):
    found = rows(packing.op7_packing(spark, sf))
    docs = [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))]
    sequences = check_pieces(found, docs)
    assert sum(p["length"] for p in found) > (len(sequences) - 1) * 2048 * 0.99


def test_packing_edges(spark):
    once = [(i, t) for i, t in {r[0]: r[1] for r in edge_rows() if r[0] not in (None, 3)}.items()]
    docs = spark.createDataFrame(once, "doc_id long, text string")
    check_pieces(rows(packing.packed(docs, group_rows=4)), once)
    total = lambda f: sum(p["length"] for p in f)
    assert total(rows(packing.packed(edge(spark)))) == total(rows(packing.packed(edge(spark), group_rows=3)))
    assert not rows(packing.packed(empty(spark)))


def test_first_fit_decreasing_is_first_fit():
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 100, 200)]
    want: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        home = next((b for b in want if sum(sizes[k] for k in b) + sizes[i] <= 100), None)
        if home is None:
            want.append(home := [])
        home.append(i)
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_class_lm_scores_are_those_of_the_plain_formula(spark, sf, monkeypatch):
    """All counts, transitions and emissions recomputed with dictionaries, from the classes alone."""
    from pyspark import SparkContext

    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or send(self, value))
    got = {r["doc_id"]: r["score"] for r in rows(classlm.op5_class_lm(spark, sf))}
    model = sent[-1][0]
    docs = [(r["doc_id"], r["text"] or "") for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))]
    h, s, doc = classlm.tokens([t.encode() for _, t in docs])
    text = [list(zip(h[doc == k].tolist(), s[doc == k].tolist(), strict=True)) for k in range(len(docs))]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs]
    of = {x: c for x, c in zip(model.h.tolist(), model.of.tolist(), strict=False) if c >= 0}
    assert len(of) > 2 * classlm.HEAD and len(set(of.values())) > classlm.CLASSES // 2
    group = lambda w: of.get(w[0], int(model.signs[w[1]]))
    count, pairs = Counter(), Counter()
    for ws, yes in zip(text, train, strict=True):
        if yes:
            count.update(w[0] for w in ws)
            pairs.update(zip([model.begin, *map(group, ws)], map(group, ws)))
    sign_of = {w[0]: w[1] for ws, yes in zip(text, train, strict=True) if yes for w in ws}
    head = sorted(count.values(), reverse=True)[: classlm.HEAD][-1]
    assert all(count[w] >= min(classlm.LEAST, head) for w in of)
    seen, kinds, size = Counter(), Counter(), Counter()
    for w, n in count.items():
        if w in of:
            size[of[w]] += n
        else:
            seen[sign_of[w]] += n
            kinds[sign_of[w]] += 1
    for k in range(classlm.SIGNATURES):
        size[int(model.signs[k])] += seen[k] + 1
    ones, twos = (sum(n == k for n in count.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos)
    before, follow, after = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        follow[a] += 1
        after[b] += n
    total = sum(pairs.values())

    def log_probability(a, w):
        b = group(w)
        share = (after[b] + 1) / (total + classlm.CLASSES)
        p = (pairs[a, b] + follow[a] * share) / (before[a] + follow[a]) if before[a] else share
        if w[0] in of:
            return math.log10(p * count[w[0]] / size[b])
        k = w[1]
        p *= (seen[k] + 1) / size[b]
        if count[w[0]]:
            return math.log10(p * (count[w[0]] - discount) / seen[k])
        return math.log10(p * (discount * kinds[k] / seen[k] if seen[k] else 1) / (kinds[k] + 1))

    for (i, _), ws in zip(docs, text, strict=True):
        want = sum(log_probability(a, w) for a, w in zip([model.begin, *map(group, ws)], ws))
        assert abs(got[i] - want) < 1e-6 * abs(want)


def test_class_lm_exchange_of_the_vocabulary_raises_the_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    one, two, single = (sum(r["score"] for r in rows(classlm.score(docs, held, classes=c, rounds=r)) if not r["held_out"]) for c, r in ((48, 0), (48, 1), (1, 0)))
    assert two > one > single


def test_distributed_exchange_moves_a_word_to_the_class_of_its_likes():
    bigrams = np.array([[0, 50, 0, 5.0], [50, 0, 0, 5], [0, 0, 9, 0], [5, 5, 0, 0]])
    w, c, n = (np.array(x) for x in ([0, 0, 3, 3], [1, 4 + 1, 0, 4 + 0], [4, 4, 4, 4]))
    assert classlm.moved(w, c, n, np.array([2, 0, 0, 2]), bigrams).tolist() == [0, 1]


def plain_kneser_ney(texts, order, alphabet, context, char):
    """Interpolated Kneser-Ney by dictionaries: absolute discounting, lower orders from continuation types."""
    padded = [" " * (order - 1) + t for t in texts]
    top = Counter(t[i - order + 1 : i + 1] for t in padded for i in range(order - 1, len(t)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(n, ctx, c):
        if n == 0:
            return 1 / alphabet
        level = counts[n]
        ones, twos = (sum(v == k for v in level.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        ctx = ctx[len(ctx) - n + 1 :] if n > 1 else ""
        after = {g: v for g, v in level.items() if g[:-1] == ctx}
        lower = p(n - 1, ctx[1:], c)
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get(ctx + c, 0) - d, 0) / total + d * len(after) / total * lower

    return p(order, context, c=char)


def test_kneser_ney_is_the_plain_formula():
    texts = ["abab abba ", "baab caab ", "cab "]
    m = language.KneserNey([t.strip() for t in texts], 5)
    codes, doc = language.normalised(["bab cx", "aab"])
    gram, at = language.grams(codes, doc)
    got = m.score(gram, language.contexts(codes, at))
    flat = "".join(chr(c - 1) for c in codes.tolist())
    want = [plain_kneser_ney(texts, language.ORDER, 5, flat[i - language.ORDER + 1 : i], flat[i]) for i in at.tolist()]
    assert np.allclose(np.exp(got), want, rtol=1e-9)


def test_language_rejects_junk_and_languages_without_a_model(spark, sf):
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet"))
    samples = defaultdict(list)
    for r in docs:
        if r["lang"] and r["text"]:
            samples[r["lang"]].append(r["text"])
    rng = np.random.default_rng(4)
    model = language.Identifier({k: v[::2] for k, v in samples.items()})
    own = [t for v in samples.values() for t in v[1::2] if sum(map(str.isalpha, t)) > 30]
    junk = ["".join(rng.permutation(list(t))) for t in own] + ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200)) for _ in range(50)]
    junk += ["Это предложение на русском языке", "これは日本語の文です", "Tämä on suomenkielinen lause", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgc3RyaW5n"]
    _, score, _, rejected = model.predict(own)
    assert rejected.mean() <= 0.01 and np.median(score) > 0.95
    _, score, _, rejected = model.predict(junk)
    assert rejected.mean() >= 0.98 and (score[rejected] < 0.5).all()
    for left in ("de", "es"):
        rest = language.Identifier({k: v[::2] for k, v in samples.items() if k != left})
        foreign = [t for t in samples[left] if sum(map(str.isalpha, t)) > 300]
        _, score, _, rejected = rest.predict(foreign)
        assert rejected.mean() > 0.8 and score[rejected].max() < 0.5
