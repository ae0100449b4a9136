"""Operators 8 to 10 and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import jaccard, suffixes, urlfilter

from .cases import edge, edge_rows, empty, words
from .test_documents import check_pieces, line_dedup_model, rows, shingle_set
from .test_documents import jaccard as similarity


def suffix_model(docs):
    count = Counter(b[p : p + 400] for _, b in docs for p in range(len(b) - 399))
    out = []
    for i, b in docs:
        mask, reach = bytearray(len(b)), 0
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                for q in range(max(p, reach), p + 400):
                    mask[q] = 1
                reach = p + 400
        kept = bytes(x for x, gone in zip(b, mask, strict=True) if not gone)
        out.append((i, len(b), sum(mask), len(re.findall(rb"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check_suffixes(docs):
    got = [tuple(r.values()) for r in rows(suffixes.without_repeated(docs))]
    assert sorted(got, key=str) == suffix_model([(r["doc_id"], (r["text"] or "").encode()) for r in rows(docs)])


def test_suffix_dedup(spark, sf):
    check_suffixes(spark.read.parquet(f"{sf}/documents.parquet"))


def test_suffix_dedup_edges(spark, monkeypatch):
    check_suffixes(edge(spark))
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    check_suffixes(edge(spark))
    assert not rows(suffixes.without_repeated(empty(spark)))


def test_suffix_dedup_of_a_text_longer_than_a_segment(spark):
    """More than a MB in one text, with a passage that repeats across its segments and in another text."""
    rng = random.Random(21)
    body = words(rng, 200_000, 50_000)
    passage = body[1000:1700]
    docs = spark.createDataFrame([(1, body + " " + passage + " end"), (2, "begin " + passage[100:600] + " end"), (3, words(rng, 3000, 50_000))], "doc_id long, text string")
    assert len(body) > suffixes.SEGMENT
    got = {r["doc_id"]: r for r in rows(suffixes.without_repeated(docs))}
    # Words next to both copies may agree by a letter or two.
    assert got[1]["n_spans"] == 2 and 2 * len(passage) <= got[1]["n_removed"] <= 2 * len(passage) + 8
    assert got[2]["n_spans"] == 1 and 500 <= got[2]["n_removed"] <= 506 and got[3]["n_removed"] == 0


def test_suffix_dedup_of_partial_overlaps_and_periods(spark):
    rng = random.Random(9)
    base = words(rng, 400)
    texts = [base[a : a + n] + words(rng, 20) for a, n in ((0, 700), (100, 450), (300, 405), (350, 399), (90, 700), (300, 800), (301, 401))]
    texts += ["ab" * 500, "x" * 399, "x" * 400, "x" * 401, words(rng, 5) + "ab" * 210]
    check_suffixes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def url_model(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    listed = host and hashlib.md5(host.encode()).hexdigest()[0] in "01"
    return host, path, rule, verdict or ("block" if listed else "allow")


def test_url_filter(spark, sf):
    urls = {r["page_id"]: r["url"] for r in rows(spark.read.parquet(f"{sf}/pages.parquet"))}
    got = rows(urlfilter.op9_url_filter(spark, sf))
    assert len(got) == len(urls)
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == url_model(urls[r["page_id"]]) for r in got)


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "http://www.example.com/en/x", "http://example.com/en/", "http://aexample.com/en/", "http://b.net/es/", "x://net/fr/a?b#c", "ftp://user@h:80/p//q://r", "http://Ä.org/ß#f?", "http://a.net?x=/es/"] * 2
    pages = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(urls)], "page_id long, url string, host string, listed boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urlfilter.filtered(pages))}
    assert got == {i: url_model(u) for i, u in enumerate(urls)}
    assert not rows(urlfilter.filtered(pages.limit(0)))


def test_url_filter_in_ranges_and_with_hostile_lists(spark, sf, monkeypatch):
    """More listed hosts than a range takes, very long urls, a list of hosts that aren't there, and one of all hosts."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(spark.createDataFrame([(10**6, "http://" + "h" * 200_000 + "/" + "p" * 200_000), (10**6 + 1, None)], "page_id long, url string"))
    urls = {r["page_id"]: r["url"] for r in rows(pages)}
    one = sorted(map(str, rows(urlfilter.filtered(pages))))
    monkeypatch.setattr(urlfilter, "RANGE_KEYS", 3)
    many = urlfilter.filtered(pages)
    assert sorted(map(str, rows(many))) == one
    hosts = {url_model(u)[0] for u in urls.values()} - {""}
    for listed in (set(), {"nowhere.example", ""}, hosts | {"nowhere.example"}):
        frame = spark.createDataFrame([(h,) for h in listed], "name string")
        for r in rows(urlfilter.filtered(pages, frame)):
            host, _, rule, _ = url_model(urls[r["page_id"]])
            assert r["host"] == host and (rule is not None or r["verdict"] == ("block" if host in listed and host else "allow"))


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urlfilter.Cascade(keys)
    assert len(cascade.levels) > 1
    assert not keys.where(cascade.has(F.col("key")) != F.col("listed")).count()
    none = urlfilter.Cascade(keys.withColumn("listed", F.lit(False)))
    assert not keys.where(none.has(F.col("key"))).count()


def groups_model(docs):
    """docs: (key, text). (group of each key as its least key, links between different sets, copies)."""
    sets = {k: frozenset(shingle_set(t)) for k, t in docs}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted({s for s in sets.values() if s}, key=lambda s: min(k for k in sets if sets[k] == s))
    links = Counter()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if similarity(a, b) >= 0.8 - 1e-9:
                links[a] += 1
                links[b] += 1
                ka, kb = (find(min(k for k in sets if sets[k] == s)) for s in (a, b))
                parent[max(ka, kb)] = min(ka, kb)
    out = {}
    for k, s in sets.items():
        same = [x for x in sets if s and sets[x] == s] or [k]
        out[k] = (find(min(same)), links[s], len(same))
    return out


def near_copies(rng, n_groups=6, size=5):
    texts = []
    for _ in range(n_groups):
        w = words(rng, 200, 5000).split()
        for _ in range(size):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    return texts


def test_jaccard_join(spark):
    rng = random.Random(2)
    docs = list(enumerate(near_copies(rng) + [words(rng, 100, 3000) for _ in range(40)] + ["short one", "short one", "", None, "a"]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in rows(jaccard.grouped(frame))}
    assert got == groups_model(docs)


def test_jaccard_join_of_a_large_group(spark, monkeypatch):
    """Leaders in parts find the group also where its texts differ in up to six words."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = random.Random(4)
    docs = list(enumerate(near_copies(rng, 2, 150) + [words(rng, 100, 3000) for _ in range(20)]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(jaccard.grouped(frame))
    want = groups_model(docs)
    # The join is probabilistic: of 320 texts, with buckets of more than four split, at most two may lose their group.
    assert sum(r["class_id"] != want[r["doc_id"]][0] for r in got) <= 2


def test_links_of_close_copies_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    base, found = words(random.Random(6), 300, 5000).split(), []
    for size in (100, 200):
        docs = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(size)]
        got = rows(jaccard.grouped(spark.createDataFrame(docs, "doc_id long, text string")))
        assert {r["class_id"] for r in got} == {0}
        found.append(sum(r["n_links"] for r in got))
    assert found[1] < 3 * found[0]


def test_jaccard_join_checks_pairs_that_the_estimate_puts_low(spark):
    """Pairs just above 0.8 whose 128-bin estimate is below 0.72 are still candidates."""
    rng, low = random.Random(12), []
    while len(low) < 3:
        pairs = []
        for _ in range(100):
            w = words(rng, 300, 5000).split()
            v = list(w)
            for at in range(5, 300, 50):
                v[at] = f"new{rng.randrange(10**6)}"
            pairs += [" ".join(w), " ".join(v)]
        sketch = {r["doc_id"]: np.frombuffer(r["sketch"], "<u2") for r in rows(jaccard.signatures(spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")))}
        low += [(pairs[i], pairs[i + 1]) for i in range(0, 200, 2) if 0.67 <= (sketch[i] == sketch[i + 1]).mean() < 0.72]
    assert all(similarity(*map(shingle_set, p)) >= 0.8 for p in low)
    docs = [(i, t) for i, t in enumerate(t for p in low for t in p)]
    signed = jaccard.signatures(spark.createDataFrame(docs, "doc_id long, text string")).select(F.lit(1).cast("long").alias("node"), "class", "sketch")
    assert jaccard.compared(signed).count() == len(low)


def test_all_links_and_groups_of_large_buckets(spark, monkeypatch):
    """Close copies and loose chains: every link counts and every group is whole, also where buckets and groups go in blocks."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(6)
    base = words(rng, 300, 5000).split()
    docs = [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(60)]
    step = words(rng, 300, 5000).split()
    for i in range(40):  # each resembles the next few only
        step[(i * 37) % 300] = f"step{i}"
        step[(i * 53 + 11) % 300] = f"more{i}"
        docs.append(" ".join(step))
    docs = list(enumerate(docs + near_copies(rng, 3, 3)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in rows(jaccard.grouped(spark.createDataFrame(docs, "doc_id long, text string"), complete=True))}
    assert got == groups_model(docs)


def test_sets_connect_what_all_links_connect():
    rng = random.Random(8)
    texts = near_copies(rng, 4, 30) + [words(rng, 60, 50) for _ in range(20)]
    whole = jaccard.Sets([t.encode() for t in texts])
    sets = [shingle_set(t) for t in texts]
    want = np.array([[i != j and similarity(x, y) >= 0.8 - 1e-9 for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    assert (whole.like(np.arange(len(texts))) == want).all()

    def components(pairs):
        label = list(range(len(texts)))
        for x, y in pairs:
            label = [label[x] if v == label[y] else v for v in label]
        return {frozenset(i for i, v in enumerate(label) if v == k) for k in label}

    assert components(whole.connecting()) == components(zip(*np.nonzero(want), strict=True))


def test_sets_of_large_buckets_all_stay_in_them(spark, monkeypatch):
    """What a bucket compares doesn't depend on its size: no set leaves a large one uncompared."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    docs = spark.createDataFrame(list(enumerate(near_copies(random.Random(3), 2, 40))), "doc_id long, text string")
    signed = jaccard.signatures(docs).select("class", "sketch").dropDuplicates(["class"]).cache()
    nodes = [(r["node"], r["class"]) for r in rows(jaccard.paths(signed, jaccard.DEPTH))]
    met = Counter(node for node, _ in nodes)
    got = {(r["node"], r["class"]) for r in rows(jaccard.candidates(signed)[1])}
    assert got and got == {(node, c) for node, c in nodes if met[node] > 4}


def test_jaccard_edges(spark):
    got = rows(jaccard.grouped(edge(spark)))
    assert len(got) == len(edge_rows()) and not rows(jaccard.grouped(empty(spark)))
    kept = jaccard.one_of_each(edge(spark))
    assert kept.columns == edge(spark).columns
    texts = [r["text"] for r in rows(kept)]
    full = [t for t in texts if t and t.strip()]
    assert len(full) == len(set(full)) and texts.count(None) == 2
    assert not jaccard.one_of_each(empty(spark)).count()


def test_pipeline_stages(spark, sf):
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        counts.append(out.count())
        docs = out
    assert counts[0] >= 0.97 * 200 and counts[1] == counts[0] and counts[2] < counts[1] and counts[4] > 0


def test_pipeline_equals_plain_stages(spark, sf):
    """Each stage against a plain version of it on what the stage before kept: language by the model's own predictions, lines and near copies by
    brute force, the mix by its targets, the pieces by the tokenizers library."""
    from lodestone.llm import language, mixing

    by_name, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    before = rows(docs)
    model = language.fitted(docs, F.lit(True))
    judged = [bool(r["text"]) and any(map(str.isalpha, r["text"])) and not model.predict([r["text"]])[3][0] for r in before]
    docs = spark.createDataFrame(by_name["language"](spark, docs, sf).collect(), docs.schema)
    assert sorted(map(str, rows(docs))) == sorted(str(r) for r, ok in zip(before, judged, strict=True) if ok)
    want = line_dedup_model(sorted((r["doc_id"], r["text"]) for r in rows(docs)))
    docs = spark.createDataFrame(by_name["line_dedup"](spark, docs, sf).collect(), docs.schema)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows(docs)} == {k: (v[2], len(v[2])) for k, v in want.items()}
    groups = groups_model([(r["doc_id"], r["text"]) for r in rows(docs)])
    stay = spark.createDataFrame(by_name["near_duplicates"](spark, docs, sf).collect(), docs.schema)
    assert sorted(r["doc_id"] for r in rows(stay)) == sorted(k for k, g in groups.items() if g[0] == k)
    count = lambda found, by: Counter({x: sum(len((r["text"] or "").split()) for r in found if r["source"] == x) for x in by})
    sources = sorted({r["source"] for r in rows(stay)})
    sizes = count(rows(stay), sources)
    goal = dict(zip(sources, mixing.targets([sizes[x] for x in sources]), strict=True))
    mixed = spark.createDataFrame(by_name["mixing"](spark, stay, sf).collect(), docs.schema)
    taken, texts = count(rows(mixed), sources), {r["doc_id"]: r["text"] for r in rows(stay)}
    assert all(abs(taken[x] - goal[x]) <= 0.01 * goal[x] + 3 for x in sources)
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in rows(mixed))
    once = mixed.dropDuplicates(["doc_id"])
    held = [(r["doc_id"], r["text"]) for r in rows(once)]
    check_pieces(rows(by_name["packing"](spark, spark.createDataFrame([next(r for r in rows(once) if r["doc_id"] == i) for i, _ in held], docs.schema), sf)), held)


def test_pipeline_on_edges(spark):
    """Each stage on nulls, empty and long texts, ties, repeats and clashing columns, and on an empty table."""
    want = {
        "language": lambda docs: {str(r) for r in rows(docs) if r["text"] and any(map(str.isalpha, r["text"]))},
        "line_dedup": lambda docs: len(rows(docs)),
    }
    for name, stage in corpus_pipeline.STAGES:
        docs = edge(spark)
        got = rows(stage(spark, docs, ""))
        assert stage(spark, empty(spark), "").count() == 0, name
        if name == "language":
            assert {str(r) for r in got} <= want[name](docs) and len(got) >= 0.9 * len(want[name](docs))
        elif name == "line_dedup":
            assert len(got) == want[name](docs) and sum(r["text"] is None for r in got) == sum(r["text"] is None for r in rows(docs))
        elif name == "near_duplicates":
            full = [r["text"] for r in got if r["text"] and r["text"].strip()]
            assert len(full) == len(set(full)) and sum(r["text"] is None for r in got) == sum(r["text"] is None for r in rows(docs))
        elif name == "mixing":
            sizes = {r["text"] for r in rows(docs)}
            assert got and all(r["text"] and any((t or "").startswith(r["text"].rstrip()) for t in sizes) for r in got)
        else:
            assert sum(p["start"] == 0 for p in got) >= len(rows(docs)) and all(0 < p["length"] <= 2048 for p in got)


def test_language_stage_drops_junk_and_keeps_the_rest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10**6 + i, "".join(random.Random(i).choices("qxzjvkw", k=300)), None, "junk", 300) for i in range(20)], docs.schema)
    kept = {r["doc_id"] for r in rows(corpus_pipeline.STAGES[0][1](spark, docs.unionByName(junk), sf))}
    good = {r["doc_id"] for r in rows(docs) if r["text"] and any(map(str.isalpha, r["text"]))}
    assert not any(i >= 10**6 for i in kept) and len(good & kept) >= 0.98 * len(good)


def test_jaccard_join_of_loose_groups_in_proportion(spark):
    """Groups of texts with many pairs on either side of the threshold: whole groups and all links, and what is checked grows with the group."""
    for size in (400, 800):
        rng = random.Random(size)
        base = words(rng, 404, 50_000).split()
        docs = []
        for i in range(size):
            v = list(base)
            for at in rng.sample(range(404), 5):
                v[at] = f"new{i}x{at}"
            docs.append((i, " ".join(v)))
        got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in rows(jaccard.grouped(spark.createDataFrame(docs, "doc_id long, text string"), complete=True))}
        sets = [shingle_set(t) for _, t in docs]
        names = {s: k for k, s in enumerate(set().union(*sets))}
        matrix = np.zeros((size, len(names)), np.float32)
        for i, s in enumerate(sets):
            matrix[i, [names[x] for x in s]] = 1
        common = matrix @ matrix.T
        each = matrix.sum(1)
        like = common >= 0.8 * (each[:, None] + each - common) - 1e-6
        np.fill_diagonal(like, False)
        assert [got[i][1] for i in range(size)] == like.sum(1).tolist()
        assert len({v[0] for v in got.values()}) == 1 if like.sum(1).all() else True
