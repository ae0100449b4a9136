"""The main library: registered queries beside their SQL, parsers, skeletons, paths, sources, incremental updates, RPC."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import __main__ as command
from lodestone import agent, engine, rpc
from lodestone import queries as registered
from lodestone.functions import text as T
from lodestone.functions.vectors import half
from lodestone.operators import formatting, graph, parse, paths, vectors
from lodestone.plans import corpus
from lodestone.sources import files, tables
from lodestone.streaming import incremental

from .compare import both


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_equals_sql(spark, sf, name):
    got, want = both(spark, sf, registered.QUERIES[name], registered.ORACLES[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registered.QUERIES) - set(registered.ORACLES)))
def test_query_runs(spark, sf, name):
    assert registered.QUERIES[name](spark, sf).count() > 0


def test_half_precision(spark):
    values = [1 / 3, 1e-5, 65519.0, 65520.0, 0.0, -65520.0, 6e-8, 1e-9, -2.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(half(F.col("v"))).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(v)) for v in values]


def test_python_rules():
    got = parse.parse_source("class A:\n    def m(self): return f(1)\n    @x\n    def n(self): pass\n    class B:\n        def k(self): pass\n@d\ndef top():\n    def inner(): pass\n", "a.py")
    assert [s["id"] for s in got.symbols] == ["a.py::A", "a.py::A::m", "a.py::A::B", "a.py::B::k", "a.py::top"]
    assert [s["id"] for s in parse.parse_source("class A:\n    def m(self):\n        return f(1\ndef z(:\n    pass\n", "a.py").symbols] == ["a.py::A", "a.py::A::m", "a.py::z"]


def test_rust_and_script_rules():
    rust = parse.parse_source('impl Foo { fn new() {} }\nimpl T for Bar { fn new() { let s = "fn no() {"; } }\nstruct S {}\nuse std::io;\n', "lib.rs")
    assert [s["id"] for s in rust.symbols] == ["lib.rs::Foo::new", "lib.rs::Bar::new"] and rust.imports[0]["module_path"] == "std::io"
    js = parse.parse_source("export const h = (a) => { return g(a) }\nfunction q() { return h() }\nclass C { m() {} }\n", "a.js")
    assert [(s["id"], s["kind"]) for s in js.symbols] == [("a.js::h", "function"), ("a.js::q", "function"), ("a.js::C", "class"), ("a.js::C::m", "method")]


@pytest.mark.parametrize(("body", "want"), [
    ("", ""), ("  \n \n", ""), ("fn a() {\n  b()\n}", "fn a() {"), ("\n\ndef f():\n    return 1", "def f():"),
    ('def f():\n    """One."""\n    return 1', 'def f():\n\n    """One."""'), ("def f():\n    '''A\n    b\n    '''\n    x", "def f():\n\n    '''A\n    b\n    '''"),
    ("# c\ndef f():\n    x", "# c\ndef f():"), ("def f():\n" + "    # n\n" * 20, "def f():\n\n" + "\n".join(["    # n"] * 14)),
])
def test_skeleton(body, want):
    assert parse.skeleton(body) == want


@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=30), st.lists(st.floats(0, 1, width=32), min_size=12, max_size=12), st.integers(1, 12))
def test_best_first_paths_are_walks(edges, similarity, depth):
    src, dst = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    graph = paths.Adjacency(12, src, dst)
    path, score, seen = paths.best_first(graph, np.array(similarity, np.float32), 0, True, depth)
    assert path[0] == 0 and path[-1] in seen and score == np.float32(similarity[path[-1]]) and len(path) <= depth
    assert all((a, b) in set(edges) for a, b in zip(path, path[1:], strict=False))
    if depth == 12:
        assert score == max(np.float32(similarity[n]) for n in seen)


def test_jump_reaches_a_disconnected_node():
    graph = paths.Adjacency(3, np.array([0]), np.array([1]))
    similarity = np.array([0.2, 0.1, 0.9], np.float32)
    # Both ways jump; the way back is reversed before the start, and each node stays where it comes first.
    assert paths.two_way(graph, similarity, 0, [2, 0, 1], 1)[0] == [2, 0]


def test_sources_and_incremental_updates(spark, tmp_path):
    root = tmp_path / "w"
    (root / ".git").mkdir(parents=True)
    (root / "dist").mkdir()
    (root / ".gitignore").write_text("dist/\n")
    (root / "dist" / "x.py").write_text("def hidden(): pass\n")
    (root / "__init__.py").write_text("def a():\n    return b()\n")
    (root / "_p.py").write_text("def b():\n    return 1\n")
    (root / "bad.py").write_bytes(b"\xff\xfe def")
    assert [p for p, _ in files.listed(str(root))] == ["__init__.py", "_p.py", "bad.py"]
    assert not files.inside(str(root), "../x") and not files.inside(str(root), "/etc/passwd") and files.inside(str(root), "_p.py")
    store = tables.IndexStore(str(tmp_path / "index"))
    assert incremental.index(spark, str(root), store) == 1
    assert store.load(spark, "edges").count() == 1 and store.load(spark, "nodes").count() == 2
    (root / "_p.py").write_text("def b():\n    return c()\n\ndef c():\n    return 1\n")
    os.remove(root / "bad.py")
    assert incremental.update(spark, str(root), store, ["_p.py", "bad.py", "../../etc/passwd"]) == 2
    assert store.load(spark, "nodes").count() == 3 and store.load(spark, "edges").count() == 2 and store.load(spark, "vectors").count() == 3
    rebuilt = incremental.tables(parse.symbols(files.read(spark, str(root))))["edges"]
    assert not rebuilt.exceptAll(store.load(spark, "edges")).count()


def test_text_helpers(spark):
    assert T.needles("Why does ForeignKey in a.b.query fail?")[:3] == ["query", "a.b.query", "Why"]
    row = spark.createDataFrame([(" .\\lib\\deep\\a b.py", "x" * 32001)], "p string, b string").select(T.normal_path(F.col("p")), F.length(T.capped(F.col("b")))).first()
    assert tuple(row) == ("lib/deep/a b.py", 32003)


class Engine:
    def paths(self, query, k):
        return [{"score": 0.5, "nodes": [{"symbol_id": "i", "name": "f", "kind": "function", "file_path": "a.py", "line_range": (0, 2), "body": "B", "skeleton": "S", "relevance": 0.5}]}][:k]

    chunks = paths


def test_rpc():
    call = lambda **a: rpc.handle(json.dumps({"id": 1, "method": "tools/call", "params": {"name": rpc.TOOLS[0], "arguments": a}}), Engine())
    assert call(query=" ")["error"]["code"] == call(query="x" * 10001)["error"]["code"] == -32602
    assert "▸ f (a.py:1-3) [skeleton]" in call(query=" ok ")["result"]["content"][0]["text"]
    assert call(query="q", max_results=0)["result"]["content"][0]["text"] == "No relevant execution paths found."
    assert rpc.handle("{", None)["error"]["code"] == -32700 and rpc.handle('{"method": "x"}', None)["error"]["code"] == -32601
    shown = json.loads(formatting.as_json(Engine().paths("q", 1), 1))["paths"][0]["nodes"][0]
    assert shown["full_body"] == "B" and shown["is_terminal"]


def test_path_search_equals_a_search_of_the_whole_graph(spark, sf):
    """The neighbourhoods found by joins lose nothing: the same paths as over all nodes at once."""
    symbols = corpus.symbols(spark, sf)
    nodes, edges = graph.build(symbols)
    held = vectors.embedded(nodes.select("id", F.concat_ws(" ", "name", "body").alias("b")), "b").select("id", "vector")
    asked = vectors.embedded(spark.createDataFrame([(0, "return class it"), (1, "def if u f"), (2, "C")], "query long, text string"), "text", "qv")
    for depth, kind in ((10, "Calls"), (2, "ContainedIn"), (1, "Calls")):
        some = edges.where(F.col("kind") == kind)
        got = {}
        for r in paths.search(held, some, asked, 4, depth).orderBy("query", "path_rank", "pos").collect():
            got.setdefault((r["query"], r["path_rank"], r["score"]), []).append(r["symbol_id"])
        table = {r["id"]: np.array(r["vector"], np.float64) for r in held.collect()}
        ids = sorted(table)
        index = {x: i for i, x in enumerate(ids)}
        pairs = {(index[r["src"]], index[r["dst"]]) for r in some.collect()}
        whole = paths.Adjacency(len(ids), *(np.array([p[k] for p in sorted(pairs)], np.int64) for k in (0, 1)))
        want = {}
        for q in asked.collect():
            v = np.array(q["qv"], np.float64)
            cos = [float(table[x] @ v / np.sqrt(table[x] @ table[x]) / np.sqrt(v @ v)) if table[x].any() and v.any() else 0.0 for x in ids]
            order = sorted(range(len(ids)), key=lambda i: (-round(cos[i], 6), i))
            found = [paths.two_way(whole, np.array(cos, np.float32), e, order[: paths.JUMP_CANDIDATES], depth) for e in order[:8]]
            found.sort(key=lambda p: -p[1])
            for rank, (path, score) in enumerate(found[:4]):
                want[q["query"], rank, round(score, 6)] = [ids[n] for n in path]
        assert [k[:2] for k in got] == [k[:2] for k in want] and list(got.values()) == list(want.values())


def test_top_k_each_in_blocks_of_queries_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    held = [(f"id{i:03d}", [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)]
    asked = [(q, [float(x) for x in rng.integers(-3, 4, 4)]) for q in range(7)] + [(7, [0.0] * 4)]
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 64)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        frame = spark.createDataFrame(held, "id string, vector array<double>").repartition(2)
        got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in vectors.top_k_each(frame, spark.createDataFrame(asked, "query long, qv array<double>"), 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for q, v in asked:
        unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-300)
        want = sorted((-round(float(unit(v) @ unit(x)), 6) + 0.0, i) for i, x in held)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s + 0.0) for s, i in want]


def test_nearest_rank_of_large_groups(spark, monkeypatch):
    from lodestone.operators import evaluation

    monkeypatch.setattr(evaluation, "ACCURACY", 100)
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 3000)] + [("b", float(x)) for x in rng.random(2000)] + [("c", 1.0)] + [("d", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for p in (0, 37, 50, 95, 100):
        got = {r["k"]: r["p_value"] for r in evaluation.nearest_rank_by(frame, "k", "v", p).collect()}
        want = {}
        for k in "abc":
            held = sorted(v for g, v in rows if g == k)
            want[k] = held[int(p / 100 * (len(held) - 1) + 0.5)]
        assert got == want


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "shop").mkdir()
    (root / "shop" / "cart.py").write_text("class Cart:\n    def total(self):\n        return price(self) + tax(self)\n\ndef price(cart):\n    return cart.sum\n")
    (root / "shop" / "tax.py").write_text("def tax(cart):\n    \"\"\"Adds tax.\"\"\"\n    return rate() * 2\n\ndef rate():\n    return 3\n")
    (root / "web.js").write_text("export const show = (cart) => { return render(cart) }\nfunction render(cart) { return cart }\n")
    return root


def test_engine_and_command(spark, tree, tmp_path, capsys):
    store = tables.IndexStore(str(tmp_path / "index"))
    asked = engine.opened(spark, str(tree), store)
    version = store.version()
    names = [n["name"] for p in asked.paths("total price tax", 3) for n in p["nodes"]]
    assert {"total", "tax"} <= set(names)
    single = asked.chunks("rate tax", 2)
    assert len(single) == 2 and all(len(p["nodes"]) == 1 and p["score"] == p["nodes"][0]["relevance"] for p in single)
    assert asked.paths("x", 0) == asked.chunks("x", 0) == []
    assert engine.opened(spark, str(tree), store).store.version() == version  # whole: not built again
    store.save(**{t: store.load(spark, t) for t in ("files", "symbols", "nodes", "edges")}, vectors=store.load(spark, "vectors").limit(1))
    engine.opened(spark, str(tree), store)
    assert store.version() == version + 2  # not whole: built again
    call = json.dumps({"id": 7, "method": "tools/call", "params": {"name": rpc.TOOLS[1], "arguments": {"query": "render cart", "max_results": 1}}})
    assert command.main([str(tree), "--data", str(tmp_path / "index")], [call + "\n", "\n"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["id"] == 7 and "=== Execution Path 1" in said["result"]["content"][0]["text"]


def test_only_changed_files_are_embedded(spark, tree, tmp_path, monkeypatch):
    import shutil

    root, store = tmp_path / "copy", tables.IndexStore(str(tmp_path / "index"))
    shutil.copytree(tree, root)
    incremental.index(spark, str(root), store)
    (root / "shop" / "tax.py").write_text("def tax(cart):\n    return levy()\n\ndef levy():\n    return 1\n")
    seen, describe = [], incremental.described
    monkeypatch.setattr(incremental, "described", lambda nodes: seen.extend(r["id"] for r in nodes.collect()) or describe(nodes))
    incremental.update(spark, str(root), store, ["shop/tax.py"])
    assert sorted(seen) == ["shop/tax.py::levy", "shop/tax.py::tax"]
    monkeypatch.undo()
    rebuilt = incremental.tables(parse.symbols(files.read(spark, str(root))))
    for name in ("vectors", "edges"):
        a, b = store.load(spark, name), rebuilt[name]
        assert a.count() == b.count() and not a.exceptAll(b).count()
    a, b = (sorted((r["id"], r["skeleton"]) for r in x.collect()) for x in (store.load(spark, "nodes"), rebuilt["nodes"]))
    assert a == b and not incremental.report_missing(spark, store)


def test_a_watched_tree_follows_changes(spark, tree, tmp_path):
    import shutil
    import time

    root, store = tmp_path / "copy", tables.IndexStore(str(tmp_path / "index"))
    shutil.copytree(tree, root)
    incremental.index(spark, str(root), store)
    stream = incremental.watch_tree(spark, str(root), store, str(tmp_path / "checkpoint"))
    try:
        (root / "new.py").write_text("def fresh():\n    return 1\n")
        os.remove(root / "web.js")
        for _ in range(120):
            if store.version() > 1:
                break
            time.sleep(0.5)
    finally:
        stream.stop()
    assert {r["path"] for r in store.load(spark, "files").collect()} == {"new.py", "shop/cart.py", "shop/tax.py"}


def test_a_failing_embedder_leaves_nulls_that_are_counted(spark):
    def provider():
        def embed(texts):
            if "bad" in texts:
                raise RuntimeError("no vector")
            return np.ones((len(texts), 3))

        return embed

    frame = spark.range(0, 6, 1, 1).select(F.col("id").alias("i"), F.when(F.col("id") == 3, "bad").otherwise("word").alias("t"))
    got = vectors.embedded(frame, "t", provider=provider, batch=2)
    assert vectors.without_vector(got) == 2 and [r["i"] for r in vectors.dimension_ok(got, 3).orderBy("i").collect()] == [0, 1, 4, 5]


def test_agent_tools(spark, tree):
    found = [{"score": 1.0, "nodes": [{"symbol_id": "a", "file_path": "f.py", "name": "a", "body": "x" * 9000}] * 2}]
    tools = agent.Tools(spark, str(tree), type("E", (), {"paths": lambda self, q, k: found})(), budget=4)
    assert tools.call("search", query="q").endswith("(truncated)") and tools.call("nothing").startswith("Error")
    assert tools.call("grep", pattern="RATE", path="shop") == "shop/tax.py:3:    return rate() * 2\nshop/tax.py:5:def rate():"
    assert tools.call("grep", pattern="x", path="../..").startswith("Error")
    assert tools.call("submit_patch", patch="+x").startswith("The patch") and tools.call("search", query="q").startswith("Error")
    assert tools.record("i", "m")["tool_call_breakdown"] == {"search": 1, "grep": 2, "submit_patch": 1}
    assert agent.tool_folder(str(tree), "shop/../shop/.") == "shop"
    with pytest.raises(ValueError, match="relative"):
        agent.tool_folder(str(tree), "/etc")


def test_needles_phases():
    assert T.needles("see pkg.mod.func and `run_it()` now") == ["func", "pkg.mod.func", "run_it"]
    many = " ".join(f"Name{i}x" for i in range(30))
    assert T.needles(many) == [f"Name{i}x" for i in range(20)]
    assert T.needles("why is it slow today") == ["today"] and T.needles("  ") == []
    assert T.needles("the Description of Foo_Bar foo_bar FOO_BAR") == ["Foo_Bar"]


@pytest.mark.parametrize("name", ["path_suffix_join", "recall_at_k"])
def test_repeated_oracle_files_equal_sql(spark, sf, tmp_path, name):
    """The same file several times in a case, some of it matched and some not."""
    for t in os.listdir(sf):
        if t != "pages.parquet":
            os.symlink(os.path.join(sf, t), tmp_path / t)
    urls = ["http://a.com/x/1", "http://a.com/x/2", "http://a.com/y/2", "http://a.com/x/1", "http://b.com/z/", None, "no scheme"]
    rows = [(3 + 97 * 3 * i, urls[0]) for i in range(5)] + [(100 + 97 * 3 * i, urls[1]) for i in range(3)] + [(5 + 97 * 3 * i, u) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string").toPandas().to_parquet(tmp_path / "pages.parquet")
    got, want = both(spark, str(tmp_path), registered.QUERIES[name], registered.ORACLES[name])
    assert got == want


def exhaustive(n, edges, similarity, start, outgoing, depth):
    """best_first without its early end and its arrays: (path, similarity, all visited nodes)."""
    import heapq

    ways = {a: [] for a in range(n)}
    for a, b in edges:
        ways[a if outgoing else b].append(b if outgoing else a)
    one, state, closed, best = np.float32(1), {start: (np.float32(0), 0, None)}, set(), start
    queue = [(one - similarity[start], start)]
    while queue:
        _, node = heapq.heappop(queue)
        if node in closed:
            continue
        closed.add(node)
        cost, level, _ = state[node]
        if level >= depth:
            continue
        if similarity[node] > similarity[best]:
            best = node
        for other in sorted(set(ways[node])):
            if other not in closed and (other not in state or cost + paths.HOP_COST < state[other][0]):
                state[other] = (cost + paths.HOP_COST, level + 1, node)
                heapq.heappush(queue, (state[other][0] + (one - similarity[other]), other))
    path = [best]
    while state[path[-1]][2] is not None:
        path.append(state[path[-1]][2])
    return path[::-1], float(similarity[best]), closed


@pytest.mark.parametrize("seed", range(60))
def test_searches_that_end_early_find_the_same_paths(seed):
    rng = np.random.default_rng(seed)
    n, depth = int(rng.integers(2, 120)), int(rng.integers(1, 11))
    edges = rng.integers(0, n, (int(rng.integers(0, 4 * n)), 2))
    similarity = rng.choice([-1, -0.3, 0, 0.1, 0.2, 0.5, 0.55, 0.7, 0.9, 1], n).astype(np.float32) if seed % 2 else rng.random(n, np.float32)
    graph = paths.Adjacency(n, edges[:, 0], edges[:, 1])
    for start in range(min(n, 12)):
        for outgoing in (True, False):
            path, score, seen = paths.best_first(graph, similarity, start, outgoing, depth)
            want, most, all_ = exhaustive(n, edges.tolist(), similarity, start, outgoing, depth)
            assert (path, score) == (want, most) and seen <= all_
            assert seen == all_ or len(seen) > paths.JUMP_VISITED


def test_memory_of_a_search():
    """A search that nothing can improve ends early; one over the whole graph takes arrays, not objects for each node."""
    import tracemalloc

    n = 40_000
    star = paths.Adjacency(n, np.zeros(n - 1, np.int64), np.arange(1, n))
    similarity = np.linspace(0.9, 0.1, n, dtype=np.float32)
    path, _, seen = paths.best_first(star, similarity, 0, True)
    assert path == [0] and len(seen) == paths.JUMP_VISITED + 1
    tree = paths.Adjacency(n, np.arange(1, n) // 8, np.arange(1, n))
    similarity = np.full(n, 0.5, np.float32)
    similarity[-1] = 0.75  # the last one to be visited
    similarity[1 : n - 1 : 2] = 0.6
    tracemalloc.start()
    path, score, _ = paths.best_first(tree, similarity, 0, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert score == 0.75 and path[-1] == n - 1 and most < 250 * n


def test_nodes_are_numbered_as_ids_sort(spark):
    ids = ["b", "a", "a\u00e9", "\U0001f600", "\uffee", "z" * 500, "Z"]
    nodes = spark.createDataFrame([(i, [1.0]) for i in ids], "id string, vector array<float>").repartition(3)
    held, links = paths.numbered(nodes, spark.createDataFrame([("a", "b"), ("a", "b"), ("Z", "\uffee")], "src string, dst string"))
    no = {r["id"]: r["no"] for r in held.collect()}
    assert sorted(no, key=no.get) == sorted(ids) and len(set(no.values())) == len(ids)
    assert sorted(map(tuple, links.collect())) == sorted([(no["a"], no["b"]), (no["Z"], no["\uffee"])]) and {t for _, t in links.dtypes} == {"bigint"}


def test_path_search_embeds_each_node_once(spark, tmp_path):
    said = str(tmp_path / "said")

    def provider():
        def embed(texts):
            with open(said, "a") as f:
                f.write("".join(t + "\n" for t in texts))
            return np.array([[len(t), 1.0] for t in texts])

        return embed

    nodes = spark.createDataFrame([(f"n{i}", "x" * (i + 1)) for i in range(40)], "id string, b string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 1) % 40}") for i in range(40)], "src string, dst string")
    asked = spark.createDataFrame([(0, [1.0, 1.0])], "query long, qv array<double>")
    assert paths.search(vectors.embedded(nodes, "b", provider=provider), edges, asked, 2).count() > 0
    with open(said) as f:
        assert len(f.readlines()) == 40
