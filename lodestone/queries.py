"""The registered queries of the library and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.vectors import half_vector
from .operators import evaluation, formatting, graph, parse, paths, vectors
from .plans import corpus as C
from .plans.corpus import GRAPH_SQL, table, values
from .plans.staging import cut

QUERIES: dict = {}
ORACLES: dict = {}
SUITES = ("de", "en", "es", "fr")
NEEDLES = ("www.", "e-mail", "License", "###", "http")


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = C.plain(sql)
        return f

    return register


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = C.symbols(spark, sf_dir)
    n = graph.nodes(s)
    return s, n, graph.call_edges(s, n).unionByName(graph.containment_edges(s, n))


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COS = "round(coalesce(CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0 END, 0), 6)"
_HALF = "list_transform({v}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END)"


def _cos(a: str, b: str) -> str:
    return _COS.format(a=f"{a}::DOUBLE[]", b=f"{b}::DOUBLE[]")


@query(f"SELECT vec_id, {_cos('embedding', 'q')} AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return vectors.top_k(e, e.where("vec_id = 0").select("embedding").scalar(), 10, "vec_id", "embedding")


@query(f"WITH h AS (SELECT vec_id, {_HALF.format(v='embedding')} AS e FROM embeddings) SELECT h.vec_id, {_cos('h.e', 'z.q')} AS score FROM h, (SELECT e AS q FROM h WHERE vec_id = 0) z ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_f16(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("embedding", half_vector(F.col("embedding")))
    return vectors.top_k(e, e.where("vec_id = 0").select("embedding").scalar(), 10, "vec_id", "embedding")


@query(f"SELECT * FROM (SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query, e.vec_id, {_cos('e.embedding', 'q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5")
def vector_topk_multi(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return vectors.top_k_each(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")), 5, "vec_id", "embedding")


@query(f"SELECT i.vec_id, CASE WHEN e.vec_id IS NULL THEN 0 ELSE {_cos('e.embedding', _Q0)} END AS score FROM (SELECT vec_id * 2 AS vec_id FROM embeddings) i LEFT JOIN embeddings e ON i.vec_id = e.vec_id")
def similarity_default(spark, sf_dir):
    """Asked for twice each id: half of them aren't there."""
    e = _emb(spark, sf_dir)
    return vectors.similarity(e, e.where("vec_id = 0").select("embedding").scalar(), e.select((F.col("vec_id") * 2).alias("vec_id")), "vec_id", "embedding")


@query("SELECT CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE 'old' END AS state, count(*) AS n, sum(vec_id) AS ids, round(sum(CASE WHEN vec_id % 10 = 0 THEN embedding[2] ELSE embedding[1] END::DOUBLE), 4) AS first FROM embeddings GROUP BY 1")
def vector_upsert(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("state", F.lit("old"))
    changed = e.where("vec_id % 10 = 0").select("vec_id", F.slice("embedding", 2, 1).alias("embedding"), F.lit("new").alias("state"))
    got = vectors.upsert(e, changed, "vec_id")
    return got.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("first"))


@query("SELECT count(*) AS n FROM embeddings WHERE label <> 1")
def vector_remove_prefix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat("label", F.lit("::"), "vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.remove_prefix(e, "1::").agg(F.count(F.lit(1)).alias("n"))


@query(GRAPH_SQL + ", held AS (SELECT n.id, len(e.embedding) AS size FROM nodes n JOIN embeddings e ON n.ordinal = e.vec_id) SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM held)) = 0 AND (SELECT count(*) FROM held WHERE size <> 64) = 0 AS ok, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM held)) AS missing, (SELECT count(*) FROM held WHERE size <> 64) AS wrong")
def index_integrity(spark, sf_dir):
    n = graph.nodes(C.symbols(spark, sf_dir))
    e = _emb(spark, sf_dir)
    return vectors.intact(n, n.select("id", "ordinal").join(e, F.col("ordinal") == F.col("vec_id")).select("id", F.col("embedding").alias("vector")), 64)


@query(GRAPH_SQL + " SELECT ordinal, name, array_to_string(calls, ',') AS calls FROM symbols")
def call_extract(spark, sf_dir):
    return C.symbols(spark, sf_dir).select("ordinal", "name", F.array_join("calls", ",").alias("calls"))


@query(GRAPH_SQL + " SELECT id, ordinal, name FROM nodes")
def nodes_dedup(spark, sf_dir):
    return graph.nodes(C.symbols(spark, sf_dir)).select("id", "ordinal", "name")


for _kind in ("Calls", "ContainedIn", None):
    _where = f" WHERE kind = '{_kind}'" if _kind else ""
    query(GRAPH_SQL + " SELECT src, dst, kind FROM edges" + _where, {"Calls": "edges_calls", "ContainedIn": "edges_contained", None: "edges_all"}[_kind])(
        lambda spark, sf_dir, kind=_kind: (lambda e: e if kind is None else e.where(F.col("kind") == kind))(_graph(spark, sf_dir)[2])
    )
for _side, _a, _b in (("graph_callees", "src", "dst"), ("graph_callers", "dst", "src")):
    query(GRAPH_SQL + f" SELECT e.{_a} AS id, e.{_b} AS neighbour FROM edges e JOIN nodes n ON e.{_a} = n.id", _side)(
        lambda spark, sf_dir, out=_side == "graph_callees": (lambda g: graph.neighbours(g[2], g[1].select("id"), out))(_graph(spark, sf_dir))
    )


@query(GRAPH_SQL + " SELECT n.id, coalesce(o.c, 0) AS n_out, coalesce(i.c, 0) AS n_in FROM nodes n LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY 1) o ON n.id = o.src LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY 1) i ON n.id = i.dst")
def graph_degree(spark, sf_dir):
    _, n, e = _graph(spark, sf_dir)
    return graph.degrees(n, e)


@query(GRAPH_SQL + " SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE file_path = 'src3.py') AND dst NOT IN (SELECT id FROM nodes WHERE file_path = 'src3.py')")
def graph_remove_file(spark, sf_dir):
    _, n, e = _graph(spark, sf_dir)
    return graph.remove_file(n, e, "src3.py")[1]


@query("""WITH RECURSIVE links AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
walk AS (SELECT 'o' || o_orderkey AS id, 0 AS depth FROM orders WHERE o_orderkey % 50 = 0
  UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN links l ON w.id = l.src WHERE w.depth < 3)
SELECT id, min(depth) AS depth FROM walk GROUP BY id""")
def graph_khop(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    link = lambda df, p, a, q, b: df.select(F.concat(F.lit(p), a).alias("src"), F.concat(F.lit(q), b).alias("dst"))
    links = link(t("customer"), "c", "c_custkey", "n", "c_nationkey").unionByName(link(t("supplier"), "s", "s_suppkey", "n", "s_nationkey")).unionByName(link(t("nation"), "n", "n_nationkey", "r", "n_regionkey")).unionByName(link(t("orders"), "o", "o_orderkey", "c", "o_custkey"))
    return graph.reachable(links, t("orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id")), 3)


def _path_inputs(spark, sf_dir, queries: list[str]):
    s = cut(C.symbols(spark, sf_dir))
    n = cut(graph.nodes(s).drop("calls"))
    e = graph.call_edges(s, n).unionByName(graph.containment_edges(s, n))
    nodes_ = vectors.embedded(n.select("id", F.concat_ws(" ", "name", "body").alias("b")), "b")
    asked = vectors.embedded(spark.createDataFrame(list(enumerate(queries)), "query long, text string"), "text", "qv")
    return n, nodes_, e, asked


@query()
def path_search(spark, sf_dir):
    _, nodes_, e, asked = _path_inputs(spark, sf_dir, ["return class it", "def if u f"])
    return paths.search(nodes_, e, asked, 5)


@query()
def path_search_teleport(spark, sf_dir):
    _, nodes_, e, asked = _path_inputs(spark, sf_dir, ["class C"])
    return paths.search(nodes_, e.where("kind = 'Calls'"), asked, 5, 1)


def _formatted(spark, sf_dir, how):
    n, nodes_, e, asked = _path_inputs(spark, sf_dir, ["return class it"])
    named = n.select(F.col("id").alias("symbol_id"), "name", "file_path", "body")
    found = parse.with_skeleton(named.join(F.broadcast(cut(paths.search(nodes_, e, asked, 2))), "symbol_id")).orderBy("path_rank", "pos").collect()
    out: dict[int, dict] = {}
    for r in found:
        node = {"symbol_id": r["symbol_id"], "name": r["name"], "kind": "function", "file_path": r["file_path"], "line_range": (0, r["body"].count("\n")), "body": r["body"], "skeleton": r["skeleton"], "relevance": r["relevance"]}
        out.setdefault(r["path_rank"], {"score": r["score"], "nodes": []})["nodes"].append(node)
    return spark.createDataFrame([(how([out[k] for k in sorted(out)], 1),)], "text string")


@query()
def format_text(spark, sf_dir):
    return _formatted(spark, sf_dir, formatting.as_text)


@query()
def format_json(spark, sf_dir):
    return _formatted(spark, sf_dir, formatting.as_json)


_LINES = "CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END"


@query(rf"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents),
w AS (SELECT doc_id, l, unnest(range(0, greatest(ceil((len(l) - 40) / 20.0), 0)::BIGINT + 1)) AS i FROM l)
SELECT doc_id, i::INTEGER AS chunk_no, array_to_string(l[i * 20 + 1 : i * 20 + 40], chr(10)) AS content FROM w WHERE regexp_matches(content, '\S')""")
def chunk_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.inline(T.chunks(F.col("text"))))


_EMBED = "(SELECT list_transform(range(64), lambda d: len(list_filter(list_transform(regexp_extract_all({t}, '[A-Z]?[a-z]+|[A-Z]+'), lambda w: ('0x' || md5(lower(w))[1:8])::BIGINT % 64), lambda b: b = d))::DOUBLE))"


@query(f"""WITH c AS MATERIALIZED (SELECT 'd' || doc_id AS file_path, chunk_no, {_EMBED.format(t='content')} AS v FROM ({{chunks}})),
q AS (SELECT item_id AS query, {_EMBED.format(t='text')} AS qv FROM benchmark WHERE item_id % 50 = 0)
SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, file_path, chunk_no)::INTEGER AS rank, file_path, chunk_no, score
  FROM (SELECT query, file_path, chunk_no, {_cos('v', 'qv')} AS score FROM c, q)) WHERE rank <= 10""".replace("{chunks}", ORACLES["chunk_lines"]))
def rag_search(spark, sf_dir):
    c = chunk_lines(spark, sf_dir).withColumn("file_path", F.concat(F.lit("d"), "doc_id"))
    asked = vectors.embedded(table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text"), "text", "qv")
    return vectors.chunk_search(vectors.embedded(c, "content"), asked.select("query", "qv"), 10)


@query("SELECT doc_id, strlen(text) // 3 AS tokens, CASE WHEN length(text) > 32000 THEN length(left(text, 32000) || '...') ELSE length(text) END AS shown FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), F.char_length(T.capped(F.col("text"))).cast("long").alias("shown"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 32000 THEN left(text, 32000) || '...' ELSE text END) AS shown FROM documents")
def body_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.capped(F.col("text")).cast("binary")).alias("shown"))


@query()
def needles(spark, sf_dir):
    def run(texts):
        return texts.map(lambda t: T.needles(t or ""))

    import pandas as pd

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.pandas_udf(run, "array<string>")("text").alias("needles"))


@query(f"SELECT doc_id FROM documents WHERE {' OR '.join(f'contains(text, {chr(39)}{n}{chr(39)})' for n in NEEDLES)} ORDER BY doc_id LIMIT 50")
def text_search_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where(T.contains_any(F.col("text"), list(NEEDLES))).select("doc_id").orderBy("doc_id").limit(50)


@query(rf"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS text, generate_subscripts({_LINES}, 1) AS line FROM documents)
SELECT doc_id, line::INTEGER AS line, text FROM l WHERE {' OR '.join(f"contains(lower(text), '{n.lower()}')" for n in NEEDLES)} ORDER BY doc_id, line LIMIT 250""")
def text_search_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.inline(T.matching_lines(F.col("text"), list(NEEDLES)))).orderBy("doc_id", "line").limit(250)


@query(rf"SELECT page_id, raw, regexp_replace(regexp_replace(replace(trim(raw), chr(92), '/'), '^(\./)+', ''), '^/+', '') AS path FROM {C.RAW_PATHS}")
def path_normalize(spark, sf_dir):
    return values(spark, sf_dir, C.RAW_PATHS).select("page_id", "raw", T.normal_path(F.col("raw")).alias("path"))


@query(f"SELECT DISTINCT o.case_id, o.file FROM (SELECT * FROM {C.ORACLE}) o JOIN (SELECT * FROM {C.RETRIEVED}) r ON o.case_id = r.case_id AND (o.file = r.file OR ends_with(o.file, '/' || r.file) OR ends_with(r.file, '/' || o.file))")
def path_suffix_join(spark, sf_dir):
    return evaluation.matched(values(spark, sf_dir, C.ORACLE), values(spark, sf_dir, C.RETRIEVED)).select("case_id", "file")


@query(f"WITH m AS (SELECT DISTINCT o.case_id, o.file FROM (SELECT * FROM {C.ORACLE}) o JOIN (SELECT * FROM {C.RETRIEVED}) r ON o.case_id = r.case_id AND (o.file = r.file OR ends_with(o.file, '/' || r.file) OR ends_with(r.file, '/' || o.file))) SELECT o.case_id, round(count(m.file) / count(*), 6) AS recall, count(m.file) > 0 AS hit FROM (SELECT * FROM {C.ORACLE}) o LEFT JOIN m ON o.case_id = m.case_id AND o.file = m.file GROUP BY 1")
def recall_at_k(spark, sf_dir):
    return evaluation.recall(values(spark, sf_dir, C.ORACLE), values(spark, sf_dir, C.RETRIEVED))


_RANK = "list_sort(list({v}))[floor({p} * (count({v}) - 1) + 0.5)::BIGINT + 1]"


@query(f"SELECT method, count(*) AS runs, round(avg(retrieval_ms), 6) AS mean_ms, {_RANK.format(v='retrieval_ms', p=0.5)}::DOUBLE AS median_ms, {_RANK.format(v='retrieval_ms', p=0.95)}::DOUBLE AS p95_ms, sum(prompt_tokens)::BIGINT AS prompt_tokens, round(avg(oracle_hit::INT), 6) AS hit_rate, round(avg(recall), 6)::DOUBLE AS mean_recall FROM (SELECT case_id, method, retrieval_ms::DOUBLE AS retrieval_ms, prompt_tokens, oracle_hit, recall::DOUBLE AS recall FROM {C.RECORDS}) GROUP BY 1")
def bench_summary(spark, sf_dir):
    return evaluation.summary(values(spark, sf_dir, C.RECORDS))


@query(f"SELECT event_type, {_RANK.format(v='value', p=0.95)} AS p_value FROM events GROUP BY 1")
def nearest_rank(spark, sf_dir):
    return evaluation.nearest_rank_by(table(spark, sf_dir, "events"), "event_type", "value", 95)


@query(f"WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY path_rank, pos) AS rn FROM {C.PATHS}) WHERE rn = 1), s AS (SELECT symbol_id, (sum(tokens) OVER (ORDER BY path_rank, pos ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS before FROM f) SELECT * FROM s WHERE before < 16384")
def context_budget(spark, sf_dir):
    return paths.context_within(values(spark, sf_dir, C.PATHS)).select("symbol_id", "before")


@query(f"WITH p AS (SELECT *, count(*) OVER (PARTITION BY path_rank) AS n, row_number() OVER (PARTITION BY path_rank ORDER BY relevance DESC, pos) AS r FROM {C.PATHS}) SELECT path_rank, pos, CASE WHEN n <= 2 THEN true ELSE pos = n - 1 OR pos = n // 2 END AS two, CASE WHEN n <= 4 THEN true ELSE r <= 4 END AS four FROM p")
def full_body_select(spark, sf_dir):
    got = paths.full_bodies(values(spark, sf_dir, C.PATHS), 2).withColumnRenamed("full", "two")
    return paths.full_bodies(got, 4).select("path_rank", "pos", "two", F.col("full").alias("four"))


@query(f"SELECT instance_id, array_to_string(list_filter(list_distinct_ordered, lambda p: p <> '' AND p <> 'dev/null'), ',') AS files FROM (SELECT instance_id, list_transform(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '+++ b/')), lambda x: x[7:]) AS list_distinct_ordered FROM {C.PATCHES})")
def patch_files(spark, sf_dir):
    return values(spark, sf_dir, C.PATCHES).select("instance_id", F.array_join(T.patch_files(F.col("patch")), ",").alias("files"))


_DIFF = """(SELECT DISTINCT instance_id, file, side, line FROM (
  SELECT instance_id, raw, last_value(CASE WHEN starts_with(raw, '+++ b') THEN ltrim(raw[7:], '/') END IGNORE NULLS) OVER (PARTITION BY instance_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS file,
    CASE WHEN starts_with(raw, '+++') OR starts_with(raw, '---') THEN NULL WHEN starts_with(raw, '+') THEN 'added' WHEN starts_with(raw, '-') THEN 'removed' END AS side, trim(raw[2:]) AS line
  FROM (SELECT instance_id, unnest(string_split(patch, chr(10))) AS raw, generate_subscripts(string_split(patch, chr(10)), 1) AS pos FROM {t})) WHERE file IS NOT NULL AND side IS NOT NULL AND line <> '')"""


@query("SELECT * FROM " + _DIFF.format(t=C.PATCHES))
def diff_lines(spark, sf_dir):
    return evaluation.diff_lines(values(spark, sf_dir, C.PATCHES))


@query(f"WITH a AS {_DIFF.format(t=C.PATCHES)}, b AS {_DIFF.format(t=C.GOLD)} SELECT p.instance_id, CASE WHEN trim(p.patch) = '' THEN 'empty' WHEN NOT EXISTS (SELECT 1 FROM a JOIN b USING (instance_id, file) WHERE a.instance_id = p.instance_id) THEN 'no_file_overlap' WHEN EXISTS (SELECT 1 FROM a JOIN b USING (instance_id, file, side, line) WHERE a.instance_id = p.instance_id) THEN 'line_overlap' ELSE 'file_overlap_only' END AS verdict FROM (SELECT * FROM {C.PATCHES}) p WHERE p.instance_id IN (SELECT instance_id FROM {C.GOLD})")
def diff_verdict(spark, sf_dir):
    return evaluation.verdicts(values(spark, sf_dir, C.PATCHES), values(spark, sf_dir, C.GOLD))


@query(f"SELECT instance_id, trim(patch) = '' AS is_empty, len(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))::INTEGER AS n_added, len(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')))::INTEGER AS n_removed, len(list_distinct(list_transform(list_filter(l, lambda x: starts_with(x, '+++ b/') OR starts_with(x, '--- a/')), lambda x: x[7:])))::INTEGER AS n_files FROM (SELECT *, string_split(patch, chr(10)) AS l FROM {C.PATCHES})")
def patch_stats(spark, sf_dir):
    return evaluation.patch_stats(values(spark, sf_dir, C.PATCHES))


@query(f"SELECT k, CASE WHEN f THEN d ELSE output END AS zero_shot, CASE WHEN f THEN d ELSE '' END AS multi_turn FROM (SELECT k, output, strpos(output, '```diff') > 0 AS f, split_part(split_part(output, '```diff' || chr(10), 2), chr(10) || '```', 1) AS d FROM {C.OUTPUTS})")
def extract_diff(spark, sf_dir):
    return values(spark, sf_dir, C.OUTPUTS).select("k", T.fenced_diff(F.col("output"), True).alias("zero_shot"), T.fenced_diff(F.col("output"), False).alias("multi_turn"))


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def predictions_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"SELECT instance_id FROM {C.SCORES} WHERE is_xy_problem AND keyword_overlap <= 3 AND logical_distance >= 7")
def xy_qualify(spark, sf_dir):
    return values(spark, sf_dir, C.SCORES).where(evaluation.qualifies()).select("instance_id")


@query(f"WITH b AS (UNPIVOT (SELECT * FROM {C.BEFORE}) ON latency, hit_rate INTO NAME metric VALUE v), a AS (UNPIVOT (SELECT * FROM {C.AFTER}) ON latency, hit_rate INTO NAME metric VALUE v), j AS (SELECT coalesce(b.method, a.method) AS method, coalesce(b.metric, a.metric) AS metric, coalesce(b.v, 0) AS before, coalesce(a.v, 0) AS after FROM b FULL JOIN a ON b.method = a.method AND b.metric = a.metric) SELECT *, round(after - before, 6) AS delta, CASE WHEN before = 0 THEN 0 ELSE round((after - before) / before * 100, 6) END AS pct FROM j")
def report_delta(spark, sf_dir):
    return evaluation.report_delta(values(spark, sf_dir, C.BEFORE), values(spark, sf_dir, C.AFTER), ["latency", "hit_rate"])


@query(f"SELECT method, {', '.join(f'max(hit_rate) FILTER (suite = {chr(39)}{x}{chr(39)}) AS {x}' for x in SUITES)}, round(avg(hit_rate) FILTER (suite IN ('de', 'en', 'es', 'fr')), 6) AS mean FROM {C.RATES} GROUP BY 1")
def report_grid(spark, sf_dir):
    return evaluation.report_grid(values(spark, sf_dir, C.RATES), list(SUITES))


@query("SELECT role AS tool, sum(turn + 1)::BIGINT AS calls FROM conversations GROUP BY 1")
def tool_call_totals(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role is not null")
    return evaluation.tool_totals(c.select(F.create_map("role", F.col("turn") + 1).alias("tool_calls")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source")
def repo_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


SOURCES = (
    ("src/main.rs", "use crate::auth;\n\npub fn main() {\n    let user = login();\n    serve(user);\n}\n\nfn serve(u: User) {\n    run(u)\n}\n\nfn run(u: User) {}\n"),
    ("src/auth.rs", "impl Session<T> {\n    pub fn new() -> Self { make() }\n}\n\npub fn login() -> User { check() }\nfn check() {}\n"),
    ("app/__init__.py", "import os\n\nclass Store:\n    def get(self):\n        return load()\n\n    def put(self, x):\n        save(x)\n\ndef load():\n    return Store()\n"),
    ("web/a.ts", "import x from 'y';\nexport const handle = (a) => { return render(a); };\nfunction render(a) { return a }\nclass View { draw() { return render(1) } }\n"),
)


@query()
def parse_symbols(spark, sf_dir):
    return parse.symbols(spark.createDataFrame(SOURCES, "path string, content string")).drop("byte_range")


@query()
def parse_imports(spark, sf_dir):
    return parse.imports(spark.createDataFrame(SOURCES, "path string, content string"))


@query(GRAPH_SQL + " SELECT id, body, split_part(body, chr(10), 1) AS skeleton FROM nodes")
def skeleton(spark, sf_dir):
    return parse.with_skeleton(graph.nodes(C.symbols(spark, sf_dir)).select("id", "body"))


@query()
def incremental_equals_rebuild(spark, sf_dir):
    """Edges after a file is changed and one deleted, less those of a rebuild: none, so both counts are 0."""
    from .streaming.incremental import replaced

    s = C.symbols(spark, sf_dir)
    fresh = s.where("file_path = 'src1.py'").withColumn("calls", F.slice("calls", 1, 1))
    updated = replaced(s, fresh, ["src1.py", "src2.py"])
    rebuilt = s.where("file_path not in ('src1.py', 'src2.py')").unionByName(fresh)
    a, b = graph.build(updated)[1], graph.build(rebuilt)[1]
    count = lambda x, y, n: x.exceptAll(y).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), "n")
    return count(a, b, "only_updated").unionByName(count(b, a, "only_rebuilt"))


ORACLES["incremental_equals_rebuild"] = "SELECT * FROM (VALUES ('only_updated', 0::BIGINT), ('only_rebuilt', 0::BIGINT)) AS t(side, n)"


# Assembly of contexts.
_KEPT = """(SELECT *, pos = n - 1 AS last FROM (SELECT *, row_number() OVER (PARTITION BY path_rank, pos > 0 AND pos < n - 1 ORDER BY relevance DESC, pos DESC) AS best FROM
 (SELECT *, count(*) OVER (PARTITION BY path_rank) AS n FROM {t})) WHERE NOT (pos > 0 AND pos < n - 1) OR best = 1)""".replace("{t}", C.PATHS)


@query(f"SELECT path_rank, pos, symbol_id, last FROM {_KEPT}")
def context_nodes(spark, sf_dir):
    return paths.kept_nodes(values(spark, sf_dir, C.PATHS)).select("path_rank", "pos", "symbol_id", "last")


@query(f"WITH k AS (SELECT path_rank, pos, symbol_id, CASE WHEN last THEN body_tokens ELSE skeleton_tokens END AS tokens FROM {_KEPT}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY path_rank, pos) AS rn FROM k) WHERE rn = 1) SELECT path_rank, pos, symbol_id, tokens, before FROM (SELECT *, (sum(tokens) OVER (ORDER BY path_rank, pos ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS before FROM f) WHERE before < 16384")
def context_assembly(spark, sf_dir):
    return paths.assembled(values(spark, sf_dir, C.PATHS)).select("path_rank", "pos", "symbol_id", "tokens", "before")


@query(f"WITH f AS (SELECT * FROM (SELECT path_rank % 5 AS query, *, row_number() OVER (PARTITION BY path_rank % 5, symbol_id ORDER BY path_rank, pos) AS rn FROM {C.PATHS}) WHERE rn = 1), t AS (SELECT query, string_agg(body, chr(10) || chr(10) ORDER BY path_rank, pos) AS x FROM f GROUP BY query) SELECT query::BIGINT AS query, CASE WHEN length(x) > 300 THEN x[1:300] || chr(10) || '... (truncated)' ELSE x END AS text FROM t")
def whole_bodies(spark, sf_dir):
    return paths.whole_bodies(values(spark, sf_dir, C.PATHS).withColumn("query", (F.col("path_rank") % 5).cast("long")), 300)


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN md5(text[1:1000] || chr(10) || '... (truncated)') ELSE md5(text) END AS shown FROM documents")
def truncate_output(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncated(F.col("text"), 1000).cast("binary")).alias("shown"))


# Graph and store look-ups.
@query(GRAPH_SQL + " SELECT id, name, file_path FROM nodes WHERE id IN (SELECT id FROM symbols WHERE ordinal % 50 = 0)")
def node_by_id(spark, sf_dir):
    s = C.symbols(spark, sf_dir)
    return graph.by_id(graph.nodes(s), s.where("ordinal % 50 = 0").select("id")).select("id", "name", "file_path")


@query(GRAPH_SQL + " SELECT (SELECT count(*) FROM (SELECT DISTINCT file_path FROM symbols)) AS files_indexed, (SELECT count(*) FROM nodes) AS symbols_indexed")
def index_counts(spark, sf_dir):
    s = C.symbols(spark, sf_dir)
    return graph.index_counts(s.select("file_path").distinct(), graph.nodes(s))


@query(GRAPH_SQL + " SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)) AS n_alone")
def graph_size(spark, sf_dir):
    _, n, e = _graph(spark, sf_dir)
    d = graph.degrees(n, e)
    return d.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n_out").alias("n_edges"), F.count_if((F.col("n_out") == 0) & (F.col("n_in") == 0)).alias("n_alone"))


@query("SELECT d.doc_id AS vec_id, e.vec_id IS NOT NULL AS contained, (SELECT count(*) FROM embeddings) AS stored FROM (SELECT DISTINCT doc_id * 3 AS doc_id FROM documents) d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def vector_facts(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("vec_id"))
    return vectors.store_facts(_emb(spark, sf_dir), asked, "vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 1")
def dimension_filter(spark, sf_dir):
    e = _emb(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 4 == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    return vectors.dimension_ok(e, 64).select("vec_id")


@query(GRAPH_SQL + """ SELECT n.id, row_number() OVER (ORDER BY s.score DESC, n.id)::INTEGER AS rank, s.score FROM
  (SELECT id, score FROM (SELECT n.id, """ + _cos("e.embedding", _Q0) + """ AS score FROM nodes n JOIN embeddings e ON n.ordinal = e.vec_id) ORDER BY score DESC, id LIMIT 10) s JOIN nodes n ON n.id = s.id""")
def chunk_nodes(spark, sf_dir):
    """Top symbols without the graph, as one-node paths: the vectors' top k joined with the nodes."""
    n, e = graph.nodes(C.symbols(spark, sf_dir)), _emb(spark, sf_dir)
    held = n.join(e, F.col("ordinal") == F.col("vec_id")).select("id", F.col("embedding").alias("vector"))
    best = vectors.top_k_each(held, e.where("vec_id = 0").select(F.lit(0).cast("long").alias("query"), F.col("embedding").alias("qv")), 10)
    return best.join(n.select("id"), "id").select("id", "rank", "score")


_CACHE = "SELECT doc_id, 'f' || doc_id AS file_path, n_chars % 3 AS mtime, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'x' END AS content, CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 3 END AS size FROM documents"


def _chunk_cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("f"), "doc_id").alias("file_path")
    size = F.when(F.col("doc_id") % 8 == 0, 2).otherwise(3)
    cache = d.select(path, F.lit(0).alias("chunk_no"), F.when(F.col("doc_id") % 9 == 0, "").otherwise("x").alias("content"), F.array_repeat(F.lit(1.0), size).alias("vector"), (F.col("n_chars") % 3).alias("mtime"))
    files = d.where("doc_id % 10 <> 3").select(path.alias("path"), F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("n_chars") % 3).alias("mtime"))
    return vectors.stale_chunks(cache, files, 3)


@query(f"SELECT file_path FROM ({_CACHE}) WHERE content <> '' AND size = 3 AND doc_id % 10 <> 3 AND doc_id % 7 <> 0")
def chunk_cache_valid(spark, sf_dir):
    return _chunk_cache(spark, sf_dir)[0].select("file_path")


@query(f"SELECT file_path AS path FROM ({_CACHE}) WHERE doc_id % 10 <> 3 AND NOT (content <> '' AND size = 3 AND doc_id % 7 <> 0)")
def chunk_cache_missing(spark, sf_dir):
    return _chunk_cache(spark, sf_dir)[1].select("path")


# Paths, files and small functions.
_EXT = "regexp_extract(path, '\\.([^./]+)$', 1)"
_FILES = "(SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '.git/' WHEN page_id % 9 = 1 THEN 'a/.b/' ELSE 'src/' END || 'm' || page_id || '.' || ['rs', 'py', 'js', 'jsx', 'ts', 'tsx', 'txt', 'PY'][page_id % 8 + 1] AS path FROM pages)"


def _files(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, ("rs", "py", "js", "jsx", "ts", "tsx", "txt", "PY"))), F.col("page_id") % 8)
    folder = F.when(F.col("page_id") % 9 == 0, ".git/").when(F.col("page_id") % 9 == 1, "a/.b/").otherwise("src/")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.lit("m"), "page_id", F.lit("."), ext).alias("path"))


@query(f"SELECT page_id, path, CASE {_EXT} WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' ELSE 'typescript' END AS language FROM {_FILES} WHERE page_id % 9 > 1 AND {_EXT} IN ('rs', 'py', 'js', 'jsx', 'ts', 'tsx')")
def visible_files(spark, sf_dir):
    from .sources.files import visible

    return visible(_files(spark, sf_dir)).withColumn("language", T.language(F.col("path")))


@query("SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM (SELECT doc_id::VARCHAR AS path, n_chars AS mtime FROM documents WHERE doc_id % 5 <> 0) o FULL JOIN (SELECT doc_id::VARCHAR AS path, n_chars + (doc_id % 3 = 0)::INT AS mtime FROM documents WHERE doc_id % 7 <> 0) n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.mtime <> n.mtime")
def listing_changes(spark, sf_dir):
    from .streaming.incremental import changes

    d, path = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string").alias("path")
    return changes(d.where("doc_id % 5 <> 0").select(path, F.col("n_chars").alias("mtime")), d.where("doc_id % 7 <> 0").select(path, (F.col("n_chars") + (F.col("doc_id") % 3 == 0).cast("int")).alias("mtime")))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents WHERE text IS NOT NULL")
def squeeze_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.squeezed(F.col("text")).cast("binary")).alias("squeezed"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN regexp_replace(url[9:], '^/+', '') ELSE url END AS path FROM pages WHERE url IS NOT NULL")
def path_relative(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", T.relative_path(F.col("url"), "https:/").alias("path"))


@query("SELECT vec_id, printf('%.4f', score + 1e-9) AS shown FROM (SELECT vec_id, " + _cos("embedding", _Q0) + " AS score FROM embeddings)")
def score_format(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return vectors.similarity(e, e.where("vec_id = 0").select("embedding").scalar(), e.select("vec_id"), "vec_id", "embedding").select("vec_id", F.format_string("%.4f", F.col("score") + 1e-9).alias("shown"))


# Evaluation.
@query(f"SELECT method, round(avg(oracle_hit::INT) * 100, 4) AS hit_pct, round(avg(recall) * 100, 4) AS recall_pct, round(sum(prompt_tokens) / count(*), 4) AS tokens_a_run, (sum(prompt_tokens) - sum(skeleton_tokens))::BIGINT AS body_tokens, sum(skeleton_tokens)::BIGINT AS skeleton_tokens FROM {C.RECORDS} GROUP BY 1")
def derived_metrics(spark, sf_dir):
    return evaluation.derived_metrics(values(spark, sf_dir, C.RECORDS))


@query(f"WITH r AS (SELECT * FROM {C.RECORDS}) SELECT 'metadata' AS part, '' AS key, count(DISTINCT case_id)::VARCHAR || '/' || count(*)::VARCHAR AS said FROM r UNION ALL SELECT 'summary', method, count(*)::VARCHAR || '/' || sum(prompt_tokens)::VARCHAR FROM r GROUP BY method UNION ALL SELECT 'records', case_id || '/' || method, prompt_tokens::VARCHAR || '/' || oracle_hit::VARCHAR FROM r")
def report_parts(spark, sf_dir):
    got = evaluation.report(values(spark, sf_dir, C.RECORDS), "documents", 10)
    pick = {"metadata": ("cases", "records"), "summary": ("runs", "prompt_tokens"), "records": ("prompt_tokens", "oracle_hit")}
    said = F.coalesce(*[F.when(F.col("part") == k, F.concat_ws("/", *(F.get_json_object("json", f"$.{x}") for x in v))) for k, v in pick.items()])
    return got.select("part", "key", said.alias("said"))


@query(f"SELECT path, created, suite, suite || CASE WHEN n > 1 THEN ' #' || n ELSE '' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY created, path) AS n FROM (SELECT *, lower(regexp_replace(regexp_extract(path, '([^/]+)/?$', 1), '\\.[^.]*$', '')) AS suite FROM {C.REPORTS}))")
def report_labels(spark, sf_dir):
    return evaluation.labelled(values(spark, sf_dir, C.REPORTS))


_STATS = f"(SELECT instance_id, method, trim(patch) = '' AS is_empty, len(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS n_added, len(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS n_removed, len(list_distinct(list_transform(list_filter(l, lambda x: starts_with(x, '+++ b/') OR starts_with(x, '--- a/')), lambda x: x[7:]))) AS n_files FROM (SELECT *, string_split(patch, chr(10)) AS l FROM {C.PATCHES}))"


@query(f"SELECT method, count(*) FILTER (NOT is_empty) AS valid, count(*) FILTER (is_empty) AS empty, coalesce(median(n_added) FILTER (NOT is_empty), 0) AS median_added, coalesce(median(n_removed) FILTER (NOT is_empty), 0) AS median_removed, count(*) FILTER (NOT is_empty AND n_files = 1) AS one_file, count(*) FILTER (NOT is_empty AND n_files = 2) AS two_files, count(*) FILTER (NOT is_empty AND n_files > 2) AS more_files FROM {_STATS} GROUP BY 1")
def patch_series(spark, sf_dir):
    p = values(spark, sf_dir, C.PATCHES)
    return evaluation.patch_series(evaluation.patch_stats(p).join(p.select("instance_id", "method"), "instance_id"))


@query(f"SELECT verdict, count(*) AS n FROM ({ORACLES['diff_verdict']}) GROUP BY 1")
def verdict_counts(spark, sf_dir):
    return evaluation.verdict_counts(diff_verdict(spark, sf_dir))


_OK = "is_xy_problem AND keyword_overlap <= 3 AND logical_distance >= 7"


@query(f"SELECT * EXCLUDE rn FROM (SELECT instance_id, is_xy_problem, keyword_overlap, logical_distance, row_number() OVER (PARTITION BY instance_id ORDER BY position) AS rn FROM {C.SCORES} WHERE {_OK}) JOIN (SELECT * EXCLUDE (k, ordinal) FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY ordinal) AS k FROM {C.CASES}) WHERE k = 1) USING (instance_id) WHERE rn = 1")
def curated_cases(spark, sf_dir):
    return evaluation.curated(values(spark, sf_dir, C.SCORES), values(spark, sf_dir, C.CASES))


@query(f"SELECT count(*) AS scored, count(*) FILTER ({_OK}) AS qualified, count(*) FILTER (NOT ({_OK})) AS rejected, count(*) FILTER (instance_id IN (SELECT instance_id FROM {C.CASES})) AS known, least(count(*) FILTER ({_OK}), 20) AS taken FROM {C.SCORES}")
def curation_counts(spark, sf_dir):
    return evaluation.curation_counts(values(spark, sf_dir, C.SCORES), values(spark, sf_dir, C.CASES), 20)


@query(f"WITH a AS (SELECT DISTINCT instance_id FROM {C.SCORES}), b AS (SELECT DISTINCT instance_id FROM {C.CASES}) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (instance_id)) AS n_both")
def id_overlap(spark, sf_dir):
    return evaluation.id_overlap(values(spark, sf_dir, C.SCORES), values(spark, sf_dir, C.CASES), "instance_id")


@query("SELECT count(*) AS total, count(*) FILTER (patch <> '') AS completed, count(*) FILTER (patch = '') AS failed, round(avg(length(patch)), 6) AS mean_calls, round(avg(length(instance_id)), 6) AS mean_prompt, round(avg(length(method)), 6) AS mean_completion FROM " + C.PATCHES)
def run_metrics(spark, sf_dir):
    p = values(spark, sf_dir, C.PATCHES)
    return evaluation.run_metrics(p.select(F.col("patch").alias("model_patch"), F.length("patch").alias("n_calls"), F.length("instance_id").alias("prompt_tokens"), F.length("method").alias("completion_tokens")))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY ALL")
def repo_filter(spark, sf_dir):
    """Rows of one repository, as the feature: an equality filter."""
    return table(spark, sf_dir, "documents").where("source = 'src3'").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
