"""Inputs of the registered queries: a code corpus made from the documents table, and tables of cases, records, patches and paths
derived from the sample tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import calls

#: One symbol row per document and one class row per file: unique and ambiguous names, duplicate ids, keyword pseudo-calls.
CORPUS = """
SELECT *, concat(file_path, '::', CASE WHEN parent_scope IS NOT NULL THEN concat(parent_scope, '::') ELSE '' END, name) AS id FROM (
  SELECT doc_id AS ordinal, concat(source, '.py') AS file_path,
         CASE WHEN doc_id % 3 = 0 THEN concat('u', cast(doc_id AS string)) ELSE concat('f', cast(doc_id % 37 AS string)) END AS name,
         concat('def it():', chr(10), '    if (u', cast((doc_id * 7 + 3) % n AS string), '()): u', cast((doc_id * 7 + 3) % n AS string), '()', chr(10),
                '    return f', cast((doc_id * 5 + 1) % 37 AS string), ' ()') AS body,
         CASE WHEN doc_id % 11 = 0 THEN 'C' END AS parent_scope
  FROM {documents}, (SELECT count(*) AS n FROM {documents})
  UNION ALL
  SELECT DISTINCT -1 AS ordinal, concat(source, '.py'), 'C', 'class C:', CAST(NULL AS string) FROM {documents}
) t
"""
CORPUS_SQL = CORPUS.replace("{documents}", "documents")
SYMBOLS_SQL = rf"""symbols AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(body, '([a-zA-Z_]\w*)\s*\(', 1), lambda x: x <> name))) AS calls FROM ({CORPUS_SQL}))"""
NODES_SQL = "nodes AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM symbols) WHERE rn = 1)"
EDGES_SQL = """unique_names AS (SELECT name, count(*) AS c FROM nodes GROUP BY name),
made AS (SELECT id AS src, file_path, unnest(calls) AS callee FROM symbols),
edges AS (
  SELECT m.src, n.id AS dst, 'Calls' AS kind FROM made m JOIN nodes n ON m.callee = n.name JOIN unique_names u ON u.name = n.name
  WHERE m.src <> n.id AND (m.file_path = n.file_path OR u.c = 1)
  UNION ALL
  SELECT s.id, n.id, 'ContainedIn' FROM symbols s JOIN nodes n ON s.parent_scope = n.name)"""
GRAPH_SQL = f"WITH RECURSIVE {SYMBOLS_SQL}, {NODES_SQL}, {EDGES_SQL}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CORPUS, documents=table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.withColumn("calls", calls(F.col("body"), F.col("name")))


NAMES = ("documents", "labels", "pages", "benchmark", "conversations", "events", "embeddings")


def values(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A table of this module: its SQL names the sample tables in braces."""
    return spark.sql(f"SELECT * FROM {sql}", **{n: table(spark, sf_dir, n) for n in NAMES if f"{{{n}}}" in sql})


def plain(sql: str) -> str:
    """The SQL with the sample tables' names for the other engine."""
    for n in NAMES:
        sql = sql.replace(f"{{{n}}}", n)
    return sql


_J = "{documents} d JOIN {labels} l ON d.doc_id = l.doc_id"
RECORDS = f"""(SELECT concat('c', cast(d.doc_id AS string)) AS case_id, d.source AS method, cast(d.n_chars AS double) / 8 AS retrieval_ms, cast(d.n_chars AS bigint) AS prompt_tokens,
 cast(floor(d.n_chars / 4) AS bigint) AS skeleton_tokens, l.quality = 1 AS oracle_hit, cast(l.quality AS double) / (1 + d.doc_id % 4) AS recall FROM {_J}) AS records"""
_URL = "(SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages})"
#: Oracle files are urls as paths; retrieved ones their last two parts, those of another page, or the whole.
ORACLE = f"(SELECT concat('c', cast(page_id % 97 AS string)) AS case_id, rest AS file FROM {_URL} WHERE rest <> '') AS oracle"
RETRIEVED = rf"""(SELECT concat('c', cast((page_id + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END) % 97 AS string)) AS case_id,
 CASE WHEN page_id % 2 = 0 THEN regexp_extract(rest, '[^/]*/[^/]*$', 0) ELSE rest END AS file FROM {_URL} WHERE rest <> '') AS retrieved"""
_NL = "chr(10)"
PATCHES = f"""(SELECT concat('i', cast(doc_id AS string)) AS instance_id, source AS method, CASE WHEN doc_id % 7 = 0 THEN '' ELSE
 concat('--- a/', lang, '/', source, '.py', {_NL}, '+++ b/', lang, '/', source, '.py', {_NL}, '@@ -1 +1 @@', {_NL}, '+x = ', cast(n_chars % 5 AS string), {_NL}, '-y = ', cast(doc_id % 3 AS string), {_NL}, ' same',
 CASE WHEN doc_id % 4 = 0 THEN concat({_NL}, '--- a/old', cast(doc_id % 9 AS string), '.py', {_NL}, '+++ b/m.py', {_NL}, '+  new line ') ELSE '' END) END AS patch FROM {{documents}}) AS patches"""
GOLD = f"""(SELECT concat('i', cast(d.doc_id AS string)) AS instance_id,
 concat('--- a/', d.lang, '/', d.source, '.py', {_NL}, '+++ b/', CASE WHEN l.toxic = 1 THEN 'other' ELSE d.lang END, '/', d.source, '.py', {_NL}, '+x = ', cast(d.doc_id % 5 AS string), {_NL}, '-y = ', cast((d.doc_id + l.quality) % 3 AS string)) AS patch FROM {_J}) AS gold"""
OUTPUTS = f"""(SELECT item_id AS k, CASE WHEN item_id % 4 = 0 THEN text WHEN item_id % 4 = 1 THEN concat(text, {_NL}, '```diff', {_NL}, '+++ b/a.py', {_NL}, '+', text, {_NL}, '```', {_NL}, 'after')
 WHEN item_id % 4 = 2 THEN concat('```diff', {_NL}, text, {_NL}, 'end') ELSE '' END AS output FROM {{benchmark}}) AS outputs"""
SCORES = """(SELECT concat('i', cast(doc_id AS string)) AS instance_id, quality = 1 AS is_xy_problem, cast(doc_id % 6 AS int) AS keyword_overlap, cast((doc_id + toxic) % 11 AS int) AS logical_distance, doc_id AS position FROM {labels}
 UNION ALL SELECT concat('i', cast(doc_id AS string)), quality = 1, 0, 10, doc_id + 1000000000 FROM {labels} WHERE doc_id % 5 = 0) AS scores"""
CASES = "(SELECT concat('i', cast(floor(doc_id / 2) * 2 AS bigint)) AS instance_id, source AS repo, n_chars, doc_id AS ordinal FROM {documents}) AS cases"
_RATE = "(SELECT d.source AS method, avg(cast(d.n_chars AS double)) AS latency, avg(cast(l.quality AS double)) AS hit_rate FROM {j} WHERE d.doc_id % 2 = {k} AND d.source <> '{without}' GROUP BY d.source) AS rates"
BEFORE, AFTER = (_RATE.replace("{j}", _J).replace("{k}", k).replace("{without}", w) for k, w in (("0", "src1"), ("1", "src2")))
RATES = f"(SELECT d.source AS method, d.lang AS suite, avg(cast(l.quality AS double)) AS hit_rate FROM {_J} GROUP BY d.source, d.lang) AS rates"
PATHS = """(SELECT cast(floor(doc_id / 6) AS int) AS path_rank, cast(doc_id % 6 AS int) AS pos, concat('s', cast((doc_id * 7 + n_chars) % 1009 AS string)) AS symbol_id, cast((doc_id * 37) % 11 AS double) / 10 AS relevance,
 cast(n_chars AS bigint) AS tokens, cast(n_chars AS bigint) AS body_tokens, cast(floor(n_chars / 5) AS bigint) AS skeleton_tokens, cast(doc_id AS string) AS body FROM {documents} WHERE n_chars IS NOT NULL AND doc_id % 13 <> 5) AS paths"""
RAW_PATHS = r"""(SELECT page_id, concat(CASE WHEN page_id % 3 = 0 THEN '  ./' WHEN page_id % 3 = 1 THEN '././' ELSE '//' END, CASE WHEN page_id % 5 = 0 THEN replace(url, '/', chr(92)) ELSE url END, ' ') AS raw FROM {pages} WHERE url IS NOT NULL) AS raw_paths"""
REPORTS = "(SELECT concat('runs/', CASE WHEN item_id % 2 = 0 THEN 'Sets/' ELSE '' END, 'Suite', cast(item_id % 7 AS string), CASE WHEN item_id % 3 = 0 THEN '.jsonl' ELSE '/' END) AS path, item_id AS created FROM {benchmark}) AS reports"
