"""Operator 6: quality rules, a threshold table compiled into one projection (no user functions, no shuffle).

`measures` turns a text into a struct of counts: words, their code points, symbols, lines that repeat an earlier line, words in
repeated three-word windows, stop words and upper-case letters. `RULES` lists (name, measure, unit, least, most): a document keeps
its place if each measure / unit lies between the bounds (None: no bound). All rules are one Boolean expression.

Repeated windows: each window's 64-bit hash and position are sorted within the row; a position counts if a neighbour
has the same hash; the words covered by such windows are added up in one pass over their sorted positions. The work is
n log n per document; nothing is exploded.

Cases: a null text has no words, all counts are 0 and it fails; lines are split at line feeds, and only lines with a word count
as repeats; equal rows are judged alike. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish without accents.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "ce", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "ou", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "als", "auf", "aus", "das", "dem", "den", "der", "die", "ein", "eine", "ich", "mit", "nicht", "sich", "sie", "und", "von", "zu",
    "como", "con", "del", "el", "las", "los", "no", "para", "por", "se", "su", "una", "y",
)
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
#: (name, measure, unit, least, most): least <= measure / unit <= most.
RULES = (
    ("word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols", "n_symbols", "n_words", None, 0.1),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 0.35),
    ("capitals", "n_capitals", "word_chars", None, 0.4),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in windows of `width` words which occur at least twice."""
    count = F.size(words) - (width - 1)
    window = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), i.alias("i")))

    def covered(ranked: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(ranked, j)["h"] == F.get(ranked, k)["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get(ranked, j)["i"]))
        first = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(places, first, lambda s, p: F.struct(p.alias("last"), (s["sum"] + F.least(F.lit(width), p - s["last"])).alias("sum")), lambda s: s["sum"])

    return F.when(count < 2, 0).otherwise(let(F.sort_array(window), covered))


def measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_capitals) of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    squeezed = lambda kept: F.octet_length(F.regexp_replace(text, kept, "")).cast("long")
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_window_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    ))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    all_ = F.octet_length(text).cast("long")
    counts = F.struct((all_ - squeezed(SYMBOLS)).alias("n_symbols"), (all_ - squeezed("[A-Z]")).alias("n_capitals"))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), counts.alias("c"))


def passes(rules=RULES) -> Column:
    """The threshold table as one expression over columns named like the measures; a unit of 0 passes."""
    ok = F.lit(True)
    for _, measure, unit, least, most in rules:
        if least is not None:
            ok = ok & (F.col(measure) >= F.lit(least) * F.col(unit))
        if most is not None:
            ok = ok & (F.col(measure) <= F.lit(most) * F.col(unit))
    return ok


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept of each document."""
    got = docs.select("doc_id", measures(F.col("text")).alias("m"))
    got = got.select("doc_id", "m.w.n_words", "m.w.word_chars", "m.c.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines", "m.w.n_stop_words", "m.c.n_capitals")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~failed & passes(rules))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def _sql_rules() -> str:
    out = []
    for _, measure, unit, least, most in RULES:
        out += [f"{measure} >= {least}::DOUBLE * {unit}"] * (least is not None) + [f"{measure} <= {most}::DOUBLE * {unit}"] * (most is not None)
    return " AND ".join(out)


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM g),
p AS (SELECT r, count(DISTINCT i + j) AS n FROM k, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY r),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
        length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(l)::BIGINT AS n_lines,
        len(list_filter(w.w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN p ON w.r = p.r)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words) AND {_sql_rules()} AS kept FROM m
"""
