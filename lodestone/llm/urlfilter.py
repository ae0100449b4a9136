"""Operator 9: URL filters: host and path rules, then exact membership in a block list by a Bloom filter cascade.

Rules (host, path, verdict): a rule fits its host and all subdomains if the url's path begins with the rule's; the longest
rule (host and path together) wins. Rules compile into one CASE expression.

Where no rule fits, a host is blocked if it is listed. The universe of keys is the set of all hosts of the corpus. Level 1 of
the cascade is a Bloom filter of the listed hosts; level 2 one of the hosts that aren't listed but pass level 1; level 3 one of
the listed that pass level 2, and so on until none passes. For every key of the universe the first level that it fails, or the
last level's parity, tells exactly whether it is listed; no join and no user function is needed. The filters' words are
aggregated by bit_or and enter the plan as scalar subqueries. Keys are divided by hash into ranges of about `RANGE_KEYS` listed ones,
each with a cascade of its own, and each range's rows are judged by a job of their own: whatever the list's size, no plan
holds more than one range's filters (`BITS` bits a listed key and level, some 5 MB).

The list is a parameter: a one-column frame of hosts. As no public list is at hand offline, the query's list is a stand-in: the hosts
whose MD5 begins with one of the hex digits 0 and 1.

Cases: a null url, or one without '://', has an empty host and path, fits no rule and is allowed (the empty host is never
listed); only A-Z is lower-cased; user information and ports stay part of the host; equal rows are judged alike; an empty
table gives no rows; an empty list blocks nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BITS, HASHES, RANGE_KEYS = 8, 4, 4_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    begin = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


class Bloom:
    """A Bloom filter over a column of keys: an array of words, aggregated natively and kept as a one-row table."""

    def __init__(self, keys: DataFrame, n: int, salt: int):
        self.words = max(1, -(-n * BITS // 64))
        self.salt = salt
        spark, key = keys.sparkSession, F.col(keys.columns[0])
        at = keys.select(F.explode(F.array(*self.places(key))).alias("p"))
        words = at.select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
        words = words.unionByName(spark.range(self.words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))).groupBy("w").agg(F.bit_or("b").alias("b"))
        sorted_ = F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"])
        self.table = staged(words.agg(sorted_.alias("words")), "bloom")

    def places(self, key: Column) -> list[Column]:
        # The salt comes first: keys that collide under one salt then don't under all.
        return [F.pmod(F.xxhash64(F.lit(self.salt * HASHES + j), key), F.lit(self.words * 64)) for j in range(HASHES)]

    def may_have(self, key: Column) -> Column:
        words, ok = self.table.scalar(), F.lit(True)
        for p in self.places(key):
            word = F.get(words, F.floor(p / 64).cast("int"))
            ok = ok & (F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return ok


class Cascade:
    """Exact membership of the universe's keys in the listed ones. listed: a Boolean column function of the key."""

    def __init__(self, universe: DataFrame):
        """universe: distinct keys (first column) with a Boolean `listed`."""
        key = universe.columns[0]
        both = staged(universe, "keys")
        own, other = both.where("listed").select(key), both.where(~F.col("listed")).select(key)
        self.levels: list[Bloom] = []
        n = own.count()
        while n:
            level = Bloom(own, n, len(self.levels))
            self.levels.append(level)
            passed = staged(other.where(level.may_have(F.col(key))), "passed")
            own, other, n = passed, own, passed.count()

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(self.levels[k - 1].may_have(key), out).otherwise(k % 2 == 0)
        return out


def filtered(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. listed: one column of hosts; None: those of the default list."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = rows.select("host").where("host <> ''").distinct()
    if listed is None:
        universe = hosts.withColumn("listed", F.md5(F.col("host").cast("binary")).substr(1, 1).isin("0", "1"))
    else:
        names = listed.toDF("host").where("host <> ''").distinct().withColumn("l", F.lit(True))
        universe = hosts.join(names, "host", "left").select("host", F.coalesce("l", F.lit(False)).alias("listed"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    universe = staged(universe, "universe")
    ranges = max(1, -(-universe.where("listed").count() // RANGE_KEYS))
    number, judged = F.pmod(F.xxhash64(F.lit(-1), "host"), F.lit(ranges)), []
    if ranges > 1:  # each range reads its own rows only
        universe, rows = (staged(x.withColumn("range", number), "ranges", "range") for x in (universe, rows))
    for r in range(ranges):
        of_range = (lambda x, r=r: x.where(F.col("range") == r)) if ranges > 1 else (lambda x: x)
        blocked = Cascade(of_range(universe).select("host", "listed")).has(F.col("host")) & (F.col("host") != "")
        got = of_range(rows).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"))
        judged.append(staged(got, "judged") if ranges > 1 else got)
    return functools.reduce(DataFrame.unionByName, judged)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))


def _sql_rule(what) -> str:
    cases = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(h, p, v)}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"CASE{cases} END"


OP9_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT page_id, host, path, {_sql_rule(lambda h, p, v: h + p)} AS rule,
       coalesce({_sql_rule(lambda h, p, v: v)}, CASE WHEN host <> '' AND md5(host)[1] IN ('0', '1') THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""
