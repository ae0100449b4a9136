"""Operator 4: mixing sources to target weights along a low-discrepancy schedule.

A document's size is its number of words. Sources, ordered by code point (null last), weigh 3, 1, 2, repeating, and share
`SHARE` of all words; a target stops at `EPOCHS` times its source's words and the excess is shared by weight among
the others, until none is above.

Schedule: 2**`LEVELS` slots of equal size. Slot i has the base-2 van der Corput point reverse(i) / 2**LEVELS; the
sources' shares, laid end to end, map it to a source. As all points of one level are evenly spaced, a source gets its
share of slots within one. The k-th slot of a source takes its block k modulo its number of blocks: the source's
documents, shuffled by hash and laid end to end, are cut into blocks of a slot's size. A document takes, for each
block, as many words as it has there, times the slots that take the block. No block is taken more than EPOCHS times.

Cases: a null text has size 0 and takes nothing; a source without words has target 0; rows equal in every respect are
two documents. All choices follow from hashes of doc_id, so that reruns agree. An empty table gives no rows. The sources'
totals (one row each) are the only thing the driver sees; text is read once for the sizes, which are written as a table
of ids, and is never shuffled. Running sums go by (source, part) with about `PART_ROWS` rows of the whole table in each part
number, so that no window grows with the data; the parts' own sums (one row each) are added up per source.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import WORD, fresh, on_row, rank_in, staged, table

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), Fraction(3, 2), 2
LEVELS, PARTS, PART_ROWS, SEED = 17, 1024, 100_000, 20240613


def targets(sizes: list[int], weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> list[Fraction]:
    """Each source's target in words: by weight, at most epochs times its size."""
    out, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    weight = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if weight[i] * unit > epochs * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weight[i] * unit
            break
        for i in full:
            out[i] = Fraction(epochs * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def schedule(spark: SparkSession, shares: list[Fraction], levels: int = LEVELS) -> DataFrame:
    """(slot, s, rank): the source's index of every slot and the slot's rank among that source's slots."""
    n, total = 1 << levels, sum(shares)
    ends, run = [], Fraction(0)
    for x in shares:
        run += x
        ends.append(-int(-run * n // total))  # points below, rounded up
    point = sum((F.shiftleft(F.shiftright("slot", k).bitwiseAND(1), levels - 1 - k) for k in range(levels)), F.lit(0).cast("long"))
    slots = spark.range(n).select(F.col("id").alias("slot")).select("slot", rank_in(ends, point).alias("s"), F.shiftright("slot", 9).alias("part"))
    per = slots.groupBy("s", "part").agg(F.count(F.lit(1)).alias("c"))
    before = per.select("s", "part", (F.sum("c").over(Window.partitionBy("s").orderBy("part")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("s", "part").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(before, ["s", "part"]).select("slot", "s", (F.col("before") + F.col("inside")).alias("rank"))


def mix(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, taken) for each row of docs."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "source", size.alias("size"))
    rows = staged(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    parts = max(PARTS, sum(r["rows"] for r in found) // PART_ROWS)
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["words"] or 0) for r in found]
    goal, total = targets(sizes) if sum(sizes) else [Fraction(0)] * len(sizes), sum(sizes)
    n = 1 << levels
    num, den = SHARE.numerator * total, SHARE.denominator * n  # words in a slot: num / den
    blocks = [-(-x * den // num) if total else 0 for x in sizes]
    facts = spark.createDataFrame([(r["source"], i, sizes[i], float(goal[i]), blocks[i]) for i, r in enumerate(found)], "src string, s int, source_size long, target double, blocks long").hint("broadcast")
    known = rows.join(facts, rows["source"].eqNullSafe(facts["src"])).drop("source", "src")
    if not total:
        return known.select("doc_id", "text_hash", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    # Each document's place among its source's shuffled words, in two steps: no window spans a source.
    known = known.withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(SEED))).withColumn("part", F.pmod("h", F.lit(parts)))
    per = known.groupBy("s", "part").agg(F.sum("size").alias("c"))
    before = per.select("s", "part", (F.sum("c").over(Window.partitionBy("s").orderBy("part")) - F.col("c")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("s", "part").orderBy("h", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = known.withColumn("inside", inside).join(before, ["s", "part"]).withColumn("lo", F.col("before") + F.col("inside"))
    # The blocks it lies in; block b begins at the least word that is at least b * num / den. Decimals where longs could overflow.
    wide = max(total * den, n * num) >= 1 << 62
    long_ = (lambda x: f"cast({x} as decimal(38,0))") if wide else (lambda x: f"cast({x} as bigint)")
    block = lambda w: F.expr(f"cast({long_(w)} * {den} div {num} as bigint)")
    begins = lambda b: F.expr(f"cast(({long_(b)} * {num} + {den - 1}) div {den} as bigint)")
    cut = placed.where("size > 0").withColumn("last", F.col("lo") + F.col("size") - 1)
    cut = cut.withColumn("block", F.explode(F.sequence(block("lo"), block("last")))).withColumn("next", F.col("block") + 1)
    part = F.least(F.col("lo") + F.col("size"), begins("next")) - F.greatest(F.col("lo"), begins("block"))
    slots = schedule(spark, goal, levels).join(F.broadcast(facts.select("s", "blocks")), "s").where(F.col("rank") < EPOCHS * F.col("blocks"))
    times = slots.groupBy("s", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    got = cut.join(times, ["s", "block"], "left").groupBy("s", "lo", "doc_id", "text_hash", "size", "source_size", "target").agg(F.sum(part * F.coalesce("times", F.lit(0))).alias("taken"))
    columns = ["doc_id", "text_hash", "size", "source_size", "target"]
    return got.select(*columns, F.col("taken").cast("long")).unionByName(placed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a document that takes its words k times and r further ones stands k times in full
    and, if r > 0, once with its first r words (up to the next word; n_chars follows). One that takes nothing goes.
    Rows equal in doc_id and text share what they take evenly."""
    h, rid, rhash, size, taken, copy = fresh(docs, "text_hash", "right_id", "right_hash", "mix_size", "mix_taken", "mix_copy")
    plan = mix(docs).groupBy("doc_id", "text_hash", "size").agg(F.expr("sum(taken) div count(1)").alias("taken")).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias(rid), F.col("text_hash").alias(rhash), F.col("size").alias(size), F.col("taken").alias(taken))
    left = docs.withColumn(h, F.xxhash64("text"))
    joined = left.join(plan, on_row(left, plan, "doc_id", h, rid, rhash))
    whole, rest = F.expr(f"`{taken}` div `{size}`").cast("int"), F.col(taken) % F.col(size)
    part = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn(copy, F.explode(part))
    words = F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1)
    text = F.when(F.col(copy) < 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(copy), F.lit(0)).cast("int")), ""))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
