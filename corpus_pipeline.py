"""The corpus pipeline: five stages, each over all that the one before kept.

Language identification drops documents that it rejects; line dedup cuts later repeated runs of lines; the Jaccard join keeps one
document of each group of near copies; mixing repeats, cuts or drops documents so that sources meet their targets; packing returns
the pieces of the training sequences. All stages but the last return the columns of their input.

Cases: a null text, or one without a letter, is rejected by the first stage; a text that line dedup empties stays as an empty row, is its own
group, and takes nothing in mixing; of rows equal in all respects one goes on from the third stage; ties between copies go to the least doc_id,
a null one counting as greatest; further columns, whatever their names, are carried up to packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, language, linededup, mixing, packing
from lodestone.llm._spark import finished, table

STAGES = [
    ("language", lambda spark, docs, sf_dir: language.accepted(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: linededup.deduplicated(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: jaccard.one_of_each(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mixed(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.packed(docs)),
]

#: Model fitting, shuffles by hash and first-fit decreasing aren't expressible in SQL; a test compares each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(stage(spark, docs, sf_dir), name, docs)  # what the stage before left is deleted once it is read
    return STAGES[-1][1](spark, docs, sf_dir)
