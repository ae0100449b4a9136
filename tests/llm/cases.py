"""Small tables that hold nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, h int, bucket string, TEXT_KEY int, label string, s int, prediction string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    passage = words(rng, 120)
    long_ = words(rng, 6000, 5000)
    texts = [None, "", "   \n\t", "one", "a b c", "x\n\nx\nx\n y z \n y z", passage, passage, passage + " tail", words(rng, 40) + "\n" + passage + "\n" + words(rng, 30), long_, long_[:-3] + "end"]
    texts += ["Straße été 日本語 \U0001f600 x" * 5, "the <|endoftext|> of & and", "A line that is long enough to count by itself because it has many words in it, more than twenty of them really.\nb"] * 2
    texts += [words(rng, 60) + "\n" + "common line here\nother line here\n" + words(rng, 30) for _ in range(12)]
    rows = [(i, t, "en" if i % 3 else None, [None, "a", "b", "é"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, passage, "fr", "a", 1), (None, None, None, None, None), (3, "another text with the same id", "en", "a", 1)]
    return [r + ("x", 1, "y", 2, "z", 3, "p") for r in rows]


def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)
