import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

CLASHES = ["row", "text_hash", "digest", "class", "bucket", "words", "ids", "score", "kept", "learnt", "hash"]


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table of (doc_id, text) with the usual columns and some that clash."""

    def make(rows, clashes=True):
        frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").select(
            "*",
            F.lit("en").alias("lang"),
            F.lit("src0").alias("source"),
            F.length("text").cast("bigint").alias("n_chars"),
        )
        extra = {name: F.lit(f"own {name}") for name in CLASHES} if clashes else {}
        return frame.withColumns(extra)

    return make


LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while many other animals watch from the hill"

EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b"),
    (4, PROSE),
    (5, PROSE),
    (5, PROSE),
    (6, LONG),
    (7, "a" * 5000),
    (8, "one\ntwo two two two two\n\n  ONE LONG LINE of Text \nlast"),
    (9, "zero\none long line of text\nother"),
    (None, "one long line of text"),
    (None, None),
    (10, "naïve Ünïcode — 中文字符 ١٢٣ 🙂🙂 <|endoftext|> tail end x"),
    (11, "mail a.b@c.org or +49 (30) 1234-5678 at 10.0.0.1, card 4111 1111 1111 1111."),
]


@pytest.fixture(scope="session")
def edges(docs):
    return docs(EDGES)


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
