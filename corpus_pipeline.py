"""Corpus pipeline: documents pass from stage to stage, each writes Parquet and the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import (
    op05_decontaminate,
    op06_chosen_path,
    op07_language,
    op08_lines,
    op09_bpe,
)
from quillstream.llm.common import stage as staged

#: Every stage works on what its predecessor kept and returns the columns of documents; the last gives
#: the digests of the encoded texts.
STAGES = [
    ("language", op07_language.stage),
    ("line_dedup", op08_lines.stage),
    ("near_duplicates", op06_chosen_path.stage),
    ("decontaminate", op05_decontaminate.stage),
    ("byte_bpe", op09_bpe.stage),
]

#: Language identification has no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = staged(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
