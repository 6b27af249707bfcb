"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op01_tokens,
    op02_pii,
    op03_simhash,
    op04_bloom_lm,
    op05_decontaminate,
    op06_chosen_path,
    op07_language,
    op08_lines,
    op09_bpe,
    op10_quality,
    op11_whitening,
    op12_exact,
    op13_ranked,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _over_documents(run) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: run(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": _over_documents(op01_tokens.query),
    "op2_private_data": _over_documents(op02_pii.query),
    "op3_simhash": _over_documents(op03_simhash.query),
    "op4_bloom_lm": _over_documents(op04_bloom_lm.query),
    "op5_decontaminate": lambda spark, folder: op05_decontaminate.query(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    ),
    "op6_near_duplicates": _over_documents(op06_chosen_path.query),
    "op7_language": _over_documents(op07_language.query),
    "op8_line_dedup": _over_documents(op08_lines.query),
    "op9_byte_bpe": _over_documents(op09_bpe.query),
    "op10_quality": lambda spark, folder: op10_quality.query(
        _table(spark, folder, "documents"), _table(spark, folder, "labels")
    ),
    "op11_whitening": lambda spark, folder: op11_whitening.query(_table(spark, folder, "embeddings")),
    "op12_exact_dedup": _over_documents(op12_exact.query),
    "op13_ranked_search": lambda spark, folder: op13_ranked.query(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    ),
}
ORACLES = {
    "op5_decontaminate": op05_decontaminate.SQL,
    "op8_line_dedup": op08_lines.SQL,
    "op12_exact_dedup": op12_exact.SQL,
    "op13_ranked_search": op13_ranked.SQL,
}
