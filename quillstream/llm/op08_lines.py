"""Line dedup: a line that several documents share stays only where the smallest id holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WHITE, spread
from .common import stage as staged

#: Keys shorter than this many code points are never dropped.
MIN_KEY = 10


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case, nothing else folded."""
    bare = F.btrim(line, F.lit(WHITE.decode()))
    # lower() agrees with A-Z folding on ASCII text and is much faster than translate().
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_key: int = MIN_KEY) -> DataFrame:
    """Per document with lines to drop: ``doc_id``, ``text_hash`` and the ``dropped`` positions.

    Lines travel as a 128-bit digest of their key. Whether a digest is shared, and by whom first, is
    a minimum and a maximum per digest, so each task sends one row per key however hot the key is. The
    shared digests are a table before the join back, so that both sides of it are plain shuffles, which
    adaptive execution splits where a digest is hot.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
        F.posexplode(F.transform(_lines(F.col(f"`{text_col}`")), line_key)).alias("position", "key"),
    ).filter(F.col("doc_id").isNotNull() & (F.char_length("key") >= min_key))
    rows = rows.select("doc_id", "text_hash", "position", F.unhex(F.md5("key")).alias("digest"))
    shared = staged(
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"))
        .filter(F.col("keeper") < F.col("other"))
        .select("digest", "keeper"),
        "shared-lines",
    )
    return (
        rows.join(shared, "digest")
        .filter(F.col("doc_id") > F.col("keeper"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("position").alias("dropped"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY
) -> DataFrame:
    """``docs`` with the shared lines taken out of the text, as a struct ``row`` of its own columns,
    plus ``n_lines`` (before) and ``n_dropped``.

    A key found in two or more documents loses all its lines except those of the smallest id; lines
    that repeat inside that document stay. A null or empty text is one empty line and becomes the
    empty text. A row without an id keeps its lines and counts for nothing. Rows of one id are one
    document for the counting; they lose their lines alike, row by row. An empty table gives none.
    """
    marks = dropped_lines(spread(docs, id_col, text_col), id_col, text_col, min_key)
    whole = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
    )
    joined = whole.join(marks, ["doc_id", "text_hash"], "left").select(
        "row", _lines(F.col(f"row.`{text_col}`")).alias("lines"), "dropped"
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text = F.when(
        F.col("dropped").isNull(), F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    ).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    replaced = {id_col: F.col(f"row.`{id_col}`"), text_col: text}
    fields = [
        (replaced[name] if name in replaced else F.col(f"row.`{name}`")).alias(name)
        for name in docs.columns
    ]
    return joined.select(
        F.struct(*fields).alias("row"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(docs: DataFrame) -> DataFrame:
    """The digest of each document after line dedup."""
    return dedup_lines(spread(docs, "doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.col("row.text"), 256).alias("kept_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their shared lines removed, all columns as they were."""
    return dedup_lines(docs).select("row.*")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
