"""Exact dedup by two passes of Bloom filtering, with DataFrame functions only.

The first pass adds the digest of every text to a blocked Bloom filter that tells "met" from "met twice":
a digest names one block of bits and ``PROBES`` bits in it, and the bits that two or more rows name are
kept as bit maps, one small row per block. The second pass probes that filter, which is of a bounded
size and broadcast: a row with a bit that no other row names is alone and passes straight through; only
the rest, all copies and few others, shuffle by their digest and are grouped exactly.

Texts are read once. What the passes read is a narrow table of digests, written to shared storage. A
table with more rows than one filter serves is filtered region by region of the digests, one filter at a
time, so the broadcast does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, spread
from .common import stage as staged

#: Bits that one row of the filter holds, as the bitmap functions have them.
BLOCK = 1 << 15
#: Bits of filter for each row of the table, and bits that a digest names.
BITS_PER_ROW, PROBES = 8, 2
#: Bits of the filter that is broadcast: 64 MiB. More rows than it serves go in further regions.
FILTER_BITS = 1 << 29


def bare(text: Column) -> Column:
    """The text without ASCII white space; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE.decode(), "")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, chars of the original, digest of the bare text) per row."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"),
        F.unhex(F.sha2(bare(text), 256)).alias("digest"),
    )


def _placed(rows: DataFrame, regions: int, blocks: int) -> DataFrame:
    """``rows`` with the ``region`` of their digest, its ``block`` there and its ``bits`` in the block."""
    mixed = F.xxhash64("digest", F.lit(1))
    bits = [F.shiftrightunsigned(mixed, 15 * k).bitwiseAND(BLOCK - 1) for k in range(PROBES)]
    return rows.withColumns(
        {
            "region": F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(regions)),
            "block": F.pmod(F.xxhash64("digest", F.lit(3)), F.lit(blocks)),
            "bits": F.array(*bits),
        }
    )


def repeated_bits(placed: DataFrame) -> DataFrame:
    """(block, twice): a bit map of the bits that two or more rows name. A row that names one bit with
    two probes counts for two, which can only add a suspect."""
    named = placed.select((F.col("block") * BLOCK).alias("base"), F.explode("bits").alias("bit"))
    twice = named.groupBy((F.col("base") + F.col("bit")).alias("place")).agg(F.count("*").alias("rows"))
    twice = twice.filter(F.col("rows") > 1).select("place")
    # The bitmap functions count from 1: value n has bucket (n - 1) / 32768 + 1.
    return twice.groupBy((F.bitmap_bucket_number(F.col("place") + 1) - 1).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("twice")
    )


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1


class Filters:
    """The filters over the digests of a table: one per region, each of at most ``filter_bits`` bits."""

    def __init__(self, rows: DataFrame, filter_bits: int = FILTER_BITS, bits_per_row: int = BITS_PER_ROW):
        total = rows.count()
        self.regions = max(1, -(-total * bits_per_row // filter_bits))
        self.blocks = max(1, -(-total * bits_per_row // (self.regions * BLOCK)))
        self.tables = [staged(repeated_bits(part), "repeated-bits") for part in self._parts(rows)]

    def _parts(self, rows: DataFrame) -> list[DataFrame]:
        placed = _placed(rows, self.regions, self.blocks)
        return [placed.filter(F.col("region") == region) for region in range(self.regions)]

    def probe(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``digest``) and ``suspect``; false proves that no other row has the digest."""
        whole = None
        for part, table in zip(self._parts(rows), self.tables):
            # At most filter_bits / 32768 rows of 4 KiB, whatever the table: the broadcast is bounded.
            probed = part.join(F.broadcast(table), "block", "left")
            met = F.col("twice").isNotNull()
            for k in range(PROBES):
                met = met & _is_set(F.col("twice"), F.col("bits")[k])
            probed = probed.withColumn("suspect", met).select(*rows.columns, "suspect")
            whole = probed if whole is None else whole.unionByName(probed)
        return whole


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """Per row ``doc_id``, ``keep_id``, ``group_size`` (rows), ``kept`` and ``digest`` (SHA-256, binary).

    Texts are equal when they are identical without ASCII white space. Of equal texts the row with the
    most code points in its original stays, among those the smallest id. A null text is an empty text.
    A row without an id stays only if no row of as many code points has one; ``keep_id`` is null then.
    Rows that repeat under one id count each for the group and are kept or dropped alike. An empty table
    gives no rows; other columns are not read.
    """
    rows = staged(digests(docs, id_col, text_col), "digests")
    return _grouped(Filters(rows, filter_bits).probe(rows), id_col)


def _grouped(marked: DataFrame, id_col: str) -> DataFrame:
    alone = marked.filter(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest"
    )
    met = marked.filter("suspect")
    # Structs order null ids first, so a flag in front of the id puts them last.
    rank = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("keep_id"))
    groups = met.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("group_size"))
    # A table of its own, so that both sides of the join are plain shuffles, which adaptive execution splits
    # where one digest holds many rows.
    groups = staged(groups.select("digest", "first.keep_id", "group_size"), "equal-texts")
    together = met.select("doc_id", "digest").join(groups, "digest")
    found = alone.unionByName(together.select(*alone.columns))
    return found.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, all columns unchanged.

    Rows whose digest is alone go from the scan to the result; the others are joined with the ids that go.
    A row is named by its id and its digest; rows without an id are never dropped, since nothing names them.
    """
    rows = staged(digests(docs, id_col, text_col), "digests")
    filters = Filters(rows, filter_bits)
    dropped = _grouped(filters.probe(rows), "doc_id").filter(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = staged(dropped.select("digest", "doc_id").distinct(), "gone")
    whole = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.unhex(F.sha2(bare(F.col(f"`{text_col}`")), 256)).alias("digest"),
    )
    marked = filters.probe(whole)
    stays = marked.filter(F.col("suspect")).join(gone, ["digest", "doc_id"], "left_anti").select("row")
    return marked.filter(~F.col("suspect")).select("row").unionByName(stays).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """The group of each document among exact copies, and the digest of its bare text."""
    return exact_groups(spread(docs, "doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = """
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))
           AS text_sha256
  FROM documents
), grouped AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
  FROM bare
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size,
       doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM grouped
"""
