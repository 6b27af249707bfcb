"""Ranked lexical search by dense blocked matrix products.

A first scan cuts every document into terms and keeps, per document, its number of terms and the counts of
those that some item asks for; N, L and document frequencies are sums over that table. A second scan goes
over tiles of documents: their impacts, for the columns of one tile of the items' vocabulary, are a dense
float64 matrix, and one BLAS product with the weights of a tile of items gives partial scores. A vocabulary
tile holds so few terms that no partial sum reaches 2^53, so products are exact and totals are added as
64-bit integers. A tile's best documents per item are chosen by score and id, ties included, and only the
best few of each task leave it.

Items go in blocks of a bounded number of terms, one pair of scans for each, so what the tasks get does not
grow with the benchmark.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, _CLASSES, _FOLD, raw, sliced, spread
from .common import stage as staged

#: Documents that an item gets at most.
TOP = 10
#: Share of the length in a document's divisor, in hundredths.
SHARE = 90
#: Rows of an impact tile, items of a weight tile, and terms that the two have in common.
TILE_DOCS, TILE_ITEMS, TILE_TERMS = 512, 256, 4096
#: (item, term) pairs of a block of items: some 16 bytes each are sent to the tasks.
BLOCK_PAIRS = 1 << 20
#: Documents' share of an item is ranked apart this often before all meet.
SALTS = 64

_IMPACT, _UNIT = 1_000_000_000, 1000


class Terms:
    """The lower-cased terms of some texts as an Arrow array, and the bounds of the texts among them."""

    def __init__(self, texts: pa.Array):
        data, offsets = raw(texts)
        folded = _FOLD[data]
        inside = _CLASSES[ALNUM][folded]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[:-1][np.diff(offsets) > 0]
        first[cut] = inside[cut]
        cut = cut[cut > 0]
        last[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        # Bytes between terms taken out, the terms follow each other as an Arrow array holds them.
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        buffers = [None, pa.py_buffer(places), pa.py_buffer(folded[inside])]
        self.values = pa.LargeStringArray.from_buffers(len(starts), buffers[1], buffers[2])
        self.bounds = np.searchsorted(starts, offsets, "left")


class Block(NamedTuple):
    """A block of items: their ids, the distinct terms, and the pairs of item and term number by item."""

    items: list
    terms: pa.LargeStringArray
    pairs_item: np.ndarray
    pairs_term: np.ndarray


def item_terms(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, term). Rows of one item id are one item."""

    def split(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                terms = Terms(part.column("text"))
                owner = np.repeat(np.arange(len(part)), np.diff(terms.bounds))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(owner)), terms.values.cast(pa.string())],
                    names=["item_id", "term"],
                )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(split, "item_id long, term string").distinct()


def _blocks(pairs: DataFrame, block_pairs: int) -> list[DataFrame]:
    """The pairs in tables of about ``block_pairs``; an item stays whole."""
    blocks = pairs.count() // block_pairs + 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return [pairs.filter(part == block) for block in range(blocks)]


def _gathered(pairs: DataFrame) -> Block:
    table = pairs.toArrow()
    items = table.column("item_id").combine_chunks().dictionary_encode()
    if items.null_count:  # a null id is an item like any other
        items = pc.dictionary_encode(table.column("item_id").combine_chunks(), null_encoding="encode")
    terms = table.column("term").combine_chunks().cast(pa.large_string()).dictionary_encode()
    return Block(
        items.dictionary.to_pylist(),
        terms.dictionary,
        items.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        terms.indices.to_numpy(zero_copy_only=False).astype(np.int64),
    )


def term_counts(docs: DataFrame, block: Block) -> DataFrame:
    """Per document ``doc_id``, its number of ``terms``, and the ``numbers`` and ``counts`` of the block's
    terms in it, as arrays."""
    vocabulary = block.terms

    def count(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                terms = Terms(part.column("text"))
                sizes = np.diff(terms.bounds)
                place = pc.index_in(terms.values, value_set=vocabulary)
                known = np.flatnonzero(np.asarray(place.is_valid()))
                owner = np.repeat(np.arange(len(part)), sizes)[known]
                number = place.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, counts = np.unique(owner * max(len(vocabulary), 1) + number, return_counts=True)
                owner, number = np.divmod(pairs, max(len(vocabulary), 1))
                edges = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(edges, pa.array(number, pa.int32())),
                        pa.ListArray.from_arrays(edges, pa.array(counts, pa.int64())),
                    ],
                    names=["doc_id", "terms", "numbers", "counts"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, terms long, numbers array<int>, counts array<long>")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents per term number, added up in each task before they meet."""

    def add(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("numbers").flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], names=["number", "df"]
        )

    sums = counted.select("numbers").mapInArrow(add, "number int, df long").groupBy("number")
    rows = sums.agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[rows.column("number").to_numpy()] = rows.column("df").to_numpy()
    return df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) per term."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _item_tiles(block: Block, weight: np.ndarray, tile_items: int, tile_terms: int):
    """Tiles of items: (first item, items, [(term numbers, item and column of every weight, weight), ...])."""
    limit = (1 << 53) // (_IMPACT // _UNIT * max(1, int(weight.max(initial=1)))) - 1
    width = max(1, min(tile_terms, limit))
    order = np.lexsort((block.pairs_term, block.pairs_item))
    item, term = block.pairs_item[order], block.pairs_term[order]
    tiles = []
    for first in range(0, len(block.items), tile_items):
        a, b = np.searchsorted(item, [first, first + tile_items])
        own, column = np.unique(term[a:b], return_inverse=True)
        parts = []
        for at in range(0, len(own), width):
            some = np.flatnonzero((column >= at) & (column < at + width))
            numbers = own[at : at + width]
            parts.append((numbers, item[a:b][some] - first, column[some] - at, weight[term[a:b][some]]))
        tiles.append((first, min(tile_items, len(block.items) - first), parts))
    return tiles


class Best:
    """The best documents of each item of a block so far, ties by id, documents without an id last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)  # a document enters with at least this score
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.unnamed = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> None:
        columns = [
            np.concatenate(pair)
            for pair in ((self.item, item), (self.score, score), (self.doc, doc), (self.unnamed, unnamed))
        ]
        order = np.lexsort((columns[2], columns[3], -columns[1], columns[0]))
        columns = [column[order] for column in columns]
        rank = np.arange(len(order)) - np.searchsorted(columns[0], columns[0], "left")
        self.item, self.score, self.doc, self.unnamed = [c[rank < self.top] for c in columns]
        full = np.flatnonzero(rank == self.top - 1)
        # Equal scores still enter: their ids decide.
        self.least[columns[0][full]] = columns[1][full]


def _scorer(block: Block, weight: np.ndarray, n_docs: int, n_terms: int, top: int, shape: tuple[int, int, int]):
    tile_docs, tile_items, tile_terms = shape

    def score(batches):
        tiles = _item_tiles(block, weight, tile_items, tile_terms)
        best = Best(len(block.items), top)
        place = np.full(len(block.terms), -1, np.int64)
        for batch in batches:
            batch = batch.filter(pa.array(pc.greater(pc.list_value_length(batch.column("numbers")), 0)))
            for at in range(0, len(batch), tile_docs):
                part = batch.slice(at, tile_docs)
                ids = part.column("doc_id")
                unnamed = np.asarray(ids.is_null())
                doc = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
                length = part.column("terms").to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(part)), pc.list_value_length(part.column("numbers")).to_numpy(zero_copy_only=False))
                number = part.column("numbers").flatten().to_numpy(zero_copy_only=False)
                count = part.column("counts").flatten().to_numpy(zero_copy_only=False)
                divisor = 100 - SHARE + (SHARE * length * n_docs) // n_terms
                impact = (_IMPACT * count) // (_UNIT * count + 8 * divisor[owner])
                for first, items, parts in tiles:
                    total = np.zeros((len(part), items), np.int64)
                    for numbers, item, column, value in parts:
                        place[numbers] = np.arange(len(numbers))
                        there = place[number]
                        place[numbers] = -1
                        met = np.flatnonzero(there >= 0)
                        if not len(met):
                            continue
                        # Only columns that a document of the tile holds.
                        used, packed = np.unique(there[met], return_inverse=True)
                        dense = np.zeros((len(part), len(used)))
                        dense[owner[met], packed] = impact[met]
                        short = np.full(len(numbers), -1, np.int64)
                        short[used] = np.arange(len(used))
                        pairs = np.flatnonzero(short[column] >= 0)
                        weighed = np.zeros((len(used), items))
                        weighed[short[column[pairs]], item[pairs]] = value[pairs]
                        total += (dense @ weighed).astype(np.int64)
                    row, item = np.nonzero(total >= best.least[first : first + items])
                    if len(row):
                        best.add(item + first, total[row, item], doc[row], unnamed[row])
        names = pa.array(block.items, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(best.item)),
                pc.if_else(pa.array(best.unnamed, pa.bool_()), pa.scalar(None, pa.int64()), pa.array(best.doc)),
                pa.array(best.score),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return score


def ranked(
    docs: DataFrame,
    benchmark: DataFrame,
    top: int = TOP,
    block_pairs: int = BLOCK_PAIRS,
    shape: tuple[int, int, int] = (TILE_DOCS, TILE_ITEMS, TILE_TERMS),
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` best documents per item with a score above zero.

    ``docs`` has (doc_id, text), ``benchmark`` (item_id, text); other columns are not read. A null or empty
    text has no terms: such a document does not count for N and such an item gets no rows. Rows of one item
    id are one item with the terms of all; every row of ``docs`` is a document of its own, also where an id
    repeats. Equal scores go by id, documents without an id last. Empty tables give no rows.
    """
    pairs = staged(item_terms(spread(benchmark, "item_id", "text")), "item-terms")
    texts = spread(docs, "doc_id", "text")
    found = None
    for part in _blocks(pairs, block_pairs):
        block = _gathered(part)
        counted = staged(term_counts(texts, block), "term-counts")
        sums = counted.agg(F.count_if(F.col("terms") > 0).alias("docs"), F.sum("terms").alias("terms")).first()
        weight = weights(_frequencies(counted, len(block.terms)), sums["docs"])
        scorer = _scorer(block, weight, sums["docs"], sums["terms"] or 1, top, shape)
        rows = staged(counted.mapInArrow(scorer, "item_id long, doc_id long, score long"), "scores")
        found = rows if found is None else found.unionByName(rows)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # Every task gives some rows per item: they are ranked in shares first, so no task gets them all.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    share = F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))
    nearer = salted.withColumn("rank", share).filter(F.col("rank") <= top)
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return nearer.withColumn("rank", last).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked(docs, benchmark)


SQL = r"""
WITH folded AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), totals AS (
  SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM folded
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counts AS (
  SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM folded)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weighted AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, totals GROUP BY term
), scored AS (
  SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT
           AS score
  FROM counts JOIN weighted USING (term) JOIN wanted USING (term), totals GROUP BY item_id, doc, doc_id
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank,
         doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
