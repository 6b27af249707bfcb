"""Benchmark decontamination: find word windows of test items inside training documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM, Words, _FOLD, sliced, spread, stage as staged

#: Words in a window; an item with fewer words is one window of its own size.
WINDOW = 13
#: A document is contaminated when at least one word in this many is hit.
SHARE = 20
#: Bytes of benchmark text whose windows are broadcast at once; some six bytes go out for each. A larger
#: benchmark goes in several passes.
BLOCK_BYTES = 4 << 20

_TABLE_BITS = 22


class Windows:
    """The windows of some test items: hashes to look up, and the words to verify a hit by.

    Everything is arrays over the items' words, built in one pass per width: a window is the number of its
    first word. ``tables`` has, by width, the sorted distinct hashes, a bit map of their leading bits, the
    bounds of each hash among its distinct windows, their first words, and the bounds of each window among
    its items.
    """

    def __init__(self, items: list[tuple[int, str | None]], size: int):
        self.names = sorted({str(item) for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        found = Words(pa.array([text for _, text in items], pa.large_string()), ALNUM)
        counts = found.counts
        item_of = np.array([number[str(item)] for item, _ in items], np.int64)
        text = np.repeat(np.arange(len(items)), counts)
        self.data, self.starts, self.ends = _FOLD[found.data], found.starts, found.ends
        self.tables = {}
        for width in np.unique(np.minimum(counts[counts > 0], size)).tolist():
            hashes, firsts = found.windows(width)
            own = counts[text[firsts]] >= size if width == size else counts[text[firsts]] == width
            self.tables[width] = self._table(width, hashes[own], firsts[own], item_of[text[firsts[own]]])

    def _table(self, width: int, hashes: np.ndarray, firsts: np.ndarray, items: np.ndarray) -> tuple:
        order = np.lexsort((items, hashes))
        hashes, firsts, items = hashes[order], firsts[order], items[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        leader = np.flatnonzero(new)[np.cumsum(new) - 1]
        kind = np.zeros(len(hashes), np.int64)  # which of the windows of a hash; almost always there is one
        for odd in np.flatnonzero(~self._same(width, firsts[leader], self, firsts)):
            known = [k for k in range(leader[odd], odd) if self._same(width, firsts[k : k + 1], self, firsts[odd : odd + 1])[0]]
            kind[odd] = kind[known[0]] if known else kind[leader[odd] : odd].max() + 1
        run = np.cumsum(new) - 1
        order = np.lexsort((items, kind, run))
        run, kind, firsts, items = run[order], kind[order], firsts[order], items[order]
        window = np.ones(len(run), bool)
        window[1:] = (run[1:] != run[:-1]) | (kind[1:] != kind[:-1])
        pair = window.copy()
        pair[1:] |= items[1:] != items[:-1]
        windows = np.flatnonzero(window)
        values = hashes[new]
        quick = np.zeros(1 << _TABLE_BITS, bool)
        quick[values >> np.uint64(64 - _TABLE_BITS)] = True
        return (
            values,
            np.packbits(quick),
            np.searchsorted(run[windows], np.arange(len(values) + 1)).astype(np.int32),
            firsts[windows].astype(np.int32),
            np.concatenate([np.cumsum(pair)[windows] - 1, [pair.sum()]]).astype(np.int32),
            items[pair].astype(np.int32),
        )

    def _same(self, width: int, firsts: np.ndarray, words, there: np.ndarray) -> np.ndarray:
        """Whether the windows at ``firsts`` have the very words of those at ``there`` in ``words``."""
        same = np.ones(len(firsts), bool)
        for k in range(width):
            left = np.flatnonzero(same)
            a, b = self.starts[firsts[left] + k], words.starts[there[left] + k]
            size = self.ends[firsts[left] + k] - a
            equal = size == words.ends[there[left] + k] - b
            same[left[~equal]] = False
            left, a, b, size = left[equal], a[equal], b[equal], size[equal]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differs = self.data[np.repeat(a, size) + place] != _FOLD[words.data[np.repeat(b, size) + place]]
            same[np.repeat(left, size)[differs]] = False
        return same

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hit, and the distinct pairs (text, number of an item with an occurring window)."""
        change = np.zeros(len(words) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for width, (hashes, quick, kinds, firsts, edges, items) in self.tables.items():
            values, there = words.windows(width)
            quick = np.unpackbits(quick).view(bool)
            maybe = np.flatnonzero(quick[values >> np.uint64(64 - _TABLE_BITS)])
            run = np.searchsorted(hashes, values[maybe])
            run[run == len(hashes)] = 0
            equal = hashes[run] == values[maybe]
            there, run = there[maybe[equal]], run[equal]
            for kind in range(int((kinds[run + 1] - kinds[run]).max(initial=0))):
                some = kinds[run] + kind < kinds[run + 1]
                window, at = kinds[run[some]] + kind, there[some]
                sure = self._same(width, firsts[window].astype(np.int64), words, at)
                window, at = window[sure], at[sure]  # equal hashes alone are no hit
                np.add.at(change, at, 1)
                np.add.at(change, at + width, -1)
                text = np.searchsorted(words.bounds, at, side="right") - 1
                met = np.unique(np.stack([text, window], axis=1), axis=0)
                many = edges[met[:, 1] + 1] - edges[met[:, 1]]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found = items[np.repeat(edges[met[:, 1]], many) + place]
                pairs.append(np.stack([np.repeat(met[:, 0], many), found], axis=1))
        return np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


_HITS = "n_words long, n_hit long, hits binary, items array<string>"


def _scanner(windows: Windows, only_hits: bool):
    """Rows with ``text`` to the same rows with the columns of ``_HITS``, perhaps those with a hit only."""
    names = pa.array(windows.names, pa.string())

    def scan(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                hit, pairs = windows.scan(words)
                counts, hits = [], []
                for a, b in zip(words.bounds, words.bounds[1:]):
                    counts.append(int(hit[a:b].sum()))
                    hits.append(np.packbits(hit[a:b]).tobytes() if counts[-1] else None)
                edges = np.searchsorted(pairs[:, 0], np.arange(len(part) + 1)).astype(np.int32)
                made = pa.RecordBatch.from_arrays(
                    [
                        *[part.column(name) for name in part.schema.names if name != "text"],
                        pa.array(words.counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(hits, pa.binary()),
                        pa.ListArray.from_arrays(edges, names.take(pa.array(pairs[:, 1]))),
                    ],
                    names=[*[n for n in part.schema.names if n != "text"], "n_words", "n_hit", "hits", "items"],
                )
                yield made.filter(pa.array(np.array(counts) > 0)) if only_hits else made

    return scan


def _scanned(rows: DataFrame, windows: Windows, only_hits: bool = False) -> DataFrame:
    schema = StructType([*rows.drop("text").schema.fields, *StructType.fromDDL(_HITS).fields])
    return rows.mapInArrow(_scanner(windows, only_hits), schema)


def _joined_hits(batches):
    """Rows of (place, n_words, all, items): the bits of several passes laid over each other."""
    for batch in batches:
        every = [
            np.bitwise_or.reduce([np.frombuffer(bits, np.uint8) for bits in row])
            for row in batch.column("every").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("place"),
                pa.array([int(np.unpackbits(bits).sum()) for bits in every], pa.int64()),
                pa.array([bits.tobytes() for bits in every], pa.binary()),
                batch.column("items"),
            ],
            names=["place", "n_hit", "hits", "items"],
        )


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in tables that hold about ``block_bytes`` of text each."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [benchmark.filter(part == block) for block in range(blocks)]


def _windows(block: DataFrame, size: int) -> Windows:
    return Windows([(item, text) for item, text in block.collect()], size)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    share: int = SHARE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document a struct ``row`` of the columns in ``keep`` (default: all), ``n_words``, ``n_hit``,
    ``hits`` (one bit per word, null without a hit), ``items`` (sorted as strings), ``contaminated``.

    The windows of the test items are a hash set from about ``block_bytes`` of text, sent to the workers;
    an item longer than that is a block of its own. Hits by hash are verified word by word. A larger
    benchmark is scanned in as many passes, one set at a time; a pass writes only the documents it hits, and
    the passes are joined at the end. Nothing is left out at any size.

    A null or empty text has no words and is clean; items without words hold no window. A null item id
    is the string ``None``. Rows that repeat are judged row by row; empty ``docs`` give no rows, an
    empty ``benchmark`` no hits. Columns of ``docs`` stay inside ``row`` and clash with nothing.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"), F.col(f"`{text_col}`").alias("text")
    )
    blocks = _blocks(spread(benchmark, "item_id", "text"), block_bytes)
    if len(blocks) == 1:
        found = _scanned(rows, _windows(blocks[0], window))
    else:
        # The number of a row must be the same in every pass, so the numbered rows are a table.
        rows = staged(rows.withColumn("place", F.monotonically_increasing_id()), "texts")
        hits = None
        for block in blocks:
            own = staged(_scanned(rows.select("place", "text"), _windows(block, window), only_hits=True), "hits")
            hits = own if hits is None else hits.unionByName(own)
        hits = hits.groupBy("place").agg(
            F.collect_list("hits").alias("every"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        hits = hits.select("place", "every", "items").mapInArrow(
            _joined_hits, "place long, n_hit long, hits binary, items array<string>"
        )
        counted = _scanned(rows, Windows([], window)).drop("n_hit", "hits", "items")
        found = counted.join(staged(hits, "hits"), "place", "left")
        found = found.fillna({"n_hit": 0}).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    dirty = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return found.select("row", "n_words", "n_hit", "hits", "items", dirty.alias("contaminated"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words hit per document, the items that hit it, and the verdict."""
    found = contamination(spread(docs, "doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not contaminated, unchanged."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).filter(~F.col("contaminated")).select("row.*")


SQL = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), doc_words AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded
), item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
        FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM windows), doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM doc_words, sizes WHERE len(w) >= k)
), found AS (
  SELECT d.doc_id, d.i, d.k, v.item FROM doc_windows d JOIN windows v ON d.k = v.k AND d.win = v.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
