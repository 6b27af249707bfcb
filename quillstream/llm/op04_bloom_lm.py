"""Language-model scores from a log-frequency Bloom filter.

Documents become blocks: per block the distinct words, their training counts, and for every word of
every text its place among them. Each block sends its distinct words and pairs of neighbours to the
regions of their keys. A region sums their counts over the corpus, holds them in a Bloom filter in which an
n-gram of quantised count q is present at the levels 1 to q, and reads every key's count by probing level
after level until one is missing. What it found goes back to the blocks, in the order of the keys, with the
exact counts of the words for the base score. No n-gram is left out: the regions grow in number with the
corpus, and none is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, SPACED, Words, heard, mix, sliced, spread, stage as staged

#: Text bytes in a block, and tokens that are scored at once.
BLOCK_BYTES = 8 << 20
PASS_TOKENS = 1 << 18
#: Bits an entry of the filter gets at least, and probes per entry.
BITS_PER_ENTRY = 10
PROBES = 4
#: Regions at least, and tokens of the corpus per region at most: the bound on what a task holds.
REGIONS = 64
REGION_TOKENS = 1 << 22
#: Each level of the quantised counts is so much larger than the one before.
WORD_BASE, PAIR_BASE = 1.25, 2.0
#: Weight of the pair estimate beside the word estimate.
PAIR_WEIGHT = 0.2
#: A page holds all bits of its n-grams.
PAGE_BITS = 1 << 15

_END, _START = 0x656E64, 0x7374617274


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    """Quantised count: 0 for none, else 1 + floor(log of the count)."""
    counts = np.asarray(counts, np.float64)
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9), 0).astype(
        np.int64
    )


def count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """Middle of the counts of a level."""
    return np.where(levels > 0, (base ** (levels - 1.0) + np.maximum(base**levels - 1, base ** (levels - 1.0))) / 2, 0.0)


def word_key(hashes: np.ndarray) -> np.ndarray:
    """Keys of words are odd, those of pairs even."""
    return mix(hashes ^ np.uint64(0x77)) | np.uint64(1)


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before) * BASE + after) & ~np.uint64(1)


class LogFrequencyFilter:
    """Bits in pages, as many as a power of two: the key chooses the page, key and level the bits in it."""

    def __init__(self, pages: int):
        self.pages = pages
        self.bits = np.zeros(pages * PAGE_BITS // 8, np.uint8)

    def page(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(1)) & np.uint64(self.pages - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
        salt = mix(np.atleast_1d(np.asarray(level, np.uint64)) * np.uint64(64) + np.uint64(probe + 1))
        return self.page(keys) * PAGE_BITS + (mix(keys ^ salt) & np.uint64(PAGE_BITS - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        """Enter keys at all levels up to their own."""
        keys = np.repeat(keys, levels)
        level = np.arange(1, len(keys) + 1) - np.repeat(np.cumsum(levels) - levels, levels)
        for probe in range(PROBES):
            place = self._places(keys, level, probe)
            np.bitwise_or.at(self.bits, place >> 3, (1 << (place & 7)).astype(np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level present in an unbroken run from 1; 0 where the first is missing."""
        found = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        level = 1
        while len(alive):
            own = keys[alive]
            there = np.ones(len(alive), bool)
            for probe in range(PROBES):
                place = self._places(own, level, probe)
                there &= (self.bits[place >> 3] >> (place & 7)) & 1 == 1
            alive = alive[there]
            found[alive] = level
            level += 1
        return found


def blocks(docs: DataFrame, learnt: Column, text_col: str, keep: list[str], block_bytes: int) -> DataFrame:
    """Blocks of documents as rows, written to the shared folder.

    ``rows`` are the kept columns, ``n_words`` and ``learnt`` one entry per document, ``places``
    (compressed 32-bit numbers) every word's place in ``hashes``, ``counts`` the occurrences in learnt
    documents.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"),
        F.coalesce(learnt, F.lit(False)).alias("learnt"),
        F.col(f"`{text_col}`").alias("text"),
    )

    def build(batches):
        number = TaskContext.get().partitionId() << 17
        for batch in batches:
            for part in sliced(batch, "text", block_bytes):
                words = Words(part.column("text"), SPACED)
                hashes, places = np.unique(words.hashes, return_inverse=True)
                taught = part.column("learnt").to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(places[np.repeat(taught, words.counts)], minlength=len(hashes))
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("row")),
                        pa.array([words.counts.tolist()], pa.list_(pa.int64())),
                        pa.array([taught.tolist()], pa.list_(pa.bool_())),
                        pa.array([_squeezed(places.astype(np.int32))], pa.binary()),
                        _lists(hashes.view(np.int64)),
                        _lists(counts),
                    ],
                    names=["block", "rows", "n_words", "learnt", "places", "hashes", "counts"],
                )

    schema = rows.select(
        F.lit(0).cast("long").alias("block"),
        F.array("row").alias("rows"),
        F.array().cast("array<long>").alias("n_words"),
        F.array().cast("array<boolean>").alias("learnt"),
        F.lit(None).cast("binary").alias("places"),
        F.array().cast("array<long>").alias("hashes"),
        F.array().cast("array<long>").alias("counts"),
    ).schema
    return staged(rows.mapInArrow(build, schema), "blocks")


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))


def _squeezed(places: np.ndarray) -> bytes:
    data = places.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _stretched(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd"), np.int32)


def _passes(row: pa.RecordBatch):
    """A block's texts in runs of about ``PASS_TOKENS``: places of the words, words per text, first text."""
    places = _stretched(row.column("places")[0].as_py())
    n_words = np.asarray(row.column("n_words").flatten())
    ends = np.cumsum(n_words)
    first = 0
    while first < len(n_words):
        begin = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, begin + PASS_TOKENS, side="right")))
        yield places[begin : ends[stop - 1]], n_words[first:stop], first
        first = stop


def _tokens(hashes: np.ndarray, places: np.ndarray, n_words: np.ndarray):
    """Hashes of the words of each text followed by the end, those before them, and the text bounds."""
    bounds = np.concatenate([[0], np.cumsum(n_words + 1)])
    token = np.full(bounds[-1], np.uint64(_END))
    is_word = np.ones(bounds[-1], bool)
    is_word[bounds[1:] - 1] = False
    token[is_word] = hashes[places]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[bounds[:-1]] = np.uint64(_START)
    return token, before, is_word, bounds


def _grams(hashes: np.ndarray, token: np.ndarray, before: np.ndarray):
    """Sorted distinct keys of a block's words and pairs, the places of the words among them, and those of
    the pair that ends at each token."""
    keys = np.concatenate([word_key(hashes), pair_key(before, token)])
    keys, back = np.unique(keys, return_inverse=True)
    return keys, back[: len(hashes)], back[len(hashes) :]


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers as eight runs of bytes of one rank, of which the high ones compress to nothing."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def ngrams(blocks_: DataFrame, regions: int) -> DataFrame:
    """(region, block, keys, counts): a block's distinct n-grams in each region of keys, in order (as
    differences), with their occurrences in learnt documents. ``regions`` is a power of two above 1."""
    shift = np.uint64(64 - (regions.bit_length() - 1))

    def send(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                hashes = np.asarray(row.column("hashes").flatten()).view(np.uint64)
                n_words = np.asarray(row.column("n_words").flatten())
                taught = np.asarray(row.column("learnt").flatten().cast(pa.int8())).astype(bool)
                token, before, _, _ = _tokens(hashes, _stretched(row.column("places")[0].as_py()), n_words)
                keys, words, pairs = _grams(hashes, token, before)
                counts = np.bincount(pairs[np.repeat(taught, n_words + 1)], minlength=len(keys))
                counts[words] = np.asarray(row.column("counts").flatten())
                region = (keys >> shift).astype(np.int64)
                here = np.unique(region)
                cuts = [*np.searchsorted(region, here), len(keys)]
                spans = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(here, pa.int32()),
                        pa.array(np.full(len(here), row.column("block")[0].as_py()), pa.int64()),
                        pa.array([_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
                        pa.array([_planes(counts[a:b]) for a, b in spans], pa.binary()),
                    ],
                    names=["region", "block", "keys", "counts"],
                )

    rows = blocks_.select("block", "places", "hashes", "n_words", "learnt", "counts")
    return rows.mapInArrow(send, "region int, block long, keys binary, counts binary")


def region_levels(table: pa.Table) -> pa.Table:
    """What the filter of one region holds of each key in its rows: ``levels`` (a byte per key), and
    ``exact`` counts of the words alone. ``words``, on one row, is how many words were learnt."""
    keys = [np.cumsum(_values(data.as_py()), dtype=np.uint64) for data in table.column("keys")]
    counts = np.concatenate([_values(data.as_py()) for data in table.column("counts")])
    cuts = np.concatenate([[0], np.cumsum([len(own) for own in keys])])
    keys, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, back, counts.view(np.int64))
    is_word = keys & np.uint64(1) == 1
    levels = np.where(is_word, level_of(total, WORD_BASE), level_of(total, PAIR_BASE))
    pages = 1
    while pages * PAGE_BITS < levels.sum() * BITS_PER_ENTRY:
        pages *= 2
    held = LogFrequencyFilter(pages)
    held.add(keys[levels > 0], levels[levels > 0])
    found = held.levels(keys).astype(np.uint8)
    spans = [back[a:b] for a, b in zip(cuts, cuts[1:])]
    learnt = np.zeros(len(spans), np.int64)
    learnt[0] = np.count_nonzero(is_word & (total > 0))
    return pa.table(
        {
            "region": table.column("region"),
            "block": table.column("block"),
            "levels": pa.array([found[own].tobytes() for own in spans], pa.binary()),
            "exact": pa.array([_planes(total[own[is_word[own]]]) for own in spans], pa.binary()),
            "words": pa.array(learnt, pa.int64()),
        }
    )


def log_chances(totals: dict, by_word, pairs, places, before, is_word) -> np.ndarray:
    """log10 of the smoothed probability of every token, from the counts that the filter gave for the
    block's words and for the pair that ends at each token."""
    size = totals["tokens"] + totals["words"] + 1.0
    end_count = float(totals["texts"])
    count = np.full(len(before), end_count)
    count[is_word] = by_word[places]
    chance = (count + 1) / size
    history = np.empty(len(before))
    history[1:] = count[:-1]
    history[before == np.uint64(_START)] = end_count
    estimate = np.minimum(1.0, pairs / np.maximum(history, 1))
    weight = np.where(history > 0, PAIR_WEIGHT, 0.0)
    return np.log10((1 - weight) * chance + weight * estimate)


def scores(
    docs: DataFrame,
    learnt: Column,
    text_col: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    region_tokens: int = REGION_TOKENS,
) -> DataFrame:
    """Per row ``row`` (columns in ``keep``, default all), ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (exact add-one unigram) and ``score`` (the filter's model).

    Tokens are runs between ASCII white space with A-Z in lower case, then one end. Counts cover all
    documents for which ``learnt`` holds; where it is null a document is scored but not learnt from.
    A null or empty text is its end alone. Without learnt documents every probability is one and the
    base score 0. Rows that repeat count and are scored each; an empty table gives no rows. A word's
    identity is a 63-bit hash. ``keep`` columns lie inside ``row``, so none clashes.
    """
    keep = docs.columns if keep is None else keep
    held = blocks(docs, learnt, text_col, keep, block_bytes)
    mass, texts, tokens = held.agg(
        *[
            F.coalesce(F.sum(size), F.lit(0)).cast("long")
            for size in (
                F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x),
                F.size(F.filter("learnt", lambda x: x)),
                F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x + 1),
            )
        ]
    ).first()
    regions = REGIONS
    while regions * region_tokens < tokens:
        regions *= 2
    found = staged(
        ngrams(held, regions)
        .groupBy("region")
        .applyInArrow(
            region_levels, "region int, block long, levels binary, exact binary, words long"
        ),
        "levels",
    )
    words = found.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    totals = {"tokens": mass + texts, "words": words + (1 if texts else 0), "texts": texts}
    returned = found.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("region", "levels", "exact"))).alias("found")
    )
    joined = held.select("block", "rows", "n_words", "places", "hashes").join(returned, "block", "left")
    types = docs.select(F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row")).schema
    schema = types.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def judge(batches):
        size = totals["tokens"] + 1.0 * (totals["words"] + 1)
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                hashes = np.asarray(row.column("hashes").flatten()).view(np.uint64)
                cells = row.column("found").flatten()
                levels = np.frombuffer(b"".join(cells.field("levels").to_pylist()), np.uint8).astype(np.int64)
                exact_of = [_values(data) for data in cells.field("exact").to_pylist()]
                whole = _tokens(hashes, _stretched(row.column("places")[0].as_py()), np.asarray(row.column("n_words").flatten()))
                keys, own, pairs_at = _grams(hashes, *whole[:2])
                by_key = np.zeros(len(keys), np.int64)
                if exact_of:
                    by_key[keys & np.uint64(1) == 1] = np.concatenate(exact_of).view(np.int64)
                counts, by_word = by_key[own], count_of(levels[own], WORD_BASE)
                pairs_of = count_of(np.arange(256), PAIR_BASE)[levels[pairs_at]]
                texts_of = row.column("rows").flatten()
                done = 0
                for places, n_words, first in _passes(row):
                    token, before, is_word, bounds = _tokens(hashes, places, n_words)
                    exact = np.full(len(token), totals["texts"])
                    exact[is_word] = counts[places]
                    each = np.log10((exact + 1) / size)
                    pairs = pairs_of[done : done + len(token)]
                    done += len(token)
                    smooth = log_chances(totals, by_word, pairs, places, before, is_word)
                    if not totals["tokens"]:
                        smooth = np.zeros(len(token))
                    yield pa.RecordBatch.from_arrays(
                        [
                            texts_of.slice(first, len(n_words)),
                            pa.array(n_words + 1, pa.int64()),
                            pa.array(np.add.reduceat((exact > 0).astype(np.int64), bounds[:-1]), pa.int64()),
                            pa.array(np.add.reduceat(each, bounds[:-1]), pa.float64()),
                            pa.array(np.add.reduceat(smooth, bounds[:-1]), pa.float64()),
                        ],
                        names=["row", "n_tokens", "n_known", "base_score", "score"],
                    )

    scored = joined.select("rows", "n_words", "places", "hashes", "found").mapInArrow(judge, schema)
    return scored.withColumn("train_tokens", F.lit(totals["tokens"]).cast("long"))


def query(docs: DataFrame) -> DataFrame:
    """Base and model score of every document; documents with remainder 2 by 7 are held out."""
    remainder = heard(F.col("doc_id"), 7)
    found = scores(spread(docs, "doc_id", "text"), remainder != 2, keep=["doc_id"])
    held = F.coalesce(heard(F.col("row.doc_id"), 7) == 2, F.lit(False))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
