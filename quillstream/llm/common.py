"""Helpers the text operators share: bounded Arrow slices, word hashes over byte buffers, staging.

Words are hashed straight from the UTF-8 buffer of an Arrow column: a prefix sum of
``byte * BASE**position`` gives every word's polynomial in a few array operations, so no Python
object is made per word. Hashes only select; whoever needs certainty compares the bytes as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.session import stage, work_dir

__all__ = ["stage", "work_dir"]

#: Text bytes that one pass of array operations covers, so that its temporaries stay small.
SLICE_BYTES = 1 << 21
#: Bytes that are hashed at once: some arrays of eight bytes for each.
HASH_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space: space and the five controls from tab to carriage return.
WHITE = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NOT_WHITE = np.ones(256, bool)
_NOT_WHITE[list(WHITE)] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True
#: Byte classes after A-Z are lower-cased: runs between white space, and runs of a-z, 0-9 and non-ASCII.
SPACED, ALNUM = "spaced", "alnum"
_CLASSES = {SPACED: _NOT_WHITE, ALNUM: _ALNUM}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up = np.cumprod(np.full(1 << 16, BASE), dtype=np.uint64)
    down = np.cumprod(np.full(1 << 16, inverse), dtype=np.uint64)
    return up, down


_TABLES = list(_powers())
_UP, _DOWN = 0, 1


def _power(which: int, n: int) -> np.ndarray:
    """``n`` powers of the base or of its inverse, beginning with the first power."""
    while len(_TABLES[which]) < n:
        table = _TABLES[which]
        _TABLES[which] = np.concatenate([table, table * table[-1]])
    return _TABLES[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def heard(key: Column, modulus: int) -> Column:
    """The remainder that deals documents into learnt and held-out ones; a null id gives null."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``limit`` bytes together, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len + 1 offsets of the texts in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: hash, first byte and end of each, and the texts' word bounds.

    ``data`` and ``offsets`` are what :func:`raw` gives; byte positions count in ``data``.
    """

    def __init__(self, texts: pa.Array, kind: str):
        self.data, self.offsets = raw(texts)
        is_word = _CLASSES[kind]
        hashes, starts, ends = [], [], []
        at, total = 0, len(self.data)
        edges = self.offsets
        while at < total:
            stop = min(total, at + HASH_BYTES)
            while stop < total:  # never cut a word: go on to a byte that ends one
                tail = is_word[_FOLD[self.data[stop - 1 : stop + HASH_BYTES]]]
                gap = np.flatnonzero(~tail)
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(total, stop + HASH_BYTES)
            part = _FOLD[self.data[at:stop]]
            inside = is_word[part]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, stop, "left")] - at
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_UP, len(part)), out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * _power(_DOWN, len(part) + 1)[s]))
            starts.append(s + at)
            ends.append(e + at)
            at = stop
        empty = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        self.starts = np.concatenate(starts) if starts else empty
        self.ends = np.concatenate(ends) if ends else empty
        #: Word numbers at which the texts begin, and the number of all words.
        self.bounds = np.searchsorted(self.starts, self.offsets, "left")

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text(self, word: int) -> bytes:
        return _FOLD[self.data[self.starts[word] : self.ends[word]]].tobytes()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words that lies in one text, and the number of its first word."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * BASE + self.hashes[k : k + n]
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        whole = np.flatnonzero(text[:n] == text[size - 1 :])
        return mix(total[whole] ^ np.uint64(size)), whole


def spread(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that no other column can clash with an operator's own."""
    return docs.select(*[F.col(f"`{name}`") for name in columns])


def bit_map(rows: DataFrame, bit: Column, size: int) -> np.ndarray:
    """A bool per number below ``size``, set for the values of ``bit``: a map of a fixed size, whatever
    the rows, that tells a scan what it can pass over. ``size`` is a multiple of 32768."""
    found = (
        rows.select(bit.cast("long").alias("bit"))
        .groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
        .collect()
    )
    may = np.zeros(size, bool)
    for row in found:  # bucket n, from 1 on, holds the numbers from (n - 1) * 32768 + 1
        own = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")[:32768]
        may[(row.bucket - 1) * 32768 : row.bucket * 32768] = own.astype(bool)
    return may


def runs(batches, key: list[str]):
    """Record batches cut so that rows with equal ``key``, which follow each other, stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(name)) for name in key]
        new = np.zeros(len(batch), bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        if held and any(column[0] != np.asarray(held[-1].column(name))[-1] for name, column in zip(key, columns)):
            new[0] = True
        cuts = np.flatnonzero(new)
        if len(cuts):
            if held or cuts[0]:
                yield pa.Table.from_batches([*held, batch.slice(0, cuts[0])]).combine_chunks()
            if cuts[-1] > cuts[0]:
                yield pa.Table.from_batches([batch.slice(cuts[0], cuts[-1] - cuts[0])])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
