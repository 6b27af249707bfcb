"""Quality classifier: an additive model of binned features and pairs of features.

Training goes round the features; each turn fits a shallow tree to the gradient over the feature's bins
and adds a part of it to the feature's lookup table. Then the pairs that explain most of what is left get
two-way tables in the same way. A text's score is the sum of its table entries through a logistic curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import SPACED, Words, heard, sliced, spread

#: Labelled rows that training sees, as an expected number; a hash of the id chooses them.
TRAIN_ROWS = 8000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 60
PAIR_ROUNDS = 30
RATE = 0.15

FEATURES = [
    "log_bytes",
    "upper",
    "digits",
    "marks",
    "symbols",
    "bangs",
    "non_ascii",
    "stops",
    "lines_per_word",
    "word_bytes",
    "short_words",
    "distinct_words",
    "top_word",
    "distinct_runs",
]


def _class(text: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(text.encode())] = 1
    return table


_LETTERS = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_BYTES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _class("0123456789"),
    "marks": _class(",;:'\"()-"),
    "symbols": _class("#$%&*+/<=>@[\\]^_`{|}~"),
    "bangs": _class("!?"),
    "non_ascii": (np.arange(256) > 127).astype(np.uint8),
    "stops": _class("."),
    "newlines": _class("\n"),
    "letters": _LETTERS,
}


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[bounds]).astype(np.float64)


def features(texts: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` per text; a null or empty text has zeros."""
    words = Words(texts, SPACED)
    data, offsets, count = words.data, words.offsets, len(texts)
    sizes = np.diff(offsets).astype(np.float64)
    some = np.maximum(sizes, 1)
    seen = {name: _per_text(table[data], offsets) for name, table in _BYTES.items()}
    n_words = words.counts.astype(np.float64)
    w = np.maximum(n_words, 1)
    lengths = words.ends - words.starts
    owner = np.repeat(np.arange(count, dtype=np.uint64), words.counts)

    def distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort((of << np.uint64(40)) | (hashes >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
        times = np.diff(np.append(first, len(keys)))
        text = (keys[first] >> np.uint64(40)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        most = np.zeros(count)
        np.maximum.at(most, text, times)
        return np.bincount(text, minlength=count).astype(np.float64), most

    different, top = distinct(words.hashes, owner)
    runs, firsts = words.windows(3)
    run_owner = owner[firsts]
    different_runs, _ = distinct(runs, run_owner)
    n_runs = np.bincount(run_owner.astype(np.int64), minlength=count)
    made = {
        "log_bytes": np.log1p(sizes),
        "upper": seen["upper"] / np.maximum(seen["letters"], 1),
        "digits": seen["digits"] / some,
        "marks": seen["marks"] / some,
        "symbols": seen["symbols"] / some,
        "bangs": seen["bangs"] / some,
        "non_ascii": seen["non_ascii"] / some,
        "stops": seen["stops"] / w,
        "lines_per_word": (seen["newlines"] + 1) / w,
        "word_bytes": _per_text(lengths, words.bounds) / w,
        "short_words": _per_text(lengths <= 3, words.bounds) / w,
        "distinct_words": different / w,
        "top_word": top / w,
        "distinct_runs": different_runs / np.maximum(n_runs, 1),
    }
    return np.stack([np.where(sizes > 0, made[name], 0.0) for name in FEATURES], axis=1)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a run of bins by gradient and curvature sums."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    total_g, total_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of every bin in a tree of the given depth over ordered bins."""
    gain, cut = _best_cut(g, h)
    if not depth or gain <= 1e-6:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the better tree that cuts one axis and then each half on the other."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        gain, cut = _best_cut(gg.sum(axis=1), hh.sum(axis=1))
        if not cut:
            continue
        parts = []
        for rows in (slice(0, cut), slice(cut, None)):
            more, _ = _best_cut(gg[rows].sum(axis=0), hh[rows].sum(axis=0))
            gain += more
            line = _tree(gg[rows].sum(axis=0), hh[rows].sum(axis=0), 1)
            parts.append(np.tile(line, (gg[rows].shape[0], 1)))
        if gain > best[0]:
            table = np.concatenate(parts)
            best = (gain, table.T if turned else table)
    return best


class AdditiveModel:
    """Bin edges, one table per feature, tables of chosen pairs, and a constant."""

    def __init__(self, base: float = 0.0):
        self.base = base
        self.edges: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.tables:
            for bins, table in zip(self._bins(x, self.edges), self.tables):
                total += table[bins]
            coarse = self._bins(x, self.pair_edges)
            for a, b, table in self.pairs:
                total += table[coarse[a], coarse[b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Learn from rows of features and 0/1 labels; one class alone gives a constant."""
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        for bins, kept in ((BINS, self.edges), (PAIR_BINS, self.pair_edges)):
            for column in x.T:
                kept.append(np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])))
        fine, coarse = self._bins(x, self.edges), self._bins(x, self.pair_edges)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-total))
            return p - y, p * (1 - p)

        for _ in range(ROUNDS):
            for table, bins in zip(self.tables, fine):
                g, h = slopes()
                step = RATE * _tree(
                    np.bincount(bins, g, len(table)), np.bincount(bins, h, len(table))
                )
                table += step
                total += step[bins]
        g, h = slopes()
        gains = []
        for a in range(x.shape[1]):
            for b in range(a):
                shape = (len(self.pair_edges[a]) + 1, len(self.pair_edges[b]) + 1)
                cell = coarse[a] * shape[1] + coarse[b]
                sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
                gains.append((_tree_2d(*sums)[0], a, b, cell, shape))
        gains.sort(key=lambda entry: (-entry[0], entry[1], entry[2]))
        chosen = [(a, b, cell, np.zeros(shape)) for _, a, b, cell, shape in gains[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for _, _, cell, table in chosen:
                g, h = slopes()
                sums = [np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h)]
                step = RATE * _tree_2d(*sums)[1]
                table += step
                total += step.reshape(-1)[cell]
        self.pairs = [(a, b, table) for a, b, _, table in chosen]
        return self


def _measured(rows: DataFrame) -> DataFrame:
    """``row`` and the ``features`` of ``text``, which is dropped."""

    def measure(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                values = features(part.column("text"))
                flat = pa.array(values.reshape(-1), pa.float64())
                offsets = pa.array(np.arange(len(part) + 1) * len(FEATURES), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.ListArray.from_arrays(offsets, flat)],
                    names=["row", "features"],
                )

    kind = rows.select("row").schema
    return rows.mapInArrow(measure, kind.add("features", ArrayType(DoubleType())))


def train(
    docs: DataFrame,
    labels: DataFrame,
    learnt: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> AdditiveModel:
    """A model from labelled rows where ``learnt``, a condition on ``id``, holds.

    About ``train_rows`` labels are drawn by a hash of the id and sent to the workers, so the documents
    are only scanned. Without labels the model is the constant one half.
    """
    marks = labels.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")
    ).filter(learnt & F.col("id").isNotNull() & F.col("label").isin(0, 1))
    total = marks.count()
    share = int(min(1.0, train_rows / max(total, 1)) * (1 << 20))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("draw")), F.lit(1 << 20)) < share
    sample = (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        .filter(draw)
        .join(F.broadcast(marks.filter(draw)), "id")
    )
    rows = _measured(
        sample.select(F.struct("id", "label", F.xxhash64("text").alias("hash")).alias("row"), "text")
    ).collect()
    rows.sort(key=lambda row: (row.row.id, row.row.hash, row.row.label))
    if not rows:
        return AdditiveModel()
    x = np.array([row.features for row in rows], np.float64).reshape(len(rows), len(FEATURES))
    return AdditiveModel().fit(x, np.array([row.row.label for row in rows], np.float64))


def score(
    docs: DataFrame, model: AdditiveModel, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Per row a struct ``row`` of the columns in ``keep`` (default: all) and ``score`` from 0 to 1.

    A null or empty text has features of zero and gets the score the model gives those. Rows are scored
    one by one, an empty table gives no rows, and columns of ``docs`` clash with nothing in ``row``.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"),
        F.col(f"`{text_col}`").alias("text"),
    )

    def judge(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(model.score(features(part.column("text"))), pa.float64())],
                    names=["row", "score"],
                )

    return rows.mapInArrow(judge, rows.select("row").schema.add("score", "double"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every document, learnt from labels whose remainder by 3 is not 1."""
    model = train(docs, labels, heard(F.col("id"), 3) != 1)
    held = F.coalesce(heard(F.col("row.doc_id"), 3) == 1, F.lit(False))
    return score(spread(docs, "doc_id", "text"), model, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        held.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
