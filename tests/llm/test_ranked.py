"""Ranked search against a plain form: ties, odd rows, several blocks and small tiles."""

import math
import re
from collections import Counter

from brute import FOLD
from conftest import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import op13_ranked

WORD = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    return re.findall(WORD, (text or "").translate(FOLD))


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score), all scores by hand."""
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    full = sum(bool(bag) for _, bag in bags)
    total = sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scores = []
        for doc_id, bag in bags:
            divisor = 10 + (90 * sum(bag.values()) * full) // total if total else 0
            score = 0
            for word in words & set(bag):
                weight = math.floor(1000 * math.log((2 * full + 2) / (2 * df[word] + 1)))
                score += weight * ((1_000_000_000 * bag[word]) // (1000 * bag[word] + 8 * divisor))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string").withColumns(
            {name: F.lit("own") for name in ("term", "score", "rank")}
        )

    return make


ITEMS = [
    (1, "quick brown FOX; the line of text"),
    (2, None),
    (3, " .-! "),
    (4, "word1 and3 word1 naïve 中文字符 tail"),
    (5, "nowhere found zzzz"),
    (6, "aaaaa " + "a" * 5000),
    (6, "one long"),
    (None, "fox card"),
]


def test_edge_rows(docs, items, empty):
    assert found(op13_ranked.query(docs(EDGES), items(ITEMS))) == plain(EDGES, ITEMS)
    assert op13_ranked.query(empty, items(ITEMS)).count() == 0
    assert op13_ranked.query(docs(EDGES), items([])).count() == 0
    assert op13_ranked.query(empty, items(ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_across_tiles_and_blocks(docs, items):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"t{j}" for j in rng.integers(0, 30, rng.integers(1, 6)))) for k in range(400)]
    rows += [(1000 - k, "t1 t2 same text") for k in range(300)]
    asked = [(k, " ".join(f"t{j}" for j in rng.integers(0, 34, 7))) for k in range(23)]
    want = plain(rows, asked)
    for pairs, shape in ((1 << 20, (512, 256, 4096)), (40, (16, 4, 3)), (1 << 20, (64, 5, 2))):
        got = op13_ranked.ranked(docs(rows, clashes=False).repartition(5), items(asked), block_pairs=pairs, shape=shape)
        assert found(got) == want


def test_no_partial_sum_reaches_the_limit_of_doubles():
    block = op13_ranked.Block([1], pa.array(["a", "b", "c"], pa.large_string()), np.zeros(3, int), np.arange(3))
    weight = np.full(3, 2**33)
    tiles = op13_ranked._item_tiles(block, weight, 8, 4096)
    largest = max(len(numbers) for _, _, parts in tiles for numbers, *_ in parts)
    assert largest * int(weight[0]) * 1_000_000 < 2**53 or largest == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" aZ9é-中\x00", max_size=9) | st.none(), max_size=7))
def test_terms_equal_the_pattern(texts):
    got = op13_ranked.Terms(pa.array(texts, pa.string()))
    words = got.values.to_pylist()
    assert [words[a:b] for a, b in zip(got.bounds, got.bounds[1:])] == [terms(t) for t in texts]
