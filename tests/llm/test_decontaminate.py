"""Decontamination against large benchmarks, in several passes, and with hashes that collide."""

import time

import numpy as np
import pyarrow as pa
from brute import sha
from test_operators import brute_hits

from quillstream.llm import op05_decontaminate
from quillstream.llm.common import ALNUM, Words

DATA = "/root/testdata/sf0.001"


def prose(rng, words):
    return " ".join(f"w{k}" for k in rng.integers(0, 4000, words))


def test_a_benchmark_of_megabytes_builds_in_seconds():
    rng = np.random.default_rng(2)
    items = [(k, prose(rng, 60)) for k in range(15_000)] + [(20_000, prose(rng, 100_000))]
    assert sum(len(text) for _, text in items) > 5_000_000
    start = time.time()
    windows = op05_decontaminate.Windows(items, 13)
    assert time.time() - start < 30
    text = "nothing here " + items[77][1] + " between " + items[-1][1][:3000]
    hit, pairs = windows.scan(Words(pa.array([text]), ALNUM))
    assert {windows.names[k] for _, k in pairs} == {"77", "20000"}
    assert hit.sum() == 60 + len(items[-1][1][:3000].rsplit(" ", 1)[0].split())


def test_passes_equal_one_scan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    total = sum(len(r.text.encode()) for r in benchmark.collect())
    columns = ["row", "n_words", "n_hit", "hits", "items", "contaminated"]
    one = op05_decontaminate.contamination(docs, benchmark, keep=["doc_id"]).select(columns)
    some = op05_decontaminate.contamination(docs, benchmark, keep=["doc_id"], block_bytes=total // 3).select(columns)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, some.collect()))
    assert one.where("n_hit > 0").count() > 0


def test_windows_whose_hashes_collide(monkeypatch):
    class Colliding(Words):
        def windows(self, size):
            hashes, firsts = super().windows(size)
            return hashes % np.uint64(2), firsts

    monkeypatch.setattr(op05_decontaminate, "Words", Colliding)
    items = [(1, "a b c"), (2, "d e f"), (3, "a b c"), (4, "g h"), (5, "b c"), (6, "x"), (7, "q a b c d e f")]
    windows = op05_decontaminate.Windows(items, 3)
    texts = ["a b c d e f", "g h g h x", "c b a", "nothing", "q a b c", "b b c"]
    hit, pairs = windows.scan(Colliding(pa.array(texts), ALNUM))
    at = 0
    for k, text in enumerate(texts):
        words, hits, found, ids, _ = brute_hits(text, items, 3)
        assert hit[at : at + words].sum() == hits
        assert sha(",".join(windows.names[n] for t, n in pairs if t == k)) == ids
        at += words


def test_a_document_of_megabytes(spark):
    rng = np.random.default_rng(4)
    items = [(1, prose(rng, 40)), (2, prose(rng, 5)), (3, prose(rng, 40))]
    text = prose(rng, 400_000) + " " + items[0][1] + " " + prose(rng, 400_000) + " " + items[1][1]
    docs = spark.createDataFrame([(1, text), (2, items[2][1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in op05_decontaminate.query(docs, benchmark).collect()}
    assert got == {1: brute_hits(text, items), 2: brute_hits(items[2][1], items)}
