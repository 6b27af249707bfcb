"""Fingerprints and likeness against a plain SimHash."""

import re

import xxhash
from conftest import EDGES
from test_operators import followed

from quillstream.llm import op03_simhash

BITS = op03_simhash.BITS


def chained(hashes):
    seed = 42
    for value in hashes:
        seed = xxhash.xxh64(value.to_bytes(8, "little"), seed=seed).intdigest()
    return seed


def plain(text):
    """The fingerprint as an unsigned number: every run of words votes for the bits of its hash."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    size = op03_simhash.TERM_WORDS
    runs = [chained(hashes[k : k + size]) for k in range(len(hashes) - size + 1)]
    if hashes and len(hashes) < size:
        runs = [chained(hashes)]
    return sum(1 << k for k in range(BITS) if 2 * sum(run >> k & 1 for run in runs) > len(runs))


def test_fingerprints_equal_plain_votes(docs):
    rows = [(k, text) for k, (_, text) in enumerate(EDGES)] + [(100, "one"), (101, "one two"), (102, "a b c d e f g h")]
    prints = op03_simhash.fingerprints(docs(rows, clashes=False), ["doc_id"], "text").collect()
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in prints} == {k: plain(t) for k, t in rows}


def test_likeness_is_the_share_of_equal_bits(docs):
    rows = [(k, f"{text} {k % 3}") for k, (_, text) in enumerate(EDGES) if text and len(text) < 300]
    got = {r.doc_id: (r.near_edited, r.near_next) for r in op03_simhash.query(docs(rows, clashes=False)).collect()}
    for doc_id, text, edited, after in followed(rows):
        want = [1 - (plain(text) ^ plain(other)).bit_count() / BITS for other in (edited, after)]
        assert got[doc_id] == tuple(want)
