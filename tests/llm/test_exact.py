"""Exact dedup against a plain form: edge rows, ties, several regions, and what passes the filter."""

import re
from collections import defaultdict

from brute import sha
from conftest import CLASHES, EDGES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.llm import op12_exact

DATA = "/root/testdata/sf0.001"


def plain(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) per row."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text or "")
        keep = min(groups[bare])[3]
        out.append((doc_id, keep, len(groups[bare]), doc_id == keep, sha(bare)))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


TIES = [
    (20, "same words"),
    (21, "same  words"),
    (22, " samewords "),
    (23, "samewords  \n"),
    (24, "Same words"),
    (25, "same words"),
    (25, "same words"),
    (None, "same\twords      "),
    (26, "\x00a"),
    (27, "a"),
    (28, "two texts under one id"),
    (28, "same words"),
]


def test_edge_rows_and_ties(docs, empty):
    rows = EDGES + TIES
    assert found(op12_exact.query(docs(rows))) == plain(rows)
    assert op12_exact.query(empty).count() == 0
    assert op12_exact.query(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_regions_and_small_filters_change_nothing(docs):
    rows = [(k, f"text {k % 700} " + " " * (k % 3)) for k in range(2000)] + [(5000 + k, "one hot text") for k in range(1000)]
    frame = docs(rows, clashes=False)
    want = [r[:4] for r in plain(rows)]
    for bits in (1 << 29, 1 << 15, 3 << 12):
        groups = op12_exact.exact_groups(frame, filter_bits=bits)
        assert found(groups.select("doc_id", "keep_id", "group_size", "kept")) == sorted(want, key=repr)


def test_most_single_rows_pass_straight_through(docs):
    rows = [(k, f"a text of its own {k}") for k in range(4000)] + [(9000 + k, f"twice {k // 2}") for k in range(200)]
    narrow = op12_exact.digests(docs(rows, clashes=False), "doc_id", "text")
    marked = op12_exact.Filters(narrow).probe(narrow)
    suspects = {r.doc_id for r in marked.filter("suspect").collect()}
    assert suspects >= {9000 + k for k in range(200)}
    assert len(suspects) < 200 + 0.1 * 4000


def test_the_plan_runs_no_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = op12_exact.query(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_deduplicate_keeps_whole_rows(docs):
    rows = EDGES + TIES
    frame = docs(rows)
    left = op12_exact.deduplicate(frame)
    assert left.columns == frame.columns and left.select(*CLASHES).distinct().count() == 1
    dropped = {(r[0], r[4]) for r in plain(rows) if not r[3] and r[0] is not None}
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=repr) == sorted(
        [r for r in rows if (r[0], sha(re.sub("[\x20\x09-\x0d]", "", r[1] or ""))) not in dropped], key=repr
    )


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.text(alphabet=" \tab\né", max_size=4) | st.none()), min_size=1, max_size=25))
def test_any_rows(docs, rows):
    assert found(op12_exact.query(docs(rows, clashes=False))) == plain(rows)
