"""Every operator against a plain form on edge cases, empty tables and columns that clash."""

import hashlib
import math
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import near_groups, private, remainder, sha, spaced, unigrams
from conftest import CLASHES, EDGES, LONG, PROSE
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstream.llm import (
    op01_tokens,
    op02_pii,
    op03_simhash,
    op04_bloom_lm,
    op05_decontaminate,
    op06_chosen_path,
    op07_language,
    op08_lines,
    op09_bpe,
    op10_quality,
)

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
DATA = "/root/testdata/sf0.001"


def sorted_rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def by_repr(rows):
    return sorted((tuple(row) for row in rows), key=repr)


def source(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# ---- 1 token counts ---------------------------------------------------------------------------


def count(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_token_counts(edges, empty):
    want = [(d, len((t or "").encode()), count(t or "")) for d, t in EDGES]
    got = op01_tokens.token_counts(edges, chunk=300, overlap=4).collect()
    assert by_repr(r[:3] for r in got) == by_repr(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert max(r.n_chunks for r in got) > 100 and max(r.n_widened for r in got) > 5
    assert op01_tokens.query(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tabcTHE'sre1é中<|>ofndx🙂 ", max_size=90), st.integers(3, 30), st.integers(1, 9))
def test_spliced_counts_equal_whole_counts(text, chunk, overlap):
    encode, lengths = op01_tokens.encoder(
        public_tokenizers.path(op01_tokens.TOKENIZER), public_tokenizers.path(op01_tokens.RANKS)
    )
    assert op01_tokens.count_long(text, encode, lengths, chunk, overlap)[0] == count(text)


# ---- 2 private data ---------------------------------------------------------------------------


def test_private_spans(edges, empty):
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in op02_pii.query(edges).collect()]
    assert by_repr(got) == by_repr((d, *private(t)[:5]) for d, t in EDGES)
    assert op02_pii.query(empty).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.. -+@@ab_%()é\n", max_size=70))
def test_spans_equal_the_patterns(text):
    said = ",".join(f"{op02_pii.KINDS[k]}:{a}:{b}" for a, k, b in op02_pii.base_spans(text))
    assert said == private(text)[5]


def test_long_runs_take_linear_time():
    assert op02_pii.base_spans("9" * 400_000 + "@" * 100_000 + "a" * 400_000) == []


def test_a_disclosing_term_is_marked_and_generalised(docs):
    filler = ["alpha beta gamma delta", "ground water level report", "music played in hall", "green hills and fields"]
    rows = [(k, f"note {k} {filler[k % 4]} from Zorbelius to max@corp.org about {filler[(k + 1) % 4]} {k}") for k in range(4)]
    rows += [(100 + k, f"{filler[k % 4]} text number {k} from the office to you about water") for k in range(400)]
    found = {r.doc_id: r for r in op02_pii.query(docs(rows)).collect()}
    for doc_id, text in rows[:4]:
        spans = [s.split(":") for s in found[doc_id].spans.split(",")]
        terms = {text[int(a) : int(b)] for kind, a, b in spans if kind == "term"}
        assert "Zorbelius" in terms and "water" not in terms and "from" not in terms
        assert [s for s in spans if s[0] != "term"] == [s.split(":") for s in private(text)[5].split(",")]
    assert all(found[d].spans == "" for d, _ in rows[4:])
    clean = {r.doc_id: r.text for r in op02_pii.sanitise(docs(rows)).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "Zorbelius" not in clean[0]
    assert clean[100] == rows[4][1]


def test_a_disclosing_term_is_marked_wherever_it_stands(docs):
    far = " ".join(f"then{k}" for k in range(40))
    rows = [(k, f"é note{k} from Zorbelius to max@corp.org today{k} {far} and ZORBELIUS again") for k in range(4)]
    rows += [(10, f"only zorbelius here, zorbelius.x@corp.org not")]
    rows += [(100 + k, f"text number {k} from the office to you about water {far} and again") for k in range(400)]
    found = {r.doc_id: r for r in op02_pii.query(docs(rows)).collect()}
    for doc_id, text in rows[:5]:
        spans = [s.split(":") for s in found[doc_id].spans.split(",")]
        terms = [text[int(a) : int(b)].lower() for kind, a, b in spans if kind == "term"]
        assert terms.count("zorbelius") == (2 if doc_id < 4 else 1)
    assert all(found[d].spans == "" for d, _ in rows[5:])
    clean = {r.doc_id: r.text for r in op02_pii.sanitise(docs(rows)).collect()}
    assert not any("zorbelius" in clean[d].lower() for d, _ in rows[:5])


# ---- 3 fingerprints ---------------------------------------------------------------------------


def followed(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for (doc_id, text), (_, after) in zip(order, [*order[1:], *order[:1]]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        yield doc_id, text, text[: len(text) - cut] + after[:cut], after


def test_fingerprints_of_edited_texts(edges, empty, monkeypatch):
    monkeypatch.setattr(op03_simhash, "BUCKET_ROWS", 3)
    got = op03_simhash.query(edges).collect()
    assert by_repr(r[:3] for r in got) == by_repr((d, len(t), sha(e)) for d, t, e, _ in followed(EDGES))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault((r.n_chars, r.doc_id if r.n_chars else 0), set()).add(r.fingerprint)
    assert len({r.fingerprint for r in got if r.n_chars == len(PROSE)}) == 1
    assert op03_simhash.query(empty).count() == 0


def test_one_document_follows_itself(docs):
    row = op03_simhash.query(docs([(3, "some words of one text")])).first()
    assert row.near_next == 1.0 and row.n_near == 0


def test_likeness_tells_edits_from_strangers(spark):
    got = op03_simhash.query(source(spark)).collect()
    texts = {r.doc_id: r.text for r in source(spark).collect()}
    assert {r.doc_id: r.edited_sha256 for r in got} == {d: sha(e) for d, _, e, _ in followed(texts.items())}
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.15


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(4)
    values = [int(v) for v in rng.integers(-(2**63), 2**63, 300)]
    for v in values[:120]:
        bits = rng.choice(64, rng.integers(1, 6), replace=False)
        changed = (v & (2**64 - 1)) ^ sum(1 << int(b) for b in bits)
        values.append(changed - 2**64 if changed >> 63 else changed)
    frame = spark.createDataFrame([(v,) for v in values + values[:5]] + [(None,)], "fingerprint BIGINT")
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for radius in (0, 1, 3):
        want = {(a, b) for a in values for b in values if a < b and apart(a, b) <= radius}
        got = op03_simhash.within_radius(frame, radius)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


# ---- 4 language model -------------------------------------------------------------------------


def scores(frame, **options):
    learnt = op04_bloom_lm.heard(F.col("doc_id"), 7) != 2
    found = op04_bloom_lm.scores(frame, learnt, keep=["doc_id"], **options)
    return [(r.row.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()]


def test_base_scores(docs, empty):
    rows = [(d, t) for d, t in EDGES if d is not None]
    want = by_repr((d, n, k, total, round(s, 6)) for d, _, n, k, total, s in unigrams(rows))
    for size in (200, 1 << 20):
        got = scores(docs(rows), block_bytes=size)
        assert by_repr((*r[:4], round(r[4], 6)) for r in got) == want
        assert all(math.isfinite(r[5]) and r[5] <= 0 for r in got)
    assert op04_bloom_lm.query(empty).count() == 0
    assert [r[5] for r in scores(docs([(None, "not learnt from")]))] == [0.0]


def test_model_beats_the_base_on_held_out_text(spark):
    got = [r for r in op04_bloom_lm.query(source(spark)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_scores_do_not_leave_out_pairs_as_the_corpus_grows(docs):
    """The order of two rare words tells, however many commoner words and pairs there are."""
    learnt = [d for d in range(400) if remainder(d, 7) != 2]
    rows = [(d, " ".join(f"w{(d * 37 + k) % 6000}" for k in range(250))) for d in learnt]
    rows += [(d, "rarely seen") for d in range(1000, 1060) if remainder(d, 7) != 2][:3]
    held_out = [d for d in range(2000, 2100) if remainder(d, 7) == 2]
    rows += [(held_out[0], "rarely seen"), (held_out[1], "seen rarely")]
    by_size = []
    for size in (1 << 22, 1000):
        found = {r[0]: r[5] for r in scores(docs(rows), region_tokens=size)}
        assert found[held_out[0]] > found[held_out[1]] + 1
        by_size.append(found[held_out[0]])
    assert by_size[0] == pytest.approx(by_size[1], abs=0.05)


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(1)
    keys = op04_bloom_lm.mix(np.arange(20_000, dtype=np.uint64))
    levels = rng.integers(1, 9, 10_000)
    held = op04_bloom_lm.LogFrequencyFilter(64)
    held.add(keys[:10_000], levels)
    found = held.levels(keys)
    assert (found[:10_000] >= levels).all() and (found[:10_000] == levels).mean() > 0.95
    assert (found[10_000:] == 0).mean() > 0.95
    counts = np.array([0, 1, 2, 3, 4, 7, 8, 1000])
    assert op04_bloom_lm.level_of(counts, 2.0).tolist() == [0, 1, 2, 2, 3, 3, 4, 10]


# ---- 5 decontamination ------------------------------------------------------------------------


def brute_hits(text, items, size=13):
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = pattern.findall((text or "").translate(fold))
    hit, found = set(), set()
    for item, body in items:
        own = pattern.findall((body or "").translate(fold))
        width = min(size, len(own))
        windows = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)} if width else set()
        for k in range(len(words) - width + 1):
            if tuple(words[k : k + width]) in windows:
                hit.update(range(k, k + width))
                found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_contamination(spark, docs, edges, empty, block_bytes):
    items = [(1, PROSE + " and more"), (2, "Lazy, DOG"), (10, None), (11, "..."), (12, "one long line"), (12, "word1 and1")]
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    found = op05_decontaminate.contamination(edges, benchmark, block_bytes=block_bytes)
    got = [(r.row.doc_id, r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.contaminated) for r in found.collect()]
    assert by_repr(got) == by_repr((d, *brute_hits(t, items)) for d, t in EDGES)
    assert all(r.row.digest == "own digest" for r in found.collect())
    assert op05_decontaminate.query(empty, benchmark).count() == 0
    nothing = op05_decontaminate.query(edges, benchmark.limit(0))
    assert nothing.where("contaminated OR n_hit > 0").count() == 0


# ---- 6 near duplicates ------------------------------------------------------------------------


def test_near_groups_on_edges(edges, empty):
    rows = [(d, t) for d, t in EDGES if d is not None]
    got = op06_chosen_path.query(edges).where("doc_id IS NOT NULL")
    assert sorted_rows(got) == by_repr(near_groups(rows))
    alone = op06_chosen_path.query(edges).where("doc_id IS NULL").collect()
    assert len(alone) == 2 and all(r.kept and r.component_id is None for r in alone)
    assert op06_chosen_path.query(empty).count() == 0


def variants(count, words, changes, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    rows = []
    for doc_id in range(count):
        own = list(base)
        for place in rng.integers(0, words, rng.integers(0, changes)):
            own[place] = f"x{rng.integers(0, 10**6)}"
        rows.append((doc_id, " ".join(own)))
    return rows


def test_a_group_larger_than_a_node_is_split_into_tiles(docs, monkeypatch):
    monkeypatch.setattr(op06_chosen_path, "TILE", 8)
    monkeypatch.setattr(op06_chosen_path, "SPLIT_ABOVE", 24)
    rows = variants(90, 120, 8) + [(1000 + d, f"other {t} z{d}") for d, t in variants(60, 20, 6, seed=9)]
    shared = "a passage that many documents share with each other word for word"
    rows += [(2000 + d, f"{shared} " + " ".join(f"v{d * 40 + k}" for k in range(8))) for d in range(80)]
    assert sorted_rows(op06_chosen_path.query(docs(rows))) == by_repr(near_groups(rows))


def test_pairs_that_part_in_a_hot_node_meet_in_a_later_tree(docs, monkeypatch):
    monkeypatch.setattr(op06_chosen_path, "TILE", 8)
    monkeypatch.setattr(op06_chosen_path, "SPLIT_ABOVE", 24)
    passage = " ".join(f"p{k}" for k in range(48))
    rows = []
    for pair in range(450):  # two texts of 107 shingles that share 96, 45 of them with all others
        own = [f"v{pair}x{k}" for k in range(62)]
        rows.append((2 * pair, f"{passage} {' '.join(own)}"))
        own[12], own[30], own[59] = f"x{pair}", f"y{pair}", f"z{pair}"
        rows.append((2 * pair + 1, f"{passage} {' '.join(own)}"))
    assert sorted_rows(op06_chosen_path.query(docs(rows))) == by_repr(near_groups(rows))


def test_near_groups_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in source(spark).collect()]
    assert sorted_rows(op06_chosen_path.query(source(spark))) == by_repr(near_groups(rows))


def test_components_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100)]
    got = op06_chosen_path.components(spark.createDataFrame(path, "a BIGINT, b BIGINT"))
    assert {r["class"]: r.component for r in got.collect()} == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


# ---- 7 language -------------------------------------------------------------------------------


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    network = op07_language.Network(["a", "b", "c"], hidden=3)
    for name in network.weights:
        network.weights[name] = network.weights[name].astype(np.float64)
    data, target = rng.integers(0, 5, (7, 4)), np.array([0, 1, 2, 0])
    _, grads = network.gradients(data, target)
    for name, grad in grads.items():
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        sides = []
        for step in (1e-4, -2e-4):
            network.weights[name][place] += step
            sides.append(network.gradients(data, target)[0])
        network.weights[name][place] += 1e-4
        assert grad[place] == pytest.approx((sides[0] - sides[1]) / 2e-4, rel=1e-3)


def test_segments_are_read_side_by_side_as_alone():
    network = op07_language.Network(["a", "b"])
    texts = ["short", "", "x" * 700, "é" * 300, "mid size text " * 9]
    data, offsets = op07_language.raw(pa.array(texts))
    labels = np.full(len(data), 9, np.uint8)
    together = network.read(data, offsets, labels)
    for text, row in zip(texts, together):
        own, bounds = op07_language.raw(pa.array([text]))
        assert network.read(own, bounds)[0] == pytest.approx(row, abs=1e-5)
    assert set(labels) <= {0, 1}


def test_languages(spark, edges, empty):
    got = op07_language.query(source(spark)).collect()
    langs = {r.doc_id: r.lang for r in source(spark).collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in got) and len(got) == len(langs)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.9
    judged = op07_language.query(edges).collect()
    letterless = [r for r in judged if r.doc_id in (1, 2, 3)]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in letterless)
    assert {r.lang_pred for r in judged} == {"und", "en"} and len(judged) == len(EDGES)
    assert op07_language.query(empty).count() == 0
    nothing = op07_language.query(edges.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_every_byte_gets_a_label(edges):
    network = op07_language.Network(["a", "b"])
    rows = op07_language.predict(edges, network, labels=True).collect()
    assert all(len(r.labels) == len((r.row.text or "").encode()) for r in rows)


# ---- 8 lines ----------------------------------------------------------------------------------


def deduped(rows):
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    holders = {}
    for d, own in lines:
        for line in own:
            if d is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    for d, own in lines:
        gone = [d is not None and len(holders.get(key(l), ())) > 1 and d != min(holders[key(l)]) for l in own]
        yield d, len(own), sum(gone), sha("\n".join(l for l, g in zip(own, gone) if not g))


def test_lines(edges, empty):
    assert sorted_rows(op08_lines.query(edges)) == by_repr(deduped(EDGES))
    assert op08_lines.query(empty).count() == 0
    kept = op08_lines.stage(None, edges, None)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)
    assert kept.select(*CLASHES).distinct().count() == 1


# ---- 9 byte pairs -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary(spark):
    return op09_bpe.Vocabulary(spark, public_tokenizers.path(op09_bpe.RANKS))


def reference(vocabulary):
    return tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


def test_encoding_and_decoding(edges, empty, vocabulary):
    library = reference(vocabulary)

    def digests(text):
        ids = library.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        return len(ids), hashlib.sha256(packed).hexdigest(), sha(text)

    assert sorted_rows(op09_bpe.query(edges)) == by_repr((d, *digests(t or "")) for d, t in EDGES)
    assert op09_bpe.query(empty).count() == 0
    encoded = op09_bpe.encode(edges, vocabulary)
    assert encoded.select("row.*").columns == edges.columns
    decoded = encoded.select("row.text", vocabulary.decode(F.col("ids")).alias("data")).collect()
    assert all(bytes(r.data).decode() == (r.text or "") for r in decoded)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="theaionrsß中é0-_ \n", min_size=1, max_size=60))
def test_heap_merges_equal_the_library(vocabulary, text):
    assert op09_bpe.merge_with_heap(text.encode(), vocabulary.ranks) == reference(vocabulary)._encode_single_piece(
        text.encode()
    )


# ---- 10 quality -------------------------------------------------------------------------------


def test_quality(spark, edges, empty):
    labels = source(spark, "labels")
    got = op10_quality.query(source(spark), labels).collect()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.85
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (remainder(r.doc_id, 3) == 1) for r in got)
    judged = op10_quality.query(edges, labels).collect()
    assert len(judged) == len(EDGES) and all(0 <= r.score <= 1 for r in judged)
    assert op10_quality.query(empty, labels).count() == 0
    assert {r.score for r in op10_quality.query(edges, labels.limit(0)).collect()} == {0.5}


def test_tables_of_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = op10_quality.AdditiveModel().fit(x[:2000], y[:2000])
    assert model.pairs[0][:2] == (1, 0)
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_features_of_repetition():
    texts = pa.array(["a b c d e f", "a a a a a a", None, LONG])
    values = dict(zip(op10_quality.FEATURES, op10_quality.features(texts).T))
    assert values["distinct_words"][0] == 1 and values["top_word"][1] == 1
    assert values["log_bytes"][2] == 0 and values["word_bytes"][2] == 0
    words = spaced(LONG)
    assert values["distinct_words"][3] == pytest.approx(len(set(words)) / len(words))
