"""The fold itself against the library, with and without words that are known before."""

import random

import public_tokenizers
import regex
import pyarrow as pa
import pytest
import tiktoken
from conftest import EDGES
from pyspark.sql import functions as F

from quillstream.llm import op09_bpe


@pytest.fixture(scope="module")
def vocabulary(spark):
    return op09_bpe.Vocabulary(spark, public_tokenizers.path(op09_bpe.RANKS))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


def random_texts(count):
    rng = random.Random(11)
    letters = ["theaionrs", "ßéüñ", "中文字符", "абвгд", "اردو", "🙂🙃", "0123", " \n\t ", "-_.,!'", "aaaa"]
    return ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 60))) for _ in range(count)]


def nothing():
    return op09_bpe.Known(pa.array([], pa.large_string()), pa.array([], pa.list_(pa.int32())))


def test_the_fold_equals_the_library(spark, vocabulary, library):
    texts = random_texts(2000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for known in (nothing(), None):  # every word through the fold, and as the query does it
        encoded = op09_bpe.encode(docs, vocabulary, known=known).select("row.doc_id", "ids").collect()
        assert {r.doc_id: r.ids for r in encoded} == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}


def test_whole_words_through_the_fold_alone(spark, vocabulary, library):
    words = sorted({w for text in random_texts(500) for w in text.split()} | {"x" * 256, "ab" * 128})
    rows = spark.createDataFrame([(w,) for w in words], "word string").withColumn("buckets", vocabulary.buckets)
    folded = rows.select(
        "word",
        F.get(vocabulary.fold_words(F.array(op09_bpe._letters(F.col("word"))), F.col("buckets")), 0).alias("ids"),
    )
    for row in folded.collect():
        if len(row.word.encode()) <= op09_bpe.FOLD_BYTES:
            assert row.ids == library._encode_single_piece(row.word.encode()), row.word


def test_common_words_are_bounded_and_right(spark, vocabulary, library):
    rows = [(k, " ".join(f"zork{j}qu" for j in range(k % 40))) for k in range(200)] + EDGES
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = len(op09_bpe.whole_tokens(vocabulary.ranks).words)
    for most in (5, 30, 1 << 19):
        known = op09_bpe.common_words(docs, vocabulary, most=most)
        assert whole <= len(known.words) <= whole + most
        for word, ids in list(zip(known.words.to_pylist(), known.ids.to_pylist()))[whole:]:
            assert ids == library._encode_single_piece(word.encode())
    assert len(known.words) > whole + 30


def test_blocks_of_any_size_give_the_same(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(op09_bpe, "BLOCK_BYTES", 50)
    texts = random_texts(100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoded = op09_bpe.encode(docs, vocabulary, known=nothing()).select("row.doc_id", "ids").collect()
    assert {r.doc_id: r.ids for r in encoded} == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}


def test_the_splitter_equals_the_pattern(vocabulary):
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(5)
    parts = ["word", "'", "'s", "'ve", "n't", "'l", "'ll", " ", "  ", "\n", "\t ", "\xa0", "\u3000", "é", "中", "²", "7", "-_", "!", "🙂", ""]
    for _ in range(200):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(30)] + [None, "", "'", "'re"]
        rng.shuffle(texts)
        words, bounds = vocabulary.splitter.split(pa.array(texts, pa.string()))
        words = words.to_pylist()
        assert [words[a:b] for a, b in zip(bounds, bounds[1:])] == [pattern.findall(t or "") for t in texts]


def test_every_character_is_split_as_by_the_library(vocabulary, library):
    points = [*range(1, 0xD800, 7), *range(0xE000, 0x20000, 5), *range(0x20000, 0x110000, 997)]
    texts = [f"a{chr(p)} {chr(p)}1{chr(p)}" for p in points]
    words, bounds = vocabulary.splitter.split(pa.array(texts))
    words = words.to_pylist()
    for text, a, b in zip(texts, bounds, bounds[1:]):
        ids = [k for word in words[a:b] for k in library._encode_single_piece(word.encode())]
        assert ids == library.encode_ordinary(text)
