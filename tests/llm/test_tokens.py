"""Boundaries for splicing in scripts that are not ASCII: counts as the library's, in bounded chunks."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstream.llm import op01_tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def count(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def encoder():
    return op01_tokens.encoder(
        public_tokenizers.path(op01_tokens.TOKENIZER), public_tokenizers.path(op01_tokens.RANKS)
    )


@settings(max_examples=400, deadline=None)
@given(
    st.text(alphabet=" \n\t\x85\xa0   　абвé'sа中文字。，、！ぁんー䷀अ।ك؟1<|endoftext|>", max_size=90),
    st.integers(3, 30),
    st.integers(1, 9),
)
def test_spliced_counts_in_any_script(text, chunk, overlap):
    encode, lengths = encoder()
    assert op01_tokens.count_long(text, encode, lengths, chunk, overlap)[0] == count(text)


@pytest.mark.parametrize(
    "words, gap",
    [(["слово", "длинное", "и", "ещё"], " "), (["λόγος", "και"], " "), (["كلمة", "طويلة"], " "), (["शब्द", "और"], " "),
     (["这是一个很长的句子", "没有空格", "文字"], "，"), (["ひらがなのぶん"], "。")],
)
def test_long_texts_take_chunks_of_their_size(words, gap):
    rng = random.Random(3)
    text = gap.join(rng.choice(words) for _ in range(200_000 // max(map(len, words))))
    encode, lengths = encoder()
    tokens, chunks, widened = op01_tokens.count_long(text, encode, lengths, 8192, 256)
    assert tokens == len(encode(text)) == count(text)
    assert widened == 0 and chunks <= len(text) // (8192 - 256) + 3


def test_five_million_cyrillic_characters():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("абвгдежзик", k=rng.randint(2, 12))) for _ in range(620_000))
    encode, lengths = encoder()
    tokens, chunks, widened = op01_tokens.count_long(text, encode, lengths)
    assert len(text) > 4_500_000 and widened == 0
    assert chunks <= len(text) // (op01_tokens.CHUNK - op01_tokens.OVERLAP) + 2
    assert tokens == len(encode(text))
