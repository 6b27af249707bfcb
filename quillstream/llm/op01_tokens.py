"""Token counts by overlap resynchronisation of long documents.

A long text is encoded in chunks that overlap. A token boundary inside the overlap that both chunks
have, and that any context keeps, splits the whole text's encoding: what stands left and right of it is
encoded apart. The counts left of it come from one chunk and right of it from the next. Where the overlap has
no such boundary it is doubled, up to the whole chunk, and then the chunk itself is extended.

Two kinds of boundary are kept by any context. One is between a character that is not white space and white
space: no match of the splitting pattern holds white space after anything else, matches look ahead only, and
no special string holds white space. The other is between a letter and punctuation of East Asian scripts,
which write no spaces: no match holds another character after a letter, the run of other characters begins
there in any context, and special strings are ASCII.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, spread

#: Vocabulary whose counts are asked for, and the same vocabulary as ranks.
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: A text above this many code points is encoded in chunks of so many.
CHUNK = 1 << 16
OVERLAP = 1 << 8
LIMIT = 1024

_ENCODERS: dict[str, tuple] = {}


def encoder(json_path: str, ranks_path: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """A function from text to token ids as the JSON file's library gives them by default, and the
    bytes of each id. Special strings of the file are cut out of the text first, leftmost first, and
    are one token each; the rest goes through the ranks, which hold the same merges."""
    if json_path not in _ENCODERS:
        with open(json_path, encoding="utf-8") as file:
            added = {entry["content"]: entry["id"] for entry in json.load(file)["added_tokens"]}
        ranks = {}
        with open(ranks_path, "rb") as file:
            for line in file:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        lengths = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        for token, number in added.items():
            lengths[number] = len(token.encode())
        encoding = tiktoken.Encoding(
            "counts",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens=added,
        )
        allowed = set(added)

        def encode(text: str) -> np.ndarray:
            if any(token in text for token in added):
                return np.array(encoding.encode(text, allowed_special=allowed), np.int64)
            return np.array(encoding.encode_ordinary(text), np.int64)

        _ENCODERS[json_path] = (encode, lengths)
    return _ENCODERS[json_path]


#: The punctuation that ends clauses in East Asian scripts, as the three bytes of each.
_MARKS = [int.from_bytes(mark.encode(), "big") for mark in "、。，！？：；"]


def _stable(text: str, start: int, byte_ends: np.ndarray) -> np.ndarray:
    """Of the token ends in bytes of ``text[start:]``'s encoding, those that any context keeps. Characters
    are told by their bytes, so some that could serve are passed over."""
    data = np.frombuffer(text.encode(), np.uint8)
    inner = byte_ends[(byte_ends > 0) & (byte_ends < len(data))]
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)]).astype(np.int64)
    at = inner + 3
    three, two, left, right = padded[at - 3], padded[at - 2], padded[at - 1], padded[at]
    # White space beyond ASCII: U+0085 and U+00A0, and single ones in the blocks of these leading bytes.
    spaced = (left == 32) | ((left >= 9) & (left <= 13)) | (two == 0xC2)
    spaced |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & (two <= 0x81)) | ((three == 0xE3) & (two == 0x80))
    before_space = ~spaced & ((right == 32) | (right == 10))
    # Letters: U+5000 to U+8FFF, and kana from U+3041 to U+3096 and U+30A1 to U+30BF.
    kana = ((two == 0x81) & (left >= 0x81)) | ((two == 0x82) & ((left <= 0x96) | (left >= 0xA1)))
    letter = (left >= 0x80) & (((three >= 0xE5) & (three <= 0xE8)) | ((three == 0xE3) & kana))
    mark = np.isin(right << 16 | padded[at + 1] << 8 | padded[at + 2], _MARKS)
    return inner[before_space | (letter & (two >= 0x80) & mark)] + start


def count_long(
    text: str, encode, lengths: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP
) -> tuple[int, int, int]:
    """Tokens of a text, chunks it took, and how often an overlap was widened."""
    chunks, widened, tokens = 1, 0, 0
    head, end = 0, min(len(text), chunk)  # the current chunk, in code points
    ids = encode(text[head:end])
    done = 0  # bytes of the current chunk that an earlier chunk has counted
    while end < len(text):
        ends = np.cumsum(lengths[ids])
        size = min(overlap, end - head)
        while True:
            after = text[end - size : end + chunk]
            after_ids = encode(after)
            after_ends = np.cumsum(lengths[after_ids])
            offset = len(text[head : end - size].encode())
            left = _stable(text[head:end], 0, ends)
            left = left[left > done]
            common = np.intersect1d(left, _stable(after, offset, after_ends))
            chunks += 1
            if len(common):
                cut = int(common[len(common) // 2])
                tokens += int(np.count_nonzero((ends > done) & (ends <= cut)))
                head, end = end - size, min(len(text), end + chunk)
                ids, done = after_ids, cut - offset
                break
            widened += 1
            if size < end - head:
                size = min(size * 2, end - head)
            else:  # no boundary in the whole chunk: make the chunk longer
                end = min(len(text), end + max(chunk, end - head))
                ids = encode(text[head:end])
                if end == len(text):
                    break
                ends = np.cumsum(lengths[ids])
    ends = np.cumsum(lengths[ids])
    return tokens + int(np.count_nonzero(ends > done)), chunks, widened


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    ranks: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    limit: int = LIMIT,
) -> DataFrame:
    """Per row the id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``, ``n_chunks``, ``n_widened``.

    No begin, end or padding tokens, no truncation; special strings inside texts are single tokens.
    A null or empty text has 0 bytes and 0 tokens. A null id stays null, repeated rows are counted row
    by row, an empty table gives no rows, and other columns are not read. A task holds one Arrow batch
    and the encoding of one chunk.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    ranks = ranks or public_tokenizers.path(RANKS)
    rows = spread(docs, id_col, text_col).toDF("doc_id", "text")

    def count(batches):
        encode, lengths = encoder(tokenizer, ranks)
        for batch in batches:
            for part in sliced(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [
                    count_long(text, encode, lengths, chunk, overlap) if text else (0, 0, 0)
                    for text in texts
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(text.encode()) if text else 0 for text in texts], pa.int64()),
                        *[pa.array([row[k] for row in found], pa.int64()) for k in range(3)],
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, n_chunks long, n_widened long"
    return rows.mapInArrow(count, schema).select(
        F.col("doc_id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        "n_chunks",
        "n_widened",
    )


def query(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
