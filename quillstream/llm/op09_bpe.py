"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut into words as the splitting pattern has them. Blocks of documents hold each distinct word once, and
for every word of a text its place among them. Over each distinct word's array of bytes a fold merges the
pair of lowest rank, leftmost first, until no pair has a rank; ranks come from a literal map, dealt into an
array of small maps so that a look-up reads one or two entries. Decoding joins the pieces of the ids.

Words that many blocks share are folded once, before: a bounded table of the commonest words goes to the
tasks with the ids that the fold gave. It spares work and decides nothing; a word that is not in it is folded
in its block. So blocks can be small, and with them the rows that hold a block.

Bytes are held as strings of the characters U+0000 to U+00FF, which Spark concatenates and hashes
directly; encoding such a string in ISO-8859-1 gives the bytes back.
"""

from __future__ import annotations

import base64
import heapq
import json
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, sliced, stage as staged, work_dir

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of words in a block of documents, unless one document alone has more.
BLOCK_BYTES = 2 << 20
#: Words that are folded before, at most, and documents (about) in which they are looked for.
COMMON_WORDS, COMMON_FROM = 1 << 19, 1 << 16
#: Tasks that fold them.
COMMON_PARTS = 64
#: The fold takes time with the square of a word's length; longer words are merged with a heap instead.
FOLD_BYTES = 256
#: Maps that the literal rank map is dealt into.
BUCKETS = 1 << 18
SPREAD = 1021
#: In the fold ids stand between the ranks of their pairs: ids from here on, ranks below, then no rank.
IDS = 1 << 20
NO_RANK = 1 << 30

#: Fixed value: the splitting pattern that :class:`Splitter` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_ONE = np.zeros(128, bool)  # letters that end a contraction after an apostrophe, alone or as the second of two
_ONE[[ord(c) for c in "stmd"]] = True


class Splitter:
    """The splitting pattern over whole Arrow arrays: words are runs of characters of one class.

    The classes of all characters are asked of the tokenizer's own library, once. A word is a run of
    letters, of numbers or of other characters, with a single space before it. Of white space before a word
    the last character stands apart, if it is not that space; the rest, and white space at the end of a text,
    is one word. An apostrophe that begins a run of its own takes the letters of a contraction.
    """

    def __init__(self) -> None:
        if public_tokenizers.PATTERN != PATTERN:
            raise ValueError("the tokenizer splits by another pattern than this splitter")
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.classes = np.zeros(0x110000, np.uint8)
        for number, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            single = {bytes([k]): k for k in range(256)}
            library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            found = bytes(library.encode_ordinary(every)).decode()
            self.classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = number

    def split(self, texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of all texts and the bounds of the texts among them; null is empty."""
        data, offsets = raw(texts)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = data[lead].astype(np.uint32)
        for size, floor, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
            some = np.flatnonzero((point >= floor) & (point < (floor >> 1 | 0x80)))
            value = data[lead[some]].astype(np.uint32) & mask
            for k in range(1, size):
                value = value << 6 | (data[lead[some] + k] & 0x3F)
            point[some] = value | 1 << 31
        point &= (1 << 31) - 1
        count = len(point)
        kind = self.classes[point]
        first = np.zeros(count + 1, bool)  # begins a text; the end counts as one
        first[np.searchsorted(lead, offsets)] = True
        run = first[:count].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        word = np.flatnonzero(run & (kind != _SPACE) & ~first[:count])
        after = word[kind[word - 1] == _SPACE]
        start[after - 1] = True
        start[after[point[after - 1] == 32]] = False
        mark = np.flatnonzero(start & (point == 39) & ~first[1:])
        mark = mark[(kind[np.minimum(mark + 1, count - 1)] == _LETTER)]
        one = mark[_ONE[np.minimum(point[mark + 1], 127)]]
        rest = mark[~first[mark + 2]]
        pair = point[rest + 1] * 128 + point[rest + 2]
        two = rest[np.isin(pair, [ord(a) * 128 + ord(b) for a, b in ("re", "ve", "ll")])]
        for begins, size in ((one, 2), (two, 3)):
            start[begins + 1] = False
            end = begins + size
            end = end[~first[end]]
            start[end[kind[end] == _LETTER]] = True
        begins = np.concatenate([lead[start], [len(data)]]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data.tobytes()))
        return words, np.searchsorted(begins[:-1], offsets, "left")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def _characters(data: bytes) -> str:
    return data.decode("latin-1")


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), 0)


class Vocabulary:
    """The rank map and the pieces of a rank file, as constants of a plan.

    The map is the value of a scalar subquery over one row: tasks get it as a literal, and plans print a
    reference instead of some hundred thousand numbers. The shorter constants are literals themselves.

    The map goes from two neighbouring ids to the id of their bytes joined, which is also the pair's
    rank. It is dealt into ``BUCKETS`` maps by ``first * SPREAD + second``; the bucket and the second id
    determine the first, so the second id alone is the key. Ids are looked up as the fold holds them,
    ``IDS`` higher, which is a multiple of the number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.ranks = read_ranks(path)
        self.splitter = Splitter()
        buckets: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                first, second = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if first is not None and second is not None:
                    buckets[(first * SPREAD + second) % BUCKETS][second + IDS] = rank
        pieces = [""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = _characters(token)
        #: Tokens that merging does not reach; the word itself is looked up for these.
        apart = {
            _characters(token): rank
            for token, rank in self.ranks.items()
            if merge_with_heap(token, self.ranks, whole=False) != [rank]
        }

        row = spark.createDataFrame([(json.dumps(buckets),)], "value string")
        literal = F.from_json("value", "array<map<string,int>>").cast("array<map<int,int>>")
        self.buckets = row.select(literal.alias("value")).scalar()
        self.bytes = self._literal([self.ranks[bytes([k])] + IDS for k in range(256)], "array<int>")
        self.apart = self._literal(apart, "map<string,int>") if apart else None
        self.pieces = self._literal(pieces, "array<string>")

    @staticmethod
    def _literal(values: list | dict, kind: str) -> Column:
        """One literal of the plan: the optimiser reads the constant JSON once."""
        return F.from_json(F.lit(json.dumps(values)), kind)

    def fold_words(self, words: Column, buckets: Column) -> Column:
        """The ids of each word, a string of bytes. ``buckets`` is a column with the rank map."""
        return _bind(buckets, lambda held: F.transform(words, lambda word: self._fold(word, held)))

    def _fold(self, word: Column, buckets: Column) -> Column:
        """Merge the pair of lowest rank, leftmost first, once per step until none has a rank.

        The state is one array: id, rank of the pair, id, rank, and so on. The smallest value is the
        lowest rank; what is left and right of its place are the ids it joins.
        """
        none, end = F.lit(NO_RANK), F.lit(2 * FOLD_BYTES + 8)

        def rank(first: Column, second: Column) -> Column:
            bucket = (first * SPREAD + second).bitwiseAND(BUCKETS - 1)
            return F.coalesce(F.try_element_at(F.get(buckets, bucket), second), none)

        def begin(ids: Column) -> Column:
            after = F.slice(ids, F.lit(2), end)
            return F.flatten(
                F.zip_with(
                    ids, after, lambda a, b: F.array(a, F.when(b.isNull(), none).otherwise(rank(a, b)))
                )
            )

        def merged(state: Column, least: Column, at: Column) -> Column:
            new = least + IDS
            return F.concat(
                F.slice(state, F.lit(1), at - 3),
                F.array(rank(F.get(state, at - 4), new), new, rank(new, F.get(state, at + 2))),
                F.slice(state, at + 3, end),
            )

        def step(state: Column) -> Column:
            return _bind(
                F.array_min(state),
                lambda least: F.when(least >= IDS - 1, state).otherwise(
                    _bind(
                        F.array_position(state, least).cast("int"), lambda at: merged(state, least, at)
                    )
                ),
            )

        # A sentinel on either side has a rank with nothing, so a pair always has two neighbours.
        letters = F.transform(F.split(word, ""), lambda c: F.get(self.bytes, F.ascii(c)))
        padded = F.concat(F.array(F.lit(IDS - 1)), letters, F.array(F.lit(IDS - 1)))
        folded = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.char_length(word) - 1, F.lit(1))),
            _bind(padded, begin),
            lambda state, _: step(state),
            lambda state: F.transform(
                F.filter(state, lambda v: (v >= IDS) & (v < NO_RANK)), lambda v: v - IDS
            ),
        )
        if self.apart is None:
            return folded
        known = F.try_element_at(self.apart, word)
        return F.when(known.isNotNull(), F.array(known)).otherwise(folded)

    def decode(self, ids: Column) -> Column:
        """The bytes that the ids stand for."""
        text = F.array_join(F.transform(ids, lambda number: F.get(self.pieces, number)), "")
        return F.encode(text, "ISO-8859-1")


def merge_with_heap(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """The same merges for a long word, in time n log n; a word that is a token is one if ``whole``."""
    if whole and word in ranks:
        return [ranks[word]]
    end = list(range(1, len(word) + 1))  # where the part that begins here ends; 0 once it is merged away
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and end[a] < len(word):
            stop = end[end[a]]
            rank = ranks.get(word[a:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, a, stop))

    for start in range(len(word)):
        offer(start)
    while heap:
        _, a, stop = heapq.heappop(heap)
        middle = end[a]
        if not middle or middle >= len(word) or end[middle] != stop:
            continue
        end[a], end[middle] = stop, 0
        if stop < len(word):
            before[stop] = a
        offer(a)
        offer(before[a])
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


class Known(NamedTuple):
    """Words whose ids are known before the fold, and the ids."""

    words: pa.LargeStringArray
    ids: pa.ListArray

    def and_more(self, words: pa.Array, ids: pa.Array) -> Known:
        return Known(
            pa.concat_arrays([self.words, words.cast(pa.large_string())]),
            pa.concat_arrays([self.ids, ids.cast(self.ids.type)]),
        )


def whole_tokens(ranks: dict[bytes, int]) -> Known:
    """Words that are one token."""
    words, ids = [], []
    for token, rank in ranks.items():
        try:
            words.append(token.decode())
            ids.append([rank])
        except UnicodeDecodeError:  # part of a character: never a word
            pass
    return Known(pa.array(words, pa.large_string()), pa.array(ids, pa.list_(pa.int32())))


def common_words(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", most: int = COMMON_WORDS, among: int = COMMON_FROM
) -> Known:
    """The words that are worth folding before: whole tokens, and at most ``most`` others that came up twice
    or more in a sample of about ``among`` rows, the commonest first. Their ids come from the fold."""
    known, splitter = whole_tokens(vocabulary.ranks), vocabulary.splitter

    def count(batches):
        for batch in batches:
            for part in sliced(batch, "text", BLOCK_BYTES):
                found = pc.value_counts(splitter.split(part.column("text"))[0])
                words, counts = found.field("values"), found.field("counts")
                new = pc.and_(
                    pc.is_null(pc.index_in(words, value_set=known.words)),
                    pc.less_equal(pc.binary_length(words), FOLD_BYTES),
                )
                yield pa.RecordBatch.from_arrays(
                    [words.filter(new).cast(pa.string()), counts.filter(new)], names=["word", "n"]
                )

    rows = docs.select(F.col(f"`{text_col}`").alias("text"))
    rows = rows.sample(min(1.0, among / max(1, docs.count())), 7)
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counts.filter(F.col("n") > 1).withColumn("n", F.least("n", F.lit(1 << 12))), "word-counts")
    held, least = 0, None
    for row in sorted(counts.groupBy("n").count().collect(), reverse=True):  # at most 4,096 rows
        held += row["count"]
        if held > most:
            break
        least = row["n"]
    if least is None:
        return known
    # A word of the fold takes long for its size: the table is small, the work on it is not.
    chosen = counts.filter(F.col("n") >= least).select("word").repartition(COMMON_PARTS)
    folded = chosen.withColumn("buckets", vocabulary.buckets).select(
        "word", F.get(vocabulary.fold_words(F.array(_letters(F.col("word"))), F.col("buckets")), 0).alias("ids")
    )
    table = staged(folded, "common-words").toArrow().combine_chunks()
    if not len(table):
        return known
    return known.and_more(table.column("word").combine_chunks(), table.column("ids").combine_chunks())


def _letters(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _word_blocks(ranks: dict[bytes, int], known: Known, splitter: Splitter):
    """Rows of (row, text) to blocks: the rows, the ``bounds`` of their words, the ``places`` of these among
    the block's distinct words, the number of ids of each distinct word (-1: not known) in ``sizes``, the known
    ids in ``flat``, and the distinct ``words`` that are left to fold."""

    def build(batches):
        for batch in batches:
            for part in sliced(batch, "text", BLOCK_BYTES):
                words, bounds = splitter.split(part.column("text"))
                words = words.dictionary_encode()
                distinct = words.dictionary
                place = pc.fill_null(pc.index_in(distinct, value_set=known.words), -1)
                place = place.to_numpy(zero_copy_only=False).astype(np.int64)
                length = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
                long = np.flatnonzero((length > FOLD_BYTES) & (place < 0))
                merged = [merge_with_heap(distinct[k].as_py().encode(), ranks) for k in long.tolist()]
                place[long] = len(known.ids) + np.arange(len(long))
                every = pa.concat_arrays([known.ids, pa.array(merged, known.ids.type)]) if merged else known.ids
                ids = every.take(pa.array(place[place >= 0]))
                counts = np.full(len(distinct), -1, np.int32)
                counts[place >= 0] = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
                rare = distinct.filter(pa.array(place < 0)).cast(pa.string())
                held = [_narrow(column) for column in (bounds, words.indices, counts, ids.flatten())]
                yield pa.RecordBatch.from_arrays(
                    [_one(part.column("row")), *[pa.array([value], pa.binary()) for value in held], _one(rare)],
                    names=["rows", *_HELD, "words"],
                )

    return build


_HELD = ["bounds", "places", "sizes", "flat"]
_KINDS = [np.dtype(kind) for kind in ("<u2", "<i4")]


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _narrow(values) -> bytes:
    """Whole numbers as bytes, two or four for each; the first byte says which."""
    values = np.asarray(values)
    small = len(values) == 0 or (values.min() >= 0 and values.max() < 1 << 16)
    return bytes([not small]) + values.astype(_KINDS[not small]).tobytes()


def _wide(value: pa.Scalar) -> np.ndarray:
    data = value.as_buffer()
    return np.frombuffer(data, _KINDS[np.frombuffer(data, np.uint8, 1)[0]], offset=1)


def _assembled(batches):
    """Blocks with the ids of their words in ``folded`` to rows with their ids."""
    for batch in batches:
        for k in range(len(batch)):
            bounds, places, sizes, known = (_wide(batch.column(name)[k]) for name in _HELD)
            folded = batch.column("folded")[k].values
            rare = sizes < 0
            sizes = sizes.astype(np.int64)
            sizes[rare] = pc.list_value_length(folded).to_numpy(zero_copy_only=False)
            # Ids of the known words come first in ``flat``, those of the folded ones behind them.
            flat = np.concatenate([known, folded.flatten().to_numpy(zero_copy_only=False)]).astype("<i4")
            starts = np.empty(len(sizes), np.int64)
            starts[~rare] = np.cumsum(sizes[~rare]) - sizes[~rare]
            starts[rare] = len(known) + np.cumsum(sizes[rare]) - sizes[rare]
            count = sizes[places]
            ends = np.concatenate([[0], np.cumsum(count)])
            ids = flat[np.arange(ends[-1]) + np.repeat(starts[places] - ends[:-1], count)]
            edges = ends[bounds].astype(np.int32)
            offsets = pa.py_buffer(edges.astype(np.int64) * 4)
            packed = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rows")[k].values, pa.ListArray.from_arrays(edges, pa.array(ids)), packed.cast(pa.binary())],
                names=["row", "ids", "packed"],
            )


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text_col: str = "text",
    keep: list[str] | None = None,
    known: Known | None = None,
) -> DataFrame:
    """Per row ``row`` (columns in ``keep``, default all), ``ids``, the token ids of the text, and ``packed``, the
    ids as little-endian unsigned 32-bit integers.

    No special tokens; strings that look like them are ordinary text. A null or empty text has no ids.
    Rows that repeat are encoded each, an empty table gives no rows, and columns of ``docs`` lie inside
    ``row``. ``known`` (default: :func:`common_words`) are words that are not folded again; any other word
    is folded once per block, and a block has a bounded number of bytes, or one document. The folded blocks
    are a table, compressed, so that splitting and assembling do not run beside each other in a task.
    """
    keep = docs.columns if keep is None else keep
    known = common_words(docs, vocabulary, text_col) if known is None else known
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"), F.col(f"`{text_col}`").alias("text")
    )
    blank = F.lit(None).cast("binary")
    words = F.array().cast("array<string>").alias("words")
    schema = rows.select(F.array("row").alias("rows"), *[blank.alias(name) for name in _HELD], words).schema
    blocks = rows.mapInArrow(_word_blocks(vocabulary.ranks, known, vocabulary.splitter), schema)
    blocks = blocks.withColumn("buckets", vocabulary.buckets)
    folded = vocabulary.fold_words(F.transform("words", _letters), F.col("buckets")).alias("folded")
    path = work_dir(docs.sparkSession, "folded-blocks")
    blocks = blocks.select("rows", *_HELD, folded)
    blocks.write.option("compression", "zstd").parquet(path)
    schema = rows.select("row", F.array().cast("array<int>").alias("ids"), blank.alias("packed")).schema
    return docs.sparkSession.read.schema(blocks.schema).parquet(path).mapInArrow(_assembled, schema)


def query(docs: DataFrame) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    vocabulary = Vocabulary(docs.sparkSession, public_tokenizers.path(RANKS))
    encoded = encode(docs.select("doc_id", "text"), vocabulary, keep=["doc_id"])
    return encoded.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(vocabulary.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the digests of the query for the documents that are left."""
    return query(docs)
