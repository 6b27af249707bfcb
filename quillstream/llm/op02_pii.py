"""Personal data: patterns find protected entities, corpus co-occurrence finds terms that give them away.

A term near an entity discloses as much of it as their pointwise mutual information; the entity's own
information is the ceiling. A term seen with an entity in several different contexts, whose information
reaches a share of that ceiling, is marked beside the entity and can be generalised.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import ALNUM, Words, bit_map, sliced, spread, stage as staged

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of an entity that count as its context.
CONTEXT = 10
#: Different contexts in which a term must stand by an entity, and the share of the entity's
#: information that the term must give away.
SUPPORT = 2
DISCLOSURE = 0.9
#: Code points a term has at least.
MIN_TERM = 3
#: Bits of the map by which a scan passes over words that are no candidate term.
MAP_BITS = 1 << 22

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What a leftmost search for the pattern finds, from one ``@`` to the next in linear time."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        free = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every entity in code points, by start and then kind."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for match in _IP.finditer(text):
            parts = match[0].split(".")
            if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in parts):
                spans.append((match.start(), 1, match.end()))
        for match in _CARD.finditer(text):
            if match.end() - match.start() <= 37:
                digits = match[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    spans.append((match.start(), 2, match.end()))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in match[0]) <= 15:
                    spans.append((match.start(), 3, match.end()))
    return sorted(spans)


def _signed(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def contexts(text: str, spans: list[tuple[int, int, int]], width: int) -> list[tuple]:
    """(entity, context, term, start, end) of each word near an entity and outside all entities."""
    folded = text.translate(_FOLD)  # as long as the text
    words, free = _free(folded, spans)
    starts = np.array([a for a, _ in words], np.int64)
    ends = np.array([b for _, b in words], np.int64)
    found, terms = [], []
    for a, rank, b in spans:
        entity = _entity(text, a, rank, b)
        left = np.flatnonzero(free[: np.searchsorted(ends, a, "right")][-4 * width :])
        left = left + max(0, int(np.searchsorted(ends, a, "right")) - 4 * width)
        right = int(np.searchsorted(starts, b, "left"))
        right = np.flatnonzero(free[right : right + 4 * width])[:width] + right
        near = [words[w] for w in (*left[-width:], *right)]
        said = [folded[s:e] for s, e in near]
        context = _signed(" ".join(said).encode())
        for (s, e), word in zip(near, said):
            if e - s >= MIN_TERM:
                found.append([entity, context, 0, s, e])
                terms.append(word)
    if terms:
        hashes = Words(pa.array(terms, pa.large_string()), ALNUM).hashes.view(np.int64)
        for row, value in zip(found, hashes.tolist()):
            row[2] = value
    return [tuple(row) for row in found]


_SPANS = "array<struct<start:int,rank:int,end:int>>"
_CONTEXTS = "array<struct<entity:bigint,context:bigint,term:bigint,start:int,end:int>>"


def find_entities(docs: DataFrame, text_col: str, keep: list[str], width: int = CONTEXT) -> DataFrame:
    """Per row ``row`` (columns in ``keep``), ``text_key``, ``spans`` and ``contexts``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"),
        text.alias("text"),
        F.unhex(F.md5(text)).alias("text_key"),
    )
    schema = rows.select("row", "text_key").schema
    schema.add("spans", DataType.fromDDL(_SPANS)).add("contexts", DataType.fromDDL(_CONTEXTS))
    span_type = pa.list_(pa.struct([(name, pa.int32()) for name in ("start", "rank", "end")]))
    context_type = pa.list_(
        pa.struct(
            [(name, pa.int64()) for name in ("entity", "context", "term")]
            + [(name, pa.int32()) for name in ("start", "end")]
        )
    )

    def find(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                spans, near = [], []
                for value in part.column("text").to_pylist():
                    found = base_spans(value)
                    spans.append([dict(zip(("start", "rank", "end"), s)) for s in found])
                    near.append(
                        [
                            dict(zip(("entity", "context", "term", "start", "end"), c))
                            for c in (contexts(value, found, width) if found else ())
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("text_key"),
                        pa.array(spans, span_type),
                        pa.array(near, context_type),
                    ],
                    names=["row", "text_key", "spans", "contexts"],
                )

    return rows.mapInArrow(find, schema)


def _entity(text: str, start: int, rank: int, end: int) -> int:
    return _signed(f"{rank}:{text[start:end].lower()}".encode())


def _free(folded: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Code points of all words of a folded text, and whether each is outside all entities."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(folded)]
    starts = np.array([a for a, _ in words], np.int64)
    ends = np.array([b for _, b in words], np.int64)
    free = np.ones(len(words), bool)
    for a, _, b in spans:
        free[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = False
    return words, free


def _documents(docs: DataFrame, text_col: str, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """In how many documents each candidate term stands (term, term_docs), and in how many it stands
    anywhere beside the entity (entity, term, pair_docs), counted over all documents.

    Maps of ``MAP_BITS`` bits, the same size whatever the corpus, tell tasks which words and pairs may be
    candidates; the join on them then decides.
    """
    mask = np.uint64(MAP_BITS - 1)
    may = bit_map(candidates, F.pmod(F.col("term"), F.lit(MAP_BITS)), MAP_BITS)
    both = F.col("entity").bitwiseXOR(F.col("term"))
    may_pair = bit_map(candidates, F.pmod(both, F.lit(MAP_BITS)), MAP_BITS)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def scan(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                there = np.flatnonzero(may[words.hashes & mask])
                owner = np.searchsorted(words.bounds, there, side="right") - 1
                pairs = []
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(owner)]):
                    number = int(owner[a])
                    value = part.column("text")[number].as_py()
                    spans = base_spans(value)
                    if spans:
                        first = words.bounds[number]
                        _, free = _free(value.translate(_FOLD), spans)
                        own = there[a:b]
                        terms = np.unique(words.hashes[own[free[own - first]]])
                        for entity in {_entity(value, *span) for span in spans}:
                            held = terms[may_pair[(terms ^ np.uint64(entity % (1 << 64))) & mask]]
                            pairs += [(entity, term) for term in held.view(np.int64).tolist()]
                order = np.lexsort((owner, words.hashes[there]))
                term, owner = words.hashes[there][order], owner[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
                terms, times = np.unique(term[new], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None] * len(terms) + [e for e, _ in pairs], pa.int64()),
                        pa.array([*terms.view(np.int64).tolist(), *[t for _, t in pairs]], pa.int64()),
                        pa.array([*times.tolist(), *[1] * len(pairs)], pa.int64()),
                    ],
                    names=["entity", "term", "documents"],
                )

    found = docs.select(text.alias("text")).mapInArrow(scan, "entity long, term long, documents long")
    counted = staged(found.groupBy("entity", "term").agg(F.sum("documents").alias("documents")), "documents")
    alone = counted.filter(F.col("entity").isNull()).select("term", F.col("documents").alias("term_docs"))
    pairs = counted.filter(F.col("entity").isNotNull()).withColumnRenamed("documents", "pair_docs")
    return alone, pairs


def marked_terms(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(text_key, added): every place outside all entities at which one of the ``terms`` stands, in
    whichever text and however far from an entity."""
    may = bit_map(terms, F.pmod(F.col("term"), F.lit(MAP_BITS)), MAP_BITS)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))

    def mark(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                there = np.flatnonzero(may[words.hashes & np.uint64(MAP_BITS - 1)])
                owner = np.searchsorted(words.bounds, there, side="right") - 1
                found = []
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(owner)]):
                    number = int(owner[a])
                    value = part.column("text")[number].as_py()
                    places, free = _free(value.translate(_FOLD), base_spans(value))
                    for word in there[a:b]:
                        place = int(word - words.bounds[number])
                        if free[place]:
                            found.append((number, int(words.hashes[word].view(np.int64)), *places[place]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("text_key").take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int32()),
                        pa.array([f[3] for f in found], pa.int32()),
                    ],
                    names=["text_key", "term", "start", "end"],
                )

    places = rows.mapInArrow(mark, "text_key binary, term long, start int, end int")
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end")
    return places.join(terms, "term", "left_semi").groupBy("text_key").agg(F.collect_set(span).alias("added"))


def disclosing_terms(
    docs: DataFrame,
    text_col: str,
    entities: DataFrame,
    support: int = SUPPORT,
    disclosure: float = DISCLOSURE,
) -> DataFrame | None:
    """(entity, term) pairs in which the term gives the entity away; None where no term has support.

    Probabilities are shares of documents. A context that copies share supports a pair once, so copies
    are no evidence. ``information`` is PMI(entity; term) over the entity's information.
    """
    near = entities.select(F.explode("contexts").alias("c")).select("c.entity", "c.term", "c.context")
    backed = (
        near.distinct().groupBy("entity", "term").count().filter(F.col("count") >= support).drop("count")
    )

    def documents(key: list[str], name: str) -> DataFrame:
        """In how many documents each key stands near an entity, or is one."""
        distinct = F.array_distinct(F.transform("contexts", lambda c: F.struct(*[c[k] for k in key])))
        held = entities.select(F.explode(distinct).alias("d")).select("d.*")
        return held.groupBy(*key).agg(F.count("*").alias(name))

    total = F.lit(float(entities.count()))
    ceiling = F.log2(total / F.col("entity_docs"))

    def share(term_docs: str) -> Column:
        pmi = F.log2(total * F.col("pair_docs") / (F.col("entity_docs") * F.col(term_docs)))
        return F.when(ceiling > 0, pmi / ceiling)

    # A pair shares at most all documents of the entity, and a term stands in at least the documents in
    # which it is near some entity: pairs that fall short even so need no count over the corpus.
    most = F.least("entity_docs", "near_docs")
    pairs = (
        backed.join(documents(["entity"], "entity_docs"), "entity")
        .join(documents(["term"], "near_docs"), "term")
        .withColumn("pair_docs", most)
        .filter(share("near_docs") >= disclosure)
        .drop("pair_docs")
    )
    pairs = staged(pairs, "pairs")
    if pairs.isEmpty():
        return None
    alone, beside = _documents(docs, text_col, pairs)
    joined = pairs.join(beside, ["entity", "term"]).join(alone, "term")
    told = share("term_docs")
    return joined.filter(told >= disclosure).select("entity", "term", told.alias("information"))


def find_private(
    docs: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    support: int = SUPPORT,
    disclosure: float = DISCLOSURE,
    width: int = CONTEXT,
) -> DataFrame:
    """Per row ``row`` (columns in ``keep``, default all), ``spans`` (base) and ``all_spans``.

    A span is (start, rank, end) in code points, end exclusive; ranks number :data:`KINDS`, and the
    next rank is :data:`TERM`. A null or empty text has no spans. Rows that repeat get the same spans;
    an empty table gives no rows; columns of ``docs`` stay in ``row``. What is staged is narrow: spans,
    and hashes of entities and of the words near them, no text.
    """
    keep = docs.columns if keep is None else keep
    entities = staged(find_entities(docs, text_col, keep, width), "entities")
    telling = disclosing_terms(docs, text_col, entities, support, disclosure)
    if telling is None:
        return entities.select("row", "text_key", "spans", F.col("spans").alias("all_spans"))
    terms = staged(telling.select("term").distinct(), "telling")
    added = marked_terms(docs, text_col, terms)
    return entities.join(added, "text_key", "left").select(
        "row",
        "text_key",
        "spans",
        F.array_sort(
            F.concat("spans", F.coalesce("added", F.array().cast(_SPANS)))
        ).alias("all_spans"),
    )


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with entities removed and disclosing terms generalised, each to its kind in brackets."""
    found = find_private(docs, text_col, **options)
    names = docs.columns

    def clean(batches):
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("all_spans").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string()),
                ],
                names=["row", "text"],
            )

    rows = found.select("row", F.col(f"row.`{text_col}`").alias("text"), "all_spans")
    cleaned = rows.mapInArrow(clean, rows.select("row", "text").schema)
    return cleaned.select(
        *[F.col("text" if name == text_col else f"row.`{name}`").alias(name) for name in names]
    )


def redact(text: str | None, spans: list[dict]) -> str | None:
    if not text:
        return text
    out, free = [], 0
    for span in spans:
        if span["start"] >= free:
            kind = (*KINDS, TERM)[span["rank"]]
            out += [text[free : span["start"]], f"[{kind.upper()}]"]
        free = max(free, span["end"])
    return "".join([*out, text[free:]])


def _said(spans: str) -> Column:
    kinds = F.array(*[F.lit(kind) for kind in (*KINDS, TERM)])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])
        ),
        ",",
    )


def query(docs: DataFrame) -> DataFrame:
    """Entities per kind of each document, and all spans."""
    found = find_private(spread(docs, "doc_id", "text"), keep=["doc_id"])

    def number(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [number(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *counts,
        F.sha2(_said("spans"), 256).alias("base_sha256"),
        _said("all_spans").alias("spans"),
    )
