"""SimHash fingerprints and the search for fingerprints within a Hamming radius, all in Spark SQL.

A term is a run of words; its 64-bit hash votes for or against each bit, once per occurrence, so a term
weighs as often as it occurs. The votes of two bits share one sum: bit i counts in the low and bit i + 32
in the high half of a 64-bit number, which a task adds up per document before anything is shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stage as staged

#: Words in a term; a shorter text is one term.
TERM_WORDS = 3
BITS = 64
#: Blocks that a fingerprint is cut into for the search. With radius r, any two fingerprints within the
#: radius agree on at least ``BLOCKS - r`` blocks, so there is a table for each choice of as many.
BLOCKS = 5
RADIUS = 3
#: Rows that one bucket of the order by id should hold, quantiles that cut the ids first, and the even
#: steps that cut each part at most; so there are no more than 65,536 buckets.
BUCKET_ROWS = 20_000
QUANTILES = 64
MAX_STEPS = 1024


def terms(text: Column) -> Column:
    """Hashes of the runs of ``TERM_WORDS`` words of a text, upper and lower case alike."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(hashes: Column) -> Column:
        count = F.size(hashes)
        whole = F.transform(
            F.sequence(F.lit(0), count - TERM_WORDS),
            lambda k: F.xxhash64(*[F.get(hashes, k + d) for d in range(TERM_WORDS)]),
        )
        short = F.when(count > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
        return F.when(count >= TERM_WORDS, whole).otherwise(short)

    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), 0)


def fingerprints(rows: DataFrame, key: list[str], text_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the 64-bit ``fingerprint`` of the text (0 for a text without words) and ``carried``.

    Rows of one key vote together. A bit is set when more than half of the weight votes for it. Carried
    columns are numbers; their largest value per key comes along.
    """
    half = 1 << 32
    votes = rows.select(*key, *carried, F.explode_outer(terms(F.col(text_col))).alias("h"))
    mask = F.lit(half + 1)
    sums = [
        F.sum(F.shiftrightunsigned(F.col("h"), k).bitwiseAND(mask)).alias(f"s{k}") for k in range(BITS // 2)
    ]
    along = [F.max(name).alias(name) for name in carried]
    counted = votes.groupBy(*key).agg(F.count("h").alias("weight"), *along, *sums)
    bits = F.lit(0).cast("long")
    for k in range(BITS // 2):
        low = F.col(f"s{k}").bitwiseAND(half - 1)
        high = F.shiftrightunsigned(F.col(f"s{k}"), 32)
        for votes_for, place in ((low, k), (high, k + 32)):
            one = F.shiftleft(F.lit(1).cast("long"), place)
            bits = bits.bitwiseOR(F.when(2 * votes_for > F.col("weight"), one).otherwise(F.lit(0).cast("long")))
    return counted.select(*key, *carried, F.coalesce(bits, F.lit(0).cast("long")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of bits on which two fingerprints agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _block_keys(fingerprint: Column, radius: int, blocks: int) -> list[Column]:
    """One key per choice of ``blocks - radius`` blocks: the fingerprint with the other blocks blanked."""
    edges = [k * BITS // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = 0
        for block in chosen:
            mask |= (1 << edges[block + 1]) - (1 << edges[block])
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("table"), fingerprint.bitwiseAND(F.lit(mask)).alias("part")))
    return keys


def within_radius(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (left < right) of different values of ``fingerprint`` at most ``radius`` bits apart.

    Copies are one value, so a pair stands for all its documents. Each table keys the values by some of
    their blocks; a pair within the radius agrees on every block but ``radius`` and so meets in a table.
    It is given only by the first table in which it meets. Null fingerprints pair with nothing.
    """
    values = prints.select(F.col("fingerprint").alias("left")).filter(F.col("left").isNotNull()).distinct()
    keys = _block_keys(F.col("left"), radius, blocks)
    dealt = values.select("left", F.explode(F.array(*keys)).alias("key")).select("left", "key.*")
    pairs = dealt.join(dealt.withColumnRenamed("left", "right"), ["table", "part"])
    pairs = pairs.filter(
        (F.col("left") < F.col("right"))
        & (F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= radius)
    )
    return pairs.select("left", "right").distinct()


def _bucketed(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with a ``bucket`` that grows as the id falls, of about ``BUCKET_ROWS`` rows each.

    Quantiles of the ids cut their range into a fixed number of parts, and even steps cut each part, so
    the ids need not be dense; what the driver sees are the quantiles.
    """
    found = rows.agg(
        F.count("*"), F.percentile_approx(id_col, [k / QUANTILES for k in range(QUANTILES + 1)], 10_000)
    ).first()
    total, cuts = found[0], sorted(set(found[1] or []))
    if len(cuts) < 2:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    steps = min(MAX_STEPS, max(1, -(-total // (BUCKET_ROWS * (len(cuts) - 1)))))

    def part(low: int, high: int) -> Column:
        """Bucket of an id between two cuts: a balanced tree of comparisons."""
        if high - low == 1:
            step = F.width_bucket(F.col(id_col).cast("double"), F.lit(float(cuts[low])), F.lit(float(cuts[high]) + 1), F.lit(steps))
            step = F.least(F.greatest(step, F.lit(1)), F.lit(steps))
            return F.lit(-low * steps).cast("long") - step
        middle = (low + high) // 2
        return F.when(F.col(id_col) >= cuts[middle], part(middle, high)).otherwise(part(low, middle))

    return rows.withColumn("bucket", F.coalesce(part(0, len(cuts) - 1), F.lit(1).cast("long")))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, place, doc_id, text, next_text, next_bucket, next_place) in falling order of the id.

    The next document has the next smaller id; after the smallest comes the largest. Rows of one id
    follow each other by their texts, and rows without an id come last. Texts move once, to the bucket of
    their id; the first row of each bucket also goes, as a mark, to the end of the bucket before, so no
    order over all rows is ever made in one task.
    """
    rows = spread(docs, id_col, text_col).toDF("doc_id", "text")
    rows = _bucketed(rows.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id")
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    line = Window.orderBy("bucket")  # one row per bucket, and there are a bounded number
    ring = tops.select(
        "top",
        F.coalesce(F.lag("bucket").over(line), F.max("bucket").over(Window.partitionBy())).alias("before"),
    )
    marks = (
        rows.join(F.broadcast(ring), F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("before", "bucket")
        .agg(F.min("text").alias("text"))
        .select(
            F.col("before").alias("bucket"),
            F.lit(1).alias("mark"),
            F.lit(None).cast("long").alias("doc_id"),
            "text",
            F.col("bucket").alias("own_bucket"),
        )
    )
    every = rows.select(
        "bucket", F.lit(0).alias("mark"), "doc_id", "text", F.col("bucket").alias("own_bucket")
    ).unionByName(marks)
    order = Window.partitionBy("bucket").orderBy("mark", F.col("doc_id").desc_nulls_last(), "text")
    found = every.select(
        "bucket",
        "mark",
        F.row_number().over(order).alias("place"),
        "doc_id",
        "text",
        F.lead("text").over(order).alias("next_text"),
        F.lead("mark").over(order).alias("next_mark"),
        F.lead("own_bucket").over(order).alias("next_bucket"),
    )
    next_place = F.when(F.col("next_mark") == 1, F.lit(1)).otherwise(F.col("place") + 1)
    return found.filter(F.col("mark") == 0).select(
        "bucket", "place", "doc_id", "text", "next_text", "next_bucket", next_place.alias("next_place")
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last third (rounded down) replaced by the beginning of the following text."""
    size = F.char_length(text)
    cut = F.floor(size / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), size - cut), F.substr(following, F.lit(1), cut))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, ``n_chars``, ``edited_sha256``, the fingerprints of the text and of its edited form
    (16 hex digits), ``near_edited`` and ``near_next`` (share of equal bits), and ``n_near``: how many
    other values of the fingerprint lie within ``RADIUS`` bits.

    A null text is empty; a text without words has fingerprint 0. Rows that repeat are rows of their own:
    each is the next document of the one before it. Of a single row the next document is itself. An empty
    table gives no rows, and other columns are not read.
    """
    rows = with_next(docs, id_col, text_col)
    key = ["bucket", "place"]
    changed_text = edited(F.col("text"), F.col("next_text"))
    versions = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("version"), changed_text.alias("body")),
    )
    # The digest travels as four numbers, so that texts are shuffled once and votes are hash-aggregated.
    sha = F.sha2(changed_text, 256)
    parts = [F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    details = ("doc_id", "n_chars", "next_bucket", "next_place", "sha0", "sha1", "sha2", "sha3")
    described = rows.withColumn("n_chars", F.char_length("text").cast("long")).select(
        *key, *details[:4], *parts, F.explode(versions).alias("v")
    )
    prints = staged(
        fingerprints(
            described.select(*key, *details, "v.version", "v.body"), [*key, "version"], "body", details
        ),
        "fingerprints",
    )
    own = prints.filter(F.col("version") == 0).drop("version")
    changed = prints.filter(F.col("version") == 1).select(*key, F.col("fingerprint").alias("edited_print"))
    after = own.select(
        F.col("bucket").alias("next_bucket"),
        F.col("place").alias("next_place"),
        F.col("fingerprint").alias("next_print"),
    )
    pairs = within_radius(own)
    near = staged(
        pairs.select(F.explode(F.array("left", "right")).alias("fingerprint"))
        .groupBy("fingerprint")
        .agg(F.count("*").alias("n_near")),
        "near",
    )
    joined = (
        own.join(changed, key).join(after, ["next_bucket", "next_place"]).join(near, "fingerprint", "left")
    )

    def digits(column: str) -> Column:
        return F.lower(F.lpad(F.hex(column), 16, "0"))

    return joined.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        F.concat(*[digits(f"sha{k}") for k in range(4)]).alias("edited_sha256"),
        digits("fingerprint").alias("fingerprint"),
        digits("edited_print").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def query(docs: DataFrame) -> DataFrame:
    return near_texts(docs)
