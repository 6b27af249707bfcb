"""Near-duplicate groups by a chosen-path set similarity join.

Documents are sets of word shingles; equal sets are one class. A tree sends a class down to the node of
one of its minwise tokens; a node that is still large is split again by further minwise tokens, chosen by
the node, and so on. In a small node all pairs are compared. A pair whose sets overlap by 0.8 meets at one
minwise token with chance 0.8, so independent trees miss a pair with a chance that falls with their number.

A node sees signatures first: a class stays only if another in the node agrees with its signature as a
similar pair would. A pair that shared the root of an earlier tree is passed over if that root was compared
whole; where it was split, the pair may have parted there, and the later trees look at it again. For the
classes that stay, whole shingle sets meet in tiles and are compared exactly; each tile emits a star per
group it finds, so a dense group gives as many rows as it has members. A node of more than one tile is
contracted first: every class meets the others of one block and some pivots of the whole node, which links
the dense groups in rows that grow with the node and not with its square. Only what is then left in different
components meets block by block. What the first trees link is one
component, and the later trees compare only across components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, bit_map, mix, runs, sliced, spread, stage as staged

#: Words in a shingle, and the similarity (in hundredths) that links two documents, as the contract of
#: the query has them.
SHINGLE = 4
SIMILARITY = 80
#: Independent trees; a pair at the threshold is in no common node with chance 0.2 to this power.
TREES = 12
#: Trees that are joined before the others; what they link is not compared again.
FIRST_TREES = 1
#: Minwise tokens per class: the trees' roots first, the others for splits and for the signature.
SIGNATURE = 64
#: Two classes are compared if at least this share of their signatures agrees. At similarity 0.8 a pair
#: falls below with a chance of about four in a million.
AGREEMENT = 0.55
#: Classes in a tile. A node with more is split by further tokens; after ``DEPTH`` splits, or when most
#: of it stays together, its tiles are compared with each other instead.
TILE = 768
SPLIT_ABOVE = 2048
BRANCHES = 2
DEPTH = 3
#: Classes of a node larger than a tile that all its blocks meet before blocks meet each other.
PIVOTS = 8
#: Bits of the map that spares unlinked documents the second reading: for each wanted class, and at most.
MAP_BITS, MOST_MAP_BITS = 16, 1 << 26

_SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64))
_MEMBER = "class long, component long, n_shingles long, roots binary, signature binary, split binary"


def _sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, and the bounds of the texts among them."""
    counts = words.counts
    values, firsts = words.windows(size)
    owner = np.repeat(np.arange(len(counts)), counts)[firsts]
    for width in range(1, size):  # a shorter text is one shingle
        short = np.flatnonzero(counts == width)
        if len(short):
            whole, first = words.windows(width)
            at = np.searchsorted(first, words.bounds[short])
            values = np.concatenate([values, whole[at]])
            owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def _minwise(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of minwise tokens (32 bits each) per text that has shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), SIGNATURE), np.uint32)
    for k, seed in enumerate(_SEEDS):
        scrambled = (values ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        scrambled ^= scrambled >> np.uint64(32)
        scrambled *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = np.minimum.reduceat(scrambled, starts) >> np.uint64(32)
    return out


def sketches(docs: DataFrame, size: int, trees: int) -> DataFrame:
    """Per row of (doc_id, text): ``n_shingles``, ``digest`` of the set (null without words), ``roots``
    (32-bit minwise tokens of the trees) and ``signature`` (8 bits of every minwise token)."""

    def sketch(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                values, bounds = _sets(Words(part.column("text"), SPACED), size)
                counts = np.diff(bounds)
                made = {name: np.full(len(part), None, object) for name in ("digest", "roots", "signature")}
                some = np.flatnonzero(counts > 0)
                if len(some):
                    tokens = _minwise(values, bounds)
                    low = tokens.astype(np.uint8)
                    sums = [
                        np.add.reduceat(mix(values ^ salt), bounds[:-1][some])
                        for salt in (np.uint64(3), np.uint64(5))
                    ]
                    for place, text in enumerate(some):
                        made["digest"][text] = sums[0][place].tobytes() + sums[1][place].tobytes()
                        made["roots"][text] = tokens[place, :trees].tobytes()
                        made["signature"][text] = low[place].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        *[pa.array(made[name], pa.binary()) for name in made],
                    ],
                    names=["doc_id", "n_shingles", *made],
                )

    return docs.mapInArrow(
        sketch, "doc_id long, n_shingles long, digest binary, roots binary, signature binary"
    )


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    rows = column.to_pylist()
    width = len(rows[0]) // np.dtype(kind).itemsize if rows else 0
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), width)


def root_nodes(classes: DataFrame, trees: range) -> DataFrame:
    """(node, tree, class, component) of every class in the root node that its minwise token names."""

    def place(batches):
        for batch in batches:
            if len(batch):
                tokens = _matrix(batch.column("roots"), np.uint32).astype(np.uint64)
                for tree in trees:
                    node = mix(tokens[:, tree] * np.uint64(256) + np.uint64(tree))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(node.view(np.int64)),
                            pa.array(np.full(len(batch), tree), pa.int32()),
                            batch.column("class"),
                            batch.column("component"),
                        ],
                        names=["node", "tree", "class", "component"],
                    )

    return classes.select("class", "component", "roots").mapInArrow(
        place, "node long, tree int, class long, component long"
    )


def split_roots(classes: DataFrame, trees: int) -> DataFrame:
    """``classes`` with ``split``: a byte per tree, 1 where the root node of the class is too large to be
    compared whole, so that sharing it does not mean to have met there."""
    rows = root_nodes(classes.withColumn("component", F.col("class")), range(trees))
    large = staged(
        rows.groupBy("node").agg(F.count("*").alias("members")).filter(F.col("members") > SPLIT_ABOVE).select("node"),
        "split",
    )
    held = rows.join(large, "node").groupBy("class").agg(F.collect_set("tree").alias("among"))
    told = F.unhex(
        F.concat(*[F.when(F.array_contains("among", tree), "01").otherwise("00") for tree in range(trees)])
    )
    return classes.join(held.select("class", told.alias("split")), "class", "left").withColumn(
        "split", F.coalesce("split", F.lit(bytes(trees)))
    )


def child_nodes(members: DataFrame) -> DataFrame:
    """Members of nodes in the children that the node's own choice of minwise tokens sends them to."""
    names = ["node", "tree", "class", "component", "n_shingles", "roots", "signature", "split", "parent_members"]

    def descend(batches):
        for batch in batches:
            if len(batch):
                tokens = _matrix(batch.column("signature"), np.uint8).astype(np.uint64)
                node = np.asarray(batch.column("node")).view(np.uint64)
                for branch in range(BRANCHES):
                    chosen = (mix(node ^ np.uint64(0xB5 + branch)) % np.uint64(SIGNATURE)).astype(np.int64)
                    value = tokens[np.arange(len(node)), chosen]
                    child = mix(mix(node + np.uint64(branch + 1)) ^ value)
                    rest = [batch.column(name) for name in names[1:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(child.view(np.int64)), *rest, batch.column("members")], names=names
                    )

    return members.select(*names[:-1], "members").mapInArrow(
        descend, f"node long, tree int, {_MEMBER}, parent_members long"
    )


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes in which there is something to join, with the number of ``members``."""
    sizes = rows.groupBy("node").agg(
        F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    sizes = staged(sizes.filter(F.col("low") < F.col("high")).select("node", "members"), "nodes")
    return rows.join(sizes, "node")


_LEAF = ["node", "tree", "class", "component", "n_shingles", "roots", "signature", "split", "members"]


def leaves(classes: DataFrame, trees: range) -> DataFrame:
    """Members of the leaf nodes of the trees; a node whose classes are in one component is left out."""
    members = _counted(root_nodes(classes, trees)).join(classes.drop("digest", "component"), "class")
    done = []
    for _ in range(DEPTH):
        members = staged(members, "members")
        done.append(members.filter(F.col("members") <= SPLIT_ABOVE).drop("parent_members"))
        large = members.filter(F.col("members") > SPLIT_ABOVE)
        if large.isEmpty():
            members = None
            break
        children = _counted(staged(child_nodes(large), "children"))
        # Where most of a node goes on together, its classes are alike: compare them, do not split them.
        dense = (F.col("members") > SPLIT_ABOVE) & (2 * F.col("members") > F.col("parent_members"))
        done.append(children.filter(dense).drop("parent_members"))
        members = children.filter(~dense)
    if members is not None:
        done.append(members.drop("parent_members"))
    every = done[0].select(_LEAF)
    for rows in done[1:]:
        every = every.unionByName(rows.select(_LEAF))
    return staged(every, "leaves")


def _largest(large: DataFrame) -> DataFrame:
    """(node, main, held, all): the largest component of every node, its classes, and all classes."""
    sizes = large.groupBy("node", "component").agg(F.count("*").alias("size"))
    main = F.max_by("component", F.struct("size", "component")).alias("main")
    return sizes.groupBy("node").agg(main, F.max("size").alias("held"), F.sum("size").alias("all"))


def _open(every: DataFrame) -> DataFrame:
    """The rows of nodes that still have classes of different components."""
    ends = every.groupBy("node").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return every.join(ends.filter(F.col("least") < F.col("most")).select("node"), "node", "left_semi")


def pivot_tiles(large: DataFrame) -> DataFrame:
    """Rows of tiles of nodes larger than a tile: each class in one block, the pivots in all of them."""
    count = F.ceil(F.col("members") / TILE).cast("int")
    own = F.pmod(F.xxhash64("class", "node"), count).cast("int")
    # A pivot is a minimum, so a task sends one row per node however many classes the node has.
    chosen = [
        F.min(F.struct(F.xxhash64("class", F.lit(k)).alias("rank"), *_LEAF[1:])).alias(f"pivot{k}")
        for k in range(PIVOTS)
    ]
    pivots = large.groupBy("node").agg(*chosen)
    pivots = pivots.select("node", F.explode(F.array(*[F.col(f"pivot{k}") for k in range(PIVOTS)])).alias("pivot"))
    pivots = pivots.select("node", "pivot.*").drop("rank").dropDuplicates(["node", "class"])
    pivots = pivots.withColumn("low", F.explode(F.sequence(F.lit(0), count - 1)))
    # A pivot is in its own block already.
    both = large.withColumn("low", own).unionByName(pivots.filter(F.col("low") != own))
    return both.select("node", "low", F.col("low").alias("high"), F.lit(0).alias("side"), *_LEAF[1:-1])


def tiles(every: DataFrame) -> DataFrame:
    """Members of leaf nodes as rows of tiles (node, low, high), each with its ``side``.

    A node of at most ``TILE`` classes is one tile. A larger one is dealt into blocks of about that many
    by a hash of the class, and a tile is a pair of blocks; the node's largest component has blocks of
    its own, which are not compared with each other.
    """
    small = every.filter(F.col("members") <= TILE).select(
        "node", *[F.lit(0).alias(name) for name in ("low", "high", "side")], *_LEAF[1:-1]
    )
    large = every.filter(F.col("members") > TILE)
    joined = large.join(_largest(large), "node")

    def blocks(members: Column) -> Column:
        return F.ceil(members / TILE).cast("int")

    # Blocks of the largest component come last and meet the others' blocks, not each other.
    rest, held = blocks(F.col("all") - F.col("held")), blocks(F.col("held"))
    inside = F.col("component") == F.col("main")
    number = F.xxhash64("class", "node")
    side = F.when(inside, rest + F.pmod(number, held)).otherwise(F.pmod(number, rest)).cast("int")
    met = F.sequence(F.lit(0), F.when(inside, rest).otherwise(rest + held) - 1)
    dealt = joined.withColumn("side", side).withColumn("other", F.explode(met))
    return small.unionByName(
        dealt.select(
            "node",
            F.least("side", "other").alias("low"),
            F.greatest("side", "other").alias("high"),
            "side",
            *_LEAF[1:-1],
        )
    )


def _alike(table: pa.Table, similarity: int, agreement: float) -> np.ndarray:
    """Which rows of whole tiles have another in their tile that may be similar."""
    columns = {name: np.asarray(table.column(name)) for name in ("node", "low", "high", "side", "tree", "n_shingles", "component")}
    roots, marks = _matrix(table.column("roots"), np.uint32), _matrix(table.column("signature"), np.uint8)
    split = _matrix(table.column("split"), np.uint8).astype(bool)
    size = columns["n_shingles"]
    group = np.zeros(len(size), np.int64)
    for name in ("node", "low", "high"):
        group[1:] |= columns[name][1:] != columns[name][:-1]
    group = np.cumsum(group)
    across = columns["low"] != columns["high"]
    stays = np.zeros(len(size), bool)
    earlier = np.arange(roots.shape[1])
    left, step = np.arange(len(size)), 0
    while len(left):
        step += 1
        left = left[left + step < len(size)]
        left = left[group[left] == group[left + step]]
        for at in range(0, len(left), 1 << 15):
            a = left[at : at + (1 << 15)]
            b = a + step
            fair = 100 * np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            fair &= (columns["component"][a] != columns["component"][b]) & (
                ~across[a] | (columns["side"][a] != columns["side"][b])
            )
            a, b = a[fair], b[fair]
            # a pair that meets in an earlier tree as well is looked at there, unless that root was split
            met = ((roots[a] == roots[b]) & ~split[a] & (earlier < columns["tree"][a][:, None])).any(axis=1)
            a, b = a[~met], b[~met]
            near = (marks[a] == marks[b]).sum(axis=1) >= agreement * SIGNATURE
            stays[a[near]] = True
            stays[b[near]] = True
    return stays


_TILE_KEY = ["node", "low", "high"]


def candidates(tile_rows: DataFrame, similarity: int, agreement: float) -> DataFrame:
    """(node, low, high, class) of the classes whose sets have to be compared in a tile."""

    def sift(batches):
        for table in runs(batches, _TILE_KEY):
            kept = table.filter(pa.array(_alike(table, similarity, agreement)))
            yield from kept.select([*_TILE_KEY, "class"]).combine_chunks().to_batches()

    met = tile_rows.repartition(*_TILE_KEY).sortWithinPartitions(*_TILE_KEY)
    return met.mapInArrow(sift, "node long, low int, high int, class long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, values) for the documents whose id is a wanted class; values are 64-bit shingle hashes."""
    bits = min(MOST_MAP_BITS, (wanted.count() * MAP_BITS // 32768 + 1) * 32768)
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    may = np.packbits(bit_map(wanted.withColumnRenamed("class", "doc_id"), bit, bits), bitorder="little")

    def build(batches):
        for batch in batches:
            bit = np.asarray(batch.column("bit"))
            batch = batch.filter(pa.array((may[bit >> 3] >> (bit & 7) & 1).astype(bool)))
            for part in sliced(batch, "text"):
                values, bounds = _sets(Words(part.column("text"), SPACED), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    names=["class", "values"],
                )

    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", bit.alias("bit"))
    return rows.mapInArrow(build, "class long, values binary")


def _joining(names: np.ndarray, sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """Whoever is linked in a tile, directly or by others, as (class, smallest class it reaches)."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    common = np.zeros((count, count), np.int64)
    if count <= 6:
        for a in range(count):
            for b in range(a):
                common[a, b] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        owner = np.repeat(np.arange(count), sizes)
        values, number = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        width = max(1, (1 << 21) // count)
        edges = np.searchsorted(number, np.arange(0, len(values) + width, width))
        for block, (a, b) in enumerate(zip(edges, edges[1:])):
            has = np.zeros((count, width), np.float32)
            has[owner[a:b], number[a:b] - block * width] = 1
            common += np.rint(has @ has.T).astype(np.int64)
    linked = (common > 0) & (100 * common >= similarity * (sizes[:, None] + sizes[None, :] - common))
    order = np.argsort(names, kind="stable")  # the smaller name becomes the root
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(np.tril(linked, -1))):
        low, high = sorted((root(int(place[a])), root(int(place[b]))))
        parent[high] = low
    tops = [(int(names[order[x]]), int(names[order[root(x)]])) for x in range(count)]
    return [(x, top) for x, top in tops if x != top]


def links(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between classes, confirmed on whole sets where the members of a tile meet."""

    def compare(batches):
        for table in runs(batches, _TILE_KEY):
            names = np.asarray(table.column("class"))
            keys = [np.asarray(table.column(name)) for name in _TILE_KEY]
            new = np.ones(len(names), bool)
            new[1:] = False
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            cuts = [*np.flatnonzero(new), len(names)]
            values = table.column("values")
            pairs = []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    own = [np.frombuffer(v.as_py(), np.uint64) for v in values.slice(a, b - a)]
                    pairs += _joining(names[a:b], own, similarity)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"]
            )

    met = members.join(sets, "class").repartition(*_TILE_KEY).sortWithinPartitions(*_TILE_KEY)
    return met.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(class, component) of every class with a link; the component is its smallest class.

    Each round takes the smallest label among the neighbours and then that label's own label, so the
    rounds grow with the logarithm of the longest path. Labels are tables between rounds.
    """
    both = staged(
        edges.select(F.col("a").alias("class"), F.col("b").alias("next")).unionByName(
            edges.select(F.col("b").alias("class"), F.col("a").alias("next"))
        ),
        "edges",
    )
    labels = staged(both.groupBy("class").agg(F.min(F.least("class", "next")).alias("component")), "labels")
    while True:
        around = (
            both.join(labels.withColumnRenamed("class", "next"), "next")
            .groupBy("class")
            .agg(F.min("component").alias("around"))
        )
        nearer = staged(
            labels.join(around, "class").select(
                "class", F.least("component", "around").alias("component"), F.col("component").alias("old")
            ),
            "nearer",
        )
        if nearer.filter(F.col("component") < F.col("old")).isEmpty():
            return labels
        jump = nearer.select(F.col("class").alias("component"), F.col("component").alias("further"))
        labels = staged(
            nearer.join(jump, "component").select("class", F.col("further").alias("component")), "labels"
        )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similarity: int = SIMILARITY,
    trees: int = TREES,
    agreement: float = AGREEMENT,
) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``.

    Equal sets are one class at distance zero, so any number of copies costs one class. A null or empty
    text and one without words have no shingles and link with nothing, not even with each other. Rows of
    one id are one document for the links. A row without an id links with nothing, has no component and
    is kept. An empty table gives no rows; other columns are not read.
    """
    rows = spread(docs, id_col, text_col).toDF("doc_id", "text")
    sketch = staged(sketches(rows.withColumn("doc_id", F.col("doc_id").cast("long")), size, trees), "sketches")
    classes = staged(
        sketch.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("class"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("roots").alias("roots"),
            F.first("signature").alias("signature"),
        ),
        "classes",
    )
    classes = staged(split_roots(classes, trees), "classes")
    found, groups, waiting = None, None, None

    def joined(rows: DataFrame) -> DataFrame:
        """``rows`` with the component of their class."""
        if groups is None:
            return rows.withColumn("component", F.col("class"))
        known = rows.drop("component").join(groups, "class", "left")
        return known.withColumn("component", F.coalesce("component", "class"))

    def link(tile_rows: DataFrame) -> None:
        nonlocal found, groups
        stay = staged(candidates(tile_rows, similarity, agreement), "candidates")
        new = links(stay, shingle_sets(rows, stay.select("class"), size), similarity)
        found = staged(new if found is None else new.unionByName(found).distinct(), "links")
        groups = components(found)

    for some in (range(min(FIRST_TREES, trees)), range(FIRST_TREES, trees)):
        if not len(some):
            continue
        every = leaves(joined(classes), some)
        met = tiles(every.filter(F.col("members") <= TILE))
        large = every.filter(F.col("members") > TILE)
        some_large = not large.isEmpty()
        if some_large:
            met = met.unionByName(pivot_tiles(large))
        if waiting is not None:
            met = met.unionByName(tiles(waiting))
        link(met)
        # What the pivots have not brought together meets block by block along with the next trees.
        waiting = staged(_open(joined(large).select(_LEAF)), "waiting") if some_large else None
    if waiting is not None:
        link(tiles(waiting))
    whole = classes.select("digest", "class").join(groups, "class", "left").select(
        "digest", F.coalesce("component", "class").alias("component_id")
    )
    found = sketch.select("doc_id", "n_shingles", "digest").join(whole, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, that of the smallest id, all columns unchanged."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{name}`" for name in docs.columns])
