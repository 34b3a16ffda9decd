"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

Every distinct text gets MinHash signatures of its five-word shingle set: TREES paths of DEPTH values, each a key of a
prefix trie. Prefixes are matched by grouping and sorting the keys in Spark, the longest first, and are shortened level
by level for the texts that have not reached the target recall: the chance that a pair at the least similarity such a
text can have with a linked one shares a prefix in some tree. The shortest prefix that any text needs prunes the tries
first: a key that shares it with no other text shares no longer one. Groups linked by it that fit a block are compared
whole. Larger ones are taken apart: texts that share a full path are a unit, and each shortening adds pairs of small
units, or joins crowded ones to a group that is compared in blocks, so that a long chain of loosely similar texts is not
compared all with all. Only per-text results leave a block: link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._text import shingle_set, slices, strings, words
from .components import components

SIMILARITY = 0.8
#: Chance that a pair at the threshold becomes a candidate.
RECALL = 0.999
TREES, DEPTH = 48, 12
#: A block of a candidate group holds about so many shingles and texts at most.
BLOCK_SHINGLES, BLOCK_TEXTS = 400_000, 700
#: Up to so many units under one trie node are paired, more of them become one group; so do paired units of which one holds
#: more texts than this, or both have more partners. The pairs that are left join small units, at most so many for one of
#: the two, and a dense group is compared in blocks.
NODE_UNITS = 8
#: Shingles of up to so many texts of a block are counted pair by pair, others by matrix products.
FEW = 24


def prefix_length(similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target chance (at least 1)."""
    for d in range(depth, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


def _coefficients(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    return draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)


def minhash(features: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = 256) -> np.ndarray:
    """MinHash signature (uint32 per hash function) of a non-empty set of 64-bit features."""
    x = (features >> np.uint64(32)).astype(np.uint32)
    low = None
    for k in range(0, len(x), rows):
        part = x[k : k + rows, None] * a[None, :]
        part += b[None, :]
        m = part.min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return low


@lru_cache(maxsize=4096)
def needed_prefix(shingles: int, similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a text of so many shingles meets the target recall.

    Its links have at least the smallest Jaccard similarity k / u >= `similarity` that integers k <= shingles <= u allow.
    """
    if shingles > 200:
        return prefix_length(similarity, recall, trees, depth)
    least = 1.0
    for shared in range(max(1, math.ceil(similarity * shingles - 1e-9)), shingles + 1):
        union = math.floor(shared / similarity + 1e-9)
        if union >= shingles:
            least = min(least, shared / union)
    return prefix_length(max(least, similarity), recall, trees, depth)


def tree_paths(signatures: np.ndarray, trees: int, depth: int, base: int) -> np.ndarray:
    """Keys of the prefix tries, as bytes by text and tree: the first `base` values as one 64-bit hash (no shorter prefix is
    ever matched), then two bytes for every further value."""
    path = signatures.reshape(len(signatures), trees, depth)
    head = np.broadcast_to(np.arange(trees, dtype=np.uint64), (len(signatures), trees)) * np.uint64(0x9E3779B97F4A7C15)
    for level in range(base):
        head = (head ^ path[:, :, level].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        head ^= head >> np.uint64(29)
    tail = (path[:, :, base:] >> np.uint32(8)).astype(np.uint16)
    return np.concatenate([np.ascontiguousarray(head).view(np.uint8).reshape(*head.shape, 8), np.ascontiguousarray(tail).view(np.uint8).reshape(*head.shape, 2 * (depth - base))], axis=2)


def path_bytes(depth: int, base: int) -> int:
    return 8 + 2 * (depth - base)


def _signatures(texts: DataFrame, similarity: float, recall: float) -> DataFrame:
    """key, n (shingles), needed (its longest sufficient prefix), trees (binary, the paths of all trees) of every text that has words."""
    base = prefix_length(similarity, recall)
    a, b = _coefficients(TREES * DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = words(strings(part, "text"))
                keys, sizes, packed = part.column("key").to_pylist(), [], []
                at = []
                signatures = []
                for k in range(part.num_rows):
                    features = shingle_set(hashes[offsets[k] : offsets[k + 1]])
                    if len(features):
                        at.append(k)
                        sizes.append(len(features))
                        signatures.append(minhash(features, a, b))
                if at:
                    packed = [row.tobytes() for row in tree_paths(np.stack(signatures), TREES, DEPTH, base)]
                needed = [needed_prefix(n, similarity, recall) for n in sizes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in at], pa.binary()), pa.array(sizes, pa.int64()), pa.array(needed, pa.int32()), pa.array(packed, pa.binary())], ["key", "n", "needed", "trees"]
                )

    return texts.mapInArrow(run, "key binary, n long, needed int, trees binary")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of sorted distinct feature arrays."""
    m = len(sets)
    if m == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]], np.int32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    features = np.concatenate(sets)
    order = np.argsort(features, kind="stable")
    features, owner = features[order], owner[order]
    first = np.flatnonzero(np.r_[True, features[1:] != features[:-1]])
    sizes = np.diff(np.r_[first, len(features)])
    out = np.zeros((m, m), np.int32)
    for c in range(2, FEW + 1):
        at = first[sizes == c]
        for k in range(0, len(at), 1 << 12):
            members = owner[at[k : k + (1 << 12), None] + np.arange(c)[None, :]]
            for i in range(c):
                for j in range(i):
                    np.add.at(out, (members[:, i], members[:, j]), 1)
    out += out.T
    many = np.flatnonzero(sizes > FEW)
    for k in range(0, len(many), 1024):
        dense = np.zeros((m, min(1024, len(many) - k)), np.float32)
        for column, g in enumerate(many[k : k + 1024]):
            dense[owner[first[g] : first[g] + sizes[g]], column] = 1
        out += (dense @ dense.T).astype(np.int32)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _link_block(sets: list[np.ndarray], blocks: np.ndarray, copies: np.ndarray, across: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each text counted in copies, number of the first text of its linked group) in one block or block pair.

    In a pair of different blocks (`across`) only links between them count; those within a block are counted in the block itself.
    """
    m = len(sets)
    shared = _intersections(sets)
    sizes = np.array([len(s) for s in sets])
    linked = np.empty((m, m), bool)
    for k in range(m):
        linked[k] = shared[k] >= similarity * (sizes[k] + sizes - shared[k]) - 1e-9
    np.fill_diagonal(linked, False)
    if across:
        linked &= blocks[:, None] != blocks[None, :]
    links = np.array([copies[row].sum() for row in linked])
    root = np.arange(m)
    while True:
        near = np.array([root[row].min(initial=m) for row in linked])
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return links, root
        root = new


def _verify(members: DataFrame, similarity: float) -> DataFrame:
    """key, links, root from members (part, block, key, copies, text), sorted by part within partitions."""

    def flush(part: str, rows: dict) -> pa.RecordBatch:
        keys = sorted(rows)
        sets, blocks, copies = zip(*[rows[k] for k in keys], strict=True)
        links, root = _link_block(list(sets), np.array(blocks), np.array(copies, np.int64), part[0] == "x", similarity)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array([keys[r] for r in root], pa.binary())], ["key", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, {}  # of one block or block pair: key -> (shingles, block, copies)
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, offsets = words(strings(piece, "text"))
                columns = [piece.column(c).to_pylist() for c in ("part", "block", "key", "copies")]
                for k, (part, block, key, copies) in enumerate(zip(*columns, strict=True)):
                    if part != current:
                        if len(rows) > 1:
                            yield flush(current, rows)
                        current, rows = part, {}
                    if key not in rows:  # a key comes once per row that carries the text
                        rows[key] = (shingle_set(hashes[offsets[k] : offsets[k + 1]]), block, copies)
        if len(rows) > 1:
            yield flush(current, rows)

    return members.mapInArrow(run, "key binary, links long, root binary")


def _key(text: str) -> Column:
    """Content hash of a text; null reads as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _units(members: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """((node, unit, group) of every text, (x, y) pairs of units to compare) from members (node, n, needed, trees) of large groups.

    Texts of a full path are a unit. At every shorter prefix that a text needs, units under one trie node are paired, or
    joined to a group where they are many or crowded (see NODE_UNITS). Pairs within a group are left out: all of its texts
    are compared. The tries are walked as sorted runs of keys (windows), not joined.
    """
    width = path_bytes(DEPTH, base)
    trees = f"sequence(0, {TREES - 1})"
    full = members.select("node", F.explode(F.expr(f"transform({trees}, k -> substring(trees, k * {width} + 1, {width}))")).alias("path"))
    run = full.withColumn("least", F.min("node").over(Window.partitionBy("path"))).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    roots = components(run).withColumnRenamed("root", "unit")
    units = materialize(members.join(roots, "node", "left").withColumn("unit", F.coalesce("unit", "node")))
    # every prefix from the shortest that a text needs on; prefixes of different lengths are different keys
    lengths = f"filter(sequence({base}, {DEPTH - 1}), d -> d >= needed)"
    prefixes = F.explode(F.expr(f"flatten(transform({trees}, k -> transform({lengths}, d -> substring(trees, k * {width} + 1, 8 + 2 * (d - {base})))))")).alias("prefix")
    by_node = Window.partitionBy("prefix")
    under = units.select("unit", prefixes).distinct().withColumn("units", F.count("*").over(by_node)).where("units > 1").withColumn("least", F.min("unit").over(by_node))
    under = materialize(under)
    listed = under.where(F.col("units") <= NODE_UNITS).groupBy("prefix").agg(F.sort_array(F.collect_list("unit")).alias("u"))
    paired = listed.select(F.explode(F.expr("flatten(transform(u, (a, i) -> transform(slice(u, i + 2, size(u)), b -> struct(a AS x, b AS y))))")).alias("p")).select("p.x", "p.y")
    pairs = materialize(paired.distinct())
    many = under.where(F.col("units") > NODE_UNITS).select(F.col("unit").alias("a"), F.col("least").alias("b"))
    sizes = units.groupBy("unit").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    partners = pairs.select(F.col("x").alias("unit")).union(pairs.select("y")).groupBy("unit").agg(F.count("*").alias("partners"))
    large = (F.col("texts") > NODE_UNITS) | (F.col("shingles") > BLOCK_SHINGLES / 2)
    crowded = materialize(sizes.join(partners, "unit").select("unit", large.alias("large"), (F.col("partners") > NODE_UNITS).alias("many")).where("large OR many"))
    of = lambda column: crowded.select(F.col("unit").alias(column), F.col("large").alias(f"{column}_large"), F.col("many").alias(f"{column}_many"))
    dense = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left").where("coalesce(x_large, false) OR coalesce(y_large, false) OR (x_many AND y_many)")
    groups = materialize(components(many.union(dense.select(F.col("x").alias("a"), F.col("y").alias("b")))).withColumnRenamed("root", "group"))
    named = lambda column: groups.select(F.col("node").alias(column), F.col("group").alias(f"{column}_group"))
    apart = pairs.join(named("x"), "x", "left").join(named("y"), "y", "left").where("coalesce(x_group, x) <> coalesce(y_group, y)").select("x", "y")
    placed = units.join(groups.withColumnRenamed("node", "unit"), "unit", "left").select("node", "unit", F.coalesce("group", "unit").alias("group"))
    return placed, materialize(apart)


def _parts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, copies, first, part, block from texts (key, n, copies, first, unit, group): every block of a group, every two
    blocks of it, and every pair of units. Parts named x.. count links between blocks only."""
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks")
    sizes = materialize(texts.groupBy("group").agg(blocks))
    placed = texts.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    named = lambda kind, *of: F.concat(F.lit(kind), F.hex(F.xxhash64(*of, F.lit(0))), F.hex(F.xxhash64(F.lit(1), *of)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    part = F.when(low == high, named("o", "group", low)).otherwise(named("x", "group", low, high))
    inside = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "copies", "first", part.alias("part"), F.col("own").alias("block"))
    for number, side in enumerate(("x", "y")):
        across = texts.join(pairs.withColumn("unit", F.col(side)), "unit").select("key", "copies", "first", named("xc", "x", "y").alias("part"), F.lit(number).alias("block"))
        inside = inside.unionByName(across)
    return inside


def link_texts(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per distinct text: key (its hash), group (least key of its linked group), n_links, first (none, doc_id).

    Links join documents whose shingle sets have Jaccard similarity of `similarity` or more; `n_links` counts the other
    documents linked to one that carries the text, copies one by one; the group is the connected component; `first` is
    the least id of its copies, null last. A text of fewer than five words has one shingle of all of them. Texts without
    words (null, empty) link only to exact copies; null reads as empty. Repeated rows are copies. Extra columns are
    ignored; an empty table gives no rows. Joins have plain tables on both sides, so that adaptive execution can split
    the rows of a hot key.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = materialize(_signatures(texts.select("key", "text"), similarity, recall).groupBy("key").agg(F.first("n").alias("n"), F.first("needed").alias("needed"), F.first("trees").alias("trees")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    copies = materialize(texts.groupBy("key").agg(F.count("*").alias("copies"), first))
    base = prefix_length(similarity, recall)
    width = path_bytes(DEPTH, base)
    path = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.substring("trees", k * width + 1, F.lit(width)))).alias("path")
    # the shortest prefix that any text needs prunes the tries
    leaves = signed.select("key", path).select("key", F.substring("path", 1, path_bytes(base, base)).alias("leaf"))
    shared = materialize(leaves.groupBy("leaf").agg(F.min("key").alias("least"), F.max("key").alias("most")).where(F.col("least") != F.col("most")).select("leaf", "least"))
    edges = leaves.join(shared, "leaf").select(F.col("key").alias("a"), F.col("least").alias("b"))
    grouped = components(edges).join(signed.select(F.col("key").alias("node"), "n"), "node").join(copies.withColumnRenamed("key", "node"), "node")
    grouped = materialize(grouped.withColumn("unit", F.col("root")).withColumnRenamed("root", "group"))
    sizes = materialize(grouped.groupBy("group").agg(F.sum("n").alias("shingles"), F.count("*").alias("texts")))
    large = sizes.where((F.col("shingles") > BLOCK_SHINGLES) | (F.col("texts") > BLOCK_TEXTS)).select("group")
    pairs = grouped.select(F.col("unit").alias("x"), F.col("unit").alias("y")).limit(0)
    if not large.isEmpty():
        apart = materialize(grouped.join(large, "group").drop("unit", "group"))
        units, pairs = _units(materialize(apart.select("node", "n").join(signed.select(F.col("key").alias("node"), "needed", "trees"), "node")), base)
        grouped = materialize(grouped.join(large, "group", "left_anti").unionByName(apart.join(units, "node")))
    members = _parts(grouped.withColumnRenamed("node", "key"), pairs)
    members = members.select(F.col("key").alias("_key"), F.col("first.doc_id").alias("_first"), "part", "block", "copies")
    # of the copies of a text only the first carries it on
    carried = texts.join(members.hint("merge"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    placed = carried.select("part", "block", "key", "copies", "text")
    verified = materialize(_verify(placed.repartition("part").sortWithinPartitions("part"), similarity))
    joined = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    found = joined.withColumnRenamed("node", "key").join(links, "key", "left")
    per_text = copies.join(found, "key", "left")
    return per_text.select("key", F.coalesce("root", "key").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first")


def join_near_texts(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its linked group), n_links; see `link_texts`."""
    linked = materialize(link_texts(docs, similarity, recall, text, doc_id))
    classes = materialize(linked.groupBy("group").agg(F.min("first").alias("least")))
    of_text = linked.join(classes, "group").select("key", F.col("least.doc_id").alias("class_id"), "n_links")
    return docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("key")).join(of_text, "key").select("doc_id", "class_id", "n_links")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs`, all columns, with one document of each linked group: the one of the least id (null last), one row of it."""
    linked = link_texts(docs, similarity, recall, text, doc_id)
    kept = linked.groupBy("group").agg(F.min(F.struct("first.none", "first.doc_id", "key")).alias("w")).select(F.col("w.doc_id").alias("_kept_id"), F.col("w.key").alias("_kept_key"))
    # whole rows as one column: no name of theirs can clash
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _key(text).alias("_key"), F.col(doc_id).alias("_id"))
    rows = placed.join(materialize(kept), (F.col("_key") == F.col("_kept_key")) & F.col("_id").eqNullSafe(F.col("_kept_id")))
    # repeated rows of the kept document: one stays
    return rows.dropDuplicates(["_key", "_id"]).select("_row.*")
