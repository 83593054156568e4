"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is the set of its runs of five words (a shorter text is one run). Texts with equal sets
are copies of one representative and enter once. Each of ``trees`` tries orders the
representatives by a signature of ``depth`` MinHash values; texts below one trie node share a
prefix. Matching begins at full depth and the prefix is shortened until a pair of exactly the
threshold is found with the target recall (1 - (1 - t**k)**trees >= recall):

1. Full prefixes: each text is paired with the first text of its node, pairs are verified on
   the whole sets, and links join texts to classes.
2. Shortened prefixes: below nodes that hold several classes, blocks of ``block`` texts are
   compared with blocks, and a task reports only the few links that join classes. A large
   group, now one class, needs no further work of its own.

Links are then counted inside each class, again blocks against blocks, without listing the
pairs. Copies never are expanded. Hot keys meet only in partial aggregates and in joins that
Spark can split.

Defined cases: a null or empty text, or one of blanks only, has no words; all such texts are
copies of each other; repeated rows are copies; the class id is the smallest document id of the
class, null ids last (null if there is no other); extra columns are not read by ``classes`` and
kept by ``first_of_class``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import LAST_ID, emit, narrow, order_id, prepare, saved, slices, text_bytes
from orderlens.llm.substring_dedup import bitmap, holds
from orderlens.llm.words import mix, starts_with_room, window_codes, words


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of each text's runs of words, and where each text's begin."""
    found = words(*text_bytes(texts))
    counts, n = found.counts, len(texts)
    codes = window_codes(found.codes, size)
    inside = np.flatnonzero(starts_with_room(found.first, len(codes), size))
    owner = np.searchsorted(found.first, inside, "right") - 1
    codes = codes[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = [mix(np.bitwise_xor.reduce(mix(found.codes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)))[None])[0] for a, b in zip(found.first[short], found.first[short + 1], strict=True)]
    codes, owner = np.r_[codes, np.array(whole, np.uint64)], np.r_[owner, short]
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    return codes[new], np.searchsorted(owner[new], np.arange(n + 1))


def set_codes(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    raw, at = codes.tobytes(), (first * 8).tolist()
    return np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(at[:-1], at[1:], strict=True)), np.int64)


def prefix_keys(codes: np.ndarray, first: np.ndarray, trees: int, depth: int, cut: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text and tree: the key of its full prefix and of its prefix of ``cut`` values."""
    n = len(first) - 1
    filled = np.flatnonzero(np.diff(first) > 0)
    factors = np.random.default_rng(seed).integers(1, 1 << 63, trees * depth, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    full, short = np.zeros((n, trees), np.uint64), np.zeros((n, trees), np.uint64)
    if not len(filled):
        return full, short
    heads = first[filled]
    for tree in range(trees):
        key = np.full(len(filled), tree + 1, np.uint64)
        for k in range(depth):
            # High bits of the product are the hash; the least one identifies the shingle.
            least = np.minimum.reduceat(codes * factors[tree * depth + k], heads)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ least)
            if k + 1 == cut:
                short[filled, tree] = key
        full[filled, tree] = key
    return full, short


def shortened(depth: int, trees: int, threshold: float, recall: float) -> int:
    """The longest prefix that finds a pair at the threshold with the target recall."""
    return max(k for k in range(1, depth + 1) if k == 1 or 1 - (1 - threshold**k) ** trees >= recall)


def enough(common, union, threshold: float):
    """common / union >= threshold in whole numbers; for arrays and columns."""
    return common * 10_000 >= union * round(threshold * 10_000)


def key_of(code: np.ndarray, oid: np.ndarray) -> np.ndarray:
    return mix(code.view(np.uint64) ^ mix(oid.view(np.uint64)))


def smallest_neighbours(edges: DataFrame) -> DataFrame:
    """``node``, ``class``: the smallest node that each node of ``edges`` (a, b) is connected to.

    In each round all nodes with one label take the least label next to any of them, so labels
    merge like contracted nodes and rounds grow with the logarithm of a component's size.
    """
    both = saved(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")).distinct())
    labels = saved(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("class")))
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), "class"), "next").groupBy("node").agg(F.min("class").alias("near"))
        seen = labels.join(near, "node")
        pulled = seen.groupBy("class").agg(F.min("near").alias("pulled"))
        # A label is itself a node; following it halves the remaining way.
        follow = labels.select(F.col("node").alias("class"), F.col("class").alias("beyond"))
        moved = seen.join(pulled.join(follow, "class", "left"), "class")
        lower = F.least("class", "near", "pulled", "beyond")
        moved = saved(moved.select("node", lower.alias("class"), (lower != F.col("class")).alias("moved")))
        labels = moved.select("node", "class")
        if moved.where("moved").isEmpty():
            return labels


def merged_classes(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` (node, class) after further links ``more`` (a, b), which join few classes: only
    the graph of the classes is gone through again. A class is named by its smallest node, so the
    smallest class of a merged one is its smallest node."""

    def class_of(end: str) -> DataFrame:
        return found.select(F.col("node").alias(end), F.col("class").alias(f"class_{end}"))

    ends = more.join(class_of("a"), "a", "left").join(class_of("b"), "b", "left")
    ends = ends.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).where("a != b").distinct()
    roots = smallest_neighbours(ends).toDF("class", "root")
    new = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti")
    nodes = found.select("node", "class").union(new.select("node", F.col("node").alias("class")))
    return saved(nodes.join(roots, "class", "left").select("node", F.coalesce("root", "class").alias("class")))


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    depth: int = 10,
    recall: float = 0.999,
    block: int = 500,
    count_links: bool = True,
    seed: int = 3,
) -> DataFrame:
    """Per document: ``class_id``, ``n_links`` (other sets at the threshold or above), ``n_copies``
    (other documents with the same set), and the codes of its text, set and class."""
    spark = prepare(docs.sparkSession)
    cut = shortened(depth, trees, threshold, recall)
    rows = narrow(docs, id_col, text_col).select("doc_id", "text", order_id().alias("oid"), F.xxhash64("text").alias("text_code"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("oid", pa.int64()), ("text_code", pa.int64()), ("code", pa.int64())])
        for batch in slices(batches):
            yield emit(schema, *(batch.column(k) for k in (0, 2, 3)), set_codes(*shingles(batch.column(1), size)))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.list_(pa.int64())
        schema = pa.schema([("oid", pa.int64()), ("code", pa.int64()), ("full", keys), ("short", keys)])
        for batch in slices(batches):
            codes, first = shingles(batch.column(1), size)
            full, short = prefix_keys(codes, first, trees, depth, cut, seed)
            at = pa.array(np.arange(len(first)) * trees, pa.int32())
            lists = (pa.ListArray.from_arrays(at, pa.array(x.view(np.int64).ravel())) for x in (full, short))
            yield emit(schema, batch.column(2), set_codes(codes, first), *lists)

    codes = saved(rows.mapInArrow(coded, "doc_id long, oid long, text_code long, code long"))
    signatures = rows.mapInArrow(signed, "oid long, code long, full array<long>, short array<long>")
    # All rows of a set have the same signature.
    heads = saved(
        signatures.groupBy("code").agg(
            F.min("oid").alias("head"), F.count("*").alias("n"), F.first("full").alias("full"), F.first("short").alias("short")
        )
    )
    whole = heads.select("code", "head", "n")
    empty = int(set_codes(np.zeros(0, np.uint64), np.array([0, 0]))[0])

    def shared(held: DataFrame, key: str) -> DataFrame:
        """The rows of trie nodes that hold more than one text, with the first of the node."""
        several = held.groupBy(key).agg(F.min("code").alias("first"), F.count("*").alias("n")).where("n > 1").select(key, "first")
        return held.join(several, key)

    held = heads.where(F.col("code") != empty).select("code", F.inline(F.arrays_zip(F.col("short").alias("key"), F.col("full").alias("full"))))
    near = saved(shared(held.toDF("code", "key", "full"), "key").drop("first"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, oid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield emit(pa.schema([("prefix", pa.int64())]), key_of(code, oid).view(np.int64))

    wanted = saved(near.select("code").distinct().join(heads.select("code", "head"), "code").mapInArrow(slots, "prefix long"))
    sieve = spark.sparkContext.broadcast(bitmap(wanted, wanted.count()))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("code", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in slices(batches):
            codes, first = shingles(batch.column(1), size)
            code = set_codes(codes, first)
            kept = pa.array(np.flatnonzero(holds(sieve.value, key_of(code, batch.column(2).to_numpy()))))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(codes.view(np.int64)))
            yield emit(schema, pa.array(code).take(kept), lists.take(kept))

    sets = saved(rows.mapInArrow(sets_of, "code long, shingles array<long>").dropDuplicates(["code"]))

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("code").alias("a"), F.col("shingles").alias("of_a"))
        other = sets.select(F.col("code").alias("b"), F.col("shingles").alias("of_b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        small, large = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
        joined = pairs.distinct().join(one, "a").join(other, "b").where(enough(small, large, threshold))
        return joined.where(enough(both, F.size("of_a") + F.size("of_b") - both, threshold)).select("a", "b")

    links = saved(verified(shared(near, "full").where("code != first").select(F.col("first").alias("a"), F.col("code").alias("b"))))
    found = smallest_neighbours(links)
    placed = saved(near.join(found.withColumnRenamed("node", "code"), "code", "left").select("key", "code", F.coalesce("class", "code").alias("class")))
    mixed = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("key")
    more = saved(joined_classes(placed.join(mixed, "key"), sets, block, threshold))
    links, found = links.union(more), merged_classes(found, more)
    if count_links:
        counts = counted(found, sets, block, threshold)
    else:
        counts = links.select(F.explode(F.array("a", "b")).alias("code")).groupBy("code").agg(F.count("*").alias("n_links"))
    member = whole.join(found.withColumnRenamed("node", "code"), "code", "left").withColumn("class", F.coalesce("class", "code"))
    smallest = member.groupBy("class").agg(F.min("head").alias("class_id"))
    known = member.join(smallest, "class").join(counts, "code", "left")
    known = known.select("code", "class", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    return codes.join(known, "code").select(
        "doc_id", "oid", "text_code", "code", "class", F.when(F.col("class_id") != LAST_ID, F.col("class_id")).alias("class_id"), "n_links", "n_copies"
    )


def in_blocks(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """``members``: grp, code, class. Each pair of blocks of a group, with the sets of both, in
    one task and in consecutive rows: grp, low, high, own, code, class, shingles."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block)
    return (
        members.join(sizes, "grp")
        .withColumn("own", F.pmod(F.xxhash64("code"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .join(sets, "code")
        .select("grp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "code", "class", "shingles")
        .repartition("grp", "low", "high")
        .sortWithinPartitions("grp", "low", "high", "own", "code")
    )


def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict]]]:
    """The texts of either block of each pair (the same list twice for a block with itself)."""
    held: list[dict] = []
    key = None

    def sides() -> tuple[list[dict], list[dict]]:
        left = [r for r in held if r["own"] == r["low"]]
        return left, left if held[0]["low"] == held[0]["high"] else [r for r in held if r["own"] == r["high"]]

    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["grp"], row["low"], row["high"]):
                if held:
                    yield sides()
                held, key = [], (row["grp"], row["low"], row["high"])
            row["shingles"] = np.array(row["shingles"], np.int64)
            held.append(row)
    if held:
        yield sides()


def linked(left: list[dict], right: list[dict], threshold: float, most_cells: int = 1 << 22) -> np.ndarray:
    """Which texts of the one block are linked with which of the other, by whole sets."""
    common = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return common.astype(bool)
    every = np.unique(np.concatenate([r["shingles"] for r in left]))
    step = max(1, most_cells // max(len(left), len(right)))
    for k in range(0, len(every), step):
        part = every[k : k + step]
        grids = []
        for side in (left,) if left is right else (left, right):
            grid = np.zeros((len(side), len(part)), np.float32)
            for j, r in enumerate(side):
                at = np.searchsorted(part, r["shingles"])
                at[at == len(part)] = 0
                grid[j, at[part[at] == r["shingles"]]] = 1
            grids.append(grid)
        common += grids[0] @ grids[-1].T
    both = common.astype(np.int64)
    n_left, n_right = (np.array([len(r["shingles"]) for r in side]) for side in (left, right))
    found = enough(both, n_left[:, None] + n_right[None] - both, threshold)
    if left is right:
        np.fill_diagonal(found, False)
    return found


def joined_classes(placed: DataFrame, sets: DataFrame, block: int, threshold: float) -> DataFrame:
    """``placed``: key, code, class. Links (a, b) that join the classes below each node, no more
    of them than classes for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for left, right in block_pairs(batches):
            one, other = (np.array([r["class"] for r in side], np.int64) for side in (left, right))
            if len(set(one.tolist()) | set(other.tolist())) < 2:
                continue
            found = np.argwhere(linked(left, right, threshold) & (one[:, None] != other[None]))
            _, firsts = np.unique(np.stack([one[found[:, 0]], other[found[:, 1]]]), axis=1, return_index=True)
            root: dict[int, int] = {}
            ends: list[tuple[int, int]] = []
            for i, j in found[firsts].tolist():
                x, y = int(one[i]), int(other[j])
                while root.get(x, x) != x:
                    x = root[x]
                while root.get(y, y) != y:
                    y = root[y]
                if x != y:
                    root[x] = y
                    ends.append(tuple(sorted((left[i]["code"], right[j]["code"]))))
            yield emit(schema, *(zip(*ends, strict=True) if ends else ([], [])))

    members = placed.select(F.col("key").alias("grp"), "code", "class")
    return in_blocks(members, sets, block).mapInArrow(run, "a long, b long")


def counted(found: DataFrame, sets: DataFrame, block: int, threshold: float) -> DataFrame:
    """``code``, ``n_links``: other sets of the class at the threshold or above, without listing pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])
        for left, right in block_pairs(batches):
            hits = linked(left, right, threshold)
            yield emit(schema, [r["code"] for r in left], hits.sum(1))
            if left is not right:
                yield emit(schema, [r["code"] for r in right], hits.sum(0))

    members = found.select(F.col("class").alias("grp"), F.col("node").alias("code"), "class")
    return in_blocks(members, sets, block).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n_links"))


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that are the first of their class: smallest id, then set, then text."""
    prepare(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = classes(docs, id_col, text_col, count_links=False)
    heads = found.groupBy("class").agg(F.min(F.struct("oid", "code", "text_code")).alias("head"))
    keep = heads.select("head.oid", "head.text_code")
    rows = docs.select(F.struct("*").alias("row"), order_id(docs[id_col].cast("long")).alias("oid"), F.xxhash64(text).alias("text_code"))
    return rows.join(keep, ["oid", "text_code"], "left_semi").dropDuplicates(["oid", "text_code"]).select("row.*")


def brute_force(docs: list[tuple], size: int = 5, threshold: float = 0.8) -> dict:
    """For tests: (class id, links to other sets, copies) by comparing all pairs."""
    sets = {}
    for doc_id, text in docs:
        ws = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        sets[doc_id] = frozenset(tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))) if ws else frozenset()
    kinds: dict[frozenset, list] = {}
    for doc_id, found in sets.items():
        kinds.setdefault(found, []).append(doc_id)
    every, links = list(kinds), {}
    root = {k: k for k in every}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(every):
        for b in every[:i]:
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) - 1e-9 and enough(len(a & b), len(a | b), threshold):
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                root[top(a)] = top(b)
    smallest: dict[frozenset, int] = {}
    for k in every:
        smallest[top(k)] = min(smallest.get(top(k), LAST_ID), *kinds[k])
    return {d: (smallest[top(k)], links.get(k, 0), len(ds) - 1) for k, ds in kinds.items() for d in ds}
