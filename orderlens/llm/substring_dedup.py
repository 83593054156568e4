"""Repeated word windows by prefix-partitioned suffix trees, truncated at the window's depth.

Only suffixes that can lie below a deep internal node are put into trees. Of each window of
``width`` words the smallest code among its ``seed``-word pieces (the rightmost of equals) is
its prefix: equal windows choose the same prefix, so all leaves of a deep node share one.

1. Prefixes are counted. Those of one text only that do not recur in it are dropped (a bitmap
   of the others, at most 2**30 bits, filters the next scan; what it lets through by chance
   ends as a leaf without sister).
2. A prefix is a subtree. Its suffixes come to one task in text order, several subtrees at a
   time; a node at depth ``width`` is addressed by the code of its path. The nodes with two
   or more leaves are the repeats, their first leaf is the earliest place, the other leaves
   are marked, and neighbouring marks join to maximal repeats.
3. A prefix with more suffixes than a task should hold (``LEAST_HEAVY``, and more than 1/100,000
   of all suffixes, so there are fewer than 100,000 such prefixes) is not gathered: it is
   lengthened to the whole window, where only the first leaf is wanted, a partial aggregate.
4. Texts equal to one of a smaller id need no tree: all their windows start earlier there.

Documents are ordered by id (null last), then by the code of their text; codes have 64 bits.
Defined cases: a null or empty text has no words; rows with equal id and text are one document
and keep the same words; rows with equal id and other texts are different documents; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import emit, narrow, order_id, prepare, saved, slices, text_bytes
from orderlens.llm.words import spans, starts_with_room, window_codes, words

HEAVY_SHARE = 100_000
CHUNK_ROWS = 100_000  # runs of suffixes, some 10 MB
LEAST_HEAVY = CHUNK_ROWS
MOST_BITS = 30


def prefixes(codes: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one prefix: prefix code, text, first start, how many."""
    n = len(codes) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none, none, none
    seeds = window_codes(codes, seed)
    choices = width - seed + 1
    least = seeds[:n].copy()
    at = np.arange(n)
    for k in range(1, choices):
        now = seeds[k : k + n]
        better = now <= least
        least[better] = now[better]
        at[better] = np.flatnonzero(better) + k
    room = starts_with_room(first, n, width)
    starts = np.flatnonzero(room)
    if not len(starts):
        return none.view(np.uint64), none, none, none
    owner = np.searchsorted(first, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.r_[heads, len(starts)])
    return seeds[at[starts[heads]]], owner[heads], starts[heads], counts


def counted(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("prefix", pa.int64()), ("code", pa.int64()), ("n", pa.int32())])
    for batch in slices(batches):
        found = words(*text_bytes(batch.column(1)))
        prefix, owner, _, _ = prefixes(found.codes, found.first, width, seed)
        order = np.lexsort((prefix, owner))
        prefix, owner = prefix[order], owner[order]
        new = np.ones(len(prefix), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        yield emit(
            schema, prefix[heads].view(np.int64), batch.column(2).take(pa.array(owner[heads])), np.diff(np.r_[heads, len(prefix)])
        )


def holds(bits: tuple[int, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Whether the bit of each code's highest ``power`` bits is set."""
    power, packed = bits
    slot = codes >> np.uint64(64 - power)
    return ((packed[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def bitmap(repeated: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """One bit for each value that the highest bits of a prefix can take."""
    power = min(MOST_BITS, max(15, (10 * n).bit_length()))
    slot = F.shiftrightunsigned("prefix", 64 - power)
    rows = (
        repeated.groupBy(F.shiftright(slot, 15).alias("bucket"))
        .agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
        .toLocalIterator()
    )
    packed = np.zeros(1 << (power - 3), np.uint8)
    for r in rows:
        packed[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return power, packed


def marked_leaves(paths: np.ndarray, oid: np.ndarray, code: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Leaves, in text order, of nodes that have an earlier leaf."""
    order = np.argsort(paths, kind="stable")
    sorted_paths = paths[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_paths[1:] != sorted_paths[:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.zeros(len(order), bool)
    out[order] = (oid[order] != oid[head]) | (code[order] != code[head]) | (start[order] != start[head])
    return out


def repeats(docs: DataFrame, width: int = 20, seed: int = 8) -> DataFrame:
    """``docs``: oid, text, code. Per document with repeats: ``runs``, starts of marked windows as (first, last)."""
    spark = docs.sparkSession
    repeated = saved(
        docs.mapInArrow(lambda it: counted(it, width, seed), "prefix long, code long, n int")
        .groupBy("prefix")
        .agg(F.min("code").alias("low"), F.max("code").alias("high"), F.max("n").alias("own"), F.sum("n").alias("n"))
        .where("low != high or own > 1")
        .select("prefix", "n")
    )
    total = repeated.agg(F.count("*").alias("prefixes"), F.coalesce(F.sum("n"), F.lit(0)).alias("suffixes")).first()
    sieve = spark.sparkContext.broadcast(bitmap(repeated, total["prefixes"]))
    limit = max(LEAST_HEAVY, total["suffixes"] // HEAVY_SHARE)
    heavy = spark.sparkContext.broadcast(
        np.sort(np.array([r["prefix"] for r in repeated.where(F.col("n") > limit).select("prefix").collect()], np.int64).view(np.uint64))
    )

    def suffixes(batches: Iterator[pa.RecordBatch], of_heavy: bool):
        """Prefix, document, first start and path codes of each run of windows that is asked for."""
        for batch in slices(batches):
            found = words(*text_bytes(batch.column(1)))
            prefix, owner, start, n = prefixes(found.codes, found.first, width, seed)
            is_heavy = np.isin(prefix, heavy.value)
            chosen = np.flatnonzero(is_heavy if of_heavy else holds(sieve.value, prefix) & ~is_heavy)
            paths = window_codes(found.codes, width).view(np.int64)
            prefix, owner, start, n = prefix[chosen], owner[chosen], start[chosen], n[chosen]
            ends = np.r_[0, np.cumsum(n)]
            flat = paths[np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)]
            rows = pa.array(owner)
            yield prefix.view(np.int64), batch.column(0).take(rows), batch.column(2).take(rows), start - found.first[owner], n, ends, flat

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("prefix", pa.int64()), ("oid", pa.int64()), ("code", pa.int64()), ("start", pa.int32()), ("paths", pa.list_(pa.int64()))]
        )
        for prefix, oid, code, start, _, ends, flat in suffixes(batches, False):
            yield emit(schema, prefix, oid, code, start, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.int64()), ("oid", pa.int64()), ("code", pa.int64()), ("start", pa.int32())])
        for _, oid, code, start, n, ends, flat in suffixes(batches, True):
            row = pa.array(np.repeat(np.arange(len(n)), n))
            each = np.repeat(start - ends[:-1], n) + np.arange(ends[-1])
            yield emit(schema, flat, oid.take(row), code.take(row), each)

    marks = pa.schema([("oid", pa.int64()), ("code", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def subtrees(rows: pa.Table) -> pa.RecordBatch:
        lists = rows.column("paths").combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        ends = np.r_[0, np.cumsum(n)]
        row = np.repeat(np.arange(len(n)), n)
        oid, code, start = (rows.column(c).to_numpy() for c in ("oid", "code", "start"))
        each = np.repeat(start - ends[:-1], n) + np.arange(ends[-1])
        hit = np.flatnonzero(marked_leaves(lists.flatten().to_numpy(), oid[row], code[row], each))
        if not len(hit):
            return emit(marks, [], [], [], [])
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
        heads = np.flatnonzero(new)
        lasts = np.r_[heads[1:], len(hit)] - 1
        return emit(marks, oid[row[hit[heads]]], code[row[hit[heads]]], each[hit[heads]], each[hit[lasts]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole subtrees, about ``CHUNK_ROWS`` suffix runs at a time."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                rows = pa.Table.from_batches(held)
                prefix = rows.column("prefix").to_numpy()
                cut = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if prefix[0] != prefix[-1] else 0
                if cut:
                    yield subtrees(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    n = rows.num_rows - cut
        if n:
            yield subtrees(pa.Table.from_batches(held))

    kind = "oid long, code long, first int, last int"
    in_trees = (
        docs.mapInArrow(light, "prefix long, oid long, code long, start int, paths array<long>")
        .repartition("prefix")
        .sortWithinPartitions("prefix", "oid", "code", "start")
        .mapInArrow(build, kind)
    )
    at = F.struct("oid", "code", "start")
    deep = docs.mapInArrow(leaves, "path long, oid long, code long, start int")
    firsts = deep.groupBy("path").agg(F.min(at).alias("head"), F.count("*").alias("n")).where("n > 1").select("path", "head")
    by_path = deep.join(firsts, "path").where(at != F.col("head")).select("oid", "code", F.col("start").alias("first"), F.col("start").alias("last"))
    return in_trees.unionByName(by_path).groupBy("oid", "code").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def removed(found_starts: np.ndarray, runs: list[dict], n: int, width: int) -> np.ndarray:
    """Which of ``n`` words the marked windows cover."""
    steps = np.zeros(n + 1, np.int64)
    for r in runs:
        steps[r["first"]] += 1
        steps[r["last"] + width] -= 1
    return np.cumsum(steps[:n]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, seed: int = 8) -> DataFrame:
    """Per document: words, removed words, and the kept words joined by one blank."""
    prepare(docs.sparkSession)
    rows = narrow(docs, id_col, text_col).select("doc_id", order_id().alias("oid"), F.xxhash64("text").alias("code"), "text")
    texts = rows.select("oid", "text", "code")
    copies = rows.select("oid", "code")
    earliest = copies.groupBy("code").agg(F.min("oid").alias("head"), F.max("oid").alias("tail")).where("head != tail").select("code", "head")
    later = copies.join(earliest, "code").where("oid != head").select("oid", "code").distinct().withColumn("copied", F.lit(True))
    marks = repeats(texts, width, seed).join(later, ["oid", "code"], "full").select("oid", "code", "runs", "copied")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            starts, ends = spans(data, offsets)
            first = np.searchsorted(starts, offsets)
            raw = data.tobytes()
            counts, gone, kept = np.diff(first), [], []
            for k, (runs, copied) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
                n = len(a)
                out = np.full(n, n >= width) if copied else removed(a, runs or [], n, width)
                gone.append(int(out.sum()))
                if not gone[-1]:
                    parts = raw[offsets[k] : offsets[k + 1]].split()
                else:
                    left = np.flatnonzero(~out)
                    parts = [raw[x:y] for x, y in zip(a[left].tolist(), b[left].tolist(), strict=True)]
                kept.append(b" ".join(parts).decode())
            yield emit(schema, batch.column(0), counts, gone, kept)

    return (
        rows.join(marks, ["oid", "code"], "left")
        .select("doc_id", "text", "runs", "copied")
        .mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")
    )


def brute_force(docs: list[tuple], width: int = 20) -> dict:
    """For tests: (id, text) to (words, removed words, digest)."""
    split = {i: [w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w] for i, t in docs}
    seen, out = set(), {}
    for i in sorted(split):
        ws = split[i]
        cover = set()
        for k in range(len(ws) - width + 1):
            window = tuple(ws[k : k + width])
            if window in seen:
                cover.update(range(k, k + width))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(ws) if k not in cover)
        out[i] = (len(ws), len(cover), hashlib.sha256(kept.encode()).hexdigest())
    return out
