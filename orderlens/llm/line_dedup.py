"""Line deduplication by winnowing over line hashes.

Every line that holds a word gets a 64-bit code of its bytes. Of each window of ``size``
neighbouring lines (the larger of ``window`` and ``min_lines``) the line with the least code is
selected; neighbouring windows mostly select the same one. A selected line is marked once for
each window that selected it, by the code of that window: a mark by the line alone would join a
later place with the line's first place anywhere, and a frequent line would hide the run that is
repeated. Equal windows select the same line, so a later place of a mark (joined with its first
place: smallest document, then position; a partial aggregate, linear pairs) lines up with it, and
every repeated window is found. From there the match is extended both ways over the two line
lists while lines are equal, and the later run is deleted.

Lists move as blocks of ``BLOCK`` lines, so that a pair of places costs the same in documents of
any length; a match goes on in the next block from the marks there. Extension stops at lines
that are already deleted, which keeps it linear where a document repeats itself.

A run of fewer lines, down to one, has a mark of its own and goes likewise if it holds
``min_words`` words (between blanks) or more.

Documents are ordered by id (null last), then by the code of their text. Defined cases: rows
with equal id and text are one document and lose the same lines; a null text stays null; a
text whose every line with a word is deleted becomes empty; lines without a word are neither
compared nor deleted; all other columns, whatever their names, are kept; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import emit, order_id, prepare, saved, slices, text_bytes
from orderlens.llm.words import BLANKS, span_codes, spans, starts_with_room, window_codes

# A repeat of fewer than ``min_lines`` lines goes from so many words on.
MIN_WORDS = 50

NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

LINES = "oid long, code long, lines array<long>, words array<int>, numbers array<int>, n_all int"
LINES_ARROW = pa.schema(
    [
        ("oid", pa.int64()),
        ("code", pa.int64()),
        ("lines", pa.list_(pa.int64())),
        ("words", pa.list_(pa.int32())),
        ("numbers", pa.list_(pa.int32())),
        ("n_all", pa.int32()),
    ]
)
# Lines that move together, and the marks of one selected line.
BLOCK = 64
MARKS = "oid long, code long, print long, pos int, start int, size int"
MARKS_ARROW = pa.schema(
    [("oid", pa.int64()), ("code", pa.int64()), ("print", pa.int64()), ("pos", pa.int32()), ("start", pa.int32()), ("size", pa.int32())]
)
RUNS_ARROW = pa.schema([("oid", pa.int64()), ("code", pa.int64()), ("gone", pa.list_(pa.int32()))])


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and number within its text of each line with a word, and where each text's begin."""
    starts, ends = spans(data, offsets, NEWLINE)
    solid = np.r_[0, np.cumsum(~BLANKS[data])]
    held = solid[ends] > solid[starts]
    starts, ends = starts[held], ends[held]
    breaks = np.r_[0, np.cumsum(NEWLINE[data])]
    first = np.searchsorted(starts, offsets)
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return starts, ends, breaks[starts] - breaks[offsets[texts]], first


def line_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and number within its text of each line with a word, and where each text's begin."""
    starts, ends, numbers, first = line_spans(data, offsets)
    return span_codes(data, starts, ends).view(np.int64), numbers, first


def read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches_with_text_second(batches)):
        data, offsets = text_bytes(batch.column(1))
        starts, ends, numbers, first = line_spans(data, offsets)
        words, _ = spans(data, offsets)
        breaks = np.r_[0, np.cumsum(NEWLINE[data])]
        at = pa.array(first, pa.int32())
        yield emit(
            LINES_ARROW,
            batch.column(0),
            batch.column(2),
            pa.ListArray.from_arrays(at, pa.array(span_codes(data, starts, ends).view(np.int64))),
            pa.ListArray.from_arrays(at, pa.array(np.searchsorted(words, ends) - np.searchsorted(words, starts), pa.int32())),
            pa.ListArray.from_arrays(at, pa.array(numbers, pa.int32())),
            breaks[offsets[1:]] - breaks[offsets[:-1]] + 1,
        )


def batches_with_text_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from (b.select(["oid", "text", "code"]) for b in batches)


def winnow(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The selected line of each window of ``size`` lines: the least code, of equals the first."""
    if not len(starts):
        return starts
    return starts + np.lib.stride_tricks.sliding_window_view(codes, size)[starts].argmin(axis=1)


def fingerprints(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """The marks of selected lines, and of shorter runs with ``min_words`` words."""
    for batch in batches:
        codes = batch.column(2).flatten().to_numpy().view(np.uint64)
        first = np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy())]
        words = np.r_[0, np.cumsum(batch.column(3).flatten().to_numpy(), dtype=np.int64)]
        for n in range(1, size + 1):
            prints = window_codes(codes, n)
            fits = starts_with_room(first, len(prints), n)
            if n < size:
                fits &= words[n:] - words[:-n] >= min_words
            at = np.flatnonzero(fits)
            owner = np.searchsorted(first, at, "right") - 1
            rows = pa.array(owner)
            ids = batch.column(0).take(rows), batch.column(1).take(rows)
            yield emit(
                MARKS_ARROW, *ids, prints[at].view(np.int64), winnow(codes, at, n) - first[owner], at - first[owner], np.full(len(at), n)
            )


def extend(later: list[int], first: list[int], seeds: list[tuple[int, int, int, int]], later_at: int, first_at: int) -> set[int]:
    """Places in the later document that go. ``seeds`` are (selected line, its place in the first
    document, start and size of its window); the lists are the blocks that hold the two lines."""
    gone: set[int] = set()
    for pos, other, start, size in sorted(seeds):
        own = set(range(start, start + size))
        if own <= gone:
            continue
        gone |= own
        a, b = pos - later_at, other - first_at
        for step in (-1, 1):
            k = step
            while 0 <= a + k < len(later) and 0 <= b + k < len(first) and later[a + k] == first[b + k]:
                place = pos + k
                if place in gone and place not in own:
                    break
                gone.add(place)
                k += step
    return gone


def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            seeds = [(s["pos"], s["first_pos"], s["start"], s["size"]) for s in row["seeds"]]
            gone = extend(row["lines"], row["first_lines"], seeds, row["block"] * BLOCK, row["first_block"] * BLOCK)
            found.append((row["oid"], row["code"], sorted(gone)))
        if found:
            yield emit(RUNS_ARROW, *zip(*found, strict=True))


def deletions(docs: DataFrame, window: int = 2, min_lines: int = 2, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``: oid, code, text. Per document with repeated runs: a flag for each of its lines."""
    size = max(window, min_lines)
    lines = saved(docs.mapInArrow(read_lines, LINES).dropDuplicates(["oid", "code"]))
    marks = lines.select("oid", "code", "lines", "words").mapInArrow(lambda it: fingerprints(it, size, min_words), MARKS)
    firsts = (
        marks.groupBy("print")
        .agg(F.min(F.struct("oid", "code", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("print", "first")
    )

    def block(place: str) -> Column:
        return F.floor(F.col(place) / BLOCK).cast("int")

    pairs = (
        marks.join(firsts, "print")
        .where(F.struct("oid", "code", "pos") != F.col("first"))
        .select("oid", "code", "pos", "start", "size", F.col("first.oid").alias("first_oid"), F.col("first.code").alias("first_code"), F.col("first.pos").alias("first_pos"))
        .groupBy("oid", "code", block("pos").alias("block"), "first_oid", "first_code", block("first_pos").alias("first_block"))
        .agg(F.collect_list(F.struct("pos", "first_pos", "start", "size")).alias("seeds"))
    )
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / BLOCK).cast("int")), lambda k: F.slice("lines", k * BLOCK + 1, BLOCK))
    blocks = lines.where(F.size("lines") > 0).select("oid", "code", F.posexplode(parts).alias("block", "lines"))
    known = blocks.withColumnsRenamed({c: f"first_{c}" for c in blocks.columns})
    matched = pairs.join(blocks, ["oid", "code", "block"]).join(known, ["first_oid", "first_code", "first_block"])
    runs = matched.select("oid", "code", "block", "first_block", "seeds", "lines", "first_lines").mapInArrow(extended, "oid long, code long, gone array<int>")
    repeats = runs.groupBy("oid", "code").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("oid", pa.int64()), ("code", pa.int64()), ("flags", pa.list_(pa.bool_())), ("n_removed", pa.int64()), ("emptied", pa.bool_())]
        )
        for batch in batches:
            marked, counts, whole = [], [], []
            for gone, numbers, n_all in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                row = np.zeros(n_all, bool)
                row[np.array(numbers)[gone]] = True
                marked.append(row)
                counts.append(len(gone))
                whole.append(len(gone) == len(numbers))
            yield emit(schema, batch.column(0), batch.column(1), marked, counts, whole)

    return repeats.join(lines.select("oid", "code", "numbers", "n_all"), ["oid", "code"]).mapInArrow(
        flags, "oid long, code long, flags array<boolean>, n_removed long, emptied boolean"
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, min_lines: int = 2, min_words: int = MIN_WORDS
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``clean`` (its text without later repeated runs) and ``n_removed``."""
    prepare(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(
        F.struct("*").alias("row"),
        order_id(docs[id_col].cast("long")).alias("oid"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("code"),
        text.alias("text"),
    )
    gone = deletions(rows.where("text is not null").select("oid", "code", "text"), window, min_lines, min_words)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, k: ~F.get(F.col("flags"), k)), "\n")
    return rows.join(gone, ["oid", "code"], "left").select(
        "row",
        F.when(F.col("flags").isNull() | F.col("text").isNull(), F.col("text")).when(F.col("emptied"), "").otherwise(kept).alias("clean"),
        F.when(F.col("text").isNull(), 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same columns, the text without later repeated runs and its length brought up to date."""
    done = dedup_lines(docs, id_col, text_col)
    new = {text_col: F.col("clean")}
    if length_col in docs.columns:
        new[length_col] = F.length("clean").cast(docs.schema[length_col].dataType)
    return done.select([new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def brute_force(docs: list[tuple], window: int = 2, min_lines: int = 2, min_words: int = MIN_WORDS) -> dict[tuple, set[int]]:
    """For tests: by (id, text), the numbers of the lines that go. ``docs`` are (id, code, text).

    Compares each line with every equal line before it, whatever stands around it there, and
    extends the match both ways.
    """
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    own = {(oid, code): [(k, x) for k, x in enumerate(text.split("\n")) if x.strip(blank)] for oid, code, text in docs}
    places: dict[str, list] = {}
    gone: dict[tuple, set[int]] = {}
    for b_key in sorted(own):
        x = own[b_key]
        for b, (_, line) in enumerate(x):
            before = places.setdefault(line, [])
            for a_key, a in before:
                y = own[a_key]
                low, high = 0, 1
                while b - low > 0 and a - low > 0 and x[b - low - 1][1] == y[a - low - 1][1]:
                    low += 1
                while b + high < len(x) and a + high < len(y) and x[b + high][1] == y[a + high][1]:
                    high += 1
                n_words = sum(len(line.encode().split()) for _, line in x[b - low : b + high])
                if low + high >= max(window, min_lines) or n_words >= min_words:
                    gone.setdefault(b_key, set()).update(x[k][0] for k in range(b - low, b + high))
            before.append((b_key, b))
    return gone
