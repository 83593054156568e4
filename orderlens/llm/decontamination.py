"""Benchmark decontamination: one Aho-Corasick automaton scans each text once.

Texts and items are normalised alike: A-Z lowered, words of digits, a-z and all bytes above
ASCII. The patterns are the windows of ``width`` consecutive item words (an item with fewer words
is one window), each word written as two signs, so that a word is two nodes of the automaton
whatever its length. A match is mapped back from word numbers to code-point offsets of the original text.

Spark cuts the benchmark into blocks of at most ``block_windows`` windows and writes each to the
shared folder; the driver sees their names only. A scanning task builds the automaton of a block
once. Up to ``CHAINED`` blocks are scanned in one stage, each by a worker of its own, and what
they found is written before the next ones, so memory is bounded for benchmarks of any size and
nothing is shuffled.

Defined cases: a null or empty text has no words and no hits; a null or empty item matches
nothing; items that share an id count once; a null item id is written as an empty string;
repeated documents are judged row by row; extra columns are not read; without documents or
benchmark the result is empty or free of hits.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import emit, narrow, place, prepare, saved, slices
from orderlens.operators.ordering import running_before
from orderlens.session import staging_dir

# Windows of one automaton (twenty nodes each at most), and automata alive in one task's workers.
BLOCK_WINDOWS = 200_000
CHAINED = 3

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lowering
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

HITS = "doc_id long, text string, n_words long, covered array<long>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def normalised(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


@dataclass
class Patterns:
    """The block's words as two signs each, and the automaton over these."""

    signs: dict[bytes, str]
    found: ahocorasick.Automaton


OTHER = chr(0) * 2  # a word that no window holds


def automaton(items: list[tuple[str, str]], width: int) -> Patterns | None:
    """A word's number is written with two signs of an alphabet of about its root: one sign would
    make nodes whose many branches are searched one by one, more signs more nodes."""
    texts = [(item_id, normalised(text)) for item_id, text in items]
    known = sorted({w for _, words in texts for w in words})
    alphabet = max(1, math.isqrt(len(known)) + 1)
    signs = {w: chr(1 + k // alphabet) + chr(1 + k % alphabet) for k, w in enumerate(known)}
    owners: dict[str, set[str]] = {}
    for item_id, words in texts:
        for k in range(max(1, len(words) - width + 1) if words else 0):
            owners.setdefault("".join([signs[w] for w in words[k : k + width]]), set()).add(item_id)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    while owners:
        window, ids = owners.popitem()
        found.add_word(window, (len(window) // 2, tuple(sorted(ids))))
    found.make_automaton()
    return Patterns(signs, found)


def scan(words: list[bytes], patterns: Patterns) -> tuple[list[int], set[str]]:
    """First and last word + 1 of each covered run, and the items that occur."""
    sign = patterns.signs.get
    items: set[str] = set()
    runs = []
    for end, (size, ids) in patterns.found.iter("".join([sign(w, OTHER) for w in words])):
        if end % 2:  # else between two words
            items.update(ids)
            runs.append((end // 2 + 1 - size, end // 2 + 1))
    covered: list[int] = []
    for first, last in sorted(runs):
        if covered and first <= covered[-1]:
            covered[-1] = max(covered[-1], last)
        else:
            covered += [first, last]
    return covered, items


def merged(one: list[int], other: list[int]) -> list[int]:
    out: list[int] = []
    for first, last in sorted([*zip(one[::2], one[1::2], strict=True), *zip(other[::2], other[1::2], strict=True)]):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


def staged_blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_windows: int) -> list[str]:
    """Files of the benchmark's blocks in the shared folder."""
    folder = f"{staging_dir(benchmark.sparkSession)}/benchmark-{uuid.uuid4().hex}"
    rows = benchmark.select(
        F.coalesce(benchmark[id_col].cast("string"), F.lit("")), F.coalesce(benchmark[text_col].cast("string"), F.lit(""))
    )
    most = max(1, block_windows // 4)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items as normalised words, very long ones in pieces that share ``width`` - 1 words."""
        schema = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("windows", pa.int64())])
        for batch in batches:
            made = []
            for item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = normalised(text)
                n = max(1, len(words) - width + 1) if words else 0
                for k in range(0, n, most):
                    part = words[k : k + most + width - 1]
                    made.append((item_id, b" ".join(part).decode(), min(most, n - k)))
            if made:
                yield emit(schema, *zip(*made, strict=True))

    def write(block: pa.Table) -> pa.Table:
        files, path = place(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        with files.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, block.schema) as writer:
            writer.write_table(block)
        return pa.table({"file": [f"{folder}/{name}"]})

    cut = rows.mapInArrow(pieces, "item_id string, words string, windows long").dropDuplicates()
    placed = running_before(cut, [F.col("item_id").asc(), F.col("words").asc()], {"before": "windows"})
    block = F.floor(F.col("before") / block_windows).alias("block")
    written = placed.select("item_id", "words", block).groupBy("block").applyInArrow(write, "file string")
    return [r.file for r in written.collect()]


def loaded(file: str, width: int) -> Patterns | None:
    files, path = place(file)
    with files.open_input_file(path) as source:
        block = pa.ipc.open_file(source).read_all()
    return automaton([*zip(block.column("item_id").to_pylist(), block.column("words").to_pylist(), strict=True)], width)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Per document: words, hit words, the items that occur, and the hit spans of its text."""
    prepare(docs.sparkSession)
    hits = narrow(docs, id_col, text_col).select(
        "*", F.lit(-1).cast("long").alias("n_words"), F.array().cast("array<long>").alias("covered"), F.array().cast("array<string>").alias("items")
    )

    def scanner(file: str | None, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = loaded(file, width) if file else None
            for batch in slices(batches):
                texts = batch.column(1).to_pylist()
                counts, covers, found = [], [], []
                for text, covered, items in zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    words = normalised(text)
                    more, ids = scan(words, patterns) if patterns and words else ([], set())
                    counts.append(len(words))
                    covers.append(merged(covered, more) if more else covered)
                    found.append(sorted(ids.union(items)))
                if last:
                    spans, n_hit = [], []
                    for text, covered in zip(texts, covers, strict=True):
                        at = [m.span() for m in WORD.finditer(text)] if covered else []
                        runs = [*zip(covered[::2], covered[1::2], strict=True)]
                        spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs])
                        n_hit.append(sum(b - a for a, b in runs))
                    yield emit(schema_of(RESULT), batch.column(0), counts, n_hit, found, spans)
                else:
                    yield emit(schema_of(HITS), batch.column(0), batch.column(1), counts, covers, found)

        return run

    # Without a block, words are still counted.
    files = staged_blocks(benchmark, item_col, item_text_col, width, block_windows) or [None]
    for k, file in enumerate(files, 1):
        last = k == len(files)
        hits = hits.mapInArrow(scanner(file, last), RESULT if last else HITS)
        if k % CHAINED == 0 and not last:
            hits = saved(hits)
    return hits


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The rows, all columns, in whose text no window of the benchmark occurs."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def scanner(file: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = loaded(file, width)
            for batch in batches:
                if patterns and batch.num_rows:
                    texts = batch.column(at).cast(pa.string()).to_pylist()
                    batch = batch.filter(pa.array([not (t and scan(normalised(t), patterns)[0]) for t in texts]))
                yield batch

        return run

    for k, file in enumerate(staged_blocks(benchmark, item_col, item_text_col, width, block_windows), 1):
        docs = docs.mapInArrow(scanner(file), docs.schema)
        if k % CHAINED == 0:
            docs = saved(docs)
    return docs


def schema_of(ddl: str) -> pa.Schema:
    longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": longs, "array<string>": strings}
    return pa.schema([(c.split(" ")[0], kinds.get(c.split(" ")[1], span)) for c in ddl.split(", ")])


def digest(found: DataFrame) -> DataFrame:
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], width: int = 10) -> dict:
    """Plain comparison of every window with every position, for tests."""
    out = {}
    for doc_id, text in docs:
        words = normalised(text or "")
        hit, ids = set(), set()
        for item_id, item in items:
            own = normalised(item or "")
            size = min(width, len(own))
            for k in range(len(own) - size + 1) if own else ():
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == own[k : k + size]:
                        hit.update(range(at, at + size))
                        ids.add("" if item_id is None else str(item_id))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(ids), sha, bool(hit))
    return out
