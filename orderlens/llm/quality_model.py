"""Quality classifier: random Fourier features of document statistics, ridge regression from
partition-summed normal equations, isotonic calibration.

The statistics are standardised with the training rows' mean and deviation. Folds by crc32 of
the id keep the held-out rows out of every fit; of the rest one fold calibrates, the others
fit the ridge weights. All labelled rows of these folds are used. Labels are the only thing
learnt from; language, source and id are no inputs.

Defined cases: a null or empty text has statistics of 0 and gets a score; labels that share an
id are averaged, null labels are ignored; repeated rows are scored one by one; a null id stays
null and counts as empty text for its fold; extra columns are not read; without labels every
score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.calibration import fold, isotonic, partition_sums
from orderlens.llm.line_dedup import line_codes
from orderlens.llm.shared import emit, narrow, prepare, saved, slices, text_bytes
from orderlens.llm.words import BLANKS, starts_with_room, window_codes, words

FEATURES = (
    "words", "chars", "word_length", "word_spread", "symbols", "digits", "upper", "marks", "beyond_ascii", "lines",
    "equal_lines", "distinct", "stutter", "pairs_again", "windows_again", "words_per_line", "closed_lines", "plain_words",
)


def _kind(letters: bytes) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(letters)] = True
    return held


SYMBOLS, DIGITS = _kind(b"#*$%&|<>"), _kind(b"0123456789")
UPPER, MARKS, CLOSING = _kind(bytes(range(65, 91))), _kind(b".,;:!?\"'()-"), _kind(b".!?")
LETTERS = _kind(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def distinct(owners: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each owner has."""
    order = np.lexsort((codes, owners))
    owners, codes = owners[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (codes[1:] != codes[:-1])
    return np.bincount(owners[new], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, offsets = text_bytes(texts)
    n, found = len(texts), words(data, offsets)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    count, owner = found.counts.astype(float), found.texts
    some = np.maximum(count, 1)
    chars = per_text((data & 0xC0) != 0x80)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    length = (lead[found.ends] - lead[found.starts]).astype(float)
    mean = np.bincount(owner, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
    line_code, _, line_first = line_codes(data, offsets)
    line_count = np.diff(line_first).astype(float)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))
    same = np.zeros(len(owner))
    same[1:] = (found.codes[1:] == found.codes[:-1]) & (owner[1:] == owner[:-1])

    def again(width: int) -> np.ndarray:
        codes = window_codes(found.codes, width)
        inside = starts_with_room(found.first, len(codes), width)
        codes, own = codes[inside], owner[: len(codes)][inside]
        total = np.bincount(own, minlength=n)
        return (total - distinct(own, codes, n)) / np.maximum(total, 1)

    sums = np.r_[0, np.cumsum(LETTERS[data])]
    lettered = sums[found.ends] > sums[found.starts]
    closed = CLOSING[data[found.ends - 1]].astype(float) if len(found.ends) else np.zeros(0)
    columns = [
        np.log1p(count), np.log1p(chars), mean, spread, per_text(SYMBOLS[data]) / some, per_text(DIGITS[data]) / some,
        per_text(UPPER[data]) / some, per_text(MARKS[data]) / some, per_text(data >= 0xC0) / some, line_count / some,
        1 - distinct(line_owner, line_code, n) / np.maximum(line_count, 1), distinct(owner, found.codes, n) / some,
        np.bincount(owner, same, n) / some, again(2), again(8), np.log1p(count / np.maximum(line_count, 1)),
        np.bincount(owner, closed, n) / some, np.bincount(owner, lettered, n) / some,
    ]
    return np.stack(columns, axis=1)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.binary())])
        for batch in slices(batches):
            rows = statistics(batch.column(1)).astype(np.float32)
            yield emit(schema, batch.column(0), [r.tobytes() for r in rows])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, stats binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), len(FEATURES)).astype(float)


class Kernel:
    """Cosines at random frequencies, whose inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int, gamma: float, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.frequencies = random.normal(0, np.sqrt(2 * gamma), (len(mean), size))
        self.phases = random.uniform(0, 2 * np.pi, size)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.deviation, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.frequencies + self.phases)
        return np.hstack([waves, np.ones((len(rows), 1))])


def scores(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_fold: int = 0,
    size: int = 192,
    gamma: float = 0.04,
    ridge: float = 1e-2,
    threshold: float = 0.3,
    seed: int = 11,
) -> DataFrame:
    """Per document: whether it was held out, its calibrated score and the decision."""
    prepare(docs.sparkSession)
    stats = saved(measured(docs, id_col, text_col))
    known = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("label"))
        .where("label is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.avg("label").alias("label"))
    )
    part = fold("doc_id", folds)
    train = saved(stats.join(known, "doc_id").where(part != held_fold).withColumn("fold", part))
    calibrates = F.col("fold") == (held_fold + 1) % folds
    if train.where(~calibrates).isEmpty() or train.where(calibrates).isEmpty():
        calibrates = F.lit(True)
        fits = train
    else:
        fits = train.where(~calibrates)
    width, count = size + 1, len(FEATURES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        rows = matrix(batch.column(0))
        return np.r_[len(rows), rows.sum(0), (rows**2).sum(0)]

    total = partition_sums(fits, ["stats"], moments, 1 + 2 * count)
    rows_seen = max(total[0], 1.0)
    mean = total[1 : 1 + count] / rows_seen
    kernel = Kernel(mean, np.sqrt(np.maximum(total[1 + count :] / rows_seen - mean**2, 0)), size, gamma, seed)

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        waves = kernel(matrix(batch.column(0)))
        return np.r_[(waves.T @ waves).ravel(), waves.T @ batch.column(1).to_numpy()]

    sums = partition_sums(fits, ["stats", "label"], equations, width * width + width)
    gram = sums[: width * width].reshape(width, width) / rows_seen + ridge / size * np.eye(width)
    weights = np.linalg.solve(gram, sums[width * width :] / rows_seen)
    if total[0] == 0:
        weights[:] = 0.0
        weights[-1] = 0.5

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("raw", pa.float64())])
        for batch in batches:
            if batch.num_rows:
                yield emit(schema, batch.column(0), batch.column(1), kernel(matrix(batch.column(2))) @ weights)

    kind = "doc_id long, label double, raw double"
    knots = isotonic(train.where(calibrates).select("doc_id", "label", "stats").mapInArrow(raw, kind), "raw", "label") if total[0] else (
        np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            if batch.num_rows:
                yield emit(schema, batch.column(0), np.interp(kernel(matrix(batch.column(1))) @ weights, *knots))

    return stats.mapInArrow(final, "doc_id long, score double").select(
        "doc_id",
        (fold("doc_id", folds) == held_fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
