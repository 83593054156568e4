"""Toxic spans by a linear-chain conditional random field over the words of each line.

Learning, from labelled documents outside the held-out fold only:
1. Words and word beginnings (4 to 8 bytes) are counted in a sample of toxic and clean
   documents; those far more frequent in toxic ones (by ratio and by the likelihood ratio) form
   the lexicon, in levels of evidence. A word of a toxic document with a level is a labelled
   toxic token; all others are clean tokens. Places with equal neighbours count once, so copies
   of one document give no evidence.
2. A two-state chain with the levels of a word and its neighbours as features is fitted by
   gradient ascent on a bounded sample of lines of one half of that sample, with the levels
   from the other half, so that chance finds of the lexicon get little weight.
   Of the lexicon's codes the ``most`` (20,000) with the strongest evidence are used: like the
   samples a bound on the model, not on the documents it scores.
3. Forward-backward marginals of all lines with a level give each document's raw score (the
   improbability that none of its words is toxic); an isotonic map over all labelled rows of
   the other folds turns it into a probability.

A line without any level has background marginals only, which are never tagged; it is not run.

Defined cases: a null or empty text has no spans and the raw score 0; labels that share an id
are averaged (toxic from 0.5 on), null labels are ignored; repeated rows are scored one by
one; a null id stays null and counts as empty text for its fold; extra columns are not read;
without toxic or without clean labels every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.calibration import fold, isotonic
from orderlens.llm.shared import emit, narrow, prepare, saved, slices, text_bytes
from orderlens.llm.words import Spans, mix, spans

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
PREFIXES = (4, 5, 6, 7, 8)
KINDS = np.arange(1, len(PREFIXES) + 2, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)
LEVELS = (12.0, 25.0, 50.0, 100.0, 250.0)
WIDTH = 1 + 3 * len(LEVELS)


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray  # one row per kind: the word and its beginnings
    first: np.ndarray  # per text
    line: np.ndarray  # number of the line over the whole batch


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends = spans(data, offsets, APART)
    coder = Spans(LOWER[data])
    codes = np.stack([coder.codes(starts, ends), *(coder.codes(starts, np.minimum(ends, starts + k)) for k in PREFIXES)])
    first = np.searchsorted(starts, offsets)
    new = np.zeros(len(data) + 1, np.int64)
    new[: len(data)] += data == 0x0A
    inner = offsets[:-1]
    np.add.at(new, inner, 1)
    line = np.cumsum(new)[starts]
    return Tokens(starts, ends, codes ^ KINDS[:, None], first, line)


def in_runs(codes: np.ndarray) -> np.ndarray:
    """The code of each word with its two neighbours."""
    padded = np.r_[np.uint64(0), codes, np.uint64(0)]
    return padded[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ padded[2:] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes


def lexicon(sample: DataFrame, toxic: int, clean: int, most: int = 20_000, ratio: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order, and the level of each. ``sample``: doc_id, text, toxic."""
    if not toxic or not clean:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])
        for batch in slices(batches):
            found = tokens(*text_bytes(batch.column(1)))
            held = [np.unique(found.codes[:, words]) for words in ranges(found.first)]
            codes, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            yield emit(schema, codes.view(np.int64), n)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.mapInArrow(documents, "code long, n long").groupBy("code").agg(F.sum("n").alias(name))

    seen = counted(sample.where("toxic"), "t")
    other = counted(sample.where("not toxic"), "c")
    found = strong(seen.where("t > 2").join(other, "code", "left"), toxic, clean, ratio)
    found = saved(found.orderBy(F.desc("evidence"), "code").limit(most))
    candidates = np.sort(np.array([r["code"] for r in found.select("code").collect()], np.int64).view(np.uint64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates' places, told apart by the words around them."""
        schema = pa.schema([("code", pa.int64()), ("place", pa.int64())])
        for batch in slices(batches):
            tokens_ = tokens(*text_bytes(batch.column(1)))
            near, codes = np.tile(in_runs(tokens_.codes[0]), len(KINDS)), tokens_.codes.ravel()
            held = np.isin(codes, candidates)
            pairs = np.unique(np.stack([codes[held], near[held]]), axis=1)
            yield emit(schema, pairs[0].view(np.int64), pairs[1].view(np.int64))

    apart = sample.where("toxic").mapInArrow(places, "code long, place long").dropDuplicates().groupBy("code").agg(F.count("*").alias("apart"))
    rows = strong(found.join(apart, "code").withColumn("t", F.least("t", "apart")), toxic, clean, ratio).collect()
    codes = np.array([r["code"] for r in rows], np.int64).view(np.uint64)
    levels = np.searchsorted(LEVELS, [r["evidence"] for r in rows], "right")
    order = np.argsort(codes)
    return codes[order], levels[order].astype(np.int64)


def strong(counts: DataFrame, toxic: int, clean: int, ratio: float) -> DataFrame:
    """The codes that are ``ratio`` times as frequent in toxic documents, by the likelihood ratio."""
    whole = toxic + clean
    t, c = F.col("t").cast("double"), F.coalesce("c", F.lit(0)).cast("double")
    evidence = 2 * (t * F.log(t * whole / ((t + c) * toxic)) + F.when(c > 0, c * F.log(c * whole / ((t + c) * clean))).otherwise(0.0))
    return (
        counts.where((t + 0.5) / (toxic + 1) > ratio * (c + 0.5) / (clean + 1))
        .select("code", "t", "c", evidence.alias("evidence"))
        .where(F.col("evidence") >= LEVELS[0])
    )


def ranges(first: np.ndarray) -> list[slice]:
    return [slice(a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b > a]


def token_levels(found: Tokens, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    codes, levels = words
    best = np.zeros(len(found.starts), np.int64)
    if len(codes):
        for kind in found.codes:
            at = np.minimum(np.searchsorted(codes, kind), len(codes) - 1)
            best = np.maximum(best, np.where(codes[at] == kind, levels[at], 0))
    return best


@dataclass
class Chain:
    """Scores of state 1 by feature, of each step between states, and of the first state."""

    weights: np.ndarray
    steps: np.ndarray
    begin: np.ndarray

    def emissions(self, levels: np.ndarray) -> np.ndarray:
        """``levels`` are padded rows of lines; -1 is padding."""
        held = np.maximum(levels, 0)
        before, after = np.pad(held, ((0, 0), (1, 0)))[:, :-1], np.pad(held, ((0, 0), (0, 1)))[:, 1:]
        k = len(LEVELS)
        parts = (np.r_[0.0, np.cumsum(self.weights[1 + j * k : 1 + (j + 1) * k])] for j in range(3))
        own, left, right = parts
        return self.weights[0] + own[held] + left[before] + right[after]

    def run(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of state 1, expected step counts, and the log of the partition sum."""
        n, length = levels.shape
        sizes = (levels >= 0).sum(1)
        push = np.exp(np.clip(self.emissions(levels), -30, 30))
        step = np.exp(self.steps)
        forward, backward = np.zeros((length, n, 2)), np.ones((length, n, 2))
        logs = np.zeros(n)
        for t in range(length):
            now = np.tile(np.exp(self.begin), (n, 1)) if t == 0 else forward[t - 1] @ step
            now[:, 1] *= push[:, t]
            total = now.sum(1)
            live = t < sizes
            logs[live] += np.log(total[live])
            forward[t] = now / total[:, None]
        for t in range(length - 2, -1, -1):
            after = backward[t + 1].copy()
            after[:, 1] *= push[:, t + 1]
            after = after @ step.T
            after /= after.sum(1, keepdims=True)
            backward[t] = np.where((t + 1 < sizes)[:, None], after, 1.0)
        both = forward * backward
        marginals = (both[:, :, 1] / both.sum(2)).T
        expected = np.zeros((2, 2))
        for t in range(length - 1):
            after = backward[t + 1].copy()
            after[:, 1] *= push[:, t + 1]
            joint = forward[t][:, :, None] * step[None] * after[:, None, :]
            live = t + 1 < sizes
            expected += (joint[live] / joint[live].sum((1, 2), keepdims=True)).sum(0)
        return marginals, expected, float(logs.sum())


    def marginals(self, levels: np.ndarray) -> np.ndarray:
        """Marginals of state 1 along one line of any length.

        The line is cut into about as many pieces as a piece has words. The steps within all
        pieces are taken side by side: first as products of 2 x 2 matrices, which carry messages
        from piece to piece, then as the messages themselves. Memory is a few numbers a word.
        """
        length = len(levels)
        wide = int(np.ceil(np.sqrt(length)))
        n = -(-length // wide)
        push = np.ones(n * wide)
        push[:length] = np.exp(np.clip(self.emissions(levels[None])[0], -30, 30))
        factors = np.exp(self.steps) * np.stack([np.ones_like(push), push], 1)[:, None, :]
        start = np.exp(self.begin) * [1.0, push[0]]
        factors[0] = factors[length:] = np.eye(2)
        factors = factors.reshape(n, wide, 2, 2)
        whole = np.tile(np.eye(2), (n, 1, 1))
        for t in range(wide):
            whole = whole @ factors[:, t]
            whole /= whole.sum((1, 2), keepdims=True)
        before, behind = np.zeros((n, 2)), np.ones((n, 2))
        for k in range(n):
            before[k] = start / start.sum()
            start = before[k] @ whole[k]
        for k in range(n - 1, 0, -1):
            behind[k - 1] = whole[k] @ behind[k]
            behind[k - 1] /= behind[k - 1].sum()
        forward = np.zeros((n, wide, 2))
        for t in range(wide):
            before = np.einsum("ni,nij->nj", before, factors[:, t])
            before /= before.sum(1, keepdims=True)
            forward[:, t] = before
        for t in range(wide - 1, -1, -1):
            forward[:, t] *= behind
            behind = np.einsum("nij,nj->ni", factors[:, t], behind)
            behind /= behind.sum(1, keepdims=True)
        both = forward.reshape(-1, 2)[:length]
        return both[:, 1] / both.sum(1)


def padded(lines: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lines), max(map(len, lines))), -1)
    for k, line in enumerate(lines):
        out[k, : len(line)] = line
    return out


def features_of(levels: np.ndarray) -> np.ndarray:
    """One feature per level reached by the word, the word before and the word behind."""
    held, k = np.maximum(levels, 0), len(LEVELS)
    out = np.zeros((*levels.shape, WIDTH))
    out[..., 0] = 1
    before, after = np.pad(held, ((0, 0), (1, 0)))[:, :-1], np.pad(held, ((0, 0), (0, 1)))[:, 1:]
    for j, values in enumerate((held, before, after)):
        for v in range(1, k + 1):
            out[..., (j * k) + v] = values >= v
    return out * (levels >= 0)[..., None]


def fitted(lines: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, decay: float = 1.0, rate: float = 0.15) -> Chain:
    """``lines``: levels and labels of the tokens of each line."""
    chain = Chain(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(2))
    if not lines:
        return chain
    lines = sorted(lines, key=lambda x: len(x[0]))
    groups = []
    for k in range(0, len(lines), 256):
        levels, truth = padded([x for x, _ in lines[k : k + 256]]), padded([y for _, y in lines[k : k + 256]])
        groups.append((levels, truth, features_of(levels)))
    observed = np.zeros((2, 2))
    for _, truth, _ in groups:
        for i in (0, 1):
            for j in (0, 1):
                observed[i, j] += ((truth[:, :-1] == i) & (truth[:, 1:] == j)).sum()
    total = sum(len(x) for x, _ in lines)
    mean, square = np.zeros(WIDTH + 6), np.zeros(WIDTH + 6)
    for k in range(1, rounds + 1):
        slope = np.zeros(WIDTH)
        expected, begin = np.zeros((2, 2)), np.zeros(2)
        for levels, truth, features in groups:
            marginals, steps, _ = chain.run(levels)
            gap = np.where(levels >= 0, truth - marginals, 0)
            slope += np.einsum("nl,nlw->w", gap, features)
            expected += steps
            begin += [-gap[:, 0].sum(), gap[:, 0].sum()]
        point = np.r_[chain.weights, chain.steps.ravel(), chain.begin]
        gradient = (np.r_[slope, (observed - expected).ravel(), begin] - decay * point) / total * 100
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        point = point + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        chain = Chain(point[:WIDTH], point[WIDTH : WIDTH + 4].reshape(2, 2), point[WIDTH + 4 :])
    return chain


def line_groups(levels: np.ndarray, line: np.ndarray) -> list[np.ndarray]:
    """Token numbers of each line that has a level."""
    held = np.zeros(int(line[-1]) + 1 if len(line) else 0, bool)
    held[line[levels > 0]] = True
    chosen = np.flatnonzero(held[line]) if len(line) else np.zeros(0, np.int64)
    return np.split(chosen, np.flatnonzero(np.diff(line[chosen])) + 1) if len(chosen) else []


# Words of a line that is run by itself, and words (with padding) of lines that are run together.
LONG_LINE = 4096
GROUP_WORDS = 1 << 17


def marginals_of(chain: Chain, levels: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Lines of like length are run together, so that padding at most doubles them."""
    out = np.zeros(len(levels))
    part: list[np.ndarray] = []

    def run() -> None:
        found = chain.run(padded([levels[g] for g in part]))[0] if part else []
        for row, g in zip(found, part, strict=True):
            out[g] = row[: len(g)]
        part.clear()

    for g in sorted(groups, key=len):
        if len(g) > LONG_LINE:
            out[g] = chain.marginals(levels[g])
            continue
        if part and (len(g) > 2 * len(part[0]) or len(g) * len(part) >= GROUP_WORDS):
            run()
        part.append(g)
    run()
    return out


def training_lines(sample: DataFrame, words: tuple[np.ndarray, np.ndarray], most: int, longest: int, seed: int) -> list:
    """A bounded sample of lines, most of them with a level, taken by a hash of their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("place", pa.int64()), ("levels", pa.binary()), ("toxic", pa.bool_()), ("held", pa.bool_())])
        for batch in slices(batches):
            found = tokens(*text_bytes(batch.column(1)))
            levels = token_levels(found, words)
            rows, near = [], in_runs(found.codes[0])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(found.first))
            toxic = np.array(batch.column(2).to_pylist(), bool)
            if len(levels):
                for g in np.split(np.arange(len(levels)), np.flatnonzero(np.diff(found.line)) + 1):
                    held = bool(levels[g].any())
                    if len(g) <= longest and (held or found.line[g[0]] % 64 == 0):
                        place = int(mix(found.codes[0][g[:1]] + np.uint64(len(g)) * near[g[0]]).view(np.int64)[0])
                        rows.append((place, levels[g].astype(np.int8).tobytes(), bool(toxic[owner[g[0]]]), held))
            yield emit(schema, *(zip(*rows, strict=True) if rows else ([], [], [], [])))

    found = sample.mapInArrow(run, "place long, levels binary, toxic boolean, held boolean")
    lines = []
    for held, share in ((True, 3), (False, 1)):
        rows = found.where(F.col("held") == held).orderBy(F.xxhash64("place", F.lit(seed)), "levels", "toxic").limit(most * share // 4)
        for r in rows.collect():
            levels = np.frombuffer(r["levels"], np.int8).astype(np.int64)
            lines.append((levels, (levels > 0).astype(np.int64) if r["toxic"] else np.zeros_like(levels)))
    return lines


def tagged(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], chain: Chain) -> DataFrame:
    """``docs``: doc_id, text. Raw score and toxic spans (code points) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.float64()), ("spans", pa.string())])
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            found = tokens(data, offsets)
            levels = token_levels(found, words)
            p = marginals_of(chain, levels, line_groups(levels, found.line))
            lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            raw, marks = np.zeros(batch.num_rows), [""] * batch.num_rows
            hits = np.flatnonzero((levels > 0) | (p >= 0.5))
            owner = np.searchsorted(found.first, hits, "right") - 1
            raw += np.log1p(np.bincount(owner, -np.log1p(-np.minimum(p[hits], 0.9999)), batch.num_rows))
            high = p[hits] >= 0.5
            shown: dict[int, list[str]] = {}
            for k, token in zip(owner[high].tolist(), hits[high].tolist(), strict=True):
                base = lead[offsets[k]]
                shown.setdefault(k, []).append(f"{lead[found.starts[token]] - base}:{lead[found.ends[token]] - base}")
            for k, parts in shown.items():
                marks[k] = ",".join(parts)
            yield emit(schema, batch.column(0), raw, marks)

    return docs.mapInArrow(run, "doc_id long, raw double, spans string")


def scores(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 4,
    held_fold: int = 2,
    sample_docs: int = 4_000,
    sample_lines: int = 4_000,
    longest_line: int = 400,
    threshold: float = 0.3,
    seed: int = 5,
) -> DataFrame:
    """Per document: whether it was held out, its score, the decision and the toxic spans.

    ``sample_docs`` bounds the toxic and the clean documents counted for the lexicon (in
    expectation, by a hash of the id), ``sample_lines`` and ``longest_line`` the lines that fit
    the chain. Nothing else is sampled.
    """
    prepare(docs.sparkSession)
    rows = narrow(docs, id_col, text_col)
    known = saved(
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("label"))
        .where("label is not null and doc_id is not null")
        .where(fold("doc_id", folds) != held_fold)
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) == 2:
        share = {k: min(1.0, sample_docs / n) for k, n in counts.items()}
        place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
        chosen = known.where(place < F.when(F.col("toxic"), share[True]).otherwise(share[False]))
        # The bounded sample's ids go to the tasks, so that no text moves for it.
        sample = saved(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))
        taken = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2 or len(taken) < 2:
        words, chain = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), fitted([])
    else:
        half = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)) == 0
        parts = {r["toxic"]: r["n"] for r in sample.where(half).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        part = lexicon(sample.where(half), parts.get(True, 0), parts.get(False, 0))
        chain = fitted(training_lines(sample.where(~half), part, sample_lines, longest_line, seed))
        words = lexicon(sample, taken[True], taken[False])
    found = saved(tagged(rows, words, chain))
    known_scores = found.join(known, "doc_id").select("raw", F.col("toxic").cast("int").alias("label"))
    knots = isotonic(known_scores, "raw", "label") if len(counts) == 2 else (np.array([0.0, 1.0]), np.array([0.0, 0.0]))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.string())])
        for batch in batches:
            yield emit(schema, batch.column(0), np.interp(batch.column(1).to_numpy(), *knots), batch.column(2))

    return found.mapInArrow(final, "doc_id long, score double, spans string").select(
        "doc_id",
        (fold("doc_id", folds) == held_fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "spans",
    )
