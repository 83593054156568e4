"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
estimates how reliable they are, and a span classifier is trained on the resulting
probabilities.

Base spans come from four strict patterns and always stay. Candidates are the base spans and
looser look-alikes of five kinds (the four and ``secret``). Six labelers vote 1, 0 or abstain:
strict pattern, checksum or shape, gazetteer, words before, edges, and misleading words before.
The votes are counted by pattern over all texts; these few counts are all the driver sees.
Candidates that the classifier takes and that overlap no base span are added.

Defined cases: a null or empty text has no spans; repeated rows are searched one by one; a null
id stays null; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import emit, ids_and_texts, narrow, prepare, saved, slices

# The kinds in their order and the strict patterns. A digit run is entered at its
# first digit only, which finds the same leftmost matches in linear time.
KINDS = ("email", "ip", "card", "phone", "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Look-alikes. Each is bounded in length, so no text makes the search slow.
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){0,4}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9]{1,4}(?:\.[0-9]{1,4}){3,4}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{3,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+|00)?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{4}[A-Z0-9]{12,36}|[0-9a-f]{32,64}|[A-Za-z]{2,3}[-_][A-Za-z0-9]{16,64}|(?:password|passwd|secret|token|api_key)\s?[=:]\s?[^\s\"']{6,64})(?![A-Za-z0-9])"),
}

# Gazetteers and context words, plain lists.
ENDINGS = frozenset("com org net edu gov int info biz io co de fr es it uk eu us ca au ch nl pl ru cn jp in br".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "sk-", "sk_", "xoxb", "password", "passwd", "secret", "token", "api_key")
BEFORE = {
    "email": ("mail", "contact", "write", "courriel", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "cell", "telefon", "appel"),
    "secret": ("password", "passwd", "secret", "token", "key", "credential", "auth"),
}
MISLEADING = ("version", "v.", "isbn", "section", "no.", "order", "sha", "commit", "chapter", "page")
LABELERS = 6
ABSTAIN = "-"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern from left to right, but entered at each @ sign."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    ips = [m.span() for m in IP.finditer(text) if octets(m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return [emails(text), ips, cards, phones]


def overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    k = bisect_left(spans, (end, 0))
    return k > 0 and spans[k - 1][1] > start


def shape_vote(kind: str, found: str) -> str:
    digits = only_digits(found)
    if kind == "email":
        return str(int("@" in found and found.rsplit(".", 1)[-1].isalpha()))
    if kind == "ip":
        return str(int(octets(found.split(".")) if found.count(".") == 3 and ":" not in found else found.count(":") == 7))
    if kind == "card":
        return str(int(13 <= len(digits) <= 19 and luhn(digits)))
    if kind == "phone":
        return str(int(10 <= len(digits) <= 13 and len(set(digits)) > 2))
    return str(int(len(set(found)) >= 8))


def gazetteer_vote(kind: str, found: str) -> str:
    digits = only_digits(found)
    if kind == "email":
        return str(int(found.rsplit(".", 1)[-1].lower().strip(" ()[]") in ENDINGS))
    if kind == "ip":
        return ABSTAIN if ":" in found else str(int(not found.startswith(("0.", "255."))))
    if kind == "card":
        return str(int(digits[:1] in ("3", "4", "5", "6")))
    if kind == "phone":
        return "1" if found.startswith(("+", "00", "(")) else ABSTAIN
    return "1" if found.startswith(PREFIXES) else ABSTAIN


def votes(kind: str, text: str, start: int, end: int, base: bool) -> str:
    found, near = text[start:end], text[max(0, start - 30) : start].lower()
    before, behind = text[start - 1 : start], text[end : end + 1]
    clean = not (before.isalnum() or before in "._-/") and not (behind.isalnum() or behind in "_/@")
    return "".join(
        (
            ABSTAIN if kind == "secret" else str(int(base)),
            shape_vote(kind, found),
            gazetteer_vote(kind, found),
            "1" if any(w in near for w in BEFORE[kind]) else ABSTAIN,
            str(int(clean or not before or not behind)),
            "0" if any(w in near for w in MISLEADING) else ABSTAIN,
        )
    )


def shape(found: str) -> int:
    """Length in steps of 8 and share of digits in thirds: the classifier's own view of the span."""
    share = sum("0" <= c <= "9" for c in found) / max(len(found), 1)
    return min(len(found) // 8, 5) * 3 + min(int(share * 3), 2)


def candidates(text: str) -> list[tuple[int, int, int, bool, str, int]]:
    """(kind, start, end, base, votes, shape), the base spans first."""
    base = base_spans(text)
    taken = sorted(s for spans in base for s in spans)
    merged: list[tuple[int, int]] = []
    for start, end in taken:
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    out = [(k, s, e, True, votes(KINDS[k], text, s, e, True), shape(text[s:e])) for k, spans in enumerate(base) for s, e in spans]
    for k, kind in enumerate(KINDS):
        for m in LOOSE[kind].finditer(text):
            if not overlaps(merged, m.start(), m.end()):
                out.append((k, m.start(), m.end(), False, votes(kind, text, m.start(), m.end(), False), shape(m[0])))
    return out


CANDIDATE = "kind:int,start:int,end:int,base:boolean,votes:string,shape:int"
FOUND = f"doc_id long, found array<struct<{CANDIDATE}>>"
STRUCT = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("shape", pa.int32())])


def one_hot(patterns: list[str]) -> np.ndarray:
    """For each pattern and labeler: whether it votes 0, 1 or abstains."""
    return np.array([[[v == x for x in ("0", "1", ABSTAIN)] for v in p] for p in patterns], float)


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 60, trust: float = 0.25) -> np.ndarray:
    """Probability of each vote pattern to be real, from how the labelers agree.

    Each labeler has its own vote probabilities for real and for false spans; they start from
    the belief that labelers are right more often than not, which also counts as much as a
    ``trust`` of all spans in every round, so that the two classes can't change places.
    """
    seen = one_hot(patterns)
    start = np.array([[0.5, 0.2, 0.3], [0.1, 0.6, 0.3]])
    rates = np.repeat(start[None], LABELERS, 0)
    prior = 0.5
    real = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        logs = np.einsum("plv,lcv->pc", seen, np.log(rates)) + np.log([1 - prior, prior])
        real = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        weights = np.stack([counts * (1 - real), counts * real], 1)
        sums = np.einsum("pc,plv->lcv", weights, seen) + start[None] * max(1.0, trust * counts.sum())
        rates = sums / sums.sum(2, keepdims=True)
        prior = float(np.clip((weights[:, 1].sum() + 1) / (weights.sum() + 2), 0.02, 0.98))
    return real


def design(kinds: list[int], patterns: list[str], shapes: list[int]) -> np.ndarray:
    """Kind, each vote of the kind, and the span's shape; no strict match, which base spans have anyway."""
    seen = one_hot(patterns)[:, 1:, :2].reshape(len(patterns), -1)
    of_kind = np.eye(len(KINDS))[kinds]
    return np.hstack([of_kind, (of_kind[:, :, None] * seen[:, None, :]).reshape(len(kinds), -1), np.eye(18)[shapes]])


def logistic(rows: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 40, decay: float = 1.0) -> np.ndarray:
    """Newton steps on weighted soft labels."""
    weights = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (counts * (target - p)) - decay * weights
        bend = (rows * (counts * p * (1 - p))[:, None]).T @ rows + decay * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights + step / max(1.0, np.abs(step).max())
    return weights


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: ``base`` and ``all`` spans as arrays of (kind, start, end) in order."""
    prepare(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = ids_and_texts(batch)
            names = ("kind", "start", "end", "base", "votes", "shape")
            rows = [[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in texts]
            yield emit(pa.schema([("doc_id", pa.int64()), ("found", pa.list_(STRUCT))]), ids, rows)

    found = saved(narrow(docs, id_col, text_col).mapInArrow(search, FOUND))
    groups = (
        found.select(F.explode("found").alias("c"))
        .groupBy("c.kind", "c.votes", "c.shape")
        .agg(F.count("*").alias("n"))
        .orderBy("kind", "votes", "shape")
        .collect()
    )
    kinds, patterns, shapes = [g["kind"] for g in groups], [g["votes"] for g in groups], [g["shape"] for g in groups]
    counts = np.array([g["n"] for g in groups], float)
    real = np.zeros(len(groups))
    for k in set(kinds):
        own = [j for j, x in enumerate(kinds) if x == k]
        real[own] = expectation_maximisation([patterns[j] for j in own], counts[own])
    weights = logistic(design(kinds, patterns, shapes), real, counts) if groups else np.zeros(0)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        schema = pa.schema([("doc_id", pa.int64()), ("base", kind), ("all", kind)])
        for batch in batches:
            rows = batch.column(1).to_pylist()
            extra = [c for row in rows for c in row if not c["base"]]
            p = design([c["kind"] for c in extra], [c["votes"] for c in extra], [c["shape"] for c in extra]) @ weights if extra else []
            taken = {id(c) for c, x in zip(extra, p, strict=True) if 1 / (1 + np.exp(-x)) >= threshold}
            base, every = [], []
            for row in rows:
                order = sorted(row, key=lambda c: (c["kind"], c["start"], c["end"]))
                shown = [({"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"]}, c) for c in order]
                base.append([s for s, c in shown if c["base"]])
                every.append([s for s, c in shown if c["base"] or id(c) in taken])
            yield emit(schema, batch.column(0), base, every)

    kind = "array<struct<kind:string,start:int,end:int>>"
    return found.mapInArrow(decide, f"doc_id long, base {kind}, all {kind}")


def digest(found: DataFrame) -> DataFrame:
    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans")
    )


def brute_force(text: str) -> list[list[tuple[int, int]]]:
    """For tests: the strict patterns as they are written."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    return [
        [m.span() for m in email.finditer(text)],
        [m.span() for m in ip.finditer(text) if octets(m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)],
        [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15],
    ]
