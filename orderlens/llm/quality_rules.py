"""Quality rules as a short-circuit cascade of DataFrame expressions; no Python runs on rows.

Each rule is a condition that rejects a text, with the work it does on one: the characters,
words, lines and windows it goes through. On a sample (a share of the rows, ``least`` of them at
least) every rule is tried, and per pattern of rejections the rows and the work of each rule are
added up. From these sums the rules are put in order one by one: next comes the rule that rejects
most per work among the sampled texts that the rules before it let through. They stand in one
CASE, so that later and dearer rules are evaluated only for texts that passed the earlier ones.
The order changes the time, never the verdict. An empty sample keeps the order given.

Words are runs of other characters than blanks (space, tab to carriage return).

Defined cases: a null or empty text has no words, every count is 0 and the base rules reject
it; repeated rows are judged one by one; a null id stays null; other columns are kept by
``kept`` and not read by ``measured``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import narrow, prepare

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
WINDOW = 8


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def repeated_words(found: Column) -> Column:
    """Words in windows of 8 that occur twice or more, the first occurrence included."""

    def covered(pairs: Column) -> Column:
        """Sorted (window, start): starts of windows with an equal neighbour, in text order."""
        last = F.size(pairs) - 1
        starts = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.when(
                ((k > 0) & (F.get(pairs, k - 1)["code"] == F.get(pairs, k)["code"]))
                | ((k < last) & (F.get(pairs, k + 1)["code"] == F.get(pairs, k)["code"])),
                F.get(pairs, k)["start"],
            ),
        )
        start = F.struct(F.lit(-WINDOW).alias("before"), F.lit(0).alias("sum"))
        return F.aggregate(
            F.array_sort(F.filter(starts, lambda s: s.isNotNull())),
            start,
            lambda got, s: F.struct(s.alias("before"), (got["sum"] + F.least(F.lit(WINDOW), s - got["before"])).alias("sum")),
            lambda got: got["sum"],
        )

    def from_codes(codes: Column) -> Column:
        pairs = F.array_sort(F.transform(codes, lambda code, k: F.struct(code.alias("code"), k.alias("start"))))
        return F.when(F.size(F.array_distinct(codes)) == F.size(codes), 0).otherwise(bound(pairs, covered))

    def from_words(ws: Column) -> Column:
        codes = F.transform(F.sequence(F.lit(1), F.size(ws) - WINDOW + 1), lambda k: F.xxhash64(F.slice(ws, k, WINDOW)))
        return F.when(F.size(ws) <= WINDOW, 0).otherwise(bound(codes, from_codes))

    return bound(found, from_words)


def stuttered_words(found: Column) -> Column:
    """Words equal to the word before."""
    return bound(
        found,
        lambda ws: F.when(F.size(ws) < 2, 0).otherwise(
            F.size(F.filter(F.sequence(F.lit(1), F.size(ws) - 1), lambda k: F.get(ws, k) == F.get(ws, k - 1)))
        ),
    )


def duplicate_lines(found: Column) -> Column:
    return bound(found, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL))


def word_chars(found: Column) -> Column:
    return F.length(F.array_join(found, ""))


def windows(found: Column) -> Column:
    return F.greatest(F.size(found) - WINDOW + 1, F.lit(0))


@dataclass(frozen=True)
class Rule:
    """``reject`` and ``work`` take the text and its words, which every rule shares. ``work`` is in
    characters read; ``measure`` names the count that ``test`` needs where it is known already."""

    name: str
    measure: Callable[[Column, Column], Column]
    test: Callable[[Column, Column, Column], Column]
    work: Callable[[Column, Column], Column]
    count: str = ""

    def reject(self, text: Column, found: Column, known: Column | None = None) -> Column:
        if known is not None and self.count:
            return self.test(known[self.count], F.size(found), known["n_lines"])
        n_lines = F.size(lines(text)) if self.count == "n_dup_lines" else F.lit(0)
        return self.test(self.measure(text, found), F.size(found), n_lines)


def _chars(text: Column, found: Column) -> Column:
    return F.length(text)


# Per word and window: reading its characters again, and hashing or comparing it.
RULES = (
    Rule("too_short", lambda t, ws: F.size(ws), lambda m, n, _: n < 20, lambda t, ws: F.lit(1), "n_words"),
    Rule("symbols", lambda t, ws: n_symbols(t), lambda m, n, _: 10 * m > n, _chars, "n_symbols"),
    Rule("long_words", lambda t, ws: word_chars(ws), lambda m, n, _: m > 30 * n, lambda t, ws: F.length(t) + F.size(ws), "word_chars"),
    Rule(
        "repeated_lines", lambda t, ws: duplicate_lines(lines(t)), lambda m, _, n: 2 * m > n,
        lambda t, ws: 2 * F.length(t) + 8 * F.regexp_count(t, F.lit("\n")), "n_dup_lines",
    ),
    Rule("stutter", lambda t, ws: stuttered_words(ws), lambda m, n, _: 5 * m > n, lambda t, ws: F.length(t) + 8 * F.size(ws)),
    Rule(
        "repeated_words", lambda t, ws: repeated_words(ws), lambda m, n, _: 100 * m > 30 * n,
        lambda t, ws: WINDOW * (F.length(t) + 8 * windows(ws)), "n_repeat_words",
    ),
)


def ordered(docs: DataFrame, text_col: str = "text", rules=RULES, fraction: float = 0.01, least: int = 2_000, seed: int = 7) -> list[Rule]:
    """The rules in the order that rejects most per work, each among what is left of the sample."""
    rows = docs.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sample = docs.select(text.alias("text")).sample(min(1.0, max(fraction, least / max(1, rows))), seed)
    tried = sample.select("text", words(F.col("text")).alias("ws"))
    tried = tried.select(
        F.array(*[r.reject(F.col("text"), F.col("ws")) for r in rules]).alias("rejected"),
        *[r.work(F.col("text"), F.col("ws")).cast("double").alias(f"w{k}") for k, r in enumerate(rules)],
    )
    # At most two to the number of rules rows.
    patterns = tried.groupBy("rejected").agg(F.count("*").alias("n"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(rules))]).collect()
    chain: list[int] = []
    while len(chain) < len(rules):
        left = [p for p in patterns if not any(p.rejected[k] for k in chain)]

        def gain(k: int) -> float:
            return sum(p.n for p in left if p.rejected[k]) / (1 + sum(p[f"w{k}"] for p in left))

        chain.append(max((k for k in range(len(rules)) if k not in chain), key=lambda k: (gain(k), -k)))
    return [rules[k] for k in chain]


def first_failed(text: Column, found: Column, rules, known: Column | None = None) -> Column:
    """The name of the first rule, in this order, that rejects; null if none does."""
    first, *rest = [(r.reject(text, found, known), r.name) for r in rules]
    return reduce(lambda case, r: case.when(*r), rest, F.when(*first))


def kept(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows, all columns, whose text no rule rejects."""
    prepare(docs.sparkSession)
    text, chain = F.coalesce(docs[text_col].cast("string"), F.lit("")), ordered(docs, text_col, rules)
    return docs.where(bound(words(text), lambda ws: first_failed(text, ws, chain)).isNull())


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The base counts of every text, whether the base rules fail, and the cascade's verdict. The
    counts are what most rules test, so only the others do work of their own."""
    prepare(docs.sparkSession)
    rows = narrow(docs, id_col, text_col)
    text, chain = F.col("text"), ordered(rows, "text", rules)
    rest = [r for r in chain if r.name not in ("too_short", "repeated_words")]

    def counts(ws: Column, ls: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            word_chars(ws).cast("long").alias("word_chars"),
            n_symbols(text).cast("long").alias("n_symbols"),
            duplicate_lines(ls).cast("long").alias("n_dup_lines"),
            repeated_words(ws).cast("long").alias("n_repeat_words"),
            F.size(ls).alias("n_lines"),
        )

    def judged(ws: Column, c: Column) -> Column:
        failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
        verdict = F.when(failed, False).otherwise(first_failed(text, ws, rest, c).isNull())
        return F.struct(c.alias("c"), failed.alias("base_failed"), verdict.alias("kept"))

    def every(ws: Column) -> Column:
        return bound(bound(lines(text), lambda ls: counts(ws, ls)), lambda c: judged(ws, c))

    found = rows.select("doc_id", bound(words(text), every).alias("f"))
    return found.select("doc_id", "f.c.*", "f.base_failed", "f.kept").drop("n_lines")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), windows AS (
  SELECT r, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r
), counts AS (
  SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS BIGINT) AS n_stutter
  FROM w LEFT JOIN covered ON w.r = covered.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
            OR word_chars > 30 * n_words OR 2 * n_dup_lines > n_lines OR 5 * n_stutter > n_words) AS kept
FROM counts
"""
