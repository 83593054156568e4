"""Operators on texts against brute force, on awkward rows and on empty tables."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlens import session
from orderlens.llm import decontamination, jaccard_join, line_dedup, packing, personal_data, quality_rules, queries, substring_dedup
from orderlens.llm.words import span_codes, window_codes, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
# Nulls in every column, blanks, ties, a repeated row, one id with two texts, very long text.
AWKWARD = [
    (1, None, "x"), (2, "", "x"), (3, " \t\n\r ", None), (None, "null id here", "y"), (None, None, None),
    (4, "same text " * 30, "x"), (4, "same text " * 30, "x"), (5, "same text " * 30, "z"), (6, "one", "x"), (6, "two", "x"),
    (7, LONG, "x"), (8, LONG + " end", "x"), (-9, "naïve “quoted” 日本語 \x00 \x1c é é", "x"), (10, "a\n\nb\n\na\nb", "x"),
]
# Names that the operators use themselves.
CLASHES = ("code", "oid", "row", "key", "class", "text_code", "n_removed", "lines", "flags", "prefix", "clean", "n_chars")


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(7).cast("int"))
    return docs.repartition(3)


def invented(seed, n=120, size=60):
    """Texts over few words with copied passages, near copies and copies."""
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(18, 40))] for _ in range(6)]
    out = []
    for k in range(n):
        kind = rnd.random()
        if out and kind < 0.15:
            text = rnd.choice(out)
        elif out and kind < 0.4:
            ws = rnd.choice(out).split(" ")
            ws[rnd.randrange(len(ws))] = rnd.choice(vocabulary)
            text = " ".join(ws)
        else:
            ws = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, size))]
            if rnd.random() < 0.5:
                at = rnd.randint(0, len(ws))
                ws[at:at] = rnd.choice(passages)
            text = "".join(w + rnd.choice([" ", " ", " ", "\n"]) for w in ws).strip(" ")
        out.append(text)
    order = list(range(n))
    rnd.shuffle(order)
    return [(i, out[i], "s") for i in order]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n\r\x0b\x0c\x1c", max_size=30), max_size=6))
def test_words_are_split_at_blanks(texts):
    raw = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
    found = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    whole = b"".join(raw)
    shown = [[whole[s:e] for s, e in zip(found.starts[a:b], found.ends[a:b])] for a, b in zip(found.first, found.first[1:])]
    assert shown == [t.split() for t in raw]
    by_word = {}
    for s, e, c in zip(found.starts, found.ends, found.codes):
        assert by_word.setdefault(whole[s:e], c) == c


def test_codes_do_not_depend_on_the_place():
    one = np.frombuffer(b"xx word yy word", np.uint8)
    codes = span_codes(one, np.array([3, 11]), np.array([7, 15]))
    assert codes[0] == codes[1]
    runs = window_codes(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 3


@pytest.mark.parametrize("text", ["", "  ", "Σας ΣΑΣ", "İx", "don't I'LL 'ss we've", "a\x1cb", "<|endoftext|> a", "“quote”… ’s", "①½ 日本語",
                                  "x" * 3000, "é é", "A\xa0B c\x85d", "12345 1.5%%%$$ Ж,", "a.b,c;;d! e?! f.", "ŰŸ ɏ ɐ"])
def test_word_tokens_equal_the_library(text):
    tokens = packing.WordTokens(VOCABULARY)
    expected = tokens.library.encode(text, add_special_tokens=False).ids
    for _ in range(2):  # new words, then remembered ones
        assert tokens.encode(pa.array(["other words", text, text]))[1].tolist() == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_has_the_library_s_tokens(texts):
    tokens = test_any_text_has_the_library_s_tokens.__dict__.setdefault("tokens", packing.WordTokens(VOCABULARY))
    found = tokens.encode(pa.array(texts, pa.string()))
    assert [f.tolist() for f in found] == [tokens.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_puts_each_token_in_one_place(spark):
    rows = AWKWARD + [(100 + i, t, s) for i, t, s in invented(1)]
    pieces = [r.asDict() for r in packing.pack(frame(spark, rows), VOCABULARY, buffer_tokens=6000).collect()]
    library = packing.WordTokens(VOCABULARY).library
    expected = {}
    for i, t, _ in rows:
        expected.setdefault(i, []).append(tuple([*library.encode(t or "", add_special_tokens=False).ids, 2]))
    counts = {}
    for p in pieces:
        fits = {ids for ids in expected[p["doc_id"]] if len(ids) == p["doc_tokens"] and zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]}
        assert fits and p["length"] > 0
        counts[p["doc_id"]] = counts.get(p["doc_id"], 0) + p["length"]
    assert counts == {i: sum(map(len, ids)) for i, ids in expected.items()}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 4096 and end & (end - 1) == 0  # full, or a power of two: no padding


def test_packing_balances_the_cost():
    placed = {}
    packer = packing.Packer(lambda piece, start, size, to, offset: placed.setdefault(to, []).append(size), 100, 1.0, 0.1, 0)
    for k, size in enumerate([90, 80, 10, 20, 50, 50]):
        packer.tail(k, 0, size)
    packer.flush(last=True)
    assert sorted(map(sorted, placed.values())) == [[10, 90], [20, 80], [50, 50]]


def test_decontamination_equals_brute_force(spark):
    rows = invented(2, 80)
    items = [(k, " ".join(t.split()[3:25]).upper()) for k, (_, t, _) in enumerate(rows[:12])] + [(50, "au bu"), (51, ""), (52, None), (None, "cu du eu")]
    items += [(0, "repeated id")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    expected = decontamination.brute_force([(i, t) for i, t, _ in rows], items)
    assert any(v[4] for v in expected.values()) and not all(v[4] for v in expected.values())
    for block in (200_000, 9):  # one automaton, and many: several to a stage, several stages, cut items
        found = decontamination.digest(decontamination.contamination(frame(spark, rows), bench, block_windows=block)).collect()
        assert {r[0]: tuple(r)[1:] for r in found} == expected
        kept = decontamination.uncontaminated(frame(spark, rows), bench, block_windows=block)
        assert kept.columns == frame(spark, rows).columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, v in expected.items() if not v[4]}


def test_memory_of_a_full_block():
    """Two nodes a word: 200,000 windows stay below 300 MB."""
    rnd = random.Random(3)
    words = [f"word{rnd.randrange(10**6)}" for _ in range(6000)]
    items = [(str(k), " ".join(rnd.choice(words) for _ in range(209))) for k in range(100)]
    stats = decontamination.automaton(items, 10).found.get_stats()
    assert stats["words_count"] == 20_000 and stats["nodes_count"] <= 20 * 20_000 + 1
    assert stats["total_size"] * decontamination.BLOCK_WINDOWS / 20_000 < 300e6


def test_decontamination_spans_are_offsets_of_the_original(spark):
    docs = frame(spark, [(1, "É—Alpha,  BETA gamma; alpha x", None)])
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id int, text string")
    (row,) = decontamination.contamination(docs, bench).collect()
    # A word goes on through letters beyond ASCII, so only a separate word matches.
    assert row["spans"] == [] and row["n_words"] == 5
    docs = frame(spark, [(1, "É Alpha,  BETA gamma; alpha x", None)])
    (row,) = decontamination.contamination(docs, bench).collect()
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(2, 14)] and row["n_hit"] == 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.-+ 23()é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert personal_data.base_spans(text) == personal_data.brute_force(text)


def test_personal_data_keeps_base_and_adds_spans(spark):
    planted = "mail jo.doe@mail1.example.com, call +1 (743) 555-3824 or (743) 555-3824, card 4111 1111 1111 1111, ip 10.0.0.255 not 10.0.0.256, password=hunter2hunter2"
    rows = AWKWARD + [(100 + k, f"{planted} {k}", "s") for k in range(40)]
    found = {}
    for r in personal_data.digest(personal_data.spans(frame(spark, rows))).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    (row,) = found[100]
    text = f"{planted} 0"
    shown = {tuple(s.split(":")[:1]) + (text[slice(*map(int, s.split(":")[1:]))],) for s in row["spans"].split(",")}
    base = {("email", "jo.doe@mail1.example.com"), ("phone", "+1 (743) 555-3824"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255")}
    assert base <= shown and ("secret", "password=hunter2hunter2") in shown
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert all(r["spans"] == "" for r in found[1] + found[2] + found[7])


def test_votes_that_agree_make_a_span_likely():
    real = personal_data.expectation_maximisation(["111111", "000000", "111-1-"], np.array([50.0, 50.0, 5.0]))
    assert real[0] > 0.9 > 0.1 > real[1] and real[2] > 0.9


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    pool = [f"line {k} of words" for k in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9))), "s") for i in range(150)]
    for window, least in ((2, 2), (3, 3), (2, 4)):
        done = {r["row"]["doc_id"]: (r["n_removed"], r["clean"]) for r in line_dedup.dedup_lines(frame(spark, rows), window=window, min_lines=least).collect()}
        code = {r[0]: r[1] for r in frame(spark, rows).select("doc_id", F.xxhash64("text")).collect()}
        gone = line_dedup.brute_force([(i, code[i], t) for i, t, _ in rows], window, least)
        for i, t, _ in rows:
            cut = gone.get((i, code[i]), set())
            kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
            assert done[i] == (len(cut), kept if not cut or kept.strip() else "")
        removed = any(n for n, _ in done.values())
        assert removed or least == 4


def test_line_dedup_finds_runs_of_frequent_lines(spark):
    """Each line stands alone before, in another context; the runs stand together only later."""
    a, b, c, d = "hello", "Les.", "heading", "more"
    texts = [f"{x}\nown {k}" for k, x in enumerate([a, b, c, d])]
    texts += [f"x\n{a}\n{b}\ny", f"z\n{a}\n{b}\nw", f"p\n{a}\n{c}\n{b}\n{d}", f"q\n{a}\n{c}\n{b}\n{d}\nr"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    for window, least, cut in ((2, 2, {5: "z\nw", 7: "q\nr"}), (2, 4, {7: "q\nr"}), (2, 5, {})):
        done = {r["row"]["doc_id"]: r["clean"] for r in line_dedup.dedup_lines(frame(spark, rows), window=window, min_lines=least).collect()}
        assert done == dict(enumerate(texts)) | cut


def test_windows_share_selected_lines():
    """Fewer lines are selected than there are windows, and equal windows select the same line."""
    codes = np.random.default_rng(1).integers(0, 1 << 62, 4000).astype(np.uint64)
    codes[1000:1300] = codes[200:500]
    for size, share in ((2, 0.7), (4, 0.45)):
        starts = np.arange(len(codes) - size + 1)
        picked = line_dedup.winnow(codes, starts, size)
        assert len(np.unique(picked)) < share * len(starts)
        assert (picked[1000 : 1301 - size] - picked[200 : 501 - size] == 800).all()


def test_matches_are_extended_both_ways_and_stop_in_time():
    later, first = [9, 1, 2, 3, 4, 5, 8], [7, 7, 1, 2, 3, 4, 5]
    # One seed at line 3 (its window 2-3) brings the whole run; blocks begin at 64 and 128.
    assert line_dedup.extend(later, first, [(67, 132, 66, 2)], 64, 128) == set(range(65, 70))
    # A document of one line over and over: each place is visited once, not once per diagonal.
    many = [5] * 4000
    assert line_dedup.extend(many, many, [(k, 0, k, 2) for k in range(1, 3999)], 0, 0) == set(range(1, 4000))


def test_line_dedup_of_one_line_over_and_over(spark):
    rows = [(1, "\n".join(["same"] * 3000), "x"), (2, "\n".join(["other", *["same"] * 2000]), "x")]
    done = {r["row"]["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert done == {1: 2999, 2: 2000}


def test_line_dedup_finds_long_single_lines(spark):
    """A passage on one line goes between new neighbours and as a whole document; a word less stays."""
    long, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(49))
    half = " ".join(f"u{k}" for k in range(25))
    texts = [f"a\n{long}\nb\n{short}\nc", f"d\n\n{long}\ne", long, f"f\n{short}\ng", short]
    texts += [f"h\n{half}\n{half} x\ni", f"j\n{half}\n{half} x\nk", f"l\n{long}\nj\nm"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    for window, least, most, cut in (
        (2, 2, 50, {1: "d\n\ne", 2: "", 6: "j\nk", 7: "l\nj\nm"}),
        (2, 3, 50, {1: "d\n\ne", 2: "", 6: "j\nk", 7: "l\nj\nm"}),
        (2, 3, 52, {}),
        (2, 2, 49, {1: "d\n\ne", 2: "", 3: "f\ng", 4: "", 6: "j\nk", 7: "l\nj\nm"}),
    ):
        done = {r["row"]["doc_id"]: r["clean"] for r in line_dedup.dedup_lines(frame(spark, rows), window=window, min_lines=least, min_words=most).collect()}
        assert done == dict(enumerate(texts)) | cut
    by_default = {r["row"]["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert by_default == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 2, 7: 1}


def test_line_dedup_of_short_runs_equals_brute_force(spark):
    rnd = random.Random(5)
    pool = [" ".join(f"t{k}" for _ in range(k)) for k in range(1, 13)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9))), "s") for i in range(60)]
    code = {r[0]: r[1] for r in frame(spark, rows).select("doc_id", F.xxhash64("text")).collect()}
    for window, least, most in ((2, 2, 10), (2, 4, 14), (5, 3, 20)):
        gone = line_dedup.brute_force([(i, code[i], t) for i, t, _ in rows], window, least, most)
        done = line_dedup.dedup_lines(frame(spark, rows), window=window, min_lines=least, min_words=most)
        assert {r["row"]["doc_id"]: r["n_removed"] for r in done.collect()} == {i: len(gone.get((i, code[i]), ())) for i, _, _ in rows}


def test_line_dedup_keeps_rows_and_columns(spark):
    docs = frame(spark, AWKWARD)
    done = line_dedup.cleaned(docs)
    assert done.columns == docs.columns and done.count() == len(AWKWARD)
    texts = {}
    for r in done.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"], r["source"]))
    assert texts[1] == [(None, None, "x")] and texts[10] == [("a\n\nb\n", 5, "x")]


@pytest.mark.parametrize("heavy", [10**9, 1])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring_dedup, "LEAST_HEAVY", heavy)
    rows = invented(4, 150) + [(500, "ab " * 70, "s"), (501, "ab cd " * 30, "s"), (502, "ab cd " * 31 + "x", "s")]
    done = substring_dedup.dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    expected = substring_dedup.brute_force([(i, t) for i, t, _ in rows])
    assert {r[0]: tuple(r)[1:] for r in done} == expected and sum(v[1] > 0 for v in expected.values()) > 20


def test_substring_dedup_of_awkward_rows(spark):
    done = sorted(tuple(r) for r in substring_dedup.dedup(frame(spark, [r for r in AWKWARD if r[0] is not None])).select("doc_id", "n_words", "n_removed").collect())
    assert len(done) == len(AWKWARD) - 2
    assert len({d for d in done if d[0] == 4}) == 1  # equal rows lose the same words
    assert [d[2] for d in done if d[0] == 5] == [60]  # a copy of a smaller id
    assert [d[2] for d in done if d[0] == 8] == [30_000]


def test_substring_dedup_orders_null_ids_last(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(None, f"null first {passage}", "s"), (3, f"{passage} three", "s"), (None, f"null again {passage}", "s"), (None, None, "s")]
    done = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(frame(spark, rows)).collect()), key=str)
    assert done == [(3, 26, 0), (None, 0, 0), (None, 27, 25), (None, 27, 25)]


def test_jaccard_classes_equal_brute_force(spark):
    rows = invented(5, 140, 90) + [(900, "", "s"), (901, None, "s"), (902, "a b", "s"), (903, "a  b\n", "s"), (904, "b a", "s")]
    expected = jaccard_join.brute_force([(i, t) for i, t, _ in rows])
    assert sum(v[1] > 1 for v in expected.values()) > 5
    for block in (500, 2):  # links counted in one block, and in many
        found = jaccard_join.classes(frame(spark, rows), block=block).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in found} == expected


def test_classes_of_long_chains_in_few_rounds(spark, monkeypatch):
    """Chains in random order, where labels that pass from node to node would take a round a node."""
    rnd = random.Random(12)
    nodes = rnd.sample(range(-(10**6), 10**6), 700)
    edges = [*zip(nodes[:300], nodes[1:301]), *zip(nodes[400:600], nodes[401:601]), (nodes[650], nodes[651])]
    rounds = []
    kept = jaccard_join.saved
    monkeypatch.setattr(jaccard_join, "saved", lambda df: rounds.append(1) or kept(df))
    found = {r[0]: r[1] for r in jaccard_join.smallest_neighbours(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(part) for part in (nodes[:301], nodes[400:601], nodes[650:652]) for n in part}
    assert found == want and len(rounds) < 14
    more = spark.createDataFrame([(nodes[5], nodes[500]), (nodes[650], nodes[690])], "a long, b long")
    merged = {r[0]: r[1] for r in jaccard_join.merged_classes(spark.createDataFrame([*found.items()], "node long, class long"), more).collect()}
    whole = {n: min(part) for part in (nodes[:301] + nodes[400:601], [*nodes[650:652], nodes[690]]) for n in part}
    assert merged == whole


def test_jaccard_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    found = jaccard_join.classes(docs).collect()
    assert len(found) == len(AWKWARD)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by_id[4] == by_id[5] == {4} and by_id[1] == by_id[2] == by_id[3] == {1} and by_id[8] == {7}
    kept = jaccard_join.first_of_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-9, 1, 4, 6, 6, 7, 10]


def test_shortened_prefixes_reach_the_recall():
    k = jaccard_join.shortened(10, 32, 0.8, 0.999)
    assert 1 - (1 - 0.8**k) ** 32 >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** 32


def test_quality_rules_equal_the_sql(spark):
    rows = [r for r in AWKWARD if "\x00" not in (r[1] or "")] + [(100 + i, t, s) for i, t, s in invented(6)]
    rows += [(300, "This This This This word word word word " * 6, "s"), (301, "a$ b% c& " * 9, "s"), (302, "one line of text\n" * 12, "s")]
    docs = frame(spark, rows)
    done = [tuple(r) for r in quality_rules.measured(docs).collect()]
    connection = duckdb.connect()
    connection.register("documents", pa.table(pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})))
    expected = [tuple(r) for r in connection.sql(quality_rules.ORACLE).fetchall()]
    assert sorted(map(str, done)) == sorted(map(str, expected))
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in done) > 0


def test_rule_order_never_changes_the_verdict(spark):
    docs = frame(spark, invented(7))
    one = {r["doc_id"] for r in quality_rules.kept(docs).collect()}
    assert one == {r["doc_id"] for r in quality_rules.kept(docs, rules=quality_rules.RULES[::-1]).collect()}
    chain = quality_rules.ordered(docs, fraction=1.0)
    assert sorted(r.name for r in chain) == sorted(r.name for r in quality_rules.RULES)


def test_rules_are_ordered_by_what_the_sample_shows(spark):
    """The same rules, costs and code: only the texts turn the order."""
    words = [f"word{k}" for k in range(60)]
    plain, symbols = " ".join(words), " ".join("a#" + w for w in words)
    long_words = " ".join(w * 12 for w in words)
    stutter = " ".join(f"{w} {w}" for w in words)
    both = " ".join(f"#{w} #{w}" for w in words)  # symbols and stutter
    repeated = " ".join(words[:20] * 4)

    def order(*texts):
        chain = quality_rules.ordered(spark.createDataFrame([(t,) for t in texts], "text string"), least=1_000_000)
        return [r.name for r in chain]

    assert order(plain, symbols, symbols)[0] == "symbols"
    assert order(plain, long_words, long_words)[0] == "long_words"
    assert order(plain, stutter, stutter)[0] == "stutter"
    # Alone, stutter rejects as many as symbols and more than repeated words; of what symbols let through, none.
    names = order(plain, both, both, both, repeated)
    assert names[0] == "symbols" and names.index("repeated_words") < names.index("stutter")
    names = order(plain, both, stutter, stutter, repeated)
    assert names.index("stutter") < names.index("repeated_words")


def test_empty_tables(spark):
    docs = frame(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id int, text string")
    assert packing.pack(docs, VOCABULARY).count() == 0
    assert decontamination.digest(decontamination.contamination(docs, bench)).count() == 0
    assert decontamination.uncontaminated(frame(spark, AWKWARD), bench).count() == len(AWKWARD)
    assert personal_data.digest(personal_data.spans(docs)).count() == 0
    assert line_dedup.cleaned(docs).count() == 0
    assert substring_dedup.dedup(docs).count() == 0
    assert jaccard_join.classes(docs).count() == 0 and jaccard_join.first_of_class(docs).count() == 0
    assert quality_rules.measured(docs).count() == 0 and quality_rules.kept(docs).count() == 0


def test_one_large_group_of_near_copies(spark):
    """Some pairs of the group are links and some are not; each text's links are counted."""
    rnd = random.Random(8)
    base = [f"v{rnd.randrange(4000)}" for _ in range(150)]
    rows = []
    for k in range(90):
        text = list(base)
        for _ in range(rnd.randint(1, 5)):
            text[rnd.randrange(len(text))] = f"e{rnd.randrange(4000)}"
        rows.append((k, " ".join(text), "s"))
    expected = jaccard_join.brute_force([(i, t) for i, t, _ in rows])
    links = [v[1] for v in expected.values()]
    assert min(links) < 40 < max(links)
    found = jaccard_join.classes(frame(spark, rows), block=25).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in found} == expected


def test_line_dedup_query_runs_small_tasks(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nc d\ne"), (2, "x\na b\nc d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    was = spark.conf.get(session.TASK_INPUT)
    try:
        spark.conf.unset(session.TASK_INPUT)
        found = {r.doc_id: r.text for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
        assert spark.conf.get(session.TASK_INPUT) == "16m" and found == {1: "a b\nc d\ne", 2: "x"}
    finally:
        spark.conf.set(session.TASK_INPUT, was)
