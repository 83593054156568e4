"""Classifiers on held-out rows, page extraction, and the pipeline against brute force."""

import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderlens.llm import calibration, decontamination, html_text, jaccard_join, line_dedup, quality_model, queries, toxicity
from tests.llm.test_text_operators import AWKWARD, frame

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def area(rows, label):
    """Share of pairs of a 1 and a 0 that the score puts in order."""
    ones = [r["score"] for r in rows if r[label] == 1]
    zeros = [r["score"] for r in rows if r[label] == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op7_quality_classifier, "quality", 0.97), (queries.op9_toxicity, "toxic", 0.75)])
def test_held_out_rows_are_told_apart(spark, query, label, least):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", label)
    rows = query(spark, MEDIUM).join(labels, "doc_id").where("held_out").collect()
    assert area(rows, label) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize(("scores", "label", "folds", "held"), [(quality_model.scores, "quality", 5, 0), (toxicity.scores, "toxic", 4, 2)])
def test_labels_of_held_out_rows_are_not_learnt_from(spark, scores, label, folds, held):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    held_out = calibration.fold("doc_id", folds) == held
    turned = labels.withColumn(label, F.when(held_out, 1 - F.col(label)).otherwise(F.col(label)))
    one = {r["doc_id"]: r["score"] for r in scores(docs, labels).collect()}
    other = {r["doc_id"]: r["score"] for r in scores(docs, turned).collect()}
    assert one == pytest.approx(other)


@pytest.mark.parametrize("scores", [quality_model.scores, toxicity.scores])
def test_scores_of_awkward_rows(spark, scores):
    docs = frame(spark, AWKWARD)
    kind = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame([(1, 0, 1, ""), (4, 1, 0, ""), (4, 1, 0, ""), (None, 1, 1, ""), (6, None, None, ""), (7, 1, 0, ""), (8, 1, 0, "")], kind)
    for given in (labels, labels.limit(0)):
        found = scores(docs, given).collect()
        assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    assert scores(docs.limit(0), labels).count() == 0


def test_monotone_pools_violators():
    fitted = calibration.monotone(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert fitted.tolist() == [0, 0.5, 0.5, 1]


def test_chain_marginals_equal_enumeration():
    rnd = np.random.default_rng(0)
    chain = toxicity.Chain(rnd.normal(size=toxicity.WIDTH), rnd.normal(size=(2, 2)), rnd.normal(size=2))
    levels = np.array([[0, 3, 1, 0], [2, 0, -1, -1]])
    marginals, steps, logs = chain.run(levels)
    emissions = chain.emissions(levels)
    total = 0.0
    expected_steps = np.zeros((2, 2))
    for row, size in ((0, 4), (1, 2)):
        weight, ones = 0.0, np.zeros(size)
        pairs = np.zeros((2, 2))
        for states in np.ndindex(*[2] * size):
            score = chain.begin[states[0]] + sum(emissions[row, t] * s for t, s in enumerate(states))
            score += sum(chain.steps[a, b] for a, b in zip(states, states[1:]))
            weight += np.exp(score)
            ones += np.exp(score) * np.array(states)
            for a, b in zip(states, states[1:]):
                pairs[a, b] += np.exp(score)
        assert marginals[row, :size] == pytest.approx(ones / weight)
        expected_steps += pairs / weight
        total += np.log(weight)
    assert steps == pytest.approx(expected_steps) and logs == pytest.approx(total)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="sidebar-left">
<!-- no <p>no</p> --><header><h1>Site</h1></header><nav><ul><li>Home<li>Away</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Caf&eacute; &amp; bar</h1><p>by me</p></header><p>First <b>bold</b>
 line<br>goes&nbsp;on.<p>Second<script>if(a<b){"</p>"}</script> one &lt;b&gt;.<table><tr><td>x</td><td>y</td></tr></table>
<form><p>Your mail</p></form><section id="comments"><p>Nice read</p></section></article>
<aside>Related</aside><div class="ad">Buy</div><footer>&copy; host</footer></body></html>"""


def test_article_markup_decides(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE, 0)], "page_id long, url string, html string, text int")
    (row,) = html_text.texts(pages).collect()
    assert row["text"] == "Café & bar\nFirst bold line goes on.\nSecond one <b>.\nx\ny"


def test_names_inside_an_article_drop_only_containers():
    article = """<article><h2 id="search">Search</h2><p class="alert">Mind this.</p><section id="related-work"><p>Others wrote.</p></section>
<section id="header-files"><p>Include them.</p></section><div class="share-bar"><p>Share</p></div><div role="alert"><p>Saved</p></div>
<section id="comments"><p>Nice read</p></section><form><p>Your mail</p></form><p hidden>Not shown</p></article>"""
    text = "Search\nMind this.\nOthers wrote.\nInclude them."
    assert html_text.split_page(article)[0] == text
    assert html_text.split_page(f"<body><form id='page'><p>Menu</p>{article}<p>End</p></form></body>")[0] == text
    assert html_text.split_page("<form><p>Menu</p><main><p>Told here.</p></main></form>")[0] == "Told here."
    assert html_text.split_page(f"<nav>{article}</nav>")[0] is None
    assert html_text.split_page("<p class='alert'>Notice</p><p>Story</p>")[1:] == (["Notice", "Story"], [1])


@pytest.mark.parametrize("html", ["<", "<p", "<p class='a>text", "a < b", "<script>open", "</div></p>text", "<!-- open", "<div " * 2000, "&#0;&bogus;&#x110000;", "<p><p><p>"])
def test_broken_markup_is_read(html):
    assert isinstance(html_text.blocks(html), list)


HOSTILE = {
    "quote": '<a "' * 250_000, "unclosed": "<svg>" * 100_000 + "x" * 500_000, "odd quotes": "<a '>'x" * 140_000,
    "deep": "<div>" * 90_000 + "</section>" * 55_000, "comments": "<!--x" * 200_000, "names": "<a" * 500_000,
    "end tags": "<svg></svg" * 100_000, "mixed quotes": "<a \"x'>" * 140_000 + '"', "signs": "<" * 1_000_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_broken_markup_takes_linear_time(kind):
    start = time.process_time()
    html_text.blocks(HOSTILE[kind])
    assert time.process_time() - start < 5  # seconds for a megabyte; hours where time is quadratic


def test_only_the_array_removes_unmarked_template_blocks(spark):
    """Nothing in the markup tells the template from the story."""
    menu = "<nav><p>one two three four five six seven</p></nav>"
    shared = "<p>read all about the terms of this site before you go on</p>"
    rows = [(k, f"http://h.example/{k}", f"{menu}{shared}<p>one two three four five six seven</p><p>page{k} tells its{k} own story{k} of thing{k}</p>") for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.texts(df).collect()}
    assert found == {k: f"page{k} tells its{k} own story{k} of thing{k}" for k in range(5)}


def test_host_runs_decide_where_markup_does_not(spark):
    top, bottom = "<div>Start here our news and old news list</div>", "<div>Write to the makers of this fine page today</div>"
    pages = [(k, "https://soup.example/%d" % k, f"{top}<div>Own story number {k} is told in words {k * 7} only here {k * 13}</div>{bottom}") for k in range(5)]
    # The copy has the same stream, so its story is no boilerplate; another host proves nothing.
    pages += [(10, "https://soup.example/copy", pages[0][2]), (11, "https://other.example/", pages[1][2])]
    pages += [(12, None, None), (None, "not a url", ""), (13, "https://soup.example/0", pages[0][2])]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).repartition(3)
    found = {r["page_id"]: r["text"] for r in html_text.texts(docs).collect()}
    assert len(found) == len(pages)
    for k in range(5):
        assert found[k] == f"Own story number {k} is told in words {k * 7} only here {k * 13}"
    assert found[10] == found[13] == found[0] and found[12] == found[None] == ""
    assert found[11].count("\n") == 2
    assert html_text.texts(docs.limit(0)).count() == 0


def test_the_array_takes_in_pages_with_an_article(spark):
    """Their menus are found as repeated runs; the article stays whole even where it is repeated."""
    menu, story = "<nav>one two three four five six seven</nav>", "the same words stand in every article of this host"
    rows = [(k, f"http://h.example/{k}", f"{menu}<article><p>{story}</p></article><p>only{k} here{k}</p>") for k in range(3)]
    rows += [(3, "http://h.example/3", "<article></article><nav>a b c</nav>"), (4, "http://h.example/4", f"<article>{'x é ' * 9000}</article>")]
    found = {r.page_id: (r.text, r.n_repeated) for r in html_text.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {0: (story, 7), 1: (story, 7), 2: (story, 7), 3: ("", 0), 4: (("x é " * 9000).strip(), 0)}


def test_repeated_runs_equal_brute_force(spark):
    rnd = np.random.default_rng(1)
    pages = [(k % 2, [f"t{x}" for x in rnd.integers(0, 3, 25)]) for k in range(8)]
    rows = {}
    for stream, (host, tokens) in enumerate(pages):
        for suffix in html_text.suffixes(tokens, 4, 6):
            low, high = rows.get((host, suffix), (stream, stream))
            rows[host, suffix] = min(low, stream), max(high, stream)
    schema = html_text.pa.schema([("host", "int64"), ("suffix", "binary"), ("low", "int64"), ("high", "int64")])
    ordered = sorted((h, s, *v) for (h, s), v in rows.items())
    batches = [html_text.pa.RecordBatch.from_arrays([html_text.pa.array(c, f.type) for c, f in zip(zip(*ordered[k : k + 3]), schema)], schema=schema) for k in range(0, len(ordered), 3)]
    found = {}
    for batch in html_text.repeated_runs(iter(batches), 4, 6):
        for r in batch.to_pylist():
            found[r["host"], r["suffix"]] = r["length"]
    for (host, suffix), _ in rows.items():
        size = sum(suffix[4 * k : 4 * k + 4] != bytes(4) for k in range(6))
        expected = 0
        for k in range(4, size + 1):
            streams = {s for (h, x), v in rows.items() for s in v if h == host and x[: 4 * k] == suffix[: 4 * k]}
            expected = k if len(streams) > 1 else expected
        assert found.get((host, suffix), 0) == expected


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """On the smallest tables, each stage redone without Spark; rules by their own SQL-tested verdicts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rules = queries.op8_quality_rules(spark, SMALL)
    texts = {r["doc_id"]: r["text"] for r in docs.join(rules.where("kept"), "doc_id").collect()}
    code = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("text")).collect()}
    gone = line_dedup.brute_force([(i, code[i], t) for i, t in texts.items()])
    for (i, _), cut in gone.items():
        kept = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in cut)
        texts[i] = kept if kept.strip() else ""
    found = jaccard_join.brute_force(list(texts.items()))
    texts = {i: t for i, t in texts.items() if found[i][0] == i}
    words = [decontamination.normalised(t) for _, t in items]
    windows = {b" ".join(w[k : k + 10]) for w in words if w for k in range(max(1, len(w) - 9))}
    texts = {i: t for i, t in texts.items() if not any(f" {w.decode()} " in f" {b' '.join(decontamination.normalised(t)).decode()} " for w in windows)}
    sizes = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        sizes.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    assert set(sizes) == set(texts) and all(a == b for a, b in sizes.values())
    staged = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, staged, SMALL).write.parquet(str(tmp_path / str(k)))
        staged = spark.read.parquet(str(tmp_path / str(k)))
        assert staged.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in staged.collect()} == texts


def test_marginals_of_long_lines():
    """The line cut into pieces gives what the chain run word by word gives; memory stays linear."""
    rng = np.random.default_rng(8)
    chain = toxicity.Chain(rng.normal(0, 1, toxicity.WIDTH), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))
    for length in (1, 2, 3, 10, 97, 1000):
        levels = np.where(rng.random(length) < 0.1, rng.integers(1, len(toxicity.LEVELS) + 1, length), 0)
        assert np.allclose(chain.marginals(levels), chain.run(levels[None])[0][0], atol=1e-12)
    sizes = [500_000, *rng.integers(1, 40, 127).tolist()]
    levels = np.where(rng.random(sum(sizes)) < 0.01, 2, 0)
    groups = np.split(np.arange(sum(sizes)), np.cumsum(sizes)[:-1])
    tracemalloc.start()
    found = toxicity.marginals_of(chain, levels, groups)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    for k in (1, 50, 127):
        assert np.allclose(found[groups[k]], chain.run(levels[groups[k]][None])[0][0], atol=1e-12)


def test_a_toxic_word_in_a_very_long_line():
    """Tokens, levels and marginals of a line of 500,000 words, one of them in the lexicon."""
    text = " ".join(["plain"] * 300_000 + ["venomous"] + ["words"] * 200_000)
    data, offsets = toxicity.text_bytes(toxicity.pa.array([text]))
    found = toxicity.tokens(data, offsets)
    code = found.codes[0][300_000]
    levels = toxicity.token_levels(found, (np.array([code]), np.array([len(toxicity.LEVELS)])))
    weights = np.zeros(toxicity.WIDTH)
    weights[0], weights[1 : 1 + len(toxicity.LEVELS)] = -6, 3
    p = toxicity.marginals_of(toxicity.Chain(weights, np.zeros((2, 2)), np.zeros(2)), levels, toxicity.line_groups(levels, found.line))
    assert np.flatnonzero(p > 0.5).tolist() == [300_000]


def test_quality_scores_equal_direct_equations(spark):
    """Statistics by hand for some features; moments, kernel, ridge weights and knots by plain numpy."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(5, 60))) + ("." if k % 3 else " #$ 99") for k in range(240)]
    truth = [int(k % 3 > 0) for k in range(240)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(truth)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_model.scores(docs, labels).collect()}
    stats = quality_model.statistics(toxicity.pa.array(texts)).astype(np.float32).astype(float)
    split = [t.split() for t in texts]
    assert np.allclose(stats[:, 0], np.log1p([len(ws) for ws in split]))
    assert np.allclose(stats[:, 2], [np.mean([len(w) for w in ws]) for ws in split], atol=1e-5)
    assert np.allclose(stats[:, 11], [len(set(ws)) / len(ws) for ws in split], atol=1e-6)
    part = np.array([zlib.crc32(str(k).encode()) % 5 for k in range(240)])
    fits, checks = ~np.isin(part, (0, 1)), part == 1
    rows, size = stats[fits], 192
    kernel = quality_model.Kernel(rows.mean(0), rows.std(0), size, 0.04, 11)
    waves, y = kernel(rows), np.array(truth, float)
    weights = np.linalg.solve(waves.T @ waves / len(rows) + 1e-2 / size * np.eye(size + 1), waves.T @ y[fits] / len(rows))
    raw = kernel(stats) @ weights
    low, wide = raw[checks].min(), np.ptp(raw[checks])
    bins = np.minimum(np.floor((raw[checks] - low) / wide * calibration.BINS), calibration.BINS - 1)
    n = np.array([(bins == b).sum() for b in np.unique(bins)], float)
    hits = np.array([y[checks][bins == b].sum() for b in np.unique(bins)])
    fitted = calibration.monotone(n + 0.1, hits + 0.1 * hits.sum() / n.sum())
    x = np.array([raw[checks][bins == b].mean() for b in np.unique(bins)])
    want = np.interp(raw, x, np.clip(fitted + 1e-6 * np.arange(len(x)) / calibration.BINS, 0, 1))
    assert np.allclose([got[k]["score"] for k in range(240)], want, atol=1e-6)
    assert all(got[k]["held_out"] == (part[k] == 0) and got[k]["predicted"] == (want[k] >= 0.3) for k in range(240) if abs(want[k] - 0.3) > 1e-5)


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    """Null ids and texts, ties, repeated rows, long texts and clashing columns through every stage."""
    docs = frame(spark, AWKWARD)
    good = " ".join(f"word{k}" for k in range(60))
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(good)}))
    for name, rows in (("awkward", docs), ("empty", docs.limit(0))):
        staged = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, staged, SMALL).write.parquet(path)
            staged = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert staged.columns == docs.columns
                held = staged
        kept = {(r["doc_id"], r["text"]) for r in held.collect()}
        # The other rows are short or repeat their words.
        assert kept == ({(None, good)} if name == "awkward" else set())
        assert {r["doc_id"] for r in staged.collect()} == {i for i, _ in kept}
