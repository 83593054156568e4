"""Clusters, whitening and archives against brute force, on awkward rows and on empty tables."""

import base64
import hashlib
import io
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from orderlens.llm import centroid_clusters, warc_archive, whitening

NAN, INF = float("nan"), float("inf")
CLASHES = ("x", "code", "cluster", "apex", "n", "total", "payload", "digest", "size", "claim", "archive", "v", "row")


def clashing(df):
    return df.withColumns({name: F.lit("7") for name in CLASHES})


def vectors(spark, rows, kind="float"):
    return clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).repartition(3)


def invented(seed, n=400, dims=64):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.3, (5, dims))
    rows = [(k, (middles[k % 5] + rng.normal(0, 0.1, dims)).astype(np.float32).tolist()) for k in range(n)]
    # A hot vector, repeated rows, awkward vectors, a null id.
    rows += [(n + k, rows[3][1]) for k in range(150)] + [rows[7], rows[7], (None, rows[9][1])]
    bad = [None, [], [0.5] * (dims - 1), [0.5] * (dims + 1), [None] + [0.5] * (dims - 1), [NAN] + [0.5] * (dims - 1), [INF] + [0.5] * (dims - 1)]
    return rows + [(n + 1000 + k, v) for k, v in enumerate(bad)]


def whole(rows, dims=64):
    return [(k, v) for k, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]


def brute_clusters(rows, clusters=8, rounds=10):
    """All distances to all centroids, in whole numbers."""
    kept = [(k, tuple(int(np.floor(1024 * float(c))) for c in v)) for k, v in whole(rows)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [np.array(x, object) for _, x in by_hash[:clusters]]
    x = np.array([x for _, x in kept], object)
    for turn in range(rounds + 1):
        far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
        number = [min(range(len(centres)), key=lambda j: (row[j], j)) for row in far]
        if turn < rounds:
            for j in set(number):
                mine = x[[i for i, m in enumerate(number) if m == j]]
                centres[j] = mine.sum(axis=0) // len(mine)
    distance = [far[i][m] for i, m in enumerate(number)]
    out = []
    for (k, _), m, d in zip(kept, number, distance):
        inertia = sum(e for e, other in zip(distance, number) if other == m)
        code = hashlib.sha256(",".join(str(v) for v in centres[m]).encode()).hexdigest()
        out.append((k, m, d, inertia, sum(distance), code))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_all_distances(spark, seed):
    rows = invented(seed)
    got = centroid_clusters.digest(centroid_clusters.cluster(vectors(spark, rows)))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_clusters(rows)


def test_clusters_of_few_equal_and_large_vectors(spark):
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2.0] * 64)]
    same = [(k, [0.25] * 64) for k in range(30)]
    # Whole numbers up to 2**30: distances near 2**62 stay exact; a longer vector is left out.
    large = [(k, [float(2**20) * (-1) ** k] + [float(k)] * 63) for k in range(12)]
    for rows in (few, same, large):
        got = centroid_clusters.digest(centroid_clusters.cluster(vectors(spark, rows, "double")))
        found = [tuple(r) for r in got.collect()]
        want = brute_clusters(rows if rows is not large else [r for r in rows if r[0] < 1])
        if rows is large:
            assert found and all(r[2] is not None for r in found)
        else:
            assert sorted(found, key=str) == want
    assert not centroid_clusters.cluster(vectors(spark, [(1, [1e300] * 64), (2, None)], "double")).count()
    assert not centroid_clusters.cluster(vectors(spark, [])).count()


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * rng.normal(0, 0.2, (600, 64))).astype(np.int64)
    x[:200] = x[300:500]  # ties
    for pivots, most in ((8, 8.0), (48, 5.0), (65, 1.5)):
        simplex = centroid_clusters.Simplex.of(x[:8], x[8:136], pivots)
        apex = simplex.apexes(x)
        centres = np.array([x[k::8].sum(0) // len(x[k::8]) for k in range(8)] + [x[5], x[5]])
        number, distance, made = centroid_clusters.nearest(x, apex, centres, simplex.apexes(centres))
        far = centroid_clusters.squared(x, centres)
        assert (number == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
        assert made <= most * len(x) * 10 / 8
        tops = simplex.apexes(centres)
        gaps = apex[:, None, :] - tops[None]
        low = (gaps**2).sum(2)
        high = (gaps[..., :-1] ** 2).sum(2) + (apex[:, -1:] + tops[:, -1]) ** 2
        assert (low <= far * (1 + 1e-6) + 1).all() and (high >= far * (1 - 1e-6) - 1).all()


def check_whitening(spark, rows, got, dims=64):
    kept = whole(rows, dims)
    x = np.floor(64 * np.array([v for _, v in kept], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    gaps = fit - sums / n
    values, turned = np.linalg.eigh(gaps.T @ gaps / n)
    values, turned = values[::-1], turned[:, ::-1]
    k = min(16, int((values > 1e-9 * values[0]).sum()))
    want = (x - sums / n) @ turned[:, :k] / np.sqrt(values[:k])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert len(got) == len(kept) * k and set(got.component) == set(range(1, k + 1))
    assert (got.n == n).all() and (got.identity_error < 1e-9).all()
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-9)
    key = got.vec_id.astype("float").fillna(-1)
    at = {int(i): number for number, (i, _) in enumerate((-1 if i is None else i, v) for i, v in kept)}
    place = key.astype(int).map(at).to_numpy()
    assert (got.deviation.to_numpy() == deviation[place]).all()
    flat = want[place, got.component.to_numpy() - 1]
    sign = np.array([np.sign((flat * got.whitened)[got.component == c].sum()) for c in range(1, k + 1)])
    assert np.abs(flat * sign[got.component - 1] - got.whitened).max() < 1e-7


def test_whitening_equals_direct_decomposition(spark):
    rows = invented(3)
    check_whitening(spark, rows, whitening.whiten(vectors(spark, rows)).toPandas())


def test_whitening_of_dependent_dimensions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        a, b, c = rng.integers(-50, 50, 3) / 4
        rows.append((k, [float(v) for v in (a, b, a + b, c, 2.0, a - c)]))
    got = whitening.whiten(vectors(spark, rows, "double")).toPandas()
    check_whitening(spark, rows, got, 6)
    assert got.component.max() == 3


def test_whitening_of_few_and_awkward_rows(spark):
    assert not whitening.whiten(vectors(spark, [])).count()
    assert not whitening.whiten(vectors(spark, [(1, None), (2, [])])).count()
    assert not whitening.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count()
    # Entries as large as allowed leave the deviation's longs: null, the rest stays right.
    large = [(1, [6e7, 1.0]), (2, [-6e7, 2.0]), (3, [5.0, -3.0]), (4, [1e300, 0.0])]
    got = whitening.whiten(vectors(spark, large, "double")).toPandas()
    assert set(got.vec_id) == {1, 2, 3} and got.deviation.isna().any() and (got.identity_error < 1e-9).all()


def test_exact_products_of_large_entries():
    rng = np.random.default_rng(9)
    d = rng.integers(-(1 << 33), 1 << 33, (40, 5))
    high, low = whitening.products(d)
    wide = d.astype(object)
    assert ((wide.T @ wide) == high.astype(object) * (1 << 31) + low.astype(object)).all()


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    basis, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    values = 10.0 ** -np.arange(9)
    turned = whitening.one_sided_jacobi(whitening.pivoted_cholesky(basis @ np.diag(values) @ basis.T))
    assert np.allclose((turned**2).sum(0), values, rtol=1e-6)
    inner = turned.T @ turned
    assert np.abs(inner - np.diag(inner.diagonal())).max() < 1e-15


PAGES = [
    (1, "http://a.example/1", "<p>same</p>"), (2, "http://a.example/2", "<p>same</p>"), (9, "http://a.example/9", "<p>same</p>"),
    (3, None, None), (4, "", ""), (None, "http://a.example/none", "<p>same</p>"), (None, None, "<p>alone</p>"),
    (5, "http://a.example/b c\r\nd%20e", "<p>é 日本 \x00\r\n\r\n end</p>\r\n\r\n"), (6, "http://a.example/6", "WARC/1.1\r\n" * 3),
    (7, "http://a.example/7", "<p>twice</p>"), (7, "http://a.example/7", "<p>twice</p>"), (8, "u", "long " * 400_000),
]


def pages(spark, rows):
    return clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)


def brute_records(rows, least=0):
    claim = {}
    for k, _, html in rows:
        key = html or ""
        claim[key] = max(claim.get(key, -(1 << 63)), -(1 << 63) if k is None else k)
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = len(data) < least or claim[html or ""] in (k, -(1 << 63))
        out.append((k, len(data), digest, "response" if first else "revisit", None if first else claim[html or ""]))
    return sorted(out, key=str)


def records(df):
    found = df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted([tuple(r) for r in found], key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_archives_of_awkward_pages(spark, tmp_path, least):
    manifest = warc_archive.write_archives(pages(spark, PAGES), str(tmp_path / "out"), least=least)
    back = warc_archive.read_archives(manifest, with_payload=True)
    assert records(back) == brute_records(PAGES, least)
    whole = {r.page_id: bytes(r.payload) for r in back.where("record_type = 'response' and page_id is not null").collect()}
    html = {k: (h or "").encode() for k, _, h in PAGES}
    assert all(html[k] == v for k, v in whole.items())
    urls = {r.page_id: r.url for r in back.collect()}
    assert urls[3] is None and urls[1] == "http://a.example/1" and urls[5] == "http://a.example/b%20c%0D%0Ad%20e"


def test_archives_carry_their_dictionary(spark, tmp_path):
    rows = [(k, f"http://h{k % 7}.example/{k}", f"<html><head><title>page {k}</title></head><body><p>{'word ' * (k % 40)}{k * k}</p></body></html>") for k in range(900)]
    manifest = warc_archive.write_archives(pages(spark, rows), f"file://{tmp_path}/out", archive_bytes=4096, dictionary_bytes=4096)
    assert records(warc_archive.read_archives(manifest)) == brute_records(rows)
    found = manifest.collect()
    assert len({r.archive for r in found}) > 3  # rolled over
    dictionaries = set()
    for name in {r.archive for r in found}:
        data = open(name.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        dictionaries.add(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        # Each record alone, from its place in the manifest, with the dictionary and nothing else.
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(list(dictionaries)[0]))
        for r in (r for r in found if r.archive == name):
            record = warc_archive.decode(reader.decompressobj().decompress(data[r.start : r.start + r.length]))
            assert record.page_id == r.page_id and record.record_type == r.record_type
    assert len(dictionaries) == 1 and dictionaries.pop()[:4] == b"\x37\xa4\x30\xec"


def test_broken_archives_are_noticed():
    data = b"payload"
    digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
    record = warc_archive.encode(warc_archive.Record(1, "u", data, 7, digest))
    with pytest.raises(ValueError, match="digest"):
        warc_archive.decode(record.replace(b"payload\r", b"changed\r"))
    with pytest.raises(ValueError, match="ends within"):
        list(warc_archive.frames(io.BytesIO(zstandard.ZstdCompressor().compress(record)[:-3])))


def test_archives_of_no_pages(spark, tmp_path):
    manifest = warc_archive.write_archives(pages(spark, []), str(tmp_path / "none"))
    assert not manifest.count() and not warc_archive.read_archives(manifest).count()


@pytest.mark.parametrize("name", ["op11_warc_archive", "op12_centroid_clusters"])
def test_queries_equal_their_sql(spark, name):
    from orderlens.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)[0]
    got, want = (d.sort_values(key).reset_index(drop=True).astype(object).where(lambda d: d.notna(), None) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
