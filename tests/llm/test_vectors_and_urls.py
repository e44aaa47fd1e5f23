"""Vector operators against brute force, URL verdicts along links, components, and edge rows of each."""

import numpy as np
from pyspark.sql import functions as F

from chronoweave.llm import crosspoly, itq, urls
from chronoweave.llm.common import components

VECTORS = "vec_id long, embedding array<float>, label int, code string"
ODD = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 0.01], 1), (7, [1.0, 0.01], None), (None, [1.0, 0.0], 1), (8, [1.0, 0.01], 2), (9, [1.0], 1), (10, [], 1), (11, [float("inf"), 1.0], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], VECTORS)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.03 * rng.standard_normal((20, 16)), np.repeat(base[:1], 5, 0)]).astype(np.float32)
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(x)]
    got = {r.vec_id: r for r in itq.near_vectors(frame(spark, rows), block=8).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    met = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None, :] % 2)
    np.fill_diagonal(met, False)
    least = np.arange(len(x))
    for _ in range(len(x)):
        least = np.array([min([least[k], *least[met[k]]]) for k in range(len(x))])
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (met[k].sum(), least[k], least[k] == k)


def test_wide_tables_find_the_same_links(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 24))
    x = np.concatenate([base, base + 0.12 * rng.standard_normal((300, 24))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    met = u @ u.T >= 0.98
    np.fill_diagonal(met, False)
    assert met.sum() > 300
    df = frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])
    got = {r.vec_id: r.n_links for r in itq.near_vectors(df, table_bits=14).collect()}
    assert [got[k] for k in range(len(x))] == met.sum(1).tolist()
    assert itq.shape(1_000, 0.98, 512) == (8, 8) and itq.shape(1 << 30, 0.98, 512)[0] == 21
    assert itq.shape(10, 1.0, 512) == (8, 8)


def test_near_vectors_edges(spark):
    rows = itq.near_vectors(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert {(r.vec_id, r.n_links, r.component_id) for r in rows if r.n_links} == {(1, 2, 1), (6, 2, 1)}
    assert all(r.kept for r in rows if r.vec_id != 6)
    assert itq.near_vectors(frame(spark, ODD).limit(0)).count() == 0


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])
    got = {}
    for r in crosspoly.nearest(df, F.col("id") % 20 == 0, 20, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    hits = []
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -9
        best = np.lexsort((np.arange(400), -s))[:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hits.append(len(set(best) & {f[1] for f in found}) / 20)
    assert np.mean(hits) >= 0.9
    few = frame(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (20, None, 0), (3, [0.0, 0.0], 0)])
    assert [(r.query_id, r.rank, r.vec_id) for r in crosspoly.nearest(few, F.col("id") % 20 == 0, 20).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert crosspoly.nearest(few.limit(0), F.col("id") % 20 == 0, 20).count() == 0


def test_probes_are_the_nearest_cells_of_several_polytopes():
    x = np.random.default_rng(11).standard_normal((20, 20))
    for bits in (0, 1, 3, 6, 8):
        widths = [6, min(bits, 6), max(0, bits - 6)]
        near, names = np.zeros((20, 1)), np.zeros((20, 1), int)
        for part, w in enumerate(w for w in widths if w):
            y = crosspoly.rotated(x / np.linalg.norm(x, axis=1, keepdims=True), 2, 9 + part)[:, : 1 << (w - 1)]
            signed = np.stack([y, -y], 2).reshape(20, -1)
            near = (near[:, :, None] + signed[:, None, :]).reshape(20, -1)
            names = (names[:, :, None] * signed.shape[1] + np.arange(signed.shape[1])).reshape(-1, near.shape[1])
        want = np.take_along_axis(names, np.argsort(-near, axis=1, kind="stable")[:, :9], 1)
        assert crosspoly.cells(x, 2, 9, bits).tolist() == want.tolist()
        assert crosspoly.cells(x, 2, 1, bits)[:, 0].tolist() == want[:, 0].tolist()
        assert crosspoly.cells(x, 2, 100, bits).shape == (20, min(100, 1 << (6 + bits)))


def test_cells_grow_with_the_vectors_of_a_length(spark):
    rows = spark.createDataFrame([(64, 51_282), (64, 65_536), (64, 65_537), (64, 1 << 33), (1, 1), (2, 2_049), (3, 4_097), (65, 1 << 17)], "d int, n long")
    assert [r[0] for r in rows.select(crosspoly.cell_bits(F.col("d"), F.col("n"), 512)).collect()] == [0, 0, 1, 17, 0, 1, 1, 0]
    assert crosspoly.effort(0, 8, 16) == (8, 16) and crosspoly.effort(7, 8, 16) == (24, 26)


def test_neighbours_in_cells_of_several_polytopes(spark):
    rng = np.random.default_rng(12)
    x = (np.repeat(rng.standard_normal((40, 16)), 30, 0) + 0.15 * rng.standard_normal((1200, 16))).astype(np.float32)
    x[600] = -x[:600].sum(0)
    df = frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])
    got = {}
    for r in crosspoly.nearest(df, F.col("id") % 20 == 0, 20, block=64, cell_rows=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x, hits = x.astype(float), []
    for q in range(0, 1200, 20):
        s = x @ x[q]
        s[q] = -np.inf
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hits.append(len(set(np.argsort(-s)[:20]) & {f[1] for f in found}) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_hundreds_of_equal_vectors(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(rng.standard_normal((1, 16)), 300, 0), rng.standard_normal((100, 16))]).astype(np.float32)
    ids = rng.permutation(400)
    df = frame(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)])
    asked = int(max(ids[:300]))
    got = [r.vec_id for r in crosspoly.nearest(df, F.col("id") == asked, 20).orderBy("rank").collect()]
    assert got == sorted(ids[:300].tolist())[:20]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {2000: 2000, 2001: 2000}


def test_blocks_reach_aliases_but_not_explicit_allows(spark):
    canonical = lambda u: f'<link rel="canonical" href="{u}">'
    pages = [
        (1, "https://a.example.org/x#t", canonical("https://b.net/y")),
        (2, "https://c.org/z", '<META http-equiv=refresh content="0; url=https://a.example.org/x">'),
        (3, "https://d.org/fr/1", canonical("https://b.net/y")),
        (4, "HTTP://X.Example.NET/en/1", None),
        (5, None, "x"),
        (6, "nothing", ""),
        (7, "https://far.org/q", canonical("/other")),
        (1, "https://a.example.org/x#t", canonical("https://b.net/y")),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, node string")
    rows = [(r.page_id, r.rule, r.verdict) for r in urls.judge(df).collect()]
    assert len(rows) == 8 and set(rows) == {(1, None, "block"), (2, None, "block"), (3, "org/fr/", "allow"), (4, "example.net/en/", "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow")}
    assert urls.judge(df.limit(0)).count() == 0


def test_references_are_resolved_and_resources_named_alike(spark):
    from urllib.parse import urljoin

    base = "http://a.org/b/c/d;p?q"
    refs = ["g", "./g", "g/", "/g", "//g.org", "?y", "g?y", ";x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g?y/../x"]
    rows = [(r, base, urljoin(base, r)) for r in refs] + [("g", "http://a.org", "http://a.org/g"), ("http://X.org/a/../b", base, "http://x.org/b")]
    for r in spark.createDataFrame(rows, "ref string, url string, want string").withColumn("to", urls.resource(urls.resolved(F.col("ref"), F.col("url")))).collect():
        assert r.to == r.want, r
    texts = ["a&amp;b", "&#38;&#x26;&#128512;&lt", "&copy=1&copy;&nosuch;&", "plain"]
    got = [r.d for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", urls.decoded(F.col("t")).alias("d")).orderBy("k").collect()]
    assert got == ["a&b", "&&😀<", "&copy=1©&nosuch;&", "plain"]
    link = lambda u: f'<link rel="canonical" href="{u}">'
    pages = [
        (1, "https://a.org/x/1.html", link("page2.html")),
        (2, "https://a.org/x/page2.html", link("../y?p=1&amp;q=2")),
        (3, "HTTPS://A.org/y?p=1&q=2", link("https://B.net/z")),
        (4, "https://a.org/y", '<meta http-equiv="refresh" content="0; url=?p=1&amp;q=2">'),
        (5, "https://a.org/other", link("?p=3")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_neighbours_of_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (7, [0.5, 0.5], 0)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in crosspoly.nearest(frame(spark, rows), F.col("id") == 0, 3).collect()]
    want = [(0, 1, 0, 1.0), (0, 2, 5, 1.0), (0, 3, 7, 0.5)]
    assert sorted(got) == sorted(want * 2)
