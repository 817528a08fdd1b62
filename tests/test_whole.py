import datetime

import numpy as np
import pytest

from creditweave.operators import graph, resample
from creditweave.queries import network as q

CASTS = {1: (1995, [1, 2, 3]), 2: (1996, [3, 4]), 3: (1997, [4, 5]), 4: (1998, [1, 5]), 5: (1999, [6, 7]), 6: (2000, [2, 5]), 7: (2001, [1, 3])}
ALL = {(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (1, 5), (2, 5), (6, 7)}
GIANT = ALL - {(6, 7)}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """Seven artists and a release in each year, as order tables."""
    at = str(tmp_path_factory.mktemp("casts"))
    lines = [(a, r, i + 1, "N") for r, (_, cast) in CASTS.items() for i, a in enumerate(cast)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(r, datetime.date(y, 5, 1)) for r, (y, _) in CASTS.items()], "o_orderkey long, o_orderdate date").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(a, 10 if a % 2 else 3, "STANDARD X") for a in range(1, 8)], "p_partkey long, p_size int, p_type string").write.parquet(f"{at}/part.parquet")
    return at


def _near(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return near


def test_measures_take_edges_of_all_years(spark, base):
    near = _near(GIANT)
    assert {r["node"]: r["coreness"] for r in q.GRF8_coreness(spark, base).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2}
    for f in (q.GRF10_betweenness, q.GRF11_eigenvector, q.GRF12_pagerank, q.GRF13_non_backtracking):
        assert {r["node"] for r in f(spark, base).collect()} == set(near)
    tri = {x: sum((b in near[a]) for a in near[x] for b in near[x] if a < b) for x in near}
    assert {r["node"]: r["triangles"] for r in q.GRF14_clustering_whole(spark, base).collect()} == tri
    assert q.GRF16_localisation(spark, base).first()["n"] == len(near)
    assert {(r["u"], r["v"]) for r in q.GRF20_snowball(spark, base).collect()} == GIANT


def test_shared_partners_take_releases_of_all_years(spark, base):
    near = _near(ALL)
    got = {(r["u"], r["v"]): r for r in q.GRF17_shared_partners_whole(spark, base).collect()}
    assert {e: r["esp"] for e, r in got.items()} == {(u, v): len(near[u] & near[v]) for u, v in ALL}
    shared = lambda u, v: [set(c) for _, c in CASTS.values() if {u, v} <= set(c)]
    assert all((r["n_shared"], r["esp_explained"]) == (len(shared(*e)), len(set().union(*shared(*e)) - set(e))) for e, r in got.items())
    assert q.GRF18_summary_whole(spark, base).first()["n_edges"] == len(ALL)
    assert sum(r["n"] for r in q.AGG27_esp_histogram_whole(spark, base).collect()) == len(ALL)
    assert sum(r["n"] for r in q.AGG28_ceiling_whole(spark, base).collect()) == len(ALL)


def test_components_take_edges_of_all_years(spark, base):
    assert {r["node"]: r["component"] for r in q.GRF7_components(spark, base).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}


def test_swaps_of_each_year_and_of_all(spark, base):
    years = {y for y, _ in CASTS.values()}
    jobs = {(None, b) for b in range(-1, 20)} | {(y, b) for y in years for b in range(-1, 100)}
    got = {(r["period"], r["replica"]): r for r in q.NUL14_swaps(spark, base).collect()}
    assert set(got) == jobs
    assert all(r["n"] == r["n_distinct"] == (15 if p is None else 3 if p == 1995 else 2) and r["same_degrees"] for (p, _), r in got.items())
    assert all(r["unchanged"] == r["n"] for (_, b), r in got.items() if b < 0) and min(r["unchanged"] for r in got.values() if r["period"] is None) < 15
    near, hist = _near(ALL), {}
    for r in q.NUL15_reprojection(spark, base).collect():
        hist.setdefault((r["period"], r["replica"]), {})[r["esp"]] = r["n"]
    esp = [len(near[u] & near[v]) for u, v in ALL]
    assert set(hist) == jobs and hist[None, -1] == {k: esp.count(k) for k in set(esp)}


def test_histogram_of_a_projection():
    rng = np.random.default_rng(8)
    pairs = np.array(sorted({(int(a), r) for r in range(60) for a in rng.integers(0, 40, int(rng.integers(1, 8)))}))
    edges = {(u, v) for r in range(60) for u in pairs[pairs[:, 1] == r, 0] for v in pairs[pairs[:, 1] == r, 0] if u < v}
    near = _near(edges)
    want = np.bincount([min(6, len(near[u] & near[v])) for u, v in edges], minlength=7)
    assert np.array_equal(resample.esp_histogram(pairs[:, 0], pairs[:, 1], 6, 50), want)


def _slow_graph():
    """Two cliques of 5 and 4 joined by a path: rank and eigenvector mix slowly."""
    one = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    two = [(i, j) for i in range(9, 13) for j in range(i + 1, 13)]
    return one + two + [(i, i + 1) for i in range(4, 9)]


def test_iterations_end_when_they_converge(spark):
    edges = _slow_graph()
    df = spark.createDataFrame([(u, v, 1.0) for u, v in edges], "u long, v long, w double")
    a = np.zeros((13, 13))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    n, d = 13, a.sum(1)
    lead = lambda m: (lambda val, vec: vec[:, np.argmax(val.real)].real)(*np.linalg.eig(m))
    unit = lambda x: np.abs(x) / np.linalg.norm(x)
    nb = lead(np.block([[a, np.eye(n) - np.diag(d)], [np.eye(n), np.zeros((n, n))]]))[:n]
    nb = np.clip(nb * np.sign(nb.sum()), 0, None)
    pr = np.linalg.solve(np.eye(n) - 0.85 * a / d, np.full(n, 0.15 / n))
    for f, name, want in ((graph.eigenvector, "eigenvector", unit(lead(a))), (graph.non_backtracking, "nonbacktracking", nb / np.linalg.norm(nb)), (lambda e: graph.pagerank(e, rounds=1000, tolerance=1e-10), "pagerank", pr)):
        got = {r["node"]: r[name] for r in f(df).collect()}
        assert np.allclose([got[i] for i in range(n)], want, atol=1e-7), name
    for f in (lambda: graph.eigenvector(df, rounds=4), lambda: graph.non_backtracking(df, rounds=4), lambda: graph.pagerank(df, rounds=4, tolerance=1e-10)):
        with pytest.raises(RuntimeError, match="after 4 rounds"):
            f()


def test_snowball_starts_inside_the_graph(spark, tmp_path):
    """Artist 1 has no edge at all, so a snowball from it is empty."""
    casts = {1: [1], 2: [11, 12], 3: [12, 13], 4: [12, 14]}
    spark.createDataFrame([(a, r, i + 1, "N") for r, c in casts.items() for i, a in enumerate(c)], "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r["u"], r["v"]) for r in q.GRF20_snowball(spark, str(tmp_path)).collect()} == {(11, 12), (12, 13), (12, 14)}


def test_sample_sizes_are_the_reference_s(spark, base, monkeypatch):
    seen = {}
    monkeypatch.setattr(graph, "betweenness", lambda e, sources=None, **_: seen.update(sources=sources))
    monkeypatch.setattr(graph, "snowball", lambda e, start, most: seen.update(start=start, most=most))
    q.GRF10_betweenness(spark, base)
    q.GRF20_snowball(spark, base)
    assert seen == {"sources": 400, "start": [1], "most": 1500}
