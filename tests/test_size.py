import itertools

import numpy as np

from creditweave.operators import adjacency, graph


def _random(seed, n=60, m=150):
    rng = np.random.default_rng(seed)
    return sorted({tuple(sorted(map(int, e))) for e in rng.integers(0, n, (m, 2)) if e[0] != e[1]})


def test_betweenness_has_no_bound_of_edges(spark):
    """A complete graph of 5.4 million edges, more than were once accepted; no path of it passes a node."""
    n = 3300
    e = spark.range(n).selectExpr("id as u", f"explode(sequence(0, {n - 1})) as v").where("u < v")
    got = graph.betweenness(e, sources=2).selectExpr("count(*) as n", "max(betweenness) as most").first()
    assert (got["n"], got["most"]) == (n, 0.0)


def test_betweenness_over_parts_and_components(spark):
    edges = _random(3) + [(100, 101), (101, 102)]
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    giant, left = set(), set(near)
    while left:
        seen, front = set(), {next(iter(left))}
        while front:
            seen |= front
            front = set().union(*(near[x] for x in front)) - seen
        giant, left = max(giant, seen, key=len), left - seen

    def paths(s):
        dist, count, front = {s: 0}, {s: 1}, [s]
        while front:
            new = []
            for x in front:
                for y in near[x]:
                    if y not in dist:
                        dist[y], count[y] = dist[x] + 1, 0
                        new.append(y)
                    if dist[y] == dist[x] + 1:
                        count[y] += count[x]
            front = new
        return dist, count

    all_ = {s: paths(s) for s in giant}
    want = dict.fromkeys(giant, 0.0)
    for s, t in itertools.combinations(sorted(giant), 2):
        for x in giant - {s, t}:
            if all_[s][0][x] + all_[t][0][x] == all_[s][0][t]:
                want[x] += all_[s][1][x] * all_[t][1][x] / all_[s][1][t]
    df = spark.createDataFrame(edges, "u long, v long")
    g = adjacency.adjacency(df, simple=True, arcs=40, chunk=7).giant()
    assert g.parts > 4
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(g, held=g.n * 5).collect()}
    k = len(giant)
    assert set(got) == giant and all(abs(got[x] - want[x] * 2 / ((k - 1) * (k - 2))) < 1e-12 for x in giant)


def test_centralities_read_edges_from_files_only(spark, monkeypatch):
    """A step is no join of Spark: with checkpoints refused the same figures come out as by brute force, over several parts and for the largest component."""
    edges = [e for e in _random(5, 30, 70)]
    nodes = sorted({x for e in edges for x in e})
    a = np.zeros((len(nodes),) * 2)
    for u, v in edges:
        a[nodes.index(u), nodes.index(v)] = a[nodes.index(v), nodes.index(u)] = 1.0 + (u * v) % 3
    df = spark.createDataFrame([(u, v, 1.0 + (u * v) % 3) for u, v in edges] + [(900, 901, 5.0)], "u long, v long, w double")
    monkeypatch.setattr(graph, "cut", None)
    g = adjacency.adjacency(df, "w", arcs=30, chunk=7).giant()
    inside = [int(x) in set(g.ids[g.inside].tolist()) for x in nodes]
    a, nodes = a[np.ix_(inside, inside)], [x for x, i in zip(nodes, inside) if i]
    rank = np.linalg.solve(np.eye(len(nodes)) - 0.85 * a / a.sum(0), np.full(len(nodes), 0.15 / len(nodes)))
    lead = np.abs(np.linalg.eigh(a)[1][:, -1])
    for f, name, want in ((lambda x: graph.pagerank(x, rounds=1000, tolerance=1e-12), "pagerank", rank), (graph.eigenvector, "eigenvector", lead)):
        got = {r["node"]: r[name] for r in f(g).collect()}
        assert set(got) == set(nodes) and np.allclose([got[x] for x in nodes], want, atol=1e-7), name
    near = {x: {y for e in edges for y in e if x in e and y != x} for x in nodes}
    core, left, k = {}, {x: set(y) for x, y in near.items()}, 0
    while left:
        x = min(left, key=lambda y: len(left[y]))
        k = max(k, len(left[x]))
        core[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    s = adjacency.adjacency(df, simple=True, arcs=30, chunk=7).giant()
    assert {r["node"]: r["coreness"] for r in graph.core_numbers(s).collect()} == core


def test_credits_of_swaps_stay_off_the_driver(spark, monkeypatch):
    """Neither rows nor Arrow tables of the credits are asked for; periods that are null belong to the whole only."""
    import pyspark.sql
    from creditweave.operators import resample

    rng = np.random.default_rng(2)
    rows = sorted({(int(a), int(r)) for a, r in rng.integers(0, 30, (200, 2))})
    df = spark.createDataFrame([(a, r, None if r % 3 == 0 else 2000 + r % 3) for a, r in rows], "a long, r long, period int")

    def refuse(*_):
        raise AssertionError("credits at the driver")

    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(type(df), name, refuse)

    def figures(a, r, s):
        import pandas as pd

        return pd.DataFrame({"n": [len(a)], "n_distinct": [len(set(zip(a.tolist(), s.tolist())))], "same": [bool((np.sort(r) == np.sort(s)).all())]})

    got = {(x["period"], x["replica"]): x for x in resample.over_swaps(df, figures, "n long, n_distinct long, same boolean", replicas=2, whole=2).collect()}
    size = {None: len(rows), **{2000 + k: sum(r % 3 == k for _, r in rows) for k in (1, 2)}}
    assert set(got) == {(p, b) for p in size for b in (-1, 0, 1)}
    assert all(x["n"] == x["n_distinct"] == size[p] and x["same"] for (p, _), x in got.items())


def test_taken_credits():
    from creditweave.operators import resample

    rng = np.random.default_rng(4)
    for size in (3, 50, 4000):
        there, traded = np.unique(rng.integers(0, 4 * size, size)), rng.integers(0, 4 * size, size)
        kind, times = np.unique(traded, return_counts=True)
        want = np.isin(traded, there) | np.isin(traded, kind[times > 1])
        assert np.array_equal(resample._taken(there, traded), want)


def test_queries_of_betweenness_follow_sources_in_files(spark, monkeypatch):
    """GRF9 and REG9 pass files of an adjacency, not edges that are checkpointed and broadcast."""
    from creditweave.queries import models, network

    class Seen(Exception):
        pass

    def seen(g, sources=None, **_):
        raise Seen(type(g).__name__, sources)

    df = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (8, 9, 1.0)], "u long, v long, w double")
    monkeypatch.setattr(network, "GRF1_projection", lambda *_: df)
    monkeypatch.setattr(graph, "betweenness", seen)
    for f, sources in ((models.GRF9_betweenness_exact, None), (models.REG9_sampled_betweenness, 400)):
        try:
            f(spark, "")
        except Seen as e:
            assert e.args == ("Adjacency", sources)


def test_key_figures_join_edges_once(spark, monkeypatch):
    """Each r was a join of all edges with their nodes of its own; now all come from one table of classes, with the same values."""
    from creditweave.operators import homophily
    from creditweave.queries import more

    e = spark.createDataFrame([(u, v, 1.0 + (u * v) % 3) for u, v in _random(6, 40, 120)], "u long, v long, w double")
    n = spark.createDataFrame([(i, "F" if i % 3 == 0 else "unknown" if i % 7 == 0 else "M", None if i % 11 == 0 else "ab"[i % 2]) for i in range(39)], "artist_id long, gender string, genre string")
    classes = homophily.edge_classes
    r = lambda x, attr, weight=None: homophily.assortativity(homophily.mixing(classes(e, x, attr), weight=weight)).first()["r"]
    want = [r(n, "gender"), r(n.where("gender in ('F', 'M')"), "gender"), r(n, "gender", "w"), r(n, "genre")]

    def refuse(*_, **__):
        raise AssertionError("another join of the edges")

    monkeypatch.setattr(homophily, "edge_classes", refuse)
    got = more.key_figures(e, n).first()
    assert np.allclose([got[c] for c in ("r_gender", "r_gender_known", "r_gender_weighted", "r_genre")], want, atol=1e-12)


def _brandes(edges):
    """Sums of the shortest paths through each node over all sources, by the book."""
    near = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        dist, count, order = {s: 0}, {s: 1}, [s]
        for x in order:
            for y in near[x]:
                if y not in dist:
                    dist[y], count[y] = dist[x] + 1, 0
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    count[y] += count[x]
        dep = dict.fromkeys(order, 0.0)
        for y in reversed(order[1:]):
            for x in near[y]:
                if dist[x] == dist[y] - 1:
                    dep[x] += count[x] / count[y] * (1 + dep[y])
            want[y] += dep[y]
    return want


def _chain_and_star(spark):
    """A hub of 300 leaves and a chain of 150, so that levels, a long list and small fronts all occur, beside another component."""
    edges = [(0, i) for i in range(1, 301)] + [(i, i + 1) for i in range(300, 450)] + [(1, 450), (900, 901)]
    return spark.createDataFrame(edges, "u long, v long"), {x: y for x, y in _brandes(edges).items() if x < 900}


def test_sources_of_betweenness_run_side_by_side(spark, monkeypatch):
    """GRF9 and REG9 followed their sources in one job a task, one after the other; now they are tasks of one job."""
    from pyspark import RDD

    df, want = _chain_and_star(spark)
    g = adjacency.adjacency(df, simple=True).giant()
    one_by_one, foreach, tasks = [], RDD.foreach, []
    monkeypatch.setattr(RDD, "toLocalIterator", lambda self, *_: one_by_one.append(self) or iter(self.collect()))
    monkeypatch.setattr(RDD, "foreach", lambda self, f: tasks.append(self.getNumPartitions()) or foreach(self, f))
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(g).collect()}
    k = len(want)
    assert set(got) == set(want) and all(abs(got[x] - want[x] / ((k - 1) * (k - 2))) < 1e-12 for x in want)
    assert not one_by_one and len(tasks) == 1 and tasks[0] > 4


def test_betweenness_leaves_no_sums_behind(spark):
    """Sums of the tasks go once they are added, and other components than the largest are not read."""
    import os

    df, want = _chain_and_star(spark)
    g = adjacency.adjacency(df, simple=True).giant()
    at = g.at.removeprefix("file://")
    before = sorted(os.listdir(at))
    graph.betweenness(g, sources=40)
    assert sorted(os.listdir(at)) == before
    s = np.flatnonzero(g.inside)
    for rows, piece, batch in ((2048, 1_000_000, 32), (64, 10, 150), (1, 1, 450)):
        got = graph.brandes(g.at, g.n, g.width, s, batch, g.inside, rows, piece)
        assert np.allclose(got[g.inside], [want[int(x)] for x in g.ids[g.inside]], rtol=1e-12) and not got[~g.inside].any()


def test_regression_on_betweenness_is_one_job_of_sources(spark, monkeypatch, tmp_path):
    """REG9 from its tables: the sources are followed in one job, and the coefficients are those of least squares on betweenness by the book."""
    from pyspark import RDD

    from creditweave.queries import models, network

    rng, base = np.random.default_rng(8), str(tmp_path)
    rows = {
        "lineitem": ([(int(p), int(o), i, "ANR"[i % 3]) for i, (p, o) in enumerate(rng.integers(0, (120, 90), (300, 2)))], "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string"),
        "orders": ([(o, f"{1995 + o % 5}-01-01") for o in range(90)], "o_orderkey long, o_orderdate string"),
        "part": ([(p, p % 50, "ABC"[p % 3 if p > 9 else p % 2] + " X") for p in range(120)], "p_partkey long, p_size int, p_type string"),
    }
    for name, (r, s) in rows.items():
        d = spark.createDataFrame(r, s)
        (d.selectExpr("o_orderkey", "date(o_orderdate) as o_orderdate") if name == "orders" else d).write.parquet(f"{base}/{name}.parquet")
    by_the_book = _brandes([(r["u"], r["v"]) for r in network.GRF1_projection(spark, base).collect()])
    foreach, tasks = RDD.foreach, []
    monkeypatch.setattr(RDD, "foreach", lambda self, f: tasks.append(self.getNumPartitions()) or foreach(self, f))
    got = {r["term"]: r for r in models.REG9_sampled_betweenness(spark, base).collect()}
    assert len(tasks) == 1
    d = network.known(spark, base).toPandas().set_index("artist_id")
    d = d[d.index.isin(by_the_book)].sort_index()
    k = len(by_the_book)
    b = np.array([by_the_book[x] for x in d.index]) / ((k - 1) * (k - 2))
    rare = d["genre"].map(d["genre"].value_counts()) < 20
    d.loc[rare, "genre"] = "Other"
    terms = [c for c in got if c.startswith("genre[")]
    assert {c[6:-1] for c in terms} == set(d["genre"]) - {min(d["genre"])}
    x = np.column_stack([np.ones(len(d)), d["gender"] == "F", *[d["genre"] == c[6:-1] for c in terms], np.log(d["n_release"].clip(lower=1))])
    want = dict(zip(["intercept", "female", *terms, "log_n"], np.linalg.lstsq(x.astype(float), np.log1p(b * 1e6), rcond=None)[0]))
    assert all(got[c]["n"] == len(d) and abs(got[c]["coef"] - want[c]) < 1e-8 for c in want)


def test_regression_on_betweenness_needs_no_weights(spark, monkeypatch):
    """REG9 summed and rounded the weights of all pairs and then dropped them; its pairs are still those of the projection, with casts too large or of no member, and keys that come in many chunks."""
    import random

    from creditweave.operators import project
    from creditweave.queries import network

    rng = random.Random(1)
    some = lambda share, x: None if rng.random() < share else x
    rows = [(some(0.02, rng.randrange(-3, 200)), some(0.02, rng.randrange(150)), some(0.5, f"t{rng.randrange(120)}"), "main") for _ in range(900)]
    rows += [(i % 50, 7, "t7", "main") for i in range(1000)] + [(5, 999, None, "main")] * 100 + [(6, 999, None, "main")]
    df = spark.createDataFrame(rows, "artist_id long, release_id long, track_key string, scope string").repartition(3)
    for most in (8, 2):
        want = {(r["u"], r["v"]) for r in project.project(df, project.Weights(most=most)).collect() if r["u"] is not None}
        for chunk in (500_000, 37):
            assert {(r["u"], r["v"]) for r in project.links(df, most, chunk).collect()} == want
    assert project.links(df.where("false")).count() == 0
    want = {x for r in project.project(df).collect() if r["u"] is not None for x in (r["u"], r["v"])}

    def refuse(*_):
        raise AssertionError("weights that nobody reads")

    monkeypatch.setattr(project, "project", refuse)
    monkeypatch.setattr(network, "credits", lambda *_: df)
    assert set(network._adjacency(spark, "").ids.tolist()) == want


def test_a_source_alone_gives_the_sums_of_a_batch(spark):
    df, want = _chain_and_star(spark)
    rng = np.random.default_rng(7)
    dense = spark.createDataFrame(sorted({(int(min(e)), int(max(e))) for e in rng.integers(0, 80, (900, 2)) if e[0] != e[1]}), "u long, v long")
    for edges in (df, dense):
        g = adjacency.adjacency(edges, simple=True, arcs=300).giant()
        s = np.flatnonzero(g.inside)
        one, side_by_side = (graph.brandes(g.at, g.n, g.width, s, k, g.inside) for k in (1, 32))
        assert g.parts > 1 and np.allclose(one, side_by_side, rtol=1e-12)
    g = adjacency.adjacency(df, simple=True).giant()
    assert np.allclose(graph.brandes(g.at, g.n, g.width, np.flatnonzero(g.inside), 1, g.inside)[g.inside], [want[int(x)] for x in g.ids[g.inside]], rtol=1e-12)
