import itertools
import math

import numpy as np

from creditweave.operators import dyads, graph, homophily, metrics, population, regress, resample


def _graph(seed, n=30, m=70):
    rng = np.random.default_rng(seed)
    return sorted({tuple(sorted(map(int, e))) for e in rng.integers(0, n, (m, 2)) if e[0] != e[1]})


def _df(spark, edges):
    return spark.createDataFrame([(u, v, 1.0 + (u * v) % 3) for u, v in edges], "u long, v long, w double")


def test_components_and_giant(spark):
    edges = _graph(1, 60, 40) + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    got = {r["node"]: r["component"] for r in graph.connected_components(_df(spark, edges)).collect()}
    assert got == parent
    assert graph.giant_component(_df(spark, edges)).count() == max(sum(parent[u] == c for u, _ in edges) for c in set(parent.values()))


def test_core_numbers_and_clustering(spark):
    edges = _graph(2)
    adj = {x: set() for e in edges for x in e}
    for u, v in edges:
        adj[u].add(v)
        adj[v].add(u)
    core, left, k = {}, {x: set(a) for x, a in adj.items()}, 0
    while left:
        x = min(left, key=lambda y: len(left[y]))
        k = max(k, len(left[x]))
        core[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    assert {r["node"]: r["coreness"] for r in graph.core_numbers(_df(spark, edges)).collect()} == core
    want = {x: sum(b in adj[a] for a, b in itertools.combinations(adj[x], 2)) for x in adj}
    assert {r["node"]: r["triangles"] for r in graph.clustering(_df(spark, edges)).collect()} == want
    esp = {(r["u"], r["v"]): r["esp"] for r in graph.shared_partners(_df(spark, edges)).collect()}
    assert esp == {(u, v): len(adj[u] & adj[v]) for u, v in edges}


def test_betweenness_of_a_path_and_pagerank(spark):
    path = [(i, i + 1) for i in range(6)]
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(_df(spark, path)).collect()}
    assert all(math.isclose(got[i], i * (6 - i) * 2 / (6 * 5)) for i in range(7))
    edges = _graph(3)
    pr = {r["node"]: r["pagerank"] for r in graph.pagerank(_df(spark, edges), rounds=60).collect()}
    ids = sorted(pr)
    a = np.zeros((len(ids),) * 2)
    for u, v in edges:
        a[ids.index(u), ids.index(v)] = a[ids.index(v), ids.index(u)] = 1.0 + (u * v) % 3
    x = np.full(len(ids), 1 / len(ids))
    for _ in range(60):
        x = 0.15 / len(ids) + 0.85 * (a / a.sum(0)) @ x
    assert np.allclose([pr[i] for i in ids], x)


def test_closed_forms_against_simulation(spark):
    rng = np.random.default_rng(11)
    n = 200
    edges = sorted({tuple(sorted(map(int, e))) for e in (rng.pareto(1.3, (900, 2)) * 20).astype(int) % n if e[0] != e[1]})
    labels = rng.random(n) < 0.3
    nodes = spark.createDataFrame([(i, "F" if labels[i] else "M") for i in range(n)], "artist_id long, gender string")
    e = spark.createDataFrame([(u, v, "all") for u, v in edges], "u long, v long, p string")
    row = {r["category"]: r for r in homophily.uniform_permutation(e, nodes, "gender", ["F"], ["p"]).collect()}["F"]
    ends = np.unique(np.array(edges))
    pos = {x: i for i, x in enumerate(ends.tolist())}
    i, j = np.array([pos[u] for u, _ in edges]), np.array([pos[v] for _, v in edges])
    lab = labels[ends]
    sim = np.array([(p[i] & p[j]).sum() for p in (rng.permutation(lab) for _ in range(20_000))])
    assert abs(sim.mean() - row["expected"]) < 4 * sim.std() / math.sqrt(len(sim))
    assert abs(sim.std() / row["sd"] - 1) < 0.03
    strat = {r["category"]: r for r in homophily.stratified_permutation(e, nodes, "gender", ["F"], ["p"]).collect()}["F"]
    st = {r["degree"]: r["stratum"] for r in homophily.degree_strata(homophily.degrees(e, ["p"]), ["p"]).collect()}
    strata = np.array([st[d] for d in np.bincount(np.concatenate([i, j]))])
    assert np.bincount(strata).min() >= 30
    sim = []
    for _ in range(5000):
        p = lab.copy()
        for s in set(strata):
            p[strata == s] = rng.permutation(p[strata == s])
        sim.append((p[i] & p[j]).sum())
    assert abs(np.mean(sim) - strat["expected"]) < 4 * np.std(sim) / math.sqrt(len(sim))


def test_assortativity_is_independent_of_ids(spark):
    edges = _graph(5)
    nodes = [(i, "ab"[i % 2]) for i in range(30)]
    a = homophily.assortativity(homophily.mixing(homophily.edge_classes(_df(spark, edges), spark.createDataFrame(nodes, "artist_id long, g string"), "g"))).first()["r"]
    moved = [tuple(sorted((997 - u, 997 - v))) for u, v in edges]
    b = homophily.assortativity(homophily.mixing(homophily.edge_classes(_df(spark, moved), spark.createDataFrame([(997 - i, c) for i, c in nodes], "artist_id long, g string"), "g"))).first()["r"]
    assert math.isclose(a, b)


def test_class_pairs_give_the_logit_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    n = 120
    nodes = [(i, "F" if rng.random() < 0.3 else "M", "xyz"[int(rng.integers(3))], int(rng.integers(3)), int(rng.integers(1, 9))) for i in range(n)]
    x, y, edges = [], [], []
    for a, b in itertools.combinations(nodes, 2):
        row = [1, (a[1] == b[1] == "F"), (a[1] == b[1] == "M"), a[2] == b[2], a[3] == b[3], math.log(a[4] * b[4])]
        eta = -4 + 1.0 * row[1] + 0.3 * row[2] + 1.2 * row[3] + 0.4 * row[4] + 0.3 * row[5]
        hit = rng.random() < 1 / (1 + math.exp(-eta))
        x.append(row)
        y.append(hit)
        if hit:
            edges.append((a[0], b[0]))
    beta, se, ll = dyads.newton(np.array(x, float), np.array(y, float), np.ones(len(y)))
    got = dyads.exact_logit(spark.createDataFrame(nodes, "artist_id long, gender string, genre string, cohort int, n_release long"), spark.createDataFrame(edges, "u long, v long")).collect()
    assert np.allclose([r["coef"] for r in got], beta, atol=1e-6) and np.allclose([r["se"] for r in got], se, atol=1e-6)
    assert math.isclose(got[0]["log_likelihood"], ll, rel_tol=1e-9) and got[0]["n_pairs"] == n * (n - 1) // 2


def test_ols_hc3_and_tails(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), rng.normal(size=300), rng.random(300) < 0.2])
    y = x @ [1, 2, -0.4] + rng.normal(size=300) * (1 + abs(x[:, 1]))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (_, a, b), c in zip(x, y)], "a double, b double, y double")
    beta, cov, _, n = regress.ols(df, "y", ["a", "b"])
    inv = np.linalg.inv(x.T @ x)
    want = inv @ x.T @ y
    e = (y - x @ want) / (1 - np.einsum("ij,jk,ik->i", x, inv, x))
    assert n == 300 and np.allclose(beta, want) and np.allclose(cov, inv @ (x.T * e**2) @ x @ inv)
    assert math.isclose(regress.chi2_p(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(regress.chi2_p(18.307038, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(regress.normal_p(1.959963984540054), 0.05, rel_tol=1e-9)


def test_swaps_keep_degrees():
    rng = np.random.default_rng(42)
    pairs = np.array(sorted({(int(a), r) for r in range(200) for a in rng.integers(0, 100, int(rng.integers(2, 9)))}))
    a, r = resample.swap(pairs[:, 0], pairs[:, 1], 5, rng)
    assert np.array_equal(np.bincount(a), np.bincount(pairs[:, 0])) and np.array_equal(np.bincount(r), np.bincount(pairs[:, 1]))
    after = set(zip(a.tolist(), r.tolist()))
    assert len(after) == len(pairs) and len(after & set(map(tuple, pairs.tolist()))) < 0.7 * len(pairs)


def test_shuffle_keeps_counts_of_strata(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(90)], "id long, label string, s int")
    out = regress.stratified_shuffle(df, "id", "label", ["s"], 4)
    count = lambda d: sorted(map(tuple, d.groupBy("s", "label").count().collect()))
    assert count(out) == count(df)


def test_quintiles_and_bins(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(13)], "id long, x double")
    n = {r["quintile"]: r["count"] for r in population.rank_quintile(df, "x", "id").groupBy("quintile").count().collect()}
    assert [n[k] for k in range(1, 6)] == [3, 2, 3, 2, 3]
    b = [r[0] for r in spark.createDataFrame([(0.5,), (0.51,), (0.0,), (None,)], "v double").select(metrics.bins(__import__("pyspark").sql.functions.col("v"), [0, 0.5, 1])).collect()]
    assert b == ["0-0.5", "0.5-1", None, None]
