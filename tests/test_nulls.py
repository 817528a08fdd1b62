import numpy as np
import pandas as pd
import pytest

from creditweave.operators import dyads, graph, homophily, nulls, project, rank, regress, resample


def _network(n=60, m=220, seed=4):
    rng = np.random.default_rng(seed)
    w = rng.pareto(1.5, n) + 1
    pairs = {tuple(sorted(map(int, rng.choice(n, 2, replace=False, p=w / w.sum())))) for _ in range(m)}
    return sorted(pairs), rng.choice(["F", "M", "M"], n)


def _frames(spark, edges, gender):
    e = spark.createDataFrame([(u, v, 2000) for u, v in edges], "u long, v long, year int")
    return e, spark.createDataFrame([(i, str(g)) for i, g in enumerate(gender)] + [(999, None)], "artist_id long, gender string")


def test_exact_spread_within_degree_strata_against_permutations(spark):
    edges, gender = _network()
    e, n = _frames(spark, edges, gender)
    got = {r["category"]: r for r in nulls.stratified_spread(e, n, "gender", ["F", "M"], ["year"], least=12).collect()}
    strata = {}
    d = homophily.degrees(e, ["year"])
    level = {r["degree"]: r["stratum"] for r in homophily.degree_strata(d, ["year"], 12).collect()}
    for r in d.collect():
        strata[r["node"]] = level[r["degree"]]
    nodes = sorted(strata)
    at = {x: i for i, x in enumerate(nodes)}
    s, g = np.array([strata[x] for x in nodes]), np.array([gender[x] for x in nodes])
    u, v = np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges])
    rng = np.random.default_rng(1)
    sim = {c: [] for c in "FM"}
    for _ in range(20_000):
        p = np.empty_like(g)
        for k in set(s):
            p[s == k] = rng.permutation(g[s == k])
        for c in "FM":
            sim[c].append(int(((p[u] == c) & (p[v] == c)).sum()))
    for c in "FM":
        x = np.array(sim[c])
        assert got[c]["observed"] == int(((g[u] == c) & (g[v] == c)).sum())
        assert abs(got[c]["expected"] - x.mean()) < 4 * x.std() / len(x) ** 0.5 and abs(got[c]["sd"] / x.std() - 1) < 0.03
    # one stratum is the uniform permutation
    one = {r["category"]: r for r in nulls.stratified_spread(e, n, "gender", ["F", "M"], ["year"], least=10_000).collect()}
    for r in homophily.uniform_permutation(e, n, "gender", ["F", "M"], ["year"]).collect():
        assert abs(one[r["category"]]["expected"] - r["expected"]) < 1e-9 and abs(one[r["category"]]["sd"] - r["sd"]) < 1e-9


def test_tables_of_matched_stubs():
    stubs, rng = np.array([6, 9, 3]), np.random.default_rng(2)
    got = nulls.drawn_tables(stubs, 6000, rng)
    assert (got.sum(2) == stubs).all() and (got == got.transpose(0, 2, 1)).all()
    label, want = np.repeat([0, 1, 2], stubs), np.zeros((6000, 3, 3))
    for b in range(6000):
        x = rng.permutation(label).reshape(-1, 2)
        np.add.at(want[b], (x[:, 0], x[:, 1]), 1)
        np.add.at(want[b], (x[:, 1], x[:, 0]), 1)
    assert np.abs(got.mean(0) - want.mean(0)).max() < 0.12 and np.abs(got.std(0) - want.std(0)).max() < 0.1


def test_figures_by_part(spark):
    edges, gender = _network()
    e, n = _frames(spark, edges, gender)
    r = nulls.class_figures(homophily.edge_classes(e, n, "gender"), ["year"], least=10).first()
    want = homophily.assortativity(homophily.mixing(homophily.edge_classes(e, n, "gender"))).first()
    assert r["n_edges"] == len(edges) and abs(r["r"] - want["r"]) < 1e-12 and r["lo"] < r["r"] < r["hi"] and abs(r["r_null"] - want["r_expected"]) < 5 * r["sd_null"] / 500**0.5
    assert nulls.class_figures(homophily.edge_classes(e, n, "gender"), ["year"], least=10_000).count() == 0
    cells = {(x["ci"], x["cj"]): x for x in nulls.cell_figures(homophily.edge_classes(e, n, "gender")).collect()}
    assert sum(x["m"] for x in cells.values()) == 2 * len(edges) and cells["F", "M"]["m"] == cells["M", "F"]["m"]


def test_permuted_labels_in_bits(spark):
    edges, gender = _network()
    e, n = _frames(spark, edges, gender)
    x = nulls.permuted_counts(e.repartition(3), n, "gender", "F", 1000).toPandas()
    exact = {r["category"]: r for r in homophily.uniform_permutation(e, n, "gender", ["F", "M"], ["year"]).collect()}
    assert len(x) == 1000 and (x.n == len(edges)).all()
    for c, col in (("F", "n_both"), ("M", "n_neither")):
        assert abs(x[col].mean() - exact[c]["expected"]) < 5 * exact[c]["sd"] / 1000**0.5 and abs(x[col].std() / exact[c]["sd"] - 1) < 0.1
    with pytest.raises(ValueError, match="closed form"):
        nulls.permuted_counts(e, n, "gender", "F", 10, most_nodes=5)


def test_drawn_labels_in_bits(spark):
    edges, gender = _network()
    gender = [g if i % 3 else None for i, g in enumerate(gender)]
    e, n = spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(i, g and str(g)) for i, g in enumerate(gender)], "artist_id long, gender string")
    got = nulls.drawn_counts(e, n, 0.3, 200)
    again = nulls.drawn_counts(e.repartition(5), n.repartition(4), 0.3, 200)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    chance = [1.0 if g == "F" else 0.0 if g == "M" else 0.3 for g in gender]
    want = sum(chance[u] * chance[v] for u, v in edges)
    x = got.toPandas()
    assert abs(x.n_both.mean() - want) < 5 * x.n_both.std() / 200**0.5
    w = e.withColumn("w", e.u * 0 + 1.0)
    r = {s: g.r for s, g in resample.imputed_r(w, n, 50).toPandas().groupby("scenario")}
    assert len(r["marginal"]) == 50 and {len(r[s]) for s in ("known_only", "homophilous", "heterophilous")} == {1}
    assert r["homophilous"].iloc[0] > r["heterophilous"].iloc[0]


def test_permuted_coefficient_is_the_regression_s(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.random() < 0.3), "ab"[i % 2], float(rng.gamma(2))) for i in range(600)]
    d = pd.DataFrame(rows, columns=["id", "x", "g", "l"])
    d["g_b"], d["y"] = (d.g == "b").astype(float), 0.8 * d.x + d.l + rng.normal(size=600)
    r = regress.permuted_coefficient(spark.createDataFrame(d), "y", "x", ["g_b", "l"], ["g"], "l", "id", 300).first()
    z = np.column_stack([np.ones(600), d.x, d.g_b, d.l])
    assert abs(r["coef"] - np.linalg.lstsq(z, d.y, rcond=None)[0][1]) < 1e-9 and r["n_strata"] == 10 and r["p"] < 0.01
    d["y"] = d.l + rng.normal(size=600)
    assert regress.permuted_coefficient(spark.createDataFrame(d), "y", "x", ["g_b", "l"], ["g"], "l", "id", 300).first()["p"] > 0.01


def test_difference_of_coefficients(spark):
    a = spark.createDataFrame([("m", "t", 1.0, 0.3), ("m", "s", None, None)], "model string, term string, coef double, se double")
    b = spark.createDataFrame([("m", "t", 2.0, 0.4), ("m", "s", 1.0, 1.0)], "model string, term string, coef double, se double")
    got = {r["term"]: r for r in regress.difference_test(a, b, ["model", "term"]).collect()}
    assert abs(got["t"]["z"] - 2.0) < 1e-12 and abs(got["t"]["p"] - 0.0455002638963584) < 1e-12 and got["s"]["p"] is None


def test_class_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    nodes = [(i, str(rng.choice(["F", "M", "mixed"])), str(rng.choice(["p", "q"])), int(rng.choice([1990, 2000])) if i % 9 else None, int(rng.integers(0, 6))) for i in range(80)]
    edges = sorted({tuple(sorted(map(int, rng.choice(80, 2, replace=False)))) for _ in range(150)})
    n = spark.createDataFrame(nodes, "artist_id long, gender string, genre string, cohort int, n_release long")
    got = {tuple(r)[:5]: tuple(r)[5:] for r in dyads.class_pairs(n, spark.createDataFrame(edges, "u long, v long")).collect()}
    want: dict = {}
    for i in range(80):
        for j in range(i + 1, 80):
            a, b = nodes[i], nodes[j]
            k = (int(a[1] == b[1] == "F"), int(a[1] == b[1] == "M"), int(a[2] == b[2]), int(a[3] == b[3]), max(a[4], 1) * max(b[4], 1))
            p, e = want.get(k, (0, 0))
            want[k] = p + 1, e + ((i, j) in set(edges))
    assert got == want


def test_node_bootstrap_holds_the_coefficient(spark):
    rng = np.random.default_rng(9)
    nodes = [(i, "F" if rng.random() < 0.4 else "M", "p", 2000, 3) for i in range(400)]
    edges = [(i, j) for i in range(400) for j in range(i + 1, 400) if rng.random() < (0.06 if nodes[i][1] == nodes[j][1] == "F" else 0.03)]
    n, e = spark.createDataFrame(nodes, "artist_id long, gender string, genre string, cohort int, n_release long"), spark.createDataFrame(edges, "u long, v long")
    got = {r["term"]: r for r in dyads.node_bootstrap(n, e, 60).collect()}
    point = {r["term"]: r["coef"] for r in dyads.case_control(n, e).collect()}
    assert all(got[t]["coef"] == point[t] for t in point) and got["same_f"]["replicas"] == 60
    for t in ("same_f", "intercept"):
        assert got[t]["lo"] < point[t] < got[t]["hi"]
    assert 0.3 < point["same_f"] < 1.1 and got["same_genre"]["lo"] is None
    assert dyads.node_bootstrap(n, e.limit(0), 5).count() in (0, 6)


def test_hubs_are_taken_until_the_edges_fit(spark):
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 12)] + [(20, 21)]
    e = spark.createDataFrame(edges, "u long, v long")
    assert {tuple(r) for r in graph.trimmed(e, 15, least_nodes=5).collect()} == {(i, i + 1) for i in range(1, 12)}
    assert graph.trimmed(e, 1000).count() == len(edges) and graph.trimmed(e.limit(0), 10).count() == 0


def test_swaps_keep_degrees_and_mix():
    rng = np.random.default_rng(42)
    pairs = sorted({(int(a), r) for r in range(400) for a in rng.choice(200, int(rng.integers(2, 9)), replace=False)})
    a, r = np.array(pairs).T
    b, s = resample.swap(a, r, 10, np.random.default_rng(1))
    assert np.array_equal(a, b) and np.array_equal(np.sort(r), np.sort(s)) and len(set(zip(b, s))) == len(pairs)
    assert len(set(zip(b.tolist(), s.tolist())) & set(pairs)) < 0.1 * len(pairs)
    one = resample.swap(np.array([1, 1]), np.array([5, 6]), 10, rng)
    assert sorted(zip(*map(list, one))) == [(1, 5), (1, 6)] and len(resample.swap(a[:0], r[:0], 10, rng)[0]) == 0


def test_smallest_by_a_mark(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).repartition(5)
    marks = sorted(r[0] for r in df.select(F.xxhash64("id")).collect())
    for n in (0, 1, 700, 5000, 9000):
        got = rank.smallest(df, n, F.xxhash64("id"), 64)
        assert sorted(r[0] for r in got.select(F.xxhash64("id")).collect()) == marks[:n]


def test_casts_of_a_hot_work(spark):
    rows = [(1, a) for a in range(5000)] + [(2, a) for a in (3, 1, 3, 2)] + [(3, 7)] + [(None, 1), (None, 2)]
    got = {r["k"]: [x["m"] for x in r["cast"]] for r in project.casts(spark.createDataFrame(rows, "k long, artist_id long"), "k", 8).collect()}
    assert got == {2: [1, 2, 3]}


def test_exact_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u long, v long")
    assert {r["node"]: round(r["betweenness"], 9) for r in graph.betweenness(e).collect()} == {1: 0.0, 2: round(2 / 3, 9), 3: round(2 / 3, 9), 4: 0.0}


def test_shapes(spark):
    h = spark.createDataFrame([("x", 0, 10.0, 20.0), ("x", 1, 30.0, 20.0), ("x", 2, 0.0, 5.0)], "p string, esp int, o double, s double")
    got = {r["esp"]: r["deviation"] for r in nulls.shape_deviation(h, ["p"], "esp", "o", "s").collect()}
    assert abs(got[0] - np.log2((20 / 45) / (10 / 40))) < 1e-12 and got[2] is None
    g = spark.createDataFrame([(0, 20.0, 10.0, 0.01), (1, 10.0, 10.0, 0.5), (7, 30.0, 10.0, 0.01)], "value int, obs double, mean double, p double")
    assert tuple(nulls.u_shape(g).first()) == (2.0, 1.0, 3.0, 2.5, 2, 3)
