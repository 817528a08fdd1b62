"""Structure of graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditweave.operators.adjacency import Adjacency, drop, get, of, part, put, row_sums
from creditweave.session import cut


def _print(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes, equal for equal sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 100) -> DataFrame:
    """``node, component``: the smallest node id of the component of each node that has an edge.

    Alternating large-star and small-star steps: every node hands its smallest neighbour to
    its larger neighbours, then to its smaller ones, until nothing changes.  Rounds grow
    with the logarithm of the number of nodes; each ends in a checkpoint.  Self-loops keep
    a node, null ends are ignored, repeated edges count once.
    """
    both = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    nodes = both.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = cut(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = _print(e)
    for _ in range(most_rounds):
        # large star: larger neighbours of a node go to its smallest one
        sym = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours of a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
        new = cut(small.select("x.a", "x.b").where("a <> b").distinct())
        before, known = known, _print(new)
        e = new
        if known == before:
            break
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def symmetric(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``a, b, w``: each undirected edge in both directions."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), w.cast("double").alias("w"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def giant_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component; of equally large ones that of the smallest id."""
    comp = cut(connected_components(edges))
    top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = comp.join(F.broadcast(top.select("component")), "component").select(F.col("node").alias("u"))
    return edges.join(inside, "u", "left_semi")


def core_numbers(edges: DataFrame | Adjacency, most_rounds: int = 200) -> DataFrame:
    """``node, coreness`` by H-index relaxation: each node takes the H-index of its neighbours' values until none changes.

    Only nodes that have too few neighbours of their value take part in a round; their values are sorted where the arcs lie.
    """
    import numpy as np

    g = of(edges, simple=True)

    def relaxed(lo, start, dst, w, c):
        own = np.array(c[lo : lo + len(start) - 1])
        size = np.diff(start)
        few = np.add.reduceat(c[dst] >= np.repeat(own, size), start[:-1], dtype=np.int64) < own
        if few.any():
            row = np.repeat(np.arange(int(few.sum())), size[few])
            near = c[dst[np.repeat(few, size)]]
            near = near[np.lexsort((-near, row))]
            first = np.cumsum(size[few]) - size[few]
            own[few] = np.maximum.reduceat(np.minimum(near, np.arange(len(near)) - first[row] + 1), first)
        return own

    now = g.degrees().astype(np.int32)
    for _ in range(most_rounds):
        new = np.concatenate(g.each(relaxed, now)) if g.n else now
        if np.array_equal(new, now):
            break
        now = new
    else:
        raise RuntimeError(f"coreness still changes after {most_rounds} rounds")
    return g.table("coreness", now, "int")


def pagerank(edges: DataFrame | Adjacency, weight: str | None = "w", damping: float = 0.85, rounds: int = 30, tolerance: float = 0.0) -> DataFrame:
    """``node, pagerank`` of the undirected weighted graph after ``rounds`` steps, or fewer once the L1 change is below n x tolerance.

    With a tolerance, ``rounds`` is a bound that raises if it is reached before.  A step is one pass over the files of the adjacency.
    """
    import numpy as np

    g = of(edges, weight)
    n = int(g.inside.sum())
    x = g.inside / max(1, n)
    out = np.where(g.inside, g.times(np.ones(g.n), weight is not None), 1.0)
    for _ in range(rounds):
        new = np.where(g.inside, (1 - damping) / max(1, n) + damping * g.times(x / out, weight is not None), 0.0)
        moved, x = float(np.abs(new - x).sum()), new
        if tolerance and moved < n * tolerance:
            break
    else:
        if tolerance and n:
            raise RuntimeError(f"pagerank still changes by more than n x {tolerance} after {rounds} rounds")
    return g.table("pagerank", x)


def _length(*x) -> float:
    import numpy as np

    return float(np.sqrt(sum((v * v).sum() for v in x))) or 1.0


def eigenvector(edges: DataFrame | Adjacency, weight: str | None = "w", rounds: int = 1000, tolerance: float = 1e-10) -> DataFrame:
    """``node, eigenvector``: leading eigenvector of A + I by power iteration, of length 1.

    It ends once a step changes the vector by less than ``tolerance`` and raises after ``rounds`` steps.
    """
    import numpy as np

    g = of(edges, weight)
    x = g.inside / _length(g.inside.astype(float))
    for _ in range(rounds if g.n else 0):
        new = np.where(g.inside, x + g.times(x, weight is not None), 0.0)
        new /= _length(new)
        moved, x = _length(new - x) if (new != x).any() else 0.0, new
        if moved < tolerance:
            break
    else:
        if g.n:
            raise RuntimeError(f"the eigenvector still changes by more than {tolerance} after {rounds} rounds")
    return g.table("eigenvector", x)


def non_backtracking(edges: DataFrame | Adjacency, rounds: int = 1000, tolerance: float = 1e-10) -> DataFrame:
    """``node, nonbacktracking``: first half of the leading eigenvector of [[A, I - D], [I, 0]], clipped at 0, of length 1.

    Two vectors are iterated: x' = A x + (I - D) y and y' = x, with a shift of 1 against oscillation.
    It ends once a step changes them by less than ``tolerance`` and raises after ``rounds`` steps.
    """
    import numpy as np

    g = of(edges)
    d = np.where(g.inside, g.degrees(), 0)
    # not x = y = 1, which is itself an eigenvector, of eigenvalue 1
    x, y = g.inside / _length(g.inside.astype(float)), np.zeros(g.n)
    for _ in range(rounds if g.n else 0):
        a, b = np.where(g.inside, g.times(x, False) + (1 - d) * y + x, 0.0), x + y
        size = _length(a, b)
        a, b = a / size, b / size
        moved = _length(a - x, b - y) if (a != x).any() or (b != y).any() else 0.0
        x, y = a, b
        if moved < tolerance:
            break
    else:
        if g.n:
            raise RuntimeError(f"the non-backtracking vector still changes by more than {tolerance} after {rounds} rounds")
    x = np.maximum(x, 0.0)
    return g.table("nonbacktracking", x / _length(x))


def triangles(edges: DataFrame) -> DataFrame:
    """``a < b < c`` with the weights of the three edges.

    Edges point from the end of smaller degree to the other one, so that a hub opens no wedges: a node has at most sqrt(2 m) edges out.
    """
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").where("u <> v")
    d = symmetric(edges).groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    o = e.join(d.withColumnsRenamed({"a": "u", "d": "du"}), "u").join(d.withColumnsRenamed({"a": "v", "d": "dv"}), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = o.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("t"), "w")
    p, q = o.select("s", F.col("t").alias("x"), F.col("w").alias("wx")), o.select("s", F.col("t").alias("y"), F.col("w").alias("wy"))
    wedge = p.join(q, "s").where("x < y")
    closed = wedge.join(e.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("wxy")), ["x", "y"])
    return closed.select(F.col("s").alias("n1"), F.col("x").alias("n2"), F.col("y").alias("n3"), F.col("wx").alias("w12"), F.col("wy").alias("w13"), F.col("wxy").alias("w23"))


def clustering(edges: DataFrame) -> DataFrame:
    """``node, triangles, clustering, weighted``: local clustering, plain and by geometric mean of weights over the largest one; 0 below degree 2."""
    top = edges.agg(F.max("w").alias("top"))
    t = triangles(edges).crossJoin(F.broadcast(top))
    g = F.pow(F.col("w12") / F.col("top") * (F.col("w13") / F.col("top")) * (F.col("w23") / F.col("top")), F.lit(1.0 / 3))
    per = t.select(F.explode(F.array("n1", "n2", "n3")).alias("node"), g.alias("g")).groupBy("node").agg(F.count(F.lit(1)).alias("t"), F.sum("g").alias("g"))
    d = symmetric(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    can = F.col("d") * (F.col("d") - 1) / 2
    return d.join(per, "node", "left").select("node", F.coalesce("t", F.lit(0)).alias("triangles"), F.coalesce(F.try_divide("t", can), F.lit(0.0)).alias("clustering"), F.coalesce(F.try_divide("g", can), F.lit(0.0)).alias("weighted"))


def shared_partners(edges: DataFrame) -> DataFrame:
    """``u, v, esp``: common neighbours of the ends of each edge, from the triangles of the graph."""
    t = triangles(edges.select("u", "v", F.lit(1.0).alias("w")))
    sides = t.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("n1", "n2"), ("n1", "n3"), ("n2", "n3"))])).alias("e"))
    n = sides.groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("esp"))
    return edges.select("u", "v").join(n, ["u", "v"], "left").select("u", "v", F.coalesce("esp", F.lit(0)).alias("esp"))


def explained_partners(edges: DataFrame, incidence: DataFrame) -> DataFrame:
    """Shared partners of each edge and those that the shared works alone impose.

    ``incidence(a, r)`` is the bipartite graph that ``edges`` are projected from.  Result:
    ``u, v, esp, esp_explained, n_shared, largest_cast, ceiling, beyond``.
    """
    inc = incidence.select("a", "r").distinct()
    size = inc.groupBy("r").agg(F.count(F.lit(1)).alias("k"))
    x, y = inc.select(F.col("a").alias("u"), "r"), inc.select(F.col("a").alias("v"), "r")
    works = x.join(y, "r").where("u < v").join(edges.select("u", "v"), ["u", "v"], "left_semi")
    w = works.join(size, "r").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n_shared"), F.max("k").alias("largest_cast"))
    third = works.join(inc.select("r", F.col("a").alias("z")), "r").where("z <> u and z <> v").groupBy("u", "v").agg(F.count_distinct("z").alias("esp_explained"))
    out = shared_partners(edges).join(w, ["u", "v"], "left").join(third, ["u", "v"], "left")
    ceiling = F.greatest(F.coalesce("largest_cast", F.lit(0)) - 2, F.lit(0))
    return out.select("u", "v", "esp", F.coalesce("esp_explained", F.lit(0)).alias("esp_explained"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "largest_cast", ceiling.alias("ceiling"), (F.col("esp") > ceiling).alias("beyond"))


def brandes(at: str, n: int, width: int, sources, batch: int, inside=None, rows: int = 2048, piece: int = 1_000_000):
    """Sums over ``sources`` of the shortest paths through each node, by Brandes' algorithm on files of an adjacency.

    ``batch`` sources are followed at once, a row of each node; of 1 each by itself.  A level takes the rows of nodes that lack a source, or, where these have more
    arcs than the front, the rows of the front, ``piece`` arcs at a time.  ``inside`` marks the nodes that a source may reach.
    """
    import numpy as np

    parts = [tuple(map(np.asarray, part(at, p, None, False)[:2])) for p in range(-(-n // width))]
    degree = np.concatenate([np.diff(start) for start, _ in parts])
    every = np.arange(n) if inside is None else np.flatnonzero(inside)

    def added(x, start, size, ends):
        """Sums of the rows of x at ``ends[start : start + size]``.

        Lists of like size are gathered side by side, about ``rows`` of them at once, so that rows are copied and added whole; lists are filled up with the last row, which is 0.
        """
        k = x.shape[1]
        out, held = np.zeros((len(size), k)), np.empty((rows, k))
        order = np.argsort(-size, kind="stable")
        lo, upto = 0, int((size > 0).sum())
        while lo < upto:
            most = int(size[order[lo]])
            which = order[lo : min(upto, lo + max(1, rows // most))]
            lo += len(which)
            if most > rows:
                first = int(start[which[0]])
                for i in range(first, first + most, rows):
                    out[which[0]] += x[ends[i : min(i + rows, first + most)]].sum(0)
                continue
            j = np.arange(most)[:, None]
            to = ends[np.minimum(start[which] + j, len(ends) - 1)].astype(np.intp)
            if size[which[-1]] < most:
                to[j >= size[which]] = len(x) - 1
            got = held[: to.size]
            np.take(x, to.ravel(), axis=0, out=got, mode="clip")
            out[which] = np.add.reduce(got.reshape(most, -1), axis=0).reshape(-1, k)
        return out

    def pulled(x, nodes):
        """Sums of x over the neighbours of ``nodes``."""
        cuts = np.searchsorted(nodes, np.arange(len(parts) + 1) * width)
        mine = [nodes[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
        return nodes, np.concatenate([np.empty((0, x.shape[1])), *[added(x, start[m - p * width], degree[m], dst) for p, ((start, dst), m) in enumerate(zip(parts, mine)) if len(m)]])

    def pieces(front):
        """Arcs of the nodes of ``front``: starts and ends, of about ``piece`` arcs, but of a node at least."""
        lo, size = 0, np.cumsum(degree[front])
        while lo < len(front):
            p = front[lo] // width
            hi = max(lo + 1, min(int(np.searchsorted(size, size[lo] - degree[front[lo]] + piece, side="right")), int(np.searchsorted(front, (p + 1) * width))))
            (start, dst), some = parts[p], front[lo:hi]
            k = degree[some]
            yield np.repeat(some, k), dst[np.repeat(start[some - p * width] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            lo = hi

    def pushed(x, front):
        """The same for all neighbours of ``front``, outside of which x is 0."""
        met = np.zeros(n, bool)
        for _, to in pieces(front):
            met[to] = True
        ends = np.flatnonzero(met)
        out = np.zeros((len(ends), x.shape[1]))
        for frm, to in pieces(front):
            order = np.argsort(to, kind="stable")
            head = np.flatnonzero(np.diff(to[order], prepend=-1))
            out[np.searchsorted(ends, to[order[head]])] += added(x, head, np.diff(head, append=len(to)), frm[order])
        return ends, out

    def step(x, front, rest):
        return pushed(x, front) if 3 * degree[front].sum() < degree[rest].sum() else pulled(x, rest)

    def arcs(nodes, most=100_000):
        """``lo, hi, starts, ends`` of the arcs of ``nodes[lo:hi]``, few enough to stay in a core's cache."""
        k = degree[nodes]
        upto, first = np.concatenate([[0], np.cumsum(k)]), np.searchsorted(nodes, np.arange(len(parts) + 1) * width)
        for (start, dst), p, lo, end in zip(parts, range(len(parts)), first, first[1:]):
            while lo < end:
                hi = max(lo + 1, min(end, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1))
                starts = upto[lo : hi + 1] - upto[lo]
                at_ = np.repeat(start[nodes[lo:hi] - p * width] - starts[:-1], k[lo:hi])
                at_ += np.arange(len(at_))
                yield lo, hi, starts, dst[at_]
                lo = hi

    def spread(x, front):
        """Sums of the values ``x`` of the nodes of ``front`` over the arcs to each node."""
        out = np.zeros(n)
        for lo, hi, starts, to in arcs(front):
            np.add.at(out, to, np.repeat(x[lo:hi], np.diff(starts)))
        return out

    def gathered(x, nodes):
        """Sums of x over the neighbours of ``nodes``."""
        out = np.zeros(len(nodes))
        for lo, hi, starts, to in arcs(nodes):
            out[lo:hi] = row_sums(starts, x[to])
        return out

    def alone(s):
        """The sums of one source: a level takes the arcs of its own front or of the nodes that are left, whichever are fewer."""
        dist, paths, rest = np.full(n, -1, np.int32), np.zeros(n), every
        dist[s], paths[s], levels = 0, 1, [np.array([s])]
        while len(rest := rest[dist[rest] < 0]):
            front = levels[-1]
            if degree[front].sum() < 1.5 * degree[rest].sum():
                got = spread(paths[front], front)[rest]
            else:
                got = gathered(np.where(dist == len(levels) - 1, paths, 0), rest)
            if not len(hit := rest[got > 0]):
                break
            dist[hit], paths[hit] = len(levels), got[got > 0]
            levels.append(hit)
        dep = np.zeros(n)
        for front, back in zip(levels[:1:-1], levels[-2:0:-1]):
            x = (1 + dep[front]) / paths[front]
            if 1.5 * degree[front].sum() < degree[back].sum():
                got = spread(x, front)[back]
            else:
                value = np.zeros(n)
                value[front] = x
                got = gathered(value, back)
            dep[back] = paths[back] * got
        return dep

    total = np.zeros(n)
    if batch == 1:
        for s in sources:
            total += alone(s)
        return total
    for b in range(0, len(sources), batch):
        s = np.asarray(sources[b : b + batch])
        k = len(s)
        dist, paths, x = np.full((n, k), -1, np.int32), np.zeros((n, k)), np.zeros((n + 1, k))
        dist[s, np.arange(k)], paths[s, np.arange(k)] = 0, 1
        levels, rest = [np.unique(s)], every
        while len(rest := rest[(dist[rest] < 0).any(1)]):
            front = levels[-1]
            x[front] = np.where(dist[front] == len(levels) - 1, paths[front], 0)
            at_, got = step(x, front, rest)
            x[front] = 0
            known = dist[at_]
            new = (got > 0) & (known < 0)
            hit = np.flatnonzero(new.any(1))
            if not len(hit):
                break
            at_, got, new = at_[hit], got[hit], new[hit]
            dist[at_] = np.where(new, len(levels), known[hit])
            paths[at_] = np.where(new, got, paths[at_])
            levels.append(at_)
        dep = np.zeros((n, k))
        for level in range(len(levels) - 1, 1, -1):
            front = levels[level]
            here = dist[front] == level
            x[front] = np.where(here, (1 + dep[front]) / np.where(here, paths[front], 1), 0)
            at_, got = step(x, front, levels[level - 1])
            x[front] = 0
            dep[at_] += np.where(dist[at_] == level - 1, paths[at_] * got, 0)
        total += dep.sum(1)
    return total


def betweenness(edges: DataFrame | Adjacency, sources: int | None = None, seed: int = 5, held: int = 8_000_000) -> DataFrame:
    """``node, betweenness``, unweighted and normalised by 2 / ((n - 1)(n - 2)); with ``sources`` estimated from so many drawn ones.

    Sources are spread over the tasks, which map the adjacency from its files and write their sums beside it, so a graph may have any number of edges.
    A task follows up to 32 sources at once, with at most ``held`` pairs of node and source in its memory, 60 bytes each; above 50,000 nodes one by one,
    as the front of one source then has few of the arcs that batches read.
    """
    import uuid

    import numpy as np

    g = of(edges, simple=True)
    spark, at, size, width = g.spark, g.at, g.n, g.width
    ids = np.flatnonzero(g.inside)
    n = len(ids)
    chosen = ids if not sources or sources >= n else ids[np.sort(np.random.default_rng(seed).choice(n, sources, replace=False))]
    scale = n / max(1, len(chosen))
    total = np.zeros(size)
    if n:
        batch, name = int(max(1, min(32, held // size))) if size <= 50_000 else 1, uuid.uuid4().hex
        put(f"{at}/{name}", g.inside)

        def run(task):
            i, s = task
            # batches of about the same size, as one of a few sources reads as many arcs
            put(f"{at}/{name}.{i}", brandes(at, size, width, s, -(-len(s) // -(-len(s) // batch)), get(f"{at}/{name}", "?")))

        # jobs of two tasks a core, each of some minutes at most; a task leaves one vector over the nodes, which the driver adds and drops before the next job
        wide = 2 * spark.sparkContext.defaultParallelism
        jobs = max(1, -(-len(chosen) // (4096 * wide)))
        groups = np.array_split(chosen, min(-(-len(chosen) // batch), jobs * wide))
        for lo in range(0, len(groups), wide):
            some = list(enumerate(groups[lo : lo + wide]))
            spark.sparkContext.parallelize(some, len(some)).foreach(run)
            for i, _ in some:
                total += get(f"{at}/{name}.{i}", "<f8")
                drop(f"{at}/{name}.{i}")
        drop(f"{at}/{name}")
    norm = scale / ((n - 1) * (n - 2)) if n > 2 else 0.0  # each pair is met from both ends
    return g.table("betweenness", total * norm)


def snowball(edges: DataFrame, start: list[int], most_nodes: int) -> DataFrame:
    """Edges induced by the nodes met by breadth-first search from ``start`` until ``most_nodes`` are met; nodes of a wave in order of id."""
    sym = cut(symmetric(edges).select("a", "b"))
    met = edges.sparkSession.createDataFrame([(s, 0) for s in start], "node long, wave int")
    front, wave = met, 0
    while True:
        wave += 1
        near = sym.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(met, "node", "left_anti")
        room = most_nodes - met.count()
        front = cut(near.orderBy("node").limit(max(0, room)).withColumn("wave", F.lit(wave)))
        if front.limit(1).count() == 0:
            break
        met = cut(met.unionByName(front))
    n = met.select("node")
    return edges.join(n.withColumnRenamed("node", "u"), "u", "left_semi").join(n.withColumnRenamed("node", "v"), "v", "left_semi")


def trimmed(sample: DataFrame, most_edges: int, least_nodes: int = 200, most_rows: int = 2_000_000) -> DataFrame:
    """Edges of the largest component of a sample from which hubs are taken, the largest first, until ``most_edges`` edges or ``least_nodes`` nodes are left.

    A sample is small; one of more than ``most_rows`` edges is refused.  Of equal degrees the smallest id goes first.
    """
    import numpy as np

    pdf = sample.select("u", "v").limit(most_rows + 1).toPandas()
    if len(pdf) > most_rows:
        raise ValueError(f"more than {most_rows} edges; take a smaller sample")
    ids, code = np.unique(pdf[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    ends = code.reshape(-1, 2)
    left = len(ids)
    while len(ends) > most_edges and left > least_nodes:
        hub = int(np.bincount(ends.ravel(), minlength=len(ids)).argmax())
        ends, left = ends[(ends != hub).all(1)], left - 1
    kept = sample.sparkSession.createDataFrame([(int(ids[a]), int(ids[b])) for a, b in ends], "u long, v long")
    return sample.join(giant_component(kept), ["u", "v"], "left_semi")
