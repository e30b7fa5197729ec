"""Shortest paths, routes, nearest neighbours and bridges against plain loops, at sizes that a round a level would not take."""

import random
from collections import defaultdict
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from corvox.operators import shortest


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def dijkstra(links, root):
    out, dist, up, order, queue = defaultdict(list), {root: 0.0}, {root: None}, [], [(0.0, root)]
    for a, b, w in links:
        out[a].append((b, w))
        out[b].append((a, w))
    done = set()
    while queue:
        d, a = heappop(queue)
        if a in done:
            continue
        done.add(a)
        order.append(a)
        for b, w in sorted(out[a]):
            if d + w < dist.get(b, float("inf")):
                dist[b], up[b] = d + w, a
                heappush(queue, (d + w, b))
    return dist, up, order


def tree_of(spark, links, radius, **more):
    nodes = spark.createDataFrame([("x", n, r) for n, r in radius.items()], "case_id string, node long, radius double")
    e = spark.createDataFrame([("x", a, b, float(w)) for a, b, w in links], "case_id string, a long, b long, length double")
    return shortest.shortest_tree(nodes, e, **more)


def labels(dist, up, order):
    """Generations and branches as a loop over settled nodes gives them."""
    kids = defaultdict(list)
    for n, p in up.items():
        if p is not None:
            kids[p].append(n)
    root, out, count = order[0], {order[0]: (0, 0)}, 0
    for n in order:
        for k in sorted(kids[n]):
            if n == root or len(kids[n]) == 1:
                out[k] = out[n]
            else:
                count += 1
                out[k] = (out[n][0] + 1, count)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shortest_tree_of_odd_graphs(spark, seed):
    """Chains, rings, ends, hairy chains and parallel links, in blocks of a few nodes, whole lengths so that ties are many."""
    r = random.Random(seed)
    links, n = [], 12
    for _ in range(14):
        links.append((r.randrange(12), r.randrange(12), r.randint(1, 4)))
    for _ in range(6):
        a = r.randrange(n)
        for _ in range(r.choice((1, 7, 20))):
            links.append((a, n, r.randint(1, 3)))
            if seed % 2 and r.random() < 0.5:
                links.append((n, n + 1, 1))
                a, n = n, n + 2
            else:
                a, n = n, n + 1
        if r.random() < 0.6:
            links.append((a, r.randrange(n), 2))
    links += [(1000 + k, 1000 + (k + 1) % 9, 1) for k in range(9)]  # a ring that the root does not reach
    radius = {k: float(r.randint(1, 5)) for k in {x for a, b, _ in links for x in (a, b)}}
    dist, up, order = dijkstra([x for x in links if x[0] != x[1]], max(radius, key=lambda k: (radius[k], -k)))
    tree = tree_of(spark, links, radius, block=lambda c: F.floor(c / 5))
    assert {x["node"]: (x["dist"], x["parent"]) for x in tree.collect()} == {k: (dist[k], up[k]) for k in dist}
    got = {x["node"]: (x["generation"], x["branch"]) for x in shortest.branch_labels(tree).collect()}
    assert got == labels(dist, up, order)


def test_grid_with_a_long_chain(spark):
    """A grid of 100,000 nodes with cycles everywhere; a chain of 5,000 nodes at its far corner adds the jobs of its doubling."""
    wide, high = 400, 250
    links = [(y * wide + x, y * wide + x + 1, 1 + (x * 7 + y * 13) % 5) for y in range(high) for x in range(wide - 1)] + [(y * wide + x, (y + 1) * wide + x, 1 + (x * 11 + y * 3) % 5) for y in range(high - 1) for x in range(wide)]
    chain = [(wide * high - 1 + k, wide * high + k, 2) for k in range(5000)]
    radius = {0: 9.0} | {k: 1.0 for k in range(1, wide * high + 5000)}
    block = lambda c: F.when(c < wide * high, F.floor(c / wide / 64) * 100 + F.floor(c % wide / 64)).otherwise(10_000 + F.floor(c / 64))
    rows, jobs = jobs_of(spark, "grid", lambda: tree_of(spark, links + chain, radius, block=block).collect())
    dist, up, _ = dijkstra(links + chain, 0)
    assert {x["node"]: (x["dist"], x["parent"]) for x in rows} == {k: (dist[k], up[k]) for k in dist}
    assert jobs < 300  # without contraction 990, as the chain crosses its 79 blocks one by one


def places(seed, n, spread):
    r = random.Random(seed)
    out = [(r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 0.01)) for _ in range(n)] + [(r.uniform(-spread, spread), spread, -spread) for _ in range(20)]
    return [tuple(round(v, 3) for v in x) for x in out]


def test_nearest_among_many_with_far_outliers(spark, monkeypatch):
    """10^5 nodes in one case and a few a million times farther away; ties, repeated places, other cases, unusable coordinates."""
    import numpy as np

    from corvox.operators import nearest

    nodes, points = places(1, 100_000, 1e6), places(2, 1500, 2e6)
    nodes += nodes[:500]
    rows = [("a", k, *x) for k, x in enumerate(nodes)] + [("b", 7, 0.0, 0.0, 0.0), ("b", 3, 2.0, 0.0, 0.0), ("d", 1, 0.0, 0.0, 0.0), ("a", -1, None, 0.0, 0.0), ("a", -2, float("nan"), 0.0, 0.0)]
    asked = [("a", f"p{k}", *x) for k, x in enumerate(points)] + [("b", "mid", 1.0, 0.0, 0.0), ("b", "mid2", 1.0, 0.0, 0.0), ("c", "alone", 0.0, 0.0, 0.0), ("b", "none", None, 1.0, 1.0)]
    n = spark.createDataFrame(rows, "case_id string, node_ord long, x double, y double, z double").repartition(4)
    p = spark.createDataFrame(asked, "case_id string, p string, x double, y double, z double").repartition(4)
    most, stored = [], nearest.stored

    def watched(df, tag):
        out = stored(df, tag)
        most.append(out.count() if tag == "pairs" else 0)
        return out

    monkeypatch.setattr(nearest, "stored", watched)
    got = {(r["case_id"], r["p"]): (r["node_ord"], r["distance"]) for r in nearest.nearest(p, n, ["p"]).collect()}
    at = np.array(nodes)
    want = {("b", "mid"): (3, 1.0), ("b", "mid2"): (3, 1.0)}
    for k, x in enumerate(points):
        d2 = ((at - x) ** 2).sum(1)
        want["a", f"p{k}"] = (int(d2.argmin()), float(d2.min() ** 0.5))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert max(most) < 0.01 * len(nodes) * len(points)


def test_routes_keep_only_leaves(spark, monkeypatch):
    """A chain of 100,000 nodes with a side branch: two routes are written out, and no table of all nodes' routes."""
    from corvox.operators import graphs

    n = 100_000
    e = spark.range(n - 1).selectExpr("'x' as case_id", "id as src", "id + 1 as dst").union(spark.sql("select 'x', 3L, 100000L"))
    nodes = spark.range(n + 1).selectExpr("'x' as case_id", "id", "id as node_ord", "cast(id as double) as x", "0.0D as y", "0.0D as z", "case when id = 99 then 3.0D else 5.0D end as radius", "true as accessible")
    most, stored = [0], graphs.stored

    def watched(df, tag):
        out = stored(df, tag)
        most.append(out.count() if tag == "way" else 0)
        return out

    monkeypatch.setattr(graphs, "stored", watched)
    got = {r["id"]: r for r in graphs.routes(nodes, e, spark.createDataFrame([("x", 0)], "case_id string, id long"), 2.5, 1e9).collect()}
    assert got.keys() == {n - 1, n} and max(most) == n + 5
    assert got[n - 1]["route"] == list(range(n)) and got[n - 1]["length"] == n - 1 and got[n - 1]["least_radius"] == 3.0
    assert got[n]["route"] == [0, 1, 2, 3, n] and got[n]["least_radius"] == 5.0


@pytest.mark.parametrize("seed", range(2))
def test_routes_through_cycles(spark, seed):
    from corvox.operators import graphs

    r = random.Random(seed)
    links = {tuple(sorted(r.sample(range(30), 2))) for _ in range(45)}
    radius = {k: r.choice((1.0, 4.0, 5.0)) if k else 5.0 for k in range(30)}
    nodes = spark.createDataFrame([("x", f"n{k}", k, float(k), float(k % 3), 0.0, radius[k], True) for k in radius], "case_id string, id string, node_ord int, x double, y double, z double, radius double, accessible boolean")
    e = spark.createDataFrame([("x", f"n{a}", f"n{b}") for a, b in links], "case_id string, src string, dst string")
    got = {x["id"]: x["route"] for x in graphs.routes(nodes, e, spark.createDataFrame([("x", "n0")], "case_id string, id string"), 3.0, 1e9).collect()}
    near = defaultdict(set)
    for a, b in links:
        if min(radius[a], radius[b]) > 1.5:
            near[a].add(b)
            near[b].add(a)
    up, front = {0: None}, [0]
    while front:
        new = {}
        for a in sorted(front):
            for b in sorted(near[a]):
                if b not in up:
                    new.setdefault(b, a)
        up |= new
        front = list(new)
    want = {}
    for k in set(up) - set(up.values()):
        way = [k]
        while up[way[-1]] is not None:
            way.append(up[way[-1]])
        if len(way) > 1:
            want[f"n{k}"] = [f"n{x}" for x in reversed(way)]
    assert got == want
