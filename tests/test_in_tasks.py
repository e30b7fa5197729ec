"""Trees, nearest nodes and corrections solved in tasks of boxes and batches, against plain loops and the general operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvox.operators import graphs, loops, nearest, shortest, voxels
from corvox.operators.boxes import SIDE


def voxel_table(spark, cases):
    return spark.createDataFrame([(c, *v) for c, vs in cases.items() for v in sorted(vs)], "case_id int, i int, j int, k int")


def test_a_tree_of_a_mask_in_one_task(spark, monkeypatch):
    """the tree of the links, for cases in one box, over several, with unreached parts and unknown radii."""
    rng = np.random.default_rng(3)
    cube = lambda low, high, n: {tuple(int(x) for x in rng.integers(low, high, 3)) for _ in range(n)}
    cases = {1: cube(0, 12, 500), 2: cube(SIDE, 2 * SIDE, 300), 3: cube(SIDE - 5, SIDE + 5, 250), 4: {(9, 9, 9)}, 5: cube(0, 5, 60)}
    v = voxel_table(spark, cases).withColumn("radius", F.expr("case when case_id = 5 or k % 4 = 0 then null else (i * 31 + j * 17 + k * 7) % 97 end")).cache()
    want = shortest.shortest_tree(v.select("case_id", voxels.number().alias("node"), "radius"), voxels.links(v), voxels.cube)
    rows = lambda df: sorted((r.case_id, r.node, round(r.dist, 6), r.parent) for r in df.collect())
    assert rows(voxels.mask_tree(v)) == rows(want)
    monkeypatch.setattr(shortest, "shortest_tree", lambda *a: pytest.fail("cases within a box need no rounds"))
    assert rows(voxels.mask_tree(v.where("case_id <> 3"))) == rows(want.where("case_id <> 3"))


def test_few_nodes_are_sent_to_the_points(spark, monkeypatch):
    """F16, F17: no trees where cases have few nodes; ties, repeated places, batches, cases on one side only."""
    monkeypatch.setattr(nearest, "tree", lambda *a: pytest.fail("few nodes need no tree"))
    monkeypatch.setattr(nearest, "BATCH", 64)
    monkeypatch.setattr(nearest, "AT_ONCE", 7)
    rng = np.random.default_rng(5)
    nodes = [("a", int(o), *map(float, x)) for o, x in zip(rng.permutation(80), rng.integers(0, 5, (80, 3)), strict=True)] + [("b", 4, 0.0, 0.0, 0.0), ("b", 2, 2.0, 0.0, 0.0), ("d", 1, 0.0, 0.0, 0.0), ("b", 1, None, 0.0, 0.0), ("b", 0, float("nan"), 0.0, 0.0)]
    points = [("a", n, *map(float, x)) for n, x in enumerate(rng.integers(-1, 7, (500, 3)))] + [("b", 0, 1.0, 0.0, 0.0), ("b", 1, 1.0, 0.0, 0.0), ("b", 2, float("inf"), 0.0, 0.0), ("c", 0, 0.0, 0.0, 0.0)]
    n = spark.createDataFrame(nodes, "case_id string, node_ord long, x double, y double, z double")
    p = spark.createDataFrame(points, "case_id string, p int, x double, y double, z double")
    got = {(r.case_id, r.p): (r.node_ord, r.distance) for r in nearest.nearest(p, n, ["p"]).collect()}
    want = {("b", 0): (2, 1.0), ("b", 1): (2, 1.0)}
    for c, k, *x in points[:500]:
        d2, o = min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), o) for m, o, *y in nodes if m == c)
        want[c, k] = (o, d2**0.5)
    assert got == want


def test_corrections_by_boxes(spark):
    """values around an airway over the edges of boxes, without a join of moved voxels."""
    rng = np.random.default_rng(9)
    body = {c: {tuple(int(x) for x in rng.integers(SIDE - 6, SIDE + 6, 3)) for _ in range(700)} for c in (1, 2, 3)}
    tube = {1: set(sorted(body[1])[::9]) | {(SIDE - 8, SIDE, SIDE), (0, 0, 0)}, 2: {(SIDE, SIDE, SIDE)}, 4: {(1, 1, 1)}}
    b = voxel_table(spark, body).withColumns({"inside": F.col("i") >= SIDE - 2, "hu": F.when(F.col("k") % 5 > 0, F.col("j") * 10.0 - 900)})
    out = voxels.corrected(b, voxel_table(spark, tube), 2, -1024.0, -300.0, -980.0)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for c, vs in body.items():
        near = set(tube.get(c, ()))
        for _ in range(2):
            near |= {tuple(a + b for a, b in zip(v, o, strict=True)) for v in near for o in voxels.SIDES}
        for i, j, k in vs:
            hu = j * 10.0 - 900 if k % 5 else None
            known = min(x for x in (hu, -300.0) if x is not None)
            want[c, i, j, k] = -980.0 if (i, j, k) in tube.get(c, ()) else -1024.0 if i < SIDE - 2 else known if (i, j, k) in near else hu
    assert {tuple(r[:4]): r.hu for r in out.collect()} == want


def test_pointer_jumps_do_not_go_through_the_driver(spark, monkeypatch):
    """tables of all nodes are merged, also where their size would let Spark broadcast them."""
    plans, observed, stored = [], loops.observed, graphs.stored
    monkeypatch.setattr(loops, "observed", lambda df, tag, **v: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or observed(df, tag, **v))
    monkeypatch.setattr(graphs, "stored", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or stored(df, tag))
    up = spark.range(40).selectExpr("1 as case_id", "id as node", "case when id > 0 then id - 1 end as up", "1 as depth")
    top = loops.climbed(up, "climb", {"depth": lambda a, b: a + b})
    assert {(r.node, r.top, r.depth) for r in top.collect()} == {(n, 0, n + 1) for n in range(40)}
    way = graphs.written(up.where("up is not null").select("case_id", "node", "up"), spark.sql("select 1 as case_id, 39L as node, 39 as depth"), 39)
    assert sorted((r.place, r.node) for r in way.collect()) == [(n, n) for n in range(40)]
    assert {tag for tag, _ in plans} >= {"climb", "jump", "way"}
    assert not [tag for tag, plan in plans if "BroadcastHashJoin" in plan]
