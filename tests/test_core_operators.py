"""Small fixtures with known results."""

import itertools
import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from corvox.functions import columns as c
from corvox.operators import audit, bridges, frames, graphs, loops, series, voxels
from corvox.sources import files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_neighbours_and_time(spark):
    f = spark.createDataFrame([("s", i, f"f{i}") for i in range(3)], "s string, i int, id string")
    assert frames.neighbours(f, "s", "i", "id", 1).where("i = 1").first()["neighbours"] == ["f0", "f2"]
    assert f.select(c.frame_time(F.col("i"), 10.0)).collect()[1][0] == 0.1
    with pytest.raises(ValueError):
        c.frame_time(F.col("i"), 0)


def test_condition_falls_back_to_suffix(spark):
    rgb = spark.createDataFrame([("a/1.png",), ("a.b.png",)], "path string")
    other = spark.createDataFrame([("pps", "a/1.npy"), ("pps", "a.tif")], "modality string, file string")
    assert rows(frames.conditions(rgb, other), "path", "file") == [("a.b.png", "a.tif"), ("a/1.png", "a/1.npy")]


def test_flicker(spark):
    flat = [("u", i, [float(v)] * 4) for i, v in enumerate((20, 40, 60, 80))]
    stripes = [("v", i, [0.0, 9.0] * 2 if i % 2 else [9.0, 0.0] * 2) for i in range(3)]
    s = frames.consistency(spark.createDataFrame(flat + stripes, "video_id string, frame_index int, gray array<float>"))
    got = {r["video_id"]: r["flicker_mean"] for r in s.collect()}
    assert got["u"] < 1e-6 < 0.05 < got["v"]
    one = spark.createDataFrame([*flat, ("w", 0, [1.0] * 4)], "video_id string, frame_index int, gray array<float>")
    with pytest.raises(Exception, match="fewer than two frames in video w"):
        frames.consistency(one).collect()
    with pytest.raises(Exception, match="frame size changes"):
        frames.consistency(spark.createDataFrame([*flat, ("u", 9, [1.0])], "video_id string, frame_index int, gray array<float>")).collect()


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_changes_across_partitions(spark, parts):
    r = random.Random(int(parts))
    data = {(v, i): [r.random() for _ in range(6)] for v in range(4) for i in range(r.choice((2, 3, 30)))}
    f = spark.createDataFrame([(v, i, g) for (v, i), g in data.items()], "video_id int, frame_index int, gray array<double>")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(x["video_id"], x["frame_index"]): (x["abs_diff"], x["flicker"], x["luminance"]) for x in frames.differences(f).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for (v, i), g in data.items():
        if i:
            d = [a - b for a, b in zip(g, data[v, i - 1], strict=True)]
            mid = statistics.median(d)
            want[v, i] = tuple(sum(x) / 6 for x in (map(abs, d), (abs(y - mid) for y in d), d))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_split(spark):
    r = spark.createDataFrame([("one", f"p{i}", 1) for i in range(6)], "category string, patient string, image_count int")
    a = audit.group_split(r, 0.5, 0.25, 0.25, "unit-test-split")
    assert rows(a.groupBy("split").count(), "split", "count") == [("test", 2), ("train", 2), ("validation", 2)]
    assert audit.leaks(a).isEmpty()
    with pytest.raises(ValueError):
        audit.check_fractions(0.5, 0.5, 0.5, "x")


def test_overlap(spark):
    v = lambda ks: spark.createDataFrame([("x", 0, 0, k) for k in ks], "case_id string, i int, j int, k int")
    o = voxels.overlap(v([0, 1]), v([1, 2])).first()
    assert (o["dice"], o["precision"], o["recall"]) == (0.5, 0.5, 0.5)


def test_depth_codes_and_aperture(spark):
    d = spark.createDataFrame([(0.0,), (47.5,), (95.0,), (120.0,)], "d double")
    assert [r[0] for r in d.select(c.depth_code(F.col("d"), 95.0)).collect()] == [0, 32768, 65535, 65535]
    assert spark.range(1).select(c.focal_length(F.lit(640), F.lit(480), F.lit(90.0))).first()[0] == pytest.approx(400.0)


def test_bridge(spark):
    v = spark.createDataFrame([("x", i, 3, 3) for i in (2, 3, 4, 5, 9, 10, 11, 12)], "case_id string, i int, j int, k int")
    marked = voxels.labelled(v)
    assert bridges.topology(marked, 3, 6.0).first().asDict() == {"case_id": "x", "original_voxels": 8, "repaired_voxels": 11, "components": 2, "kept": 2, "removed": 0, "attached": 1, "bridge_voxels": 3, "below_minimum": 0, "unbridged": 0}
    grown = bridges.bridged(marked, 3, 6.0)
    assert (7, 3, 3) in rows(grown, "i", "j", "k")
    assert bridges.topology(voxels.labelled(grown), 3, 6.0).first()["components"] == 1
    assert bridges.topology(marked, 3, 2.0).first()["unbridged"] == 1 and bridges.topology(marked, 5, 6.0).first()["below_minimum"] == 1


def bridged(voxels_, least, limit):
    """Rank by rank, as the operator's text says."""
    left, parts = set(voxels_), []
    while left:
        todo, part = [min(left)], set()
        while todo:
            v = todo.pop()
            if v in left:
                left.remove(v)
                part.add(v)
                todo += [tuple(a + d for a, d in zip(v, o, strict=True)) for o in itertools.product((-1, 0, 1), repeat=3)]
        parts.append(part)
    parts.sort(key=lambda x: (-len(x), min(x)))
    grown = set(parts[0])
    for part in parts[1:]:
        if len(part) >= least:
            d, p, q = min((math.dist(p, q), p, q) for p in part for q in grown)
            if d <= limit:
                n = max(1, *(abs(a - b) for a, b in zip(p, q, strict=True)))
                grown |= part | {tuple(round(a + (b - a) * s / n) for a, b in zip(p, q, strict=True)) for s in range(n + 1)}
    return grown


@pytest.mark.parametrize("seed", range(3))
def test_bridges_against_brute_force(spark, seed):
    r = random.Random(seed)
    cases = {c: {(r.randrange(14), r.randrange(9), r.randrange(5)) for _ in range(r.randint(40, 90))} for c in "ab"}
    v = spark.createDataFrame([(c, *x) for c, xs in cases.items() for x in xs], "case_id string, i int, j int, k int")
    got = rows(bridges.bridged(voxels.labelled(v), 2, 3.0), "case_id", "i", "j", "k")
    assert got == sorted((c, *x) for c, xs in cases.items() for x in bridged(xs, 2, 3.0))


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_long_chains_take_few_jobs(spark):
    """5,000 nodes in a row, entered in the middle of a stretch that is too narrow."""
    n = 5000
    e = spark.range(n - 1).selectExpr("'x' as case_id", "id as src", "id + 1 as dst")
    nodes = spark.range(n).selectExpr("'x' as case_id", "id", "id as node_ord", "cast(id as double) as x", "0.0D as y", "0.0D as z", "case when id < 100 then 1.0D else 5.0D end as radius", "true as accessible", "cast(id as double) as dist")
    start = spark.createDataFrame([("x", 40)], "case_id string, id long")
    seen, jobs = jobs_of(spark, "reached", lambda: rows(loops.reached(start, e), "id", "depth"))
    assert seen == [(k, k - 40) for k in range(40, n)] and jobs < 120
    got, jobs = jobs_of(spark, "routes", lambda: graphs.routes(nodes, e, start, 2.5, 1e9).collect())
    assert [(r["id"], r["route"][0], len(r["route"]), r["length"], r["least_radius"]) for r in got] == [(n - 1, 100, n - 100, n - 101.0, 5.0)] and jobs < 300


def test_entry_moves_to_the_nearest_passable_node(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("b", "f"), ("g", "a")]
    wide = dict.fromkeys("cdeg", 4.0)
    nodes = spark.createDataFrame([("x", i, k, float(k), 0.0, 0.0, wide.get(i, 1.0), True) for k, i in enumerate("abcdefg")], "case_id string, id string, node_ord int, x double, y double, z double, radius double, accessible boolean")
    for extra in ([], [("d", "e")]):  # with a cycle too
        e = spark.createDataFrame([("x", *p) for p in links + extra], "case_id string, src string, dst string")
        at = lambda i: spark.createDataFrame([("x", i)], "case_id string, id string")
        assert rows(graphs.routes(nodes, e, at("f"), 2.5, 100.0), "id", "route") == [("d", ["c", "d"]), ("e", ["c", "e"])]
        assert rows(graphs.routes(nodes, e, at("d"), 2.5, 100.0), "id", "route") == ([("e", ["d", "c", "e"])] if not extra else [("c", ["d", "c"]), ("e", ["d", "e"])])
        assert graphs.routes(nodes, e, at("a"), 2.5, 100.0).isEmpty()  # g is nearest and stands alone
        with pytest.raises(Exception, match="wide enough"):
            graphs.routes(nodes, e, at("a"), 9.0, 100.0).collect()


def test_voxels_outside_the_grid_are_an_error(spark):
    for v in ((-1, 0, 0), (0, voxels.SPAN, 0)):
        with pytest.raises(Exception, match="voxel outside"):
            voxels.labelled(spark.createDataFrame([("x", *v)], "case_id string, i int, j int, k int")).collect()


def test_cap(spark):
    v = spark.createDataFrame([("x", i, j, k) for i in (3, 4) for j in (3, 4) for k in (1, 2, 3, 4, 8, 9)], "case_id string, i int, j int, k int")
    r = voxels.capped(voxels.labelled(v)).first()
    assert (r["size"], r["cap"]) == (8, 4)


def test_access_by_depth(spark):
    n = spark.createDataFrame([("x", "a", 5.0, 0.0), ("x", "b", 5.0, 1.0), ("x", "c", 5.0, 2.0)], "case_id string, id string, radius double, dist double")
    e = spark.createDataFrame([("x", "a", "b"), ("x", "b", "c")], "case_id string, src string, dst string")
    a = graphs.accessible(n, e, n.where("id = 'a'").select("case_id", "id"), 3.0, 1.5)
    assert rows(a, "id", "accessible") == [("a", True), ("b", True), ("c", False)]


def test_series_filter(spark):
    s = spark.createDataFrame([("p2", "s", "u1", "CT", "chest"), ("p1", "s", "u2", None, "CHEST"), ("p3", "s", "u3", "MR", "CHEST")], "patient_id string, study_uid string, series_uid string, modality string, body_part string")
    assert [r["series_uid"] for r in series.listed(s, "CT", "CHEST").collect()] == ["u2", "u1"]


def test_image_sizes(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 5) + b"\0" * 8
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 9, 11) + b"\0" * 12
    for name, data in (("a.png", png), ("b.jpg", jpeg), ("c.jpg", b"\xff\xd8\xff"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = files.image_sizes(spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"))
    assert rows(got, "path", "width", "height") == [("a.png", 7, 5), ("b.jpg", 11, 9), ("c.jpg", None, None), ("d.txt", None, None)]
    assert [r["path"].rsplit("/")[-1] for r in files.catalogue(spark, str(tmp_path), [".png", ".jpg"]).collect()] == ["a.png", "b.jpg", "c.jpg"]


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("x", "a", 1.0, 2.0)], "case_id string, id string, dist double, radius double")
    files.write_radius_profile(n, str(tmp_path / "p"), 4)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    files.write_report(n, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"case_id":"x","dist":1.0,"id":"a","radius":2.0}'


def test_graph_documents_are_bounded(spark, monkeypatch):
    from corvox.plans import records

    monkeypatch.setattr(records, "PART", 7)
    part = spark.createDataFrame([(k, k % 9, 900.0 + k) for k in range(101)], "p_partkey long, p_size int, p_retailprice double")
    docs = records.graphs({"part": part}.get).selectExpr("case_id", "json_array_length(get_json_object(value, '$.nodes')) as n").collect()
    assert len(docs) == 15 and max(r["n"] for r in docs) == 7 and sum(r["n"] for r in docs) == 101
    nodes = rows(records.s5_graph_nodes({"part": part}.get), "case_id", "node_ord", "id")
    assert nodes == [(0, k, f"n{k}") for k in range(101)]
    edges = rows(records.s5_graph_edges({"part": part}.get), "case_id", "edge_ord", "src", "dst")
    assert edges == [(0, k - 1, f"n{(k - 1) // 2}", f"n{k}") for k in range(1, 101)]
