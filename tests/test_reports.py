"""Reports, material maps, mesh openings, percentiles and image headers on small fixtures."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvox.operators import audit, materials, mesh, ranks
from corvox.sources import files


def tube(spark, shape):
    v = spark.createDataFrame([("x", *p) for p in sorted(shape)], "case_id string, i int, j int, k int")
    f = mesh.exposed_faces(v).cache()
    return f, mesh.lattice(f).cache()


def graph(spark, low, high, extra=()):
    nodes = [("x", "n0000", 0, *low, 1.25, True), ("x", "n0001", 1, *high, 1.25, True), *extra]
    n = spark.createDataFrame(nodes, "case_id string, id string, node_ord int, x double, y double, z double, radius double, accessible boolean")
    return mesh.top_opening(n, spark.createDataFrame([("x", "n0000", "n0001"), *(("x", "n0001", e[1]) for e in extra)], "case_id string, src string, dst string"))


def test_only_the_top_end_opens(spark):
    f, v = tube(spark, {(i, j, k) for k in range(1, 6) for i, j in ((2, 2), (1, 2), (3, 2), (2, 1), (2, 3))})
    top = graph(spark, (2.0, 2.0, 1.0), (2.0, 2.0, 5.0))
    assert top.first()[1:] == (2.0, 2.0, 5.0, 0.0, 0.0, 1.0, 1.25)
    assert mesh.edge_report(f).first()["boundary"] == 0
    left = mesh.uncapped(f, v, top)
    report = mesh.cap_report(f, v, top).first()
    assert report["removed"] == f.count() - left.count() > 0 and report["hollow"] and report["openings"] == 1 and report["trim_depth"] == 0
    rim = mesh.boundary_loops(left).join(v, ["case_id", "vid"])
    assert rim.count() > 0 and rim.agg(F.min("z")).first()[0] > 3.0
    none = mesh.top_opening(spark.createDataFrame([], "case_id string, id string, node_ord int, x double, y double, z double, radius double, accessible boolean"), spark.createDataFrame([], "case_id string, src string, dst string"))
    assert mesh.uncapped(f, v, none).count() == f.count() and not mesh.cap_report(f, v, none).first()["hollow"]
    with pytest.raises(Exception, match="every face of case x"):
        mesh.uncapped(f, v, top, scale=9.0, trim=False, margin=50.0).collect()
    with pytest.raises(Exception, match="every face of case x"):
        mesh.repaired(f.withColumn("b", F.col("a")), v).collect()


def test_a_trim_leaves_one_approved_loop(spark):
    f, v = tube(spark, {(i, j, k) for k in range(1, 9) for i, j in ((3, 3), (2, 3), (4, 3), (3, 2), (3, 4))})
    top = graph(spark, (3.0, 3.0, 1.0), (3.0, 3.0, 8.0))
    loops = mesh.boundary_loops(mesh.uncapped(f, v, top, trim=True))
    assert mesh.cap_report(f, v, top, trim=True).first()["trim_depth"] == 1.0
    o = mesh.openings(loops, v, top.select("case_id", "x", "y", "z", "radius")).collect()
    assert len(o) == 1 and o[0]["approved"]


def test_the_opening_follows_a_slanted_leaf(spark):
    """The highest accessible leaf counts, not a higher one that is closed, and its own direction."""
    top = graph(spark, (0.0, 0.0, 0.0), (0.0, 0.0, 4.0), [("x", "n0002", 2, 3.0, 0.0, 8.0, 2.0, True), ("x", "n0003", 3, 0.0, 9.0, 9.0, 2.0, False)]).first()
    assert (top["x"], top["z"], top["radius"]) == (3.0, 8.0, 2.0) and (top["dx"], top["dy"], top["dz"]) == pytest.approx((0.6, 0.0, 0.8))


def test_material_maps_go_entry_by_entry(spark):
    r = random.Random(3)
    pts = [("a" if i % 3 else "b", i, r.random(), r.random(), r.random(), r.randint(0, 3), r.uniform(0, 5), r.random(), r.random(), r.random()) for i in range(60)]
    pts = [(c, n, x, y, z, min(g, 1) if c == "b" else g, *rest) for c, n, x, y, z, g, *rest in pts]  # case b has regions 0 and 1 only
    p = spark.createDataFrame([(*x, 0.5) for x in pts], "case_id string, n int, x double, y double, z double, region int, generation double, distance double, radius_norm double, wet double, albedo_r double")
    regions = [{"regions": "distal", "multipliers": {"wet": 0.5}}, {"regions": [1, "distal"], "opacity": 0.5, "channels": {"wet": 0.9}}, {"opacity": 1e-5, "channels": {"wet": 1000.0}}]
    spots = [{"center": (0.5, 0.5, 0.5), "radius": 0.3, "multipliers": {"wet": 0.2}}, {"center": (0.2, 0.2, 0.2), "falloff": 2.0, "channels": {"wet": 0.4}, "multipliers": {"wet": 1.1}, "albedo_delta_rgb": [2.0, 0.0, 0.0]}]
    got = {x["n"]: (x["wet"], x["albedo_r"]) for x in materials.overlaid(p, regions, spots).collect()}
    for _, n, x, y, z, g, _, _, _, wet in pts:
        wet *= 0.5 if g == 3 else 1
        wet += 0.45 if g in (1, 3) else 0
        w = math.exp(-sum((a - 0.5) ** 2 for a in (x, y, z)) / 0.09)
        wet *= 1 + w * (0.2 - 1)
        w = math.exp(-sum((a - 0.2) ** 2 for a in (x, y, z)) / 0.16)
        wet = (wet + w * 0.4) * (1 + w * (1.1 - 1))
        assert got[n] == pytest.approx((min(max(wet, 0), 1), 0.5 + 2 * w))
    report = {(x["case_id"], x["kind"], x["place"]): (x["points"], x["peak"]) for x in materials.overlay_report(p, regions, spots).collect()}
    assert {k[1:] for k in report if k[0] == "a"} == {("region", 0), ("region", 1), ("spot", 0), ("spot", 1)}
    assert {k[1:] for k in report if k[0] == "b"} == {("region", 1), ("spot", 0), ("spot", 1)}  # no distal point: entry 0 is left out there
    assert report["a", "region", 0] == (sum(x[0] == "a" and x[5] == 3 for x in pts), 1.0)
    assert materials.overlaid(p, [], []).count() == len(pts)
    for bad in ({"regions": "elbow"}, {"regions": 4}, {"regions": True}):
        with pytest.raises(ValueError):
            materials.entry_weight(bad)


@pytest.mark.parametrize("small", [3, 50, 10_000])
def test_percentiles_of_large_groups(spark, small):
    """Bracketed ranks are exact: ties that hold most of a group, tails over many magnitudes, null groups."""
    r = random.Random(small)
    data = {"ties": [7.0] * 4000 + [r.gauss(7, 1) for _ in range(300)], "tails": [10 ** r.uniform(-9, 9) * r.choice((-1, 1)) for _ in range(3000)], None: [float(r.randint(0, 40)) for _ in range(2500)], "one": [3.5], "two": [1.0, 2.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("ties", None), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = {"least": 0.0, "p05": 0.05, "mid": 0.5, "p951": 0.951, "most": 1.0}
    got = {x["g"]: [x[k] for k in shares] for x in ranks.percentiles(df, "v", shares, ("g",), small).collect()}
    assert got == {k: pytest.approx([float(np.quantile(vs, q)) for q in shares.values()], rel=1e-9) for k, vs in data.items()}
    all_ = [v for vs in data.values() for v in vs]
    assert list(ranks.percentiles(df, "v", shares, (), small).first()) == pytest.approx([float(np.quantile(all_, q)) for q in shares.values()], rel=1e-9)


@pytest.mark.parametrize("small", [2, 1 << 18])
def test_percentiles_of_several_values(spark, small):
    """Two values of a group together, nulls in either; a group without any value has no row."""
    rows = [("a", float(i), None if i % 3 else float(i * i)) for i in range(31)] + [("b", 4.0, None), (None, None, 7.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "g string, u double, v double")
    got = {x["g"]: (x["mid"], x["high"], x["low"]) for x in ranks.percentiles_of(df, {"u": {"mid": 0.5, "high": 0.9}, "v": {"low": 0.25}}, ("g",), small).collect()}
    assert got == {"a": (15.0, 27.0, pytest.approx(float(np.quantile([i * i for i in range(0, 31, 3)], 0.25)))), "b": (4.0, 4.0, None), None: (None, None, 7.0)}
    assert tuple(ranks.percentiles_of(df, {"u": {"mid": 0.5}, "v": {"low": 1.0}}, (), small).first()) == (pytest.approx(float(np.median([*range(31), 4]))), 900.0)


def test_observed(spark):
    """Aggregates are taken as rows are written, also where the plan is empty before it runs."""
    from corvox.sources.scratch import observed

    df = spark.range(10)
    kept, n, most = observed(df.where("id > 3"), "seen", n=F.count("*"), most=F.max("id"))
    assert (kept.count(), n, most) == (6, 6, 9)
    for none in (df.where("id > 30"), df.where("false"), df.limit(0), df.where("false").join(df, "id")):
        kept, n, most = observed(none, "seen", n=F.count("*"), most=F.max("id"))
        assert (kept.count(), n, most) == (0, 0, None)


def test_headers_are_read_by_ranges(spark, tmp_path):
    """A JPEG of 3 MB whose size comes after a long segment; every kind of other file."""
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 5) + b"\0" * 8
    long = b"".join(b"\xff\xe1" + struct.pack(">H", 65_000) + b"\xff" * 64_998 for _ in range(20))
    jpeg = b"\xff\xd8" + long + b"\xff\xc2\0\x11\x08" + struct.pack(">HH", 9, 11) + b"\1" * 1_700_000
    cut = b"\xff\xd8" + long
    for name, data in (("a.png", png), ("b.jpg", jpeg), ("c.jpg", cut), ("d.jpg", b"\xff\xd8\xff"), ("e.txt", b"x"), ("f.jpg", b""), ("g.jpg", b"\xff\xd8\0\0\xff\xff\xc0\0\x11\x08\0\x04\0\x03")):
        (tmp_path / name).write_bytes(data)
    listed = files.catalogue(spark, str(tmp_path), [".png", ".jpg", ".txt"]).select("path")
    got = {r["path"].rsplit("/")[-1]: r for r in files.image_headers(listed.union(spark.createDataFrame([(str(tmp_path / x),) for x in ("f.jpg", "gone.png")], "path string"))).collect()}
    want = {"a.png": (7, 5), "b.jpg": (11, 9), "g.jpg": (3, 4)}
    assert {k: (r["width"], r["height"]) for k, r in got.items()} == {k: want.get(k, (None, None)) for k in ("a.png", "b.jpg", "c.jpg", "d.jpg", "e.txt", "f.jpg", "g.jpg", "gone.png")}
    assert got["b.jpg"]["bytes_read"] < 22 * files.HEADER < len(jpeg) / 30
    whole = files.image_sizes(spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")).collect()
    assert {r["path"]: (r["width"], r["height"]) for r in whole} == {k: (r["width"], r["height"]) for k, r in got.items() if k not in ("f.jpg", "gone.png")}  # empty files are not listed


def test_data_set_audit(spark, tmp_path):
    one = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 1, 1) + b"\0" * 8
    names = ["Lung_cancer/imgs/patient-a/video-1/000.png", "Lung_cancer/imgs/patient-a/video-1/001.png", "Non_lung_cancer/imgs/patient-b/video-2/000.png", "Lung_cancer/annotation.json", "Non_lung_cancer/labels.json", "Lung_cancer/other.json"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(one if n.endswith("png") else b"{}")
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    sizes = lambda some: files.image_headers(some.select(F.concat(F.lit(f"{tmp_path}/"), "path").alias("path"))).select(F.substring("path", len(str(tmp_path)) + 2, 10**6).alias("path"), "width", "height")
    got = {r["category"]: r for r in audit.dataset_audit(listed, sizes, 1).collect()}
    lung, rest = got["lung_cancer"], got["non_lung_cancer"]
    assert (lung["images"], lung["patients"], lung["videos"], lung["metadata_files"]) == (2, 1, 1, ["Lung_cancer/annotation.json"])
    assert [tuple(x) for x in lung["samples"]] == [(names[0], 1, 1)]
    assert (rest["images"], rest["metadata_files"]) == (1, ["Non_lung_cancer/labels.json"]) and got.keys() == {"lung_cancer", "non_lung_cancer"}
    empty = {r["category"]: r["images"] for r in audit.dataset_audit(listed.limit(0), sizes, 3).collect()}
    assert empty == {"lung_cancer": 0, "non_lung_cancer": 0}
    with pytest.raises(ValueError):
        audit.dataset_audit(listed, sizes, -1)


def test_split_reports(spark):
    r = spark.createDataFrame([("lung_cancer", f"patient-{i}", i) for i in range(6)], "category string, patient string, image_count long")
    a = audit.group_split(r, 0.5, 0.25, 0.25, "unit-test-split").cache()
    assert {x["split"]: x["patients"] for x in audit.split_totals(a).collect()} == {"train": 2, "validation": 2, "test": 2}
    listed = audit.split_patients(a).where("split = 'train'").orderBy("place").collect()
    assert [x["place"] for x in listed] == [0, 1] and listed[0]["patient"] < listed[1]["patient"]
    assert tuple(audit.leak_report(a).first()) == (False, 0, 6, 15)
    assert tuple(audit.leak_report(a.limit(0)).first()) == (False, 0, 0, 0)
