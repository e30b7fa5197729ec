"""Windows along sequences that are longer than a block, against plain loops."""

import math
import random

import numpy as np
import pytest

from corvox.operators import motion, scans


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_very_long_episode(many_parts):
    """10^6 frames of one episode, over 40 partitions."""
    n = 1_000_000
    p = many_parts.range(0, n, 1, 40).selectExpr("'e' as case_id", f"(id * 7919) % {n} as ord").selectExpr("case_id", "ord", "sin(ord / 50.0D) as x", "cos(ord / 70.0D) as y", "ord / 1000.0D as z")
    got = motion.arc_length(p, "case_id", "ord").select("ord", "step", "s").toPandas().sort_values("ord")
    t = np.arange(n)
    at = np.stack([np.sin(t / 50.0), np.cos(t / 70.0), t / 1000.0], 1)
    step = np.concatenate([[0.0], np.sqrt((np.diff(at, axis=0) ** 2).sum(1))])
    assert (got["ord"].to_numpy() == t).all()
    assert np.allclose(got["step"], step, atol=1e-12) and np.allclose(got["s"], np.cumsum(step), atol=1e-6)


@pytest.mark.parametrize("size", [7, 16, 1000])
def test_blocks_against_loops(many_parts, monkeypatch, size):
    monkeypatch.setattr(scans, "SIZE", size)
    r = random.Random(size)
    seqs = {k: [(r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9), r.choice("aab")) for _ in range(n)] for k, n in (("a", 100), ("b", 6), (None, 31), ("c", 1), ("d", 7), ("e", 14))}
    rows = [(k, i, *x) for k, xs in seqs.items() for i, x in enumerate(xs)]
    r.shuffle(rows)
    p = many_parts.createDataFrame(rows, "case_id string, ord int, x double, y double, z double, phase string")
    arc = motion.arc_length(p, "case_id", "ord").cache()
    lengths = {}
    for k, xs in seqs.items():
        s = 0.0
        for i, x in enumerate(xs):
            step = math.dist(x[:3], xs[i - 1][:3]) if i else 0.0
            s += step
            lengths[k, i] = step, s
    assert {(x["case_id"], x["ord"]): pytest.approx((x["step"], x["s"])) for x in arc.collect()} == lengths
    assert set(arc.columns) == {*p.columns, "step", "s"}
    want = {k: [x[0] for x in xs] for k, xs in seqs.items()}
    for _ in range(2):
        want = {k: [sum(xs[max(0, i - 3) : i + 4]) / len(xs[max(0, i - 3) : i + 4]) if len(xs) >= 7 and 0 < i < len(xs) - 1 else x for i, x in enumerate(xs)] for k, xs in want.items()}
    got = {(x["case_id"], x["ord"]): x["x"] for x in motion.smoothed(p, "case_id", "ord", ["x"]).collect()}
    assert got == {(k, i): pytest.approx(x) for k, xs in want.items() for i, x in enumerate(xs)}
    runs = {}
    for k, xs in seqs.items():
        run = 0
        for i, x in enumerate(xs):
            run += i == 0 or x[3] != xs[i - 1][3]
            old = runs.get((k, run), (0, 0.0))
            runs[k, run] = old[0] + 1, old[1] + lengths[k, i][0]
    assert {(x["case_id"], x["run"]): pytest.approx((x["frames"], x["distance"])) for x in motion.phases(arc, "case_id", "ord", "phase", "step").collect()} == runs
    samples = {}
    for k, xs in seqs.items():
        end = lengths[k, len(xs) - 1][1]
        for i in range(len(xs) - 1):
            d0, d1 = lengths[k, i][1], lengths[k, i + 1][1]
            at = [2.5 * j for j in range(math.ceil(d0 / 2.5), math.ceil(d1 / 2.5))] + [end] * (d1 == end)
            for d in at:
                samples[k, round(d, 6)] = xs[i][0] + (xs[i + 1][0] - xs[i][0]) * (d - d0) / (d1 - d0)
    got = {(x["case_id"], round(x["s"], 6)): x["x"] for x in motion.resampled(arc, "case_id", "ord", "s", ["x"], 2.5).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in samples.items()}
    e = many_parts.createDataFrame([(k, i, [*x[:3], 0.0, 0.0, 0.0, 1.0, x[0]]) for k, i, *x in rows], "episode string, frame int, action array<double>")
    got = {(x["episode"], x["frame"]): x["step"] for x in motion.kinematics(e, 20.0).collect()}
    assert got == {k: pytest.approx(v[0]) for k, v in lengths.items() if k[1]}


@pytest.mark.parametrize("size", [5, 1000])
def test_places_and_neighbours_of_long_sequences(many_parts, monkeypatch, size):
    from corvox.operators import frames, ranks

    monkeypatch.setattr(scans, "SIZE", size)
    monkeypatch.setattr(ranks, "SORTED", size)
    seqs = {"a": 43, None: 12, "b": 1, "c": 5}
    rows = [(k, f"{i:03d}/x", i) for k, n in seqs.items() for i in range(n)]
    random.Random(size).shuffle(rows)
    f = many_parts.createDataFrame(rows, "s string, path string, i int")
    assert sorted((str(x["s"]), x["i"], x["frame_index"]) for x in frames.indexed(f, "s", "path").collect()) == sorted((str(k), i, i) for k, _, i in rows)
    near = {(x["s"], x["i"]): x["neighbours"] for x in frames.neighbours(f, "s", "i", "path", 2).collect()}
    assert near == {(k, i): [f"{j:03d}/x" for j in range(max(0, i - 2), min(seqs[k], i + 3)) if j != i] for k, _, i in rows}
    assert sorted((str(x["s"]), x["i"]) for x in frames.strided(f, "s", "i", 4, 3).collect()) == sorted((str(k), i) for k, _, i in rows if i in (0, 4, 8))
    picks = {k: set(range(n)) if n <= 4 else {round(j * (n - 1) / 3) for j in range(4)} for k, n in seqs.items()}
    assert sorted((str(x["s"]), x["i"]) for x in frames.evenly_spaced(f, "s", "i", 4).collect()) == sorted((str(k), i) for k, v in picks.items() for i in v)
