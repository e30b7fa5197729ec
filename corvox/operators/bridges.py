"""Component bridging on the graph of gaps between components.

The least gap of every two components within the limit is found once, for all of them together,
box by box (operators/boxes.py) with a margin as wide as the limit. The growth itself, largest component
first, then only looks at these gaps: one small group of rows for each case. A bridge is a new
thing that later components can hang on; its gaps are measured when a growth has used it, and
the growth is done again until it uses no bridge that is not measured. Rounds follow the depth
of bridges that hang on bridges, not the number of components.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvox.operators.boxes import SIDE, Box, by_box, dealt
from corvox.operators.voxels import KEY, SIDES, ranked_components
from corvox.sources.scratch import stored

ENDS = ["pi", "pj", "pk", "qi", "qj", "qk"]
KEPT, ATTACHED, SMALL, UNBRIDGED = "kept", "attached", "below_minimum", "unbridged"


def gaps_by_cells(parts: DataFrame, goals: DataFrame, limit: float, spacing: tuple[float, float, float]) -> DataFrame:
    """gaps() by a join of cells as wide as the limit, for limits of many voxels."""
    width = max(limit, 1e-6)
    cell = lambda a, s: F.floor(F.col(a) * s / width).cast("long")
    around = F.explode(F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip("ijk", o, strict=True))) for o in product((-1, 0, 1), repeat=3))))
    p = parts.withColumn("o", around).select("case_id", F.col("rank"), *(F.col(a).alias(f"p{a}") for a in "ijk"), *((cell(a, s) + F.col(f"o.{a}")).alias(f"c{a}") for a, s in zip("ijk", spacing, strict=True)))
    q = goals.select("case_id", "to", "line", *(F.col(a).alias(f"q{a}") for a in "ijk"), *(cell(a, s).alias(f"c{a}") for a, s in zip("ijk", spacing, strict=True)))
    d2 = sum(((F.col(f"p{a}") - F.col(f"q{a}")) * s) ** 2 for a, s in zip("ijk", spacing, strict=True))
    # Spark's estimate leaves out that p has 27 rows a voxel
    met = p.hint("merge").join(q.hint("merge"), ["case_id", "ci", "cj", "ck"]).where("rank > to").withColumn("gap", F.sqrt(d2)).where(F.col("gap") <= limit)
    least = met.groupBy("case_id", "rank", "to", "line").agg(F.min(F.struct("gap", *ENDS)).alias("m"))
    return least.select("case_id", "rank", "to", "line", "m.*")


#: Pairs of voxels that a box keeps before it looks for the least of them.
PAIRS = 1 << 20


def first_pairs(found: list[np.ndarray]) -> np.ndarray:
    """Of columns (rank, to, line, gap, p, q) the least (gap, p, q) for each of the first three."""
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    return rows[:, first]


def gaps(parts: DataFrame, goals: DataFrame | None, limit: float, spacing: tuple[float, float, float]) -> DataFrame:
    """The least gap from each component of parts(*KEY, rank), one rank a voxel, to each thing of goals(*KEY, to, line) of a lower rank, at most `limit` mm; the first (p, q) of equals. Without goals, to each other component.

    A box has its own voxels p and the goals up to the limit around it, so only the least gaps of
    each box are merged.
    """
    reach = [max(1, int(limit / s + 1e-6)) for s in spacing]
    margin = max(reach)
    if margin > SIDE // 2:
        return gaps_by_cells(parts, parts.withColumn("to", F.col("rank")).withColumn("line", F.lit(None).cast("string")) if goals is None else goals, limit, spacing)
    far = {o: float(np.sqrt(sum((d * s) * (d * s) for d, s in zip(o, spacing, strict=True)))) for o in product(*(range(-r, r + 1) for r in reach))}
    lengths = sorted({x for x in far.values() if x <= limit})
    offsets = sorted((lengths.index(x), o) for o, x in far.items() if x <= limit)
    kind, none = dict(parts.dtypes)["case_id"], np.iinfo(np.int32).min

    def nearest(key: tuple, p: np.ndarray, rank: np.ndarray, q: np.ndarray, to: np.ndarray, line: np.ndarray, names: list) -> pa.Table:
        box = Box(p, tuple(k.as_py() for k in key[1:]), 2 * margin)
        grid = np.full(box.grid.size, none, np.int32)
        grid[p] = rank
        found = [np.zeros((6, 0), np.int64)]
        for gap, o in offsets:
            at = q + box.step(o)
            met = grid[at]
            hit = np.flatnonzero(met > to)
            if len(hit):
                found.append(np.stack([met[hit], to[hit], line[hit], np.full(len(hit), gap), at[hit], q[hit]]).astype(np.int64))
            if sum(x.shape[1] for x in found) > PAIRS:
                found = [first_pairs(found)]
        rank, to, line, gap, p, q = first_pairs(found)
        ends = dict(zip(ENDS, (*box.world(p), *box.world(q)), strict=True))
        case = pa.array([key[0].as_py()], key[0].type).take(pa.array(np.zeros(len(p), np.int64)))
        return pa.table({"case_id": case, "rank": pa.array(rank.astype(np.int32)), "to": pa.array(to.astype(np.int32)), "line": pa.array([names[n] for n in line], pa.string()), "gap": pa.array(np.array(lengths)[gap])} | {e: pa.array(x) for e, x in ends.items()})

    columns = lambda table, *names: (table.column(c).to_numpy() for c in names)

    def among(key: tuple, table: pa.Table) -> pa.Table:
        at, rank = columns(table, "at", "rank")
        box = Box(at, (0, 0, 0), 2 * margin)
        own, grid = box.inside(at), np.full(box.grid.size, none, np.int32)
        grid[at] = rank
        # a voxel amid its own component is nearest to nothing
        skin = np.logical_or.reduce([grid[at + box.step(o)] != rank for o in SIDES])
        return nearest(key, at[own & skin], rank[own & skin], at[skin], rank[skin], np.zeros(skin.sum(), np.int64), [None])

    def to_goals(key: tuple, there: pa.Table, here: pa.Table) -> pa.Table:
        line = here.column("line").combine_chunks().dictionary_encode("encode")
        return nearest(key, *columns(there, "at", "rank"), *columns(here, "at", "to"), line.indices.to_numpy(), line.dictionary.to_pylist())

    schema = ", ".join([f"case_id {kind}, rank int, to int, line string, gap double", *(f"{e} long" for e in ENDS)])
    if goals is None:
        met = by_box(dealt(parts.select(*KEY, "rank"), 2 * margin, margin), "at", "rank").applyInArrow(among, schema)
    else:
        there = by_box(dealt(parts.select(*KEY, "rank"), 2 * margin, 0), "at", "rank")
        here = by_box(dealt(goals.select(*KEY, "to", "line"), 2 * margin, margin), "at", "to", "line")
        met = there.cogroup(here).applyInArrow(to_goals, schema)
    least = met.groupBy("case_id", "rank", "to", "line").agg(F.min(F.struct("gap", *ENDS)).alias("m"))
    return least.select("case_id", "rank", "to", "line", "m.*")


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """One case: components in order of rank, each with the state that the gaps to what has grown so far give it and the ends of its bridge."""
    near = {}
    for r in rows[rows["gap"].notna()].itertuples():
        near.setdefault(r.rank, []).append((r.gap, tuple(int(getattr(r, e)) for e in ENDS), r.to, r.line))
    used, out = {1: None}, [(1, KEPT, None, *[None] * 6)]
    for rank in sorted(set(rows["rank"]) - {1}):
        open_ = [(gap, ends) for gap, ends, to, line in near.get(rank, []) if to in used and (line is None or line == used[to])]
        if open_:
            gap, ends = min(open_)
            used[rank] = ",".join(map(str, ends))
            out.append((rank, ATTACHED, gap, *ends))
        else:
            out.append((rank, UNBRIDGED, None, *[None] * 6))
    got = pd.DataFrame(out, columns=["rank", "state", "gap", *ENDS])
    got.insert(0, "case_id", [rows["case_id"].iloc[0]] * len(got))
    return got.astype({e: "Int64" for e in ENDS})


def lines(bridges: DataFrame) -> DataFrame:
    """The voxels of each bridge (case_id, rank, *ENDS), from p to q."""
    steps = F.greatest(*(F.abs(F.col(f"q{a}") - F.col(f"p{a}")) for a in "ijk"), F.lit(1))
    at = bridges.withColumn("n", steps).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"))))
    return at.select("case_id", "rank", *ENDS, *(F.bround(F.col(f"p{a}") + (F.col(f"q{a}") - F.col(f"p{a}")) * F.col("s") / F.col("n"), 0).cast("long").alias(a) for a in "ijk"))


def growth(marked: DataFrame, least: int, limit: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Every component's (case_id, component, size, rank, state, gap, *ENDS), and the voxels of the components that take part (*KEY, rank)."""
    r = stored(ranked_components(marked).select("case_id", "component", "size", "rank"), "ranks")
    parts = stored(marked.join(r.where(f"rank = 1 or size >= {least}"), ["case_id", "component"]).select(*KEY, "rank"), "parts")
    known = stored(gaps(parts, None, limit, spacing), "gaps")
    alone = parts.select("case_id", "rank").distinct()
    alone = stored(alone.select(*(F.col(c) if c in alone.columns else F.lit(None).cast(t).alias(c) for c, t in known.dtypes)), "parts")
    schema = ", ".join(f"{c} {t}" for c, t in (("case_id", dict(r.dtypes)["case_id"]), ("rank", "int"), ("state", "string"), ("gap", "double"), *((e, "long") for e in ENDS)))
    measured = None
    for _ in range(rounds):
        state = stored(known.unionByName(alone).groupBy("case_id").applyInPandas(grow, schema), "growth")
        new = state.where(F.col("state") == ATTACHED).select("case_id", "rank", *ENDS)
        new = stored(new if measured is None else new.join(measured, new.columns, "left_anti"), "bridges")
        if new.isEmpty():
            small = r.join(state.select("case_id", "rank"), ["case_id", "rank"], "left_anti").withColumn("state", F.lit(SMALL))
            return r.join(state, ["case_id", "rank"]).unionByName(small, allowMissingColumns=True), parts
        goal = lines(new).select(*KEY, F.col("rank").alias("to"), F.concat_ws(",", *ENDS).alias("line"))
        grown = parts.join(new.select("case_id").distinct(), "case_id", "left_semi")
        known = known.unionByName(stored(gaps(grown, goal, limit, spacing), "gaps"))
        measured = new if measured is None else measured.union(new)
    raise RuntimeError("bridges did not settle")


def bridged(marked: DataFrame, least: int, limit: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The largest component, with those of at least `least` voxels whose gap to what has grown so far is at most `limit` mm, joined by straight voxel lines."""
    state, parts = growth(marked, least, limit, spacing)
    held = state.where(F.col("state").isin(KEPT, ATTACHED)).select("case_id", "rank")
    return parts.join(held, ["case_id", "rank"], "left_semi").select(*KEY).union(lines(state.where(F.col("state") == ATTACHED)).select(*KEY)).distinct()


def topology(marked: DataFrame, least: int, limit: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The report of bridged() for each case: voxels before and after, and how many components were kept whole, attached, too small or left unbridged."""
    state, parts = growth(marked, least, limit, spacing)
    state = stored(state, "states")
    held = state.where(F.col("state").isin(KEPT, ATTACHED))
    inside = parts.join(held.select("case_id", "rank"), ["case_id", "rank"], "left_semi").withColumnRenamed("rank", "part")
    drawn = lines(state.where(F.col("state") == ATTACHED)).groupBy(*KEY).agg(F.min("rank").alias("rank"))
    drawn = drawn.join(inside, KEY, "left")
    new = drawn.groupBy("case_id").agg(F.count_if(F.col("part").isNull() | (F.col("part") > F.col("rank"))).alias("bridge_voxels"), F.count_if(F.col("part").isNull()).alias("added"))
    n = lambda s: F.count_if(F.col("state") == s)
    size = lambda ok: F.sum(F.when(ok, F.col("size")).otherwise(0))
    g = state.groupBy("case_id").agg(F.count("*").alias("components"), F.sum("size").alias("original_voxels"), size(F.col("state").isin(KEPT, ATTACHED)).alias("held"), n(ATTACHED).alias("attached"), n(SMALL).alias("below_minimum"), n(UNBRIDGED).alias("unbridged"))
    g = g.join(new, "case_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("bridge_voxels", "added")})
    return g.select("case_id", "original_voxels", (F.col("held") + F.col("added")).alias("repaired_voxels"), "components", (1 + F.col("attached")).alias("kept"), (F.col("components") - 1 - F.col("attached")).alias("removed"), "attached", "bridge_voxels", "below_minimum", "unbridged")
