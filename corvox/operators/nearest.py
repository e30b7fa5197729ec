"""Nearest neighbours in space: few nodes of a case are sent to its points, many are met by two octrees.

Points of a case with at most FEW nodes are dealt to batches and meet all its nodes in the
batch's task, so only they and a batch's nodes go through a shuffle. Other cases take two
octrees, one over the points and one over what they look for. A tree is a table of its boxes, each with the tight bounds of what it holds; boxes of at most
LEAF places are not divided. Pairs of a point box and a node box go down both trees together:
of the node boxes beside one point box those stay whose least distance is not above the
smallest greatest distance to any of them. What is left are pairs of small boxes; there every
point bounds its own node boxes once more before it meets their nodes. No level pairs all
points with all nodes, and far outliers only add boxes along their way.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvox.operators.ranks import ranked
from corvox.sources.scratch import observed, stored

#: Nodes of a case whose points meet all of them, and about how many points do so in a task.
FEW, BATCH = 1024, 1 << 16
#: Points that meet the nodes at once.
AT_ONCE = 1024
#: Places of a box that is not divided, and levels below the root at most.
LEAF, DEPTH = 8, 20
#: Levels that are counted at once; those below only where boxes are still too full.
STEP = 6
#: Places of a smallest cell from which on ranks are halved instead.
CROWD = 64
CELL = ["level", "cx", "cy", "cz"]
SIDES = [f"{n}_{a}" for a in "xyz" for n in ("low", "high")]
#: Distances compare with a margin for rounding.
MARGIN = 1 + 1e-12


def add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def celled(places: DataFrame) -> DataFrame:
    """places(case_id, x, y, z) with the cell of each at the deepest level, in a cube around its case."""
    size = places.groupBy("case_id").agg(*(F.min(a).alias(f"o{a}") for a in "xyz"), F.greatest(*(F.max(a) - F.min(a) for a in "xyz")).alias("size"))
    cell = lambda a: F.least(F.lit((1 << DEPTH) - 1), F.floor(F.when(F.col("size") > 0, (F.col(a) - F.col(f"o{a}")) / F.col("size")).otherwise(0.0) * (1 << DEPTH))).cast("long")
    return places.join(size, "case_id").withColumns({f"c{a}": cell(a) for a in "xyz"}).drop("ox", "oy", "oz", "size")


def ranked_cells(places: DataFrame) -> DataFrame:
    """As celled(), by the ranks of the places along each axis."""
    n = places.groupBy("case_id").agg(F.count("*").alias("total"))
    out = places.join(n, "case_id")
    for k, a in enumerate("xyz"):
        order = ("xyz"[k:] + "xyz"[:k])
        out = ranked(out, *order, by=("case_id",)).withColumn(f"c{a}", F.expr(f"place * {1 << DEPTH} div total")).drop("place")
    return out.drop("total")


def up(c: str, level: Column) -> Column:
    return F.call_function("shiftright", F.col(c), (DEPTH - level).cast("int"))


def tree(places: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Boxes (case_id, *CELL, n, leaf, *SIDES, parent cell p*), and the places with the leaf box of each."""
    cells = celled(places)
    known = divided(cells, tag)
    if not known.where(f"level = {DEPTH} and n > {CROWD}").isEmpty():
        cells = stored(ranked_cells(places), tag)
        known = divided(cells, tag)
    ends = known.where("leaf").select("case_id", *CELL)
    low, high = ends.agg(F.min("level"), F.max("level")).first()
    at = cells.select(*(c for c in cells.columns if c not in ("cx", "cy", "cz")), *(F.col(f"c{a}").alias(f"d{a}") for a in "xyz"), F.explode(F.sequence(F.lit(low or 0), F.lit(high or 0))).alias("level"))
    at = at.withColumns({f"c{a}": up(f"d{a}", F.col("level")) for a in "xyz"}).join(ends, ["case_id", *CELL]).drop("dx", "dy", "dz")
    return known, stored(at, tag)


def divided(cells: DataFrame, tag: str) -> DataFrame:
    """The boxes of a tree over cells."""
    known, rest = None, cells.select("case_id", "x", "y", "z", *(F.col(f"c{a}").alias(f"d{a}") for a in "xyz"))
    for first in range(0, DEPTH + 1, STEP):
        last = min(first + STEP - 1, DEPTH)
        rows = rest.select("case_id", "x", "y", "z", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level"), "dx", "dy", "dz").withColumns({f"c{a}": up(f"d{a}", F.col("level")) for a in "xyz"})
        boxes = rows.groupBy("case_id", *CELL).agg(F.count("*").alias("n"), *(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("low", F.min), ("high", F.max))))
        boxes = boxes.withColumns({f"p{a}": F.expr(f"shiftright(c{a}, 1)") for a in "xyz"} | {"leaf": (F.col("n") <= LEAF) | (F.col("level") == DEPTH)})
        boxes = stored(boxes, tag)
        inner = boxes.where("not leaf").select("case_id", (F.col("level") + 1).alias("level"), *(F.col(f"c{a}").alias(f"p{a}") for a in "xyz"))
        more = boxes.where(f"level = {first}").unionByName(boxes.join(inner, ["case_id", "level", "px", "py", "pz"], "left_semi"))
        known = more if known is None else known.unionByName(more)
        open_ = boxes.where(f"level = {last} and not leaf").select("case_id", *(F.col(f"c{a}").alias(f"e{a}") for a in "xyz"))
        if open_.isEmpty():
            break
        rest = rest.withColumns({f"e{a}": up(f"d{a}", F.lit(last)) for a in "xyz"}).join(open_, ["case_id", "ex", "ey", "ez"], "left_semi").drop("ex", "ey", "ez")
    return stored(known, tag)


def side(boxes: DataFrame, s: str) -> DataFrame:
    """For each box what takes its place in the next round: its children, or itself if it is a leaf. All columns but case_id begin with s."""
    keep = lambda at, cell: boxes.select("case_id", at.alias(f"{s}level"), *(F.col(f"{cell}{a}").alias(f"{s}c{a}") for a in "xyz"), F.struct(*CELL).alias(f"{s}next"), F.col("leaf").alias(f"{s}leaf"), *(F.col(c).alias(s + c) for c in SIDES))
    kids = keep(F.col("level") - 1, "p").where(F.col(f"{s}next.level") > 0)
    return kids.unionByName(keep(F.col("level"), "c").where(f"{s}leaf"))


def gaps(inner: dict[str, tuple[Column, Column]], outer: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """Least and greatest squared distance between two boxes, given as (low, high) by axis."""
    least = add([F.greatest(F.lit(0.0), inner[a][0] - outer[a][1], outer[a][0] - inner[a][1]) ** 2 for a in "xyz"])
    most = add([F.greatest(inner[a][1] - outer[a][0], outer[a][1] - inner[a][0]) ** 2 for a in "xyz"])
    return least, most


def sides(s: str) -> dict[str, tuple[Column, Column]]:
    return {a: (F.col(f"{s}low_{a}"), F.col(f"{s}high_{a}")) for a in "xyz"}


def nearest(points: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """points(case_id, *key, x, y, z) with the nearest of nodes(case_id, node_ord, x, y, z) of their case and its distance, the lowest node_ord of equals: (case_id, *key, x, y, z, node_ord, distance).

    Points and nodes with a null or non-finite coordinate, and points of cases without nodes, are left out.
    """
    whole = " and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('infinity')" for a in "xyz")
    as_double = lambda df, *cols: df.select("case_id", *cols, *(F.col(a).cast("double").alias(a) for a in "xyz")).where(whole)
    goals = stored(as_double(nodes, "node_ord").groupBy("case_id", "x", "y", "z").agg(F.min("node_ord").alias("node_ord")), "goals")
    many, n = observed(goals.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("case_id"), "many", n=F.count("*"))
    places = stored(as_double(points, *key), "places")
    if not n:
        return near_few(places, goals, key)
    few = near_few(*(df.join(many, "case_id", "left_anti") for df in (places, goals)), key)
    return few.unionByName(near_many(*(df.join(many, "case_id", "left_semi") for df in (places, goals)), key))


def near_few(places: DataFrame, goals: DataFrame, key: list[str]) -> DataFrame:
    """nearest() for cases with few nodes: every batch of points meets all nodes of its case."""
    size = places.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > BATCH).select("case_id", F.ceil(F.col("n") / BATCH).alias("batches"))
    size, n = observed(size, "batches", n=F.count("*"))
    batches = F.coalesce("batches", F.lit(1)).cast("long") if n else F.lit(1).cast("long")
    sized = lambda df: df.join(size, "case_id", "left") if n else df
    p = sized(places).select("case_id", *key, "x", "y", "z", (F.floor(F.rand(0) * batches) if n else F.lit(0).cast("long")).alias("batch"))
    g = sized(goals).select("case_id", "x", "y", "z", "node_ord", F.explode(F.sequence(F.lit(0).cast("long"), batches - 1)).alias("batch"))
    kinds = dict(goals.dtypes)
    schema = ", ".join([*(f"`{c}` {k}" for c, k in places.dtypes), f"node_ord {kinds['node_ord']}", "distance double"])

    def meet(here: pa.Table, there: pa.Table) -> pa.Table:
        here, there = here.drop_columns(["batch"]), there.sort_by("node_ord")
        if not (len(here) and len(there)):
            return here.slice(0, 0).append_column("node_ord", there.column("node_ord").slice(0, 0)).append_column("distance", pa.array([], pa.float64()))
        at, goal = ([t.column(c).to_numpy() for c in "xyz"] for t in (here, there))
        best, least = np.empty(len(here), np.int64), np.empty(len(here))
        for first in range(0, len(here), AT_ONCE):
            part = slice(first, first + AT_ONCE)
            x, y, z = (p[part, None] - g for p, g in zip(at, goal, strict=True))
            d2 = x * x + y * y + z * z
            best[part] = d2.argmin(axis=1)
            least[part] = d2.min(axis=1)
        return here.append_column("node_ord", there.column("node_ord").take(pa.array(best))).append_column("distance", pa.array(np.sqrt(least)))

    return p.groupBy("case_id", "batch").cogroup(g.groupBy("case_id", "batch")).applyInArrow(meet, schema)


def near_many(places: DataFrame, goals: DataFrame, key: list[str]) -> DataFrame:
    """nearest() by two octrees; goals are distinct places."""
    asked = stored(places.select("case_id", "x", "y", "z").distinct(), "places")
    q_boxes, q_at = tree(asked, "point-tree")
    n_boxes, n_at = tree(goals, "node-tree")
    q_next, n_next = side(q_boxes, "q"), side(n_boxes, "n")
    cell = lambda s: [f"{s}level", *(f"{s}c{a}" for a in "xyz")]
    root = F.lit(0)
    pairs = q_boxes.where("level = 0").select("case_id", *(root.alias(c) for c in cell("q"))).join(n_boxes.where("level = 0").select("case_id", *(root.alias(c) for c in cell("n"))), "case_id")
    pairs = stored(pairs.withColumn("most", F.lit(float("inf"))), "pairs")
    for _ in range(DEPTH + 1):
        met = pairs.join(q_next, ["case_id", *cell("q")]).join(n_next, ["case_id", *cell("n")])
        least, most = gaps(sides("q"), sides("n"))
        met = met.select("case_id", "qnext", "nnext", (F.col("qleaf") & F.col("nleaf")).alias("done"), least.alias("least"), most.alias("most"), F.col("most").alias("above")).where(F.col("least") <= F.col("above") * MARGIN)
        met = met.withColumn("bound", F.min("most").over(Window.partitionBy("case_id", "qnext"))).where(F.col("least") <= F.col("bound") * MARGIN)
        of = lambda s: [F.col(f"{s}next.{c}").alias(s + c) for c in CELL]
        pairs = stored(met.select("case_id", *of("q"), *of("n"), "done", F.col("bound").alias("most")), "pairs")
        if pairs.where("not done").isEmpty():
            break
    leaf = n_boxes.where("leaf").select("case_id", *(F.col(c).alias("n" + c) for c in (*CELL, *SIDES)))
    own = pairs.join(q_at.select("case_id", "x", "y", "z", *(F.col(c).alias("q" + c) for c in CELL)), ["case_id", *cell("q")]).join(leaf, ["case_id", *cell("n")])
    least, most = gaps({a: (F.col(a), F.col(a)) for a in "xyz"}, sides("n"))
    own = own.select("case_id", "x", "y", "z", *cell("n"), least.alias("least"), most.alias("most"))
    own = own.withColumn("bound", F.min("most").over(Window.partitionBy("case_id", "x", "y", "z"))).where(F.col("least") <= F.col("bound") * MARGIN)
    there = n_at.select("case_id", *(F.col(c).alias("n" + c) for c in CELL), *(F.col(a).alias(f"g{a}") for a in "xyz"), "node_ord")
    d2 = add([(F.col(a) - F.col(f"g{a}")) ** 2 for a in "xyz"])
    hit = own.join(there, ["case_id", *cell("n")]).groupBy("case_id", "x", "y", "z").agg(F.min(F.struct(d2.alias("d2"), "node_ord")).alias("m"))
    return places.join(hit, ["case_id", "x", "y", "z"]).select("case_id", *key, "x", "y", "z", F.col("m.node_ord").alias("node_ord"), F.sqrt("m.d2").alias("distance"))
