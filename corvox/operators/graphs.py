"""Branch graphs: nodes(case_id, id, node_ord, x, y, z, radius, generation, dist, ...) and edges(case_id, src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvox.operators import shortest
from corvox.operators.loops import climbed, components, forest, reached
from corvox.operators.ranks import percentiles
from corvox.sources.scratch import observed, stored


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("case_id", "src", "dst").union(edges.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the number of distinct edge ends at each."""
    d = both_ways(edges).groupBy("case_id", F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.join(d, ["case_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def accessible(nodes: DataFrame, edges: DataFrame, roots: DataFrame, minimum: float, depth: float | None = None) -> DataFrame:
    """nodes with `accessible`: wide enough (2r >= minimum), within depth, and reached from the root through such nodes."""
    local = 2 * F.col("radius") >= minimum
    if depth is not None:
        local = local & (F.col("dist") <= depth)
    ok = stored(nodes.where(local).select("case_id", "id"), "passing")
    to = edges.join(ok.withColumnRenamed("id", "dst"), ["case_id", "dst"], "left_semi")
    seen = reached(roots.join(ok, ["case_id", "id"], "left_semi"), to).select("case_id", "id", F.lit(True).alias("accessible"))
    return nodes.drop("accessible").join(seen, ["case_id", "id"], "left").withColumn("accessible", F.coalesce("accessible", F.lit(False)))


def accessible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ok = nodes.where("accessible").select("case_id", "id")
    mark = edges.join(ok.withColumnRenamed("id", "src"), ["case_id", "src"], "left_semi").join(ok.withColumnRenamed("id", "dst"), ["case_id", "dst"], "left_semi").select("case_id", "src", "dst", F.lit(True).alias("accessible"))
    return edges.drop("accessible").join(mark, ["case_id", "src", "dst"], "left").withColumn("accessible", F.coalesce("accessible", F.lit(False)))


def radius_jumps(nodes: DataFrame, edges: DataFrame, ratio: float = 2.5) -> DataFrame:
    """Edges of each case whose larger radius is more than `ratio` times the smaller."""
    r = lambda c, n: nodes.select("case_id", F.col("id").alias(c), F.col("radius").alias(n))
    j = edges.join(r("src", "r1"), ["case_id", "src"]).join(r("dst", "r2"), ["case_id", "dst"])
    jump = F.greatest("r1", "r2") / F.greatest(F.least("r1", "r2"), F.lit(1e-6)) > ratio
    return j.groupBy("case_id").agg(F.count_if(jump).alias("jumps"), F.count("*").alias("edges"))


def branches(nodes: DataFrame, edges: DataFrame, main: str | None = None) -> DataFrame:
    """nodes(branch_id, node_ord) and edges(branch_id, length, edge_ord): one row per branch."""
    n = nodes.groupBy("case_id", "branch_id").agg(F.avg("radius").alias("radius_mean"), F.min("radius").alias("radius_min"), F.max("radius").alias("radius_max"), F.min("generation").alias("generation"), F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "id"))), lambda x: x["id"]).alias("node_ids"), F.bool_and("accessible").alias("accessible"))
    e = edges.groupBy("case_id", "branch_id").agg(F.sum("length").alias("length"))
    of = lambda c, b: nodes.select("case_id", F.col("id").alias(c), F.col("branch_id").alias(b))
    turn = edges.drop("branch_id").join(of("src", "from_branch"), ["case_id", "src"]).join(of("dst", "branch_id"), ["case_id", "dst"]).where("from_branch <> branch_id")
    parent = turn.groupBy("case_id", "branch_id").agg(F.min_by("from_branch", "edge_ord").alias("parent"))
    label = F.when(F.col("branch_id") == main, "trachea") if main is not None else F.lit(None).cast("string")
    return n.join(e, ["case_id", "branch_id"], "left").join(parent, ["case_id", "branch_id"], "left").withColumns({"length": F.coalesce("length", F.lit(0.0)), "label": label})


def centreline_quality(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Counts, lengths and radii of each case's graph: nodes(branch_id, accessible, generation, dist, radius), edges(length)."""
    of = components(edges.select("case_id", F.col("src").alias("a"), F.col("dst").alias("b")), "reachable")
    own = roots.select("case_id", "id").join(of.withColumnRenamed("node", "id"), ["case_id", "id"], "left")
    alone = own.where("component is null").select("case_id", F.col("id").alias("node"))
    seen = of.join(own.select("case_id", "component").distinct(), ["case_id", "component"], "left_semi").select("case_id", "node").union(alone).groupBy("case_id").agg(F.count_distinct("node").alias("reachable"))
    root = roots.join(nodes.select("case_id", "id", "accessible"), ["case_id", "id"]).groupBy("case_id").agg(F.bool_and("accessible").alias("open_root"))
    end = F.col("degree") <= 1
    n = degrees(nodes, edges).groupBy("case_id").agg(F.count("*").alias("nodes"), F.count_if(end).alias("terminals"), F.count_if(end & F.col("accessible")).alias("accessible_terminals"), F.avg(F.when(F.col("accessible"), 1.0).otherwise(0.0)).alias("accessible_fraction"), F.count_distinct("branch_id").alias("branches"), F.max("generation").alias("max_generation"), F.max("dist").alias("max_distance"))
    length = edges.groupBy("case_id").agg(F.sum("length").alias("total_length"))
    radii = percentiles(nodes, "radius", {"radius_p05": 0.05, "radius_p50": 0.5, "radius_p95": 0.95}, ("case_id",))
    out = n.join(length, "case_id", "left").join(radii, "case_id", "left").join(seen, "case_id", "left").join(root, "case_id", "left")
    return out.withColumns({"total_length": F.coalesce("total_length", F.lit(0.0)), "reaches_all": F.col("reachable") == F.col("nodes"), "route_non_empty": F.coalesce("open_root", F.lit(False))}).drop("open_root")


def entry_node(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The highest, then widest node of degree <= 1 that is accessible; else any accessible one; else any."""
    d = degrees(nodes, edges)
    tier = F.when(F.col("accessible") & (F.col("degree") <= 1), 2).when(F.col("accessible"), 1).otherwise(0)
    return d.groupBy("case_id").agg(F.max_by("id", F.struct(tier.alias("t"), "z", "radius", -F.col("node_ord"))).alias("id"))


def nearest_passable(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(case_id, id): each entry, or the passable node that breadth-first steps from it meet first (the lowest node_ord of equals); an error for a case without any.

    nodes(case_id, id, node_ord, passable). The distance of every node from the entry is that
    of the tree of all nodes, so a chain to the first passable one costs no rounds of its own.
    """
    direct = stored(entries.join(nodes.where("passable"), ["case_id", "id"]).select("case_id", "id"), "entries")
    rest, n = observed(entries.join(direct.select("case_id"), "case_id", "left_anti").select("case_id", "id"), "entries", n=F.count("*"))
    if not n:
        return direct
    far = rerooted(edges.join(rest.select("case_id"), "case_id", "left_semi"), rest)
    steps = walked(far, rest, {}) if far is not None else reached(rest, both_ways(edges)).select("case_id", F.col("id").alias("node"), "depth")
    near = steps.withColumnRenamed("node", "id").join(nodes.where("passable"), ["case_id", "id"]).groupBy("case_id").agg(F.min_by("id", F.struct("depth", "node_ord")).alias("found"))
    none = F.raise_error(F.concat(F.lit("no node is wide enough in case "), F.col("case_id").cast("string")))
    moved = rest.join(near, "case_id", "left").select("case_id", F.coalesce("found", none.cast(dict(entries.dtypes)["id"])).alias("id"))
    return direct.union(moved)


def rerooted(edges: DataFrame, entries: DataFrame) -> DataFrame | None:
    """edges(case_id, src, dst) turned so that they lead away from entries(case_id, id), as (case_id, node, up); None where they are not a forest.

    Only the edges between an entry and its old root turn. The entry's ancestors are found by
    doubling: a round marks what lies 2^k steps above what is marked.
    """
    into = stored(edges.select("case_id", F.col("dst").alias("node"), F.col("src").alias("up")).distinct(), "into")
    if not forest(into.select("case_id", F.col("up").alias("src"), F.col("node").alias("dst"))):
        return None
    jump, n = into, F.count("*")
    above, size = observed(entries.select("case_id", F.col("id").alias("node")).distinct(), "above", n=n)
    for _ in range(64):
        more = above.join(jump.hint("merge"), ["case_id", "node"]).select("case_id", F.col("up").alias("node")).join(above, ["case_id", "node"], "left_anti").distinct()
        above, grown = observed(above.union(more), "above", n=n)
        if grown == size:
            break
        size = grown
        jump = stored(jump.join(jump.select("case_id", F.col("node").alias("up"), F.col("up").alias("far")).hint("merge"), ["case_id", "up"]).select("case_id", "node", F.col("far").alias("up")), "jump")
    else:
        return None
    turned = into.join(above, ["case_id", "node"], "left_semi").select("case_id", F.col("up").alias("node"), F.col("node").alias("up"))
    return stored(into.join(above, ["case_id", "node"], "left_anti").union(turned), "rerooted")


def walked(parents: DataFrame, entries: DataFrame, values: dict) -> DataFrame:
    """(case_id, node, depth, *values) of the nodes below entries in parents(case_id, node, up, *values), and of the entries."""
    start = entries.select("case_id", F.col("id").alias("node"), F.lit(None).cast(dict(parents.dtypes)["up"]).alias("up"), F.lit(0).alias("depth"), *(e.alias(v) for v, (_, e) in values.items()))
    all_ = parents.select("case_id", "node", "up", F.lit(1).alias("depth"), *values).join(entries.select("case_id", F.col("id").alias("node")), ["case_id", "node"], "left_anti").unionByName(start)
    tree = climbed(all_, "walk", {"depth": lambda a, b: a + b} | {v: f for v, (f, _) in values.items()})
    return tree.join(entries.select("case_id", F.col("id").alias("top")), ["case_id", "top"], "left_semi").drop("top")


def routes(nodes: DataFrame, edges: DataFrame, entries: DataFrame, minimum: float, working_length: float) -> DataFrame:
    """Routes from the entry, or the passable node nearest to it, to the leaves of the breadth-first tree through passable nodes (accessible, 2r > minimum), no longer than the working length; a route has two nodes at least.

    A forest is turned to lead away from the entry; where passable nodes form cycles, the tree
    comes from shortest.distances in steps, with the parent that comes first in node_ord.
    Lengths and radii add up by pointer jumping; only leaves are written out as routes.
    """
    passable = F.col("accessible") & (2 * F.col("radius") > minimum)
    known = stored(nodes.select("case_id", "id", F.col("node_ord").cast("long").alias("node"), "x", "y", "z", "radius", passable.alias("passable")), "nodes")
    entry = stored(nearest_passable(known.select("case_id", "id", F.col("node").alias("node_ord"), "passable"), edges, entries), "entry")
    ok = known.where("passable").drop("passable")
    of = lambda c, n: ok.select("case_id", F.col("id").alias(c), F.col("node").alias(n))
    inside = stored(edges.select("case_id", "src", "dst").distinct().join(of("src", "a").hint("merge"), ["case_id", "src"]).join(of("dst", "b").hint("merge"), ["case_id", "dst"]).select("case_id", "a", "b"), "inside")
    start = stored(entry.join(ok, ["case_id", "id"]).select("case_id", "node", "radius"), "start")
    away = rerooted(inside.select("case_id", F.col("a").alias("src"), F.col("b").alias("dst")), start.select("case_id", F.col("node").alias("id")))
    if away is None:
        links = stored(shortest.both(inside.withColumn("length", F.lit(1.0))), "links")
        best = shortest.distances(links, start.select("case_id", "node"))
        before = best.select("case_id", F.col("node").alias("a"), (F.col("dist") + 1).alias("dist"))
        away = stored(best.join(links.withColumnRenamed("b", "node"), ["case_id", "node"]).join(before, ["case_id", "a", "dist"]).groupBy("case_id", "node").agg(F.min("a").alias("up")), "away")
    at = lambda c, n: ok.select("case_id", F.col("node").alias(c), *(F.col(v).alias(n + v) for v in ("x", "y", "z", "radius")))
    gap = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2)
    hop = away.join(at("node", "a").hint("merge"), ["case_id", "node"]).join(at("up", "b").hint("merge"), ["case_id", "up"])
    hop = stored(hop.select("case_id", "node", "up", gap.alias("length"), F.col("aradius").alias("least_radius")), "hops")
    values = {"length": (lambda a, b: a + b, F.lit(0.0)), "least_radius": (F.least, F.col("radius"))}
    tree = walked(hop, start.withColumnRenamed("node", "id"), values)
    inner = hop.select("case_id", F.col("up").alias("node")).distinct()
    ends, deepest = observed(tree.where((F.col("depth") > 0) & (F.col("length") <= working_length)).join(inner, ["case_id", "node"], "left_anti"), "ends", deepest=F.max("depth"))
    name = ok.select("case_id", "node", "id")
    route = written(hop, ends, deepest or 0).join(name.hint("merge"), ["case_id", "node"]).groupBy("case_id", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("route"))
    return ends.join(name.hint("merge"), ["case_id", "node"]).join(route.withColumnRenamed("leaf", "node").hint("merge"), ["case_id", "node"]).select("case_id", "id", "route", "length", "least_radius")


#: Joins that follow each other without a written table between them.
STRIDE = 6


def written(parents: DataFrame, leaves: DataFrame, deepest: int) -> DataFrame:
    """(case_id, leaf, node, place) of the nodes on the ways from the entry (place 0) to leaves(case_id, node, depth), none below `deepest`, in parents(case_id, node, up).

    A table of ancestors by powers of two takes log2 of the depth rounds, and as many joins,
    from the farthest ancestors to the nearest, write a way out: each doubles its nodes.
    """
    jumps = [parents.select("case_id", "node", "up")]
    while 2 << len(jumps) - 1 <= deepest:
        last = jumps[-1]
        jumps.append(stored(last.join(last.select("case_id", F.col("node").alias("up"), F.col("up").alias("far")).hint("merge"), ["case_id", "up"]).select("case_id", "node", F.col("far").alias("up")), "jump"))
    way = leaves.select("case_id", F.col("node").alias("leaf"), "node", F.col("depth").cast("long").alias("place"))
    for k in range(len(jumps) - 1, -1, -1):
        far = F.when((F.col("place") >= 1 << k) & F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place")))
        both = F.explode(F.array_compact(F.array(F.struct("node", "place"), far)))
        way = way.join(jumps[k].hint("merge"), ["case_id", "node"], "left").select("case_id", "leaf", both.alias("at")).select("case_id", "leaf", "at.node", "at.place")
        if k % STRIDE == 0:
            way = stored(way, "way")
    return way


def common_prefix(first: Column, second: Column) -> Column:
    """Leading equal nodes of two routes, at least 1."""
    same = F.zip_with(first, second, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, False)
    return F.greatest(F.lit(1), F.when(at > 0, at - 1).otherwise(F.least(F.size(first), F.size(second))).cast("int"))


def between(first: Column, second: Column) -> tuple[Column, Column]:
    """Nodes of the way back from the first route's end to the common part, and on to the second's end."""
    n = common_prefix(first, second)
    return F.reverse(F.slice(first, n, F.size(first))), F.slice(second, n, F.size(second))


def deepest_route(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The route to the farthest leaf of the accessible nodes of each case, and its least radius."""
    r = routes(nodes, edges, roots, 0.0, float("inf"))
    far = r.join(nodes.select("case_id", "id", "dist", "node_ord").hint("merge"), ["case_id", "id"])
    return far.groupBy("case_id").agg(F.max_by(F.struct("id", "route", "least_radius", "dist"), F.struct("dist", -F.col("node_ord"))).alias("m")).select("case_id", "m.*")


def targets(routes_: DataFrame, minimum: float) -> DataFrame:
    """Least lumen diameter and clearance of each route."""
    return routes_.select("case_id", "id", (2 * F.col("least_radius")).alias("min_lumen"), (2 * F.col("least_radius") - minimum).alias("clearance"))


def diverse(points: DataFrame, k: int) -> DataFrame:
    """points(case_id, id, ord, x, y, z, length, sector): the longest, then k - 1 times the best of 1.7 * distance to the chosen + length / 4 + 80 for a new sector.

    A pick is one pass with map-side combined maxima for all cases together; only the picks,
    at most k of a case, go from pass to pass.
    """
    gap = lambda c: F.sqrt((F.col("x") - c["x"]) ** 2 + (F.col("y") - c["y"]) ** 2 + (F.col("z") - c["z"]) ** 2)
    fields, chosen = ("id", "x", "y", "z", "sector"), None
    for pick in range(k):
        if chosen is None:
            p, score = points, F.col("length")
        else:
            p = points.join(chosen.groupBy("case_id").agg(F.collect_list(F.struct(*fields)).alias("had")), "case_id").where(~F.array_contains(F.transform("had", lambda c: c["id"]), F.col("id")))
            score = 1.7 * F.array_min(F.transform("had", gap)) + 0.25 * F.col("length") + F.when(F.exists("had", lambda c: c["sector"] == F.col("sector")), 0.0).otherwise(80.0)
        best = p.groupBy("case_id").agg(F.max_by(F.struct(*fields), F.struct(score.alias("s"), "length", -F.col("ord"))).alias("b")).select("case_id", F.lit(pick).alias("pick"), "b.*")
        best = stored(best, "pick")
        chosen = best if chosen is None else chosen.union(best)
    return chosen.select("case_id", "id", "pick")
