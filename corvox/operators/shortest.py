"""Shortest-path trees over graphs of any size and shape, cycles and long chains included.

links(case_id, a, b, length) name each link once or both ways; nodes are whole numbers. A graph
is first contracted: nodes with two neighbours form chains, which pointer jumping turns into
one link each, and ends with one neighbour are cut off; both leave rows that say from which
nodes, and how far, the removed ones are reached. What stays is relaxed block by block: a task
brings a bounded block of nodes to rest at once, and only improvements that cross to another
block lead to a further round. So rounds count crossings of blocks, not steps, and no chain
adds to them. Then the removed nodes get their distances in reverse order, and every node the
parent that attains its distance, the earliest settled of equals.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvox.operators.loops import climbed
from corvox.operators.ranks import ranked
from corvox.sources.scratch import observed, stored

#: Nodes of a block by default; distances that differ by less than CLOSE are equal.
BLOCK, CLOSE = 4096, 1e-6
#: After all chains are taken once, contraction goes on while a round takes off at least one in SHARE of the nodes.
SHARE = 8
NODE = ["case_id", "node"]
LINK, KNOWN, NEW = 0, 1, 2


def numbered(node: Column) -> Column:
    """The default block of a node: BLOCK consecutive numbers."""
    return F.floor(node / BLOCK)


def both(links: DataFrame) -> DataFrame:
    """The shortest of the links between two nodes, both ways; loops left out."""
    turned = links.select("case_id", F.col("b").alias("a"), F.col("a").alias("b"), "length")
    return links.select("case_id", "a", "b", "length").unionByName(turned).where("a <> b").groupBy("case_id", "a", "b").agg(F.min("length").alias("length"))


def contracted(links: DataFrame, roots: DataFrame, rounds: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """links (both ways) without chains and ends, and for each step the rows (case_id, node, via, length) by which the nodes taken off are reached."""
    steps, e = [], links
    root = roots.select("case_id", F.col("node").alias("a"), F.lit(True).alias("root"))
    for _ in range(rounds):
        degree = e.groupBy("case_id", "a").agg(F.count("*").alias("n")).join(root, ["case_id", "a"], "left")
        degree, size, inner, ends = observed(degree, "degrees", size=F.count("*"), inner=F.expr("count_if(n = 2 and root is null)"), ends=F.expr("count_if(n = 1 and root is null)"))
        first = not steps and inner > 0  # chains always go once, whatever their share
        if not first and max(inner, ends) * SHARE < max(size, 1):
            return e, steps
        if first or inner * SHARE >= size:
            e, taken = unchained(e, degree)
        else:
            out = stored(e.join(degree.where("n = 1 and root is null").select("case_id", "a"), ["case_id", "a"]), "ends")
            gone = out.select("case_id", "a")
            e = stored(e.join(gone, ["case_id", "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), ["case_id", "b"], "left_anti").select("case_id", "a", "b", "length"), "links")
            taken = out.select("case_id", F.col("a").alias("node"), F.col("b").alias("via"), "length")
        steps.append(taken)
    return e, steps


def unchained(e: DataFrame, degree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with each chain of nodes of two neighbours as one, and both ways out of every node of a chain. Rings without another node are left out: nothing reaches them."""
    inner = degree.where("n = 2 and root is null").select("case_id", "a")
    into = e.join(inner.withColumnRenamed("a", "b"), ["case_id", "b"])
    on = into.alias("i").join(e.alias("o"), (F.col("i.case_id") == F.col("o.case_id")) & (F.col("i.b") == F.col("o.a")) & (F.col("i.a") != F.col("o.b")))
    on = on.select("i.case_id", F.struct("i.a", "i.b").alias("node"), F.struct(F.col("o.a"), F.col("o.b")).alias("up"), "i.length")
    last = e.join(inner.withColumnRenamed("a", "b"), ["case_id", "b"], "left_anti").select("case_id", F.struct("a", "b").alias("node"), F.lit(None).cast(on.schema["up"].dataType).alias("up"), "length")
    whole = climbed(on.unionByName(last), "chains", {"length": lambda x, y: x + y}).select("case_id", F.col("node.a").alias("a"), F.col("top.b").alias("b"), "length")
    whole = stored(whole.join(inner.withColumn("inner", F.lit(True)), ["case_id", "a"], "left"), "chains")
    kept = whole.where("inner is null and a <> b").groupBy("case_id", "a", "b").agg(F.min("length").alias("length"))
    return stored(kept, "links"), whole.where("inner").select("case_id", F.col("a").alias("node"), F.col("b").alias("via"), "length")


def settle(rows: pd.DataFrame) -> pd.DataFrame:
    """One block's links, known distances and new ones: the nodes that new distances improve."""
    out, best, queue = defaultdict(list), {}, []
    for kind, a, b, w in zip(*(rows[c].tolist() for c in ("kind", "a", "b", "length")), strict=True):
        if kind == LINK:
            out[a].append((b, w))
            continue
        best[a] = min(w, best.get(a, w))
        if kind == NEW:
            heappush(queue, (w, a))
    done = {}
    while queue:
        d, a = heappop(queue)
        if a in done or d > best[a]:
            continue
        done[a] = d
        for b, w in out[a]:
            if d + w < best.get(b, float("inf")):
                best[b] = d + w
                heappush(queue, (d + w, b))
    return pd.DataFrame({"case_id": [rows["case_id"].iloc[0]] * len(done), "node": list(done), "dist": list(done.values())})


def relaxed(links: DataFrame, roots: DataFrame, block, rounds: int = 10_000) -> DataFrame:
    """(case_id, node, dist) of what links (both ways) reach from the roots; `block` maps a node column to its block's, which bounds what a task takes."""
    e = stored(links.withColumns({"at": block(F.col("a")), "to": block(F.col("b"))}), "links")
    inside, across = e.where("at = to").select("case_id", "at", "a", "b", "length"), e.where("at <> to").select("case_id", F.col("a").alias("node"), "b", "length")
    schema = f"case_id {dict(roots.dtypes)['case_id']}, node {dict(roots.dtypes)['node']}, dist double"
    best = roots.select(*NODE, F.lit(0.0).alias("dist")).limit(0)
    front = stored(roots.select(*NODE, F.lit(0.0).alias("dist")), "front")
    for _ in range(rounds):
        here = front.withColumn("at", block(F.col("node")))
        open_ = here.select("case_id", "at").distinct()
        known = best.withColumn("at", block(F.col("node"))).join(open_, ["case_id", "at"], "left_semi")
        rows = inside.join(open_, ["case_id", "at"], "left_semi").select(F.lit(LINK).alias("kind"), "case_id", "at", "a", "b", "length")
        for kind, part in ((NEW, here), (KNOWN, known)):
            rows = rows.union(part.select(F.lit(kind), "case_id", "at", "node", "node", "dist"))
        better = stored(rows.groupBy("case_id", "at").applyInPandas(settle, schema), "better")
        best = stored(best.join(better.select(*NODE), NODE, "left_anti").unionByName(better), "dist")
        new = better.join(across, NODE).groupBy("case_id", F.col("b").alias("node")).agg(F.min(F.col("dist") + F.col("length")).alias("dist"))
        front, n = observed(new.join(best.select(*NODE, F.col("dist").alias("old")), NODE, "left").where("old is null or dist < old - 1e-9").drop("old"), "front", n=F.count("*"))
        if not n:
            return best
    raise RuntimeError("distances did not settle")


def distances(links: DataFrame, roots: DataFrame, block=numbered) -> DataFrame:
    """(case_id, node, dist) of the nodes that links (both ways) reach from roots(case_id, node)."""
    alone = links.where(block(F.col("a")) != block(F.col("b"))).isEmpty()
    core, steps = (links, []) if alone else contracted(links, roots)
    best = relaxed(core, roots, block)
    for taken in reversed(steps):
        near = taken.join(best.withColumnRenamed("node", "via"), ["case_id", "via"])
        best = stored(best.unionByName(near.groupBy(*NODE).agg(F.min(F.col("dist") + F.col("length")).alias("dist"))), "dist")
    return best


def parents(links: DataFrame, best: DataFrame) -> DataFrame:
    """distances() with each node's parent: of those that attain its distance the nearest, then the lowest."""
    up = best.select("case_id", F.col("node").alias("a"), F.col("dist").alias("above"))
    way = best.join(links.withColumnRenamed("b", "node"), NODE).join(up, ["case_id", "a"]).where(f"abs(above + length - dist) <= {CLOSE} and above < dist")
    parent = way.groupBy(*NODE).agg(F.min_by("a", F.struct(F.round("above", 6), "a")).alias("parent"))
    return best.join(parent, NODE, "left")


def shortest_tree(nodes: DataFrame, links: DataFrame, block=numbered) -> DataFrame:
    """nodes(case_id, node, radius), links(case_id, a, b, length): distance and parent from each case's widest node (the lowest of equals); what it doesn't reach is left out."""
    roots = stored(nodes.groupBy("case_id").agg(F.max_by("node", F.struct("radius", -F.col("node"))).alias("node")), "roots")
    e = stored(both(links), "links")
    return parents(e, distances(e, roots, block))


def branch_labels(tree: DataFrame) -> DataFrame:
    """tree(case_id, node, parent, dist) with `generation` and `branch`: each child of a branching node other than the root starts a branch one generation on; branches are numbered as their parents settle, then by node. Pointer jumping adds up the starts above each node."""
    kids = tree.where("parent is not null").groupBy("case_id", F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    split = tree.join(kids.where("kids >= 2"), NODE).where("parent is not null").select("case_id", F.col("node").alias("parent"), F.lit(1).alias("generation"), F.col("dist").alias("turn"))
    t = stored(tree.join(split, ["case_id", "parent"], "left").withColumn("generation", F.coalesce("generation", F.lit(0))), "tree")
    starts = t.where("generation = 1 or parent is null")
    order = ranked(starts.select("case_id", F.coalesce(F.round("turn", 6), F.lit(-1.0)).alias("turn"), F.coalesce("parent", "node").alias("from"), "node"), "turn", "from", "node", by=("case_id",))
    head = F.when((F.col("generation") == 1) | F.col("parent").isNull(), F.col("node"))
    rows = climbed(t.select(*NODE, F.col("parent").alias("up"), "generation", head.alias("head")), "branches", {"generation": lambda a, b: a + F.coalesce(b, F.lit(0)), "head": lambda a, b: F.coalesce(a, b)})
    out = rows.join(order.select("case_id", F.col("node").alias("head"), F.col("place").alias("branch")), ["case_id", "head"])
    return tree.select(*NODE, "parent", "dist").join(out.select(*NODE, "generation", "branch"), NODE)
