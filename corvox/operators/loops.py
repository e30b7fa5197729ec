"""Fixed-point loops over tables. Each round is a written table; the driver sees only whether it changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvox.sources.scratch import observed, stored


def components(edges: DataFrame, tag: str, by: tuple[str, ...] = ("case_id",), rounds: int = 64) -> DataFrame:
    """edges(*by, a, b) to (*by, node, component): the smallest node that links reach.

    Each round hooks every node to its smallest neighbour, jumps once along these hooks and
    contracts the edges to what they hang on, so that at least half of the nodes go. Hot nodes
    only meet combined minima and one row per node.
    """
    key = list(by)
    at = lambda c: [*key, c]
    e, left = observed(edges.select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{tag}-edges", n=F.count("*"))
    labels = e.select(*key, F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    for turn in range(rounds):
        if not left:
            return labels
        hook = e.select(*key, F.col("b").alias("node"), F.col("a").alias("up")).union(e.select(*key, "a", "a")).groupBy(*at("node")).agg(F.min("up").alias("up"))
        hook = stored(hook, f"{tag}-hooks")
        above = hook.select(*key, F.col("node").alias("up"), F.col("up").alias("top"))
        hook = stored(hook.join(above, at("up")).select(*key, "node", "top"), f"{tag}-hooks")
        if turn == 0:
            labels = hook.withColumnRenamed("top", "component")
        else:
            labels = labels.join(hook.withColumnRenamed("node", "component"), at("component"), "left").select(*key, "node", F.coalesce("top", "component").alias("component"))
            labels = stored(labels, f"{tag}-labels")
        e = e.join(hook.withColumnRenamed("node", "a"), at("a")).select(*key, F.col("top").alias("p"), "b").join(hook.withColumnRenamed("node", "b"), at("b")).select(*key, F.least("p", "top").alias("a"), F.greatest("p", "top").alias("b"))
        e, left = observed(e.where("a <> b").distinct(), f"{tag}-edges", n=F.count("*"))
    raise RuntimeError("components did not settle")


def climbed(parents: DataFrame, tag: str, values: dict[str, Callable[[Column, Column], Column]], rounds: int = 64) -> DataFrame:
    """parents(case_id, node, up, *values): every node with its top, the last of its ancestors, and its values joined along the way there.

    Pointer jumping: each round joins a node twice with what hangs above it, which triples its
    reach, so a chain of n nodes takes log3 n rounds. `values` maps a column to the function of (the node's, the one above's);
    a top's own values take part. A node whose ancestors end at one that is not in the table has
    no top; nodes below a cycle are left out, which ends as soon as no others are open. The table
    of all nodes is merged, never sent through the driver, however small its compressed rows look.
    """
    open_ = F.col("up").isNotNull()
    j, open_rows = observed(parents.select("case_id", "node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("top"), *values), tag, n=F.count_if(open_))
    before = None
    for _ in range(rounds):
        if open_rows in (0, before):
            break
        before = open_rows
        above = j.select("case_id", F.col("node").alias("up"), F.col("up").alias("up_"), F.col("top").alias("top_"), *(F.col(v).alias(v + "_") for v in values))
        both = {v: F.when(open_, f(F.col(v), F.col(v + "_"))).otherwise(F.col(v)) for v, f in values.items()}
        for _ in range(2):
            j = j.join(above.hint("merge"), ["case_id", "up"], "left").select("case_id", "node", F.col("up_").alias("up"), F.when(open_, F.col("top_")).otherwise(F.col("top")).alias("top"), *(x.alias(v) for v, x in both.items()))
        j, open_rows = observed(j, tag, n=F.count_if(open_))
    return j.where("up is null").drop("up")


def forest(edges: DataFrame) -> bool:
    """Whether no node of edges(case_id, src, dst) has two edges that lead to it."""
    return edges.groupBy("case_id", "dst").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def reached(starts: DataFrame, edges: DataFrame, rounds: int = 100_000) -> DataFrame:
    """starts(case_id, id) and all that edges(case_id, src, dst) reach from them, with the number of steps.

    Where no two edges lead to one node, by pointer jumping in log3 of the depth rounds; else
    breadth first, a round a level.
    """
    seen = stored(starts.select("case_id", "id", F.lit(0).alias("depth")).distinct(), "seen")
    links = stored(edges.select("case_id", F.col("src").alias("id"), "dst").distinct(), "links")
    into = links.join(seen.select("case_id", F.col("id").alias("dst")), ["case_id", "dst"], "left_anti")
    if forest(into):
        up = into.select("case_id", F.col("dst").alias("node"), F.col("id").alias("up"), F.lit(1).alias("depth"))
        tops = into.select("case_id", F.col("id").alias("node")).distinct().join(into.select("case_id", F.col("dst").alias("node")), ["case_id", "node"], "left_anti")
        tree = climbed(up.union(tops.select("case_id", "node", F.lit(None).cast(dict(up.dtypes)["up"]), F.lit(0))), "climb", {"depth": lambda a, b: a + b})
        below = tree.join(seen.select("case_id", F.col("id").alias("top")), ["case_id", "top"], "left_semi").where("depth > 0").select("case_id", F.col("node").alias("id"), "depth")
        return seen.union(below)
    front = seen
    for depth in range(1, rounds):
        new = front.join(links, ["case_id", "id"]).select("case_id", F.col("dst").alias("id")).distinct().join(seen.select("case_id", "id"), ["case_id", "id"], "left_anti")
        front, n = observed(new.select("case_id", "id", F.lit(depth).alias("depth")), "front", n=F.count("*"))
        if not n:
            return seen
        seen = seen.union(front)
    raise RuntimeError("too many steps")
