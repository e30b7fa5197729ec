"""Inputs derived from the given tables, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATHS = "(select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages)"


def paths(t) -> DataFrame:
    return t("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


#: Nodes of a tree, and orders of a mask: the number of cases grows with the tables.
NODES, ORDERS = 500, 4096
TREE = f"""(select case_id, n, 'n' || n as id, case when n > 0 then 'n' || ((n - 1) // 2) end as parent, generation, radius, (n % 7) + price / 1000 as x, (n % 11) - 5.0::double as y, size * 0.1::double - generation * 10.0::double as z, generation * 10.0::double as dist
 from (select *, cast(length(bin(n + 1)) - 1 as bigint) as generation from (select p_partkey // {NODES} as case_id, p_partkey % {NODES} as n, 1 + p_size / 10 as radius, p_size as size, p_retailprice as price from part)))"""


def tree(t) -> DataFrame:
    """The parts as heap-shaped trees of NODES nodes."""
    p = t("part").selectExpr(f"p_partkey div {NODES} as case_id", f"p_partkey % {NODES} as n", "1 + p_size / 10 as radius", "p_size as size", "p_retailprice as price")
    p = p.withColumn("generation", (F.length(F.bin(F.col("n") + 1)) - 1).cast("long"))
    return p.select(
        "case_id", "n", F.concat(F.lit("n"), "n").alias("id"), F.when(F.col("n") > 0, F.concat(F.lit("n"), F.expr("(n - 1) div 2"))).alias("parent"), "generation", "radius",
        (F.col("n") % 7 + F.col("price") / 1000).alias("x"), (F.col("n") % 11 - 5.0).alias("y"), (F.col("size") * 0.1 - F.col("generation") * 10.0).alias("z"), (F.col("generation") * 10.0).alias("dist"),
    )


EDGES = f"(select case_id, parent as src, id as dst, n as edge_ord, generation from {TREE} where parent is not null)"


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is not null").select("case_id", F.col("parent").alias("src"), F.col("id").alias("dst"), F.col("n").alias("edge_ord"), "generation")


def mask_sql(side: int, shift: int = 0) -> str:
    return f"(select distinct l_orderkey // {ORDERS} as case_id, (l_orderkey + {shift} * l_linenumber) % {side} as i, l_partkey % {side} as j, l_suppkey % {side} as k from lineitem)"


def mask(t, side: int, shift: int = 0) -> DataFrame:
    """Every line's voxel in a cube of its orders' case."""
    return t("lineitem").selectExpr(f"l_orderkey div {ORDERS} as case_id", f"(l_orderkey + {shift} * l_linenumber) % {side} as i", f"l_partkey % {side} as j", f"l_suppkey % {side} as k").distinct()


#: Two masks that overlap in part, and one of a few percent of its cube's voxels.
REFERENCE, CANDIDATE, SIDE = mask_sql(24), mask_sql(24, 1), 86
SPARSE = mask_sql(SIDE)


def sparse(t) -> DataFrame:
    return mask(t, SIDE)


FRAMES = "(select label as video_id, row_number() over (partition by label order by vec_id) - 1 as frame_index, embedding as gray from embeddings)"


def frames(t) -> DataFrame:
    """Vectors as 8 x 8 grey frames of a video per label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return t("embeddings").select(F.col("label").alias("video_id"), (F.row_number().over(w) - 1).alias("frame_index"), F.col("embedding").alias("gray"))


PIXELS = f"(select video_id, frame_index, cast((p - 1) // 8 as bigint) as row, cast((p - 1) % 8 as bigint) as col, cast(gray[p] as double) as v from (select *, unnest(range(1, 65)) as p from {FRAMES}))"


def pixels(t) -> DataFrame:
    return frames(t).select("video_id", "frame_index", F.posexplode("gray")).select("video_id", "frame_index", F.expr("cast(pos div 8 as long)").alias("row"), F.expr("cast(pos % 8 as long)").alias("col"), F.col("col").cast("double").alias("v"))


CHAINS = "(select user_id as case_id, row_number() over (partition by user_id order by ts, event_id) - 1 as ord, event_type, value as x, value * value / 100 as y, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as double) as z from events)"


def chains(t) -> DataFrame:
    """Events of a user as a chain of points in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rank = F.row_number().over(w) - 1
    return t("events").select(F.col("user_id").alias("case_id"), rank.alias("ord"), "event_type", F.col("value").alias("x"), (F.col("value") * F.col("value") / 100).alias("y"), rank.cast("double").alias("z"))


RECORDS = "(select c_mktsegment as category, c_custkey as patient, (select count(*) from orders where o_custkey = c_custkey) as image_count from customer)"


def records(t) -> DataFrame:
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("image_count"))
    return t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("patient"), F.coalesce("image_count", F.lit(0).cast("long")).alias("image_count"))
