"""Ranks without bringing all rows, or all rows of a group, to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvox.sources.scratch import stored


def ranked(rows: DataFrame, *order: str, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """rows with `place`, their 0-based rank in the given order (make it total: ties could fall apart), in each group of `by`.

    Rows are range-partitioned by group and order and written, so that every later read sees
    the same partitions; ranks within a partition are shifted by the group's counts in those
    before, of which there are at most one per partition and group.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(by)
    p = stored(rows.repartitionByRange(n, *keys, *order).withColumn("part_", F.spark_partition_id()), "ranks")
    sizes = p.groupBy(*keys, "part_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*(F.col(k).alias(k + "_") for k in keys), F.col("part_").alias("p_"), F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("before_"))
    same = F.col("part_") == F.col("p_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(k + "_"))
    own = F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(*order)) - 1
    return p.withColumn("own_", own).join(before, same).withColumn("place", F.col("own_") + F.col("before_")).drop("part_", "own_", "before_", "p_", *(k + "_" for k in keys))


#: Rows of a group that one task sorts; larger groups are ranked by range partitions.
SORTED = 1 << 16


def numbered(rows: DataFrame, order: str, by: str) -> DataFrame:
    """rows with `place`, the 0-based rank of each in its group: by a window while every group is small, else as ranked()."""
    longest = rows.groupBy(by).agg(F.count("*").alias("n_")).agg(F.max("n_")).first()[0] or 0
    if longest > SORTED:
        return ranked(rows, order, by=(by,)).withColumn("place", F.col("place").cast("long"))
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("long"))


#: Values of a group up to which Spark's own exact percentile keeps them in a task.
SMALL = 1 << 18
#: Steps of the sketch that brackets a rank.
STEPS = 1000


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = (), small: int | None = None) -> DataFrame:
    """percentiles_of() for one value."""
    return percentiles_of(rows, {value: shares}, by, small)


def percentiles_of(rows: DataFrame, values: dict[str, dict[str, float]], by: tuple[str, ...] = (), small: int | None = None) -> DataFrame:
    """For each value, columns named as in its shares: exact percentiles of its non-null values in each group by linear interpolation; a group without any value has no row.

    The values are written once, as what they come from may be dear. Groups that fit a task take
    one aggregate for all of them.
    """
    small = SMALL if small is None else small
    own = {v: f"v{i}_" for i, v in enumerate(values)}
    any_ = F.coalesce(*(F.col(c) for c in own.values())).isNotNull()
    kept = stored(rows.select(*by, *(F.col(v).cast("double").alias(c) for v, c in own.items())).where(any_), "values")
    if (kept.groupBy(*by).agg(F.count("*").alias("n_")).agg(F.max("n_")).first()[0] or 0) <= small:
        all_ = kept.groupBy(*by).agg(*(F.percentile(own[v], F.array(*(F.lit(float(q)) for q in shares.values()))).alias(own[v]) for v, shares in values.items()))
        return all_.select(*by, *(F.element_at(own[v], i + 1).alias(k) for v, shares in values.items() for i, k in enumerate(shares)))
    out = None
    for v, shares in values.items():
        one = bracketed(kept.select(*by, F.col(own[v]).alias("v_")).where("v_ is not null"), shares, by, small)
        if len(values) > 1:
            out = matched(kept.select(*by).distinct() if out is None else out, one, list(by), "left") if by else one if out is None else out.join(one, F.lit(True))
    return one if out is None else out


def counted_percentiles(rows: DataFrame, value: str, count: str, shares: dict[str, float], by: tuple[str, ...] = (), small: int | None = None) -> DataFrame:
    """percentiles() of values that each stand for `count` equal ones. Groups with few different values take one aggregate, else range partitions are summed up."""
    small = SMALL if small is None else small
    kept = rows.select(*by, F.col(value).cast("double").alias("v_"), F.col(count).alias("c_")).where("v_ is not null")
    kept = stored(kept.groupBy(*by, "v_").agg(F.sum("c_").alias("c_")), "values")
    if (kept.groupBy(*by).agg(F.count("*").alias("n_")).agg(F.max("n_")).first()[0] or 0) <= small:
        all_ = kept.groupBy(*by).agg(F.percentile("v_", F.array(*(F.lit(float(q)) for q in shares.values())), F.col("c_")).alias("p_"))
        return all_.select(*by, *(F.element_at("p_", i + 1).alias(k) for i, k in enumerate(shares)))
    n, keys = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), list(by)
    p = stored(kept.repartitionByRange(n, *keys, "v_").withColumn("part_", F.spark_partition_id()), "ranks")
    sizes = p.groupBy(*keys, "part_").agg(F.sum("c_").alias("n_"))
    w = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "part_", F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("before_"))
    run = F.sum("c_").over(Window.partitionBy(*keys, "part_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0))
    upto = matched(p.withColumn("own_", run), before, [*keys, "part_"]).select(*keys, "v_", "c_", (F.col("own_") + F.col("before_")).alias("upto_"))
    whole = sizes.groupBy(*keys).agg(F.sum("n_").alias("all_"))
    upto = matched(upto, whole, keys) if keys else upto.join(whole, F.lit(True))
    rank = {k: float(q) * (F.col("all_") - 1) for k, q in shares.items()}
    has = lambda r: (F.col("upto_") > r) & (F.col("upto_") - F.col("c_") <= r)
    pick = lambda r: F.max(F.when(has(r), F.col("v_")))
    ends = upto.groupBy(*keys, "all_").agg(*(pick(way(r)).alias(k + end) for k, r in rank.items() for end, way in (("_a", F.floor), ("_b", F.ceil))))
    return ends.select(*keys, *((F.col(k + "_a") + (F.col(k + "_b") - F.col(k + "_a")) * (r - F.floor(r))).alias(k) for k, r in rank.items()))


def bracketed(v: DataFrame, shares: dict[str, float], by: tuple[str, ...], small: int) -> DataFrame:
    """percentiles_of() for v(*by, v_) with groups of any size.

    A sketch of the group brackets each rank between two of its values, whose own ranks are known
    to a tenth of a step, with a step to spare; the values outside are only counted. That is done
    again with what lies inside, a few hundredths of it each time, until a task can hold the
    different values that are left.
    """
    keys = [*by, "name_"]
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("name_"), F.lit(float(q)).alias("q_")) for k, q in shares.items())))
    whole = v.groupBy(*by).agg(F.count("*").alias("n_")).select(*by, "n_", names.alias("s_"))
    # rank_: 0-based place of the wanted value, a fraction, within what is left
    want = stored(whole.select(*by, "s_.name_", (F.col("s_.q_") * (F.col("n_") - 1)).alias("rank_"), "n_"), "ranks")
    left = v.select(*by, F.explode(F.array(*(F.lit(k) for k in shares))).alias("name_"), "v_")
    before = None
    while True:
        points = F.percentile_approx("v_", F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1))), 10 * STEPS)
        sketch = left.groupBy(*keys).agg(points.alias("points_"))
        low = F.floor(F.floor("rank_") / F.col("n_") * STEPS).cast("int") - 1
        high = F.ceil((F.ceil("rank_") + 1) / F.col("n_") * STEPS).cast("int") + 1
        ends = matched(want, sketch, keys).select(*keys, "rank_", F.element_at("points_", F.greatest(low, F.lit(0)) + 1).alias("low_"), F.element_at("points_", F.least(high, F.lit(STEPS)) + 1).alias("high_"))
        ends = stored(ends, "ends")
        met = matched(left, ends, keys)
        counts = met.groupBy(*keys, "rank_").agg(F.count_if(F.expr("v_ < low_")).alias("under_"), F.count_if(F.expr("v_ between low_ and high_")).alias("n_"))
        want = stored(counts.select(*keys, (F.col("rank_") - F.col("under_")).alias("rank_"), "n_"), "ranks")
        inside = stored(met.where("v_ between low_ and high_").groupBy(*keys, "v_").agg(F.count("*").alias("c_")), "inside")
        most = inside.groupBy(*keys).agg(F.count("*").alias("d_")).agg(F.max("d_")).first()[0] or 0
        if most <= small or most == before:
            break
        before = most
        left = stored(met.where("v_ between low_ and high_").select(*keys, "v_"), "left")
    w = Window.partitionBy(*keys).orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    run = matched(inside, want, keys).withColumn("upto_", F.sum("c_").over(w))
    has = lambda r: (F.col("upto_") > r) & (F.col("upto_") - F.col("c_") <= r)
    pick = run.groupBy(*keys, "rank_").agg(F.max(F.when(has(F.floor("rank_")), F.col("v_"))).alias("a_"), F.max(F.when(has(F.ceil("rank_")), F.col("v_"))).alias("b_"))
    pick = pick.withColumn("x_", F.col("a_") + (F.col("b_") - F.col("a_")) * (F.col("rank_") - F.floor("rank_")))
    return pick.groupBy(*by).agg(*(F.max(F.when(F.col("name_") == k, F.col("x_"))).alias(k) for k in shares))


def matched(rows: DataFrame, more: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of `more` for the same keys, null keys too; columns of both come from `more`'s side only where rows lack them."""
    own = [c for c in more.columns if c not in keys and c not in rows.columns]
    other = more.select(*(F.col(k).alias(k + "other_") for k in keys), *own)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(k + "other_"))
    return rows.join(other, same, how).drop(*(k + "other_" for k in keys))
