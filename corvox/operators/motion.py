"""Trajectories: steps, arc length, smoothing, resampling and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvox.functions.columns import quaternion_angle
from corvox.operators.ranks import matched, percentiles_of
from corvox.operators.scans import Blocks
from corvox.sources.scratch import stored


def kinematics(episodes: DataFrame, fps: float) -> DataFrame:
    """episodes(episode, frame, action of 8 numbers): speed in mm/s, angular rate in deg/s and depth change of each step."""
    blocks = Blocks(episodes.select("episode", "frame", "action"), "episode", "frame", back=1)
    s = blocks.own(blocks.rows.withColumn("b", F.lag("action").over(blocks.window))).where("b is not null")
    at = lambda c, i: F.element_at(c, i).cast("double")
    step = F.sqrt(sum(((at("action", i) - at("b", i)) ** 2 for i in (2, 3)), (at("action", 1) - at("b", 1)) ** 2))
    angle = quaternion_angle(F.slice("action", 4, 4), F.slice("b", 4, 4))
    return s.select("episode", "frame", step.alias("step"), (step * fps * 1000).alias("speed"), (angle * fps).alias("angular"), at("action", 8).alias("depth"), (at("action", 8) - at("b", 8)).alias("d_depth"))


def episode_summary(steps: DataFrame) -> DataFrame:
    steps = stored(steps, "steps")
    g = steps.groupBy("episode").agg(F.sum("step").alias("path"), F.max("depth").alias("max_insertion"), F.avg(F.when(F.col("d_depth") < -1e-6, 1.0).otherwise(0.0)).alias("retraction"))
    g = matched(g, percentiles_of(steps, {v: {f"{v}_median": 0.5, f"{v}_p95": 0.95} for v in ("speed", "angular")}, ("episode",)), ["episode"], "left")
    return g.select("episode", "path", "speed_median", "speed_p95", "angular_median", "angular_p95", "max_insertion", "retraction")


def arc_length(points: DataFrame, by: str, order: str) -> DataFrame:
    """points(x, y, z) with `step` from the point before and the running length `s`."""
    blocks = Blocks(points, by, order, back=1)
    w = blocks.window
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    return blocks.own(blocks.running(blocks.rows.withColumn("step", F.coalesce(step, F.lit(0.0))), "s", F.col("step")))


def smoothed(points: DataFrame, by: str, order: str, columns: list[str], half: int = 3, passes: int = 2) -> DataFrame:
    """Centred moving averages, summed from the first neighbour to the last; end points stay, groups of fewer than 2 * half + 1 points too."""
    blocks = Blocks(points, by, order, back=half * passes, ahead=half * passes)
    w = blocks.window
    p = blocks.of_all(blocks.rows.withColumn("k_", blocks.place()), {"n_": F.count("*")})
    inner = (F.col("n_") >= 2 * half + 1) & (F.col("k_") > 0) & (F.col("k_") < F.col("n_") - 1)

    def mean(c: str) -> Column:
        total = F.coalesce(F.lag(c, half).over(w), F.lit(0.0))
        for d in range(1 - half, half + 1):
            total = total + F.coalesce(F.lead(c, d).over(w) if d > 0 else F.lag(c, -d).over(w), F.lit(0.0))
        return total / F.count(c).over(w.rowsBetween(-half, half))

    for _ in range(passes):
        p = p.withColumns({c: F.when(inner, mean(c)).otherwise(F.col(c)) for c in columns})
    return blocks.own(p).drop("n_", "k_")


def resampled(points: DataFrame, by: str, order: str, distance: str, columns: list[str], every: float) -> DataFrame:
    """Samples each `every` along the distance, and the end, by linear interpolation in their segment."""
    blocks = Blocks(points, by, order, ahead=1)
    w = blocks.window
    seg = blocks.rows.withColumns({"d0": F.col(distance), "d1": F.lead(distance).over(w), **{f"{c}_1": F.lead(c).over(w) for c in columns}})
    seg = blocks.own(blocks.of_all(seg, {"end": F.max(distance)})).where("d1 > d0")
    last = F.col("d1") == F.col("end")
    first = F.ceil(F.col("d0") / every)
    upto = F.ceil(F.col("d1") / every) - 1
    inside = F.when(upto >= first, F.transform(F.sequence(first, F.greatest(first, upto)), lambda i: i * every)).otherwise(F.array().cast("array<double>"))
    at = F.explode(F.when(last, F.concat(inside, F.array(F.col("end")))).otherwise(inside))
    s = seg.select(by, "d0", "d1", *columns, *(f"{c}_1" for c in columns), at.alias("s"))
    u = (F.col("s") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    return s.select(by, "s", *((F.col(c) + (F.col(f"{c}_1") - F.col(c)) * u).alias(c) for c in columns))


def phases(steps: DataFrame, by: str, order: str, phase: str, step: str) -> DataFrame:
    """Runs of equal phases with their frames and distance."""
    blocks = Blocks(steps, by, order, back=1)
    new = F.when(F.lag(F.lit(1)).over(blocks.window).isNull() | ~F.col(phase).eqNullSafe(F.lag(phase).over(blocks.window)), 1).otherwise(0)
    r = blocks.own(blocks.running(blocks.rows.withColumn("new_", new), "run", F.col("new_"))).drop("new_")
    return r.groupBy(by, "run", phase).agg(F.count("*").alias("frames"), F.sum(step).alias("distance"))


def path_summary(points: DataFrame, by: str, time: Column, diameter: float) -> DataFrame:
    """points(step, radius of the route's node): length, duration, frames, mean speed, least lumen diameter and what it leaves beside a scope of the given outer diameter."""
    g = points.groupBy(by).agg(F.sum("step").alias("length"), (F.max(time) - F.min(time)).alias("duration"), F.count("*").alias("frames"), (2 * F.min("radius")).alias("min_lumen"))
    return g.withColumns({"mean_speed": F.col("length") / F.greatest("duration", F.lit(1e-6)), "clearance": F.col("min_lumen") - diameter})
