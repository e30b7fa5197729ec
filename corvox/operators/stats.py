"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvox.operators.ranks import percentiles

SPREAD = {"median": 0.5, "p05": 0.05, "p95": 0.95}


def spread(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Median, 5 % and 95 % point of each metric over its finite values (linear interpolation, by distributed ranks); NaN without any."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("c")).select("c.*").where(~F.isnan("x") & (F.abs("x") != float("inf")))
    known = percentiles(long, "x", SPREAD, ("metric",))
    names = rows.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return names.join(known, "metric", "left").select("metric", *(F.coalesce(k, F.lit(float("nan"))).alias(k) for k in SPREAD))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """Counts in min(32, max(6, n div 3)) equal bins from minimum to maximum, the last one closed; empty bins are absent."""
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()  # one row
    if not n:
        return rows.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    bins = min(32, max(6, n // 3))
    at = F.least(F.lit(bins), F.floor((F.col(value) - low) / F.lit(high - low if high > low else 1.0) * bins) + 1)
    return rows.where(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def totals(episodes: DataFrame, fps: float) -> DataFrame:
    """episodes(frames, passed): counts, hours, durations in seconds, failures and pass rate."""
    one = episodes.agg(F.count("*").alias("episodes"), F.sum("frames").alias("frames"), (F.sum("frames") / fps / 3600).alias("hours"), F.count_if(~F.col("passed")).alias("failures"), F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("pass_rate"))
    durations = percentiles(episodes.select((F.col("frames") / fps).alias("d")), "d", {f"duration_{k}": q for k, q in SPREAD.items()})
    both = one.join(durations, F.lit(True))  # two tables of one row
    return both.select("episodes", "frames", "hours", *(f"duration_{k}" for k in SPREAD), "failures", "pass_rate")


def environments(*lists: DataFrame) -> DataFrame:
    """Every combination of short lists of options, with a stable id."""
    grid = lists[0]
    for x in lists[1:]:
        grid = grid.crossJoin(F.broadcast(x))  # option lists, a few rows each
    return grid.withColumn("environment_id", F.sha2(F.to_json(F.struct(*sorted(grid.columns))), 256))
