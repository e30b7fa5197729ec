"""Image series: filters, picks, slice order, spacing and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(series: DataFrame, modality: str | None = "CT", body: str | None = None, body_keys: tuple[str, ...] = ("body_part",), **equal: str) -> DataFrame:
    """Series that pass the filters that are given, in order of patient, study and series."""
    s = series
    for column, value in equal.items():
        s = s.where(F.col(column) == value)
    if modality is not None:
        s = s.where(F.col("modality").isNull() | (F.col("modality") == modality))
    if body is not None:
        s = s.where(F.exists(F.array(*body_keys), lambda k: F.lower(k) == body.lower()))
    return s.orderBy(*(F.coalesce(c, F.lit("")) for c in ("patient_id", "study_uid", "series_uid")))


def picked(series: DataFrame, by: str, modality: str = "CT") -> DataFrame:
    """The first series of each group that has the modality or none."""
    ok = series.where(F.col("modality").isNull() | (F.col("modality") == modality))
    w = Window.partitionBy(by).orderBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("patient_id", "study_uid", "series_uid")))
    return ok.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def ordered(slices: DataFrame, projection: Column) -> DataFrame:
    """0-based ordinal in a series by projection, else instance number, else input order; path breaks ties."""
    key = F.coalesce(projection, F.col("instance").cast("double"), F.col("input_ord").cast("double"))
    return slices.withColumn("ordinal", F.row_number().over(Window.partitionBy("series").orderBy(key, "path")) - 1)


def spacing(slices: DataFrame, projection: str, thickness: str) -> DataFrame:
    """Median positive gap of consecutive projections, else the thickness, and which it was."""
    w = Window.partitionBy("series").orderBy(projection)
    gap = F.abs(F.col(projection) - F.lag(projection).over(w))
    g = slices.withColumn("gap", gap).groupBy("series").agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("median_gap"), F.max(thickness).alias("thickness"))
    return g.select("series", F.coalesce("median_gap", "thickness").alias("spacing"), F.when(F.col("median_gap").isNotNull(), "projection").when(F.col("thickness").isNotNull(), "thickness").otherwise("none").alias("derivation"))


def uneven(slices: DataFrame) -> DataFrame:
    """Series whose slices differ in pixel size."""
    return slices.groupBy("series").agg(F.count_distinct(F.struct("rows", "cols")).alias("sizes")).where("sizes > 1")


def provenance(slices: DataFrame) -> DataFrame:
    """Ordered slices of each series as one list."""
    return slices.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "sha", "instance"))).alias("slices"))
