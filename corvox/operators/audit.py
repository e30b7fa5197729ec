"""Dataset audits, group splits, replicas and file verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvox.functions.columns import category_index, folded, patient_video, suffix
from corvox.operators.ranks import ranked


def fractions_ok(train: Column, validation: Column, test: Column, salt: Column) -> Column:
    """Whether split fractions are positive and add up to 1, and the salt is not blank."""
    return F.coalesce((F.least(train, validation, test) > 0) & (F.abs(train + validation + test - 1) <= 1e-6) & (F.length(F.trim(salt)) > 0), F.lit(False))


def check_fractions(train: float, validation: float, test: float, salt: str) -> None:
    if min(train, validation, test) <= 0 or abs(train + validation + test - 1) > 1e-6:
        raise ValueError("fractions must be positive and add up to 1")
    if not salt.strip():
        raise ValueError("salt must not be blank")


def group_split(records: DataFrame, train: float, validation: float, test: float, salt: str) -> DataFrame:
    """records(category, patient, image_count) with a split each, whole patients, by salted hash order within a category."""
    check_fractions(train, validation, test, salt)
    key = F.sha2(F.concat_ws("|", F.lit(salt), "category", F.col("patient").cast("string")), 256)
    n = records.groupBy(F.col("category").alias("c")).agg(F.count("*").alias("n"))
    r = ranked(records.withColumn("key", key), "key", "patient", by=("category",)).withColumn("rank", F.col("place") + 1)
    r = r.join(n, F.col("category").eqNullSafe(F.col("c")))
    v, s = (F.greatest(F.lit(1), F.bround(F.col("n") * f, 0).cast("int")) for f in (validation, test))
    r = r.withColumns({"v": v, "s": s}).withColumn("over", F.greatest(F.lit(0), 1 - (F.col("n") - F.col("v") - F.col("s"))))
    from_test = (F.col("s") >= F.col("v")) & (F.col("s") > 1)
    r = r.withColumns({"s": F.when(from_test, F.col("s") - F.col("over")).otherwise(F.col("s")), "v": F.when(~from_test & (F.col("v") > 1), F.col("v") - F.col("over")).otherwise(F.col("v"))})
    r = r.withColumn("k", F.greatest(F.lit(1), F.col("n") - F.col("v") - F.col("s")))
    split = F.when((F.col("n") < 3) | (F.col("rank") <= F.col("k")), "train").when(F.col("rank") <= F.col("k") + F.col("v"), "validation").otherwise("test")
    return r.select("category", "patient", "image_count", split.alias("split"))


def split_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split", "category").agg(F.count_distinct("patient").alias("patients"), F.sum("image_count").alias("images"))


def split_totals(assigned: DataFrame) -> DataFrame:
    """One row a split: records, images, and both by category in order of name."""
    each = assigned.groupBy("split", "category").agg(F.count("*").alias("patients"), F.coalesce(F.sum("image_count"), F.lit(0)).alias("images"))
    listed = F.sort_array(F.collect_list(F.struct("category", "patients", "images")))  # a row a category
    return each.groupBy("split").agg(F.sum("patients").alias("patients"), F.sum("images").alias("images"), listed.alias("categories"))


def split_patients(assigned: DataFrame) -> DataFrame:
    """The records of each split with their place by patient: the report's list as rows, since a split may hold most of a table."""
    return ranked(assigned.select("split", "patient", "category", "image_count"), "patient", "category", by=("split",))


def leaks(assigned: DataFrame) -> DataFrame:
    """Patients in more than one split."""
    return assigned.groupBy("category", "patient").agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def leak_report(assigned: DataFrame) -> DataFrame:
    """One row: whether a patient is in more than one split, how many are, and the patients and images that are assigned."""
    each = assigned.groupBy("category", "patient").agg(F.count_distinct("split").alias("splits"), F.sum("image_count").alias("images"))
    return each.agg(F.coalesce(F.bool_or(F.col("splits") > 1), F.lit(False)).alias("patient_overlap"), F.count_if(F.col("splits") > 1).alias("overlaps"), F.count("*").alias("assigned_patients"), F.coalesce(F.sum("images"), F.lit(0)).alias("assigned_images"))


#: Names of the known categories, of images and of metadata documents: fixed values.
CATEGORIES, UNKNOWN = ["lung_cancer", "non_lung_cancer"], "uncategorized"
IMAGES = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff"]
METADATA = ["annotation.json", "labels.json", "objects.json"]


def dataset_audit(files: DataFrame, sizes: Callable[[DataFrame], DataFrame], sample: int, categories: list[str] | None = None) -> DataFrame:
    """files(path) to a row per category: images, patients, videos, its metadata files, and the first `sample` images by path with their sizes.

    Known categories always have a row, the rest only where it has something. `sizes` maps
    paths to (path, width, height) and only gets the sampled ones.
    """
    if sample < 0:
        raise ValueError("sample must not be negative")
    known = categories or CATEGORIES
    f = files.select("path", F.split("path", "/").alias("parts")).withColumn("at", category_index(F.col("parts"), known))
    f = f.withColumn("category", F.when(F.col("at") > 0, folded(F.try_element_at("parts", F.greatest("at", F.lit(1))))).otherwise(UNKNOWN))
    patient, video = patient_video(F.col("parts"), F.col("at"))
    images = f.where(suffix(F.col("path")).isin(IMAGES)).select("category", "path", patient.alias("patient"), video.alias("video"))
    count = images.groupBy("category").agg(F.count("*").alias("images"), F.count_distinct("patient").alias("patients"), F.count_distinct("patient", "video").alias("videos"))
    meta = f.where(F.element_at("parts", -1).isin(METADATA)).groupBy("category").agg(F.sort_array(F.collect_list("path")).alias("metadata_files"))
    first = images.select("category", "path", F.split("path", "/").alias("order"), F.pmod(F.xxhash64("path"), F.lit(64)).alias("deal"))
    for keys in (("category", "deal"), ("category",)):  # the first of 64 deals, then of these
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("order"))).where(F.col("n") <= sample)
    shown = first.join(sizes(first.select("path")), "path", "left").groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "path", "width", "height"))), lambda x: F.struct(x["path"].alias("path"), x["width"].alias("width"), x["height"].alias("height"))).alias("samples"))
    names = files.sparkSession.createDataFrame([(k,) for k in [*known, UNKNOWN]], "category string")
    out = names.join(count, "category", "left").join(meta, "category", "left").join(shown, "category", "left")
    out = out.where(F.col("category").isin(known) | F.col("images").isNotNull() | F.col("metadata_files").isNotNull())
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("images", "patients", "videos")}
    return out.withColumns(zero | {c: F.coalesce(c, F.array().cast(dict(out.dtypes)[c])) for c in ("metadata_files", "samples")})


def replicas(cases: DataFrame, *fingerprint: str | Column) -> DataFrame:
    """Unique worlds, duplicates and the largest multiplicity of equal fingerprints."""
    m = cases.groupBy(*fingerprint).agg(F.count("*").alias("m"))
    return m.agg(F.count("*").alias("unique_worlds"), F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("duplicates"), F.max("m").alias("max_multiplicity"))


def distinct_first(cases: DataFrame, index: str, n: int, *fingerprint: str | Column) -> DataFrame:
    """Of the cases with index < n, the first with each fingerprint."""
    few = cases.where(F.col(index) < n)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*fingerprint).orderBy(index))).where("place = 1").drop("place")


def verified(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """expected(path, bytes, sha) against observed: present, size and hash as they should be."""
    o = observed.select("path", F.col("bytes").alias("bytes_seen"), F.col("sha").alias("sha_seen"))
    j = expected.join(o, "path", "left")
    size, sha = F.col("bytes").eqNullSafe(F.col("bytes_seen")), F.col("sha").eqNullSafe(F.col("sha_seen"))
    flags = F.array_compact(F.array(F.when(F.col("bytes_seen").isNull(), "missing"), F.when(F.col("bytes_seen").isNotNull() & ~size, "size_changed"), F.when(F.col("sha_seen").isNotNull() & ~sha, "sha_changed"), F.when(F.startswith("path", F.lit("/")), "absolute_path")))
    return j.select("path", F.col("bytes_seen").isNotNull().alias("present"), (size & sha).alias("verified"), flags.alias("flags"))


def first_n(rows: DataFrame, by: str, n: int, *order: str | Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash; all rows of a table of n or fewer."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def rank_picks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """First, middle and last by value (null as 0), then their neighbours; a row picked twice keeps its first place."""
    r = ranked(rows.select(key, F.coalesce(value, F.lit(0.0)).alias("value")), "value", key)
    n = rows.agg(F.count("*").alias("n"))
    base = F.array(F.lit(0), F.expr("n div 2"), F.col("n") - 1)
    shifted = lambda o: F.transform(base, lambda b: F.greatest(F.lit(0), F.least(F.col("n") - 1, b + o)))
    steps = [shifted(o) for o in (0, 1, -1, 2, -2)]
    picks = n.where("n > 0").select(F.posexplode(F.flatten(F.array(*steps))).alias("pick", "place")).groupBy("place").agg(F.min("pick").alias("pick"))
    return r.join(picks, "place").select(key, "value", "pick")
