"""Frame catalogues: sequences, neighbours, conditions, differences and picks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvox.operators.ranks import matched, numbered
from corvox.operators.scans import Blocks
from corvox.sources.scratch import stored

#: Suffixes in the order in which a fallback is taken.
SUFFIXES = [".exr", ".jpeg", ".jpg", ".npy", ".npz", ".png", ".tif", ".tiff"]


MOST_MODALITIES = 1000


def indexed(files: DataFrame, by: str, path: str) -> DataFrame:
    """0-based frame_index in each sequence, paths ordered by their parts."""
    rows = files.withColumn("parts_", F.split(path, "/"))
    return numbered(rows, "parts_", by=by).withColumnRenamed("place", "frame_index").drop("parts_")


def neighbours(frames: DataFrame, by: str, order: str, item: str, radius: int) -> DataFrame:
    """Items within radius places before and after, without the item itself."""
    if radius < 1:
        return frames.withColumn("neighbours", F.array().cast(f"array<{dict(frames.dtypes)[item]}>"))
    blocks = Blocks(frames, by, order, back=radius, ahead=radius)
    near = F.concat(F.collect_list(item).over(blocks.window.rowsBetween(-radius, -1)), F.collect_list(item).over(blocks.window.rowsBetween(1, radius)))
    return blocks.own(blocks.rows.withColumn("neighbours", near))


def stem(path: Column, twice: bool = False) -> Column:
    """Path without its suffix; twice: of what is left, the suffix goes too."""
    once = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return F.regexp_replace(once, r"(?<=[^/])\.[^./]+$", "") if twice else once


def conditions(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frames(path) x files(modality, file): for each frame and modality the file with the same path, else the first suffix of SUFFIXES on its stem."""
    rank = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.lower(F.regexp_extract("file", r"\.[^./]+$", 0)))
    known = files.withColumns({"stem": stem(F.col("file")), "rank": rank})
    exact = frames.join(known, F.col("path") == F.col("file")).select("path", "modality", "file", F.lit(0).cast("long").alias("rank"))
    other = frames.join(known.where("rank > 0"), stem(F.col("path"), True) == F.col("stem")).select("path", "modality", "file", "rank")
    best = exact.union(other).groupBy("path", "modality").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))
    return best


def missing(frames: DataFrame, modalities: DataFrame, matched: DataFrame) -> DataFrame:
    """(path, modality) without a file; modalities are a few names."""
    names = [r[0] for r in modalities.distinct().limit(MOST_MODALITIES + 1).collect()]
    if len(names) > MOST_MODALITIES:
        raise ValueError(f"more than {MOST_MODALITIES} modalities")
    pairs = frames.select("path", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("modality"))
    return pairs.join(matched, ["path", "modality"], "left_anti")


def sequences(frames: DataFrame, by: str, order: str, item: str) -> DataFrame:
    """Frames and their ordered items of each sequence."""
    return frames.groupBy(by).agg(F.count("*").alias("frame_count"), F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item]).alias("items"))


def change(gray: np.ndarray, before: np.ndarray) -> tuple[float, float, float]:
    """Mean absolute change, mean absolute flicker about the median change, mean change."""
    if gray.shape != before.shape:
        raise ValueError("frame size changes")
    return changes(gray[None], before[None])[0]


def changes(gray: np.ndarray, before: np.ndarray) -> list[tuple[float, float, float]]:
    """change() of every row of two matrices."""
    delta = gray.astype(np.float64) - before.astype(np.float64)
    return list(zip(np.abs(delta).mean(1).tolist(), np.abs(delta - np.median(delta, axis=1, keepdims=True)).mean(1).tolist(), delta.mean(1).tolist(), strict=True))


def differences(frames: DataFrame) -> DataFrame:
    """frames(video_id, frame_index, gray): mean absolute change to the frame before, mean absolute flicker about its median, mean change.

    Frames are range-partitioned by video and index and compared with the one before as they
    stream by; only the first and last frame of each partition are kept for a second step that
    compares across partitions. A video may span any number of partitions.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    ddl = f"video_id {kinds['video_id']}, frame_index {kinds['frame_index']}, abs_diff double, flicker double, luminance double, first boolean, last boolean, gray {kinds['gray']}"
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = frames.select("video_id", "frame_index", "gray").repartitionByRange(n, "video_id", "frame_index").sortWithinPartitions("video_id", "frame_index")

    def run(batches):
        kept = None  # the row before: video, index and frame; first and last rows carry their frames
        for b in batches:
            if not b.num_rows:
                continue
            videos, indexes, grays = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            size, out = pc.list_value_length(grays).to_numpy(zero_copy_only=False), []
            if kept is None:
                out.append((videos[0], indexes[0], None, None, None, True, False, grays[0].values.to_numpy(zero_copy_only=False)))
            before = [kept[0] if kept else None, *videos[:-1]]
            at = [i for i in range(b.num_rows) if (i or kept) and videos[i] == before[i]]
            if at and (size == size[0]).all() and (kept is None or len(kept[2]) == size[0]):
                now = grays.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size[0])
                got = changes(now[at], np.concatenate([(now[:1] if kept is None else kept[2][None]), now[:-1]])[at])
            else:
                frame = lambda i: kept[2] if i < 0 else grays[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                got = [change(frame(i), frame(i - 1)) for i in at]
            out += [(videos[i], indexes[i], *x, False, False, None) for i, x in zip(at, got, strict=True)]
            kept = videos[-1], indexes[-1], np.array(grays[b.num_rows - 1].values.to_numpy(zero_copy_only=False))
            yield table(out, b.schema)
        if kept is not None:
            yield table([(*kept[:2], None, None, None, False, True, kept[2])], b.schema)

    def table(rows, like):
        kinds = [like.field(0).type, like.field(1).type, *[pa.float64()] * 3, pa.bool_(), pa.bool_(), like.field(2).type]
        names = ["video_id", "frame_index", "abs_diff", "flicker", "luminance", "first", "last", "gray"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    each = stored(order.mapInArrow(run, ddl), "changes")
    edge = each.where("first or last")
    w = Window.partitionBy("video_id").orderBy("frame_index", F.col("last").cast("int"))
    across = edge.withColumns({"before": F.lag("gray").over(w), "was": F.lag("last").over(w)}).where("first and was").select("video_id", "frame_index", "gray", "before")

    def compare(batches):
        for b in batches:
            got = [change(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[i] for g in got], pa.float64()) for i in range(3))], names=["video_id", "frame_index", "abs_diff", "flicker", "luminance"])

    rest = across.mapInArrow(compare, ddl.split(", first")[0])
    return each.where("abs_diff is not null").select(*rest.columns).union(rest)


def consistency(frames: DataFrame) -> DataFrame:
    """Summary of differences() for each video; a video of fewer than two frames is an error."""
    p95 = lambda x: F.percentile(x, 0.95)
    summary = differences(frames).groupBy("video_id").agg(
        F.avg("abs_diff").alias("abs_diff_mean"), p95("abs_diff").alias("abs_diff_p95"), F.avg("flicker").alias("flicker_mean"), p95("flicker").alias("flicker_p95"),
        F.avg("luminance").alias("luminance_mean"), F.avg(F.abs("luminance")).alias("luminance_abs_mean"),
    )
    n = frames.groupBy("video_id").agg(F.count("*").alias("frames"))
    few = F.raise_error(F.concat(F.lit("fewer than two frames in video "), F.col("video_id").cast("string"))).cast("long")
    both = n.join(summary, "video_id", "left").withColumn("frames", F.when(F.col("frames") < 2, few).otherwise(F.col("frames")))
    return both.select("video_id", "frames", *summary.columns[1:])


def evenly_spaced(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Rows of each group at n evenly spaced places, rounded half to even; all of a group of n or fewer."""
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    at = matched(numbered(rows, order, by=by), total, [by])
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("total") - 1) / max(n - 1, 1), 0).cast("long"))
    return at.where((F.col("total") <= n) | F.array_contains(wanted, F.col("place"))).drop("total")


def strided(rows: DataFrame, by: str, order: str, stride: int, most: int | None = None) -> DataFrame:
    """Every stride-th row of a group, and of these the first `most`."""
    out = numbered(rows, order, by=by).where(F.pmod("place", F.lit(stride)) == 0)
    return out if most is None else out.where(F.col("place") < stride * most)


def capture_metrics(pixels: DataFrame) -> DataFrame:
    """pixels(video_id, frame_index, r, g, b in 0..255, alpha or null): mean, deviation and range of all channels, shares of pixels that are not black, near white, covered by alpha, and covered but dark, and the coverage with its source.

    Frames without alpha have null in the alpha shares and count what is not black as covered.
    """
    share = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    total = sum((F.col(c) for c in "gb"), F.col("r"))
    squares = sum((F.col(c) * F.col(c) for c in "gb"), F.col("r") * F.col("r"))
    g = pixels.groupBy("video_id", "frame_index").agg(
        (F.sum(total) / F.count("*") / 3).alias("mean"), (F.sum(squares) / F.count("*") / 3).alias("square"), F.min(low).alias("low"), F.max(high).alias("high"), share(high > 3).alias("non_black"), share(low > 250).alias("near_white"),
        F.count("alpha").alias("with_alpha"), share(F.col("alpha") > 0).alias("covered"), share((F.col("alpha") > 0) & (high <= 3)).alias("dark"),
    )
    has = F.col("with_alpha") > 0
    return g.select(
        "video_id", "frame_index", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("std"), "low", "high", "non_black", "near_white", F.when(has, F.col("covered")).alias("alpha_coverage"), F.when(has, F.col("dark")).alias("visible_dark"),
        F.when(has, F.greatest("non_black", "covered")).otherwise(F.col("non_black")).alias("coverage"), F.when(has, "alpha_or_rgb_nonblack").otherwise("rgb_nonblack").alias("coverage_source"),
    )


def exposure_gain(pixels: DataFrame, target: float = 118.0, share: float = 0.75, low: float = 0.4, high: float = 2.5) -> DataFrame:
    """Gain that brings a percentile of a frame's visible luminance to the target."""
    ref = F.percentile("v", share)
    return pixels.groupBy("video_id", "frame_index").agg(F.least(F.greatest(F.lit(target) / F.greatest(ref, F.lit(1e-3)), F.lit(low)), F.lit(high)).alias("gain"))
