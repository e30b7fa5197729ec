"""Rules over records and documents: one table of violations each, and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvox.functions.columns import valid_case_id

# Kinds, renderers and modalities that documents may name.
SOURCES = ["local_nifti", "local_dicom", "tcia", "maisi"]
VOLUMES = ["local_ct", "local_dicom", "maisi", "mask_conditioned_maisi"]
MASKS = ["maisi_label", "mask_conditioned_maisi", "monai_segmenter", "external_segmenter", "precomputed", "ct_threshold"]
RENDERERS = ["omniverse_rtx", "learnable_renderer", "software_preview"]
REQUIRED = ["rgb", "depth", "normal", "pps", "mask"]


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule whose condition holds; null does not count."""
    hits = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))
    return rows.select(key, F.explode(hits).alias("rule"))


def volume_manifest(rows: DataFrame, key: str) -> DataFrame:
    """rows(case_id, source_type, type, uri, path, input_path, version)."""
    kind, uri = F.coalesce("source_type", "type"), F.coalesce("uri", "path", "input_path")
    return violations(rows, key, {"case_id": ~valid_case_id(F.col("case_id")), "source_type": ~F.coalesce(kind.isin(SOURCES), F.lit(False)), "uri": blank(uri), "version": blank(F.coalesce("version", F.lit("1.0")))})


def case_recipe(rows: DataFrame, key: str) -> DataFrame:
    """rows(volume_kind, volume_path, volume_config, mask_kind, mask_path, mask_command, renderer, modalities); renderer and modalities have defaults."""
    kind, mask = F.col("volume_kind"), F.col("mask_kind")
    unknown = lambda c, known: ~F.coalesce(c.isin(known), F.lit(False))
    local = kind.isin("local_ct", "local_dicom")
    return violations(rows, key, {
        "volume_kind": unknown(kind, VOLUMES), "volume_path": (local & blank(F.col("volume_path"))) | (kind.isin(VOLUMES) & ~local & blank(F.col("volume_config"))),
        "mask_kind": unknown(mask, MASKS), "mask_path": mask.isin("precomputed", "mask_conditioned_maisi", "maisi_label") & blank(F.col("mask_path")), "mask_command": mask.isin("monai_segmenter", "external_segmenter") & blank(F.col("mask_command")),
        "modalities": F.size(missing_members(F.coalesce("modalities", F.array(*map(F.lit, REQUIRED))), REQUIRED)) > 0, "renderer": unknown(F.coalesce("renderer", F.lit(RENDERERS[0])), RENDERERS),
    })


def missing_members(given: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(given, F.array().cast("array<string>")))


def training_manifest(frames: DataFrame, known: list[str]) -> DataFrame:
    """frames(frame_id, modality, path, neighbours): all violations of a training manifest."""
    n = F.count("*").over(Window.partitionBy("frame_id"))
    rows = frames.withColumn("n_", n)
    return violations(rows, "frame_id", {"frame_id": blank(F.col("frame_id")), "duplicate": F.col("n_") > 1, "modality": ~F.coalesce(F.col("modality").isin(known), F.lit(False)), "path": blank(F.col("path")), "neighbours": F.col("neighbours").isNull()})


def graph(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(case_id, item, rule) of nodes(case_id, id, radius, generation, dist, x, y, z), edges(case_id, src, dst) and roots(case_id, id)."""
    finite = reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False)) for c in "xyz"])
    n = nodes.withColumn("n_", F.count("*").over(Window.partitionBy("case_id", "id")))
    of = lambda df, key, rules: violations(df.withColumn("k_", F.struct("case_id", F.col(key).alias("item"))), "k_", rules).select("k_.*", "rule")
    ids = nodes.select("case_id", F.col("id").alias("end")).distinct()
    ends = edges.select("case_id", F.concat_ws(">", "src", "dst").alias("item"), F.explode(F.array("src", "dst")).alias("end"))
    return (
        of(n, "id", {"id": blank(F.col("id")), "radius": ~(F.col("radius") > 0), "generation": F.col("generation") < 0, "distance": F.col("dist") < 0, "finite": ~finite, "duplicate": F.col("n_") > 1})
        .union(ends.join(ids, ["case_id", "end"], "left_anti").select("case_id", "item", F.lit("dangling")).distinct())
        .union(edges.where("src = dst").select("case_id", F.concat_ws(">", "src", "dst"), F.lit("loop")))
        .union(roots.join(ids.withColumnRenamed("end", "id"), ["case_id", "id"], "left_anti").select("case_id", "id", F.lit("root")))
    )


def case_gate(checks: Column) -> Column:
    """'pass' if there are checks and all hold."""
    v = F.map_values(checks)
    return F.when(F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)), "pass").otherwise("fail")


def corpus_gate(cases: DataFrame, minima: dict[str, float], flags: list[str]) -> DataFrame:
    """cases with `reasons` (metrics below their minimum or missing, flags not set) and `passed`."""
    low = [F.when(~F.coalesce(F.col(m) >= v, F.lit(False)), F.lit(f"{m}_below_{v:g}")) for m, v in minima.items()]
    off = [F.when(~F.coalesce(F.col(f), F.lit(False)), F.lit(f"{f}_missing")) for f in flags]
    return cases.withColumn("reasons", F.array_compact(F.array(*low, *off))).withColumn("passed", F.size("reasons") == 0)
