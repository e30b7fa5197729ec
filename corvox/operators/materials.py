"""Material channels of surface points: region summaries, overlays and atlases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvox.functions.columns import region_weights, texture
from corvox.sources.scratch import stored


def region_summary(points: DataFrame, channels: list[str]) -> DataFrame:
    """Points, channel means and generation range of each region that has points."""
    return points.groupBy("case_id", "region").agg(F.count("*").alias("points"), *(F.avg(c).alias(c) for c in channels), F.min("generation").alias("generation_min"), F.max("generation").alias("generation_max"))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


#: Weights up to this don't count.
LEAST_WEIGHT = 1e-4
#: Other names of regions 0 to 3, fixed values of material maps.
REGIONS = {"tracheal": 0, "proximal": 0, "tracheal_or_proximal_airway": 0, "main": 1, "main_bronchus": 1, "lobar": 2, "segmental": 2, "lobar_or_segmental_bronchus": 2, "distal": 3, "distal_airway": 3}


def region_ids(entry: dict) -> list[int] | None:
    """The regions an entry names by number or name; None for all of them."""
    named = entry.get("regions")
    named = named if isinstance(named, (list, tuple)) or named is None else [named]
    if named is None or any(str(x).lower() == "all" for x in named):
        return None
    out = []
    for x in named:
        text = str(x).strip().lower().replace("-", "_").replace(" ", "_")
        number = REGIONS.get(text, int(text) if text.isdigit() else -1)
        if isinstance(x, bool) or not 0 <= number <= 3:
            raise ValueError(f"unknown region {x!r}")
        out.append(number)
    return out


def entry_weight(entry: dict) -> Column:
    """Weight in 0..1 of an entry at points(x, y, z, region, generation, distance, radius_norm), all but region normalised."""
    ids, soft = region_ids(entry), float(entry.get("edge_softness", 0.0))
    if ids is None:
        w = F.lit(1.0)
    elif soft <= 0:
        w = F.col("region").isin(ids).cast("double")
    else:
        raw = region_weights(F.col("generation"), F.col("distance"), F.col("radius_norm"), soft)
        w = unit(F.greatest(F.lit(0.0), *(raw[i] for i in ids)))
    if "center" in entry:
        reach = max(float(entry.get("radius", 0.2)), 1e-6) * max(float(entry.get("falloff", 1.0)), 1e-6)
        d2 = sum(((F.col(a) - float(c)) ** 2 for a, c in zip("yz", entry["center"][1:], strict=True)), (F.col("x") - float(entry["center"][0])) ** 2)
        w = w * F.exp(-d2 / reach**2)
    w = w * min(max(float(entry.get("opacity", 1.0)), 0.0), 1.0)
    noise = min(max(float(entry.get("noise_strength", 0.0)), 0.0), 1.0)
    if noise > 0:
        w = w * (1 - noise + noise * texture(F.lit(str(entry.get("name", "material-map-entry"))), F.col("x"), F.col("y"), F.col("z"), float(entry.get("noise_scale", 3.0))))
    return unit(w)


def in_order(regions: list[dict], spots: list[dict]) -> list[tuple[str, int, dict]]:
    if any("center" not in e for e in spots):
        raise ValueError("a spot needs a center")
    return [(kind, i, e if kind == "spot" else {k: v for k, v in e.items() if k != "center"}) for kind, group in (("region", regions), ("spot", spots)) for i, e in enumerate(group)]


def overlay_report(points: DataFrame, regions: list[dict], spots: list[dict]) -> DataFrame:
    """(case_id, kind, place, name, points, peak, mean) of the entries that weigh anything at a case's points: one pass over the points for all entries."""
    entries = in_order(regions, spots)
    if not entries:
        return points.select("case_id", F.lit("").alias("kind"), F.lit(0).alias("place"), F.lit("").alias("name"), F.lit(0).cast("long").alias("points"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("mean")).limit(0)
    w = points.select("case_id", *(entry_weight(e).alias(f"w{n}") for n, (_, _, e) in enumerate(entries)))
    g = w.groupBy("case_id").agg(*(f.alias(f"{k}{n}") for n in range(len(entries)) for k, f in (("n", F.count_if(F.col(f"w{n}") > LEAST_WEIGHT)), ("peak", F.max(f"w{n}")), ("mean", F.avg(f"w{n}")))))
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("place"), F.lit(str(e.get("name", f"{kind}_{i}"))).alias("name"), F.col(f"n{n}").alias("points"), F.col(f"peak{n}").alias("peak"), F.col(f"mean{n}").alias("mean")) for n, (kind, i, e) in enumerate(entries)]
    return g.select("case_id", F.explode(F.array(*rows)).alias("e")).select("case_id", "e.*").where("points > 0")


def overlaid(points: DataFrame, regions: list[dict], spots: list[dict]) -> DataFrame:
    """points after a material map's entries, regions and then spots, entry by entry: its offsets (`channels`), then its `multipliers`, then the next; channels end in 0..1, `albedo_delta_rgb` is added to albedo_r, albedo_g and albedo_b.

    An entry that weighs nothing at all points of a case is left out there; those that no case
    needs don't enter the expression. The report that says so has a row per case and entry.
    """
    entries = in_order(regions, spots)
    report = stored(overlay_report(points, regions, spots), "overlay")
    used = {(r["kind"], r["place"]) for r in report.select("kind", "place").distinct().collect()}  # at most one for each entry
    flags = report.groupBy(F.col("case_id").alias("case_")).agg(F.collect_set(F.concat("kind", "place")).alias("applied_"))
    out = points.join(flags, points["case_id"].eqNullSafe(flags["case_"]), "left")
    touched: dict[str, Column] = {}
    for n, (kind, i, e) in enumerate(x for x in entries if x[:2] in used):
        out = out.withColumn(f"weight{n}_", F.when(F.array_contains("applied_", f"{kind}{i}"), entry_weight(e)).otherwise(0.0))
        w = F.col(f"weight{n}_")
        now = lambda c: touched.get(c, F.col(c))
        for c, offset in e.get("channels", {}).items():
            touched[c] = now(c) + w * float(offset)
        for c, factor in e.get("multipliers", {}).items():
            touched[c] = now(c) * (1 + w * (float(factor) - 1))
        for c, delta in zip(("albedo_r", "albedo_g", "albedo_b"), e.get("albedo_delta_rgb", ()), strict=False):
            if delta:
                touched[c] = now(c) + w * float(delta)
    named = {c for _, _, e in entries for k in ("channels", "multipliers") for c in e.get(k, {})}
    final = {c: x if c.startswith("albedo_") else unit(x) for c, x in (touched | {c: F.col(c) for c in named - touched.keys()}).items()}
    return out.withColumns(final).select(*points.columns) if final else points


def atlas(points: DataFrame, value: str, size: int) -> DataFrame:
    """Weighted means of the texels of a size x size atlas: each point counts in the four texels around it."""
    px, py = (unit(F.col(c)) * (size - 1) for c in "uv")
    p = points.select("case_id", value, px.alias("px"), py.alias("py"))
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    part = [F.struct(F.least(F.floor("px") + dx, F.lit(size - 1)).cast("long").alias("tx"), F.least(F.floor("py") + dy, F.lit(size - 1)).cast("long").alias("ty"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w")) for dx in (0, 1) for dy in (0, 1)]
    return p.select("case_id", value, F.explode(F.array(*part)).alias("t")).groupBy("case_id", "t.tx", "t.ty").agg(F.sum("t.w").alias("weight"), (F.sum(F.col("t.w") * F.col(value)) / F.sum("t.w")).alias("value")).where("weight > 1e-9")
