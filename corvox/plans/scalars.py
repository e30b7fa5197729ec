"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvox.functions import columns as c

from .inputs import PATHS, PIXELS, TREE, paths, pixels, tree
from .registry import query, r6

PARTS = "split(path, '/')"


@query(f"select page_id, case when len({PARTS}) > 1 then array_to_string(({PARTS})[1:least(2, len({PARTS}) - 1)], '/') else 'default' end as sequence_id, 'default' as flat from {PATHS}")
def p1_sequence_id(t):
    return paths(t).select("page_id", c.sequence_id(F.col("path"), 2).alias("sequence_id"), c.sequence_id(F.col("path"), 0).alias("flat"))


@query("select conv_id, turn, 'case-x_' || role || '_' || case when turn > 999999 then turn::varchar else lpad(turn::varchar, 6, '0') end as frame_id from conversations")
def p2_frame_id(t):
    return t("conversations").select("conv_id", "turn", c.frame_id(F.lit("--case x!"), F.col("role"), F.col("turn")).alias("frame_id"))


@query("select conv_id, turn, round(turn / 20.0, 6) as time_s, cast(null as double) as no_rate from conversations")
def p3_frame_time(t):
    return t("conversations").select("conv_id", "turn", r6(c.frame_time(F.col("turn"), 20.0)).alias("time_s"), c.frame_time(F.col("turn"), None).alias("no_rate"))


@query(f"select page_id, case when starts_with(path, ({PARTS})[1] || '/') then substr(path, length(({PARTS})[1]) + 2) else path end as inside, path as outside from {PATHS}")
def p4_relative_path(t):
    p = F.col("path")
    return paths(t).select("page_id", c.relative_path(p, F.split(p, "/")[0]).alias("inside"), c.relative_path(p, F.lit("/elsewhere")).alias("outside"))


LANGS = ["de", "en", "es", "fr"]
INDEX = f"coalesce(list_position(list_transform({PARTS}, lambda x: replace(lower(x), '-', '_') in ('de', 'en', 'es', 'fr')), true), 0)"


@query(f"select page_id, cast(i as int) as category_index, case when i > 0 then replace(lower(p[i]), '-', '_') end as category from (select page_id, {PARTS} as p, {INDEX} as i from {PATHS})")
def p5_category(t):
    parts = F.split("path", "/")
    return paths(t).withColumn("i", c.category_index(parts, LANGS)).select("page_id", F.col("i").alias("category_index"), F.when(F.col("i") > 0, c.folded(F.try_element_at(parts, F.greatest("i", F.lit(1))))).alias("category"))


@query(f"""with p as (select page_id, split(replace(path, '?', '/'), '/') as p from {PATHS}), i as (select *, coalesce(list_position(list_transform(p, lambda x: x in ('de', 'en', 'es', 'fr')), true), 0) as i from p),
a as (select page_id, case when i > 0 then p[i + 1:] end as a from i) select page_id, case when len(a) >= 2 then a[1] end as patient, case when len(a) >= 3 then a[2] when len(a) = 2 then '.' end as video from a""")
def p6_patient_video(t):
    parts = F.split(F.replace("path", F.lit("?"), F.lit("/")), "/")
    patient, video = c.patient_video(F.col("p"), F.col("i"))
    return paths(t).select("page_id", parts.alias("p")).withColumn("i", c.category_index(F.col("p"), LANGS)).select("page_id", patient.alias("patient"), video.alias("video"))


@query("select c_custkey, regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9_.\\-]*$') as valid, regexp_matches('#' || c_name, '^[A-Za-z0-9]') as marked, regexp_replace(regexp_replace('..' || c_name || ' x.nii', '[^A-Za-z0-9_.-]+', '-', 'g'), '^[.\\-_]+|[.\\-_]+$', '', 'g') as case_id from customer")
def p7_case_id(t):
    name = F.col("c_name")
    return t("customer").select("c_custkey", c.valid_case_id(name).alias("valid"), c.valid_case_id(F.concat(F.lit("#"), name)).alias("marked"), c.safe_name(F.concat(F.lit(".."), name, F.lit(" x.nii")), "case", ".-_").alias("case_id"))


@query("select c_custkey, 'sha256:' || sha256(c_name) as uid, cast(null as varchar) as blank from customer")
def p8_pseudonym(t):
    return t("customer").select("c_custkey", c.pseudonym(F.concat(F.lit(" \t"), "c_name", F.lit("\n "))).alias("uid"), c.pseudonym(F.lit(" \t ")).alias("blank"))


@query("select l_orderkey, l_linenumber, round(2.0::double * (l_orderkey % 40) + 0.5 * (l_partkey % 40) - 3, 6) as x, round(1.5::double * (l_partkey % 40) + 7, 6) as y, round(-3.0::double * (l_suppkey % 40) + 1, 6) as z, true as back from lineitem")
def p10_affine(t):
    m = [F.lit(float(v)) for v in (2, 0.5, 0, -3, 0, 1.5, 0, 7, 0, 0, -3, 1)]
    v = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey % 40 as i", "l_partkey % 40 as j", "l_suppkey % 40 as k")
    v = v.withColumns(dict(zip("xyz", c.affine(m, F.col("i"), F.col("j"), F.col("k")), strict=True)))
    back = c.affine(c.inverse_affine(m), F.col("x"), F.col("y"), F.col("z"))
    return v.select("l_orderkey", "l_linenumber", *(r6(x).alias(x) for x in "xyz"), ((F.abs(back[0] - F.col("i")) < 1e-9) & (F.abs(back[1] - F.col("j")) < 1e-9) & (F.abs(back[2] - F.col("k")) < 1e-9)).alias("back"))


Q = "list_transform(embedding[5:8], lambda x: x::double)"


@query(f"with q as (select vec_id, list_transform({Q}, lambda x: x / sqrt(list_sum(list_transform({Q}, lambda y: y * y)))) as q from embeddings), p as (select vec_id, q, lag(q) over (order by vec_id) as p from q) select vec_id, round(degrees(2 * acos(least(abs(list_sum(list_transform(range(1, 5), lambda i: p[i] * q[i]))), 1.0))), 4) as angle from p where p is not null")
def p11_quaternion_angle(t):
    q = F.transform(F.slice("embedding", 5, 4), lambda x: x.cast("double"))
    e = t("embeddings").select("vec_id", q.alias("r")).withColumn("q", F.transform("r", lambda x: x / F.sqrt(c.dot(F.col("r"), F.col("r")))))
    n = F.lit(1)
    a, b = e.select("vec_id", "q"), e.select((F.col("vec_id") + n).alias("vec_id"), F.col("q").alias("p"))
    return a.join(b, "vec_id").select("vec_id", F.round(c.quaternion_angle(F.col("p"), F.col("q")), 4).alias("angle"))


@query("select r_regionkey, 400.0::double as focal, round(4.9 + r_regionkey * 0.5::double, 6) as minimum_lumen from region")
def p12_profile(t):
    return t("region").select("r_regionkey", r6(c.focal_length(F.lit(640), F.lit(480), F.lit(90.0))).alias("focal"), r6(F.lit(4.9) + F.col("r_regionkey") * 0.5).alias("minimum_lumen"))


@query("select l_orderkey, l_linenumber, round(l_quantity * 2.5 - 1024, 6) as hu, round(l_quantity, 6) as plain from lineitem")
def p13_rescale(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(c.rescaled(F.col("l_quantity"), F.lit("2.5"), F.lit("-1024"))).alias("hu"), r6(c.rescaled(F.col("l_quantity"), F.lit("none"), F.lit(None).cast("string"))).alias("plain"))


@query("select l_orderkey, l_linenumber from lineitem where l_extendedprice <= 30000")
def p14_threshold(t):
    return t("lineitem").where("l_extendedprice <= 30000").select("l_orderkey", "l_linenumber")


@query(f"select video_id, frame_index, row, col, round(greatest(least(-v * 100, 95), 0), 4) as depth, cast(round_even(least(greatest(greatest(least(-v * 100, 95), 0) / 95, 0), 1) * 65535, 0) as int) as code from {PIXELS}")
def p15_depth_code(t):
    d = c.depth_from_buffer(F.col("v") * 100, 95.0)
    return pixels(t).select("video_id", "frame_index", "row", "col", F.round(d, 4).alias("depth"), c.depth_code(d, 95.0).alias("code"))


@query(f"select video_id, frame_index, row, col, sqrt((row - 3.5)^2 + (col - 3.5)^2) <= 0.485 * 8 as visible, v > 0 and sqrt((row - 3.5)^2 + (col - 3.5)^2) <= 0.485 * 8 as hit from {PIXELS}")
def p16_aperture(t):
    seen = c.in_aperture(F.col("row"), F.col("col"), 8, 8)
    return pixels(t).select("video_id", "frame_index", "row", "col", seen.alias("visible"), ((F.col("v") > 0) & ~F.isnan("v") & seen).alias("hit"))


@query("select l_orderkey, l_linenumber, cast(round_even(x, 0) as int) as preview, cast(floor(x) as int) as video from (select *, (least(greatest(l_quantity * 40 - 1000, -1350), 150) + 1350) / 1500 * 255 as x from lineitem)")
def p17_window(t):
    hu = F.col("l_quantity") * 40 - 1000
    return t("lineitem").select("l_orderkey", "l_linenumber", c.windowed(hu, -600.0, 1500.0).alias("preview"), c.windowed(hu, -600.0, 1500.0, True).alias("video"))


@query("with w as (select p_partkey, (p_retailprice - min(p_retailprice) over (partition by p_brand)) / greatest(max(p_retailprice) over (partition by p_brand) - min(p_retailprice) over (partition by p_brand), 1e-6) as u from part), s as (select *, least(greatest((u - 0.2) / 0.6, 0), 1) as s from w) select p_partkey, round(u, 6) as scaled, round(s * s * (3 - 2 * s), 6) as smooth from s")
def p18_smoothstep(t):
    w = Window.partitionBy("p_brand")
    u = c.normalized(F.col("p_retailprice"), F.min("p_retailprice").over(w), F.max("p_retailprice").over(w))
    return t("part").select("p_partkey", u.alias("u")).select("p_partkey", r6("u").alias("scaled"), r6(c.smoothstep(F.col("u"), 0.2, 0.8)).alias("smooth"))


ST = lambda x, a, b: f"(list_transform([least(greatest(({x} - {a}) / ({b} - {a}), 0.0::double), 1.0::double)], lambda q: q * q * (3 - 2 * q))[1])"
G = lambda at: ST("generation", f"({at} - 0.15::double)", f"({at} + 0.15::double)")
NEAR = ST("rn", "0.785::double", "0.935::double")
RAW = [f"greatest(1 - {G('0.5::double')}, 1 - {ST('dn', '0.14::double', '0.352::double')}, {NEAR})", f"{G('0.5::double')} * (1 - {G('1.5::double')}) * (1 - 0.65 * {NEAR})", f"{G('1.5::double')} * (1 - {G('3.5::double')}) * (1 - 0.65 * {NEAR})", f"greatest({G('3.5::double')}, {ST('dn', '0.5125::double', '0.732::double')}) * (1 - 0.65 * {NEAR})"]


@query(f"""with b as (select case_id, n, generation, (radius - 1) / 5 as rn, least(generation / 8.0, 1.0::double) as dn from {TREE}), w as (select case_id, n, case when rn > 0.86 or generation <= 0 then 0 when generation <= 1 then 1 when generation <= 3 then 2 else 3 end as region, {', '.join(f'{x} as w{i}' for i, x in enumerate(RAW))} from b)
select case_id, n, region, {', '.join(f'round(case when w0 + w1 + w2 + w3 > 1e-6 then w{i} / (w0 + w1 + w2 + w3) else {float(i == 3)} end, 6) as s{i}' for i in range(4))} from w""")
def p19_region(t):
    b = tree(t).select("case_id", "n", "generation", ((F.col("radius") - 1) / 5).alias("rn"), F.least(F.col("generation") / 8.0, F.lit(1.0)).alias("dn"))
    soft = c.soft_weights(F.col("generation"), F.col("dn"), F.col("rn"))
    return b.select("case_id", "n", c.region(F.col("generation"), F.col("rn")).alias("region"), *(r6(w).alias(f"s{i}") for i, w in enumerate(soft)))


@query("select l_returnflag, count(*) as voxels, round(count(*) * 0.747 * 0.747 * 1.2218 / 1000, 6) as airway_ml, 0.0::double as missing_ml from lineitem group by 1")
def p20_volume(t):
    none = [F.lit(None).cast("double")] * 3
    g = t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("voxels"))
    return g.select("l_returnflag", "voxels", r6(c.volume_ml(F.col("voxels"), none)).alias("airway_ml"), r6(c.volume_ml(F.lit(None).cast("long"), none)).alias("missing_ml"))


@query("""with v as (select l_orderkey, l_linenumber, (l_orderkey % 3)::double as a, (l_partkey % 3)::double as b, (l_suppkey % 3)::double as c from lineitem), u as (select *, sqrt(a * a + b * b + c * c) as n from v),
r as (select l_orderkey, l_linenumber, case when n > 0 then a / n else 1 end as rx, case when n > 0 then b / n else 0 end as ry, case when n > 0 then c / n else 0 end as rz from u)
select l_orderkey, l_linenumber, round(rx, 6) as rx, round(ry, 6) as ry, round(rz, 6) as rz, round(-rz, 6) + 0.0 as sx, 0.0::double as sy, round(rx, 6) as sz from r""")
def p21_orientation(t):
    v = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_orderkey % 3 as double) as a", "cast(l_partkey % 3 as double) as b", "cast(l_suppkey % 3 as double) as c")
    row = c.unit([F.col("a"), F.col("b"), F.col("c")], (1.0, 0.0, 0.0))
    s = c.cross(row, [F.lit(0.0), F.lit(1.0), F.lit(0.0)])
    return v.select("l_orderkey", "l_linenumber", *(r6(x).alias(n) for x, n in zip(row, ("rx", "ry", "rz"), strict=True)), *((r6(x) + 0.0).alias(n) for x, n in zip(s, ("sx", "sy", "sz"), strict=True)))


@query(f"select a.case_id, a.n, case when a.x - r.x >= 0 then 'right' else 'left' end || '-' || case when a.y - r.y >= 0 then 'upper' else 'lower' end as sector from {TREE} a join {TREE} r on a.case_id = r.case_id and r.n = 0")
def p22_sector(t):
    nodes = tree(t)
    root = nodes.where("n = 0").select("case_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    return nodes.join(root, "case_id").select("case_id", "n", c.sector(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")).alias("sector"))


PH = "(list_sum(list_transform(range(1, length(p_brand) + 1), lambda i: i * ascii(p_brand[i]))) % 997 / 997.0::double * 2 * pi())"


@query(f"select p_partkey, round(least(greatest(0.5 + 0.22 * sin(3 * (1.7 * x - 0.9 * y + 1.1 * z) + p) + 0.18 * cos(3 * (0.6 * x + 1.3 * y - 1.5 * z) - 0.5 * p) + 0.1 * sin(1.65 * (x + y) + 0.7 * p), 0), 1), 6) as modulation from (select p_partkey, p_size / 50.0::double as x, (p_partkey % 10) / 10.0::double as y, p_retailprice / 2000 as z, {PH} as p from part)")
def p23_texture(t):
    x, y, z = F.col("p_size") / 50, (F.col("p_partkey") % 10) / 10, F.col("p_retailprice") / 2000
    return t("part").select("p_partkey", r6(c.texture(F.col("p_brand"), x, y, z)).alias("modulation"))


@query("""with s as (select l_orderkey, count(*) as n, min(l_linenumber) as first, min(l_quantity) as q from lineitem group by 1)
select l_orderkey, 0.0::double as m0, round(1.0::double + l_orderkey % 3, 6) as m1, 0.0::double as m2, round(q, 6) as m3, 0.8::double as m4, 0.0::double as m5, 0.0::double as m6, 20.0::double as m7, 0.0::double as m8, 0.0::double as m9, round(-n * 0.5::double, 6) as m10, round(n * 2.0::double, 6) as m11 from s""")
def p24_slice_affine(t):
    """Columns: column direction x row spacing, row direction x column spacing, slice direction x slice spacing, origin."""
    s = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_quantity").alias("q"))
    row, col = [F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)]
    across = c.cross(row, col)
    spacing = (F.lit(0.8), 1.0 + F.col("l_orderkey") % 3, -F.col("n") * 0.5)
    origin = (F.col("q"), F.lit(20.0), F.col("n") * 2.0)
    m = [x for i in range(3) for x in (col[i] * spacing[0], row[i] * spacing[1], across[i] * spacing[2], origin[i])]
    return s.select("l_orderkey", *(r6(x).alias(f"m{i}") for i, x in enumerate(m)))
