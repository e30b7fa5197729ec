"""Queries of sources, series, rules and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvox.functions.columns import pseudonym
from corvox.operators import rules, series, stats
from corvox.sources import files

from .inputs import TREE, edges, tree
from .registry import query, r6

ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"


def order_json(t):
    return t("orders").select(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).alias("value"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def s2_json_lines(t):
    return order_json(t).select(files.parsed(F.col("value"), ORDER).alias("o")).select("o.*")


@query("select event_id, (props->>'k')::bigint as vertices, 0.747::double as spacing, cast(null as bigint) as voxels, false as checks_all from events")
def s3_flattened_cases(t):
    text = F.concat(F.lit('{"case_id":"'), "event_id", F.lit('","quality":{"mesh":{"vertices":'), F.get_json_object("props", "$.k"), F.lit("}}}"))
    cases = t("events").select(files.parsed(text, files.CASE).alias("c")).select("c.*")
    return files.flattened_cases(cases).select(F.col("case_id").cast("long").alias("event_id"), "vertices", F.col("spacing")[0].alias("spacing"), "voxels", "checks_all")


#: Nodes of one graph document; larger cases have several.
PART = 4096


def graphs(t):
    """JSON documents of at most PART nodes and the edges to them, with the places of their first node and edge in the case."""
    n, e = tree(t).withColumn("part", F.expr(f"n div {PART}")), edges(tree(t)).withColumn("part", F.expr(f"edge_ord div {PART}"))
    nodes = n.groupBy("case_id", "part").agg(F.min("n").alias("first_node"), F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct("id", F.array("x", "y", "z").alias("point_mm"), F.col("radius").alias("radius_mm"), F.lit("b").alias("branch_id"), "generation", F.col("dist").alias("distance_mm"), (F.col("radius") > 1.5).alias("accessible")).alias("v")))), lambda x: x["v"]).alias("nodes"))
    links = e.groupBy("case_id", "part").agg((F.min("edge_ord") - 1).alias("first_edge"), F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(10.0).alias("length_mm"), F.lit("b").alias("branch_id"), "generation", F.lit(True).alias("accessible")).alias("v")))), lambda x: x["v"]).alias("edges"))
    return nodes.join(links, ["case_id", "part"], "left").select("case_id", "first_node", "first_edge", F.to_json(F.struct("nodes", "edges")).alias("value"))


@query(f"select case_id, n as node_ord, id, round(x, 6) as x, round(radius, 6) as radius, generation, radius > 1.5 as accessible from {TREE}")
def s5_graph_nodes(t):
    g = graphs(t).select("case_id", "first_node", "first_edge", files.parsed(F.col("value"), files.GRAPH).alias("g")).select("case_id", "first_node", "first_edge", "g.nodes", "g.edges")
    return files.graph_nodes(g).select("case_id", F.col("node_ord").cast("long").alias("node_ord"), "id", r6("x").alias("x"), r6("radius").alias("radius"), "generation", "accessible")


@query(f"select case_id, n - 1 as edge_ord, parent as src, id as dst, generation from {TREE} where parent is not null")
def s5_graph_edges(t):
    g = graphs(t).select("case_id", "first_node", "first_edge", files.parsed(F.col("value"), files.GRAPH).alias("g")).select("case_id", "first_node", "first_edge", "g.nodes", "g.edges")
    return files.graph_edges(g).select("case_id", F.col("edge_ord").cast("long").alias("edge_ord"), "src", "dst", "generation")


@query("select conv_id as case_id, 'main' as path_id, turn as frame_index, turn / 20.0::double as time_s, role as phase from conversations")
def s6_path_frames(t):
    f = F.struct(F.col("turn").alias("frame_index"), (F.col("turn") / 20).alias("time_s"), F.lit(None).cast("array<double>").alias("position"), F.lit(None).cast("array<double>").alias("quaternion"), F.col("role").alias("phase"))
    docs = t("conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.array(F.struct(F.lit("main").alias("path_id"), F.sort_array(F.collect_list(f)).alias("frames"))).alias("paths"))
    docs = docs.select("case_id", files.parsed(F.to_json(F.struct("paths")), files.PATHS)["paths"].alias("paths"))
    return files.path_frames(docs, "main").select("case_id", "path_id", "frame_index", "time_s", "phase")


@query("select o_orderkey, o_orderstatus as exact, o_orderpriority as folded, cast(null as varchar) as absent from orders")
def s7_series_catalogue(t):
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("Modality"), F.col("o_orderpriority").alias("BODYPART")))
    m = t("orders").select("o_orderkey", F.from_json(text, "map<string,string>").alias("m"))
    return m.select("o_orderkey", files.metadata(F.col("m"), "Modality").alias("exact"), files.metadata(F.col("m"), "BodyPart").alias("folded"), files.metadata(F.col("m"), "StudyUID").alias("absent"))


@query(f"select case_id, id, round(dist, 6) as dist, round(radius, 6) as radius, generation from {TREE}")
def s8_radius_profile(t):
    return files.profile(tree(t), 8).select("case_id", "id", r6("dist").alias("dist"), r6("radius").alias("radius"), "generation")


@query("""select '{"n":' || count(*) || ',"status":"' || o_orderstatus || '"}' as value from orders group by o_orderstatus""")
def s9_report_json(t):
    return files.report_json(t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")))


@query("with c as (select conv_id, count(*) as frames from conversations group by 1) select * from (select 'episodes' as name, format('{:,}', count(*)) as value from c union all select 'frames', format('{:,}', sum(frames)::bigint) from c)")
def s11_report_lines(t):
    return files.report_lines(stats.totals(episode_lengths(t), 20.0), {"episodes": 0, "frames": 0})


SERIES = "(select (o_custkey % 50)::varchar as patient_id, o_orderstatus as study_uid, o_orderkey::varchar as series_uid, case when o_orderstatus = 'P' then null when o_orderstatus = 'O' then 'CT' else 'MR' end as modality, o_orderpriority as body_part from orders)"


def series_table(t):
    m = F.when(F.col("o_orderstatus") == "O", "CT").when(F.col("o_orderstatus") == "F", "MR")
    return t("orders").select((F.col("o_custkey") % 50).cast("string").alias("patient_id"), F.col("o_orderstatus").alias("study_uid"), F.col("o_orderkey").cast("string").alias("series_uid"), m.alias("modality"), F.col("o_orderpriority").alias("body_part"))


@query(f"select patient_id, series_uid, modality from {SERIES} where (modality is null or modality = 'CT') and lower(body_part) = '2-high' and study_uid = 'O'")
def f1_series_filter(t):
    return series.listed(series_table(t), "CT", "2-HIGH", study_uid="O").select("patient_id", "series_uid", "modality")


@query(f"select patient_id, series_uid from (select *, row_number() over (partition by patient_id order by study_uid, series_uid) as k from {SERIES} where modality is null or modality = 'CT') where k = 1")
def f2_series_pick(t):
    return series.picked(series_table(t), "patient_id").select("patient_id", "series_uid")


SLICES = "(select l_orderkey as series, l_linenumber as instance, l_partkey as input_ord, l_quantity as proj, (l_linenumber % 3)::bigint as rows, (l_tax * 100)::bigint as cols, l_linenumber || '.dcm' as path from lineitem)"


def slice_table(t):
    return t("lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("instance"), F.col("l_partkey").alias("input_ord"), F.col("l_quantity").alias("proj"), (F.col("l_linenumber") % 3).cast("long").alias("rows"), F.round(F.col("l_tax") * 100).cast("long").alias("cols"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".dcm")).alias("path"))


@query(f"select series, instance, row_number() over (partition by series order by case when instance % 5 = 0 then instance::double else proj end, path) - 1 as ordinal from {SLICES}")
def k6_slice_order(t):
    return series.ordered(slice_table(t), F.when(F.col("instance") % 5 != 0, F.col("proj"))).select("series", "instance", "ordinal")


@query(f"with g as (select series, abs(proj - lag(proj) over (partition by series order by proj)) as gap from {SLICES}) select series, round(coalesce(median(gap) filter (gap > 0), 1.25), 6) as spacing, case when count(*) filter (gap > 0) > 0 then 'projection' else 'thickness' end as derivation from g group by 1")
def w9_slice_spacing(t):
    s = series.spacing(slice_table(t).withColumn("thickness", F.lit(1.25)), "proj", "thickness")
    return s.select("series", r6("spacing").alias("spacing"), "derivation")


@query(f"select series, count(distinct (rows, cols)) as sizes from {SLICES} group by 1 having count(distinct (rows, cols)) > 1")
def f15_uneven_slices(t):
    return series.uneven(slice_table(t))


@query(f"select series, count(*) as n, string_agg(path, ',' order by proj, path) as paths from {SLICES} group by 1")
def a30_provenance(t):
    s = series.ordered(slice_table(t).withColumn("sha", pseudonym(F.col("path"))), F.col("proj"))
    return series.provenance(s).select("series", F.size("slices").cast("long").alias("n"), F.array_join(F.transform("slices", lambda x: x["path"]), ",").alias("paths"))


def manifests(t):
    o = t("orders")
    kind = F.when(F.col("o_orderstatus") == "O", "local_dicom").when(F.col("o_orderstatus") == "F", "spreadsheet")
    name = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("../"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    doc = F.to_json(F.struct(name.alias("case_id"), kind.alias("type"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")).alias("path")))
    return o.select("o_orderkey", files.parsed(doc, "case_id string, source_type string, type string, uri string, path string, input_path string, version string").alias("d")).select("o_orderkey", "d.*")


@query("select o_orderkey, r as rule from (select o_orderkey, unnest(list_filter([case when o_orderkey % 9 = 0 then 'case_id' end, case when o_orderstatus <> 'O' then 'source_type' end, case when o_custkey % 5 = 0 then 'uri' end], lambda x: x is not null)) as r from orders)")
def f8_volume_manifest(t):
    return rules.volume_manifest(manifests(t), "o_orderkey")


def recipes(t):
    o = t("orders")
    third = F.col("o_orderkey") % 3
    kind = F.when(third == 0, "local_ct").when(third == 1, "maisi").otherwise("magic")
    mask = F.when(third == 0, "precomputed").when(third == 1, "external_segmenter").otherwise("ct_threshold")
    even = F.when(F.col("o_custkey") % 2 == 0, "a/b")
    given = F.when(F.col("o_orderstatus") == "O", F.array(*map(F.lit, rules.REQUIRED))).when(F.col("o_orderstatus") == "F", F.array(*map(F.lit, ("rgb", "depth", "pps", "extra"))))
    renderer = F.when(F.col("o_orderpriority") == "1-URGENT", "pencil").when(F.col("o_orderpriority") == "2-HIGH", "software_preview")
    return o.select("o_orderkey", kind.alias("volume_kind"), even.alias("volume_path"), F.lit(" ").alias("volume_config"), mask.alias("mask_kind"), even.alias("mask_path"), even.alias("mask_command"), renderer.alias("renderer"), given.alias("modalities"))


@query("select o_orderkey, r as rule from (select o_orderkey, unnest(list_filter([case when o_orderkey % 3 = 2 then 'volume_kind' end, case when o_orderkey % 3 = 1 or (o_orderkey % 3 = 0 and o_custkey % 2 = 1) then 'volume_path' end, case when o_orderkey % 3 = 0 and o_custkey % 2 = 1 then 'mask_path' end, case when o_orderkey % 3 = 1 and o_custkey % 2 = 1 then 'mask_command' end, case when o_orderstatus = 'F' then 'modalities' end, case when o_orderpriority = '1-URGENT' then 'renderer' end], lambda x: x is not null)) as r from orders)")
def f9_case_recipe(t):
    return rules.case_recipe(recipes(t), "o_orderkey")


@query("select o_orderkey, case when o_orderstatus = 'O' then '' when o_orderstatus = 'F' then 'mask,normal' else 'depth,mask,normal,pps,rgb' end as missing from orders")
def u3_missing_members(t):
    return recipes(t).select("o_orderkey", F.array_join(F.array_sort(rules.missing_members(F.col("modalities"), rules.REQUIRED)), ",").alias("missing"))


@query("with f as (select conv_id || ':' || (turn // 2) as frame_id, role, case when turn % 5 > 0 then 'x' end as path, turn from conversations) select frame_id, unnest(list_filter([case when count(*) over (partition by frame_id) > 1 then 'duplicate' end, case when role <> 'user' then 'modality' end, case when path is null then 'path' end, case when turn % 4 = 0 then 'neighbours' end], lambda x: x is not null)) as rule from f")
def f10_training_manifest(t):
    f = t("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.expr("cast(turn div 2 as string)")).alias("frame_id"), F.col("role").alias("modality"), F.when(F.col("turn") % 5 > 0, "x").alias("path"), F.when(F.col("turn") % 4 > 0, F.array(F.lit("a"))).alias("neighbours"))
    return rules.training_manifest(f, ["user"])


BROKEN = f"(select case_id, id, case when n % 17 = 0 then -radius else radius end as radius, generation, case when n % 19 = 0 then -1.0::double - dist else dist end as dist, n from {TREE})"


@query(f"select case_id, id as item, 'radius' as rule from {BROKEN} where radius <= 0 union all select case_id, id, 'distance' from {BROKEN} where dist < 0 union all select case_id, parent || '>' || id || 'x', 'dangling' from {TREE} where n % 23 = 1 union all select case_id, parent || '>' || parent, 'loop' from {TREE} where n % 29 = 1")
def f11_graph_rules(t):
    nodes = tree(t)
    e = edges(nodes)
    dst = F.when(F.col("edge_ord") % 23 == 1, F.concat("dst", F.lit("x"))).when(F.col("edge_ord") % 29 == 1, F.col("src")).otherwise(F.col("dst"))
    e = e.where("edge_ord % 23 <> 1 or edge_ord % 29 <> 1").withColumn("dst", dst).union(e.where("edge_ord % 23 = 1 and edge_ord % 29 = 1").withColumn("dst", F.col("src"))).union(e.where("edge_ord % 23 = 1 and edge_ord % 29 = 1").withColumn("dst", F.concat("dst", F.lit("x"))))
    nodes = nodes.withColumns({"radius": F.when(F.col("n") % 17 == 0, -F.col("radius")).otherwise(F.col("radius")), "dist": F.when(F.col("n") % 19 == 0, -1.0 - F.col("dist")).otherwise(F.col("dist"))})
    roots = nodes.where("n = 0").select("case_id", "id")
    return rules.graph(nodes, e, roots)


@query("with m as (select o_custkey, count(*) as nodes, sum(o_totalprice) as length from orders group by 1) select o_custkey, concat_ws(',', case when nodes < 10 then 'nodes_below_10' end, case when length < 2e6 then 'length_below_2e+06' end, case when nodes % 2 = 1 then 'opening_missing' end) as reasons, nodes >= 10 and length >= 2e6 and nodes % 2 = 0 as passed from m")
def f5_corpus_gate(t):
    m = t("orders").groupBy("o_custkey").agg(F.count("*").alias("nodes"), F.sum("o_totalprice").alias("length")).withColumn("opening", F.col("nodes") % 2 == 0)
    return rules.corpus_gate(m, {"nodes": 10, "length": 2e6}, ["opening"]).select("o_custkey", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("select o_custkey, case when count(*) >= 10 and max(o_totalprice) > 1e5 then 'pass' else 'fail' end as status, 'fail' as empty from orders group by 1")
def f4_case_gate(t):
    m = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("p"))
    checks = F.create_map(F.lit("enough"), F.col("n") >= 10, F.lit("long"), F.col("p") > 1e5)
    return m.select("o_custkey", rules.case_gate(checks).alias("status"), rules.case_gate(F.create_map().cast("map<string,boolean>")).alias("empty"))


def episode_lengths(t):
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("frames")).withColumn("passed", F.col("conv_id") % 10 > 0)


@query("with c as (select conv_id, count(*) as frames from conversations group by 1) select count(*) as episodes, sum(frames)::bigint as frames, round(sum(frames) / 20.0::double / 3600, 6) as hours, round(median(frames / 20.0::double), 6) as duration_median, round(quantile_cont(frames / 20.0::double, 0.05), 6) as duration_p05, round(quantile_cont(frames / 20.0::double, 0.95), 6) as duration_p95, count(*) filter (conv_id % 10 = 0) as failures, round(avg(case when conv_id % 10 > 0 then 1.0::double else 0.0 end), 6) as pass_rate from c")
def a7_totals(t):
    s = stats.totals(episode_lengths(t), 20.0)
    return s.select(*(r6(c).alias(c) if d == "double" else F.col(c) for c, d in s.dtypes))


@query("with o as (select l_orderkey, sum(l_quantity) as q, sum(l_extendedprice) as p from lineitem group by 1) select 'q' as metric, round(median(q), 4) as median, round(quantile_cont(q, 0.05), 4) as p05, round(quantile_cont(q, 0.95), 4) as p95 from o union all select 'p', round(median(p), 4), round(quantile_cont(p, 0.05), 4), round(quantile_cont(p, 0.95), 4) from o")
def a8_spread(t):
    s = stats.spread(t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p")), ["q", "p"])
    return s.select("metric", *(F.round(x, 4).alias(x) for x in ("median", "p05", "p95")))


@query("with e as (select min(o_totalprice) as low, max(o_totalprice) as high, least(32, greatest(6, count(*) // 3)) as bins from orders) select least(bins, floor((o_totalprice - low) / (high - low) * bins) + 1)::int as bin, count(*) as n from orders, e group by 1")
def a9_histogram(t):
    return stats.histogram(t("orders"), "o_totalprice")


@query("select n_name, r_name, cadence, n_name || '|' || r_name || '|' || cadence as key from nation, region, (values (10), (20)) c(cadence)")
def j15_environments(t):
    cadence = t("nation").sparkSession.createDataFrame([(10,), (20,)], "cadence int")
    g = stats.environments(t("nation").select("n_name"), t("region").select("r_name"), cadence)
    return g.dropDuplicates(["environment_id"]).select("n_name", "r_name", "cadence", F.concat_ws("|", "n_name", "r_name", F.col("cadence").cast("string")).alias("key"))
