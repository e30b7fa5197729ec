"""Queries of frame catalogues, audits, splits, motion and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvox.functions import columns as c
from corvox.operators import audit, frames, motion
from corvox.sources import files

from .inputs import CHAINS, FRAMES, PATHS, PIXELS, RECORDS, chains, paths, pixels, records
from .inputs import frames as frame_table
from .registry import query, r6

TURNS = "(select conv_id, turn, role from conversations)"


@query("select conv_id, turn, row_number() over (partition by conv_id order by split(lpad(turn::varchar, 8, '0') || '/' || role, '/')) - 1 as frame_index from conversations")
def w1_frame_index(t):
    files = t("conversations").select("conv_id", "turn", F.concat_ws("/", F.format_string("%08d", "turn"), "role").alias("path"))
    return frames.indexed(files, "conv_id", "path").select("conv_id", "turn", "frame_index")


@query("select conv_id, turn, coalesce(array_to_string(list(turn) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), ',') || case when lead(turn) over (partition by conv_id order by turn) is not null then ',' else '' end, '') || coalesce(array_to_string(list(turn) over (partition by conv_id order by turn rows between 1 following and 2 following), ','), '') as neighbours from conversations")
def w2_neighbours(t):
    n = frames.neighbours(t("conversations"), "conv_id", "turn", "turn", 2)
    return n.select("conv_id", "turn", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


DELTA = f"""p as (select video_id, frame_index, gray, lag(gray) over (partition by video_id order by frame_index) as b from {FRAMES}),
d as (select video_id, frame_index, unnest(list_transform(range(1, 65), lambda i: gray[i]::double - b[i]::double)) as x from p where b is not null),
m as (select video_id, frame_index, median(x) as mid from d group by all),
e as (select video_id, frame_index, avg(abs(x)) as abs_diff, avg(abs(x - mid)) as flicker, avg(x) as luminance from d join m using (video_id, frame_index) group by all)"""


@query(f"with {DELTA} select video_id, frame_index, round(abs_diff, 6) as abs_diff, round(flicker, 6) as flicker, round(luminance, 6) as luminance from e")
def w3_frame_differences(t):
    return frames.differences(frame_table(t)).select("video_id", "frame_index", r6("abs_diff").alias("abs_diff"), r6("flicker").alias("flicker"), r6("luminance").alias("luminance"))


@query(f"with {DELTA} select video_id, count(*) + 1 as frames, round(avg(abs_diff), 6) as abs_diff_mean, round(quantile_cont(abs_diff, 0.95), 6) as abs_diff_p95, round(avg(flicker), 6) as flicker_mean, round(quantile_cont(flicker, 0.95), 6) as flicker_p95, round(avg(luminance), 6) as luminance_mean, round(avg(abs(luminance)), 6) as luminance_abs_mean from e group by 1")
def a12_consistency(t):
    s = frames.consistency(frame_table(t))
    return s.select("video_id", "frames", *(r6(x).alias(x) for x in s.columns[2:]))


EPISODES = """(select label as episode, row_number() over (partition by label order by vec_id) - 1 as frame, list_transform(embedding[1:3], lambda x: x::double) as pos, list_transform(embedding[4:7], lambda x: x / sqrt(list_sum(list_transform(embedding[4:7], lambda y: y::double * y::double)))) as q, embedding[8]::double as depth from embeddings)"""
STEPS = f"""b as (select *, lag(pos) over w as p0, lag(q) over w as q0, lag(depth) over w as d0 from {EPISODES} window w as (partition by episode order by frame)),
s as (select episode, frame, sqrt((pos[1] - p0[1])^2 + (pos[2] - p0[2])^2 + (pos[3] - p0[3])^2) as step, degrees(2 * acos(least(abs(q[1] * q0[1] + q[2] * q0[2] + q[3] * q0[3] + q[4] * q0[4]), 1.0::double))) * 20 as angular, depth, depth - d0 as d_depth from b where p0 is not null)"""


def episodes(t):
    q = F.transform(F.slice("embedding", 4, 4), lambda x: x.cast("double"))
    w = frame_table(t).withColumnRenamed("gray", "embedding").withColumn("q", q)
    n = F.sqrt(c.dot(F.col("q"), F.col("q")))
    action = F.concat(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")), F.transform("q", lambda x: x / n), F.array(F.element_at("embedding", 8).cast("double")))
    return w.select(F.col("video_id").alias("episode"), F.col("frame_index").alias("frame"), action.alias("action"))


@query(f"select episode, frame, round(pos[1], 6) as x, round(q[1], 6) as q0, round(depth, 6) as depth from {EPISODES}")
def s4_episode_scan(t):
    a = lambda i: r6(F.element_at("action", i))
    return episodes(t).select("episode", "frame", a(1).alias("x"), a(4).alias("q0"), a(8).alias("depth"))


@query(f"with {STEPS} select episode, frame, round(step, 6) as step, round(step * 20000, 4) as speed, round(angular, 3) as angular, round(d_depth, 6) as d_depth from s")
def w4_kinematics(t):
    return motion.kinematics(episodes(t), 20.0).select("episode", "frame", r6("step").alias("step"), F.round("speed", 4).alias("speed"), F.round("angular", 3).alias("angular"), r6("d_depth").alias("d_depth"))


@query(f"with {STEPS} select episode, round(sum(step), 5) as path, round(quantile_cont(step * 20000, 0.5), 4) as speed_median, round(quantile_cont(step * 20000, 0.95), 4) as speed_p95, round(quantile_cont(angular, 0.5), 3) as angular_median, round(quantile_cont(angular, 0.95), 3) as angular_p95, round(max(depth), 6) as max_insertion, round(avg(case when d_depth < -1e-6 then 1.0 else 0.0 end), 6) as retraction from s group by 1")
def a11_episode_summary(t):
    s = motion.episode_summary(motion.kinematics(episodes(t), 20.0))
    return s.select("episode", *(F.round(x, d).alias(x) for x, d in zip(s.columns[1:], (5, 4, 4, 3, 3, 6, 6), strict=True)))


ARC = f"(select *, sum(step) over (partition by case_id order by ord) as s from (select *, coalesce(sqrt((x - lag(x) over w)^2 + (y - lag(y) over w)^2 + (z - lag(z) over w)^2), 0) as step from {CHAINS} window w as (partition by case_id order by ord)))"


@query(f"select case_id, ord, round(step, 5) as step, round(s, 4) as s from {ARC}")
def w7_arc_length(t):
    return motion.arc_length(chains(t), "case_id", "ord").select("case_id", "ord", F.round("step", 5).alias("step"), F.round("s", 4).alias("s"))


def _mean(c: str) -> str:
    near = [f"coalesce(lag({c}, {-d}) over w, 0)" if d < 0 else f"coalesce(lead({c}, {d}) over w, 0)" if d else c for d in range(-3, 4)]
    return f"case when n >= 7 and ord > 0 and ord < n - 1 then ({' + '.join(near)}) / (count({c}) over (partition by case_id order by ord rows between 3 preceding and 3 following)) else {c} end as {c}"


def _pass(src: str) -> str:
    return f"select case_id, ord, n, {_mean('x')}, {_mean('y')} from {src} window w as (partition by case_id order by ord)"


@query(f"select case_id, ord, round(x + 1e-9, 5) as x, round(y + 1e-9, 5) as y from ({_pass('(' + _pass(f'(select *, count(*) over (partition by case_id) as n from {CHAINS})') + ')')})")
def w8_smoothed(t):
    """Means of short decimals lie halfway between two roundings, which engines decide differently: hence the 1e-9."""
    return motion.smoothed(chains(t), "case_id", "ord", ["x", "y"]).select("case_id", "ord", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in "xy"))


@query(f"""with g as (select *, lead(s) over w as d1, lead(x) over w as x1, max(s) over (partition by case_id) as e from {ARC} window w as (partition by case_id order by ord)), k as (select * from g where d1 > s),
a as (select case_id, s as d0, d1, x, x1, unnest(list_concat(list_transform(range(ceil(s / 25)::bigint, ceil(d1 / 25)::bigint), lambda i: i * 25.0::double), case when d1 = e then [e] else [] end)) as p from k) select case_id, round(p, 4) as s, round(x + (x1 - x) * (p - d0) / (d1 - d0), 4) as x from a""")
def j12_resampled(t):
    arc = motion.arc_length(chains(t), "case_id", "ord")
    return motion.resampled(arc, "case_id", "ord", "s", ["x"], 25.0).select("case_id", F.round("s", 4).alias("s"), F.round("x", 4).alias("x"))


@query(f"with n as (select *, case when event_type = lag(event_type) over (partition by case_id order by ord) then 0 else 1 end as new from {ARC}), r as (select *, sum(new) over (partition by case_id order by ord) as run from n) select case_id, run::bigint as run, event_type, count(*) as frames, round(sum(step), 4) as distance from r group by case_id, run, event_type")
def a21_phases(t):
    p = motion.phases(motion.arc_length(chains(t), "case_id", "ord"), "case_id", "ord", "event_type", "step")
    return p.select("case_id", "run", "event_type", "frames", F.round("distance", 4).alias("distance"))


@query(f"select case_id, round(sum(step), 3) as length, round((max(ord) - min(ord)) / 20.0::double, 3) as duration, count(*) as frames, round(sum(step) / greatest((max(ord) - min(ord)) / 20.0::double, 1e-6), 3) as mean_speed, round(2 * min(1 + (ord * 7 % 11 + case_id % 5) / 10), 3) as min_lumen, round(2 * min(1 + (ord * 7 % 11 + case_id % 5) / 10) - 1.8, 3) as clearance from {ARC} group by 1 having count(*) > 1")
def a22_path_summary(t):
    at = motion.arc_length(chains(t), "case_id", "ord").withColumn("radius", F.expr("1 + (ord * 7 % 11 + case_id % 5) / 10"))
    p = motion.path_summary(at, "case_id", F.col("ord") / 20, 1.8).where("frames > 1")
    return p.select("case_id", *(F.round(x, 3).alias(x) if x != "frames" else F.col(x) for x in p.columns[1:]))


@query("select conv_id, count(*) as frame_count, array_to_string(list(role order by turn), ',') as items from conversations group by 1")
def a1_sequences(t):
    return frames.sequences(t("conversations"), "conv_id", "turn", "role").select("conv_id", "frame_count", F.array_join("items", ",").alias("items"))


FILES = """(select 'quality' as modality, doc_id || '.png' as file from labels union all select 'depth', doc_id || '.npy' from documents where doc_id % 2 = 0 union all select 'depth', doc_id || '.exr' from documents where doc_id % 6 = 0)"""


def condition_files(t):
    d = t("documents")
    name = lambda s: F.concat(F.col("doc_id").cast("string"), F.lit(s))
    return t("labels").select(F.lit("quality").alias("modality"), name(".png").alias("file")).union(d.where("doc_id % 2 = 0").select(F.lit("depth"), name(".npy"))).union(d.where("doc_id % 6 = 0").select(F.lit("depth"), name(".exr")))


def rgb(t):
    return t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))


@query(f"select path, modality, coalesce(max(file) filter (file = path), min(file)) as file from (select doc_id || '.png' as path, doc_id from documents) join {FILES} on split_part(file, '.', 1) = doc_id::varchar group by 1, 2")
def j1_conditions(t):
    return frames.conditions(rgb(t), condition_files(t))


@query(f"select doc_id || '.png' as path, m.modality from documents, (values ('quality'), ('depth')) m(modality) where not exists (select 1 from {FILES} f where f.modality = m.modality and split_part(file, '.', 1) = doc_id::varchar)")
def j2_missing_conditions(t):
    modes = condition_files(t).sparkSession.createDataFrame([("quality",), ("depth",)], "modality string")
    return frames.missing(rgb(t), modes, frames.conditions(rgb(t), condition_files(t)))


INVENTORY = "(select doc_id::varchar as path, strlen(text) as bytes, sha256(text) as sha from documents)"
TAMPERED = "(select doc_id::varchar as path, case when doc_id % 7 = 0 then strlen(text) + 1 else strlen(text) end as bytes, case when doc_id % 7 = 0 then sha256(text || 'x') else sha256(text) end as sha from documents where doc_id % 11 <> 0)"


def inventory(t, tampered: bool = False):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")) if tampered else F.col("text")
    d = t("documents").where("doc_id % 11 <> 0") if tampered else t("documents")
    return d.select(F.col("doc_id").cast("string").alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha"))


@query("select doc_id::varchar as path, strlen(text) as bytes, md5(text) as md5, sha256(text) as sha from documents")
def s10_inventory(t):
    return t("documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha")).dropDuplicates(["path"])


@query(f"select e.path, o.path is not null as present, coalesce(e.bytes = o.bytes and e.sha = o.sha, false) as verified from {INVENTORY} e left join {TAMPERED} o on e.path = o.path")
def j3_verified(t):
    return audit.verified(inventory(t), inventory(t, True)).select("path", "present", "verified")


@query(f"select e.path, case when o.path is null then 'missing' else concat_ws(',', case when e.bytes <> o.bytes then 'size_changed' end, case when e.sha <> o.sha then 'sha_changed' end) end as flags from {INVENTORY} e left join {TAMPERED} o on e.path = o.path")
def j4_artifact_flags(t):
    return audit.verified(inventory(t), inventory(t, True)).select("path", F.array_join("flags", ",").alias("flags"))


@query("select conv_id, turn from conversations c where not exists (select 1 from documents d where d.doc_id = c.conv_id * 31 + c.turn)")
def j5_unresolved(t):
    return t("conversations").withColumn("ref", F.col("conv_id") * 31 + F.col("turn")).join(t("documents").select(F.col("doc_id").alias("ref")), "ref", "left_anti").select("conv_id", "turn")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def j11_retained(t):
    keep = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(keep, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


SPLIT = f"""r as (select *, row_number() over (partition by category order by sha256('split-1|' || category || '|' || patient), patient) as rank, count(*) over (partition by category) as n from {RECORDS}),
f as (select *, greatest(1, round_even(n * 0.1, 0)::int) as v, greatest(1, round_even(n * 0.15, 0)::int) as s from r),
w as (select category, patient, image_count, case when n < 3 or rank <= n - v - s then 'train' when rank <= n - s then 'validation' else 'test' end as split from f)"""


def assigned(t):
    return audit.group_split(records(t), 0.75, 0.1, 0.15, "split-1")


@query(f"with {SPLIT} select * from w")
def w6_group_split(t):
    return assigned(t)


@query(f"with {SPLIT} select split, category, count(distinct patient) as patients, sum(image_count)::bigint as images from w group by 1, 2")
def a5_split_summary(t):
    return audit.split_summary(assigned(t))


@query(f"with {SPLIT}, e as (select split, category, count(*) as n, sum(image_count)::bigint as m from w group by 1, 2) select split, sum(n)::bigint as patients, sum(m)::bigint as images, string_agg(category || ':' || n || ':' || m, ',' order by category) as categories from e group by 1")
def a5_split_totals(t):
    s = audit.split_totals(assigned(t))
    return s.select("split", "patients", "images", F.array_join(F.transform("categories", lambda x: F.concat_ws(":", x["category"], x["patients"].cast("string"), x["images"].cast("string"))), ",").alias("categories"))


@query(f"with {SPLIT} select split, patient, category, image_count, row_number() over (partition by split order by patient, category) - 1 as place from w")
def a5_split_patients(t):
    return audit.split_patients(assigned(t)).select("split", "patient", "category", "image_count", F.col("place").cast("long").alias("place"))


@query(f"with {SPLIT}, x as (select category, patient, split from w union all select category, patient, 'test' from w where patient % 10 = 0) select category, patient, array_to_string(list_sort(list(distinct split)), ',') as splits from x group by 1, 2 having count(distinct split) > 1")
def a6_leaks(t):
    a = assigned(t).select("category", "patient", "split")
    extra = a.where("patient % 10 = 0").select("category", "patient", F.lit("test").alias("split"))
    return audit.leaks(a.union(extra)).select("category", "patient", F.array_join("splits", ",").alias("splits"))


@query(f"with {SPLIT}, x as (select category, patient, image_count, split from w union all select category, patient, image_count, 'test' from w where patient % 10 = 0), e as (select category, patient, count(distinct split) as n, sum(image_count) as m from x group by 1, 2) select bool_or(n > 1) as patient_overlap, count(*) filter (n > 1) as overlaps, count(*) as assigned_patients, sum(m)::bigint as assigned_images from e")
def a6_leak_report(t):
    a = assigned(t)
    return audit.leak_report(a.union(a.where("patient % 10 = 0").withColumn("split", F.lit("test"))))


@query(f"select category, patient, image_count from {RECORDS} where category is not null")
def a4_patient_records(t):
    return records(t).dropna(subset=["category", "patient"])


DATASET = f"""(select page_id % 8 as kind, split_part(path, '/', 1) as host, split_part(path, '/', 2) as lang, case when page_id % 8 < 3 then 'Lung_cancer/imgs/' || host || '/' || lang || '/' || page_id || '.png' when page_id % 8 < 5 then 'Non-Lung-Cancer/' || host || '/' || page_id || '.JPG' when page_id % 8 = 5 then 'other/' || page_id || '.png' when page_id % 8 = 6 then 'Lung_cancer/' || page_id || '/labels.json' else 'Lung_cancer/' || page_id || '.txt' end as path from {PATHS})"""


@query(f"""with f as (select *, case when kind in (0, 1, 2, 6, 7) then 'lung_cancer' when kind < 5 then 'non_lung_cancer' else 'uncategorized' end as category from {DATASET}), i as (select *, row_number() over (partition by category order by string_split(path, '/')) as n from f where kind < 6),
c as (select category, count(*) as images, count(distinct case when kind < 5 then host end) as patients, count(distinct case when kind < 3 then host || '/' || lang when kind < 5 then host || '/.' end) as videos, string_agg(path || ':' || length(path) || 'x7', ',' order by n) filter (n <= 3) as samples from i group by 1), m as (select category, string_agg(path, ',' order by path) as metadata_files from f where kind = 6 group by 1)
select category, images, patients, videos, coalesce(metadata_files, '') as metadata_files, samples from c left join m using (category)""")
def a2_dataset_audit(t):
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    p, k = paths(t).select((F.col("page_id") % 8).alias("kind"), F.col("page_id").cast("string").alias("id"), part(1).alias("host"), part(2).alias("lang")), F.col("kind")
    name = F.when(k < 3, F.concat(F.lit("Lung_cancer/imgs/"), "host", F.lit("/"), "lang", F.lit("/"), "id", F.lit(".png"))).when(k < 5, F.concat(F.lit("Non-Lung-Cancer/"), "host", F.lit("/"), "id", F.lit(".JPG"))).when(k == 5, F.concat(F.lit("other/"), "id", F.lit(".png")))
    name = name.when(k == 6, F.concat(F.lit("Lung_cancer/"), "id", F.lit("/labels.json"))).otherwise(F.concat(F.lit("Lung_cancer/"), "id", F.lit(".txt")))
    sizes = lambda some: some.select("path", F.length("path").alias("width"), F.lit(7).alias("height"))
    a = audit.dataset_audit(p.select(name.alias("path")), sizes, 3)
    shown = F.transform("samples", lambda x: F.concat(x["path"], F.lit(":"), x["width"].cast("string"), F.lit("x"), x["height"].cast("string")))
    return a.select("category", "images", "patients", "videos", F.array_join("metadata_files", ",").alias("metadata_files"), F.array_join(shown, ",").alias("samples"))


@query(f"select lower(regexp_extract(split_part(path, '/', 1), '\\.[^.]+$')) as suffix, count(*) as n from {PATHS} group by 1")
def a3_suffixes(t):
    return paths(t).groupBy(c.suffix(F.split_part("path", F.lit("/"), F.lit(1))).alias("suffix")).agg(F.count("*").alias("n"))


@query(f"select page_id, path from {PATHS} where lower(regexp_extract(split_part(path, '/', 1), '\\.[^.]+$')) in ('.com', '.org')")
def s1_file_catalogue(t):
    return paths(t).where(c.suffix(F.split_part("path", F.lit("/"), F.lit(1))).isin(".com", ".org")).orderBy(F.split("path", "/")).select("page_id", "path")


@query("select count(*) as unique_worlds, (sum(m) - count(*))::bigint as duplicates, max(m) as max_multiplicity from (select count(*) as m from documents group by lang, n_chars, md5(text))")
def a10_replicas(t):
    return audit.replicas(t("documents"), "lang", "n_chars", F.md5("text"))


@query("select doc_id from (select doc_id, row_number() over (partition by lang, n_chars, md5(text) order by doc_id) as k from documents where doc_id < 600) where k = 1")
def w5_distinct_first(t):
    return audit.distinct_first(t("documents"), "doc_id", 600, "lang", "n_chars", F.md5("text")).select("doc_id")


@query("select o_orderkey from orders order by md5('7:' || o_orderkey), o_orderkey limit 100")
def k1_seeded_sample(t):
    return audit.seeded_sample(t("orders"), "o_orderkey", 100, 7).select("o_orderkey")


@query(f"select category, page_id, place from (select split_part(path, '/', 2) as category, page_id, row_number() over (partition by split_part(path, '/', 2) order by split(path, '/'), page_id) as place from {PATHS}) where place <= 3")
def k2_first_n(t):
    p = paths(t).withColumn("category", F.split_part("path", F.lit("/"), F.lit(2)))
    return audit.first_n(p, "category", 3, F.split("path", "/"), "page_id").select("category", "page_id", "place")


@query(f"with n as (select case_id, ord, count(*) over (partition by case_id) as n from {CHAINS}) select case_id, ord from n where n <= 5 or list_contains(list_transform(range(0, 5), lambda i: round_even(i * (n - 1) / 4.0::double, 0)::int), ord::int)")
def k3_evenly_spaced(t):
    return frames.evenly_spaced(chains(t), "case_id", "ord", 5).select("case_id", "ord")


@query("with r as (select c_custkey, c_acctbal, row_number() over (order by c_acctbal, c_custkey) - 1 as place, count(*) over () as n from customer), p as (select place, min(pick) as pick from (select greatest(0, least(n - 1, b + o)) as place, k * 3 + i as pick from (select max(n) as n from r), (values (0, 0), (1, 1), (2, -1), (3, 2), (4, -2)) x(k, o), lateral (select unnest([0, n // 2, n - 1]) as b, unnest([0, 1, 2]) as i)) group by 1) select c_custkey, round(c_acctbal, 6) as value, pick::int as pick from r join p using (place)")
def k4_rank_picks(t):
    return audit.rank_picks(t("customer"), "c_custkey", "c_acctbal").select("c_custkey", r6("value").alias("value"), "pick")


@query(f"select case_id, ord from {CHAINS} where ord % 3 = 0 and ord < 12")
def k5_strided(t):
    return frames.strided(chains(t), "case_id", "ord", 3, 4).select("case_id", "ord")


RGB = f"(select video_id, frame_index, least(greatest((v + 0.3) * 400, 0), 255) as r, least(greatest((v + 0.3) * 300, 0), 255) as g, least(greatest((v + 0.28) * 900, 0), 255) as b, case when video_id % 2 = 0 then case when (\"row\" + col) % 3 > 0 then 255 else 0 end end as alpha from {PIXELS})"


@query(f"""with p as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from {RGB}), c as (select video_id, frame_index, avg(x) as mean, stddev_pop(x) as std from (select video_id, frame_index, unnest([r, g, b]) as x from {RGB}) group by 1, 2), s as (select video_id, frame_index, min(lo) as low, max(hi) as high, avg((hi > 3)::int) as non_black, avg((lo > 250)::int) as near_white, case when count(alpha) > 0 then avg(coalesce(alpha > 0, false)::int) end as alpha_coverage, case when count(alpha) > 0 then avg(coalesce(alpha > 0 and hi <= 3, false)::int) end as visible_dark from p group by 1, 2)
select video_id, frame_index, round(mean, 4) as mean, round(std, 4) as std, round(low, 4) as low, round(high, 4) as high, round(non_black, 6) as non_black, round(near_white, 6) as near_white, round(alpha_coverage, 6) as alpha_coverage, round(visible_dark, 6) as visible_dark, round(greatest(non_black, coalesce(alpha_coverage, 0)), 6) as coverage, case when alpha_coverage is null then 'rgb_nonblack' else 'alpha_or_rgb_nonblack' end as coverage_source from c join s using (video_id, frame_index)""")
def a25_capture_metrics(t):
    tone = lambda lift, gain: F.least(F.greatest((F.col("v") + lift) * gain, F.lit(0.0)), F.lit(255.0))
    alpha = F.when(F.col("video_id") % 2 == 0, F.when((F.col("row") + F.col("col")) % 3 > 0, 255).otherwise(0))
    m = frames.capture_metrics(pixels(t).select("video_id", "frame_index", tone(0.3, 400).alias("r"), tone(0.3, 300).alias("g"), tone(0.28, 900).alias("b"), alpha.alias("alpha")))
    return m.select("video_id", "frame_index", *(F.col(x) if x == "coverage_source" else F.round(x, 4 if x in ("mean", "std", "low", "high") else 6).alias(x) for x in m.columns[2:]))


@query(f"select video_id, frame_index, round(least(greatest(118 / greatest(quantile_cont(x, 0.75), 1e-3), 0.4), 2.5), 5) as gain from (select video_id, frame_index, (v + 0.3) * 400 as x from {PIXELS} where sqrt((row - 3.5)^2 + (col - 3.5)^2) <= 0.485 * 8) group by 1, 2")
def a26_exposure_gain(t):
    p = pixels(t).where(c.in_aperture(F.col("row"), F.col("col"), 8, 8)).withColumn("v", (F.col("v") + 0.3) * 400)
    return frames.exposure_gain(p).select("video_id", "frame_index", F.round("gain", 5).alias("gain"))


@query("with f as (select *, 1 - l_discount - l_tax as a, l_discount as b, l_tax - case when l_linenumber = 7 then 0.01::double else 0 end as c from lineitem) select l_orderkey, l_linenumber, least(a, b, c) > 0 and abs(a + b + c - 1) <= 1e-6 and l_orderkey % 5 > 0 as ok from f")
def f14_split_rules(t):
    short = F.when(F.col("l_linenumber") == 7, 0.01).otherwise(0.0)
    train = 1 - F.col("l_discount") - F.col("l_tax")
    ok = audit.fractions_ok(train, F.col("l_discount"), F.col("l_tax") - short, F.when(F.col("l_orderkey") % 5 > 0, "split-1").otherwise("  "))
    return t("lineitem").select("l_orderkey", "l_linenumber", ok.alias("ok"))


@query("select p_partkey, case when p_partkey % 3 < 2 then p_size end as width, case when p_partkey % 3 < 2 then p_partkey % 5000 end as height from part")
def p9_image_sizes(t):
    four = lambda c, n: F.lpad(F.hex(c), n, "0")
    w, h = F.col("p_size").cast("long"), F.col("p_partkey") % 5000
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(w, 8), four(h, 8), F.lit("0806000000"))
    jpeg = F.concat(F.lit("FFD8FFE000046162FFC0001108"), four(h, 4), four(w, 4), F.lit("03" + "00" * 12))
    body = F.unhex(F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, jpeg).otherwise(F.lit("FFD8FF")))
    sizes = files.image_sizes(t("part").select(F.col("p_partkey").alias("path"), body.alias("content")))
    return sizes.select(F.col("path").alias("p_partkey"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
