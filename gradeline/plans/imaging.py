"""Registered queries on rasters, parameter banks and quality roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bank, raster
from ..sources import files, tables
from .registry import off_tie, query, rounded


@query("widest_gap", """select * from (
with c as (select image_id, x, avg(v) as m from raster group by 1, 2), l as (select image_id, avg(m) * 0.4e0 as cut from c group by 1),
d as (select c.image_id, x, x - row_number() over (partition by c.image_id order by x) as isl from c join l using (image_id) where m < cut),
s as (select image_id, min(x) as a, max(x) + 1 as b from d group by image_id, isl), r as (select *, row_number() over (partition by image_id order by b - a desc, a) as k from s)
select image_id, a as gap_left, b as gap_right, b - a as gap_width, a - cast(floor((b - a) * 0.5) as int) as left_end, b + cast(floor((b - a) * 0.5) as int) as right_start from r where k = 1)""")
def _(spark, folder):
    return raster.widest_gap(tables.raster(spark, folder), "image_id", "x", "v")


_TILES = """
tl as (select image_id, tx, ty, count(*) as n, avg(v) as mean, stddev_pop(v) as std
       from strip, (select unnest(range(0, 4)) as tx), (select unnest(range(0, 4)) as ty)
       where x >= tx * 8 and x < tx * 8 + 10 and y >= ty * 8 and y < ty * 8 + 10 group by 1, 2, 3)"""


@query("tile_stats", f"""select * from (with {_TILES.strip()}
select image_id, tx, ty, n, round(mean, 9) as mean, round(std, 7) as std, mean >= 20 and std >= 5 as keep from tl)""")
def _(spark, folder):
    out = raster.tile_stats(tables.strip(spark, folder), "image_id", "x", "y", "v", 10, 8)
    return rounded(rounded(out, "mean"), "std", digits=7)


@query("block_pool_summary", f"""select * from (with {_TILES.strip()}, k as (select * from tl where mean >= 20 and std >= 5)
select count(*) as n_blocks, round(avg(mean), 7) as mean_mean, round(stddev_pop(mean), 7) as mean_std, round(min(mean), 7) as mean_min, round(max(mean), 7) as mean_max,
       round(quantile_cont(mean, 0.05), 7) as mean_p5, round(quantile_cont(mean, 0.5), 7) as mean_p50, round(quantile_cont(mean, 0.95), 7) as mean_p95,
       round(avg(std), 7) as std_mean, round(stddev_pop(std), 7) as std_std, round(min(std), 7) as std_min, round(max(std), 7) as std_max,
       round(quantile_cont(std, 0.05), 7) as std_p5, round(quantile_cont(std, 0.5), 7) as std_p50, round(quantile_cont(std, 0.95), 7) as std_p95 from k)""")
def _(spark, folder):
    out = raster.block_pool_summary(raster.tile_stats(tables.strip(spark, folder), "image_id", "x", "y", "v", 10, 8))
    return rounded(out, *[c for c in out.columns if c != "n_blocks"], digits=7)


@query("image_qc", """
select image_id, round(avg(v), 9) as mean, round(stddev_pop(v), 9) as std, round(avg(case when v = 0 then 1e0 else 0e0 end), 9) as clip0_frac,
       round(avg(case when v = 255 then 1e0 else 0e0 end), 9) as clip255_frac, count(*) as n_px from strip group by 1""")
def _(spark, folder):
    return rounded(raster.image_qc(tables.strip(spark, folder), "image_id", "v"), "mean", "std", "clip0_frac", "clip255_frac")


@query("otsu_by_group", """select * from (
with h as (select image_id, v as level, count(*) as n from strip group by 1, 2),
c as (select *, cast(sum(n) over w as double) as w, cast(sum(n * level) over w as double) as m, cast(sum(n) over (partition by image_id) as double) as tw,
             cast(sum(n * level) over (partition by image_id) as double) as tm from h window w as (partition by image_id order by level rows between unbounded preceding and current row)),
b as (select *, case when w < tw then power(tm * w / tw - m, 2) / (w * (tw - w)) else 0e0 end as sb from c),
t as (select image_id, level as threshold from (select *, row_number() over (partition by image_id order by sb desc, level) as k from b) where k = 1)
select image_id, count(*) as n_px, cast(max(threshold) as double) as threshold, sum(case when v >= threshold then 1 else 0 end)::bigint as n_bright,
       cast(quantile_cont(v, 0.5) as double) as median, cast(quantile_cont(case when v >= threshold then v end, 0.5) as double) as bright_median,
       cast(quantile_cont(case when v >= threshold then v end, 0.5) - quantile_cont(v, 0.5) as double) as contrast from strip join t using (image_id) group by 1)""")
def _(spark, folder):
    return raster.otsu_by_group(tables.strip(spark, folder), ["image_id"], "v")


# the same likelihood equation solved by bisection on the grey histogram
@query("weibull_fit_by_group", """select * from (
with recursive h as (select l_suppkey as image_id, floor(l_quantity) as v, cast(count(*) as double) as n from lineitem group by 1, 2),
g as (select image_id, list(ln(v) order by v) as lx, list(n order by v) as ns, cast(sum(n) as bigint) as n_px, sum(n * ln(v)) / sum(n) as ml, sum(n) as total from h group by 1),
b as (select image_id, 0.01e0 as lo, 60e0 as hi, 0 as k from g where n_px >= 50
      union all select b.image_id, case when f < 0 then mid else lo end, case when f < 0 then hi else mid end, k + 1 from (
        select b.*, (lo + hi) / 2 as mid, list_sum(list_transform(range(1, len(lx) + 1), lambda i: ns[i] * exp((lo + hi) / 2 * lx[i]) * lx[i]))
               / list_sum(list_transform(range(1, len(lx) + 1), lambda i: ns[i] * exp((lo + hi) / 2 * lx[i]))) - 2 / (lo + hi) - ml as f
        from b join g using (image_id)) b where k < 70),
c as (select image_id, (lo + hi) / 2 as c from b where k = 70)
select g.image_id, round(c, 6) as c, case when c is not null then 0e0 end as loc,
       round(power(list_sum(list_transform(range(1, len(lx) + 1), lambda i: ns[i] * exp(c * lx[i]))) / total, 1 / c), 6) as scale, n_px from g left join c using (image_id))""")
def _(spark, folder):
    pixels = tables.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_quantity").alias("v"))
    return rounded(raster.weibull_fit_by_group(pixels, ["image_id"], "v"), "c", "scale", digits=6)


@query("weibull_rank_map", """select * from (
with r as (select image_id, l_id, v, row_number() over (partition by image_id order by v, l_id) as k, count(*) over (partition by image_id) as n from
  (select l_suppkey % 10 as image_id, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 7 as l_id, min(l_quantity) as v from lineitem group by 1, 2)),
g as (select *, 3e0 + 40e0 * power(-ln(1e0 - (k - 0.5e0) / n), 1 / 1.8e0) as g from r), m as (select image_id, avg(g) as mm, stddev_pop(g) as ss from g group by 1)
select image_id, l_id, least(greatest(round((g - mm) / ss * 30 + 120), 0e0), 255e0) as grey from g join m using (image_id))""")
def _(spark, folder):
    items = tables.table(spark, folder, "lineitem")
    pid = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 7
    rows = items.groupBy((F.col("l_suppkey") % 10).alias("image_id"), pid.alias("l_id")).agg(F.min("l_quantity").alias("v"))
    out = raster.weibull_rank_map(rows, ["image_id"], "v", "l_id", 1.8, 3.0, 40.0, 120.0, 30.0, 0.0, 64.0)
    return out.select("image_id", "l_id", "grey")


@query("affine_match", """
select image_id, x, y, count(*) as n, round(sum(m), 7) as total from (
  select image_id, x, y, (v - avg(v) over (partition by image_id)) / stddev_pop(v) over (partition by image_id) * 25e0 + 110e0 as m from strip) group by 1, 2, 3""")
def _(spark, folder):
    out = raster.affine_match(tables.strip(spark, folder), ["image_id"], "v", 110.0, 25.0)
    return rounded(out.groupBy("image_id", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total", digits=7)


@query("lowlevel_features", """select * from (
with n as (select image_id, count(*) as n from strip group by 1),
h as (select s.image_id, v // 8 as k, count(*) / max(n.n) as f from strip s join n using (image_id) group by 1, 2),
t as (select image_id, 32 + (y * 8 // 40) * 8 + x * 8 // 40 as k, avg(v) / 255e0 as f from strip group by 1, 2),
g as (select image_id, k from n, (select unnest(range(0, 96)) as k))
select image_id, g.k as pos, round(coalesce(h.f, t.f, 0e0), 9) as f from g left join h using (image_id, k) left join t using (image_id, k))""")
def _(spark, folder):
    out = raster.lowlevel_features(tables.strip(spark, folder), "image_id", "x", "y", "v", 40)
    return rounded(out.select("image_id", F.posexplode("features").alias("pos", "f")), "f").withColumn("pos", F.col("pos").cast("bigint"))


def _mixture(key: str) -> str:
    """Recursive SQL: three weighted components on the grey histogram `h` of every `key`."""
    logp = lambda k: f"(ln(w{k}) - 0.5e0 * ln(2 * pi() * s{k}) - 0.5e0 * power(level - m{k}, 2) / s{k})"
    share = ", ".join(f"sum(r{k}) as n{k}, sum(r{k} * level) / sum(r{k}) as c{k}" for k in "123")
    return f"""
c as (select *, sum(n) over (partition by {key} order by level) as upto, sum(n) over (partition by {key}) as total,
             sum(n * level) over (partition by {key}) / sum(n) over (partition by {key}) as centre from h),
i as (select {key}, 0 as it, 0 as over, -1e300 as ll, 1 / 3e0 as w1, 1 / 3e0 as w2, 1 / 3e0 as w3,
             cast(min(level) filter (where upto >= total / 6e0) as double) as m1, cast(min(level) filter (where upto >= total / 2e0) as double) as m2,
             cast(min(level) filter (where upto >= total * 5 / 6e0) as double) as m3, sum(n * power(level - centre, 2)) / max(total) + 1e-6 as s1,
             sum(n * power(level - centre, 2)) / max(total) + 1e-6 as s2, sum(n * power(level - centre, 2)) / max(total) + 1e-6 as s3 from c group by {key}),
em as (
  select * from i
  union all
  select {key}, it + 1, case when abs(now - ll) < 1e-3 then 1 else 0 end, now, n1 / total, n2 / total, n3 / total, c1, c2, c3, v1, v2, v3
  from (
    select {key}, any_value(it) as it, any_value(ll) as ll, any_value(total) as total, sum(n * whole) / any_value(total) as now, any_value(n1) as n1, any_value(n2) as n2, any_value(n3) as n3,
           any_value(c1) as c1, any_value(c2) as c2, any_value(c3) as c3, {", ".join(f"sum(r{k} * power(level - c{k}, 2)) / any_value(n{k}) + 1e-6 as v{k}" for k in "123")}
    from (
      select *, {", ".join(f"sum(r{k}) over (partition by {key}) as n{k}, sum(r{k} * level) over (partition by {key}) / sum(r{k}) over (partition by {key}) as c{k}" for k in "123")}
      from (select *, n * exp(p1 - whole) as r1, n * exp(p2 - whole) as r2, n * exp(p3 - whole) as r3
            from (select *, greatest(p1, p2, p3) + ln(exp(p1 - greatest(p1, p2, p3)) + exp(p2 - greatest(p1, p2, p3)) + exp(p3 - greatest(p1, p2, p3))) as whole
                  from (select c.*, it, ll, {", ".join(f"{logp(k)} as p{k}" for k in "123")} from em join c using ({key}) where over = 0 and it < 100))))
    group by {key})),
f as (select {key}, unnest([struct_pack(m := m1, w := w1, s := s1), struct_pack(m := m2, w := w2, s := s2), struct_pack(m := m3, w := w3, s := s3)]) as g
      from (select *, row_number() over (partition by {key} order by it desc) as rk from em) where rk = 1),
o as (select {key}, g.m as m, g.w as w, g.s as s, row_number() over (partition by {key} order by g.m) - 1 as label from f),
l as (select {key}, level, arg_max(label, ln(w) - 0.5e0 * ln(s) - 0.5e0 * power(level - m, 2) / s) as label from o join h using ({key}) group by 1, 2)"""


@query("gmm_segment", f"""select * from (
with recursive h as (select 0 as image, cast(v as integer) as level, count(*) as n from strip group by 1, 2),
{_mixture("image").strip()}
select cast(label as integer) as label, cast(sum(n) as bigint) as n, round(sum(n * level) / sum(n) + 3.7e-12, 9) as mean from l join h using (image, level) group by 1)""")
def _(spark, folder):
    out = raster.gmm_segment(tables.strip(spark, folder).select("image_id", "v"), "v")
    return off_tie(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), "mean")


@query("gmm_segment_by_image", f"""select * from (
with recursive h as (select image_id as image, cast(v as integer) as level, count(*) as n from strip group by 1, 2),
{_mixture("image").strip()}
select image as image_id, level, cast(label as integer) as label, n from l join h using (image, level))""")
def _(spark, folder):
    out = raster.gmm_segment(tables.strip(spark, folder).select("image_id", "v"), "v", keys=["image_id"])
    return out.groupBy("image_id", F.col("v").cast("int").alias("level"), "label").agg(F.count(F.lit(1)).alias("n"))


# --- banks ----------------------------------------------------------------------------------------------


_REASONS = """
rs as (select entry_id, concat_ws(',', case when hl_c is null then 'hl_fit_failed' end, case when hl_c > 10 then 'hl_shape' end,
   case when hl_c is not null and abs(hl_loc) > 500 then 'hl_location' end, case when hl_c is not null and hl_scale > 500 then 'hl_scale' end, case when hl_psd_size = 0 then 'hl_psd_failed' end,
   case when sh_c > 50 then 'sh_shape' end, case when abs(sh_loc) > 3000 then 'sh_location' end, case when sh_scale > 3000 then 'sh_scale' end, case when sh_psd_size = 0 then 'sh_psd_failed' end) as reasons from bank)"""


@query("filter_bank", f"select * from (with {_REASONS.strip()} select entry_id, reasons, reasons = '' as keep from rs)")
def _(spark, folder):
    return bank.filter_bank(tables.bank(spark, folder)).select("entry_id", F.array_join("reasons", ",").alias("reasons"), "keep")


@query("persist_bank", f"""select * from (with {_REASONS.strip()}
select row_number() over (order by entry_id) - 1 as index, entry_id, hl_loc, sh_c from rs join bank using (entry_id) where reasons = '')""")
def _(spark, folder):
    from ..session import scratch_path
    from ..sources.writers import persist_bank

    path = scratch_path(spark, "bank")
    kept = bank.filter_bank(tables.bank(spark, folder)).where("keep").drop("keep", "reasons")
    persist_bank(kept, "entry_id", path)
    return spark.read.parquet(path).select("index", "entry_id", "hl_loc", "sh_c")


@query("fit_rollup", """select * from (
with a as (select count(*) as n, count(hl_c) as h, sum(case when hl_psd_size > 0 then 1 else 0 end)::bigint as hp, sum(case when hl_c is not null and (hl_c <= 0 or hl_scale <= 0) then 1 else 0 end)::bigint as hn,
   count(sh_c) as s, sum(case when sh_psd_size > 0 then 1 else 0 end)::bigint as sp, sum(case when sh_c <= 0 or sh_scale <= 0 then 1 else 0 end)::bigint as sn from bank)
select 'hl_fit' as check, case when h = n then 'PASS' else 'WARN' end as status, h as value from a union all select 'hl_psd', case when hp > 0.8 * n then 'PASS' else 'WARN' end, hp from a
union all select 'hl_positive', case when hn = 0 then 'PASS' else 'FAIL' end, hn from a union all select 'sh_fit', case when s = n then 'PASS' else 'WARN' end, s from a
union all select 'sh_psd', case when sp > 0.8 * n then 'PASS' else 'WARN' end, sp from a union all select 'sh_positive', case when sn = 0 then 'PASS' else 'FAIL' end, sn from a)""".replace(" as check", ' as "check"'))
def _(spark, folder):
    return bank.fit_rollup(tables.bank(spark, folder))


@query("select_frames", """
select frame_id, strict_clear, site, grp, frame_id % 9 = 4 as disputed from frames where strict_clear = 1 and site <> 'Brand#2'""")
def _(spark, folder):
    return bank.select_frames(tables.frames(spark, folder), "strict_clear", "site", "Brand#2", F.col("frame_id") % 9 == 4)


@query("frame_funnel", """
select count(*) as total_rows, sum(case when strict_clear = 1 then 1 else 0 end)::bigint as flagged, sum(case when strict_clear = 1 and site = 'Brand#2' then 1 else 0 end)::bigint as excluded,
       sum(case when strict_clear = 1 and site <> 'Brand#2' then 1 else 0 end)::bigint as selected, sum(case when strict_clear = 1 and site <> 'Brand#2' and frame_id % 9 = 4 then 1 else 0 end)::bigint as disputed_kept,
       count(distinct case when strict_clear = 1 and site <> 'Brand#2' then site end) as n_sites from frames""")
def _(spark, folder):
    return bank.frame_funnel(tables.frames(spark, folder), "strict_clear", "site", "Brand#2", F.col("frame_id") % 9 == 4)


@query("quality_gate", "select entry_id, hl_scale >= 200 and hl_loc >= 20 as quality_ok from bank")
def _(spark, folder):
    gated = bank.quality_gate(tables.bank(spark, folder), "hl_scale", "hl_loc")
    return gated.select("entry_id", "quality_ok")


@query("stratum_counts", "select site || '_' || grp as stratum, count(*) as n from frames where strict_clear = 1 group by 1")
def _(spark, folder):
    return bank.stratum_counts(tables.frames(spark, folder), "site", "grp", usable=F.col("strict_clear") == 1)


@query("qc_rollup", """select * from (
with i as (select l_orderkey, avg(l_quantity) as m, stddev_pop(l_quantity) as s, avg(l_discount) as c0, avg(l_tax) as c1, max(l_quantity) as hi, min(l_quantity) as lo, count(*) - 1 as redrawn from lineitem group by 1),
a as (select cast(count(*) as double) as n, stddev_pop(m) as ms, stddev_pop(s) as ss, max(c0) as c0, max(c1) as c1, cast(sum(case when hi > m and m > lo then 1 else 0 end) as double) as o,
             cast(sum(case when redrawn > 0 then 1 else 0 end) as double) as r from i)
select 'generated' as chk, case when n = (select count(*) from orders) then 'PASS' else 'WARN' end as status, n as value from a union all select 'mean_spread', 'INFO', round(ms, 9) from a union all select 'std_spread', 'INFO', round(ss, 9) from a
union all select 'clip0_max', case when c0 < 0.05 then 'PASS' else 'WARN' end, round(c0, 9) from a union all select 'clip255_max', case when c1 < 0.05 then 'PASS' else 'WARN' end, round(c1, 9) from a
union all select 'brightness_order', case when o = n then 'PASS' else 'WARN' end, o from a union all select 'redrawn', 'INFO', r from a)""")
def _(spark, folder):
    q = F.col("l_quantity")
    items = tables.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.avg(q).alias("m"), F.stddev_pop(q).alias("s"), F.avg("l_discount").alias("c0"), F.avg("l_tax").alias("c1"),
        F.max(q).alias("hi"), F.min(q).alias("lo"), (F.count(F.lit(1)) - 1).alias("redrawn"),
    )
    out = bank.qc_rollup(items, tables.table(spark, folder, "orders").count(), "m", "s", "c0", "c1", "hi", "m", "lo", "redrawn")
    return rounded(out.withColumnRenamed("check", "chk"), "value")




def _image_table(spark, folder):
    """Rows shaped like the `image` source: one 40x40 grey image per id, every third one unreadable."""
    pixels = tables.strip(spark, folder).groupBy("image_id", "x", "y").agg(F.max("v").alias("v"))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(1599)), lambda i: F.lpad(F.hex(F.coalesce(F.element_at("_grid", i), F.lit(0))), 2, "0")
    )
    # at most 1600 cells per image
    packed = pixels.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("y") * 40 + F.col("x"), "v"))).alias("_grid")
    )
    ok = F.col("image_id") % 3 != 0
    size = F.when(ok, 40).otherwise(-1)
    return packed.select("image_id", F.struct(
        F.col("image_id").cast("string").alias("origin"), size.alias("height"), size.alias("width"),
        F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.when(ok, F.unhex(F.array_join(cells, ""))).alias("data"),
    ).alias("image"))


@query("image_area", """
select cast(image_id as varchar) as origin, case when image_id % 3 <> 0 then 40 end as width, case when image_id % 3 <> 0 then 40 end as height,
       case when image_id % 3 <> 0 then 1600e0 end as area, case when image_id % 3 = 0 then 'unreadable' end as error from (select distinct image_id from strip)""")
def _(spark, folder):
    return files.image_area(_image_table(spark, folder))


@query("explode_images", """select * from (
with p as (select image_id, x, y, max(v) as v from strip group by 1, 2, 3),
g as (select image_id, gx as x, gy as y from (select distinct image_id from strip where image_id % 3 <> 0), (select cast(unnest(range(0, 40)) as int) as gx), (select cast(unnest(range(0, 40)) as int) as gy))
select image_id, x, y, coalesce(v, 0) as v from g left join p using (image_id, x, y))""")
def _(spark, folder):
    return raster.explode_images(_image_table(spark, folder), ["image_id"]).drop("origin")


@query("mask_rollup", """select * from (
with m as (select case when p_partkey % 3 = 0 then 'ship' else 'airplane' end as label, p_size * 4 as w, p_partkey % 90 + 20 as h, case when p_partkey % 7 <> 0 then substr(p_type, 1, 5) end as damage from part),
a as (select count(*) as n, count(*) filter (where label = 'airplane') as planes, count(*) filter (where label = 'ship') as ships, min(w) as w0, max(w) as w1, min(h) as h0, max(h) as h1 from m)
select 'masks' as chk, 'INFO' as status, cast(n as double) as value from a
union all select 'count_airplane', case when planes >= 0.9e0 * 120 then 'PASS' else 'WARN' end, planes from a union all select 'count_ship', case when ships >= 0.9e0 * 100000000 then 'PASS' else 'WARN' end, ships from a
union all select 'width_min', 'INFO', w0 from a union all select 'width_max', 'INFO', w1 from a union all select 'height_min', 'INFO', h0 from a union all select 'height_max', 'INFO', h1 from a
union all select 'max_side', case when greatest(w1, h1) <= 150 then 'PASS' else 'FAIL' end, greatest(w1, h1) from a union all select 'verdict', case when greatest(w1, h1) <= 150 then 'PASS' else 'FAIL' end, case when greatest(w1, h1) <= 150 then 0 else 1 end from a
union all select 'damage_' || coalesce(damage, 'none'), 'INFO', count(*) from m group by damage)""")
def _(spark, folder):
    key = F.col("p_partkey")
    masks = tables.table(spark, folder, "part").select(
        F.when(key % 3 == 0, "ship").otherwise("airplane").alias("label"), (F.col("p_size") * 4).alias("w"), (key % 90 + 20).alias("h"),
        F.when(key % 7 != 0, F.substring("p_type", 1, 5)).alias("damage"))
    out = bank.mask_rollup(masks, "label", {"airplane": 120, "ship": 100_000_000}, "w", "h", "damage", 150)
    return out.withColumnRenamed("check", "chk")


@query("site_rollup", """select * from (
with u as (select p_brand as site, count(*) as n from bank join part on p_partkey = entry_id where hl_c is not null and hl_psd_size > 0 group by 1)
select 'usable_entries' as chk, 'INFO' as status, cast(sum(n) as double) as value from u union all select 'effective_sites', 'INFO', count(*) from u
union all select 'site_' || site, 'INFO', n from u)""")
def _(spark, folder):
    sites = tables.frames(spark, folder).select(F.col("frame_id").alias("entry_id"), "site")
    return bank.site_rollup(tables.bank(spark, folder).join(sites, "entry_id"), "site").withColumnRenamed("check", "chk")
