"""Registered queries on folds, samples, draws and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from ..operators import splits
from ..sources import tables
from .registry import query, rounded

_FOLDS = """
r as (select lang as domain, case when n_chars % 8 = 0 then 'airplane' else 'ship' end as label, doc_id,
             row_number() over (partition by lang, case when n_chars % 8 = 0 then 'airplane' else 'ship' end order by md5('42|' || doc_id), doc_id) as rn from documents),
s as (select domain, label, count(*) as n from r group by 1, 2),
o as (select domain, label, coalesce(sum(n) over (partition by domain order by label rows between unbounded preceding and 1 preceding), 0) as off from s),
kf as (select r.domain, r.label, r.doc_id, cast((rn - 1 + off) % 5 as int) as fold from r join o using (domain, label)),
sp as (select domain, label, doc_id, f as fold, case when f = fold then 'test' else 'train' end as split from kf, (select unnest([0, 1, 2, 3, 4]) as f))"""


def folds(spark, folder):
    label = F.when(F.col("n_chars") % 8 == 0, "airplane").otherwise("ship")
    docs = tables.table(spark, folder, "documents").select(F.col("lang").alias("domain"), label.alias("label"), "doc_id")
    return splits.stratified_kfold(docs, ["domain"], "label", "doc_id", 5, 42)


def split_table(spark, folder):
    return splits.expand_folds(folds(spark, folder), 5)


@query("stratified_kfold", f"select * from (with {_FOLDS.strip()} select domain, label, doc_id, fold from kf)")
def _(spark, folder):
    return folds(spark, folder).select("domain", "label", "doc_id", "fold")


@query("split_manifest", f"""select * from (with {_FOLDS.strip()}
select domain, fold, split, sum(case when label = 'airplane' then 1 else 0 end)::bigint as n_airplane, sum(case when label = 'ship' then 1 else 0 end)::bigint as n_ship, count(*) as total
from sp group by rollup (domain, fold, split))""")
def _(spark, folder):
    return splits.split_manifest(split_table(spark, folder), "label", ["airplane", "ship"])


@query("leak_check", """
select doc_id % 5 as fold, doc_id, 2 as n_splits from documents where n_chars % 50 = 3""")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 5).alias("fold"))
    test = docs.withColumn("split", F.lit("test"))
    leaked = docs.where("n_chars % 50 = 3").withColumn("split", F.lit("train"))
    return splits.leak_check(test.unionByName(leaked), ["fold"], "doc_id")


@query("fold_coverage_check", f"""select * from (with {_FOLDS.strip()},
b as (select * from sp where not (doc_id % 53 = 1 and split = 'test') and not (doc_id % 59 = 2 and fold = 0 and split = 'train')),
g as (select domain, doc_id, sum(case when split = 'test' then 1 else 0 end)::bigint as n_test, count(*) as n_rows, count(distinct fold) as n_folds from b group by 1, 2)
select domain, doc_id, n_test, n_rows, n_folds, case when n_test <> 1 then 'not_tested_once' else 'not_in_every_fold' end as rule from g where n_test <> 1 or n_rows <> 5 or n_folds <> 5)""")
def _(spark, folder):
    broken = split_table(spark, folder).where("not (doc_id % 53 = 1 and split = 'test') and not (doc_id % 59 = 2 and fold = 0 and split = 'train')")
    return splits.fold_coverage_check(broken, ["domain"], "doc_id", 5)


@query("canonicalize", "select distinct url from pages")
def _(spark, folder):
    pages = tables.table(spark, folder, "pages")
    return splits.canonicalize(pages.select("url").unionByName(pages.select("url")), "url")


@query("fixed_sample", "select doc_id, md5('9|' || doc_id) as draw_hash from documents order by draw_hash, doc_id limit 100")
def _(spark, folder):
    return splits.fixed_sample(tables.table(spark, folder, "documents").select("doc_id"), "doc_id", 100, 9)


@query("per_class_sample", """
select doc_id, lang, md5('6|' || doc_id) as order_hash from (select doc_id, lang, row_number() over (partition by lang order by md5('5|' || doc_id), doc_id) as rn from documents)
where rn <= case lang when 'en' then 20 when 'fr' then 10 else 0 end""")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "lang")
    return splits.per_class_sample(docs, "lang", "doc_id", {"en": 20, "fr": 10}, 5).drop("rn")


@query("per_class_head", "select doc_id, lang from (select *, row_number() over (partition by lang order by doc_id) as rn from documents) where rn <= 7")
def _(spark, folder):
    return splits.per_class_head(tables.table(spark, folder, "documents").select("doc_id", "lang"), "lang", "doc_id", 7)


@query("truncate", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 50")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "n_chars").withColumn("k", -F.col("n_chars"))
    return splits.truncate(docs, ["k", "doc_id"], 50).drop("k")


@query("round_robin_assign", """
select o.o_orderkey, b.entry_id, b.hl_c from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) o
join (select entry_id, hl_c, row_number() over (order by entry_id) - 1 as s from bank) b on o.i % (select count(*) from part) = b.s""")
def _(spark, folder):
    rows = tables.table(spark, folder, "orders").select("o_orderkey")
    entries = tables.bank(spark, folder).select("entry_id", "hl_c")
    return splits.round_robin_assign(rows, "o_orderkey", entries, "entry_id")


@query("band_filter_pool", """
select p_partkey, p_retailprice, round(greatest(q5, 950e0), 6) as lo, round(q95, 6) as p95 from part,
  (select quantile_cont(p_retailprice, 0.05) as q5, quantile_cont(p_retailprice, 0.95) as q95 from part) where p_retailprice between greatest(q5, 950e0) and q95""")
def _(spark, folder):
    pool = tables.table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return rounded(splits.band_filter_pool(pool, "p_retailprice", "p5", 950.0), "lo", "p95", digits=6)


@query("draw_pairs", """
select o_orderkey, p.p_partkey, p.p_retailprice as mu, p.p_size as sigma from
  (select o_orderkey, least(cast(floor(cast('0x' || substr(md5('3|' || o_orderkey), 1, 13) as bigint) / 4503599627370496e0 * (select count(*) from part)) as bigint), (select count(*) from part) - 1) as s from orders) o
join (select *, row_number() over (order by p_partkey) - 1 as s from part) p using (s)""")
def _(spark, folder):
    pool = tables.table(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("mu"), F.col("p_size").alias("sigma"))
    return splits.draw_pairs(tables.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", pool, "p_partkey", 3)


@query("perturb", """
select entry_id, round(hl_c * (0.9e0 + (1.1e0 - 0.9e0) * (cast('0x' || substr(md5('42|' || entry_id || '|hl_c'), 1, 13) as bigint) / 4503599627370496e0)), 9) as hl_c, hl_loc,
       round(hl_scale * (0.9e0 + (1.1e0 - 0.9e0) * (cast('0x' || substr(md5('42|' || entry_id || '|hl_scale'), 1, 13) as bigint) / 4503599627370496e0)), 9) as hl_scale from bank""")
def _(spark, folder):
    entries = tables.bank(spark, folder).select("entry_id", "hl_c", "hl_loc", "hl_scale")
    return rounded(splits.perturb(entries, "entry_id", ["hl_c", "hl_scale"]), "hl_c", "hl_scale")


@query("pick_clean_candidate", """select * from (
with c as (select l_orderkey, l_linenumber as draw, avg(cast(round(l_discount * 100) as int)) / 1e2 as f from lineitem group by 1, 2),
k as (select *, max(draw) over (partition by l_orderkey) as last, row_number() over (partition by l_orderkey order by case when f <= 0.01 then 0 else 1 end, case when f <= 0.01 then 0 else f end, draw) as r from c where draw <= 5)
select l_orderkey, draw, round(f, 9) as fraction, f <= 0.01 as clean, case when f <= 0.01 then draw else last end as redraws from k where r = 1)""")
def _(spark, folder):
    draws = tables.table(spark, folder, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("draw")).agg((F.avg(F.round(F.col("l_discount") * 100).cast("int")) / 1e2).alias("f"))
    return rounded(splits.pick_clean_candidate(draws, ["l_orderkey"], "draw", "f", 0.01, 5), "fraction")


@query("weighted_draw", """
select o_orderkey, case when u < 0.7e0 then 'intact' when u < 0.85e0 then 'break' else 'bury' end as category
from (select o_orderkey, cast('0x' || substr(md5('11|' || o_orderkey), 1, 13) as bigint) / 4503599627370496e0 as u from orders)""")
def _(spark, folder):
    # Mix of damage kinds.
    weights = {"intact": 0.70, "break": 0.15, "bury": 0.15}
    return splits.weighted_draw(tables.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", weights, 11)


@query("share_audit", """
select category, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share, round(case category when 'intact' then 0.7 else 0.15 end, 9)::double as target_share from (
select case when u < 0.7e0 then 'intact' when u < 0.85e0 then 'break' else 'bury' end as category
from (select cast('0x' || substr(md5('11|' || o_orderkey), 1, 13) as bigint) / 4503599627370496e0 as u from orders)) group by 1""")
def _(spark, folder):
    weights = {"intact": 0.70, "break": 0.15, "bury": 0.15}
    drawn = splits.weighted_draw(tables.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", weights, 11)
    return rounded(splits.share_audit(drawn, "category", weights), "share", "target_share")


@query("unimodal_check", """select * from (
with p as (select l_suppkey as profile, cast(l_orderkey % 9 as int) as pos, avg(l_quantity) as v from lineitem group by 1, 2),
k as (select profile, arg_min(pos, (-v, pos)) as peak from (select * from p) group by 1),
d as (select p.profile, pos, peak, v - lag(v) over (partition by p.profile order by pos) as dv from p join k using (profile))
select profile, peak, sum(case when (pos <= peak and dv < -0.02) or (pos > peak and dv > 0.02) then 1 else 0 end)::bigint as violations from d group by 1, 2)""")
def _(spark, folder):
    items = tables.table(spark, folder, "lineitem")
    prof = items.groupBy(F.col("l_suppkey").alias("profile"), (F.col("l_orderkey") % 9).cast("int").alias("pos")).agg(F.avg("l_quantity").alias("v"))
    return splits.unimodal_check(prof, ["profile"], "pos", "v")


@query("representative_sample", """select * from (
with f as (select p_brand, p_type, p_partkey, row_number() over (partition by p_brand, p_type order by p_partkey) as rn from part)
select p_brand, p_type, p_partkey from f order by case when rn = 1 then 0 else 1 end, case when rn = 1 then p_brand end, case when rn = 1 then p_type end, p_partkey limit 300)""")
def _(spark, folder):
    part = tables.table(spark, folder, "part").select("p_brand", "p_type", "p_partkey")
    return splits.representative_sample(part, ["p_brand", "p_type"], "p_partkey", 300)


@query("hash_uniform", """
select o_orderkey, cast('0x' || substr(md5('1|' || o_orderkey), 1, 13) as bigint) / 4503599627370496e0 as u from orders""")
def _(spark, folder):
    return tables.table(spark, folder, "orders").select("o_orderkey", hash_uniform(1, "o_orderkey").alias("u"))


@query("set_operations", """select * from (
with a as (select doc_id, cls, digest from snap_a), b as (select doc_id, cls, digest from snap_b)
select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b)
union all select 'except', count(*) from (select * from a except all select * from b))""")
def _(spark, folder):
    a, b = tables.snapshot_a(spark, folder), tables.snapshot_b(spark, folder)
    n = F.count(F.lit(1)).alias("n")
    parts = [("union", a.unionByName(b).distinct()), ("intersect", a.intersect(b)), ("except", a.exceptAll(b))]
    out = None
    for op, df in parts:
        row = df.agg(n).select(F.lit(op).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


