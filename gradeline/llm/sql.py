"""SQL counterparts of the numbered queries that SQL can express."""

from .near_dedup import SHINGLE, SIMILARITY
from .sharding import BITS

NEAR = f"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end) as grams from t),
n as (select doc_id, len(grams) as n_shingles from s),
g as (select doc_id, unnest(grams) as gram from s),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * c >= {round(100 * SIMILARITY)} * (x.n_shingles + y.n_shingles - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as node, doc_id as found from documents
  union
  select r.node, e.b from reach r join both_ways e on e.a = r.found)
select n.doc_id, cast(n.n_shingles as bigint) as n_shingles, min(found) as component_id, min(found) = n.doc_id as kept
from n join reach r on r.node = n.doc_id group by n.doc_id, n.n_shingles
"""

QUALITY = """
with t as (select doc_id, coalesce(text, '') as x from documents),
w as (
  select doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from t),
windows as (
  select doc_id, unnest(range(1, len(w) - 1)) as i,
    unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as k from w where len(w) >= 3),
counted as (select doc_id, i, count(*) over (partition by doc_id, k) as c from windows),
covered as (
  select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from counted where c > 1) group by doc_id),
stats as (
  select w.doc_id, x, cast(len(w.w) as bigint) as n_words, cast(length(array_to_string(w.w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(x, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
    cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from w left join covered on covered.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words
    or word_chars not between 3 * n_words and 10 * n_words or 2 * n_dup_lines > n_lines
    or len(regexp_extract_all(x, '\\p{Lu}')) > len(regexp_extract_all(x, '\\p{Ll}'))) as kept
from stats
"""

#: Bytes of a shard in `op6_shards`: small enough that the given tables need several depths.
SHARD_BYTES = 256 << 10

SHARDS = f"""
with t as (
  select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as h from documents),
levels as (select doc_id, n_bytes, h, d, h >> ({BITS} - d) as prefix from t, (select unnest(range(0, {BITS + 1})) as d)),
sums as (
  select doc_id, n_bytes, d, prefix, sum(n_bytes) over (partition by d, prefix) as held,
    min(h) over (partition by d, prefix) as low, max(h) over (partition by d, prefix) as high from levels),
placed as (
  select doc_id, any_value(n_bytes) as n_bytes, min(d) as depth, arg_min(prefix, d) as prefix
  from sums where held <= {SHARD_BYTES} or low = high group by doc_id)
select doc_id, n_bytes, case when depth = 0 then '' else lpad(bin(prefix), cast(depth as integer), '0') end as shard, cast(depth as integer) as depth
from placed
"""

COPIES = """
with t as (
  select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm from documents),
g as (
  select doc_id, norm, count(*) over (partition by norm) as group_size,
    first_value(doc_id) over (partition by norm order by size desc, doc_id) as keep_id from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""

FILTERS = """
with t as (select doc_id, coalesce(text, '') as x, coalesce(lang, '') as part from documents),
w as (select *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') as w, coalesce(min(doc_id) over (partition by x) < doc_id, false) as copied from t),
f as (
  select doc_id, part, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * len(regexp_extract_all(x, '[A-Z]')) > 3 * length(x) then 4 else 0 end
    + case when regexp_matches(x, '[#$%&*|]') then 8 else 0 end + case when copied then 16 else 0 end as f from w),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
cells as (
  select part, f, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from f left join l on l.doc_id = f.doc_id group by part, f),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, unnest(range(1, 6)) as step from orders),
bits as (
  select filter_order, cast(step as integer) as step, substr(filter_order, step, 1) as x, cast(1 << (ascii(substr(filter_order, step, 1)) - 65) as bigint) as b,
    cast(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))) as bigint) as before from steps),
sums as (
  select part, filter_order, step, x,
    sum(n) filter (where f & (coalesce(before, 0) | b) = 0) as kept,
    sum(n) filter (where f & coalesce(before, 0) = 0 and f & b != 0) as removed,
    sum(n) filter (where f & coalesce(before, 0) != 0 and f & b != 0) as redundant,
    sum(n) filter (where f = b) as unique_fails,
    sum(good) filter (where f & coalesce(before, 0) = 0 and f & b != 0) as good_lost,
    sum(toxic) filter (where f & coalesce(before, 0) = 0 and f & b != 0) as toxic_lost
  from cells, bits group by part, filter_order, step, x)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
  cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(sum(coalesce(removed, 0)) over (partition by part, x) as bigint) as shapley
from sums
"""

TRIE = """
with t as (
  select conv_id as c, turn, strlen(coalesce(text, '')) as b,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as g
  from conversations where conv_id is not null),
own as (select c, list(g order by turn nulls first, g) as g, list(b order by turn nulls first, g) as b from t group by c),
h as (
  select *, xor(list_reduce(range(0, 8 * length(cast(c as varchar))), lambda s, k:
    xor((case when k % 8 = 0 then xor(s, ascii(substr(cast(c as varchar), cast(k // 8 + 1 as bigint), 1))) else s end) >> 1,
      3988292384 * ((case when k % 8 = 0 then xor(s, ascii(substr(cast(c as varchar), cast(k // 8 + 1 as bigint), 1))) else s end) & 1)),
    cast(4294967295 as bigint)), 4294967295) % 9 as h from own),
runs as (
  select h.c, list_concat(coalesce(x.g, [])[1:h.h], h.g[h.h + 1:]) as g, list_concat(coalesce(x.b, [])[1:h.h], h.b[h.h + 1:]) as b
  from h left join own x on x.c = h.c - h.c % 5),
places as (select c, unnest(range(0, len(g) + 1)) as d, g, b from runs),
nodes as (
  select array_to_string(g[1:d], '') as k, d, min(c) as conv_id, count(*) as n, max(coalesce(b[d], 0)) as bytes,
    string_agg(cast(c as varchar), ',' order by c) filter (where len(g) = d) as ends from places group by k, d),
children as (select k[1:32 * (d - 1)] as k, d - 1 as d, count(*) as n from nodes where d > 0 group by 1, 2),
full_nodes as (select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c on c.k = n.k and c.d = n.d),
up as (select k, n, bytes, n_children, d, unnest(range(0, d + 1)) as a from full_nodes),
sums as (
  select k[1:32 * a] as k, a as d, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(case when d > 0 then (n - 1) * bytes else 0 end) as saved
  from up group by 1, 2)
select n.conv_id, cast(n.d as bigint) as depth, p.conv_id as parent_conv_id, n.n as n_convs, n.n_children, cast(s.n_leaves as bigint) as n_leaves,
  cast(s.saved as bigint) as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from full_nodes n join sums s on s.k = n.k and s.d = n.d
left join nodes p on n.d > 0 and p.d = n.d - 1 and p.k = n.k[1:32 * (n.d - 1)]
"""

ORACLES: dict[str, str] = {
    "op2_near_copies": NEAR,
    "op5_quality_rules": QUALITY,
    "op6_shards": SHARDS,
    "op9_exact_copies": COPIES,
    "op11_filter_audit": FILTERS,
    "op12_prefix_trie": TRIE,
}
