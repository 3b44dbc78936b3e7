"""The whole chain as a query. Its links lie apart on their contigs, one on each, so that SQL can find the cheapest flow by trying all counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chain
from . import views as v
from .catalogue import query

_FROM, _TO = "n div 4 + 1", "n * 3 div 4"
_LETTERS, _BASES = "bdefhijklmnopqrsuvwxyz", "acgtacgtacgtacgtacgtan"


def contigs(s, sf) -> DataFrame:
    """(chr, seq, n, k): texts as sequences; z is the unknown letter."""
    d = v.table(s, sf, "documents").where("length(text) >= 400")
    return d.select(F.concat(F.lit("c"), "doc_id").alias("chr"), F.translate(F.lower("text"), _LETTERS, _BASES).alias("seq"), F.length("text").cast("bigint").alias("n"), F.col("doc_id").alias("k"))


def links(s, sf) -> DataFrame:
    """A link over the middle half of each contig: a deletion of it for even ids, a second copy for odd ones."""
    return contigs(s, sf).select("chr", F.expr(_FROM).alias("from"), F.expr(_TO).alias("to"), (F.col("k") % 2).cast("int").alias("type"))


def mappings(s, sf) -> DataFrame:
    """Reads over the contigs, of which half go to the middle of those that have a second copy of it, and most leave the middle of those that lack it."""
    many = v.table(s, sf, "documents").agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("many")).first()[0]
    d = v.table(s, sf, "lineitem").select((F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4).alias("read_id"), "l_linenumber", ((F.col("l_orderkey") + F.col("l_linenumber") * 17) % many).alias("k"), (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31 + F.col("l_linenumber") * 104729).alias("h"))
    d = d.join(contigs(s, sf).drop("seq"), "k").withColumn("a", F.expr(_FROM)).withColumn("z", F.expr(_TO)).withColumn("p", 1 + F.col("h") % F.col("n"))
    moved = F.when((F.col("k") % 2 == 1) & (F.col("l_linenumber") % 2 == 1), F.col("a") + F.col("h") % (F.col("z") - F.col("a")))
    moved = moved.when((F.col("k") % 2 == 0) & F.col("p").between(F.col("a"), F.col("z") - 1) & (F.col("l_linenumber") % 4 != 0), 1 + F.col("h") % (F.col("a") - 1)).otherwise(F.col("p"))
    return d.select("read_id", F.col("chr").alias("ref_name"), moved.alias("ref_pos"), F.lit("+").alias("orientation"))


def breaks(s, sf) -> DataFrame:
    k = F.col("s_suppkey")
    at = 20 + (k % 3) * 100
    return v.table(s, sf, "supplier").select(F.concat(F.lit("c"), k * 3).alias("chr"), at.alias("start"), (at + 5 + k % 7).alias("end"))


# of each contig's middle edge: segments of its cost (k hits, l expected of one copy), their sum for each count of copies, and the cheapest of these
_FULL = f"""
with sq as (select 'c' || doc_id as chr, translate(lower(text), '{_LETTERS}', '{_BASES}') as seq, length(text)::bigint as n, doc_id as k from documents where length(text) >= 400),
lk as (select chr, k, n, n // 4 + 1 as a, n * 3 // 4 as z, k % 2 as type from sq),
li as (select l_orderkey * 4 + l_linenumber % 4 as read_id, l_linenumber as j, (l_orderkey + l_linenumber * 17) % (select greatest(1, count(*)) from documents) as k, l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 104729 as h from lineitem),
mp as (select read_id, chr, case when type = 1 and j % 2 = 1 then a + h % (z - a) when type = 0 and 1 + h % n between a and z - 1 and j % 4 <> 0 then 1 + h % (a - 1) else 1 + h % n end as pos from li join lk using (k)),
w as (select *, 1.0::double / count(*) over (partition by read_id) as weight from mp),
cov as (select chr, pos, round(sum(weight), 6) as cov from w group by chr, pos),
br as (select 'c' || (s_suppkey * 3) as chr, 20 + (s_suppkey % 3) * 100 as "start", 25 + (s_suppkey % 3) * 100 + s_suppkey % 7 as "end" from supplier),
hi as (select chr, pos, pos - row_number() over (partition by chr order by pos) as g from cov where cov >= 3),
sp as (select chr, greatest(min(pos) - 2, 1) as "start", max(pos) + 2 as "end" from hi group by chr, g),
ch as (select chr, unnest(range(1, length(seq) + 1)) as pos, unnest(string_split(seq, '')) as c from sq),
mk as (select chr, "start", "end" from br union all select * from sp),
hid as (select distinct ch.chr, ch.pos from ch left join mk on mk.chr = ch.chr and ch.pos between "start" and "end" where c = 'n' or "start" is not null),
win as (select chr, (pos - 1) // 500 as win, count(*) as len, count(*) filter (c in ('g', 'c')) as gc, count(*) filter (c in ('a', 't')) as at_ from ch group by all),
wb as (select *, case when gc + at_ > 0 then least((gc * 100 // (gc + at_)) * 50 // 100, 49) end as bin from win),
cw as (select * from wb where not exists (select 1 from hid where hid.chr = wb.chr and (hid.pos - 1) // 500 = wb.win)),
hw as (select chr, (pos - 1) // 500 as win, sum(cov) as hits from cov group by all),
bl as (select bin, round(sum(coalesce(hits, 0)) / sum(len), 6) as lam from cw left join hw using (chr, win) where bin is not null group by bin),
bj as (select b.bin, bl.lam from (select unnest(range(0, 50)) as bin) b left join (select * from bl where lam > 0) bl using (bin)),
bf as (select bin, coalesce(case when bin * 2 > 50 then last_value(lam ignore nulls) over (order by bin rows between unbounded preceding and current row)
  else first_value(lam ignore nulls) over (order by bin rows between current row and unbounded following) end, 0) as lam from bj),
ps as (select ch.chr, ch.pos, bf.lam from ch join wb on wb.chr = ch.chr and wb.win = (ch.pos - 1) // 500 join bf using (bin) left join hid on hid.chr = ch.chr and hid.pos = ch.pos where hid.pos is null),
ed as (select lk.chr, a, z, type, round(coalesce(sum(cov), 0), 6) as hits, count(ps.pos) as unmasked, coalesce(sum(ps.lam::decimal(18, 6)), 0)::double as expected
  from lk left join ps on ps.chr = lk.chr and ps.pos between a and z - 1 left join cov on cov.chr = ps.chr and cov.pos = ps.pos group by all),
arcs as (select chr as arc_id, type, a, z, hits as k, case when expected = 0 then 0 else unmasked end as len, case when unmasked = 0 then 0 else round(expected / unmasked, 6) end as lam from ed),
a1 as (select *, lam * len / 2 as l from arcs), a2 as (select *, cast(trunc(k / l + 0.0001 + 0.9999) as bigint) as up, cast(trunc(k / l + 0.0001) as bigint) as down from a1 where l > 0 and len > 0),
ar as (select arc_id, k, l, case when (case when up = 0 then 999999999 else -k * ln(greatest(up, 1)) + l * up end) > (case when down = 0 then 999999999 else -k * ln(greatest(down, 1)) + l * down end) then down else up end as s from a2),
i as (select unnest(range(0, 10)) as i), m as (select *, case when s > 11 then s - 11 else least(s, 1) end as low from ar), m2 as (select *, least(low - 1, 10) as jump from m),
m3 as (select *, case when low > 1 then low - jump else low end as stop from m2),
rw as (
  select arc_id, k, l, s, i as seq, 1 as sg, s + i as at_, (s + i)::double as x0, (s + i + case when i = 9 then 2 else 1 end)::double as x1, case when i = 9 then 2 else 1 end as cap from ar, i
  union all select arc_id, k, l, s, 10, 1, s + 11, s + 11, s + 21, 99 from ar
  union all select arc_id, k, l, s, 1000 + i, -1, s - i, s - i - case when i = 9 and s - i > 2 then 2 else 1 end, s - i, case when i = 9 and s - i > 2 then 2 else 1 end from ar, i where s - i > 1
  union all select arc_id, k, l, s, 2000, -1, low, low - jump, low, jump from m2 where jump > 0
  union all select arc_id, k, l, s, 3000, -1, stop, 1.0::double / 21, stop, stop from m3 where stop > 0),
sg as (select *, cast(trunc(1000 * ((case when x1 = 0 then 999999999 else -k * ln(case when x1 > 0 then x1 else 1 end) + l * x1 end) - (case when x0 = 0 then 999999999 else -k * ln(case when x0 > 0 then x0 else 1 end) + l * x0 end)) / (x1 - x0)) as bigint) as slope from rw),
xs as (select arc_id, type, x from (select arc_id, type from arcs), (select unnest(range(0, 2001)) as x) where (type = 0 and x <= 2) or (type = 1 and x >= 2)),
co as (select xs.arc_id, type, xs.x, coalesce(sum(case when sg.sg = 1 then slope * greatest(0, least(cap, xs.x - at_)) when sg.sg = -1 then -slope * greatest(0, least(cap, at_ - xs.x)) end), xs.x) + 3 * xs.x + 2 * abs(xs.x - 2) as cost, max(at_ + cap) filter (sg.sg = 1) as most
  from xs left join sg on sg.arc_id = xs.arc_id group by xs.arc_id, type, xs.x),
bx as (select arc_id, (list(x order by cost, x))[1] as x from co where most is null or x <= most group by arc_id),
raw as (select arcs.arc_id as chr, a as "start", z - 1 as "end", (x - 2) as diff from bx join arcs using (arc_id) where x <> 2 and len >= 100),
kp as (select * from raw where not exists (select 1 from br where br.chr = raw.chr and br."start" <= raw."end" and raw."start" <= br."end") and "end" - "start" >= 200),
gd as (select ps.chr, ps.pos, ps.lam, coalesce(cov.cov, 0) as cov from ps left join cov using (chr, pos) where lam > 0)
select kp.chr, "start", "end", case when diff > 0 then 'gain' else 'loss' end as call, round(sum(cov) / sum(lam::decimal(18, 6))::double, 6) as doc_ratio
from kp left join gd on gd.chr = kp.chr and gd.pos between "start" and "end" group by kp.chr, "start", "end", diff"""


def _options() -> chain.Options:
    return chain.Options(high=3, least=200)


def stages_of(s, sf, folder: str | None = None):
    seqs = contigs(s, sf).select(F.col("chr").alias("id"), "seq")
    pairs = s.createDataFrame([], "edge_id long, contig string, start long, end long, strand string")
    return chain.run_chain(s, mappings(s, sf), breaks(s, sf), seqs, links(s, sf), pairs, options=_options(), folder=folder)


@query(_FULL)
def full_calls(s, sf):
    """From mappings, breaks, sequences and links to named calls: depth, masks, expected depth, graph, costs, flow, runs, smoothing."""
    return stages_of(s, sf)[0]
