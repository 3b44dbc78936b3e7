"""All queries on the driver's tables, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoflux.functions import alignment as al
from genoflux.functions import sequence as sq
from genoflux.operators import calls as ca
from genoflux.operators import cluster as cl
from genoflux.operators import depth as de
from genoflux.operators import flow as fl
from genoflux.operators import graph as gr
from genoflux.operators import intervals as iv
from genoflux.operators import reads as rd
from genoflux.operators import report as rp
from genoflux.scratch import materialise

from . import views as v

_Q: dict = {}
_S: dict = {}


def query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = f
        if sql is not None:
            _S[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    from . import files, models, runs  # noqa: F401  add their own

    return _Q


def oracle_sql() -> dict:
    from . import files, models, runs  # noqa: F401

    return _S


def flagship(spark, sf) -> DataFrame:
    return calls_off_breaks(spark, sf)


# ---- reads -----------------------------------------------------------------------------------------------------------


@query(f"with {v.MAPPINGS} select read_id, ref_name, ref_pos, orientation, 1.0::double / count(*) over (partition by read_id) as weight from mappings")
def read_block_weights(s, sf):
    return rd.block_weights(v.mappings(s, sf))


_COV = f"""{v.MAPPINGS}, w as (select *, 1.0::double / count(*) over (partition by read_id) as weight from mappings),
  depth as (select ref_name, ref_pos, round(sum(weight), 6) as cov from w group by all)"""


@query(f"with {_COV} select * from depth")
def position_coverage(s, sf):
    return rd.coverage(v.mappings(s, sf))


@query(f"with {v.MAPPINGS} select * from mappings where ref_name in (select 'chr' || r_regionkey from region where r_regionkey < 3)")
def ref_semi_join(s, sf):
    refs = v.table(s, sf, "region").where("r_regionkey < 3").select(F.concat(F.lit("chr"), F.col("r_regionkey")).alias("ref_name"))
    return rd.on_references(v.mappings(s, sf), refs)


_PAIRS = f"""{v.MAPPINGS}, m as (select *, read_id - read_id % 2 as template from mappings),
  p0 as (select f.template, f.ref_name, least(f.ref_pos, b.ref_pos) as left_pos, greatest(f.ref_pos, b.ref_pos) as right_pos,
    case when f.ref_pos < b.ref_pos then f.orientation else b.orientation end as l_orientation,
    case when f.ref_pos < b.ref_pos then b.orientation else f.orientation end as r_orientation
    from m f join m b on f.template = b.template and f.ref_name = b.ref_name where f.read_id % 2 = 0 and b.read_id % 2 = 1),
  p1 as (select *, case when l_orientation = '+' and r_orientation = '-' then 0 when l_orientation = '-' and r_orientation = '+' then 1 when l_orientation = '+' then 2 else 3 end::int as type from p0),
  pairs as (select *, right_pos - left_pos + 36 * case type when 0 then 1 when 1 then 3 else 2 end as dist from p1)"""


@query(f"""with {_PAIRS}, c as (select *, max(case when type = 0 and left_pos < right_pos and dist between 100 and 400 then 1 else 0 end) over (partition by template) as ok from pairs)
select template as read_id, ref_name, left_pos, right_pos, l_orientation, r_orientation, type, dist from c where ok = 0 and dist <= 1000""")
def discordant_pairs(s, sf):
    return rd.discordant_pairs(v.mappings(s, sf), 36, 100, 400, 1000)


@query(f"""with {v.MAPPINGS}, one as (select read_id, any_value(ref_name) as ref_name, any_value(ref_pos) as ref_pos, any_value(orientation) as orientation from mappings group by read_id having count(*) = 1),
  p as (select least(f.ref_pos, b.ref_pos) as lp, greatest(f.ref_pos, b.ref_pos) as rp, case when f.ref_pos < b.ref_pos then f.orientation else b.orientation end as lo, case when f.ref_pos < b.ref_pos then b.orientation else f.orientation end as ro
    from one f join one b on b.read_id = f.read_id + 1 and f.read_id % 2 = 0 and f.ref_name = b.ref_name),
  d as (select rp - lp + 36 * case when lo = '+' and ro = '-' then 1 when lo = '-' and ro = '+' then 3 else 2 end as dist from p)
select round(avg(dist), 6) as mean, round(stddev_samp(dist), 6) as sd, count(*) as n from d where dist > 10 and dist < 5000""")
def insert_size_stats(s, sf):
    return rd.insert_sizes(v.mappings(s, sf), 36, 10, 5000)


@query(f"""with {v.MAPPINGS}, a as (select read_id, ref_pos, ref_name, orientation from mappings where orientation = '+'), b as (select read_id, ref_pos, ref_name, orientation from mappings where orientation = '-'),
  x as (select a.*, 1 as source, dense_rank() over (order by read_id) as block, row_number() over (partition by read_id order by ref_name, ref_pos) as seq from a
    union all select b.*, 2, dense_rank() over (order by read_id), row_number() over (partition by read_id order by ref_name, ref_pos) from b)
select block, source, seq, read_id || '_' || source as read_id, ref_name, ref_pos, orientation from x""")
def interleave_sources(s, sf):
    m = v.mappings(s, sf)
    return rd.interleave(m.where("orientation = '+'"), m.where("orientation = '-'"), "read_id", ["ref_name", "ref_pos"])


# ---- intervals -------------------------------------------------------------------------------------------------------


def _merged(source: str, gap: int, name: str = "merged") -> str:
    return f"""{name}_0 as (select *, max("end") over (partition by chr order by "start", "end" rows between unbounded preceding and 1 preceding) as before from {source}),
  {name}_1 as (select *, sum(case when before is null or "start" > before + {gap} then 1 else 0 end) over (partition by chr order by "start", "end" rows unbounded preceding) as island from {name}_0),
  {name} as (select chr, min("start") as "start", max("end") as "end" from {name}_1 group by chr, island)"""


@query(f"""with {v.INTERVALS}, {v.BREAKS}, u as (select chr, "start", "end" from iv union all select chr, "start", "end" from br), {_merged('u', 0)} select * from merged""")
def interval_union_merge(s, sf):
    return iv.merge(v.intervals(s, sf).select("chr", "start", "end").unionByName(v.breaks(s, sf).select("chr", "start", "end")))


@query(f"with {v.INTERVALS}, {_merged('iv', 25)} select * from merged")
def interval_merge_with_gap(s, sf):
    return iv.merge(v.intervals(s, sf), 25)


@query(f"""with {v.INTERVALS}, {_merged('iv', 1)},
  g as (select chr, coalesce(lag("end") over w, -1) + 1 as "start", "start" - 1 as "end" from merged window w as (partition by chr order by "start")
    union all select chr, max("end") + 1, 10000000 - 1 from merged group by chr)
select * from g where "start" <= "end" """)
def interval_complement(s, sf):
    return iv.complement(v.intervals(s, sf), 10_000_000)


@query(f"""with {v.INTERVALS}, {v.BREAKS} select * from iv where not exists (select 1 from br where br.chr = iv.chr and br."start" <= iv."end" and iv."start" <= br."end")""")
def interval_overlap_anti(s, sf):
    return iv.overlap_anti(v.intervals(s, sf), v.breaks(s, sf))


@query(f"""with {v.INTERVALS}, {v.BREAKS} select iv.* from iv where exists (select 1 from br where br.chr = iv.chr and br."start" <= iv."end" and iv."start" <= br."end")""")
def interval_overlap_semi(s, sf):
    return iv.overlap_semi(v.intervals(s, sf), v.breaks(s, sf))


@query(f"""with {v.INTERVALS}, {v.BREAKS} select br.id, iv.chr, iv."start", iv."end", iv.label, br."start" as break_start, br."end" as break_end,
  least(iv."end", br."end") - greatest(iv."start", br."start") + 1 as shared, br."start" <= iv."start" and iv."end" <= br."end" as inside
  from iv join br on br.chr = iv.chr and br."start" <= iv."end" and iv."start" <= br."end" """)
def interval_overlap_join(s, sf):
    j = iv.overlap_join(v.intervals(s, sf), v.breaks(s, sf))
    c = (F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    return j.select(
        F.col("r_id").alias("id"), "chr", "start", "end", "label", F.col("r_start").alias("break_start"), F.col("r_end").alias("break_end"),
        iv.overlap_amount(*c).alias("shared"), iv.contains(c[2], c[3], c[0], c[1]).alias("inside"),
    )


@query(f"""with {v.LINKS}, {v.BREAKS}, x as (select *, "from" + case when type = 3 then -200 else 200 end as lp, "to" - case when type = 2 then -200 else 200 end as rp from links)
select id, chr, "from", "to", type, count, avg_md from x where not exists (select 1 from br where br.chr = x.chr and (x.lp between br."start" and br."end" or x.rp between br."start" and br."end"))""")
def screen_link_endpoints(s, sf):
    return iv.screen_links(v.links(s, sf), v.breaks(s, sf), 200)


_BEST = f"""{v.INTERVALS}, {v.BREAKS}, db as (select distinct chr, "start", "end" from iv),
  hit as (select br.id, br."start" as qs, br."end" as qe, db."start" as s, db."end" as e, least(br."end", db."end") - greatest(br."start", db."start") + 1 as ov
    from br join db on br.chr = db.chr and br."start" <= db."end" and db."start" <= br."end"),
  r as (select *, row_number() over (partition by id order by ov desc, s, e) as k from hit),
  agg as (select id, max(case when k = 1 then s end) as bs, max(case when k = 1 then e end) as be, max(case when k = 1 then ov end) as bo, count(*) as n, sum(ov) as ov, sum(e - s + 1) as size,
    string_agg(s || chr(9) || e, chr(9) order by s, e) as match_list,
    coalesce(string_agg(format('{{:.4f}}', ov / (qe - qs + 1)) || chr(9) || format('{{:.4f}}', ov / (e - s + 1)), chr(9) order by s, e) filter (where k > 1), '') as other_shares from r group by id),
  best as (select br.id, br.chr, br."start", br."end", round(coalesce(bo / (br."end" - br."start" + 1), 0), 4) as best_share, round(coalesce(bo / (be - bs + 1), 0), 4) as best_match_share,
    coalesce(n, 0) as matches, abs(bs - br."start") as start_diff, abs(be - br."end") as end_diff, round(coalesce(ov / (br."end" - br."start" + 1), 0), 4) as covered,
    round(coalesce(ov / size, 0), 4) as match_covered, match_list, other_shares, br."end" - br."start" + 1 as length from br left join agg using (id))"""


def _best(mode: str):
    def f(s, sf):
        return iv.annotate(v.breaks(s, sf), v.intervals(s, sf), mode)

    f.__name__ = f"best_overlap_{mode}"
    cols = ", ".join(iv.MODES[mode])
    query(f"""with {_BEST} select id, chr, "start", "end", {cols} from best""")(f)


for _mode in iv.MODES:
    _best(_mode)


@query(f"""with {v.BREAKS}, {v.LINKS} select br.id, coalesce(string_agg(l.id::varchar, chr(9) order by l."from", l."to", l.id), '') as links
  from br left join links l on l.chr = br.chr and l."from" >= br."start" - 3000 and l."to" <= br."end" + 3000 group by br.id""")
def link_containment_list(s, sf):
    return iv.contained_links(v.breaks(s, sf), v.links(s, sf))


@query(f"""with {v.LINKS}, {v.BREAKS} select l.id, l.chr, l."from" as pos, b."start" as seg_start, b.id as seg_id
  from links l asof left join br b on l.chr = b.chr and l."from" >= b."start" """)
def point_location_asof(s, sf):
    return iv.locate(v.links(s, sf).select("id", "chr", F.col("from").alias("pos")), v.breaks(s, sf).select("chr", "start", "id"))


# ---- depth -----------------------------------------------------------------------------------------------------------

_SPIKES = f"""{_COV}, st as (select ref_name as chr, ref_pos as pos, case when cov <= 1 then 'low' when cov >= 3 then 'high' end as state from depth),
  g as (select *, pos - row_number() over (partition by chr, state order by pos) as k from st where state is not null),
  runs as (select chr, min(pos) as "start", max(pos) as "end", state from g group by chr, state, k)"""


def _spikes(s, sf):
    c = rd.coverage(v.mappings(s, sf)).select(F.col("ref_name").alias("chr"), F.col("ref_pos").alias("pos"), "cov")
    return de.spikes(c, 1, 3)


@query(f"with {_SPIKES} select * from runs")
def coverage_spikes(s, sf):
    return _spikes(s, sf)


@query(f"""with {_SPIKES} select chr, greatest("start" - 2, 1) as "start", "end" + 2 as "end" from runs where state = 'high'""")
def spike_pad_filter(s, sf):
    return de.pad_spikes(_spikes(s, sf))


@query(f"""with {_SPIKES}, {v.BREAKS}, {v.CALLS}, u as (select chr, "start", "end" from br union all select chr, greatest("start" - 2, 1), "end" + 2 from runs where state = 'high'), {_merged('u', 0)}
select * from calls c where not exists (select 1 from merged m where m.chr = c.chr and m."start" <= c."end" and c."start" <= m."end")""")
def calls_off_breaks(s, sf):
    masks = iv.merge(v.breaks(s, sf).select("chr", "start", "end").unionByName(de.pad_spikes(_spikes(s, sf))))
    return iv.overlap_anti(v.calls(s, sf), masks)


def _seqs(s, sf):
    return v.table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("seq"))


_SEQ = "seqs as (select doc_id as id, lower(text) as seq from documents)"


@query(f"""with {_SEQ}, c as (select id, unnest(range(1, length(seq) + 1)) as pos, unnest(string_split(seq, '')) as c from seqs where length(seq) > 0),
  g as (select id, pos, pos - row_number() over (partition by id order by pos) as k from c where c = 'n')
select id, min(pos) as "start", max(pos) as "end" from g group by id, k""")
def n_runs(s, sf):
    return de.letter_runs(_seqs(s, sf))


_WIN = f"""{_SEQ}, w0 as (select id, seq, unnest(range(0, cast(ceil(length(seq) / 500) as bigint))) as win from seqs where length(seq) > 0),
  w1 as (select id, win::int as win, substring(seq, win * 500 + 1, 500) as s from w0),
  w2 as (select id, win, s, length(s)::int as len, length(regexp_replace(s, '[^gc]', '', 'g'))::int as gc, length(regexp_replace(s, '[^at]', '', 'g'))::int as at_ from w1),
  win as (select *, case when gc + at_ > 0 then least((gc * 100 // (gc + at_)) * 50 // 100, 49)::bigint end as bin from w2)"""


@query(f'with {_WIN} select id, win, len, gc, at_ as "at", bin from win')
def gc_windows(s, sf):
    return de.gc_windows(_seqs(s, sf))


def _lambda(s, sf):
    w = de.gc_windows(_seqs(s, sf))
    return de.bin_lambda(w.withColumn("hits", F.col("gc") % 7))


_LAM = f"{_WIN}, lam as (select bin, sum(gc % 7)::bigint as hits, sum(len)::bigint as length, round(sum(gc % 7) / sum(len), 6) as lam from win where bin is not null group by bin)"


@query(f"with {_LAM} select * from lam")
def gc_bin_lambda(s, sf):
    return _lambda(s, sf)


@query(f"""with {_LAM}, b as (select unnest(range(0, 50)) as bin), j as (select b.bin, l.lam from b left join (select * from lam where lam > 0) l using (bin))
select bin, coalesce(case when bin * 2 > 50 then last_value(lam ignore nulls) over (order by bin rows between unbounded preceding and current row)
  else first_value(lam ignore nulls) over (order by bin rows between current row and unbounded following) end, 0) as lam from j""")
def gc_lambda_fallback(s, sf):
    return de.fill_lambda(_lambda(s, sf))


@query(f"""with {_SEQ}, x as (select id, substring(seq, 101, 200) as s from seqs)
select id, case when length(regexp_replace(s, '[^acgt]', '', 'g')) > 0 then round(length(regexp_replace(s, '[^gc]', '', 'g')) / length(regexp_replace(s, '[^acgt]', '', 'g')), 6) end as gc,
  round(length(regexp_replace(s, '[^acgt]', '', 'g')) / length(s), 6) as known from x where length(s) > 0""")
def interval_gc_content(s, sf):
    return de.gc_content(_seqs(s, sf), 101, 300)


def _regions(s, sf):
    return v.breaks(s, sf).select("id", "chr", (F.col("start") % 15000).alias("start"), (F.col("start") % 15000 + 900).alias("end"))


_REG = f"""{v.BREAKS}, reg as (select id, chr, "start" % 15000 as "start", "start" % 15000 + 900 as "end" from br)"""


@query(f"""with {_REG}, {v.COVERAGE} select r.id, round(sum(case when lam > 0 then cov end) / sum(case when lam > 0 then lam end), 6) as ratio,
  sum(case when c.pos is null then 0 when lam > 0 then 0 else 1 end)::bigint as masked, round(coalesce(sum(cov), 0), 6) as total
  from reg r left join cov c on c.chr = r.chr and c.pos between r."start" and r."end" group by r.id""")
def doc_ratio(s, sf):
    return de.depth_ratio(_regions(s, sf), v.coverage(s, sf))


@query(f"""with {_REG}, {v.COVERAGE}, parts as (select id % 30 as edge_id, id as occ, chr, "start", "end" from reg),
  masks as (select chr, "start" + 200 as "start", "start" + 260 as "end" from reg),
  good as (select * from cov c where not exists (select 1 from masks m where m.chr = c.chr and c.pos between m."start" and m."end")),
  o as (select p.edge_id, p.occ, sum(cov) as h, sum(lam) as x, count(c.pos) as u from parts p left join good c on c.chr = p.chr and c.pos between p."start" and p."end" group by all),
  e as (select edge_id, round(coalesce(sum(h), 0), 6) as hits, round(coalesce(sum(x), 0), 6) as expected, sum(u)::bigint as unmasked, count(*) as paths from o group by edge_id)
select *, round(case when unmasked <= 0 then 0 else expected / unmasked end, 6) as lam, unmasked // paths as called from e""")
def edge_hits_expected(s, sf):
    r = _regions(s, sf)
    parts = r.select((F.col("id") % 30).alias("edge_id"), F.col("id").alias("occ"), "chr", "start", "end")
    masks = r.select("chr", (F.col("start") + 200).alias("start"), (F.col("start") + 260).alias("end"))
    return de.edge_hits(parts, masks, v.coverage(s, sf))


# ---- graph -----------------------------------------------------------------------------------------------------------


@query(f"""with {v.EDGES}, x as (select contig, pos, edge_id, lead(pos) over w as next_pos, lead(edge_id) over w as next_edge from edges window w as (partition by contig order by pos, edge_id)) select * from x where next_pos is not null""")
def free_edge_links(s, sf):
    return gr.free_links(v.edges(s, sf))


@query(f"""with {v.INTERVALS}, {_merged('iv', 0)}, len as (select chr, max("end") + 1000 as length from iv group by chr),
  g as (select chr, coalesce(lag("end") over w, 0) + 1 as "start", "start" - 1 as "end" from merged window w as (partition by chr order by "start")
    union all select m.chr, max("end") + 1, any_value(length) from merged m join len using (chr) group by m.chr),
  a as (select *, 'edge' as kind from merged union all select *, 'gap' from g where "start" <= "end")
select *, row_number() over (order by chr, "start") - 1 as edge_id from a""")
def fill_reference_gaps(s, sf):
    i = v.intervals(s, sf)
    lengths = i.groupBy("chr").agg((F.max("end") + 1000).alias("length"))
    return gr.dense_ids(gr.fill_gaps(i, lengths), ["chr", "start"], "edge_id")


@query(f"with {v.EDGES} select edge_id, 2 * count(*) as copies from edges group by edge_id")
def reference_multiplicity(s, sf):
    return gr.multiplicity(v.edges(s, sf))


@query(f"""with {v.LINKS}, fl as (select o_orderkey as id, o_custkey % 3 as flow from orders) select links.*, flow from links join fl using (id) where flow <> 0""")
def donor_edge_report(s, sf):
    flows = v.table(s, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("flow"))
    return gr.donor_report(v.links(s, sf), flows)


def _cut(s, sf):
    parts = _regions(s, sf).select("chr", "start", "end")
    points = v.links(s, sf).select("chr", (F.col("from") % 16000).alias("pos"))
    return parts, points


@query(f"""with {_REG}, {v.LINKS}, parts as (select distinct chr, "start", "end" from reg), pts as (select distinct chr, "from" % 16000 as pos from links),
  c as (select parts.*, pos from parts join pts on pts.chr = parts.chr and pos > "start" and pos <= "end" union select chr, "start", "end", "start" from parts)
select chr, pos as "start", coalesce(lead(pos) over (partition by chr, "start", "end" order by pos) - 1, "end") as "end" from c""")
def cut_at_links(s, sf):
    return gr.cut_at(*_cut(s, sf))


def _occurrences(s, sf):
    m = iv.merge(v.breaks(s, sf).select("chr", "start", "end"))
    every = gr.dense_ids(gr.fill_gaps(m, m.groupBy("chr").agg((F.max("end") + 100_000).alias("length"))).select("chr", "start", "end"), ["chr", "start"], "edge_id")
    return materialise(every.withColumn("strand", F.when(F.col("edge_id") % 3 == 0, "-").otherwise("+")), "occurrences")


# ---- clusters --------------------------------------------------------------------------------------------------------


def _mates(s, sf):
    p = rd.discordant_pairs(v.mappings(s, sf), 36, 100, 400, 1000)
    return p.select(F.col("ref_name").alias("chr"), "type", "left_pos", "right_pos", "dist", F.col("read_id").alias("template"))


def _given(s, sf):
    return _mates(s, sf).withColumn("part", F.floor(F.col("left_pos") / 100)).withColumn("cluster", F.floor(F.col("dist") / 50))


@query(f"""with {_PAIRS}, c as (select *, max(case when type = 0 and left_pos < right_pos and dist between 100 and 400 then 1 else 0 end) over (partition by template) as ok from pairs),
  mm as (select ref_name as chr, type, left_pos, right_pos, dist, template, left_pos // 100 as part, dist // 50 as cluster from c where ok = 0 and dist <= 1000),
  a as (select *, not coalesce(left_pos = lag(left_pos) over w and dist = lag(dist) over w, false) as fresh, avg(dist) over (partition by chr, type, part, cluster) as mean
    from mm window w as (partition by chr, type, part, cluster order by left_pos, dist, right_pos, template)),
  b as (select *, fresh and row_number() over (partition by chr, type, part, cluster, template, fresh order by left_pos, dist, right_pos) = 1 as kept from a),
  g as (select chr, type, part, cluster, count(*) as size, min(left_pos) as x1, max(left_pos) as x2, min(right_pos) as x3, max(right_pos) as x4, avg(dist) as mean, sum(kept::int)::bigint as n,
    sum(case when kept then (dist - mean) * (dist - mean) end) as ss from b group by all),
  l as (select chr, case when type in (0, 2) then x2 else x1 end as "from", case when type in (1, 2) then x4 else x3 end as "to", type, n as count, x2 - x1 as l_from, x4 - x3 as l_to,
    round(mean, 6) as avg_md, round(sqrt(ss / size), 6) as sd from g where size > 1 and mean >= 400 and n > 1)
select *, row_number() over (partition by type order by chr, "from", "to", l_from, l_to, avg_md) as id from l""")
def cluster_summary(s, sf):
    return cl.cluster_summary(_given(s, sf), 200)


@query(f"with {v.LINKS} select * from links where count >= 3 and avg_md < 10000000")
def link_filter(s, sf):
    return cl.filter_links(v.links(s, sf), 3)


@query("""with c as (select o_custkey as id, list(o_orderkey) as members from orders group by 1), m as (select id, unnest(members) as read_id from c where id in (1, 2, 3, 5, 8, 13, 21, 34))
select m.id, l_orderkey as read_id, l_partkey, l_suppkey, l_linenumber from m join lineitem on l_orderkey = m.read_id""")
def cluster_member_drilldown(s, sf):
    c = v.table(s, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("members"))
    rows = v.table(s, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), "l_partkey", "l_suppkey", "l_linenumber")
    return cl.members(c, rows, [1, 2, 3, 5, 8, 13, 21, 34])


# ---- flow ------------------------------------------------------------------------------------------------------------

_SEGS = f"""{v.ARCS}, a0 as (select *, hits::double as k, lam * len / 2 as l from (from arcs union all select -1, 26, 1, 0, -1, 0)), a1 as (select *, cast(trunc(k / l + 0.0001 + 0.9999) as bigint) as up, cast(trunc(k / l + 0.0001) as bigint) as down from a0 where l > 0 and len > 40),
  a as (select arc_id, "from", "to", k, l, case when (case when up = 0 then 999999999 else -k * ln(greatest(up, 1)) + l * up end) > (case when down = 0 then 999999999 else -k * ln(greatest(down, 1)) + l * down end) then down else up end as s from a1),
  i as (select unnest(range(0, 10)) as i), m as (select *, case when s > 11 then s - 11 else least(s, 1) end as low from a), m2 as (select *, least(low - 1, 10) as jump from m),
  m3 as (select *, case when low > 1 then low - jump else low end as stop from m2),
  raw as (
    select arc_id, "from", "to", k, l, i as seq, 'fwd' as dir, case when i = 0 then s else 0 end as low, case when i = 0 then s + 1 when i = 9 then 2 else 1 end as cap, (s + i)::double as x0, (s + i + case when i = 9 then 2 else 1 end)::double as x1, 1 as sg from a, i
    union all select arc_id, "from", "to", k, l, 10, 'fwd', 0, 99, s + 11, s + 21, 1 from a
    union all select arc_id, "from", "to", k, l, 1000 + i, 'rev', 0, case when i = 9 and s - i > 2 then 2 else 1 end, s - i - case when i = 9 and s - i > 2 then 2 else 1 end, s - i, -1 from a, i where s - i > 1
    union all select arc_id, "from", "to", k, l, 2000, 'rev', 0, jump, low - jump, low, -1 from m2 where jump > 0
    union all select arc_id, "from", "to", k, l, 3000, 'rev', 0, stop, 1.0::double / 21, stop, -1 from m3 where stop > 0),
  segs as (select arc_id, "from", "to", seq::bigint as seq, dir, low::bigint as low, cap::bigint as cap,
    sg * cast(trunc(1000 * ((case when x1 = 0 then 999999999 else -k * ln(case when x1 > 0 then x1 else 1 end) + l * x1 end) - (case when x0 = 0 then 999999999 else -k * ln(case when x0 > 0 then x0 else 1 end) + l * x0 end)) / (x1 - x0)) as bigint) as slope from raw
    union all select arc_id, "from", "to", 0, 'fwd', case when len < 0 then 2 else 0 end, case when len < 0 then 2 else 99999 end, case when len < 0 then 0 else 1 end from a0 where l <= 0 or len <= 40)"""


@query(f"with {_SEGS} select * from segs")
def cost_segments(s, sf):
    """Costs of all arcs: short ones are free, and the closing one must carry two."""
    a = v.arcs(s, sf)
    closing = s.range(1).select(*(F.lit(x).cast(t).alias(n) for x, (n, t) in zip((-1, 26, 1, 0, -1, 0.0), a.dtypes)))
    return fl.cost_segments(a.unionByName(closing), free_length=40)


@query(f"""with {v.ARCS}, x as (select arc_id, 1 as image, case when "from" > 0 then 2 * "from" - 1 else 2 * "from" + 1 end + 51 as tail, 2 * "to" + 51 as head from arcs where "from" <> "to"
  union all select arc_id, 2, case when -"to" > 0 then -2 * "to" - 1 else -2 * "to" + 1 end + 51, -2 * "from" + 51 from arcs where "from" <> "to") select * from x""")
def skew_symmetric_network(s, sf):
    return fl.doubled(v.arcs(s, sf).where("from <> to"), 25)  # self_loop_flow has the others


@query("""with i as (select o_custkey as arc_id, case when o_orderkey % 2 = 0 then 1 else -1 end as sign, o_orderkey % 9 as flow from orders) select arc_id, sum(sign * flow) / 2 as flow from i group by arc_id""")
def net_arc_flow(s, sf):
    o = v.table(s, sf, "orders")
    return fl.net_flow(o.select(F.col("o_custkey").alias("arc_id"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("sign"), (F.col("o_orderkey") % 9).alias("flow")))


# ---- calls -----------------------------------------------------------------------------------------------------------


@query("""with d as (select user_id, event_id, ts, case when value > 50 then 1 when value < 50 then -1 else 0 end::int as sign, abs(value - 50) as v, value as l from events),
  a as (select *, case when sign is distinct from lag(sign) over (partition by user_id order by ts, event_id) then 1 else 0 end as fresh from d),
  b as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as run from a)
select user_id, run, sign, count(*) as n, round(sum(l), 6) as length, round(min(v), 6) as peak from b where sign <> 0 group by user_id, run, sign""")
def signed_runs_first_pass(s, sf):
    return ca.signed_runs(v.table(s, sf, "events"), "user_id", ["ts", "event_id"], F.col("value") - 50, F.col("value"))


@query("""with d as (select user_id, event_id, ts, case when value > 50 then 1 when value < 50 then -1 else 0 end::int as sign, value as l from events),
  a as (select *, case when sign is distinct from lag(sign) over (partition by user_id order by ts, event_id) then 1 else 0 end as fresh from d),
  b as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as run from a),
  r as (select user_id, run, sign, round(sum(l), 6) as length from b where sign <> 0 group by all)
select user_id, run, sign, length from (select *, row_number() over (partition by user_id order by length desc, run) as k from r) where k = 1""")
def longest_signed_run(s, sf):
    return ca.longest_run(signed_runs_first_pass(s, sf), "user_id")


@query(f"""with {v.CALLS} select chr, "start", "end", case when cast(trunc(flow_diff) as bigint) > 0 then 'gain' else 'loss' end as call from calls where "end" - "start" >= 1000""")
def final_calls(s, sf):
    return ca.final_calls(ca.truncated(v.calls(s, sf)).where(F.col("end") - F.col("start") >= 1000))


@query("""with d as (select o_orderkey as id, (o_totalprice % 7) / 2 as flow, 2.0::double as ref from orders), h as (select id, floor(flow * 2) / 2 as flow, ref from d)
select id, case when flow <> floor(flow) and flow > ref then flow - 0.5 when flow <> floor(flow) and flow < ref then flow + 0.5 else flow end as flow, greatest(least(flow - ref, 0.5), -0.5) as sign from h""")
def half_flow_rounding(s, sf):
    d = v.table(s, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.floor((F.col("o_totalprice") % 7) / 2 * 2) / 2).alias("flow"))
    return d.select("id", ca.toward(F.col("flow"), F.lit(2.0)).alias("flow"), ca.clamp(F.col("flow") - 2.0).alias("sign"))


# ---- reports ---------------------------------------------------------------------------------------------------------


@query(f"""with {v.EDGES}, x as (select *, count(*) over (partition by contig, edge_id) as n, row_number() over (partition by contig, edge_id order by pos) as k from edges)
select contig, pos, edge_id, length, flow, flow // n + case when k <= flow % n then 1 else 0 end as share from x""")
def apportion_copies(s, sf):
    return rp.apportion(v.edges(s, sf), ["contig"])


@query(f"with {v.EDGES} select flow, sum(length)::bigint as weight from edges where flow between -2000 and 2000 group by flow")
def copy_histogram(s, sf):
    return rp.histogram(v.edges(s, sf), "flow", "length")


@query(f"""with {v.EDGES}, h as (select contig, flow, sum(length) as w from edges group by all), c as (select *, sum(w) over (partition by contig order by flow) as upto, sum(w) over (partition by contig) as total from h)
select contig, round(sum(flow * w) / sum(w), 6) as mean, (list(flow order by w desc, flow))[1] as mode, min(case when 2 * upto >= total then flow end) as median from c group by contig""")
def weighted_mean_mode_median(s, sf):
    return rp.weighted_stats(v.edges(s, sf), "contig", "flow", "length")


@query("""select round(coalesce(sum((o_custkey % 5) * ((5000 - 1000 + 1) / (o_custkey % 300 + 100)::double)), 0), 6) as copies, count(*) as n from orders where o_orderkey % 11 - 1 <> -1""")
def region_ref_copies(s, sf):
    o = v.table(s, sf, "orders").select((F.col("o_custkey") % 5).alias("ref"), (F.col("o_custkey") % 300 + 100).cast("double").alias("length"), (F.col("o_orderkey") % 11 - 1).alias("rel_end"))
    return rp.region_copies(o, 1000, 5000)


@query(f"""with {v.EDGES}, c as (select contig, length, sum(length) over (partition by contig order by length) as upto from edges) select contig, min(length) as nscore from c where upto >= 100000 * 50 / 100 group by contig""")
def nscore_n50(s, sf):
    return rp.nscore(v.edges(s, sf), "contig", "length", F.lit(100_000), 50)


@query("""select user_id, (list(event_id order by value, event_id))[1] as first_min, (list(event_id order by value desc, event_id))[1] as first_max from events group by user_id""")
def argmin_argmax(s, sf):
    return v.table(s, sf, "events").groupBy("user_id").agg(rp.argmin("value", "event_id").alias("first_min"), rp.argmax("value", "event_id").alias("first_max"))


@query(f"""with {v.EDGES}, o as (select *, length - pos % 7 as unmasked, (pos % 50)::double as hits, (pos % 60)::double as expected from edges)
select edge_id, max(flow) as donor, 2 * count(*) as ref, sum(length)::bigint as length, sum(unmasked)::bigint as unmasked, case when sum(expected) <> 0 then trunc(100 * (sum(hits) / sum(expected))) / 100 end as ratio from o group by edge_id""")
def segment_report(s, sf):
    e = v.edges(s, sf).withColumn("unmasked", F.col("length") - F.col("pos") % 7).withColumn("hits", (F.col("pos") % 50).cast("double")).withColumn("expected", (F.col("pos") % 60).cast("double"))
    return rp.segments(e)


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem where l_orderkey = 77")
def key_lookup(s, sf):
    return rp.lookup(v.table(s, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), "l_orderkey", 77)


@query("select c_custkey, c_name, c_nationkey from customer order by c_custkey offset 100")
def ordinal_lookup(s, sf):
    return rp.from_row(v.table(s, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"], 100)


@query("select c_custkey, c_name, c_nationkey from customer order by c_custkey desc limit 7")
def tail_rows(s, sf):
    return rp.from_row(v.table(s, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"], -7)


# ---- functions -------------------------------------------------------------------------------------------------------

_DNA = "dna as (select l_orderkey as k, l_linenumber as j, l_partkey as p, translate(substring(md5(l_partkey::varchar), 1, 20), '0123456789abcdef', 'ACGTacgtNACGTACG') as a, translate(substring(md5(l_suppkey::varchar), 1, 20), '0123456789abcdef', 'ACGTacgtNACGTACG') as b from lineitem)"
_RC = "translate(regexp_replace(reverse({0}), '[^ACGTacgt]', 'X', 'g'), 'ACGTacgt', 'TGCAtgca')"


def _dna(s, sf):
    def letters(c):
        return F.translate(F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 20), "0123456789abcdef", "ACGTacgtNACGTACG")

    return v.table(s, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), F.col("l_partkey").alias("p"), letters("l_partkey").alias("a"), letters("l_suppkey").alias("b"))


@query(f"""with {_DNA}, r as (select *, {_RC.format('a')} as ra, {_RC.format('b')} as rb from dna)
select k, j, p, ra as revcomp, least(a, ra) as canonical, a > ra as flipped, hamming(a, b)::int as hamming, least(hamming(a, b), hamming(a, rb))::int as hamming_any from r""")
def revcomp_canonical_hamming(s, sf):
    a, b = F.col("a"), F.col("b")
    return _dna(s, sf).select("k", "j", "p", sq.revcomp(a).alias("revcomp"), sq.canonical(a).alias("canonical"), sq.is_flipped(a).alias("flipped"), sq.hamming(a, b).alias("hamming"), sq.hamming_any(a, b).alias("hamming_any"))


@query(f"""with {_DNA}, x as (select k, j, p, a[1] as c, b[2] as d from dna)
select k, j, p, nullif(instr('ACGT', upper(c)) - 1, -1)::int as code, case when p % 6 <= 3 then substring('ACGT', p % 6 + 1, 1) end as base,
  case when upper(c) = upper(d) then 100 else 0 end::int as score, format('{{:,}}', k * 12345) as thousands, 100000 - p + 1 as flipped from x""")
def base_codes_and_formats(s, sf):
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    c, d = F.substring(a, 1, 1), F.substring(b, 2, 1)
    return _dna(s, sf).select(
        "k", "j", "p", sq.base_code(c).alias("code"), sq.code_base((p % 6).cast("int")).alias("base"), sq.align_score(c, d).alias("score"),
        sq.thousands(F.col("k") * 12345).alias("thousands"), sq.flip_coordinate(p, F.lit(100_000)).alias("flipped"),
    )


@query(f"""with {_SEQ}, x as (select substring(seq, i, 8) as kmer from seqs, unnest(range(1, length(seq) - 8 + 2)) as t(i) where length(seq) >= 8) select kmer, count(*) as n from x group by kmer having count(*) > 400""")
def kmer_repeats(s, sf):
    return sq.kmer_counts(_seqs(s, sf), 8).where("n > 400")


@query(f"""with {_SEQ}, x as (select id, i, substring(seq, i, 8) as kmer from seqs, unnest(range(1, length(seq) - 8 + 2)) as t(i) where length(seq) >= 8),
  f as (select kmer from x group by kmer having count(*) > 400), u as (select id::varchar as chr, i as "start", i + 7 as "end" from x where kmer in (select kmer from f)), {_merged('u', 0)} select * from merged""")
def high_copy_regions(s, sf):
    """Stretches of sequences covered by k-mers that occur very often; those of one sequence don't overlap, so that only texts that share an id are merged."""
    d = _seqs(s, sf)
    hit = materialise(sq.covered_by(d, sq.kmer_counts(d, 8).where("n > 400"), 8).select(F.col("id").cast("string").alias("chr"), "start", "end"), "covered")
    shared = materialise(d.groupBy(F.col("id").cast("string").alias("chr")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chr"), "shared-ids")
    return hit.join(shared, "chr", "left_anti").unionByName(iv.merge(hit.join(shared, "chr", "left_semi")))


@query("""with x as (select p_brand as g, p_partkey as k, substring(lpad(p_partkey::varchar, 8, '0'), 1, 8) as s from part), c as (select g, k, unnest(range(1, 9)) as i, unnest(string_split(s, '')) as c from x),
  m as (select g, i, min(c) = max(c) as same from c group by g, i)
select g, k, string_agg(case when same then ' ' else c end, '' order by i) as masked from c join m using (g, i) group by g, k""")
def mask_identical_columns(s, sf):
    p = v.table(s, sf, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("s"))
    return sq.mask_same_columns(p, "g", "k", "s")


def _aligned(s, sf):
    p, q = F.col("l_partkey"), F.col("l_quantity").cast("int")
    cigar = F.concat(q + 3, F.lit("M"), p % 4 + 1, F.lit("I"), p % 3 + 1, F.lit("D"), F.lit("2N3S1P4M"))
    return v.table(s, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), p.alias("pos"), q.alias("q"), (p % 2048).cast("int").alias("flag"), cigar.alias("cigar"))


@query("""select l_orderkey as k, l_linenumber as j, l_partkey as pos, l_partkey + cast(l_quantity as int) + 3 + l_partkey % 3 + 1 + 2 + 4 as last from lineitem""")
def cigar_reference_end(s, sf):
    return _aligned(s, sf).select("k", "j", "pos", al.reference_end(F.col("pos"), al.parse_cigar(F.col("cigar"))).alias("last"))


@query("""with x as (select l_orderkey as k, l_linenumber as j, l_partkey as pos, cast(l_quantity as int) + 3 as m, l_partkey % 4 + 1 as i, l_partkey % 3 + 1 as d, repeat('ACGT', 20) as b from lineitem)
select k, j, pos, substring(b, 1, m + i) || repeat('-', d) || 'NN' || '*' || substring(b, m + i + 3 + 1, 4) as aligned from x""")
def cigar_aligned_bases(s, sf):
    return _aligned(s, sf).select("k", "j", "pos", al.aligned_bases(F.repeat(F.lit("ACGT"), 20), al.parse_cigar(F.col("cigar"))).alias("aligned"))


_FLAGSQL = ", ".join(f"(f & {b}) <> 0 as {n}" for n, b in al.FLAGS.items())


@query(f"""with x as (select l_orderkey as k, l_linenumber as j, l_partkey as p, (l_partkey % 2048)::int as f from lineitem) select k, j, p, {_FLAGSQL}, f | 1024 as marked, f & ~16 as forward from x""")
def alignment_flags(s, sf):
    f = F.col("flag")
    return _aligned(s, sf).select("k", "j", F.col("pos").alias("p"), *(al.has_flag(f, n).alias(n) for n in al.FLAGS), al.set_flag(f, "is_duplicate", True).alias("marked"), al.set_flag(f, "is_reverse", False).alias("forward"))


@query("""with x as (select l_orderkey as k, l_linenumber as j, l_partkey as p, l_partkey * 9973 as a, l_partkey * 9973 + cast(l_quantity as bigint) * 3000 as z from lineitem)
select k, j, p, case when a >> 14 = z >> 14 then 4681 + (a >> 14) when a >> 17 = z >> 17 then 585 + (a >> 17) when a >> 20 = z >> 20 then 73 + (a >> 20) when a >> 23 = z >> 23 then 9 + (a >> 23) when a >> 26 = z >> 26 then 1 + (a >> 26) else 0 end as bin,
  (1 + (z >> 26) - (a >> 26) + 1 + (z >> 23) - (a >> 23) + 1 + (z >> 20) - (a >> 20) + 1 + (z >> 17) - (a >> 17) + 1 + (z >> 14) - (a >> 14) + 1)::int as n_bins from x""")
def region_bins(s, sf):
    a = F.col("pos") * 9973
    z = a + F.col("q").cast("bigint") * 3000 + 1
    return _aligned(s, sf).select("k", "j", F.col("pos").alias("p"), al.region_bin(a, z).cast("bigint").alias("bin"), F.size(al.region_bins(a, z)).alias("n_bins"))


@query("""select l_orderkey as k, l_linenumber as j, l_partkey as p, cast(regexp_extract(l_orderkey || '+:<24,' || l_partkey || ',2>', '^(\\d+)[+-]', 1) as bigint) as read_id, regexp_extract('/w/chrdir/chr' || (l_suppkey % 5) || '.scov', '.*(chr[^.]*)\\.', 1) as chr,
  cast(trunc(l_extendedprice / 1000 + 0.5) as bigint) as rounded, cast(trunc(l_extendedprice / 1000 + 0.9999) as bigint) as raised from lineitem""")
def text_fields(s, sf):
    d = v.table(s, sf, "lineitem")
    x = F.col("l_extendedprice") / 1000
    return d.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), F.col("l_partkey").alias("p"),
        sq.bowtie_read_id(F.concat(F.col("l_orderkey"), F.lit("+:<24,"), F.col("l_partkey"), F.lit(",2>"))).alias("read_id"),
        sq.chromosome_of(F.concat(F.lit("/w/chrdir/chr"), F.col("l_suppkey") % 5, F.lit(".scov"))).alias("chr"), fl.half_up(x).alias("rounded"), fl.nearly_ceil(x).alias("raised"),
    )


@query("""with a as (select l_suppkey as k, list_sort(list_distinct(list(l_partkey))) as x from lineitem where l_returnflag = 'A' group by 1), b as (select l_suppkey as k, list_distinct(list(l_partkey)) as x from lineitem where l_returnflag = 'R' group by 1)
select k, list_sort(list_distinct(list_concat(a.x, b.x)))::varchar as positions, len(list_distinct(list_concat(a.x, b.x))) as n from a join b using (k)""")
def position_set_union(s, sf):
    d = v.table(s, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("b"))
    u = F.array_sort(F.array_union("a", "b"))
    return d.where("size(a) > 0 and size(b) > 0").select("k", F.concat(F.lit("["), F.array_join(u.cast("array<string>"), ", "), F.lit("]")).alias("positions"), F.size(u).cast("bigint").alias("n"))


@query("""select (select count(*) from (select l_orderkey, l_partkey from lineitem except all select l_orderkey, l_partkey from lineitem where l_returnflag <> 'N')) as only_left,
  (select count(*) from (select l_orderkey, l_partkey from lineitem where l_returnflag <> 'N' except all select l_orderkey, l_partkey from lineitem)) as only_right""")
def table_difference(s, sf):
    a = v.table(s, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    b = a.where("l_returnflag <> 'N'").drop("l_returnflag")
    a = a.drop("l_returnflag")
    x = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"))
    return x.crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right")))  # one row each


@query("""select net, case when tail is null then 'end missing' when low > cap then 'bounds cross' when tail = head then 'loop' end as why, arc_id
  from (select 'net' || (s_nationkey % 5) as net, s_suppkey as arc_id, s_suppkey % 10 as tail, (s_suppkey * 3 + 1) % 10 as head, s_suppkey % 4 as low, s_suppkey % 6 as cap from supplier) where low > cap or tail = head""")
def flow_problem_check(s, sf):
    k = F.col("s_suppkey")
    a = v.table(s, sf, "supplier").select(F.concat(F.lit("net"), F.col("s_nationkey") % 5).alias("net"), k.alias("arc_id"), (k % 10).alias("tail"), ((k * 3 + 1) % 10).alias("head"), (k % 4).alias("low"), (k % 6).alias("cap"))
    return fl.check_problem(a).select("net", "why", "arc_id")
