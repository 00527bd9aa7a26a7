"""Queries on citation graphs: closure, views, degrees, co-citation, evidence, folds, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.operators import graph as g
from quillgraph.operators import splits
from quillgraph.plans.registry import Tables, query

r6 = lambda c: F.round(c, 6)


@query("j04_node_closure", "select n.id, coalesce(p.title, cast(n.id as varchar)) as title, coalesce(p.abstract, '') as abstract, p.title is null as stub from nodes n left join parts p on n.id = p.id", "nodes", "parts")
def j04(t: Tables) -> DataFrame:
    return g.close_nodes(t.edges, t.parts)


@query("j05_edge_upsert", """with old as (select * from edges where src % 2 = 0), new as (select src, dst, concat('new ', dst) as sentence, pos from edges where src % 3 = 0)
    select coalesce(o.src, n.src) as src, coalesce(o.dst, n.dst) as dst, coalesce(nullif(trim(o.sentence), ''), nullif(trim(n.sentence), ''), '') as sentence, coalesce(o.pos, n.pos) as pos, o.src is null as added
    from old o full join new n on o.src = n.src and o.dst = n.dst""", "edges")
def j05(t: Tables) -> DataFrame:
    e = t.edges
    return g.upsert_edges(e.filter("src % 2 = 0"), e.filter("src % 3 = 0").withColumn("sentence", F.concat(F.lit("new "), F.col("dst").cast("string"))))


@query("j06_node_upsert", """with old as (select id, title, case when id % 4 = 0 then '' else abstract end as abstract from parts), new as (select o_orderkey as id, o_orderpriority as title, o_orderstatus as abstract from orders)
    select coalesce(o.id, n.id) as id, coalesce(nullif(trim(o.title), ''), nullif(trim(n.title), ''), '') as title, coalesce(nullif(trim(o.abstract), ''), nullif(trim(n.abstract), ''), '') as abstract from old o full join new n on o.id = n.id""", "parts")
def j06(t: Tables) -> DataFrame:
    old = t.parts.select("id", "title", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("abstract")).alias("abstract"))
    new = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract"))
    return g.upsert_nodes(old, new, ("title", "abstract"))


@query("u05_isolate_removal", "select p.id, p.title from parts p where p.id in (select id from nodes)", "parts", "nodes")
def u05(t: Tables) -> DataFrame:
    return g.without_isolates(t.parts.select("id", "title"), t.edges)


@query("a01_graph_stats", """select (select count(*) from nodes) as nodes, (select count(*) from outdeg) as sources, (select count(*) from outdeg where outdeg >= 4) as eligible_sources,
    (select quantile_cont(outdeg, 0.5) from outdeg where outdeg >= 4) as outdeg_p50, (select quantile_cont(outdeg, 0.9) from outdeg where outdeg >= 4) as outdeg_p90, (select max(outdeg) from outdeg) as outdeg_max,
    (select quantile_cont(coalesce(indeg, 0), 0.5) from nodes n left join indeg i on n.id = i.id) as indeg_p50, (select count(*) from edges) as edges,
    (select round(avg(case when trim(sentence) <> '' then 1.0 else 0.0 end), 6) from edges) as sentence_rate""", "nodes", "deg")
def a01(t: Tables) -> DataFrame:
    return g.graph_stats(t.nodes, t.edges, 4).withColumn("sentence_rate", r6("sentence_rate"))


@query("a02_degrees", "select * from deg", "deg")
def a02(t: Tables) -> DataFrame:
    return g.degrees(t.edges)


@query("a02_masked_degrees", "select coalesce(i.id, o.id) as id, cast(coalesce(indeg, 0) as bigint) as indeg, cast(coalesce(outdeg, 0) as bigint) as outdeg from (select dst as id, count(*) as indeg from edges where src not in (select id from months where month >= 200001) group by 1) i full join outdeg o on i.id = o.id", "outdeg", "months")
def a02m(t: Tables) -> DataFrame:
    return g.degrees(t.edges, t.months.filter("month >= 200001"))


@query("a07_sentence_coverage", "select src, round(avg(case when trim(sentence) <> '' then 1.0 else 0.0 end), 6) as coverage, count(*) as n from edges group by 1", "edges")
def a07(t: Tables) -> DataFrame:
    return g.sentence_coverage(t.edges).withColumn("coverage", r6("coverage"))


@query("a08_outdegree_quantiles", "select quantile_cont(outdeg, 0.1) as q10, quantile_cont(outdeg, 0.99) as q99 from outdeg", "outdeg")
def a08(t: Tables) -> DataFrame:
    d = t.edges.groupBy("src").count()
    return d.agg(F.percentile("count", F.lit(0.1)).alias("q10"), F.percentile("count", F.lit(0.99)).alias("q99"))


@query("a14_year_histogram", "select cast(year(o_orderdate) as integer) as year, count(*) as n from orders group by 1")
def a14(t: Tables) -> DataFrame:
    return t.read("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("a15_store_stats", "select source, count(*) as n, sum(case when quality is not null then 1 else 0 end)::bigint as with_topic from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def a15(t: Tables) -> DataFrame:
    d = t.read("documents").join(t.read("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("with_topic"))


@query("a16_topic_vocabulary", """select topic, n, "rank" from (select p_type as topic, count(*) as n, cast(row_number() over (order by count(*) desc, p_type) as bigint) as "rank" from part group by 1) where "rank" <= 24""")
def a16(t: Tables) -> DataFrame:
    c = t.read("part").groupBy(F.col("p_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "topic")).cast("bigint")).filter("rank <= 24")


@query("g05_masked_view", "select src, dst from edges where src not in (select id from months where month >= 200101)", "edges", "months")
def g05(t: Tables) -> DataFrame:
    return g.masked_view(t.edges, t.months.filter("month >= 200101")).select("src", "dst")


@query("g06_frozen_view", "select src, dst from edges where src in (select id from months where month < 199901) and dst in (select id from months where month < 199901)", "edges", "months")
def g06(t: Tables) -> DataFrame:
    return g.frozen_view(t.edges, t.months, 199901).select("src", "dst")


@query("g07_rolling_view", """select q.src as qid, e.src, e.dst from edges q join edges e on q.dst = e.dst and e.src <> q.src join months mq on mq.id = q.src join months me on me.id = e.src where me.month < mq.month""", "edges", "months")
def g07(t: Tables) -> DataFrame:
    return g.rolling_view(t.edges, t.edges.select(F.col("src").alias("qid"), F.col("dst").alias("cid")), t.months)


@query("g08_full_view", "select q.src as qid, count(*) as n from edges q join edges e on q.dst = e.dst and e.src <> q.src group by 1", "edges")
def g08(t: Tables) -> DataFrame:
    return g.full_view(t.edges, t.edges.select(F.col("src").alias("qid"), F.col("dst").alias("cid"))).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@query("g09_view_dispatch", "select q.src as qid, count(*) as n from edges q join (select * from edges where src in (select id from months where month < 200001) and dst in (select id from months where month < 200001)) e on q.dst = e.dst and e.src <> q.src group by 1", "edges", "months")
def g09(t: Tables) -> DataFrame:
    return g.view("frozen", t.edges, t.edges.select(F.col("src").alias("qid"), F.col("dst").alias("cid")), t.months, 200001).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@query("g11_graph_check", """select 'self_loops' as "check", count(*) filter (where l_orderkey = l_partkey) as n from lineitem union all select 'parallel_edges', count(*) from (select 1 from lineitem group by l_orderkey, l_partkey having count(*) > 1)
    union all select 'unknown_ends', count(*) from (select l_orderkey as id from lineitem union all select l_partkey from lineitem) where id not in (select p_partkey from part) union all select 'double_ids', 0""")
def g11(t: Tables) -> DataFrame:
    return g.graph_problems(t.read("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), t.parts)


@query("g15_evidence_pool", "select dst, src, sentence, pos from edges where trim(sentence) <> ''", "edges")
def g15(t: Tables) -> DataFrame:
    return g.evidence_pool(t.edges)


_EVIDENCE = """with p as (select e.dst, e.src, e.sentence, m.month, {order} as i, count(*) over (partition by dst) as n from edges e left join months m on m.id = e.src where trim(sentence) <> '')
    select dst, src, sentence, {ord} as ord from p where {cond}"""


@query("w37_evidence_recent", _EVIDENCE.format(order="row_number() over (partition by dst order by m.month nulls first, src) - 1", ord="n - i", cond="n - i <= 3"), "edges", "months")
def w37r(t: Tables) -> DataFrame:
    return g.selected_evidence(_pool(t), "recent").select("dst", "src", "sentence", "ord")


@query("w37_evidence_spread", _EVIDENCE.format(order="row_number() over (partition by dst order by m.month nulls first, src) - 1", ord="i // greatest(1, n // 3) + 1", cond="i % greatest(1, n // 3) = 0 and i // greatest(1, n // 3) < 3"), "edges", "months")
def w37s(t: Tables) -> DataFrame:
    return g.selected_evidence(_pool(t), "spread").select("dst", "src", "sentence", "ord")


@query("w38_evidence_stride", _EVIDENCE.format(order="row_number() over (partition by dst order by pos) - 1", ord="i // greatest(1, n // 3) + 1", cond="i % greatest(1, n // 3) = 0 and i // greatest(1, n // 3) < 3"), "edges", "months")
def w38(t: Tables) -> DataFrame:
    return g.selected_evidence(_pool(t), "stride").select("dst", "src", "sentence", "ord")


def _pool(t: Tables) -> DataFrame:
    return g.evidence_pool(t.edges).join(t.months.withColumnRenamed("id", "src"), "src", "left")


@query("p14_citer_time", """select when_cited, count(*) as n from (select case when me.month is null or md.month is null then 'unknown' when me.month < md.month then 'prior' when me.month = md.month then 'same' else 'later' end as when_cited
    from edges e left join months me on me.id = e.src left join months md on md.id = e.dst) group by 1""", "edges", "months")
def p14(t: Tables) -> DataFrame:
    m = t.months
    e = t.edges.join(m.select(F.col("id").alias("src"), F.col("month").alias("ms")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("month").alias("md")), "dst", "left")
    return e.groupBy(ids.citer_time(F.col("ms"), F.col("md")).alias("when_cited")).agg(F.count(F.lit(1)).alias("n"))


@query("p15_masked_citers", "select id from months where month >= 200106 union select o_orderkey from orders where o_orderstatus = 'F'", "months")
def p15(t: Tables) -> DataFrame:
    return t.months.filter("month >= 200106").select("id").union(t.read("orders").filter("o_orderstatus = 'F'").select("o_orderkey")).distinct()


@query("p24_log_degrees", "select id, round(ln(1 + indeg), 6) as log_indeg, round(ln(1 + outdeg), 6) as log_outdeg from deg", "deg")
def p24(t: Tables) -> DataFrame:
    return g.degrees(t.edges).select("id", r6(F.log1p("indeg")).alias("log_indeg"), r6(F.log1p("outdeg")).alias("log_outdeg"))


@query("j12_two_hop_counts", "select e1.src, e2.dst, count(*) as paths from edges e1 join edges e2 on e1.dst = e2.src where e1.src <> e2.dst group by 1, 2", "edges")
def j12(t: Tables) -> DataFrame:
    return g.two_hop(t.edges.select("src", "dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("paths"))


@query("j13_induced_subgraph", "select src, dst from edges where src in (select id from parts) and dst in (select id from parts)", "edges", "parts")
def j13(t: Tables) -> DataFrame:
    return g.induced(t.edges, t.parts).select("src", "dst")


@query("j14_target_edge_removal", "select src, dst from edges e where not exists (select 1 from lineitem l where l.l_returnflag = 'R' and l.l_orderkey = e.src and l.l_partkey = e.dst)", "edges")
def j14(t: Tables) -> DataFrame:
    targets = t.read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return g.without_targets(t.edges, targets).select("src", "dst")


@query("j18_later_cocited", """select distinct q.dst as query, r.dst as cited from edges q join months mc on mc.id = q.src join months mq on mq.id = q.dst and mc.month > mq.month join edges c on c.src = q.src join edges r on r.src = q.dst and r.dst = c.dst""", "edges", "months")
def j18(t: Tables) -> DataFrame:
    return g.later_cocited(t.edges, t.months)


@query("a05_cocitation", """with p as (select a.dst as i, b.dst as j, count(*) as w from edges a join edges b on a.src = b.src and a.dst <> b.dst group by 1, 2), r as (select *, row_number() over (partition by i order by w desc, j) as rn from p) select i, j, w from r where rn <= 64""", "edges")
def a05(t: Tables) -> DataFrame:
    return g.cocitations(t.edges)


@query("g13_fold_out", "with k as (select unnest([0, 1, 2]) as fold) select fold, src, dst from edges cross join k where src % 3 <> fold", "edges")
def g13(t: Tables) -> DataFrame:
    e = t.edges
    return g.fold_out(e, e.select(F.col("src").alias("id"), (F.col("src") % 3).cast("int").alias("fold")).distinct())


@query("w50_expansion_order", """with c as (select id, indeg, row_number() over (order by indeg desc, id) as ord from deg where indeg >= 1 and outdeg = 0) select id, indeg, ord from c where ord <= 100""", "deg")
def w50(t: Tables) -> DataFrame:
    return g.expansion_candidates(t.nodes, t.edges, None, 100).select("id", "indeg", "ord")


@query("x01_admit_and_split", """with od as (select src, count(*) as n, avg(case when trim(sentence) <> '' then 1.0 else 0.0 end) as cov from edges group by 1 having count(*) >= 4),
    cov as (select * from od where cov >= 0.5), q as (select quantile_cont(n, 0.1) as lo, quantile_cont(n, 0.99) as hi from cov), adm as (select c.src, m.month from cov c cross join q join months m on m.id = c.src where m.month is not null and n between lo and hi),
    f as (select min(month) as first from (select distinct month from adm order by month desc limit 2)), rest as (select src, month, row_number() over (order by month desc, src desc) as rn, count(*) over () as n from adm, f where month < first)
    select src as source_id, 'frontier' as split from adm, f where month >= first union all select src, case when rn <= ceil(n * 0.1) then 'test' else 'train' end from rest""", "edges", "months")
def x01(t: Tables) -> DataFrame:
    return splits.admit_and_split(t.edges, t.months, k=4, coverage=0.5, quantiles=(0.1, 0.99), frontier_months=2, test_share=0.1)


@query("x02_month_split", """with c as (select month, count(*) as n from months where month is not null group by 1), r as (select month, sum(n) over (order by month desc) - n as newer, (select sum(n) from c) as total from c)
    select m.id, case when r.newer < round_even(r.total * 0.25, 0) then 'dev' else 'train' end as split from months m join r on m.month = r.month""", "months")
def x02(t: Tables) -> DataFrame:
    return splits.month_split(t.months.filter("month is not null"), 0.25)


@query("x04_eligible_gold", "select e.src as qid, e.dst as gid from edges e join months q on q.id = e.src join months c on c.id = e.dst where c.month < q.month", "edges", "months")
def x04(t: Tables) -> DataFrame:
    return splits.eligible_gold(t.edges.select(F.col("src").alias("qid"), F.col("dst").alias("gid")), t.months)


@query("x14_stable_shuffle", "select o_orderkey as id, cast(row_number() over (order by sha1(concat('s', o_orderkey)), o_orderkey) as bigint) as ord from orders")
def x14(t: Tables) -> DataFrame:
    o = t.read("orders").select(F.col("o_orderkey").alias("id"))
    return splits.stable_shuffle(o, "s")


@query("x16_modulo_shards", "select o_orderkey % 7 as shard, count(*) as n from orders group by 1")
def x16(t: Tables) -> DataFrame:
    return t.read("orders").groupBy((F.col("o_orderkey") % 7).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("j21_leak_check", """select 'train_test' as pair, count(*) as n from (select id from months where id % 3 = 0 intersect select id from months where id % 5 = 0)
    union all select 'train_frontier', count(*) from (select id from months where id % 3 = 0 intersect select id from months where month >= 200101) union all select 'test_frontier', count(*) from (select id from months where id % 5 = 0 intersect select id from months where month >= 200101)""", "months")
def j21(t: Tables) -> DataFrame:
    m = t.months
    return splits.leaks({"train": m.filter("id % 3 = 0"), "test": m.filter("id % 5 = 0"), "frontier": m.filter("month >= 200101")})


@query("a33_most_gold_row", "select src, sentence, n from (select l_orderkey as src, concat(l_returnflag, l_linestatus) as sentence, cast(l_quantity as bigint) as n, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as rn from lineitem) where rn = 1")
def a33(t: Tables) -> DataFrame:
    l = t.read("lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), "l_linenumber", "l_partkey", "l_suppkey")
    return l.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("l_orderkey").alias("src"), F.concat("l_returnflag", "l_linestatus").alias("sentence"), F.col("l_quantity").cast("bigint").alias("n"))


@query("a34_gold_union", "select src, array_to_string(list_sort(list(distinct dst)), ',') as gold, count(distinct dst) as n from edges group by 1", "edges")
def a34(t: Tables) -> DataFrame:
    return t.edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("g")).select("src", F.array_join("g", ",").alias("gold"), F.size("g").cast("bigint").alias("n"))


@query("a39_domain_stats", "select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from outdeg) as seeds", "nodes", "outdeg")
def a39(t: Tables) -> DataFrame:
    e = t.edges
    return t.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("seeds")))


@query("d01_date_windows", """select min(d) as w_first, max(d) as w_last, count(*) as days from (select d, datediff('day', (select min(cast(o_orderdate as date)) from orders), d) // 30 as k from (select cast(unnest(generate_series((select min(cast(o_orderdate as date)) from orders), (select max(cast(o_orderdate as date)) from orders), interval 1 day)) as date) as d)) group by k""")
def d01(t: Tables) -> DataFrame:
    s = t.read("orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    w = s.select(F.explode(ids.date_windows(F.col("a"), F.col("b"), 30)).alias("w"))
    return w.select(F.col("w.first").alias("w_first"), F.col("w.last").alias("w_last"), (F.datediff("w.last", "w.first") + 1).cast("bigint").alias("days"))


@query("d03_frozen_cutoff", "select min(month) as cutoff, count(*) filter (where month is null) as undated from months", "months")
def d03(t: Tables) -> DataFrame:
    return t.months.agg(F.min("month").alias("cutoff"), F.count_if(F.col("month").isNull()).alias("undated"))
