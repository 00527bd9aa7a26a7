"""Queries on text columns, stores, merges and incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.functions import text as tx
from quillgraph.functions import vectors as vx
from quillgraph.operators import greedy, resolve, upserts
from quillgraph.plans.registry import Tables, query

r6 = lambda c: F.round(c, 6)
_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) > 2 and x not in (" + _STOPS + ")))"


@query("p01_canonical_id", "select o_orderkey, case when o_orderkey % 2 = 0 then concat('21', lpad(cast(o_orderkey % 12 + 1 as varchar), 2, '0'), '.', lpad(cast(o_orderkey as varchar), 5, '0')) else concat('hep-th/99', lpad(cast(o_orderkey % 12 + 1 as varchar), 2, '0'), lpad(cast(o_orderkey % 1000 as varchar), 3, '0')) end as id from orders")
def p01(t: Tables) -> DataFrame:
    return _ids(t).select("o_orderkey", ids.canonical_id(F.col("raw")).alias("id"))


def _ids(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    mm = F.lpad((k % 12 + 1).cast("string"), 2, "0")
    modern = F.concat(F.lit(" arXiv:21"), mm, F.lit("."), F.lpad(k.cast("string"), 5, "0"), F.lit("v2"))
    legacy = F.concat(F.lit("https://arxiv.org/abs/hep-th/99"), mm, F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("v1 "))
    return t.read("orders").select(k, F.when(k % 2 == 0, modern).otherwise(legacy).alias("raw"))


@query("p02_id_month", "select o_orderkey, cast(case when o_orderkey % 2 = 0 then 2021 else 1999 end * 100 + o_orderkey % 12 + 1 as integer) as month from orders")
def p02(t: Tables) -> DataFrame:
    return _ids(t).select("o_orderkey", ids.id_month(F.col("raw")).alias("month"))


@query("p05_gate_year", "select o_orderkey, case when o_orderkey % 2 = 0 then 2021 end::integer as year from orders")
def p05(t: Tables) -> DataFrame:
    return _ids(t).select("o_orderkey", ids.gate_year(ids.canonical_id(F.col("raw"))).cast("int").alias("year"))


@query("p04_month_text", "select id, case when month is not null then concat(month // 100, '-', lpad(cast(month % 100 as varchar), 2, '0')) end as month_text from months", "months")
def p04(t: Tables) -> DataFrame:
    return t.months.select("id", F.when(F.col("month").isNotNull(), ids.month_text(F.col("month"))).alias("month_text"))


@query("p07_year_window", "select count(*) filter (where month // 100 >= 1998) as kept, count(*) filter (where month // 100 < 1998) as dropped_old, count(*) filter (where month is null) as dropped_unknown from months", "months")
def p07(t: Tables) -> DataFrame:
    y = F.floor(F.col("month") / 100)
    return t.months.agg(F.count_if(y >= 1998).alias("kept"), F.count_if(y < 1998).alias("dropped_old"), F.count_if(F.col("month").isNull()).alias("dropped_unknown"))


@query("p08_topic_filter", "select p_partkey from part where p_brand = 'Brand#11' and p_size > 10")
def p08(t: Tables) -> DataFrame:
    p = t.read("part").withColumn("l1", F.array("p_brand"))
    return p.filter(F.array_contains("l1", "Brand#11") & (F.col("p_size") > 10)).select("p_partkey")


@query("p09_degree_filter", "select n.id from deg n join months m on m.id = n.id where indeg >= 20 and month // 100 between 1996 and 2000", "deg", "months")
def p09(t: Tables) -> DataFrame:
    from quillgraph.operators.graph import degrees

    return degrees(t.edges).filter("indeg >= 20").join(t.months.filter("floor(month / 100) between 1996 and 2000"), "id").select("id")


@query("p12_flat_text", "select doc_id, length(trim(regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) as n from documents")
def p12(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.length(tx.flat(F.col("text"))).cast("bigint").alias("n"))


@query("p17_keyword_rate", "select lang, round(avg(case when contains(lower(text), 'the') or contains(lower(text), 'der') then 1.0 else 0.0 end), 6) as rate from documents group by 1")
def p17(t: Tables) -> DataFrame:
    hit = F.exists(F.array(F.lit("the"), F.lit("der")), lambda k: F.lower("text").contains(k))
    return t.read("documents").groupBy("lang").agg(r6(F.avg(F.when(hit, 1.0).otherwise(0.0))).alias("rate"))


@query("p26_search_projection", "select p.id, p.title, substr(p.abstract, 1, 500) as abstract, coalesce(d.indeg, 0)::bigint as indeg, n.id is not null as in_domain from parts p left join deg d on d.id = p.id left join nodes n on n.id = p.id", "parts", "deg", "nodes")
def p26(t: Tables) -> DataFrame:
    from quillgraph.operators.graph import degrees

    p = t.parts.join(degrees(t.edges), "id", "left").join(t.nodes.withColumn("in_domain", F.lit(True)), "id", "left")
    return p.select("id", "title", F.substring("abstract", 1, 500).alias("abstract"), F.coalesce("indeg", F.lit(0)).alias("indeg"), F.coalesce("in_domain", F.lit(False)).alias("in_domain"))


@query("t01_inverted_index", "select term, count(*) as df, sum(tf)::bigint as cf from (select term, doc_id, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) group by 1, 2) group by 1")
def t01(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("t04_token_sets", "select item_id, len(" + _TOK.format(c="text") + ") as n from benchmark")
def t04(t: Tables) -> DataFrame:
    return t.read("benchmark").select("item_id", F.size(tx.token_set(F.col("text"))).cast("bigint").alias("n"))


@query("u04_token_jaccard", "with b as (select item_id, " + _TOK.format(c="text") + " as s from benchmark) select a.item_id as a, b.item_id as b, round(case when len(list_distinct(list_concat(a.s, b.s))) > 0 then len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) else 0 end, 6) as j from b a join b on a.item_id = b.item_id + 1")
def u04(t: Tables) -> DataFrame:
    b = t.read("benchmark").select("item_id", tx.token_set(F.col("text")).alias("s"))
    o = b.select((F.col("item_id") + 1).alias("item_id"), F.col("item_id").alias("b"), F.col("s").alias("sb"))
    return b.join(o, "item_id").select(F.col("item_id").alias("a"), "b", r6(vx.jaccard(F.col("s"), F.col("sb"))).alias("j"))


@query("i01_merge_snapshot", """with o as (select doc_id as id, source as title, n_chars as update_date from documents where doc_id % 2 = 0), n as (select doc_id as id, concat('new ', lang) as title, case when doc_id % 4 = 0 then n_chars - 1 else n_chars + 1 end as update_date from documents where doc_id % 3 = 0)
    select coalesce(o.id, n.id) as id, case when n.id is not null and (o.id is null or n.update_date >= o.update_date) then n.title else o.title end as title, case when n.id is not null and (o.id is null or n.update_date >= o.update_date) then n.update_date else o.update_date end as update_date from o full join n on o.id = n.id""")
def i01(t: Tables) -> DataFrame:
    return upserts.merged_snapshot(*_snapshots(t))


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.read("documents")
    old = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("n_chars").alias("update_date"))
    new = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("new "), "lang").alias("title"), F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars") + 1).alias("update_date"), F.col("doc_id").alias("seq"))
    return old, new


@query("i01_merge_counts", "select count(*) filter (where doc_id % 2 <> 0) as added, count(*) filter (where doc_id % 2 = 0 and doc_id % 4 <> 0) as updated from documents where doc_id % 3 = 0")
def i01c(t: Tables) -> DataFrame:
    return upserts.merge_counts(*_snapshots(t))


@query("i02_bulk_upsert", "select doc_id as id, source as title, n_chars as update_date from documents where doc_id % 2 = 0 and doc_id % 3 <> 0 union all select doc_id, concat('new ', lang), case when doc_id % 4 = 0 then n_chars - 1 else n_chars + 1 end from documents where doc_id % 3 = 0")
def i02(t: Tables) -> DataFrame:
    old, new = _snapshots(t)
    return upserts.bulk_upsert(old, new.drop("seq"))


@query("i03_topic_merge", "with o as (select doc_id as id, source as title, 'x' as topic from documents where doc_id % 2 = 0), n as (select doc_id as id, concat('t', quality) as topic from labels) select coalesce(o.id, n.id) as id, coalesce(o.title, cast(n.id as varchar)) as title, coalesce(n.topic, o.topic) as topic from o full join n on o.id = n.id")
def i03(t: Tables) -> DataFrame:
    old = t.read("documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("x").alias("topic"))
    return upserts.merged_topics(old, t.read("labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("t"), F.col("quality").cast("string")).alias("topic")))


@query("i04_field_merge", """with o as (select doc_id as id, source as title, lang as abstract, n_chars as update_date from documents where doc_id % 2 = 0), n as (select doc_id as id, case when doc_id % 5 = 0 then '' else concat('new ', lang) end as title, '' as abstract, case when doc_id % 4 = 0 then n_chars - 1 else n_chars + 1 end as update_date from documents where doc_id % 3 = 0), j as (select coalesce(o.id, n.id) as id, o.title as ot, n.title as nt, o.abstract as oa, n.abstract as na, o.update_date as ov, n.update_date as nv from o full join n on o.id = n.id)
    select id, case when nv < ov then ot else coalesce(nullif(nt, ''), ot, '') end as title, case when nv < ov then oa else coalesce(nullif(na, ''), oa, '') end as abstract, greatest(ov, nv) as update_date, case when nv is null then 'old' when ov is null then 'new' when nv < ov then 'old' else 'both' end as origin from j""")
def i04(t: Tables) -> DataFrame:
    d = t.read("documents")
    old = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("abstract"), F.col("n_chars").alias("update_date"))
    new = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("new "), "lang")).alias("title"), F.lit("").alias("abstract"), F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars") + 1).alias("update_date"))
    return upserts.merged_fields(old, new, ("title", "abstract"))


@query("i07_sync_state", "select event_type as key, cast(max(event_id) as varchar) as value from events group by 1")
def i07(t: Tables) -> DataFrame:
    e = t.read("events")
    state = t.spark.sql("select cast(null as string) as key, cast(null as string) as value where false")
    return upserts.put_state(state, e.select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq")))


@query("j08_batched_lookup", "select doc_id, source from documents where doc_id in (select doc_id from labels)")
def j08(t: Tables) -> DataFrame:
    return t.read("documents").join(t.read("labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("j09_missing_topics", "select doc_id as id from documents where doc_id not in (select doc_id from labels)")
def j09(t: Tables) -> DataFrame:
    return upserts.missing_from(t.read("documents").select(F.col("doc_id").alias("id")), t.read("labels").select(F.col("doc_id").alias("id")))


@query("j07_coalesced_lookup", "select o.o_orderkey as id, coalesce(nullif(trim(p.title), ''), o.o_orderpriority) as title from orders o left join parts p on p.id = o.o_orderkey", "parts")
def j07(t: Tables) -> DataFrame:
    o = t.read("orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return o.join(t.parts.select("id", "title"), "id", "left").select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "o_orderpriority").alias("title"))


@query("s04_topic_override", "with b as (select doc_id as id, source as topic from documents where doc_id % 2 = 0), s as (select doc_id as id, lang as topic from documents where doc_id % 3 = 0) select coalesce(b.id, s.id) as id, coalesce(s.topic, b.topic) as topic from b full join s on b.id = s.id")
def s04(t: Tables) -> DataFrame:
    d = t.read("documents")
    return upserts.overridden(d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("topic")), d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic")), ("topic",))


@query("s33_unit_vectors", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5) as before, 1.0::double as after from embeddings")
def s33(t: Tables) -> DataFrame:
    v = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.round(vx.dot(F.col("v"), F.col("v")), 5).alias("before"), F.round(vx.norm(vx.unit(F.col("v"))), 9).alias("after"))


@query("s34_topic_vector_sum", "select vec_id, round(2 * list_sum(list_transform(embedding, lambda x: x::double)), 5) as total from embeddings")
def s34(t: Tables) -> DataFrame:
    v = F.col("v")
    return t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", F.round(F.aggregate(vx.added(v, v), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("s35_gap_fill_ladder", "select doc_id as id, case when doc_id % 5 = 0 then source when doc_id % 3 = 0 then lang else 'x' end as value, case when doc_id % 5 = 0 then 0 when doc_id % 3 = 0 then 1 else 2 end::integer as step from documents")
def s35(t: Tables) -> DataFrame:
    d = t.read("documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return upserts.first_of([d.filter("id % 5 = 0").select("id", F.col("source").alias("value")), d.filter("id % 3 = 0").select("id", F.col("lang").alias("value")), d.select("id", F.lit("x").alias("value"))], "value")


def _title_key_sql(c: str) -> str:
    """The rule of title_key over a text expression."""
    for k, v in tx.GREEK.items():
        c = f"replace({c}, '{k}', ' {v} ')"
    names = tx.SIGNS | {f"\\{v}": v for v in tx.GREEK.values()} | {f"\\var{v}": v for v in tx.GREEK.values()}
    cases = " ".join(f"when w = '{k}' then '{v}'" for k, v in names.items())
    return f"array_to_string(list_filter(list_transform(regexp_extract_all({c}, '{tx._TITLE_TOKEN}'), lambda w: case {cases} when starts_with(w, '\\') then null else lower(w) end), lambda w: w is not null), ' ')"


_TITLE = "concat('The $\\pi_{0.5}$ ', p_name, ' for ε-nets: SE(3) \\emph{Nets} \\& ', p_type, '\\% of ', p_brand, '’s 3\\times3 Self-Made \\textbf{Way}, May 2019')"


@query("f01_title_key", f"select p_partkey, {_title_key_sql(_TITLE)} as key from part union all select 1000000 + doc_id, {_title_key_sql('text')} from documents")
def f01(t: Tables) -> DataFrame:
    made = F.concat(F.lit("The $\\pi_{0.5}$ "), "p_name", F.lit(" for ε-nets: SE(3) \\emph{Nets} \\& "), "p_type", F.lit("\\% of "), "p_brand", F.lit("’s 3\\times3 Self-Made \\textbf{Way}, May 2019"))
    parts = t.read("part").select("p_partkey", tx.title_key(made).alias("key"))
    return parts.unionByName(t.read("documents").select((F.col("doc_id") + 1_000_000).alias("p_partkey"), tx.title_key(F.col("text")).alias("key")))


@query("f02_marked_id", "select o_orderkey, case when o_orderkey % 3 <> 0 then concat('2410.', lpad(cast(o_orderkey % 100000 as varchar), 5, '0')) end as id from orders")
def f02(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    n = F.concat(F.lit("2410."), F.lpad((k % 100000).cast("string"), 5, "0"))
    text = F.when(k % 3 == 0, F.concat(F.lit("vol. "), n)).when(k % 3 == 1, F.concat(F.lit("arXiv preprint arXiv:"), n)).otherwise(F.concat(F.lit("eprint no. "), n))
    return t.read("orders").select(k, tx.marked_id(text).alias("id"))


@query("f04_sentence_flags", "select doc_id, case when trim(text) = '' then 'empty' else concat_ws(',', case when length(trim(text)) > 900 then 'too_long' end, case when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 8 then 'too_few_letters' end) end as flags from documents")
def f04(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.array_join(tx.sentence_flags(F.col("text")), ",").alias("flags"))


@query("f08_unified_cites", r"select doc_id, regexp_replace(concat('\citep*{', source, '} and \textcite{', lang, '}'), '\\(citep\*|textcite)', '\\cite', 'g') as tex from documents")
def f08(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", tx.unified_cites(F.concat(F.lit("\\citep*{"), "source", F.lit("} and \\textcite{"), "lang", F.lit("}"))).alias("tex"))


@query("a28_flag_rollup", "with f as (select case when trim(text) = '' then 'empty' when length(trim(text)) > 900 then 'too_long' end as flag from documents union all select case when trim(text) <> '' and length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 8 then 'too_few_letters' end from documents) select flag, count(*) as n from f where flag is not null group by 1")
def a28(t: Tables) -> DataFrame:
    return t.read("documents").select(F.explode(tx.sentence_flags(F.col("text"))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("j02_prioritised_lookup", """with k as (select p_partkey as id, 1 as prio, p_name as key from part union all select p_partkey, 2, p_type from part), x as (select p_name as key, min(p_partkey) as hit from part group by 1 union all select p_type, max(p_partkey) from part group by 1)
    select id, arg_min(hit, prio) as hit, min(prio)::integer as prio from k join x using (key) group by 1""")
def j02(t: Tables) -> DataFrame:
    p = t.read("part")
    keys = p.select(F.col("p_partkey").alias("id"), F.posexplode(F.array("p_name", "p_type")).alias("prio", "key")).withColumn("prio", F.col("prio") + 1)
    index = p.groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("hit")).union(p.groupBy("p_type").agg(F.max("p_partkey")))
    return resolve.first_hit(keys, index)


_CUT = "regexp_replace(text, ' [^ ]+$', '')"


@query("j20_near_titles", "with b as (select item_id, " + _TOK.format(c="text") + " as s from benchmark union all select item_id + 100000, " + _TOK.format(c=_CUT) + " from benchmark) select a.item_id as a, b.item_id as b from b a join b on a.item_id < b.item_id where len(list_intersect(a.s, b.s)) >= 1 and len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.8")
def j20(t: Tables) -> DataFrame:
    """Every text, and once more without its last word."""
    b = t.read("benchmark").select(F.col("item_id").alias("id"), "text")
    b = b.unionByName(b.select((F.col("id") + 100_000).alias("id"), F.regexp_replace("text", " [^ ]+$", "").alias("text")))
    return resolve.jaccard_pairs(b.select("id", tx.token_set(F.col("text")).alias("s")), 0.8)


@query("w35_exact_title_dedupe", "select p_brand as qid, min(p_partkey) as cid, p_name as title from part group by 1, 3")
def w35(t: Tables) -> DataFrame:
    p = t.read("part")
    return p.groupBy(F.col("p_brand").alias("qid"), F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("cid")).select("qid", "cid", "title")


@query("s11_row_digests", "select doc_id, sha256(text) as digest from documents")
def s11(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("a24_latency_quantiles", "select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(sum(value), 4) as total, max(value) as largest from events group by 1")
def a24(t: Tables) -> DataFrame:
    p = lambda q: r6(F.percentile("value", F.lit(q)))
    return t.read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest"))


@query("s26_key_coverage", "select source, count(*) as n from documents group by 1")
def s26(t: Tables) -> DataFrame:
    return t.read("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
