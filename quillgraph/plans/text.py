"""Queries on text functions, bibliographies and graphs built from LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import latex
from quillgraph.functions import text as tx
from quillgraph.operators import build, greedy
from quillgraph.plans.registry import Tables, paper_id, query, short_id

r6 = lambda c: F.round(c, 6)
_SURVEY = r"(?i)\b(survey|overview|tutorial|systematic review|literature review|comprehensive review|critical review|review of)\b"


@query("p10_survey_titles", "with t as (select p_partkey, concat(p_name, case p_partkey % 4 when 0 then ': a Survey' when 1 then ' surveyed' when 2 then ' - an OVERVIEW of x' else '' end) as title from part) select p_partkey, regexp_matches(title, '" + _SURVEY + "') as survey from t")
def p10(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    title = F.concat("p_name", F.when(k == 0, ": a Survey").when(k == 1, " surveyed").when(k == 2, " - an OVERVIEW of x").otherwise(""))
    return t.read("part").select("p_partkey", tx.survey_title(title).alias("survey"))


@query("p11_title_exclusion", "select p_partkey, lower(p_name) = 'x' or (least(length(p_name), 40) >= 24 and contains('a title that is long enough to hold others', lower(p_name))) or (length(p_name) >= 1 and lower(p_name) = lower(p_type)) as excluded from part")
def p11(t: Tables) -> DataFrame:
    out = tx.title_excluded(F.col("p_name"), F.lit("a title that is long enough to hold others")) | (tx.flat(F.col("p_name")) == "x") | (tx.flat(F.col("p_name")) == tx.flat(F.col("p_type")))
    return t.read("part").select("p_partkey", out.alias("excluded"))


@query("p16_candidate_text", "select p_partkey, substr(concat(p_name, chr(10), substr(p_type, 1, 5), chr(10), 'Cite: ', p_brand, chr(10), 'Cite: ', p_name), 1, 40) as text from part")
def p16(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", tx.candidate_text(F.col("p_name"), F.col("p_type"), F.array("p_brand", "p_name"), 5, 40).alias("text"))


@query("p18_rank_annotation", "select l_orderkey, l_linenumber, l_partkey, coalesce(case when l_linenumber % 2 = 0 then l_linenumber end, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))::integer as rank from lineitem")
def p18(t: Tables) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")), pos).alias("rank"))


@query("p20_topic_label", "select doc_id, case when contains(lower(text), 'idiot') then 'rude' when source = 'src1' then 'first' when source = 'src2' then 'second' else 'other' end as topic from documents")
def p20(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", tx.topic_label(F.concat(F.lit("zz "), "source"), F.col("text"), {"src1": "first", "src2": "second"}, {"idiot": "rude"}).alias("topic"))


@query("p21_query_terms", r"select item_id, len(regexp_extract_all(text, '[\w.-]+')) as n from benchmark")
def p21(t: Tables) -> DataFrame:
    return t.read("benchmark").select("item_id", F.size(tx.fts_query_terms(F.col("text"))).cast("bigint").alias("n"))


@query("f03_clean_sentences")
def f03(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("\\textbf{We} follow "), "source", F.lit(" \\citep{a, b} % note\n\\label{x} and "), "text")
    return t.read("documents").select("doc_id", latex.cleaned(raw).alias("c")).select("doc_id", "c.*")


@query("f14_section_titles", "select doc_id, case doc_id % 3 when 0 then true else false end as intro, case doc_id % 3 when 1 then true else false end as related from documents")
def f14(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    title = F.when(k == 0, "1. \\textbf{Introduction}").when(k == 1, "II Related Work").otherwise("Method")
    return t.read("documents").select("doc_id", tx.intro_title(title).alias("intro"), tx.related_title(title).alias("related"))


@query("f25_bundle_parser", "select item_id, concat('T', item_id) as title, concat('2401.', lpad(cast(item_id as varchar), 5, '0')) as id, 'c' as cite from benchmark union all select item_id, 'Other', '', 'd' from benchmark")
def f25(t: Tables) -> DataFrame:
    i = F.col("item_id")
    text = F.concat(F.lit("1. Title: T"), i.cast("string"), F.lit("\n   arXiv: 2401."), F.lpad(i.cast("string"), 5, "0"), F.lit("\n   Cite: c\n2. Title: Other\n   Cite: d\n"))
    return t.read("benchmark").select("item_id", F.explode(tx.bundle_entries(text)).alias("e")).select("item_id", "e.*")


@query("f27_analysis_parser", "select item_id, case when item_id % 2 = 0 then 'core' end as relevance, item_id % 2 = 0 as ok from benchmark")
def f27(t: Tables) -> DataFrame:
    text = F.when(F.col("item_id") % 2 == 0, 'Relevance: Core\nReason: it says so').otherwise("no idea")
    return t.read("benchmark").select("item_id", tx.analysis_fields(text).alias("a")).select("item_id", "a.relevance", "a.ok")


@query("f33_ranked_id_repair", "select item_id, case when item_id % 2 = 0 then 'x,y' else '2401.00001,2401.00002' end as ids from benchmark")
def f33(t: Tables) -> DataFrame:
    text = F.when(F.col("item_id") % 2 == 0, '{"ranked_ids": ["x", "y"]}').otherwise('{"ranked_ids": [2401.00001, then 2401.00002')
    return t.read("benchmark").select("item_id", F.array_join(tx.ranked_ids(text), ",").alias("ids"))


@query("g01_seed_graph", "select concat('o', l_orderkey) as src, concat('2401.', lpad(cast(l_partkey as varchar), 5, '0')) as dst, concat('We use \\cite{k', l_partkey, '} in this work.') as sentence from lineitem group by l_orderkey, l_partkey")
def g01(t: Tables) -> DataFrame:
    """Papers whose LaTeX cites their parts by key; the bibliography names even parts by id and odd ones by title."""
    title = lambda c: F.concat(F.lit("On \\emph{part} "), c.cast("string"), F.lit(" and its $\\alpha_2$ Makers"))
    entry = lambda n: F.when(n % 2 == 0, F.concat(F.lit("Some title. \\newblock arXiv:"), paper_id(n))).otherwise(F.concat(title(n), F.lit(". \\newblock A Press")))
    key = lambda n: F.concat(F.lit("k"), n.cast("string"))
    each = lambda f: F.sort_array(F.transform("n", f))
    # numbers are sent, and texts made of them behind that
    papers = t.read("lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("n"))
    s = each(lambda n: F.concat(F.lit("We use \\cite{"), key(n), F.lit("} in this work.")))
    b = each(lambda n: F.concat(F.lit("\\bibitem{"), key(n), F.lit("} A. Author. \\newblock "), entry(n)))
    tex = F.concat(F.array_join(s, " "), F.lit(" \\begin{thebibliography} "), F.array_join(b, " "), F.lit(" \\end{thebibliography}"))
    papers = papers.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), tex.alias("tex"))
    parts = t.read("part").select("p_partkey", paper_id(F.col("p_partkey")).alias("id"))
    return build.cited_edges(papers, parts.select(tx.title_key(title(F.col("p_partkey"))).alias("title_key"), "id"), parts.select("id")).select("src", short_id(F.col("dst")).alias("dst"), "sentence")


@query("a17_monthly_recall", "with m as (select month, count(*) as n from months where month is not null group by 1) select month, n, round(n / sum(n) over (), 6) as share from m", "months")
def a17(t: Tables) -> DataFrame:
    m = t.months.filter("month is not null").groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return m.select("month", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("a31_set_precision_recall", "select src as qid, round(count(*) filter (where dst % 2 = 0 and dst % 3 = 0) / greatest(1, count(*) filter (where dst % 2 = 0)), 6) as precision, round(count(*) filter (where dst % 2 = 0 and dst % 3 = 0) / greatest(1, count(*) filter (where dst % 3 = 0)), 6) as recall from edges group by 1", "edges")
def a31(t: Tables) -> DataFrame:
    p, g = F.col("dst") % 2 == 0, F.col("dst") % 3 == 0
    n = lambda c: F.greatest(F.lit(1), F.count_if(c))
    return t.edges.groupBy(F.col("src").alias("qid")).agg(r6(F.count_if(p & g) / n(p)).alias("precision"), r6(F.count_if(p & g) / n(g)).alias("recall"))


@query("a38_weighted_mean", "select l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) as mean from lineitem group by 1")
def a38(t: Tables) -> DataFrame:
    return t.read("lineitem").groupBy("l_returnflag").agg(r6(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("mean"))


@query("a09_split_stats", "with s as (select case when month >= 200101 then 'new' else 'old' end as split, outdeg, indeg from deg join months m on m.id = deg.id where month is not null) select split, count(*) as n, round(avg(outdeg), 6) as mean_out, median(outdeg) as median_out, round(avg(indeg), 6) as mean_in from s group by 1", "deg", "months")
def a09(t: Tables) -> DataFrame:
    from quillgraph.operators.graph import degrees

    d = degrees(t.edges).join(t.months.filter("month is not null"), "id")
    return d.groupBy(F.when(F.col("month") >= 200101, "new").otherwise("old").alias("split")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("outdeg")).alias("mean_out"), F.median("outdeg").alias("median_out"), r6(F.avg("indeg")).alias("mean_in"))


@query("x10_gold_with_fallback", "select src, dst, case when trim(sentence) = '' or length(trim(sentence)) < 14 then concat('This work is related to ', dst, '.') else sentence end as sentence from edges", "edges")
def x10(t: Tables) -> DataFrame:
    s = F.trim("sentence")
    return t.edges.select("src", "dst", F.when((s == "") | (F.length(s) < 14), F.concat(F.lit("This work is related to "), F.col("dst").cast("string"), F.lit("."))).otherwise(F.col("sentence")).alias("sentence"))
