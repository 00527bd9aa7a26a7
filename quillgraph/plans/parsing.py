"""Queries on identifiers, text rules and LaTeX parsers, over texts made from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import ids, latex
from quillgraph.functions import text as tx
from quillgraph.plans.registry import Tables, query
from quillgraph.plans.tables import _TOK

_K = "doc_id % {n}"


def _docs(t: Tables, *more) -> DataFrame:
    return t.read("documents").select("doc_id", "text", "lang", "source", *more)


def _kth(n: int, *values):
    """The value for doc_id % n; the last stands for all further ones."""
    k = F.col("doc_id") % n
    out = F.lit(values[-1]) if isinstance(values[-1], str) or values[-1] is None else values[-1]
    for i, v in list(enumerate(values[:-1]))[::-1]:
        out = F.when(k == i, F.lit(v) if isinstance(v, str) or v is None else v).otherwise(out)
    return out


@query("p03_month_of_fields", "select doc_id, case doc_id % 4 when 0 then 202403 when 1 then 202011 when 2 then 199902 else 202107 end::integer as month from documents")
def p03(t: Tables) -> DataFrame:
    fields = [_kth(4, "2024-03-09", "soon", None, "x"), _kth(4, "1990-01", "202011", "n/a", None)]
    legacy = ids.id_month(_kth(4, "2301.00001", "2301.00001", "hep-th/9902001", "2107.00001"))
    return _docs(t).select("doc_id", F.coalesce(ids.month_of_fields(*fields), legacy).alias("month"))


@query("p06_minimum_year", "select * from (values ('explicit', 2015), ('switched off', null), ('configured', 2018), ('relative', 2016), ('none', null)) as v(gate, year)")
def p06(t: Tables) -> DataFrame:
    gates = {"explicit": ids.minimum_year(2015, 2018, 10, 2026), "switched off": ids.minimum_year(0, 2018, 10, 2026), "configured": ids.minimum_year(None, 2018, 10, 2026), "relative": ids.minimum_year(None, None, 10, 2026), "none": ids.minimum_year()}
    return t.spark.createDataFrame(list(gates.items()), "gate string, year int")


@query("p13_citer_allowed", "select e.src, e.dst, case when s.month is null or d.month is null then true when s.month < d.month then true when s.month = d.month then true else false end as lenient, coalesce(s.month < d.month, false) as strict from edges e left join months s on s.id = e.src left join months d on d.id = e.dst", "edges", "months")
def p13(t: Tables) -> DataFrame:
    m = t.months
    e = t.edges.select("src", "dst").join(m.select(F.col("id").alias("src"), F.col("month").alias("c")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("month").alias("q")), "dst", "left")
    return e.select("src", "dst", ids.citer_allowed(F.col("c"), F.col("q")).alias("lenient"), ids.citer_allowed(F.col("c"), F.col("q"), False, False).alias("strict"))


@query("p19_retrieval_queries", "select * from (values (1, 'a'), (2, 'b c'), (3, 'd'), (4, 'e')) as v(no, text)")
def p19(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(enumerate(tx.normalised_queries([" a ", "b c", ""], "a|d| e |"), 1)), "no int, text string")


@query("p23_next_since", "select event_type, cast(max(cast(ts as date)) + 1 as date) as since, cast('2020-01-01' as date) as without from events group by 1")
def p23(t: Tables) -> DataFrame:
    e = t.read("events").groupBy("event_type").agg(F.max(F.to_date("ts")).alias("last"))
    start = F.to_date(F.lit("2020-01-01"))
    return e.select("event_type", ids.next_since(F.col("last"), start).alias("since"), ids.next_since(F.lit(None).cast("date"), start).alias("without"))


@query("p28_abstract_backfill", "select l_orderkey as qid, l_partkey as cid, coalesce(nullif(case when l_linenumber % 2 = 0 then 'own' else '' end, ''), p.p_type) as title, l_linenumber as ord from lineitem l left join part p on p.p_partkey = l.l_partkey where l_linenumber <= 5")
def p28(t: Tables) -> DataFrame:
    from quillgraph.operators import datasets

    pool = t.read("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("cid"), F.when(F.col("l_linenumber") % 2 == 0, "own").otherwise("").alias("title"), F.col("l_linenumber").alias("ord"))
    return datasets.selected_prefix(pool, t.read("part").select(F.col("p_partkey").alias("cid"), F.col("p_type").alias("title")), 5)


@query("f06_recovered_prose", r"select doc_id, case doc_id % 4 when 0 then concat('Prose of ', source, ' follows \cite{a} closely.') when 1 then concat('We build on \cite{b} here. % Prose of ', source, ' follows \cite{a} closely.') when 2 then concat('Prose of ', source, ' follows \cite{a} closely.') else '} % short' end as prose from documents")
def f06(t: Tables) -> DataFrame:
    said = F.concat(F.lit("Prose of "), "source", F.lit(" follows \\cite{a} closely."))
    raw = _kth(4, F.concat(F.lit("} % "), said, F.lit(" % and")), F.concat(F.lit("We build on \\cite{b} here. % "), said), F.concat(F.lit("Live words without any. %% "), said), "} % short")
    return _docs(t).select("doc_id", tx.recovered_prose(raw).alias("prose"))


def _paper(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("f09_sections", "select doc_id, trim(concat('We begin with ', source, ' and go on for a good while.')) as introduction, 'Others did it, at some length, before us.' as related from documents")
def f09(t: Tables) -> DataFrame:
    tex = _paper("\\begin{document}\\section{1. {Introduction}} We begin with ", F.col("source"), " and go on for a good while.\n\\subsection*{Related \\emph{Work}} Others did it, at some length, before us.\\section{Method} m \\end{document}")
    return _docs(t).select("doc_id", latex.introduction_and_related(tex).alias("s")).select("doc_id", "s.*")


@query("f10_body_fallback", "select doc_id, concat('A letter on ', lang, ' without any section.') as introduction, '' as related from documents")
def f10(t: Tables) -> DataFrame:
    tex = _paper("\\title{T}\\maketitle\\begin{abstract}Short.\\end{abstract} A letter on ", F.col("lang"), " without any section. \\begin{thebibliography}{9} x \\end{thebibliography}")
    return _docs(t).select("doc_id", latex.introduction_and_related(tex).alias("s")).select("doc_id", "s.*")


@query("f11_short_sections", "select doc_id, case when doc_id % 2 = 0 then 'The sections below hold too little, so this is what counts. \\section{Introduction} Short.' else 'An introduction that has more than fifty characters in it.' end as introduction from documents")
def f11(t: Tables) -> DataFrame:
    tex = _kth(2, "\\maketitle The sections below hold too little, so this is what counts. \\section{Introduction} Short. \\bibliography{x}", "\\maketitle x \\section{Introduction} An introduction that has more than fifty characters in it.")
    return _docs(t).select("doc_id", latex.introduction_and_related(tex).alias("s")).select("doc_id", "s.introduction")


@query("f15_bibliography_items", """select doc_id, 'k1' as cite_key, concat('A book on ', lang) as title, null as eprint from documents union all select doc_id, 'k2', concat('Notes of ', source), concat('2401.', lpad(cast(doc_id % 100000 as varchar), 5, '0')) from documents union all select doc_id, 'k3', 'An old one', null from documents""")
def f15(t: Tables) -> DataFrame:
    eprint = F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0")
    tex = _paper("\\begin{thebibliography}{9}\\bibitem{k1} A. Author, ``A book on ", F.col("lang"), ",'' Press, 1999. \\bibitem[B(2000)]{k2} B. Author. \\newblock Notes of ", F.col("source"), ". \\newblock arXiv:2401.", eprint, ". \\bibitem{k3} C. Author, \\emph{An old one}, 1900. \\end{thebibliography}")
    b = _docs(t).select("doc_id", F.inline(latex.bibliography(tex)))
    return b.select("doc_id", "cite_key", F.col("fields")["title"].alias("title"), F.col("fields")["eprint"].alias("eprint"))


@query("f16_bibtex_entries", "select doc_id, concat('k', doc_id) as cite_key, concat('A {Nested} title of ', source) as title, '2019' as year, lang as note from documents")
def f16(t: Tables) -> DataFrame:
    tex = _paper("@string{x = {y}}\n@article{k", F.col("doc_id").cast("string"), ",\n title = {A {Nested}\n title of ", F.col("source"), "}, year = 2019, note = \"", F.col("lang"), "\" }")
    b = _docs(t).select("doc_id", F.inline(latex.bibliography(tex)))
    return b.select("doc_id", "cite_key", *[F.col("fields")[c].alias(c) for c in ("title", "year", "note")])


@query("f17_plausible_titles", "select doc_id, case doc_id % 4 when 0 then true else false end as title, case doc_id % 4 when 1 then true when 2 then true else false end as venue from documents")
def f17(t: Tables) -> DataFrame:
    c = _kth(4, F.concat(F.lit("Small boats on the river "), "lang"), "In Proceedings of the river meeting", "Journal of Boats", "Boats")
    return _docs(t).select("doc_id", tx.plausible_title(c).alias("title"), tx.plausible_venue(c).alias("venue"))


@query("f18_main_file", "select doc_id, case doc_id % 3 when 0 then 'paper.tex' when 1 then 'long.tex' else 'root.tex' end as main from documents")
def f18(t: Tables) -> DataFrame:
    from quillgraph.sources import files

    root, plain = "\\documentclass{article}\\begin{document} x \\end{document}", "only words of some length, but no root at all, and more of them"
    names = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("text")) for n, c in (("paper.tex", _kth(3, root, "short", root)), ("long.tex", F.lit(plain)), ("root.tex", _kth(3, "short", "x", root)))])
    texts = _docs(t).select(F.col("doc_id").cast("string").alias("archive"), F.inline(names))
    return files.materialised_sources(texts).select(F.col("archive").cast("bigint").alias("doc_id"), "main")


@query("f19_inlined_inputs", "select doc_id, concat('\\documentclass{a} one two ', source, '  end') as tex from documents")
def f19(t: Tables) -> DataFrame:
    from quillgraph.sources import files

    names = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("text")) for n, c in (("main.tex", F.lit("\\documentclass{a} one \\input{part} end")), ("part.tex", F.concat(F.lit("two \\include{deep.tex}"))), ("deep.tex", F.concat("source", F.lit(" \\input{part}"))))])
    texts = _docs(t).select(F.col("doc_id").cast("string").alias("archive"), F.inline(names))
    return files.materialised_sources(texts).select(F.col("archive").cast("bigint").alias("doc_id"), "tex")


@query("f20_plain_tex", "select doc_id, concat('See', chr(10), 'the site of ', source, ' 50\\% of it.') as text from documents")
def f20(t: Tables) -> DataFrame:
    raw = _paper("See % a note\nthe~site of ", F.col("source"), " \\url{http://x.org/a} \\begin{verbatim} a % b \\end{verbatim} 50\\% of   it.")
    plain = tx.plain_tex(raw)
    return _docs(t).select("doc_id", F.regexp_replace(plain, " *\n *", "\n").alias("text"))


@query("f22_macro_removal", "select doc_id, concat('before ', lang, ' after \\keepme{x}') as text from documents")
def f22(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.without_macro(_paper("before ", F.col("lang"), " \\added[id=1]{a}{b} after \\keepme{x}"), "added", 2).alias("text"))


@query("f23_repaired_keys", "select doc_id, case doc_id % 3 when 0 then concat('hep-th/', lpad(cast(doc_id % 10000000 as varchar), 7, '0')) when 1 then '2401.00001' else 'word' end as key from documents")
def f23(t: Tables) -> DataFrame:
    n = F.lpad((F.col("doc_id") % 10_000_000).cast("string"), 7, "0")
    return _docs(t).select("doc_id", ids.repaired_key(_kth(3, F.concat(F.lit("hep-th"), n), "2401.00001", "word")).alias("key"))


@query("f24_concepts", "select doc_id, array_to_string(list_sort(list_distinct([lang, source, 'all', lang])), ', ') as concepts from documents where lang is not null and source is not null")
def f24(t: Tables) -> DataFrame:
    d = _docs(t).filter("lang is not null and source is not null")
    return d.select("doc_id", tx.concepts(F.array("lang", F.lit("all")), F.array("source"), F.array("lang")).alias("concepts"))


@query("f26_chosen_ids", "select doc_id, case doc_id % 2 when 0 then concat(source, ',', lang) else source end as chosen from documents where lang is not null and source is not null")
def f26(t: Tables) -> DataFrame:
    d = _docs(t).filter("lang is not null and source is not null")
    answer = _kth(2, "[1] the first\n2. the second\n1) again\nnothing here", F.concat(F.lit("I choose "), "source", F.lit(" alone\n7. unknown")))
    return d.select("doc_id", F.array_join(tx.chosen_ids(answer, F.array("source", "lang"), 3), ",").alias("chosen"))


@query("f28_message_fields", "select doc_id, source as title, concat('On ', lang, chr(10), 'and more.') as abstract from documents")
def f28(t: Tables) -> DataFrame:
    m = _paper("Please help.\nTitle: ", F.col("source"), "\nAbstract: On ", F.col("lang"), "\nand more.")
    return _docs(t).select("doc_id", tx.message_fields(m).alias("m")).select("doc_id", "m.*")


@query("f29_cite_matches_title", "select doc_id, case doc_id % 3 when 0 then true when 1 then true else false end as agrees from documents")
def f29(t: Tables) -> DataFrame:
    cite = _kth(3, "They sailed on rivers \\cite{x}.", "The SBR model \\cite{y}.", "Nothing of the kind \\cite{z}.")
    return _docs(t).select("doc_id", tx.cite_matches_title(cite, F.lit("Small Boats: Rivers")).alias("agrees"))


@query("f30_near_titles", "select item_id, case item_id % 3 when 0 then true when 1 then len(" + _TOK.format(c="text") + ") >= 4 else false end as near from benchmark")
def f30(t: Tables) -> DataFrame:
    k, x = F.col("item_id") % 3, F.col("text")
    other = F.when(k == 0, F.upper(x)).when(k == 1, F.concat(x, F.lit(" zzzyx"))).otherwise("")
    return t.read("benchmark").select("item_id", tx.near_titles(x, other).alias("near"))


@query("f31_candidate_lists", "select doc_id, concat('1. [', source, '] ', lang, ' (rank 1)', chr(10), '2. [x] T (rank 2)') as ranked, concat('1. [', source, '] ', lang, chr(10), '   ', substr(text, 1, 10), chr(10), '2. [x] T', chr(10), '   A') as abstracts from documents where text is not null and lang is not null and source is not null")
def f31(t: Tables) -> DataFrame:
    d = _docs(t).filter("text is not null and lang is not null and source is not null")
    item = lambda i, ti, a: F.struct(i.alias("id"), ti.alias("title"), a.alias("abstract"))
    c = F.array(item(F.col("source"), F.col("lang"), F.col("text")), item(F.lit("x"), F.lit("T"), F.lit("A")))
    return d.select("doc_id", tx.candidate_list(c, "rank").alias("ranked"), tx.candidate_list(c, "abstract", 10).alias("abstracts"))


@query("f32_prompts", "select doc_id, concat('Title: ', source, chr(10), 'Abstract: ', lang, chr(10), chr(10), 'Candidates:', chr(10), '1. [x] T', chr(10), chr(10), 'Select the 3 most relevant papers.') as prompt from documents where lang is not null and source is not null")
def f32(t: Tables) -> DataFrame:
    d = _docs(t).filter("lang is not null and source is not null")
    return d.select("doc_id", tx.prompt("select", F.col("source"), F.col("lang"), F.lit("1. [x] T"), 3).alias("prompt"))


@query("f34_template_sentences", "select doc_id, case doc_id % 3 when 2 then false else true end as template from documents")
def f34(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.template_sentence(_kth(3, "This work is related to boats.", "Too short.", "A sentence that is of its own making.")).alias("template"))


@query("f36_selected_prefix", "select l_orderkey as qid, l_partkey as cid, case when l_linenumber = 2 then p.p_name else 'own' end as title, l_linenumber as ord from lineitem l left join part p on p.p_partkey = l.l_partkey where l_linenumber <= 3")
def f36(t: Tables) -> DataFrame:
    from quillgraph.operators import datasets

    pool = t.read("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("cid"), F.when(F.col("l_linenumber") == 2, F.lit(None)).otherwise("own").alias("title"), F.col("l_linenumber").alias("ord"))
    return datasets.selected_prefix(pool, t.read("part").select(F.col("p_partkey").alias("cid"), F.col("p_name").alias("title")), 3)


@query("f37_keyword_hits", "select doc_id, doc_id % 2 = 0 as hit from documents")
def f37(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.title_keyword_hit(_kth(2, "Boats of old \\cite{x}", "A cat \\cite{y}"), F.lit("The boats and the cat")).alias("hit"))


@query("f03_cleaned_citations", r"""select doc_id, case doc_id % 2 when 0 then concat('We follow ', source, ' \cite{a,b} and ', lang, '.') else 'Short.' end as text, doc_id % 2 = 0 as ok, case doc_id % 2 when 0 then '' else 'too_few_letters' end as reasons from documents where lang is not null and source is not null""")
def f03b(t: Tables) -> DataFrame:
    raw = _kth(2, _paper("\\textbf{We} \\emph{follow} {", F.col("source"), "}~\\citep[see][p.~3]{a, b} % a note\n\\label{x} and\\vspace{2pt} ", F.col("lang"), " ."), "\\section{Long title}  Short.")
    d = _docs(t).filter("lang is not null and source is not null").select("doc_id", latex.cleaned(raw).alias("c"))
    return d.select("doc_id", "c.text", "c.ok", F.array_join("c.reasons", ",").alias("reasons"))


@query("f07_key_caps", r"select doc_id, concat('Many agree \cite{k1,k2,k3,k4,k5,k6} and ', source, ' does \cite{z}.') as text from documents where source is not null")
def f07(t: Tables) -> DataFrame:
    raw = _paper("Many agree \\cite{k1, k2,k3 ,k4,k5,k6,k7, k8} and ", F.col("source"), " does \\cite{z}.")
    return _docs(t).filter("source is not null").select("doc_id", latex.cleaned(raw).alias("c")).select("doc_id", "c.text")


@query("f21_expanded_macros", "select doc_id, concat('We use {the ', source, ' model} with x{y} and \\operatorname{argmax} of it; \\other{z} stays.') as tex from documents where source is not null")
def f21(t: Tables) -> DataFrame:
    tex = _paper("\\newcommand{\\model}[1]{{the #1 model}}\\def\\pair#1#2{#1{#2}}\\DeclareMathOperator*{\\am}{argmax}\\newcommand\\our{\\model{", F.col("source"), "}}We use \\our with \\pair{x}{y} and \\am of it; \\other{z} stays.")
    return _docs(t).filter("source is not null").select("doc_id", latex.with_macros_expanded(tex).alias("tex"))
