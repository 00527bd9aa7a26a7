"""Operators on small hand-made fixtures."""

from __future__ import annotations

import os
import tarfile

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import ids, latex
from quillgraph.functions import text as tx
from quillgraph.operators import graph as g
from quillgraph.operators import greedy, ranking, resolve, splits, upserts
from quillgraph.sources import files


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(None).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in columns.items()])


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_ids_and_months(spark):
    c = F.lit
    assert value(spark, ids.canonical_id(c(" arXiv:2501.12345v2 "))) == "2501.12345"
    assert value(spark, ids.id_month(c("2501.12345v2"))) == 202501
    assert value(spark, ids.id_month(c("hep-th/9901001"))) == 199901
    assert value(spark, ids.id_month(c("2513.00001"))) is None
    assert [value(spark, ids.gate_year(c(x))) for x in ("2101.00001", "9901.00001", "hep-th/9901001")] == [2021, 1999, None]
    assert ids.minimum_year(recent_years=10, as_of=2026) == 2016
    assert ids.minimum_year(configured=2018, recent_years=10, as_of=2026) == 2018
    assert ids.minimum_year(configured=0, recent_years=10, as_of=2026) is None
    w = value(spark, ids.date_windows(F.to_date(c("2024-01-01")), F.to_date(c("2024-01-10")), 3))
    assert len(w) == 4 and str(w[0]["last"]) == "2024-01-03" and str(w[-1]["last"]) == "2024-01-10"
    assert value(spark, ids.month_of_fields(c("soon"), c("2024-07-01"))) == 202407
    assert value(spark, ids.strict_month(c("2024-13"))) is None
    assert value(spark, ids.repaired_key(c("hepth9901001"))) == "hepth/9901001"


def test_titles(spark):
    def keys(*titles):
        return [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(tx.title_key(F.col("t"))).collect()]

    same = lambda *titles: len(set(keys(*titles))) == 1
    assert same("A $\\beta_2$ bound for trees", "A β_{2} bound for trees", "a \\beta 2 {Bound} for Trees!")
    assert same("Fast SO(3) pooling", "Fast SO (3) Pooling", "fast so 3 pooling")
    assert same("The \\emph{quiet} river's bend", "The “quiet” river’s bend", "\\textbf{The quiet} river's bend")
    assert same("log\\_file parsing", "log_file parsing", "log file parsing")
    assert keys("Salt \\& Pepper: 5\\% of a 2 \\times 2 grid", None, "$$") == ["salt and pepper 5 percent of a 2 x 2 grid", "", ""]
    readings = lambda t: value(spark, tx.title_keys(F.lit(t)))
    assert readings("The self-made boat, May 2019") == ["the self-made boat may 2019", "the self-made boat", "the self-made boat may", "the self made boat may 2019", "the selfmade boat may 2019", "self-made boat may 2019"]
    assert "slow boats" in readings("arXiv preprint arXiv:2101.00001 Slow boats") and "slow boats" in readings("Slow boats, arXiv:2101.00001")
    assert readings("One") == [] and readings("The Boat") == ["the boat"]
    marked = lambda s: value(spark, tx.marked_id(F.lit(s)))
    assert marked("see arXiv: 2101.00001 (in press)") == "2101.00001"
    assert marked("eprint 2101.00001") == "2101.00001"
    assert marked("part 2101.00001") is None


def test_recovered_prose(spark):
    got = lambda s: value(spark, tx.recovered_prose(F.lit(s)))
    assert got("} % We follow \\cite{a} in this.\n% and so on") == "We follow \\cite{a} in this."
    assert got("We live with \\cite{b} here. % We follow \\cite{a} in this.") == "We live with \\cite{b} here. % We follow \\cite{a} in this."
    assert got("Live text without any. % We follow \\cite{a} in this.") == "We follow \\cite{a} in this."
    assert got("5\\% of it") == "5\\% of it" and got("") == "" and got("x % short") == "x % short"


def test_sentence_flags(spark):
    flags = lambda s: value(spark, tx.sentence_flags(F.lit(s)))
    many = ", ".join(f"k{i}" for i in range(13))
    assert flags("  ") == ["empty"] and flags("A plain sentence \\cite{a,b}.") == []
    assert flags(f"}} \\label{{x}} \\cite{{{many}}}") == ["lead_junk", "label", "cite_spam"]
    assert flags("\\subsubsection{A} \\begin{figure} \\IEEEPARstart{T}{he}") == ["section", "figure", "ieeeparstart"]
    assert flags("1 2 3") == ["too_few_letters"] and flags("ab" * 451) == ["too_long"]


def test_resolving(spark):
    library = spark.createDataFrame(
        [("p", "a", {"journal": "arXiv preprint arXiv:2410.24164"}), ("p", "b", {"volume": "2410.24164"}), ("p", "c", {"eprint": "2504.16054", "journal": "arXiv:2410.24164"}), ("p", "d", {"title": "$\\omega_1$ and the well-ordered boats"})],
        "paper_id string, cite_key string, fields map<string,string>",
    )
    index = spark.createDataFrame([("x",)], "t string").select(tx.title_key(F.lit("ω_{1} and the well-ordered boats")).alias("title_key"), F.lit("2504.16054").alias("id"))
    known = spark.createDataFrame([("2410.24164",), ("2504.16054",)], "id string")
    got = {r["cite_key"]: r["target"] for r in resolve.resolved_citations(library, index, known).collect()}
    assert got == {"a": "2410.24164", "c": "2504.16054", "d": "2504.16054"}


def test_masks_and_degrees(spark):
    e = spark.createDataFrame([("2607.1", "2001.1"), ("2608.1", "2001.1"), ("2001.1", "1901.1")], "src string, dst string")
    masked = spark.createDataFrame([("2607.1",), ("2608.1",)], "id string")
    assert [tuple(r) for r in g.masked_view(e, masked).collect()] == [("2001.1", "1901.1")]
    d = {r["id"]: r["indeg"] for r in g.degrees(e, masked).collect()}
    assert d["2001.1"] == 0 and d["1901.1"] == 1


def test_evidence_order(spark):
    rows = [(f"2001.{i:05d}", "c", f"s{i}", i) for i in range(9)]
    e = spark.createDataFrame(rows, "src string, dst string, sentence string, pos bigint")
    pick = lambda d: [r["sentence"] for r in g.selected_evidence(g.evidence_pool(d), "stride", 3).orderBy("ord").collect()]
    assert pick(e) == ["s0", "s3", "s6"]
    assert pick(e.withColumn("pos", 8 - F.col("pos"))) == ["s8", "s5", "s2"]
    assert "s3" not in pick(e.filter("pos < 7").filter("src <> '2001.00003'"))
    assert pick(e.withColumn("sentence", F.lit(" "))) == []
    with pytest.raises(ValueError):
        g.selected_evidence(e, "best")


def test_merge(spark):
    old = spark.createDataFrame([("2101.1", "Old", "2021-01-01")], "id string, title string, update_date string")
    new = spark.createDataFrame([("2101.1", "New", "2021-06-01", 0), ("2201.2", "Brand", "2022-01-01", 1), ("2201.2", "Older", "2021-01-01", 2)], "id string, title string, update_date string, seq bigint")
    assert {r["id"]: r["title"] for r in upserts.merged_snapshot(old, new).collect()} == {"2101.1": "New", "2201.2": "Brand"}
    assert tuple(upserts.merge_counts(old, new).first()) == (1, 1)


def test_split_frontier(spark):
    edges = [(f"{m}.{i:05d}", f"1900.{j:05d}", "cites.", j) for m in (2605, 2606, 2607, 2608) for i in range(20) for j in range(10)]
    e = spark.createDataFrame(edges, "src string, dst string, sentence string, pos bigint")
    months = e.select(F.col("src").alias("id")).distinct().withColumn("month", F.substring("id", 1, 4).cast("int"))
    s = splits.admit_and_split(e, months, quantiles=(0.0, 1.0), frontier_months=1)
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"frontier": 20, "test": 6, "train": 54}
    assert {r["source_id"][:4] for r in s.filter("split = 'test'").collect()} == {"2607"}
    gone = splits.admit_and_split(e.withColumn("sentence", F.when((F.col("src") == "2606.00000") & (F.col("pos") == 0), "").otherwise(F.col("sentence"))), months, quantiles=(0.0, 1.0))
    assert gone.count() == 79


def test_month_split(spark):
    d = spark.createDataFrame([("a", 202501), ("b", 202502), ("c", 202503), ("d", 202503)], "id string, month int")
    assert {r["id"] for r in splits.month_split(d, 0.25).filter("split = 'dev'").collect()} == {"c", "d"}


def test_metrics(spark):
    r = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "qid string, cid string, ord int")
    gold = spark.createDataFrame([("q", c) for c in "abc"], "qid string, cid string")
    m = ranking.metrics(r, gold, 3).first()
    assert (m["hits"], m["rr"]) == (2, 1.0) and m["precision"] == pytest.approx(2 / 3) and m["recall"] == pytest.approx(2 / 3)
    allowed = spark.createDataFrame([("q", "a"), ("q", "b")], "qid string, cid string")
    lists = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "x", 3), ("q", "b", 4)], "qid string, cid string, ord int")
    assert [x["cid"] for x in ranking.ordered_distinct(lists, 2, allowed).orderBy("ord").collect()] == ["a", "b"]


def test_fusion_edge_cases(spark):
    rows = [("q", 0, None, 1.0), ("q", 1, 0.5, 1.0), ("q", 2, 0.5, 0.0), ("r", 0, 0.1, 0.2)]
    got = {(r["qid"], r["slot"]): r["fused"] for r in ranking.fused(spark.createDataFrame(rows, "qid string, slot bigint, ce double, gat double")).collect()}
    assert got["r", 0] == 0.0 and all(v is not None for v in got.values())
    assert got["q", 1] > got["q", 2]


def test_cite_parsing():
    keys = [f"k{i}" for i in range(15)]
    text = "We follow earlier work on this \\citep[see][p. 2]{" + ", ".join(keys) + "}. Next one here. } \\label{x} Models are strong \\cite{a}. Models are strong \\cite{b}."
    found = dict(latex.citing_sentences(text))
    assert any(k == keys for k in found.values())
    clean, ok, _ = latex.clean_sentence("} 50\\% of it % a comment\n \\label{y} works \\cite{a,b,c,d,e,f,g,h} .")
    assert ok and "\\label" not in clean and clean.count(",") == 5 and clean.endswith(".") and "}" not in clean.replace("\\cite{a,b,c,d,e,f}", "")
    intro, related = latex.intro_and_related("\\section{Introduction} " + "a b " * 20 + "\\section{Related Work} " + "c d " * 20 + "\\section{Method} m")
    assert intro.startswith("a b") and related.startswith("c d") and "m" not in related.replace("c d", "")
    bib = dict(latex.bibtex_entries("@article{x1, title = {A {Nested} Title}, year = 2020, journal=\"arXiv:2410.24164\"}"))
    assert bib["x1"] == {"title": "A {Nested} Title", "year": "2020", "journal": "arXiv:2410.24164"}
    items = dict(latex.bibitems("\\bibitem{k1} A. Author. \\newblock Some Title. \\newblock arXiv:2410.24164, 2024. \\bibitem[x]{k2} B, ``Quoted one,'' 2020. \\end{thebibliography}"))
    assert items["k1"]["title"] == "Some Title" and items["k1"]["eprint"] == "2410.24164" and items["k2"]["title"] == "Quoted one"
    tree = {"main.tex": "\\documentclass{a}\\begin{document}\\input{b}\\end{document}", "b.tex": "B \\input{main}"}
    assert latex.main_file(tree) == "main.tex" and latex.inlined(tree, "main.tex").count("B") == 1


def test_latex_columns(spark):
    d = spark.createDataFrame([("Known \\cite{a} since then.",), (None,)], "t string")
    assert d.select(latex.cleaned("t").alias("c")).collect()[0]["c"]["ok"]
    assert d.select(F.explode(latex.sentences_with_keys("t")).alias("s")).first()["s"]["keys"] == ["a"]
    assert d.select(latex.bibliography("t")).count() == 2 and d.select(latex.introduction_and_related("t")).count() == 2


def test_greedy(spark):
    t = spark.createDataFrame([("q", 1, 1, "A title that is long enough here"), ("q", 2, 2, "a title that is long enough here"), ("q", 3, 3, "A title that is long enough here, too"), ("q", 4, 4, "Other")], "qid string, cid int, ord int, title string")
    assert [r["cid"] for r in greedy.suppressed_titles(t, 5).orderBy("ord").collect()] == [1, 4]
    p = spark.createDataFrame([("q", 1, "7", None), ("q", 2, None, "Other"), ("q", 3, None, "long enough title in here")], "qid string, ord int, id string, title string")
    c = spark.createDataFrame([("q", 7, "x"), ("q", 8, "other"), ("q", 9, "a long enough title in here")], "qid string, cid int, title string")
    assert [(r["ord"], r["cid"]) for r in greedy.aligned_predictions(p, c).orderBy("ord").collect()] == [(1, 7), (2, 8), (3, 9)]


def test_pagerank_mass(spark):
    e = spark.createDataFrame([("q", "a", "b"), ("q", "b", "c"), ("q", "a", "c")], "qid string, src string, dst string")
    r = g.personalised_pagerank(e, spark.createDataFrame([("q", "a")], "qid string, id string"), steps=4)
    assert r.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_edge_softmax(spark):
    m = spark.createDataFrame([("d", "a", 0.0, [1.0, 0.0]), ("d", "b", 0.0, [0.0, 1.0])], "dst string, src string, logit double, vec array<double>")
    assert g.edge_softmax(m).first()["vec"] == pytest.approx([0.5, 0.5])


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "1", "title": "First Paper"}\nnot json\n{"id": "2", "title": "Second Paper", "versions": [{"version": "v1", "created": "x"}]}\n')
    assert {r["id"] for r in files.read_metadata(spark, str(tmp_path / "m.jsonl")).collect()} == {"1", "2"}
    nodes = spark.createDataFrame([("a", "A & B"), ("b", "B")], "id string, title string")
    edges = spark.createDataFrame([("a", "b", 'says "x" <y>', 0)], "src string, dst string, sentence string, pos bigint")
    files.write_gexf(nodes, edges, str(tmp_path / "g.gexf"))
    n, e = files.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert {(r["id"], r["label"]) for r in n.collect()} == {("a", "A & B"), ("b", "B")}
    assert e.first()["sentence"] == 'says "x" <y>'
    os.makedirs(tmp_path / "t")
    (tmp_path / "main.tex").write_text("hello")
    with tarfile.open(tmp_path / "t" / "x.tar", "w") as tar:
        tar.add(tmp_path / "main.tex", "main.tex")
    assert files.archive_texts(spark, str(tmp_path / "t" / "x.tar")).first()["text"] == "hello"
    new = spark.createDataFrame([("1", [1.0]), ("2", [2.0])], "id string, embedding array<double>")
    path = str(tmp_path / "emb")
    assert files.append_missing(new, path, "id") == 2 and files.append_missing(new, path, "id") == 0
    assert files.read_embeddings(spark, path).count() == 2


def test_stream_merge(spark, tmp_path):
    from quillgraph.streaming.upserts import merge_stream

    table = str(tmp_path / "table")
    spark.createDataFrame([("1", "old", "2020")], "id string, title string, update_date string").write.parquet(f"{table}/v=0")
    spark.createDataFrame([("1", "new", "2021", 0), ("2", "more", "2021", 1)], "id string, title string, update_date string, seq bigint").write.json(str(tmp_path / "in"))
    incoming = spark.readStream.schema("id string, title string, update_date string, seq bigint").json(str(tmp_path / "in"))
    merge_stream(spark, incoming, table, str(tmp_path / "check")).awaitTermination()
    assert {r["id"]: r["title"] for r in spark.read.parquet(f"{table}/v=1").collect()} == {"1": "new", "2": "more"}


def test_text_parsers(spark):
    assert tx.normalised_queries(["c"], "a| b |a", ["z"]) == ["c", "a", "b"] and tx.normalised_queries(None, " ", ["z"]) == ["z"]
    assert value(spark, tx.chosen_ids(F.lit("1. first\n[3] third\nuse x2 too\n1."), F.array(F.lit("x1"), F.lit("x2"), F.lit("x3")), 3)) == ["x1", "x3", "x2"]
    assert value(spark, tx.concepts(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a")))) == "a, b"
    assert value(spark, tx.without_macro(F.lit("x \\todo{y} z \\href{u}{v}"), "todo")) == "x z \\href{u}{v}"
    assert value(spark, tx.plausible_title(F.lit("Attention is all you need"))) and not value(spark, tx.plausible_title(F.lit("In Proceedings of the conference 2020")))
    assert value(spark, tx.plain_tex(F.lit("a~b \\url{x} c % d"))) == "a b c"
    c = F.array(F.struct(F.lit("i").alias("id"), F.lit("T").alias("title"), F.lit("abc").alias("abstract")))
    assert value(spark, tx.candidate_list(c, "rank")) == "1. [i] T (rank 1)" and value(spark, tx.candidate_list(c, "abstract", 2)).endswith("ab")
    assert "Rank the 5" in value(spark, tx.prompt("rank", F.lit("t"), F.lit("a"), tx.candidate_list(c), 5))


def test_rollups(spark):
    from quillgraph.operators import evaluation as ev

    o = spark.createDataFrame([("q", "See graph nets [1]", "[1]", "Graph nets"), ("q", "", "[2]", "Other things")], "qid string, cite string, id string, title string")
    r = ev.citation_rollup(o).first()
    assert r["non_empty"] == 0.5 and r["id_present"] == 0.5 and r["distinct"] == 1.0
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id int, emb array<double>")
    assert ev.pair_cosines(v, 200).first()["n"] > 50
    s = spark.createDataFrame([("q", 0, 0.9, 1), ("q", 1, 0.8, 0), ("q", 2, 0.1, 1)], "qid string, slot int, score double, y int")
    assert ev.grouped_recall(s, 2).first()["recall"] == 0.5
    ranked = spark.createDataFrame([("a", "q", 1, 1), ("a", "q", 2, 2), ("b", "q", 2, 1), ("b", "q", 1, 2)], "recipe string, qid string, cid int, ord int")
    out = {x["recipe"]: x for x in ev.recipe_comparison(ranked, spark.createDataFrame([("q", 1)], "qid string, cid int"), "a", 1).collect()}
    assert out["b"]["delta"] == -1.0 and out["b"]["overlap"] == 1.0


def test_record_sources(spark, tmp_path):
    import json

    (tmp_path / "oai.jsonl").write_text(json.dumps({"xml": "<r><id>1</id><created>2020-01-02</created><updated></updated><authors><author><keyname>Doe</keyname><forenames>Ann</forenames></author></authors><title>T</title></r>"}))
    r = files.oai_records(spark, str(tmp_path / "oai.jsonl")).first()
    assert (r["authors"], r["update_date"]) == ("Ann Doe", "2020-01-02")
    (tmp_path / "ids.json").write_text('{"test_sources": ["a", "b"]}')
    (tmp_path / "ids2.json").write_text('["c"]')
    assert {x["id"] for x in files.read_id_list(spark, str(tmp_path / "ids*.json")).collect()} == {"a", "b", "c"}


def test_bm25_before_a_month(spark):
    import math
    import random

    from quillgraph.operators import ranking as rk

    rng = random.Random(5)
    docs = [(f"d{i:02}", rng.choice([1, 2, 3, 4, None]), rng.choices("abcdefghijkl", k=rng.randint(0, 6))) for i in range(40)]
    queries = [("q0", 2, ["a", "b", "a"]), ("q1", 4, ["c", "zz"]), ("q2", 4, ["zz"]), ("d03", 9, ["d", "e"]), ("q4", 1, ["a"])]
    want = {}
    for qid, cutoff, terms in queries:
        e = [(d, t) for d, m, t in docs if m is not None and m < cutoff and d != qid]
        mean = sum(len(t) for _, t in e) / max(1, len(e))
        score = {d: 0.0 for d, _ in e}
        for x in set(terms):
            df = sum(x in t for _, t in e)
            for d, t in e:
                score[d] += math.log(1 + (len(e) - df + 0.5) / (df + 0.5)) * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / max(mean, 1e-9)))
        want[qid] = sorted(((-round(s, 9), d) for d, s in score.items()))[:10]
    got = {q[0]: [] for q in queries}
    d = spark.createDataFrame(docs, "doc string, month int, terms array<string>")
    for r in rk.bm25_before(d, spark.createDataFrame(queries, "qid string, month int, terms array<string>")).orderBy("qid", "rank").collect():
        got[r["qid"]].append((-round(r["score"], 9), r["doc"]))
    assert got == want
    assert len(got["q2"]) == 10 and not got["q4"]


def test_contracts_of_pools_and_packs(spark):
    from quillgraph.operators import datasets, pool

    assert pool.chosen_ranker({"linear", "ltr"}) == "ltr" and pool.chosen_ranker(set()) == "heuristic" and pool.chosen_ranker({"ce_sent", "ce"}) == "ce_sent"
    window = spark.createDataFrame([(1, 0, 10), (1, 1, 11)], "qid int, slot int, cid int")
    gat = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.7)], "qid int, cid int, gat double")
    for bad in ([(1, 10, 0.5)], [(1, 10, 0.5), (1, 11, float("nan"))], [(1, 10, 0.5), (1, 11, float("inf"))]):
        with pytest.raises(ValueError, match="1 candidates without a finite CE score"):
            pool.scored_window(window, spark.createDataFrame(bad, "qid int, cid int, ce double"), gat)
    edges = spark.createDataFrame([("a", "x", "s", 0), ("a", "y", "s", 1), ("b", "x", "s", 2), ("b", "y", "s", 3)], "src string, dst string, sentence string, pos bigint")
    vectors = spark.createDataFrame([(i, [1.0, float(n)]) for n, i in enumerate("abxy")], "id string, emb array<double>")
    none = vectors.select("id").limit(0)
    with pytest.raises(ValueError, match="1 required papers have no vector"):
        g.cutoff_pack(edges, vectors, none, spark.createDataFrame([("z",)], "id string"))
    seen, both, near = g.cutoff_pack(edges, vectors, spark.createDataFrame([("b",)], "id string"), none)
    assert seen.count() == 2 and {(r["i"], r["j"], r["w"]) for r in both.collect()} == {("x", "y", 1), ("y", "x", 1)}
    assert {(r["id"], r["other"], r["ord"]) for r in near.collect()} == {("x", "a", 1), ("x", "y", 2), ("y", "a", 1), ("y", "x", 2)}
    pools = spark.createDataFrame([("a", "", "", ["x", "y"])], "source_id string, title string, abstract string, pool_ids array<string>")
    papers = spark.createDataFrame([("a", "A title", "An abstract")], "id string, title string, abstract string")
    gold = spark.createDataFrame([("a", ["x"])], "source_id string, gold_ids array<string>")
    made, rows, counts = datasets.adapter_dataset(pools, papers, gold, {"test": none})
    assert made.count() == 4 and {r["name"]: r["n"] for r in counts.collect()} == {"bundle": 2, "one": 2, "rows": 1, "skipped": 0}
    assert rows.first()["title"] == "A title" and rows.first()["abstract"] == "An abstract"
    with pytest.raises(ValueError, match="train_test: 1 ids"):
        datasets.adapter_dataset(pools, papers, gold, {"test": spark.createDataFrame([("a",)], "id string")})


def test_block_scores_of_many_blocks(spark, monkeypatch):
    import numpy as np

    from quillgraph.functions import vectors

    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 5)
    x = np.random.default_rng(1).normal(size=(23, 4))
    x[7] = 0
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, emb array<double>")
    got = {(r["qid"], r["cid"]): (r["cosine"], r["distance"]) for r in vectors.block_scores(d.filter("id < 8"), d).collect()}
    assert len(got) == 8 * 23
    for (q, c), (cosine, distance) in got.items():
        norms = np.linalg.norm(x[q]) * np.linalg.norm(x[c])
        assert abs(cosine - (x[q] @ x[c] / norms if norms else 0.0)) < 1e-12 and abs(distance - np.linalg.norm(x[q] - x[c])) < 1e-12
    assert vectors.block_scores(d.limit(0), d).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from quillgraph.operators.tables import shared_path

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir is unset"):
        shared_path(session)


def test_top_by_bm25_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(ranking, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ranking, "BLOCK_QUERIES", 2)
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, rng.choices("abcdefgh", k=rng.randint(1, 9))) for i in range(60)], "doc bigint, terms array<string>")
    queries = spark.createDataFrame([(i, rng.choices("abcdefghz", k=3)) for i in range(7)] + [(8, ["z"]), (9, [])], "qid bigint, terms array<string>")
    all_scores = {}
    for r in ranking.bm25(docs, queries).collect():
        all_scores.setdefault(r["qid"], []).append((-round(r["score"], 6), r["doc"]))
    want = {(q, d, n) for q, x in all_scores.items() for n, (_, d) in enumerate(sorted(x)[:5], 1)}
    assert {(r["qid"], r["doc"], r["rank"]) for r in ranking.bm25_top(docs, queries, 5).collect()} == want
    assert ranking.bm25_top(docs.limit(0), queries, 5).count() == 0
