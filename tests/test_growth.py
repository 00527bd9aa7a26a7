"""Registered queries against their SQL on small tables with the keys, sizes and values that larger copies bring."""

from __future__ import annotations

import duckdb
import pytest

from quillgraph.plans import all_queries
from tests.test_queries import rows

QUERIES, SQL = all_queries()


def same(spark, folder, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(folder)), c.execute(SQL[name])
    columns = [d[0] for d in want.description]
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want.fetchall())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and abs(u - v) <= 2e-5) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", ["g01_seed_graph", "g02_grown_graph"])
def test_six_digit_keys(name, spark, tmp_path):
    """Keys from 100,000 on share the five digits of their short ids."""
    c = duckdb.connect()
    c.execute(f"copy (select range as p_partkey from range(0, 100200)) to '{tmp_path}/part.parquet'")
    c.execute(f"copy (select i // 5 as l_orderkey, case when i % 2 = 0 then 10000 + i // 4 else 100000 + i end as l_partkey from (select range as i from range(0, 190))) to '{tmp_path}/lineitem.parquet'")
    same(spark, tmp_path, name, ["part", "lineitem"])


def test_texts_are_parsed_once(spark):
    """g01: each paper's text goes to Python once, for its sentences and its bibliography."""
    plan = QUERIES["g01_seed_graph"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1


def test_cited_edges(spark):
    """A target's first sentence, whichever of its keys is cited; the least id or title of a key's entries; silent, unknown, own and repeated references."""
    from quillgraph.operators import build

    tex = r"See \cite{a, none}. Then \cite{b,c} shows. Again \cite{a}. \begin{thebibliography}{9} \bibitem{a} X. \newblock The Long Title 2020. \bibitem{b} Y. \newblock T. \newblock arXiv:2401.00002 \bibitem{c} Z, arXiv:2401.00001 \bibitem{c} Z, ``The long title,'' A. \bibitem{d} W, arXiv:2401.00003 \bibitem{e} V, arXiv:2401.99999 \bibitem{f} U, arXiv:2401.00009 \end{thebibliography}"
    papers = spark.createDataFrame([("2401.00009", tex), ("p", None), ("q", ""), ("r", r"\bibitem{k} A. \newblock Long title")], "id string, tex string")
    known = spark.createDataFrame([(f"2401.0000{i}",) for i in (1, 2, 3, 9)], "id string")
    titles = spark.createDataFrame([("the long title", "2401.00002"), ("long title", "2401.00001"), ("long title", "2401.00003")], "title_key string, id string")
    got = sorted(map(tuple, build.cited_edges(papers, titles, known).select("src", "dst", "sentence", "pos").collect()))
    assert got == [("2401.00009", "2401.00001", "Then \\cite{b,c} shows.", 1), ("2401.00009", "2401.00002", "See \\cite{a,none}.", 0), ("2401.00009", "2401.00003", "", 2**31), ("r", "2401.00001", "", 2**31)]


#: Queries whose pairs stay in the task that makes them.
WHOLE = ["a11_score_percentiles", "w13_w15_structural_score", "w26_rank_features", "w54_second_head", "w58_frozen_window", "j15_score_alignment", "w07_zscore", "w28_pair_network", "w53_score_dump", "w36_cold_start_pool"]


@pytest.mark.parametrize("name", WHOLE)
def test_pairs_are_not_shuffled(name, spark):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and "MapInArrow" in plan


def test_bootstrap_reads_one_row_a_query(spark, monkeypatch):
    """m11: what is resampled is a written table of a query's hits, no plan over pairs."""
    from quillgraph.operators import evaluation as ev

    seen, real = [], ev.paired_bootstrap
    monkeypatch.setattr(ev, "paired_bootstrap", lambda pairs, draws: seen.append(pairs) or real(pairs, draws))
    QUERIES["m11_paired_bootstrap"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_draws_stay_in_their_tasks(spark):
    """m11: neither draws nor queries are broadcast, and the figures are those of plain Python, with a difference that isn't known left out."""
    import hashlib

    from quillgraph.operators import evaluation as ev

    pairs = [(q, q % 5, None if q == 7 else q * q % 7) for q in range(23)]
    got = ev.paired_bootstrap(spark.createDataFrame(pairs[::-1], "qid long, a int, b int"), 300)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    d, n = [None if b is None else a - b for _, a, b in pairs], len(pairs)
    h = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:15], 16)
    mean = lambda x: sum(y for y in x if y is not None) / sum(y is not None for y in x)
    m = sorted(mean([d[h(i, k, 0) % n] for k in range(n)]) for i in range(1, 301))
    s = [mean([x if x is None or h(k, i, 1) % 2 == 0 else -x for k, x in enumerate(d)]) for i in range(1, 301)]
    at = lambda q: m[int(q * 299)] + (q * 299 % 1) * (m[int(q * 299) + 1] - m[int(q * 299)])
    want = (mean(d), at(0.025), at(0.975), (sum(abs(x) >= abs(mean(d)) - 1e-12 for x in s) + 1) / 301)
    assert tuple(got.first()) == pytest.approx(want, abs=1e-9)
    assert tuple(ev.paired_bootstrap(spark.createDataFrame([], "qid long, a int, b int"), 10).first()) == (None,) * 4


def test_counted_fit(spark):
    """m18: rows with counts give the fit of the rows written out."""
    from quillgraph.operators import models

    d = spark.createDataFrame([(0.1, 1.0, 0, 3), (0.4, 0.0, 1, 2), (0.3, 1.0, 1, 1), (0.2, 0.5, 0, 2)], "a double, b double, y int, n int")
    whole = d.selectExpr("a", "b", "y", "explode(sequence(1, n)) as k")
    u, v = models.logistic_fit(d, ("a", "b"), count="n"), models.logistic_fit(whole, ("a", "b"))
    assert all(abs(u[i][c] - v[i][c]) < 1e-3 for i in (0, 2, 3) for c in "ab")


def test_counted_statistics(spark):
    """x22: rows with counts give the statistics of the rows written out, and a constant has the deviation 1."""
    from quillgraph.operators import models

    d = spark.createDataFrame([(1.0, 2.0, 3), (5.0, 2.0, 1)], "a double, b double, n int")
    assert models.fit_statistics(d, ("a", "b"), "n") == ({"a": 2.0, "b": 2.0}, {"a": pytest.approx(3**0.5), "b": 1.0})


def test_gexf_in_several_files(spark, tmp_path):
    """Above the size, edges come in several files, in order, and nothing is lost."""
    from quillgraph.sources import files

    n = spark.range(70).selectExpr("cast(id as string) as id", "concat('t', id) as title", "map('year', cast(id as string)) as attributes")
    e = spark.range(500).selectExpr("cast(id % 70 as string) as src", "cast(id % 7 as string) as dst", "concat('<', id, '>') as sentence", "id as pos")
    files.write_gexf(n, e, str(tmp_path / "g"), largest=60)
    assert len(list((tmp_path / "g").glob("part-*.gz"))) > 8
    nodes, edges = files.read_gexf(spark, str(tmp_path / "g"))
    assert {r["id"]: r["attributes"]["year"] for r in nodes.collect()} == {str(i): str(i) for i in range(70)}
    assert [r["sentence"] for r in edges.orderBy("pos").collect()] == [f"<{i}>" for i in range(500)]


def test_gexf_nodes_without_attributes(spark, tmp_path):
    """Nodes alone go above the size, and one without attributes stays."""
    from quillgraph.sources import files

    n = spark.range(90).selectExpr("cast(id as string) as id", "concat('t', id) as title", "if(id % 2 = 0, map('year', '1'), null) as attributes")
    e = spark.createDataFrame([("1", "2", "s", 1)], "src string, dst string, sentence string, pos bigint")
    files.write_gexf(n, e, str(tmp_path / "g"), largest=40)
    nodes, edges = files.read_gexf(spark, str(tmp_path / "g"))
    assert sorted(int(r["id"]) for r in nodes.collect()) == list(range(90)) and edges.count() == 1


def test_gexf_nodes_are_computed_once(spark, tmp_path):
    """Writing several files, which counts and samples the nodes, doesn't compute them again."""
    from pyspark.sql import functions as F

    from quillgraph.sources import files

    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda i: made.add(1) or True, "boolean")
    n = spark.range(90).filter(seen("id")).selectExpr("cast(id as string) as id", "concat('t', id) as title")
    e = spark.createDataFrame([("1", "2", "s", 1)], "src string, dst string, sentence string, pos bigint")
    files.write_gexf(n, e, str(tmp_path / "g"), largest=40)
    assert files.read_gexf(spark, str(tmp_path / "g"))[0].count() == made.value == 90


def test_gexf_nodes_pass_over_edges(spark, tmp_path):
    """No edge leaves Python for the nodes, nor a node for the edges; both have what defaults and escapes give."""
    from quillgraph.sources import files

    (tmp_path / "g.gexf").write_text(
        """<gexf><graph><attributes class="edge"><attribute id="0" title="sentence"/></attributes><nodes><node id="a" label="A &amp; B"><attvalues>
        <attvalue for="year" value="1999"/></attvalues></node><node id='b'/><node id="c" label=""></node></nodes><edges><edge source="a" target="b"><attvalues><attvalue for="0" value="&lt;x&gt;"/>
        </attvalues></edge><edge source="b" target="c" label="l"/><edge source="c" target="a"/></edges></graph></gexf>"""
    )
    nodes, edges = files.read_gexf(spark, str(tmp_path / "g.gexf"))
    for d in (nodes, edges):
        assert "Filter (" not in d._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in nodes.collect()] == [("a", "A & B", {"id": "a", "label": "A & B", "year": "1999"}), ("b", "b", {"id": "b"}), ("c", "", {"id": "c", "label": ""})]
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "<x>", 3), ("b", "c", "l", 4), ("c", "a", "", 5)]


def test_gexf_tables_have_small_row_groups(spark, monkeypatch):
    """s13: what a task holds of the edges and nodes that it writes stays far below Parquet's 128 MB."""
    import pyarrow.parquet as pq

    from quillgraph.operators.tables import written
    from quillgraph.plans import files as plans
    from quillgraph.sources import files

    made = written(spark.range(400_000).selectExpr("xxhash64(id) as a", "xxhash64(-id) as b").coalesce(1), 1 << 20)
    assert pq.ParquetFile(made.inputFiles()[0].removeprefix("file://")).num_row_groups > 3
    sizes = []
    for module in (plans, files):
        monkeypatch.setattr(module, "written", lambda d, group=None: sizes.append(group) or written(d, group))
    QUERIES["s13_gexf_nodes"](spark, "/root/testdata/sf0.001")
    assert len(sizes) == 2 and all(x and x <= 16 << 20 for x in sizes)
