"""The projection of the provided tables onto citation concepts, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as By
from pyspark.sql import functions as F

from quillgraph.functions.vectors import block_scores
from quillgraph.operators.tables import ship
from quillgraph.operators.windows import Window, over_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The same tables as common table expressions; a later one may use those before it.
CTES = {
    "edges": """select src, dst, case when (src * 7 + dst) % 5 = 0 then '' else concat('cites ', dst, ' ', flag) end as sentence, src * 100000 + dst as pos
        from (select l_orderkey as src, l_partkey as dst, min(l_returnflag) as flag from lineitem where l_orderkey <> l_partkey group by 1, 2)""",
    "months": """select o_orderkey as id, case when o_orderkey % 17 = 0 then null else cast(year(o_orderdate) * 100 + month(o_orderdate) as integer) end as month from orders""",
    "parts": """select p_partkey as id, p_name as title, p_type as abstract, p_brand as brand from part""",
    "nodes": """select distinct id from (select src as id from edges union all select dst from edges)""",
    "indeg": """select dst as id, count(*) as indeg from edges group by 1""",
    "outdeg": """select src as id, count(*) as outdeg from edges group by 1""",
    "deg": """select coalesce(i.id, o.id) as id, cast(coalesce(indeg, 0) as bigint) as indeg, cast(coalesce(outdeg, 0) as bigint) as outdeg from indeg i full join outdeg o on i.id = o.id""",
    "vec": """select vec_id as id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings""",
    "win": """select q.id as qid, c.id as cid, cast(row_number() over (partition by q.id order by c.id) - 1 as bigint) as slot,
        case when c.id % 13 = 0 then null else round(coalesce(list_cosine_similarity(q.v, c.v), 0), 9) end as ce,
        round(-list_distance(q.v, c.v), 9) as gat, coalesce(q.label = c.label, false) as is_gold
        from vec q join vec c on q.id % 20 = 0 and q.id <> c.id""",
    "ranked": """select qid, cid, is_gold, cast(row_number() over (partition by qid order by gat desc, slot) as bigint) as ord from win""",
}
NEEDS = {"nodes": ("edges",), "indeg": ("edges",), "outdeg": ("edges",), "deg": ("indeg", "outdeg"), "win": ("vec",), "ranked": ("win",)}


def paper_id(n: Column) -> Column:
    """A number below 91,200,000 as an id of its own: 2401.nnnnn, and 2402 to 2412, 2501 and so on for each further 100,000."""
    month = F.floor(n / 100_000)
    yymm = (24 + F.floor(month / 12)) * 100 + month % 12 + 1
    return F.concat(F.lpad(yymm.cast("string"), 4, "0"), F.lit("."), F.lpad((n % 100_000).cast("string"), 5, "0"))


def short_id(i: Column) -> Column:
    """The SQL's text of a paper_id: 2401 and the number's first five digits, which from 100,000 on several numbers share."""
    month = (F.substring(i, 1, 2).cast("bigint") - 24) * 12 + F.substring(i, 3, 2).cast("bigint") - 1
    return F.concat(F.lit("2401."), F.lpad((month * 100_000 + F.substring(i, 6, 5).cast("bigint")).cast("string"), 5, "0"))


def sql_of(body: str, *ctes: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for c in ctes:
        add(c)
    parts = ", ".join(f"{n} as ({CTES[n]})" for n in order)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {parts}, {body[5:]}" if parts else body
    return f"with {parts} {body}" if parts else body


class Tables:
    """The projection's tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def edges(self) -> DataFrame:
        e = self.read("lineitem").filter("l_orderkey <> l_partkey").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.min("l_returnflag").alias("flag"))
        s = F.when((F.col("src") * 7 + F.col("dst")) % 5 == 0, "").otherwise(F.concat(F.lit("cites "), F.col("dst").cast("string"), F.lit(" "), "flag"))
        return e.select("src", "dst", s.alias("sentence"), (F.col("src") * 100000 + F.col("dst")).alias("pos"))

    @property
    def months(self) -> DataFrame:
        m = F.when(F.col("o_orderkey") % 17 != 0, F.year("o_orderdate") * 100 + F.month("o_orderdate"))
        return self.read("orders").select(F.col("o_orderkey").alias("id"), m.cast("int").alias("month"))

    @property
    def parts(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.col("p_brand").alias("brand"))

    @property
    def nodes(self) -> DataFrame:
        e = self.edges
        return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()

    @property
    def vec(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))

    @property
    def win(self) -> DataFrame:
        """Every query (ids divisible by 20) against all other rows, block by block; two channels, gold by equal label."""
        v = self.vec.select("id", F.col("v").alias("emb"))
        labels = self.vec.select("id", "label")
        d = block_scores(v.filter("id % 20 = 0"), v).filter("qid <> cid")
        d = d.join(labels.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").join(labels.select(F.col("id").alias("cid"), F.col("label").alias("cl")), "cid")
        slot = F.row_number().over(By.partitionBy("qid").orderBy("cid")) - 1
        ce = F.when(F.col("cid") % 13 != 0, F.round("cosine", 9))
        return d.select("qid", "cid", ce.alias("ce"), F.round(-F.col("distance"), 9).alias("gat"), F.coalesce(F.col("ql") == F.col("cl"), F.lit(False)).alias("is_gold"), slot.cast("bigint").alias("slot"))

    def windows(self, f: Callable[[Window], dict], schema: str, queries: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
        """What f makes of each whole window of win, without a shuffle of its pairs."""
        return self.all_windows(lambda ws: (f(w) for w in ws), schema, queries, rows)

    def all_windows(self, f: Callable[[Iterator[Window]], Iterator[dict]], schema: str, queries: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
        """As windows, with all windows of a task in one call; further columns of queries and rows come by id."""
        v = self.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), "label")
        q = v.filter("id % 20 = 0")
        return over_windows(q if queries is None else q.join(queries, "id", "left"), v if rows is None else v.join(rows, "id", "left"), f, schema)

    @property
    def ranked(self) -> DataFrame:
        o = F.row_number().over(By.partitionBy("qid").orderBy(F.col("gat").desc(), "slot"))
        return self.win.select("qid", "cid", "is_gold", o.cast("bigint").alias("ord"))


def query(name: str, sql: str | None = None, *ctes: str):
    """Registers a function of Tables as a query, with its SQL over the named table expressions."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql_of(sql, *ctes)
        return f

    return put
