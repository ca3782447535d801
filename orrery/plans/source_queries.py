"""SRC* and SNK*: the driver tables written in each format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.plans.registry import query
from orrery.plans.tables import SQL_EDGES
from orrery.session import fresh_path
from orrery.sources import files as FS

ORDER_COLUMNS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING"
_SQL_ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("src01_csv", sql=_SQL_ORDERS)
def src01(t):
    path = fresh_path(t.spark, "orders-csv")
    _orders(t).write.csv(path, sep=";", header=True)
    return FS.read_csv(t.spark, path, ORDER_COLUMNS, sep=";", header=True)


def _grouped_json(t):
    """Arrays of at most 1000 order records, one text per group of keys."""
    record = F.struct(*_orders(t).columns)
    groups = _orders(t).groupBy(F.floor(F.col("o_orderkey") / 1000).alias("grp")).agg(F.collect_list(record).alias("rows"))
    return groups.select("grp", F.to_json("rows").alias("value"))


@query("src02_json", sql=_SQL_ORDERS)
def src02(t):
    path = fresh_path(t.spark, "orders-json")
    # Several arrays per file, one a line: the number of files follows the tasks, not the rows.
    _grouped_json(t).select("value").write.text(path)
    return FS.read_json(t.spark, path, ORDER_COLUMNS, multi_line=False).select(*[c.split()[0] for c in ORDER_COLUMNS.split(", ")])


@query("src03_api_payload", sql=_SQL_ORDERS)
def src03(t):
    """Every group is an answer, and every second one is followed by an empty answer."""
    payload = F.concat(F.lit('[{"page": 1, "total": 9}, '), "value", F.lit("]"))
    answers = F.when(F.col("grp") % 2 == 0, F.array(payload, F.lit("[]"))).otherwise(F.array(payload))
    return FS.api_rows(_grouped_json(t).select(F.explode(answers).alias("payload")), "payload", ORDER_COLUMNS.replace(" BIGINT", ": BIGINT").replace(" STRING", ": STRING").replace(" DOUBLE", ": DOUBLE"))


@query(
    "src04_xml",
    sql="select n_name as name, n_nationkey::varchar as code, case when n_nationkey % 2 = 0 then 'r' || n_regionkey::varchar end as region from nation union all select p_name, p_partkey::varchar, null from part",
)
def src04(t):
    nation = t.nation.select(
        F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("code"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("region"),
    )
    both = FS.union_sources(nation, t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("code")))
    fields = F.array(*[F.struct(F.col(c).alias("_VALUE"), F.lit(c).alias("_name")) for c in ("name", "code", "region")])
    path = fresh_path(t.spark, "records-xml")
    both.select(F.filter(fields, lambda f: f["_VALUE"].isNotNull()).alias("field")).write.format("xml").option("rowTag", "record").save(path)
    return FS.read_xml(t.spark, path, ["name", "code", "region"])


def _work(t):
    from orrery.plans.tables import refcode

    papers = t.part.select(
        refcode(F.col("p_partkey"), F.col("p_brand")).alias("refcode"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.lit(None).cast("string").alias("link"), F.split("p_name", " ").alias("keywords"),
    )
    return {"papers": papers, "object_papers": t.edges()}


@query(
    "src06_load_work",
    sql="select 'papers' as part, count(*) as n from part union all select 'object_papers', count(*) from " + SQL_EDGES + " union all select 'objects', 0",
)
def src06(t):
    path = fresh_path(t.spark, "work")
    FS.save_tables(_work(t), path)
    papers, edges, objects = FS.load_work(t.spark, path)
    parts = [("papers", papers), ("object_papers", edges), ("objects", objects)]
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, df in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("src07_file_inventory")
def src07(t):
    return FS.file_inventory(t.spark, t.sf_dir, ".parquet")


@query(
    "src08_union",
    sql="select s_name as name, s_acctbal as balance, null::varchar as segment from supplier union all select c_name, c_acctbal, c_mktsegment from customer",
)
def src08(t):
    left = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return FS.union_sources(left, t.customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name")))


@query(
    "src09_preview",
    sql="""select * from (select 'head' as part, o_orderkey, o_totalprice, (select count(*) from orders) as rows_total from orders order by o_orderkey limit 3)
 union all select * from (select 'tail', o_orderkey, o_totalprice, (select count(*) from orders) from orders order by o_orderkey desc limit 3)""",
)
def src09(t):
    return FS.preview(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("snk01_save_tables", sql="select p_name as title, count(*) as n from part group by 1")
def snk01(t):
    path = fresh_path(t.spark, "saved")
    FS.save_tables(_work(t), path)
    return FS.load_table(t.spark, path, "papers", FS.PAPERS).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("snk02_save_matrices", sql="select p_partkey, p_size, round(p_retailprice, 2) as p_retailprice from part")
def snk02(t):
    from orrery.operators.projection import fit_pca

    frame = t.part.select("p_partkey", "p_size", "p_retailprice")
    path = fresh_path(t.spark, "matrices")
    names = t.spark.range(2).select(F.element_at(F.array(F.lit("p_size"), F.lit("p_retailprice")), (F.col("id") + 1).cast("int")).alias("feature"))
    FS.save_matrices({"matrix": frame, "features": names}, {"projection": fit_pca(frame, ["p_size", "p_retailprice"], 2)}, path)
    tables, models = FS.load_matrices(t.spark, path, ["matrix", "features"], ["projection"])
    restored = models["projection"].transform(tables["matrix"])
    return restored.select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("p_retailprice"))


@query(
    "snk04_recommendations_csv",
    sql="""select s_name as identifier, '1' as association, '[0.0, 0.0]' as scores, 'a' || chr(10) || 'b, "c"' as url, s_name || ' title' as title, null::varchar as description from supplier""",
)
def snk04(t):
    path = fresh_path(t.spark, "recommendations")
    rows = t.supplier.select(
        F.col("s_name").alias("identifier"), F.lit(1).alias("association"), F.lit("[0.0, 0.0]").alias("scores"), F.lit('a\nb, "c"').alias("url"),
        F.concat("s_name", F.lit(" title")).alias("title"), F.lit(None).cast("string").alias("description"),
    )
    FS.write_recommendations(rows, path)
    schema = ", ".join(f"{c} STRING" for c in ("identifier", "association", "scores", "url", "title", "description"))
    return FS.read_csv(t.spark, path, schema, header=True, escape='"', multiLine=True)
