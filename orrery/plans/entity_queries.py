"""JN*, DD*, TK*: joins, de-duplication, incremental load and top-k on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import entities as E
from orrery.operators import nearest as N
from orrery.plans.registry import query
from orrery.plans.tables import SQL_EDGE_KEYS, SQL_EDGES, SQL_OBJECTS, SQL_REFCODE, refcode

SQL_PAPERS = f"(select {SQL_REFCODE} as refcode, * from part)"


@query(
    "jn01_merge_rows",
    sql="select p_partkey, p_size, p_retailprice, case when p_type = 'ECONOMY' then 1 else 0 end as economy from part",
)
def jn01(t):
    dummies = t.part.select("p_partkey", (F.col("p_type") == "ECONOMY").cast("int").alias("economy"))
    return E.merge_rows(dummies, t.part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey")


@query(
    "jn02_paper_details",
    sql=f"""select ids.refcode, p.p_name as title, p.p_retailprice as price from (
 select distinct {SQL_REFCODE} as refcode from (select l_partkey + 100 as p_partkey, 'Brand#' || (l_partkey % 25)::varchar as p_brand from lineitem)) ids
 left join {SQL_PAPERS} p using (refcode)""",
)
def jn02(t):
    ids = t.lineitem.select(
        refcode(F.col("l_partkey") + 100, F.concat(F.lit("Brand#"), (F.col("l_partkey") % 25).cast("string"))).alias("refcode")
    ).distinct()
    papers = t.papers().select("refcode", "p_partkey", F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    return E.paper_details(ids, papers, "refcode", "p_partkey").select("refcode", "title", "price")


@query(
    "jn03_known_edges",
    sql=f"select objid, refcode from {SQL_EDGES} where refcode in (select refcode from {SQL_PAPERS} where p_partkey % 5 <> 0)",
)
def jn03(t):
    return E.known_edges(t.edges(), t.papers().filter("p_partkey % 5 <> 0"), "refcode").select("objid", "refcode")


@query(
    "jn04_unseen_papers",
    sql=f"select refcode, p_name from {SQL_PAPERS} where refcode not in (select refcode from {SQL_EDGES} where objid = 'Supplier#000000003')",
)
def jn04(t):
    """Papers that one object is not linked to."""
    return E.unseen(t.papers().select("refcode", "p_name"), t.edges().filter("objid = 'Supplier#000000003'"), "refcode")


@query(
    "jn05_object_by_papers",
    sql=f"""select 'Supplier#000000003' as objid, p.refcode, case when e.refcode is null then 0 else 1 end as associated
 from {SQL_PAPERS} p left join (select refcode from {SQL_EDGES} where objid = 'Supplier#000000003') e using (refcode)""",
)
def jn05(t):
    return E.pair_with_papers(t.papers().select("refcode"), t.edges(), ["Supplier#000000003"]).select("objid", "refcode", "associated")


@query(
    "jn07_name_contains",
    sql=f"""select name, arg_min(objid, seq) as objid from (values ('Supplier#0000000'), ('#00000001'), ('  Supplier#000000042 '), ('supplier'), ('9')) q(name)
 join {SQL_OBJECTS} on contains(objid, trim(name)) group by name""",
)
def jn07(t):
    names = ["Supplier#0000000", "#00000001", "  Supplier#000000042 ", "supplier", "9"]
    return E.first_containing(t.objects(), names, "objid", "seq")


@query(
    "jn08_coordinates",
    sql=f"""select c.c_custkey, o.objid, o.ra, o."dec" from customer c join {SQL_OBJECTS} o
 on o.seq = c.c_custkey""",
)
def jn08(t):
    names = t.customer.select(
        "c_custkey", F.concat(F.lit("  SUPPLIER#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(" ")).alias("name")
    )
    return E.coordinates_of(t.objects(), names, "objid", "ra", "dec").select("c_custkey", "objid", "ra", "dec")


def _nearest_sql(distance: str) -> str:
    return f"""select a.objid, arg_min(b.objid, ({distance}, b.seq)) as nearest, round(min({distance}), 6) as distance
 from {SQL_OBJECTS} a join {SQL_OBJECTS} b on a.seq % 9 = 0 and b.seq % 9 <> 0 group by a.objid"""


def _nearest(t, position):
    objects = t.objects()
    found = N.nearest_other(objects.filter("seq % 9 = 0"), objects.filter("seq % 9 <> 0"), "objid", position, "seq")
    return found.select("objid", "nearest", F.round("distance", 6).alias("distance"))


@query("jn09_nearest_other", sql=_nearest_sql('sqrt((a.ra - b.ra)^2 + (a."dec" - b."dec")^2)'))
def jn09(t):
    return _nearest(t, [F.col("ra"), F.col("dec")])


@query("jn09_nearest_other_ra", sql=_nearest_sql("abs(a.ra - b.ra)"))
def jn09_ra(t):
    return _nearest(t, [F.col("ra")])


@query(
    "jn09_nearest_other_sky",
    sql=_nearest_sql(
        """round(2 * sqrt(pow(sin(radians(a."dec" - b."dec") / 2), 2)
 + cos(radians(a."dec")) * cos(radians(b."dec")) * pow(sin(radians(a.ra - b.ra) / 2), 2)), 10)"""
    ),
)
def jn09_sky(t):
    return _nearest(t, N.sky_vector(F.col("ra"), F.col("dec")))


@query(
    "jn10_group_papers",
    sql=f"select distinct s_nationkey, refcode from {SQL_EDGES} join {SQL_OBJECTS} using (objid)",
)
def jn10(t):
    return E.papers_of_group(t.objects(), t.edges(), "s_nationkey")


@query(
    "dd01_keep_last",
    sql="""select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders
 qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""",
)
def dd01(t):
    return E.keep_last(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), "o_custkey", "o_orderkey")


@query("dd02_drop_copies", sql="select distinct l_returnflag, l_linestatus, l_quantity, l_discount from lineitem")
def dd02(t):
    return E.drop_copies(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


_SQL_MOVES = """(select s_name as from_id, 'Supplier#' || lpad((s_suppkey + 7)::varchar, 9, '0') as to_id from supplier where s_suppkey % 10 = 0)"""


def _moves(t):
    target = F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") + 7).cast("string"), 9, "0"))
    return t.supplier.filter("s_suppkey % 10 = 0").select(F.col("s_name").alias("from_id"), target.alias("to_id"))


@query(
    "dd03_transfer_papers",
    sql=f"""select objid, refcode from {SQL_EDGES} union select m.to_id, e.refcode from {SQL_EDGES} e join {_SQL_MOVES} m on m.from_id = e.objid
 where m.to_id in (select s_name from supplier)""",
)
def dd03(t):
    return E.transfer_edges(t.edges(), _moves(t), t.objects())


@query(
    "dd04_rename_object",
    sql=f"select coalesce(m.to_id || 'x', e.objid) as objid, e.refcode from {SQL_EDGES} e left join {_SQL_MOVES} m on m.from_id = e.objid",
)
def dd04(t):
    renames = _moves(t).select(F.col("from_id").alias("old_id"), F.concat("to_id", F.lit("x")).alias("new_id"))
    return E.rename_objects(t.edges(), renames)


@query("dd05_remove_object", sql=f"select objid, refcode from {SQL_EDGES} where objid not in (select from_id from {_SQL_MOVES})")
def dd05(t):
    return E.remove_objects(t.edges(), _moves(t).select(F.col("from_id").alias("objid"))).select("objid", "refcode")


_SQL_NAMED = """(select s_suppkey as seq, case when s_suppkey % 18 = 0 then 'M ' || s_suppkey::varchar else s_name end as objid,
 ((s_suppkey*37) % 360)::double as ra, (((s_suppkey*17) % 180) - 90)::double as "dec", s_suppkey % 9 = 0 as empty, s_name from supplier)"""


@query(
    "dd06_merge_empty_objects",
    sql=f"""with o as {_SQL_NAMED}, mv as (select a.objid as from_id, a.seq, arg_min(b.objid, ((a.ra - b.ra)^2 + (a."dec" - b."dec")^2, b.seq)) as to_id
 from o a join o b on a.empty and not b.empty group by all),
 rn as (select to_id, arg_min(from_id, seq) as new_id from mv where starts_with(from_id, 'M') group by to_id),
 e as (select o.objid, x.refcode, o.empty from {SQL_EDGES} x join o on o.s_name = x.objid),
 k as (select objid, refcode from e where not empty union select mv.to_id, e.refcode from e join mv on mv.from_id = e.objid)
 select coalesce(rn.new_id, k.objid) as objid, count(*) as papers, min(refcode) as first_paper, max(refcode) as last_paper
 from k left join rn on rn.to_id = k.objid group by 1""",
)
def dd06(t):
    key = F.col("s_suppkey")
    named = F.when(key % 18 == 0, F.concat(F.lit("M "), key.cast("string"))).otherwise(F.col("s_name"))
    bands = ["spec_u", "spec_g", "spec_r", "spec_i", "spec_z"]
    objects = t.objects().withColumnRenamed("objid", "s_name").withColumn("s_suppkey", F.col("seq"))
    objects = objects.select(
        "seq", named.alias("objid"), "ra", "dec", "s_name", *[F.when(key % 9 != 0, F.col("s_acctbal") + i).alias(b) for i, b in enumerate(bands)]
    )
    edges = t.edges().withColumnRenamed("objid", "s_name").join(objects.select("s_name", "objid"), "s_name").select("objid", "refcode")
    _, merged = E.merge_empty_objects(objects, edges, bands, [F.col("ra"), F.col("dec")])
    return merged.groupBy("objid").agg(
        F.count(F.lit(1)).alias("papers"), F.min("refcode").alias("first_paper"), F.max("refcode").alias("last_paper")
    )


@query(
    "dd07_category_mapping",
    sql="""select p_brand, arg_max(p_type, seen) as p_type from (select p_brand, p_type, min(p_partkey) as seen from part group by all) group by p_brand""",
)
def dd07(t):
    return E.category_mapping(t.part, "p_brand", "p_type", "p_partkey")


_SQL_RECORDS = "select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders"


def _records(t, known):
    """A third of the orders is known already, the others arrive."""
    third = F.col("o_orderkey") % 3 == 0
    return t.orders.filter(third if known else ~third).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "dd08_ingest_refresh",
    sql=f"""select * from ({_SQL_RECORDS})
 qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""",
)
def dd08(t):
    known = E.keep_last(_records(t, True), "o_custkey", "o_orderkey")
    return E.ingest_objects(known, _records(t, False), "o_custkey", "o_orderkey")


@query(
    "dd08_ingest_keep_known",
    sql=f"""select * from ({_SQL_RECORDS})
 qualify row_number() over (partition by o_custkey order by least(o_orderkey % 3, 1), o_orderkey desc) = 1""",
)
def dd08_keep(t):
    known = E.keep_last(_records(t, True), "o_custkey", "o_orderkey")
    return E.ingest_objects(known, _records(t, False), "o_custkey", "o_orderkey", refresh=False)


@query(
    "dd08_ingest_papers",
    sql=f"""select refcode, p_name from {SQL_PAPERS} where p_partkey % 2 = 0
 or p_partkey in (select p_partkey from {SQL_EDGE_KEYS})""",
)
def dd08_papers(t):
    papers = t.papers().select("p_partkey", "refcode", "p_name")
    batch = papers.join(t.edge_keys().select("p_partkey"), "p_partkey")
    return E.ingest_papers(papers.filter("p_partkey % 2 = 0").drop("p_partkey"), batch.drop("p_partkey"))


@query(
    "tk01_first_k_by_score",
    sql=f"""select objid, refcode, score from (select s_name as objid, {SQL_REFCODE} as refcode, max(l_quantity) as score
 from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by all)
 qualify row_number() over (partition by objid order by score desc, refcode) <= 50""",
)
def tk01(t):
    scored = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("score"))
    biblio = (
        scored.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("s_name").alias("objid"), refcode(F.col("p_partkey"), F.col("p_brand")).alias("refcode"), "score")
    )
    return E.first_k(biblio, ["objid"], [F.col("score").desc_nulls_last(), F.col("refcode")], 50).drop("rank")


@query(
    "tk02_latest_per_object",
    sql=f"""select objid, refcode, row_number() over (partition by objid order by refcode desc)::integer as rank
 from {SQL_EDGES} qualify rank <= 10""",
)
def tk02(t):
    return E.latest_papers(t.edges(), 10)


SQL_SCORED = f"""(select s_name as objid, {SQL_REFCODE.replace("p_partkey", "part.p_partkey")} as refcode, ((l_suppkey*31 + l_partkey*17) % 101) / 100.0::double as mlp_proba,
 case when k.s_suppkey is null then 0 else 1 end as associated, ((l_suppkey*13 + l_partkey*7) % 100) / 100.0::double as cf_score
 from (select distinct l_suppkey, l_partkey from lineitem) x join part on part.p_partkey = l_partkey join supplier s on s.s_suppkey = l_suppkey
 left join {SQL_EDGE_KEYS} k on k.s_suppkey = x.l_suppkey and k.p_partkey = x.l_partkey)"""


def scored(t):
    """Scored pairs: every shipped (supplier, part) pair with two derived scores and the edge flag."""
    pairs = t.edge_keys()
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    flagged = pairs.join(t.edge_keys().withColumn("associated", F.lit(1)), ["s_suppkey", "p_partkey"], "left")
    return (
        flagged.join(t.part.select("p_partkey", "p_brand"), "p_partkey")
        .join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey")
        .select(
            F.col("s_name").alias("objid"),
            refcode(p, F.col("p_brand")).alias("refcode"),
            (((s * 31 + p * 17) % 101) / 100.0).alias("mlp_proba"),
            F.coalesce("associated", F.lit(0)).alias("associated"),
            (((s * 13 + p * 7) % 100) / 100.0).alias("cf_score"),
        )
    )


SQL_VOTED = f"""(select *, round((mlp_proba + cf_score) / 2, 6) as recommend from {SQL_SCORED} where mlp_proba > 0.5
 qualify row_number() over (partition by objid order by (mlp_proba + cf_score) / 2 desc, refcode desc) <= 10)"""


@query(
    "tk03_append_latest",
    sql=f"""select objid, refcode, mlp_proba, associated, cf_score, recommend from {SQL_VOTED} union all
 select * from (select objid, refcode, 0.0::double, 1, 0.0::double, 0.0::double from {SQL_EDGES}
 qualify row_number() over (partition by objid order by refcode desc) <= 10)""",
)
def tk03(t):
    from orrery.operators.recommend import vote

    return E.append_latest(vote(scored(t), k=10), t.edges(), 10).withColumn("recommend", F.round("recommend", 6))
