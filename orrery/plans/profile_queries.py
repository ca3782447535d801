"""AGG*, PV*, ENC*, IMP*, PL*: profiling, reshaping, encoding, imputation and plot data on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import encode as EN
from orrery.operators import impute as I
from orrery.operators import plotdata as PL
from orrery.operators import profile as P
from orrery.operators import reshape as R
from orrery.plans.registry import query
from orrery.plans.tables import SQL_AB, SQL_BANDS, SQL_MEASURES

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(template: str, names, joiner=" union all ") -> str:
    return joiner.join(template.replace("{c}", n) for n in names)


# -- AGG ---------------------------------------------------------------------------------------------------------------
@query(
    "agg01_null_counts",
    sql=_union(
        f"select '{{c}}' as feature, count(*) filter ({{c}} is null) as nulls, round(count(*) filter ({{c}} is null) / count(*), 6) as share from {SQL_MEASURES}",
        ["l_orderkey", "l_linenumber", "l_partkey", *NUMBERS],
    ),
)
def agg01(t):
    return P.null_counts(t.measures()).withColumn("share", F.round("share", 6))


@query("agg02_mean_per_category", sql="select p_type, round(avg(p_retailprice), 6) as p_retailprice from part group by p_type")
def agg02(t):
    return P.mean_per_category(t.part, "p_type", "p_retailprice").withColumn("p_retailprice", F.round("p_retailprice", 6))


@query(
    "agg03_null_share_bands",
    sql="select vec_id, round((" + " + ".join(f"({b} is null)::int" for b in "ugriz") + f") / 5, 6) as pnan from {SQL_BANDS}",
)
def agg03(t):
    from orrery.operators.entities import null_share

    return null_share(t.bands(), ["u", "g", "r", "i", "z"]).select("vec_id", F.round("pnan", 6).alias("pnan"))


_SQL_PACKED = "(select p_partkey, p_type, case when p_partkey % 11 <> 0 then replace(p_name, ' ', '; ') end as packed from part)"


def _packed(t):
    return t.part.select(
        "p_partkey", "p_type", F.when(F.col("p_partkey") % 11 != 0, F.replace("p_name", F.lit(" "), F.lit("; "))).alias("packed")
    )


@query(
    "agg04_category_values",
    sql=f"""select trim(v) as packed, count(*) as n from (select unnest(list_distinct(string_split(coalesce(packed, 'nan'), ';'))) as v from {_SQL_PACKED}) group by 1""",
)
def agg04(t):
    values = P.category_values(_packed(t), "packed", ";")
    return values.groupBy("packed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg05_frequencies",
    sql=f"""select trim(v) as packed, count(*) as n, round(count(*) / (select count(*) from part), 6) as share
 from (select unnest(list_distinct(string_split(coalesce(packed, 'nan'), ';'))) as v from {_SQL_PACKED}) group by 1""",
)
def agg05(t):
    return P.frequencies(_packed(t), "packed", ";", share=True).withColumn("share", F.round("share", 6))


@query(
    "agg06_categorical_overview",
    sql=f"""select feature, trim(v) as value, count(*) as n from (
 select 'p_type' as feature, unnest(list_distinct(string_split(p_type, ';'))) as v from {_SQL_PACKED} union all
 select 'packed', unnest(list_distinct(string_split(coalesce(packed, 'nan'), ';'))) from {_SQL_PACKED}) group by 1, 2""",
)
def agg06(t):
    return P.categorical_overview(_packed(t))


_SQL_CORR = "(" + " union all ".join(
    f"select '{a}' as feature, '{b}' as other, corr({a}, {b}) as r from {SQL_MEASURES}" if a != b else f"select '{a}' as feature, '{a}' as other, 1.0::double as r"
    for a in NUMBERS
    for b in NUMBERS
) + ")"


@query("agg07_correlation_matrix", sql=f"select feature, other, round(r, 6) as r from {_SQL_CORR}")
def agg07(t):
    return P.correlation_matrix(t.measures(), NUMBERS).withColumn("r", F.round("r", 6))


@query(
    "agg08_target_correlations",
    sql=f"select feature, round(r, 6) as correlation from {_SQL_CORR} where other = 'l_extendedprice' and abs(r) > 0.01",
)
def agg08(t):
    out = P.target_correlations(t.measures(), NUMBERS, "l_extendedprice", 0.01)
    return out.withColumn("correlation", F.round("correlation", 6))


@query(
    "agg09_reduce_collinear",
    sql="select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount from lineitem",
)
def agg09(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount").withColumn(
        "price_again", F.col("l_extendedprice") * 2 + 1
    )
    return P.reduce_collinear(df, ["l_quantity", "l_extendedprice", "l_discount", "price_again"])


@query(
    "agg10_describe",
    sql=_union(
        f"""select '{{c}}' as feature, count({{c}}) as count, round(avg({{c}}), 4) as mean, round(stddev_samp({{c}}), 4) as std, min({{c}}) as min,
 round(quantile_cont({{c}}, 0.25), 6) as q25, round(quantile_cont({{c}}, 0.5), 6) as q50, round(quantile_cont({{c}}, 0.75), 6) as q75, max({{c}}) as max from {SQL_MEASURES}""",
        NUMBERS,
    ),
)
def agg10(t):
    out = P.describe(t.measures(), NUMBERS)
    return out.select("feature", "count", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "std")], *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


@query(
    "agg11_rank_correlations",
    sql="""with p as (select l_quantity as x, l_discount as y from lineitem),
 r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from p),
 c as (select x, y, count(*) as n from p group by all),
 s as (select sum(a.n::double * b.n) filter (a.x < b.x and a.y < b.y) as con, sum(a.n::double * b.n) filter (a.x < b.x and a.y > b.y) as dis,
 sum(a.n::double * b.n) filter (a.x < b.x) as ux, sum(a.n::double * b.n) filter (a.y < b.y) as uy from c a, c b)
 select round((select corr(x, y) from p), 6) as pearson, round((select corr(rx, ry) from r), 6) as spearman,
 round((con - dis) / sqrt(ux * uy), 6) as kendall from s""",
)
def agg11(t):
    out = P.rank_correlations(t.lineitem, "l_quantity", "l_discount")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_SQL_JUDGED = "(select quality as label, case when n_chars > 500 then 1 else 0 end as prediction from labels join documents using (doc_id))"


def _judged(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("prediction"), "n_chars"
    )


@query("agg12_confusion", sql=f"select prediction as predicted, label as actual, count(*) as n from {_SQL_JUDGED} group by all")
def agg12(t):
    return P.confusion(_judged(t))


def _sql_scores(source: str) -> str:
    return f"""select l as label, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from (
 select l, count(*) filter (label = l and prediction = l) / nullif(count(*) filter (prediction = l), 0) as p,
 count(*) filter (label = l and prediction = l) / nullif(count(*) filter (label = l), 0) as r from {source}, (values (0), (1)) v(l) group by l)"""


@query("agg13_label_scores", sql=_sql_scores(_SQL_JUDGED))
def agg13(t):
    out = P.label_scores(P.confusion(_judged(t)))
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg14_accuracy", sql=f"select round(avg((label = prediction)::int), 6) as accuracy from {_SQL_JUDGED}")
def agg14(t):
    return P.accuracy(_judged(t)).select(F.round("accuracy", 6).alias("accuracy"))


_SQL_CUT = "(select quality as label, case when n_chars / 2000 >= 0.5 then 1 else 0 end as prediction from labels join documents using (doc_id))"


@query(
    "agg15_threshold_performance",
    sql=f"select s.*, round((select avg((label = prediction)::int) from {_SQL_CUT}), 6) as accuracy from ({_sql_scores(_SQL_CUT)}) s",
)
def agg15(t):
    out = P.threshold_performance(_judged(t).withColumn("score", F.col("n_chars") / 2000), "label", "score")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "agg16_regression_scores",
    sql="""select round(1 - sum(pow(l_extendedprice - 1400 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) as r2,
 round(sqrt(avg(pow(l_extendedprice - 1400 * l_quantity, 2))), 4) as rmse from lineitem""",
)
def agg16(t):
    df = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * 1400).alias("guess"))
    return P.regression_scores(df, "l_extendedprice", "guess").select(F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"))


@query("agg17_positive_share", sql="select round(100 * avg(quality), 6) as percent from labels")
def agg17(t):
    return P.positive_share(t.labels, "quality").select(F.round("percent", 6).alias("percent"))


# -- PV ----------------------------------------------------------------------------------------------------------------
@query(
    "pv01_pivot_max",
    sql="""select o_orderpriority, max(o_totalprice) filter (o_orderstatus = 'F') as "F", max(o_totalprice) filter (o_orderstatus = 'O') as "O",
 max(o_totalprice) filter (o_orderstatus = 'P') as "P" from orders group by 1""",
)
def pv01(t):
    return R.pivot_max(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query(
    "pv02_pivot_last",
    sql="""select o_custkey, arg_max(o_totalprice, o_orderkey) filter (o_orderstatus = 'F') as "F", arg_max(o_totalprice, o_orderkey) filter (o_orderstatus = 'O') as "O",
 arg_max(o_totalprice, o_orderkey) filter (o_orderstatus = 'P') as "P" from orders group by 1""",
)
def pv02(t):
    return R.pivot_last(t.orders, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O", "P"])


@query(
    "pv02_duplicate_cells",
    sql="select o_custkey, o_orderstatus, count(*) as n from orders group by all having count(*) > 1",
)
def pv02_duplicates(t):
    return R.duplicate_cells(t.orders, "o_custkey", "o_orderstatus")


_SQL_TOTALS = "(select o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) as total from orders group by all)"


@query(
    "pv03_pivot_unique",
    sql=f"""select o_orderpriority, max(total) filter (o_orderstatus = 'F') as "F", max(total) filter (o_orderstatus = 'O') as "O",
 max(total) filter (o_orderstatus = 'P') as "P" from {_SQL_TOTALS} group by 1""",
)
def pv03(t):
    totals = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return R.pivot_unique(totals, "o_orderpriority", "o_orderstatus", "total", ["F", "O", "P"])


@query(
    "pv04_melt",
    sql=_union("select l_orderkey, l_linenumber, l_partkey, l_suppkey, '{c}' as variable, {c} as value from lineitem", NUMBERS),
)
def pv04(t):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return R.melt(t.lineitem.select(*ids, *NUMBERS), ids)


_LINES = ["H_alpha", "H_beta", "Ly_alpha"]


@query(
    "pv05_lines_wide",
    sql="""select vec_id as objid, embedding[1]::double as "H_alpha", embedding[2]::double as "H_beta", embedding[3]::double as "Ly_alpha" from embeddings""",
)
def pv05(t):
    lines = t.embeddings.select(
        F.col("vec_id").alias("objid"),
        F.posexplode(F.slice("embedding", 1, 4)).alias("i", "chi2"),
    ).select(
        "objid",
        F.get(F.array(*[F.lit(n) for n in [*_LINES, "N_V 1240"]]), F.col("i")).alias("linename"),
        F.col("chi2").cast("double").alias("linechi2"),
    )
    return R.lines_wide(lines, _LINES)


# -- ENC ---------------------------------------------------------------------------------------------------------------
def _label(v: str) -> str:
    import string

    words = "".join(c for c in v if c not in string.punctuation).split()
    return "".join(w.capitalize() for w in words)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "enc01_one_hot",
    sql="select o_orderkey, "
    + ", ".join(f"(o_orderstatus = '{v}')::int as \"o_orderstatus_{v}\"" for v in "FOP")
    + ", "
    + ", ".join(f"(o_orderpriority = '{v}')::int as \"o_orderpriority_{_label(v)}\"" for v in PRIORITIES)
    + " from orders",
)
def enc01(t):
    return EN.one_hot(t.orders, ["o_orderstatus", "o_orderpriority"], keep=["o_orderkey"])


@query(
    "enc02_multi_value_one_hot",
    sql="""select p_type_group, sum(contains(packed, 'anvil')::int)::bigint as anvil, sum(contains(packed, 'ring')::int)::bigint as ring, sum(contains(packed, 'red')::int)::bigint as red,
 sum(list_contains(string_split(packed, ';'), 'red')::int)::bigint as red_exact from (select p_type as p_type_group, replace(p_name, ' ', ';') || ';scored' as packed from part) group by 1""",
)
def enc02(t):
    df = t.part.select("p_partkey", F.col("p_type").alias("p_type_group"), F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit(";scored")).alias("kw"))
    loose = EN.one_hot(df, ["kw"], keep=["p_partkey", "p_type_group"], sep=";")
    exact = EN.one_hot(df, ["kw"], keep=["p_partkey"], sep=";", exact=True).select("p_partkey", F.col("kw_Red").alias("red_exact"))
    return (
        loose.join(exact, "p_partkey")
        .groupBy("p_type_group")
        .agg(F.sum("kw_Anvil").alias("anvil"), F.sum("kw_Ring").alias("ring"), F.sum("kw_Red").alias("red"), F.sum("red_exact").alias("red_exact"))
    )


@query(
    "enc03_tag_indicators",
    sql="""select p_partkey, """
    + ", ".join(f"list_contains(string_split(p_name, ' '), '{w}')::int as {w}" for w in ("small", "red", "ring", "widget"))
    + " from part",
)
def enc03(t):
    tags = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))
    return EN.indicator_columns(tags, "p_partkey", "tag", ["small", "red", "ring", "widget"])


@query(
    "enc03_tag_positions",
    sql="""with w as (select p_partkey, unnest(list_distinct(string_split(p_name, ' '))) as tag from part),
 v as (select tag, row_number() over (order by tag) - 1 as position from (select distinct tag from w))
 select p_partkey, string_agg(position::varchar, ',' order by position) as positions from w join v using (tag) group by p_partkey""",
)
def enc03_positions(t):
    tags = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))
    _, hits = EN.indicator_vectors(tags, "p_partkey", "tag")
    return hits.select("p_partkey", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(
    "enc04_object_matrix",
    sql="""select p_partkey, p_size::double as p_size, p_retailprice, (kind = 'NA')::int as "kind_Na", """
    + ", ".join(f"(kind = '{k}')::int as \"kind_{k.capitalize()}\"" for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " from (select *, case when p_partkey % 5 = 0 then 'NA' else p_type end as kind from part)",
)
def enc04(t):
    df = t.part.withColumn("kind", F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_type")))
    return EN.object_matrix(df, "p_partkey", ["p_size", "p_retailprice"], ["kind"])


# -- IMP ---------------------------------------------------------------------------------------------------------------
_SQL_ROW = "l_orderkey, l_linenumber, l_partkey, l_quantity"


@query("imp01_fill_mean", sql=f"select {_SQL_ROW}, round(coalesce(l_tax, (select avg(l_tax) from {SQL_MEASURES})), 6) as l_tax from {SQL_MEASURES}")
def imp01(t):
    out = I.fill_mean(t.measures(), ["l_tax"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round("l_tax", 6).alias("l_tax"))


@query("imp02_fill_median", sql=f"select {_SQL_ROW}, round(coalesce(l_tax, (select median(l_tax) from {SQL_MEASURES})), 6) as l_tax from {SQL_MEASURES}")
def imp02(t):
    out = I.fill_median(t.measures(), ["l_tax"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round("l_tax", 6).alias("l_tax"))


@query(
    "imp03_compare_by_null",
    sql=" union all ".join(
        f"""select l_tax is null as is_missing, '{c}' as feature, count({c}) as count, round(avg({c}), 4) as mean, round(quantile_cont({c}, 0.5), 6) as q50,
 count(*) filter ({c} is null) as nulls from {SQL_MEASURES} group by 1"""
        for c in NUMBERS
    ),
)
def imp03(t):
    out = I.compare_by_null(t.measures().select(*NUMBERS), "l_tax")
    return out.select("is_missing", "feature", "count", F.round("mean", 4).alias("mean"), F.round("q50", 6).alias("q50"), "nulls")


@query(
    "imp04_fill_group_mean",
    sql=f"""select {_SQL_ROW}, round(coalesce(l_tax, avg(l_tax) over (partition by l_quantity)), 6) as l_tax from {SQL_MEASURES}""",
)
def imp04_fill(t):
    out = I.fill_by_group_mean(t.measures(), "l_quantity", "l_tax")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round("l_tax", 6).alias("l_tax"))


@query("imp04_fill_by_cluster")
def imp04(t):
    return I.fill_by_cluster(t.measures(), "l_tax", ignore=["l_orderkey", "l_linenumber", "l_partkey"], k=3)


@query("imp05_fill_all_by_cluster")
def imp05(t):
    gaps = t.measures().withColumn("l_discount", F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")))
    return I.fill_all_by_cluster(gaps, ignore=["l_orderkey", "l_linenumber", "l_partkey"], k=15)


# -- PL ----------------------------------------------------------------------------------------------------------------
@query(
    "pl01_histogram",
    sql=f"""with s as (select variant, min(value) as lo, (max(value) - min(value)) / 50 as w from {SQL_AB} group by variant)
 select variant, least(floor((value - lo) / w), 49)::integer as bin, round(lo + w * least(floor((value - lo) / w), 49), 6) as lower, count(*) as n
 from {SQL_AB} join s using (variant) group by all""",
)
def pl01(t):
    out = PL.histogram(t.ab(), "value", 50, ["variant"])
    return out.select("variant", "bin", F.round("lower", 6).alias("lower"), "n")


@query(
    "pl02_box_numbers",
    sql=f"""with q as (select variant, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from {SQL_AB} group by 1)
 select variant, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, min(value) filter (value >= q1 - 1.5 * (q3 - q1)) as low_whisker,
 max(value) filter (value <= q3 + 1.5 * (q3 - q1)) as high_whisker,
 count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as outliers from {SQL_AB} join q using (variant) group by variant, q1, median, q3""",
)
def pl02(t):
    out = PL.box_numbers(t.ab(), "value", ["variant"])
    return out.select("variant", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "low_whisker", "high_whisker", "outliers")


@query("pl03_heat_map", sql=f"select feature, other, round(r, 6) as r from {_SQL_CORR}")
def pl03(t):
    return PL.heat_map(t.measures(), NUMBERS).withColumn("r", F.round("r", 6))


@query("pl04_scatter_sample")
def pl04(t):
    return PL.scatter_sample(t.measures(), NUMBERS, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("pl05_actual_vs_predicted")
def pl05(t):
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1400).alias("predicted")
    )
    scores = P.regression_scores(df, "actual", "predicted")
    points = PL.jittered(df, ["actual", "predicted"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return points.join(F.broadcast(scores))
