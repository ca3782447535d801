"""JN06, ENC05, ML*, LM*, SNK03 and the streaming load: models on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.scalars import collapse_blanks
from orrery.operators import cluster as CL
from orrery.operators import encode as EN
from orrery.operators import factorise as FA
from orrery.operators import linear as LM
from orrery.operators import projection as PR
from orrery.operators import recommend as RC
from orrery.operators.distances import distance_quantile
from orrery.operators.profile import describe
from orrery.plans.entity_queries import SQL_SCORED, SQL_VOTED, scored
from orrery.plans.registry import query
from orrery.plans.tables import SQL_EDGE_KEYS, SQL_EDGES, SQL_OBJECTS, SQL_REFCODE, refcode, spread
from orrery.session import cut_lineage, fresh_path, rewritten


def _object_frame(t):
    """Suppliers as objects: balance, position and one-hot nation."""
    return EN.one_hot(
        t.objects().withColumn("nation", F.col("s_nationkey").cast("string")), ["nation"], keep=["objid", "seq", "s_acctbal", "ra", "dec"]
    )


def _object_projection(t, k=15):
    frame = _object_frame(t)
    return PR.fit_filled(frame, [c for c in frame.columns if c not in ("objid", "seq")], k)


def _object_components(t, k=15):
    """The objects, projected."""
    return _object_projection(t, k).project(_object_frame(t), ["objid"])


def _papers(t):
    return spread(t.part, "p_partkey").select(
        refcode(F.col("p_partkey"), F.col("p_brand")).alias("refcode"), F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"), F.split("p_name", " ").alias("keywords"), "p_partkey",
        F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("link"),
    )


def _paper_components(t, k=35):
    """Parts as papers: the article matrix, projected."""
    _, scores = PR.sparse_pca(EN.article_cells(_papers(t)), _papers(t).select("refcode"), "refcode", "feature", "value", k)
    return scores


def _groups(t):
    return t.objects().select("objid", F.col("s_nationkey").alias("cluster"))


@query("jn06_sample_pairs")
def jn06(t):
    return RC.sample_pairs(t.edges(), t.papers())


@query(
    "jn06_pair_counts",
    sql=f"""select objid, count(*) as positives, least(3 * count(*), (select count(*) from part) - count(*)) as negatives
 from {SQL_EDGES} group by objid""",
)
def jn06_counts(t):
    pairs = RC.sample_pairs(t.edges(), t.papers())  # distinct by construction
    return pairs.groupBy("objid").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


@query("enc05_article_matrix")
def enc05(t):
    return EN.article_cells(_papers(t))


@query("ml01_object_components")
def ml01(t):
    return _object_components(t)


@query("ml01_vector_components")
def ml01_vectors(t):
    names = [f"x{i}" for i in range(64)]
    frame = t.embeddings.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return PR.project(PR.fit_pca(frame, names, 15), frame, ["vec_id"])


@query("ml01_article_components")
def ml01_articles(t):
    return _paper_components(t)


def _trained(t):
    # As tables, so that joins see the true sizes of the vectors.
    objects, papers = rewritten(_object_components(t)), rewritten(_paper_components(t))
    pairs = cut_lineage(RC.sample_pairs(t.edges(), t.papers()))
    model, held_out = RC.fit_on_components(pairs, objects, papers)
    return objects, papers, model, held_out


@query("ml02_pair_classifier")
def ml02(t):
    from orrery.operators.profile import confusion, label_scores

    _, _, _, held_out = _trained(t)
    return label_scores(confusion(held_out.withColumn("prediction", F.col("prediction").cast("int"))))


@query("ml03_score_papers")
def ml03(t):
    objects, papers, model, _ = _trained(t)
    return RC.score_papers(model, objects, papers, t.edges(), ["Supplier#000000001", "Supplier#000000002"], threshold=0.0)


def _positions(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 360 + F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") * 17 % 180 + F.col("c_acctbal") / 2000).alias("y")
    )


@query("ml04_density_clusters")
def ml04(t):
    names = [f"x{i}" for i in range(8)]
    frame = t.embeddings.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return CL.dbscan(frame, "vec_id", names, 0.12)


_SQL_POINTS = """(select c_custkey as id, c_custkey * 37 % 360 + c_acctbal / 1000 as x, c_custkey * 17 % 180 + c_acctbal / 2000 as y from customer)"""


@query(
    "ml04_noise_points",
    sql=f"""with p as (select * from {_SQL_POINTS}), n as (select a.id, count(*) as near from p a join p b on sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 4 group by 1),
 c as (select p.* from p join n using (id) where near >= 5)
 select id, not exists (select 1 from c where sqrt((c.x - p.x)^2 + (c.y - p.y)^2) <= 4) as noise from p""",
)
def ml04_noise(t):
    return CL.dbscan(_positions(t), "id", ["x", "y"], 4.0).select("id", (F.col("label") == -1).alias("noise"))


@query(
    "ml05_median_distance",
    sql=f"""select quantile_cont(sqrt((a.x - b.x)^2 + (a.y - b.y)^2), 0.5) as median_distance from {_SQL_POINTS} a join {_SQL_POINTS} b on a.id < b.id""",
)
def ml05_median(t):
    return t.spark.createDataFrame([(distance_quantile(_positions(t), ["x", "y"]),)], "median_distance double")


@query("ml05_radius_candidates")
def ml05_search(t):
    points = t.objects().select("seq", F.col("ra").alias("x"), F.col("dec").alias("y"))
    return CL.radius_candidates(points, "seq", ["x", "y"])


_SQL_CANDIDATES = """(select user_id / 100 as eps, count(*) % 25 + 1 as nclusters, count(*) filter (event_type = 'error') % 6 as noise, 1 / (count(*) % 25 + 1) as distribution from events group by user_id)"""


@query(
    "ml05_choose_radius",
    sql=f"""with c as (select *, case when noise = 0 then 'inf'::double else nclusters + nclusters * distribution - log10(noise) end as score from {_SQL_CANDIDATES}),
 f as (select * from c where nclusters between 3 and 15), q as (select quantile_cont(distribution, 0.9) as a, quantile_cont(distribution, 0.1) as b, quantile_cont(noise, 0.8) as d from f),
 s as (select 0 as tier, score, eps from f, q where distribution between b and a and noise <= d union all select 1, score, eps from c where nclusters between 2 and 10)
 select eps from s order by tier, score desc, eps limit 1""",
)
def ml05(t):
    counted = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    candidates = counted.select(
        (F.col("user_id") / 100).alias("eps"), (F.col("n") % 25 + 1).alias("nclusters"), (F.col("e") % 6).alias("noise"), (1 / (F.col("n") % 25 + 1)).alias("distribution")
    )
    return CL.choose_radius(candidates)


@query(
    "ml06_cluster_papers",
    sql=f"select distinct s_nationkey as cluster, refcode, 1.0::double as r from {SQL_EDGES} join {SQL_OBJECTS} using (objid)",
)
def ml06(t):
    return FA.cluster_papers(_groups(t), t.edges())


def _ratings(t):
    keys = t.edge_keys().join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    return keys.select(F.col("s_nationkey").alias("cluster"), F.col("p_partkey").cast("int").alias("paper")).distinct().withColumn("r", F.lit(1.0).cast("float"))


@query("ml07_factor_scores")
def ml07(t):
    return FA.all_scores(FA.fit_factors(_ratings(t), "cluster", "paper", "r"), "cluster", "paper")


@query("ml07_squared_error")
def ml07_error(t):
    ratings = _ratings(t)
    return FA.squared_error(FA.fit_factors(ratings, "cluster", "paper", "r"), ratings, "r")


def _rows(t):
    cells = t.edge_keys().join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey").groupBy("p_partkey", "s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return FA.row_vectors(cells, "p_partkey", "s_nationkey", "v", list(range(25)))


@query(
    "ml08_full_rank",
    sql=f"""with c as (select l_partkey as p_partkey, s_nationkey, count(distinct l_suppkey) as v from lineitem join supplier on s_suppkey = l_suppkey group by all)
 select p_partkey, round(sum(v)::double, 4) as total, round(sum(v * v)::double, 4) as squares from c group by 1""",
)
def ml08(t):
    rows = cut_lineage(_rows(t))
    _, right = FA.singular_values(rows, "v", 25)
    near = FA.reconstruct(rows, "p_partkey", "v", right, 25)
    total = F.aggregate("approx", F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate("approx", F.lit(0.0), lambda s, x: s + x * x)
    return near.select("p_partkey", F.round(total, 4).alias("total"), F.round(squares, 4).alias("squares"))


@query("ml08_reduced_rank")
def ml08_reduced(t):
    rows = cut_lineage(_rows(t))
    _, right = FA.singular_values(rows, "v", 10)
    return FA.reconstruct(rows, "p_partkey", "v", right, 10).select("p_partkey", "approx")


@query("ml09_latent_features")
def ml09(t):
    return FA.latent_feature_errors(cut_lineage(_rows(t)), "p_partkey", "v", range(5, 26, 5))


_SQL_FACTORS = f"(select s_nationkey as cluster, {SQL_REFCODE} as refcode, ((s_nationkey * 13 + p_partkey * 7) % 100) / 100 as score from (select distinct s_nationkey, p_partkey from {SQL_EDGE_KEYS} k join supplier using (s_suppkey)) join part using (p_partkey))"


@query(
    "ml10_cluster_scores",
    sql=f"select objid, refcode, round(score, 6) as cf_score from {_SQL_FACTORS} f join {SQL_OBJECTS} o on o.s_nationkey = f.cluster",
)
def ml10(t):
    pairs = t.edge_keys().join(t.supplier, "s_suppkey").select("s_nationkey", "p_partkey").distinct()
    scores = pairs.join(t.part, "p_partkey").select(
        F.col("s_nationkey").alias("cluster"), refcode(F.col("p_partkey"), F.col("p_brand")).alias("refcode"), ((F.col("s_nationkey") * 13 + F.col("p_partkey") * 7) % 100 / 100).alias("score")
    )
    return RC.cluster_scores(_groups(t), scores).withColumn("cf_score", F.round("cf_score", 6))


@query(
    "ml11_vote",
    sql=f"""select objid, refcode, mlp_proba, associated, cf_score, round((mlp_proba + cf_score) / 2, 6) as recommend from {SQL_SCORED}
 where mlp_proba > 0.5 and refcode not in (select refcode from {SQL_EDGES} where objid = 'Supplier#000000001')
 qualify row_number() over (partition by objid order by (mlp_proba + cf_score) / 2 desc, refcode desc) <= 10""",
)
def ml11(t):
    ignore = t.edges().filter("objid = 'Supplier#000000001'")
    return RC.vote(scored(t), 10, ignore).withColumn("recommend", F.round("recommend", 6))


@query(
    "ml12_place_new_objects",
    sql="""with n as (select vec_id as new_id, embedding as e from embeddings where vec_id % 10 = 0),
 d as (select n.new_id, k.vec_id, k.label, sqrt(list_sum(list_transform(list_zip(n.e, k.embedding), lambda p: pow(p[1]::double - p[2]::double, 2)))) as dist from n, embeddings k where k.vec_id % 10 <> 0)
 select new_id::varchar as objid, arg_min(label, dist) as cluster, round(min(dist), 5) as distance from d group by 1""",
)
def ml12(t):
    vectors = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("pc"), F.col("label").alias("cluster"))
    new = vectors.filter("vec_id % 10 = 0").select(F.col("vec_id").cast("string").alias("objid"), "pc")
    known = vectors.filter("vec_id % 10 <> 0").select(F.col("vec_id").cast("string").alias("objid"), "pc", "cluster")
    return RC.place_new_objects(known, new).withColumn("distance", F.round("distance", 5))


_SQL_EVALUATED = f"""(select e.objid, coalesce(t / nullif(p, 0), 0) as precision, coalesce(t / e, 0) as recall, coalesce(2 * (t / p) * (t / e) / nullif(t / p + t / e, 0), 0) as f1
 from (select objid, count(*) as e from {SQL_EDGES} group by 1) e left join (select objid, count(*) as p, count(*) filter (associated = 1) as t from {SQL_VOTED} group by 1) g using (objid))"""


@query("ml13_evaluate", sql=f"select objid, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from {_SQL_EVALUATED}")
def ml13(t):
    out = RC.evaluate(RC.vote(scored(t), 10), t.edges())
    return out.select("objid", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("ml13_evaluate_sample")
def ml13_sample(t):
    sample = RC.sample_objects(t.objects(), 100)
    top = RC.vote(scored(t).join(sample, "objid", "left_semi"), 20)
    return describe(RC.evaluate(top, t.edges().join(sample, "objid", "left_semi")), ["precision", "recall", "f1"])


def _model(t):
    projection = _object_projection(t)
    objects = rewritten(projection.project(_object_frame(t), ["objid"]))
    return RC.build(objects, rewritten(_paper_components(t)), t.edges(), _groups(t), projection=projection)


def _requests(t):
    """One known object and one customer, who is a new object, of every nation; a new one's balance is not known."""
    known = t.supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("name")).withColumnsRenamed({"s_nationkey": "nation"})
    nation = F.col("c_nationkey").alias("nation")
    new = t.customer.groupBy(nation).agg(F.min("c_name").alias("name"), F.min("c_custkey").alias("key"))
    both = known.withColumn("key", F.lit(None).cast("bigint")).unionByName(new)
    flags = [(F.col("nation").cast("string") == c.split("_", 1)[1]).cast("int").alias(c) for c in _object_frame(t).columns if c.startswith("nation_")]
    place = (F.pmod(F.col("key") * 37, F.lit(360)).cast("double").alias("ra"), (F.pmod(F.col("key") * 17, F.lit(180)) - 90).cast("double").alias("dec"))
    turn = (F.col("nation") * 2 + F.col("key").isNotNull().cast("int")).alias("turn")
    return both.select(turn, "name", F.lit(None).cast("double").alias("s_acctbal"), *place, *flags)


@query("ml14_batch_recommendations")
def ml14(t):
    model = _model(t)
    given = model.recommend(_requests(t), 10)
    known = t.objects().select("objid", "ra", "dec")
    asked = _requests(t).select(F.col("name").alias("objid"), "ra", "dec").filter("ra is not null")
    return RC.recommendation_table(given, known.unionByName(asked), _papers(t).select("refcode", "title", "description", "link", "p_partkey"), "p_partkey")


@query(
    "snk03_model_bundle",
    sql=f"""with e as (select * from {SQL_EDGE_KEYS}), r as (select distinct s_nationkey, p_partkey from e join supplier using (s_suppkey))
 select 'objects' as part, count(*) as n from supplier union all select 'papers', count(*) from part union all select 'edges', count(*) from e
 union all select 'groups', count(*) from supplier union all select 'ratings', count(*) from r
 union all select 'scores', count(distinct s_nationkey) * count(distinct p_partkey) from r""",
)
def snk03(t):
    path = fresh_path(t.spark, "model")
    _model(t).save(path)
    restored = RC.Recommender.load(t.spark, path)
    parts = [(n, getattr(restored, n)) for n in RC.BUNDLE_TABLES]
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, df in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("ml15_rebuild")
def ml15(t):
    """Names cleaned, empty objects merged, gaps filled, matrices built, radius searched, objects clustered, models fitted,
    saved and read back, votes checked."""
    from orrery.operators import entities as E

    key = F.col("seq")
    bands = ["spec_u", "spec_g", "spec_r", "spec_i", "spec_z"]
    # Every ninth object has no band at all; others lack a single one here and there.
    gaps = [F.when((key % 9 != 0) & (key % 7 != i), F.col("s_acctbal") * (i + 1) + key).alias(b) for i, b in enumerate(bands)]
    objects = t.objects().select("seq", collapse_blanks(F.col("objid")).alias("objid"), "ra", "dec", *gaps)
    objects, edges = E.merge_empty_objects(objects, t.edges(), bands, [F.col("ra"), F.col("dec")])
    objects, edges = cut_lineage(objects.filter("objid <> ''").distinct()), cut_lineage(edges)
    projection = PR.fit_filled(objects, ["ra", "dec", *bands], 5)
    components = cut_lineage(projection.project(objects, ["objid", "seq"]))
    papers = cut_lineage(_paper_components(t))
    dims = [f"x{i}" for i in range(5)]
    placed = components.select("objid", "seq", *[F.get("pc", F.lit(i)).alias(d) for i, d in enumerate(dims)])
    radius = CL.choose_radius(CL.radius_candidates(placed, "seq", dims)).first()["eps"] or distance_quantile(placed, dims)
    groups = cut_lineage(CL.dbscan(placed, "seq", dims, radius).join(components.select("objid", "seq"), "seq").select("objid", F.col("label").alias("cluster")))
    path = fresh_path(t.spark, "rebuilt")
    RC.build(components.select("objid", "pc"), papers, edges, groups, projection=projection).save(path)
    bundle = RC.Recommender.load(t.spark, path)
    wanted = [r["objid"] for r in RC.sample_objects(objects, 100).collect()]
    asked = edges.filter(F.col("objid").isin(wanted))
    return describe(RC.evaluate(RC.vote(bundle.scored(wanted), 20), asked), ["precision", "recall", "f1"])


# -- linear models -----------------------------------------------------------------------------------------------------
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _prices(t):
    return t.lineitem.select(*ROW, *FEATURES, "l_extendedprice")


@query("lm01_linear_model")
def lm01(t):
    rows, weights, intercept, _ = LM.fit_linear(_prices(t), FEATURES, "l_extendedprice", ROW)
    return rows.select(*ROW, "pred", "delta")


DUMMIES = {"even": 2, "third": 3, "fifth": 5, "seventh": 7}


def _dummies(t):
    """Four 0/1 columns of falling frequency per part, and a price."""
    return t.part.select("p_partkey", "p_size", F.col("p_retailprice").alias("price"), *[(F.col("p_partkey") % m == 0).cast("int").alias(n) for n, m in DUMMIES.items()])


@query(
    "lm02_first_cutoff",
    sql="""select 'even' as feature, round(regr_r2(price, x), 8) as r2, round(regr_intercept(price, x), 4) as intercept, round(regr_slope(price, x), 4) as weight
 from (select p_retailprice as price, (p_partkey % 2 = 0)::int::double as x from part)""",
)
def lm02(t):
    """The sweep's fit on the single most frequent column, which SQL can state; the whole sweep is in lm02_cutoff_sweep."""
    single = next(r for r in LM.cutoff_sweep(_dummies(t), list(DUMMIES), "price") if len(r["columns"]) == 1)
    row = [(single["columns"][0], round(single["r2"], 8), round(single["intercept"], 4), round(single["weights"][0], 4))]
    return t.spark.createDataFrame(row, "feature string, r2 double, intercept double, weight double")


@query("lm02_cutoff_sweep")
def lm02_rows(t):
    rows = [(r["cutoff"], r["r2"], ",".join(r["columns"]), r["intercept"], r["best"]) for r in LM.cutoff_sweep(_dummies(t), list(DUMMIES), "price")]
    return t.spark.createDataFrame(rows, "cutoff double, r2 double, columns string, intercept double, best boolean")


@query("lm03_repeated_fits")
def lm03(t):
    return LM.mean_weights(LM.repeated_fits(_prices(t), FEATURES, "l_extendedprice", ROW))


@query("lm04_significance")
def lm04(t):
    return LM.significance(_prices(t), FEATURES, "l_extendedprice")


@query(
    "lm05_explain",
    sql="""select l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, weight, value, round(weight * value, 6) as product, round(100 + 1400 * l_quantity - 250.5 * l_discount, 6) as prediction
 from (select *, unnest(['l_quantity', 'l_discount']) as feature, unnest([1400.0::double, -250.5]) as weight, unnest([l_quantity, l_discount]) as value from lineitem)""",
)
def lm05(t):
    out = LM.explain_rows(_prices(t), ROW, ["l_quantity", "l_discount"], {"l_quantity": 1400.0, "l_discount": -250.5}, 100.0)
    return out.select(*ROW, "feature", "weight", "value", F.round("product", 6).alias("product"), F.round("prediction", 6).alias("prediction"))


@query("lm06_best_features")
def lm06(t):
    names = LM.best_features(LM.cutoff_sweep(_dummies(t), list(DUMMIES), "price"), ["p_size", "price"], exclude=["price"])
    return t.spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, feature string")


@query(
    "dd08_ingest_stream",
    sql="""select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders
 qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""",
)
def dd08_stream(t):
    from orrery.streaming.ingest import run_available

    source, target = fresh_path(t.spark, "arriving"), fresh_path(t.spark, "objects")
    records = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    records.repartition(4, "o_orderkey").write.parquet(source)
    return run_available(t.spark, source, records.schema, target, "o_custkey", "o_orderkey", files_per_batch=2)
