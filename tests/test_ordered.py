import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import ordered as O
from orrery.operators import outliers as OU
from orrery.operators import resample as RS
from orrery.operators import stats as ST
from orrery.operators.nearest import nearest_other, sky_vector
from orrery.operators.profile import rank_correlations


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows is one key, and a third of them one value."""
    rng = np.random.default_rng(1)
    rows = [(int(k), float(np.round(v, 1)), i) for i, (k, v) in enumerate(zip(np.where(rng.random(3000) < 0.5, 0, rng.integers(0, 20, 3000)), rng.normal(5, 2, 3000)))]
    rows += [(0, 4.2, 10000 + i) for i in range(700)]
    return rows, spark.createDataFrame(rows, "k bigint, v double, id bigint").repartition(7).persist()


def test_quantiles_match_numpy(skewed):
    rows, df = skewed
    got = {(r["k"], r["q"]): r["quantile"] for r in O.quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.93, 1.0]).collect()}
    for k in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == k]
        for q in (0.0, 0.1, 0.5, 0.93, 1.0):
            assert got[(k, q)] == pytest.approx(np.quantile(values, q))


def test_number_rows_is_dense(skewed):
    rows, df = skewed
    got = O.number_rows(df, ["k"], ["v", "id"]).collect()
    for k in {r[0] for r in rows}:
        mine = sorted((r["v"], r["id"], r["pos"]) for r in got if r["k"] == k)
        assert [m[2] for m in mine] == list(range(len(mine)))


def test_quantiles_without_key_and_empty(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"))
    assert O.quantiles(df, [], "v", [0.25]).first()["quantile"] == 2.5
    assert O.quantiles(df.filter("v < 0"), [], "v", [0.25]).count() == 0


def brute_lof(values):
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    x = [values[i] for i in order]
    n = len(x)
    near = []
    for i in range(n):
        cand = sorted((abs(x[i] - x[j]), 0 if j < i else 1, abs(i - j), j) for j in range(max(0, i - 2), min(n, i + 3)) if j != i)
        near.append([(d, j) for d, _, _, j in cand[:2]])
    kd = [max(d for d, _ in nb) for nb in near]
    lrd = [1 / (np.mean([max(kd[j], d) for d, j in nb]) + 1e-10) for nb in near]
    lof = [np.mean([lrd[j] for _, j in nb]) / lrd[i] for i, nb in enumerate(near)]
    return {order[i]: lof[i] for i in range(n)}


def test_local_outliers_match_brute_force_across_blocks(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in np.round(rng.normal(0, 1, 300), 2)] + [9.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, id bigint, v double")
    got = {r["id"]: r["lof"] for r in OU.local_outliers(df, ["k"], "v", "id", block_rows=16).collect()}
    want = brute_lof(values)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-6)


def test_replace_all_matches_the_running_rule(spark):
    rng = np.random.default_rng(4)
    x = [float(v) for v in rng.normal(0, 1, 200)]
    df = spark.createDataFrame([(1, i, v, i == 7) for i, v in enumerate(x)], "k int, id bigint, v double, outlier boolean")
    got = {r["id"]: r["v"] for r in OU.replace_flagged(df, ["k"], "v", "id", mode="all", block_rows=32).collect()}
    y = list(x)
    for i in range(1, len(x) - 1):
        y[i] = (y[i - 1] + x[i + 1]) / 2
    assert [got[i] for i in range(len(x))] == pytest.approx(y, abs=1e-12)
    single = {r["id"]: r["v"] for r in OU.replace_flagged(df, ["k"], "v", "id", block_rows=32).collect()}
    assert single[7] == pytest.approx((x[6] + x[8]) / 2) and single[8] == x[8]


def test_bootstrap_interval_is_near_the_direct_one(skewed):
    rows, df = skewed
    values = np.array([r[1] for r in rows if r[0] == 0])
    rng = np.random.default_rng(0)
    direct = np.quantile([np.quantile(rng.choice(values, len(values)), 0.9) for _ in range(1000)], [0.025, 0.975])
    got = RS.quantile_interval(df.filter("k = 0"), ["k"], "v", 0.9, trials=1000).first()
    assert [got["low"], got["high"]] == pytest.approx(list(direct), abs=0.11)
    again = RS.quantile_interval(df.filter("k = 0").repartition(3), ["k"], "v", 0.9, trials=1000).first()
    assert (again["low"], again["high"]) == (got["low"], got["high"])


def test_permutation_p_is_near_the_direct_one(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 60), 3), np.round(rng.normal(-0.25, 1, 50), 3)
    rows = [(1, "A", float(v)) for v in a] + [(1, "B", float(v)) for v in b]
    df = spark.createDataFrame(rows, "k int, variant string, v double")
    got = RS.quantile_permutation(df, ["k"], "v", 0.5, trials=4000).first()
    both = np.concatenate([a, b])
    seen = np.quantile(b, 0.5) - np.quantile(a, 0.5)
    hits = 0
    for _ in range(4000):
        p = rng.permutation(both)
        hits += (np.quantile(p[60:], 0.5) - np.quantile(p[:60], 0.5)) <= seen
    assert got["observed"] == pytest.approx(seen)
    assert got["p_value"] == pytest.approx(hits / 4000, abs=0.04)


def test_mean_differences_centre_and_small_groups(spark):
    rows = [(1, "A", float(i), i) for i in range(400)] + [(1, "B", float(i) + 10, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, variant string, v double, id bigint")
    got = RS.mean_differences(df, ["k"], "v", "id", trials=400, size=100)
    row = got.agg(F.avg("difference"), F.count("difference")).first()
    assert row[1] == 400 and abs(row[0] - (159.5 - 199.5)) < 3
    full = RS.mean_differences(df, ["k"], "v", "id", trials=5, size=1000).agg(F.avg("difference")).first()[0]
    assert abs(full - (159.5 - 199.5)) < 12  # all of b, three quarters of a


def test_resampled_means_refuse_small_groups(spark):
    rows = [(1, float(i), i) for i in range(10)] + [(2, float(i), 100 + i) for i in range(50)]
    got = RS.resampled_means(spark.createDataFrame(rows, "k int, v double, id bigint"), ["k"], "v", "id").groupBy("k").count().collect()
    assert [r["k"] for r in got] == [2]


def test_resamples_have_the_spread_of_draws(spark, monkeypatch):
    monkeypatch.setattr(RS, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(3)
    a, b = rng.normal(5, 2, 600), rng.normal(6, 3, 500)
    rows = [("A", float(v), i) for i, v in enumerate(a)] + [("B", float(v), 9000 + i) for i, v in enumerate(b)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, variant string, v double, id bigint").repartition(5)
    diff = np.array([r["difference"] for r in RS.mean_differences(df, ["k"], "v", "id", trials=1500, size=100).collect()])
    expected = np.sqrt(a.var() / 100 * (1 - 100 / 600) + b.var() / 100 * (1 - 100 / 500))
    assert diff.mean() == pytest.approx(b.mean() - a.mean(), abs=4 * expected / np.sqrt(1500)) and diff.std() == pytest.approx(expected, rel=0.1)
    means = {}
    for r in RS.resampled_means(df, ["variant"], "v", "id").collect():
        means.setdefault(r["variant"], []).append(r["mean"])
    assert [len(means["A"]), len(means["B"])] == [600, 500]
    assert np.std(means["A"]) == pytest.approx(a.std() / np.sqrt(0.2 * 600), rel=0.15) and np.mean(means["A"]) == pytest.approx(a.mean(), abs=0.1)


def test_kendall_and_spearman_against_pairs(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 9, 120), rng.integers(0, 7, 120)
    got = rank_correlations(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y").first()
    con = dis = tx = ty = 0
    for i in range(120):
        for j in range(i):
            s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            con, dis = con + (s > 0), dis + (s < 0)
            tx, ty = tx + (x[i] == x[j]), ty + (y[i] == y[j])
    n0 = 120 * 119 / 2
    assert got["kendall"] == pytest.approx((con - dis) / np.sqrt((n0 - tx) * (n0 - ty)))

    def avg_rank(v):
        return np.array([np.sum(v < a) + (np.sum(v == a) + 1) / 2 for a in v])

    assert got["spearman"] == pytest.approx(np.corrcoef(avg_rank(x), avg_rank(y))[0, 1])


def test_nearest_matches_brute_force_with_dense_cells(spark):
    rng = np.random.default_rng(7)
    dense = rng.normal(100, 1e-4, (300, 2))
    wide = rng.uniform(0, 360, (60, 2)) * [1, 0.4]
    pts = np.vstack([dense, wide])
    df = spark.createDataFrame([(f"o{i}", i, float(p[0]), float(p[1])) for i, p in enumerate(pts)], "objid string, seq bigint, ra double, dec double")
    got = nearest_other(df.filter("seq % 5 = 0"), df.filter("seq % 5 <> 0"), "objid", [F.col("ra"), F.col("dec")], "seq", leaf=8).collect()
    assert len(got) == 72
    kept = [i for i in range(len(pts)) if i % 5]
    for r in got:
        d = np.linalg.norm(pts[kept] - pts[r["seq"]], axis=1)
        assert r["distance"] == pytest.approx(d.min(), abs=1e-12) and r["nearest"] == f"o{kept[int(np.argmin(d))]}"
    sky = nearest_other(df.filter("seq = 300"), df.filter("seq > 300"), "objid", sky_vector(F.col("ra"), F.col("dec")), "seq").first()
    assert sky["nearest"] is not None


def test_rank_sum_counts_pairs(spark):
    rows = [(1, "A", v) for v in (1.0, 2.0, 2.0, 5.0)] + [(1, "B", v) for v in (2.0, 3.0, 0.5)]
    got = ST.rank_sum(spark.createDataFrame(rows, "experiment int, variant string, value double"), ["experiment"]).first()
    u = sum((a > b) + 0.5 * (a == b) for a in (1, 2, 2, 5) for b in (2, 3, 0.5))
    assert got["u"] == u


def test_two_proportions_agrees_with_directed(spark):
    row = spark.createDataFrame([(100, 30, 120, 48)], "n_a bigint, success_a bigint, n_b bigint, success_b bigint")
    two, way = ST.two_proportions(row).first(), ST.directed_proportions(row).first()
    assert abs(way["z"]) == pytest.approx(two["z"]) and two["p_value"] == pytest.approx(2 * way["p_value"])


@pytest.mark.parametrize("n", [50, 5000])
def test_missing_positions_have_no_neighbour(spark, n):
    df = spark.range(n).select(
        F.concat(F.lit("o"), "id").alias("objid"), F.col("id").alias("seq"),
        F.when(F.col("id") % 10 != 3, F.rand(5) * 360).alias("ra"), F.when(F.col("id") % 15 != 0, F.rand(6) * 90).alias("dec"),
    ).cache()
    got = {r["seq"]: r for r in nearest_other(df.filter("seq % 5 = 0"), df.filter("seq % 5 <> 0"), "objid", [F.col("ra"), F.col("dec")], "seq").collect()}
    rows = {r["seq"]: (r["ra"], r["dec"]) for r in df.collect()}
    assert set(got) == {i for i in rows if i % 5 == 0}
    there = np.array([rows[i] for i in rows if i % 5 and None not in rows[i]])
    for i, r in got.items():
        if None in rows[i]:
            assert r["nearest"] is None and r["distance"] is None
        else:
            assert r["distance"] == pytest.approx(np.linalg.norm(there - np.array(rows[i]), axis=1).min())


def test_shuffles_of_large_files_get_more_partitions(spark, tmp_path, monkeypatch):
    from orrery import session
    from orrery.operators import entities as E
    from orrery.plans.tables import Tables

    rows = [(i % 40, i % 70) for i in range(3000)] + [(None, 1), (None, 1)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = Tables(spark, str(tmp_path)).edge_keys()
    assert "REPARTITION_BY_NUM" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(session, "DEALT_BYTES", 16)
    keys = Tables(spark, str(tmp_path)).edge_keys()
    assert keys.rdd.getNumPartitions() == -(-session.file_bytes(keys) // 16) > usual
    assert sorted(map(tuple, keys.collect()), key=repr) == sorted(set(rows), key=repr)
    edges = keys.select(F.col("s_suppkey").cast("string").alias("objid"), F.col("p_partkey").cast("string").alias("refcode"))
    moves = spark.createDataFrame([("1", "2"), ("3", "99")], "from_id string, to_id string")
    moved = E.transfer_edges(edges, moves, edges.select("objid").distinct())
    assert moved.rdd.getNumPartitions() > usual
    text = [tuple(None if v is None else str(v) for v in r) for r in rows]
    assert sorted(map(tuple, moved.collect()), key=repr) == sorted({*text, *(("2", p) for o, p in text if o == "1")}, key=repr)
