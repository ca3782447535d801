"""ST*: A/B statistics on the events, in two variants by event number."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import outliers as O
from orrery.operators import resample as RS
from orrery.operators import stats as ST
from orrery.plans.registry import query
from orrery.plans.tables import SQL_AB

KEY = ["experiment"]


def _r(df, cols, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" and c in cols else c for c, t in df.dtypes])


def _summary(t):
    return ST.ab_summary(t.ab(), KEY, "value", F.col("value") > 50)


_SQL_SUM = f"""(select experiment, count(*) filter (variant = 'A') as na, count(*) filter (variant = 'B') as nb,
 count(*) filter (variant = 'A' and value > 50) as sa, count(*) filter (variant = 'B' and value > 50) as sb,
 avg(value) filter (variant = 'A') as ma, avg(value) filter (variant = 'B') as mb,
 stddev_pop(value) filter (variant = 'A') as da, stddev_pop(value) filter (variant = 'B') as db from {SQL_AB} group by experiment)"""


def phi(x: str) -> str:
    """Normal distribution function in SQL: power series with odd double factorials, by the log-gamma function."""
    term = "exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()) - {x} * {x} / 2)".replace("{x}", x)
    return f"(case when abs({x}) > 12 then case when {x} > 0 then 1.0 else 0.0 end else 0.5 + sign({x}) * list_sum(list_transform(range(0, 400), lambda k: {term})) / sqrt(2 * pi()) end)"


# Normal quantiles of the checks.
Z95, Z975, Z80 = "1.6448536269514722e0", "1.959963984540054e0", "0.8416212335729143e0"


def t975(df: str) -> str:
    """97.5 % quantile of t by its expansion in 1 / df; enough for many degrees of freedom."""
    z = Z975
    return f"""({z} + (power({z},3)+{z})/(4*{df}) + (5*power({z},5)+16*power({z},3)+3*{z})/(96*power({df},2)) + (3*power({z},7)+19*power({z},5)+17*power({z},3)-15*{z})/(384*power({df},3))
 + (79*power({z},9)+776*power({z},7)+1482*power({z},5)-1920*power({z},3)-945*{z})/(92160*power({df},4)))"""


@query(
    "st01_mean_interval",
    sql=f"""select variant, n, round(m, 6) as mean, round(s, 6) as std, round(m - h, 5) as low, round(m + h, 5) as high from (
 select *, s / sqrt(n) * {t975("(n - 1)")} as h from (select variant, count(*) as n, avg(value) as m, stddev_samp(value) as s from {SQL_AB} group by variant))""",
)
def st01(t):
    out = ST.mean_interval(t.ab(), ["variant"], "value")
    return _r(_r(out, ["mean", "std"]), ["low", "high"], 5)


@query(
    "st02_two_proportions",
    sql=f"""select experiment, round(z, 6) as z, round(2 * (1 - {phi("z")}), 6) as p_value from (select experiment, abs(sb / nb - sa / na) / sqrt(p * (1 - p) * (1 / na + 1 / nb)) as z
 from (select *, (sa + sb) / (na + nb) as p from {_SQL_SUM}))""",
)
def st02(t):
    return _r(ST.two_proportions(_summary(t)).select("experiment", "z", "p_value"), ["z", "p_value"])


@query(
    "st03_proportions_interval",
    sql=f"""select experiment, round(d, 6) as difference, round(d - {Z975} * e, 6) as low, round(d + {Z975} * e, 6) as high from (
 select experiment, sb / nb - sa / na as d, sqrt(sa / na * (1 - sa / na) / na + sb / nb * (1 - sb / nb) / nb) as e from {_SQL_SUM})""",
)
def st03(t):
    cols = ["difference", "low", "high"]
    return _r(ST.proportions_interval(_summary(t)).select("experiment", *cols), cols)


@query(
    "st04_directed_proportions",
    sql=f"""select experiment, direction, round(z_manual, 6) as z_manual, round(z, 6) as z, round(case when direction = 'smaller' then {phi("z")} else 1 - {phi("z")} end, 6) as p_value from (
 select experiment, case when round(sa / na, 5) < round(sb / nb, 5) then 'smaller' else 'larger' end as direction,
 (round(sa / na, 5) - round(sb / nb, 5)) / sqrt(round(p, 5) * (1 - round(p, 5)) * (1 / na + 1 / nb)) as z_manual, (ka / na - kb / nb) / sqrt(p * (1 - p) * (1 / na + 1 / nb)) as z
 from (select *, (ka + kb) / (na + nb) as p from (select *, floor(sa / na * na) as ka, floor(sb / nb * nb) as kb from {_SQL_SUM})))""",
)
def st04(t):
    cols = ["z_manual", "z", "p_value"]
    return _r(ST.directed_proportions(_summary(t)).select("experiment", "direction", *cols), cols)


_SQL_DESIGN = f"(select experiment, sa / na as p, sb / nb as q, na, nb, sa, sb, ma, mb, da, db from {_SQL_SUM})"


def _designs(t):
    return _summary(t).withColumns({"p_null": F.col("success_a") / F.col("n_a"), "p_alt": F.col("success_b") / F.col("n_b")})


@query(
    "st05_size_for_proportions",
    sql=f"select experiment, round_even(2 * ((p + q) / 2) * (1 - (p + q) / 2) * pow({Z95} + {Z80}, 2) / nullif(pow(p - q, 2), 0), 0)::bigint as n from {_SQL_DESIGN}",
)
def st05(t):
    return _designs(t).select("experiment", ST.size_for_proportions(F.col("p_null"), F.col("p_alt")).alias("n"))


@query(
    "st06_size_for_means",
    sql=f"select experiment, round_even(2 * da * da * pow({Z975} + {Z80}, 2) / nullif(pow(ma - mb, 2), 0), 0)::bigint as n from {_SQL_DESIGN}",
)
def st06(t):
    n = ST.size_for_means(F.col("mean_a") - F.col("mean_b"), F.col("std_pop_a"), one_sided=False)
    return _summary(t).select("experiment", n.alias("n"))


@query(
    "st07_power",
    sql=f"""select experiment, round(1 - {phi("z")}, 6) as power from (
 select experiment, ({Z95} * sqrt(2 * p * (1 - p) / na) - (q - p)) / sqrt((p * (1 - p) + q * (1 - q)) / na) as z from {_SQL_DESIGN})""",
)
def st07(t):
    return _r(ST.power_of_test(_designs(t), "p_null", "p_alt", "n_a").select("experiment", "power"), ["power"])


_SQL_SIZE = "ceil(pow(({a} * sqrt(2 * p * (1 - p)) + " + Z80 + " * sqrt(p * (1 - p) + q * (1 - q))) / nullif(q - p, 0), 2))"


@query("st08_experiment_size", sql=f"select experiment, {_SQL_SIZE.replace('{a}', Z95)} as n from {_SQL_DESIGN}")
def st08(t):
    return _designs(t).select("experiment", ST.experiment_size(F.col("p_null"), F.col("p_alt")).alias("n"))


@query(
    "st09_time_units",
    sql=f"select experiment, round({_SQL_SIZE.replace('{a}', '2.241402727604945')} / na * 2, 6) as units from (select experiment, na, sa / na as p, (sa + 5) / na as q from {_SQL_SUM})",
)
def st09(t):
    units = ST.time_units(F.col("n_a"), F.col("success_a"), F.col("success_a") + 5, 0.025)
    return _summary(t).select("experiment", F.round(units, 6).alias("units"))


@query(
    "st10_power_curve",
    sql=f"""with d as (select experiment, 2 * (asin(sqrt(p)) - asin(sqrt(q))) as h, round_even(2 * ((p + q) / 2) * (1 - (p + q) / 2) * pow({Z95} + {Z80}, 2) / nullif(pow(p - q, 2), 0), 0)::bigint as base_n from {_SQL_DESIGN}),
 g as (select *, unnest(range(greatest(floor(base_n * 0.1::double)::bigint, 1), greatest(floor(base_n * 1.5::double)::bigint, greatest(floor(base_n * 0.1::double)::bigint, 1) + 1), greatest(floor(base_n * 0.1::double)::bigint, 1))) as n from d where base_n is not null),
 e as (select *, abs(h * s) * sqrt(n / 2) as u from g, (values (0.8::double), (1.0), (1.2)) v(s))
 select experiment, n, round(h * s, 6) as effect, floor(2 * pow(({Z95} + {Z80}) / h, 2))::bigint as solved_n, round({phi("(u - " + Z975 + ")")} + {phi("(-u - " + Z975 + ")")}, 6) as power from e""",
)
def st10(t):
    out = ST.power_curve(_designs(t), "p_null", "p_alt")
    return _r(out.select("experiment", "n", "effect", "solved_n", "power"), ["effect", "power"])


@query("st11_cohens_d", sql=f"select experiment, round(abs((ma - mb) / sqrt((da * da + db * db) / 2)), 6) as cohens_d from {_SQL_SUM}")
def st11(t):
    return _r(ST.cohens_d(_summary(t)).select("experiment", "cohens_d"), ["cohens_d"])


@query(
    "st12_bayes_update",
    sql=f"""with g as (select experiment, i / 100 as th, floor(sa / na * 100) + sb as w, 100 - floor(sa / na * 100) + nb - sb as l from {_SQL_SUM}, range(1, 100) r(i)),
 v as (select *, w * ln(th) + l * ln(1 - th) as lg from g), m as (select experiment, max(lg) as top from v group by 1)
 select experiment, round(sum(th * exp(lg - top)) / sum(exp(lg - top)), 6) as posterior_mean from v join m using (experiment) group by 1""",
)
def st12(t):
    mean = ST.bayes_update(F.col("p_null"), F.col("success_b"), F.col("n_b"))
    return _designs(t).select("experiment", F.round(mean, 6).alias("posterior_mean"))


@query("st13_quantile_interval")
def st13(t):
    return RS.quantile_interval(t.ab(), KEY, "value", 0.9, trials=1000)


@query("st14_quantile_permutation")
def st14(t):
    return RS.quantile_permutation(t.ab(), KEY, "value", 0.9, trials=10000)


@query(
    "st14_observed_difference",
    sql=f"""select experiment, round(quantile_cont(value, 0.9) filter (variant = 'B') - quantile_cont(value, 0.9) filter (variant = 'A'), 6) as observed from {SQL_AB} group by 1""",
)
def st14_observed(t):
    return _r(RS.observed_difference(t.ab(), KEY, "value", 0.9), ["observed"])


@query(
    "st15_rank_sum",
    sql=f"""with r as (select experiment, variant, rank() over (partition by experiment order by value) + (count(*) over (partition by experiment, value) - 1) / 2 as rk from {SQL_AB}),
 s as (select experiment, count(*) filter (variant = 'A') as na, count(*) filter (variant = 'B') as nb, sum(rk) filter (variant = 'A') as ra from r group by 1),
 z as (select *, ra - na * (na + 1) / 2 as u, (ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb * (na + nb + 1) / 12) as z from s)
 select experiment, na as n_a, nb as n_b, u, round(z, 6) as z, round(2 * {phi("(-abs(z))")}, 6) as p_value from z""",
)
def st15(t):
    return _r(ST.rank_sum(t.ab(), KEY), ["z", "p_value"])


_SQL_PAIRED = "(select user_id % 10 as experiment, user_id, count(*) filter (event_type = 'view') as x, count(*) filter (event_type = 'click') as y from events group by all)"


def _paired(t):
    return t.events.groupBy(F.pmod("user_id", F.lit(10)).alias("experiment"), "user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("x"), F.count_if(F.col("event_type") == "click").alias("y")
    )


@query(
    "st16_sign_test",
    sql=f"""with c as (select experiment, count(*) filter (x <> y) as n, count(*) filter (x > y) - count(*) filter (x = y) as k from {_SQL_PAIRED} group by 1)
 select experiment, n, k, round(least(1.0, 2 * coalesce(list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 0)), 6) as p_value from c""",
)
def st16(t):
    return _r(ST.sign_test(_paired(t), KEY, "x", "y"), ["p_value"])


_SQL_LOF = f"""(with o as (select *, lag(value, 1) over w as l1, lag(value, 2) over w as l2, lead(value, 1) over w as r1, lead(value, 2) over w as r2 from {SQL_AB}
 window w as (partition by experiment, variant order by value, event_id)),
 d as (select *, coalesce(value - l1, 1e308) as a1, coalesce(value - l2, 1e308) as a2, coalesce(r1 - value, 1e308) as b1, coalesce(r2 - value, 1e308) as b2 from o),
 p as (select *, case when a2 <= b1 then 0 when b2 < a1 then 1 else 2 end as pick from d),
 k as (select *, case pick when 0 then a2 when 1 then b2 else greatest(a1, b1) end as kd from p),
 n as (select *, lag(kd, 1) over w as k1, lag(kd, 2) over w as k2, lead(kd, 1) over w as m1, lead(kd, 2) over w as m2 from k window w as (partition by experiment, variant order by value, event_id)),
 q as (select *, 1 / ((case pick when 0 then greatest(a1, k1) + greatest(a2, k2) when 1 then greatest(b1, m1) + greatest(b2, m2) else greatest(a1, k1) + greatest(b1, m1) end) / 2 + 1e-10) as lrd from n),
 f as (select *, lag(lrd, 1) over w as e1, lag(lrd, 2) over w as e2, lead(lrd, 1) over w as g1, lead(lrd, 2) over w as g2 from q window w as (partition by experiment, variant order by value, event_id))
 select experiment, variant, event_id, value, (case pick when 0 then e1 + e2 when 1 then g1 + g2 else e1 + g1 end) / 2 / lrd as lof from f)"""


@query("st17_local_outliers", sql=f"select experiment, variant, event_id, value from {_SQL_LOF} where lof > 1.5")
def st17(t):
    out = O.local_outliers(t.ab(), ["experiment", "variant"], "value", "event_id")
    return out.filter("outlier").select("experiment", "variant", "event_id", "value")


_SQL_ARRIVAL = f"""(select *, lag(value) over w as pv, lead(value) over w as nx from {_SQL_LOF} window w as (partition by experiment, variant order by event_id))"""


@query(
    "st18_replace_outliers",
    sql=f"""select experiment, variant, event_id, round(case when lof > 1.5 and pv is not null and nx is not null then (pv + nx) / 2 else value end, 6) as value from {_SQL_ARRIVAL}""",
)
def st18(t):
    group = ["experiment", "variant"]
    flagged = O.local_outliers(t.ab(), group, "value", "event_id")
    out = O.replace_flagged(flagged, group, "value", "event_id")
    return _r(out.select("experiment", "variant", "event_id", "value"), ["value"])


@query(
    "st18_replace_all",
    sql=f"""with recursive b as (select experiment, variant, event_id, value, row_number() over w as i, lead(value) over w as nx, count(*) over (partition by experiment, variant) as c,
 max(case when lof > 1.5 then 1 else 0 end) over (partition by experiment, variant) as hit from {_SQL_LOF} window w as (partition by experiment, variant order by event_id)),
 s as (select experiment, variant, event_id, i, value as y from b where i = 1 union all
 select b.experiment, b.variant, b.event_id, b.i, case when b.hit = 1 and b.i < b.c then (s.y + b.nx) / 2 else b.value end
 from s join b on b.experiment = s.experiment and b.variant = s.variant and b.i = s.i + 1)
 select experiment, variant, event_id, round(y + 1e-8, 6) as value from s""",
)
def st18_all(t):
    group = ["experiment", "variant"]
    flagged = O.local_outliers(t.ab(), group, "value", "event_id")
    out = O.replace_flagged(flagged, group, "value", "event_id", mode="all")
    # Halves of prices end in ties at the sixth place; the shift decides them alike on both sides.
    return _r(out.select("experiment", "variant", "event_id", (F.col("value") + 1e-8).alias("value")), ["value"])


@query("st19_resampled_means")
def st19(t):
    means = RS.resampled_means(t.ab(), ["experiment", "variant"], "value", "event_id")
    return ST.mean_interval(means, ["experiment", "variant"], "mean").withColumnRenamed("n", "replicates")


@query("st20_mean_differences")
def st20(t):
    return RS.mean_differences(t.ab(), KEY, "value", "event_id")


@query("st20_replicates", sql=f"select distinct experiment, r::int as rep from {SQL_AB}, range(10000) n(r)")
def st20_replicates(t):
    """Which replicates there are."""
    return RS.mean_differences(t.ab(), KEY, "value", "event_id").filter("difference is not null").select("experiment", "rep")


@query(
    "st19_replicates",
    sql=f"select experiment, variant, least(count(value), 1000) as replicates from {SQL_AB} group by all having count(value) > 10",
)
def st19_replicates(t):
    """How many replicates each group has."""
    means = RS.resampled_means(t.ab(), ["experiment", "variant"], "value", "event_id")
    return means.groupBy("experiment", "variant").agg(F.count("mean").alias("replicates"))


_SQL_DIFF = f"(select experiment, value - 50 as d from {SQL_AB})"


@query(
    "st21_difference_intervals",
    sql=f"""select experiment, n, round(m - {Z975} * s / sqrt(n), 6) as sem_low, round(m + {Z975} * s / sqrt(n), 6) as sem_high, round(m - {Z975} * s, 6) as spread_low, round(m + {Z975} * s, 6) as spread_high,
 round(m - {t975("(n - 1)")} * s / sqrt(n), 3) as t_low, round(m + {t975("(n - 1)")} * s / sqrt(n), 3) as t_high, round({phi("(-m / s)")}, 6) as p_negative
 from (select experiment, count(*) as n, avg(d) as m, stddev_samp(d) as s from {_SQL_DIFF} group by 1)""",
)
def st21(t):
    df = t.ab().select("experiment", (F.col("value") - 50).alias("d"))
    out = ST.difference_intervals(df, KEY, "d").drop("mean", "std")
    return _r(_r(out, ["sem_low", "sem_high", "spread_low", "spread_high", "p_negative"]), ["t_low", "t_high"], 3)  # the SQL form of the t quantile is an expansion


@query(
    "st22_normality",
    sql=f"""with m as (select experiment, count(*) as n, avg(value) as mu from {SQL_AB} group by 1),
 c as (select experiment, any_value(n) as n, avg(pow(value - mu, 2)) as m2, avg(pow(value - mu, 3)) as m3, avg(pow(value - mu, 4)) as m4 from {SQL_AB} join m using (experiment) group by 1),
 s as (select experiment, n, m3 / pow(m2, 1.5) as sk, m4 / (m2 * m2) - 3 as ku from c), j as (select *, n / 6 * (sk * sk + ku * ku / 4) as jb from s)
 select experiment, n, round(sk, 6) as skewness, round(ku, 6) as kurtosis, round(jb, 4) as jarque_bera, round(exp(-jb / 2), 6) as p_value, exp(-jb / 2) > 0.05 or abs(sk) <= 0.5 as acceptable from j""",
)
def st22(t):
    return _r(_r(ST.normality(t.ab(), KEY, "value"), ["skewness", "kurtosis", "p_value"]), ["jarque_bera"], 4)


@query("st23_jitter")
def st23(t):
    return RS.jitter(t.ab(), KEY, "value", "event_id")


@query("st23_normal_resample")
def st23_normal(t):
    return RS.normal_resample(t.ab(), ["experiment", "variant"], "value", 50)


@query(
    "st24_best_split",
    sql=f"""with v as (select event_type, value, count(*) as n, sum(value) as s, sum(value * value) as q from events group by all),
 r as (select event_type, value, sum(n) over w as ln, sum(s) over w as ls, sum(n) over p as tn, sum(s) over p as ts from v
 window w as (partition by event_type order by value), p as (partition by event_type)),
 g as (select *, ls * ls / ln + coalesce((ts - ls) * (ts - ls) / nullif(tn - ln, 0), 0) as gain from r)
 select event_type, tn::bigint as n, round(ls / ln, 6) as low_mean, round((ts - ls) / (tn - ln), 6) as high_mean from g qualify row_number() over (partition by event_type order by gain desc, value) = 1""",
)
def st24(t):
    out = ST.best_split(t.events.select("event_type", "value"), ["event_type"], "value")
    return _r(out, ["low_mean", "high_mean"])


@query("st25_ab_pipeline")
def st25(t):
    from orrery.operators.abtest import evaluate

    return evaluate(t.ab(), KEY, "value", "event_id")
