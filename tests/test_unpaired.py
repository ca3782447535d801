"""Queries without an SQL twin: each runs on the smallest tables and keeps an invariant of its own."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"

# What a row of the query must fulfil, and how many rows there are (None: at least one; ANY: perhaps none on so few objects).
ANY = -1
INVARIANTS = {
    "jn06_sample_pairs": ("label in (0, 1) and objid is not null and refcode is not null", None),
    "st13_quantile_interval": ("low <= high", 10),
    "st14_quantile_permutation": ("p_value between 0 and 1", 10),
    "st19_resampled_means": ("low <= mean and mean <= high and replicates > 0", 20),
    "st20_mean_differences": ("difference is not null", 100_000),
    "st23_jitter": ("event_id is not null", 1000),
    "st23_normal_resample": ("draw between 0 and 49 and value is not null", 1000),
    "st25_ab_pipeline": ("experiment between 0 and 9", 10),
    "ml01_object_components": ("size(pc) > 0 and not exists(pc, x -> isnan(x))", 10),
    "ml01_vector_components": ("size(pc) = 15 and not exists(pc, x -> isnan(x))", 500),
    "ml05_radius_candidates": ("eps >= 0.01 and nclusters > 5 and noise >= 0 and distribution <= 1", ANY),
    "ml04_density_clusters": ("label >= -1", 500),
    "ml07_factor_scores": ("not isnan(score)", None),
    "ml08_reduced_rank": ("size(approx) > 0", 200),
    "ml09_latent_features": ("error >= 0", None),
    "ml13_evaluate_sample": ("min >= 0 and max <= 1", 3),
    "lm01_linear_model": ("pred is not null", 6000),
    "lm02_cutoff_sweep": ("r2 <= 1.0000001", None),
    "lm03_repeated_fits": ("not isnan(weight)", 4),
    "lm04_significance": ("p_value between 0 and 1", 3),
    "lm06_best_features": ("feature is not null", None),
    "txt11_text_features": ("size(pc) > 0 and not exists(pc, x -> isnan(x))", None),
    "enc05_article_matrix": (None, None),
    "ml01_article_components": ("size(pc) > 0 and not exists(pc, x -> isnan(x))", None),
    "ml02_pair_classifier": (None, None),
    "ml03_score_papers": (None, None),
    "ml14_batch_recommendations": (None, None),
    "ml15_rebuild": (None, None),
    "imp04_fill_by_cluster": (None, None),
    "imp05_fill_all_by_cluster": (None, None),
    "pl04_scatter_sample": (None, None),
    "pl05_actual_vs_predicted": (None, None),
}


@pytest.mark.parametrize("name", INVARIANTS)
def test_invariant(spark, name):
    if not Path(DATA).exists():
        pytest.skip("driver tables are not here")
    rule, count = INVARIANTS[name]
    df = entry.queries()[name](spark, DATA).cache()
    n = df.count()
    assert n > 0 if count is None else count in (n, ANY)
    assert rule is None or df.filter(f"not coalesce({rule}, false)").count() == 0
    df.unpersist()
