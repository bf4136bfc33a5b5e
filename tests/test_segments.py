"""Segments, boundary metrics, explanations, personas (M12-M13, H4, R*, W2)."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from cohortlens.operators import cluster as C
from cohortlens.operators import personas as P
from cohortlens.operators import segments as S


def _two_groups(spark):
    rows = [(f"C{i:05d}", 10.0 + (i % 3) * 0.1, 1.0 + (i % 2) * 0.1, 0) for i in range(10)]
    rows += [(f"C{i:05d}", 1.0 + (i % 3) * 0.1, 10.0 + (i % 2) * 0.1, 1) for i in range(10, 20)]
    return spark.createDataFrame(rows, "CUST_ID string, f1 double, f2 double, cluster_label int")


def test_boundary_and_rule_explanations(spark):
    df = _two_groups(spark)
    cen = S.explanation_centers(df, ["f1", "f2"])
    b = S.boundary_metrics(df, ["f1", "f2"], cen)
    rows = b.collect()
    assert len(rows) == 20 and all(r.boundary_distance_ratio >= 0 for r in rows)
    assert {r.nearest_alternate_cluster for r in rows if r.cluster_label == 0} == {1}
    ex = S.rule_explanations(df, ["f1", "f2"], cen, b).collect()
    assert all(r.explanation.startswith(f"Assigned to Segment {r.cluster_label} primarily due to ") for r in ex)
    assert not any("borderline" in r.explanation for r in ex)
    summ = S.segment_summaries(S.rule_explanations(df, ["f1", "f2"], cen, b)).collect()
    assert len(summ) == 2 and all("customers are often characterized by" in r.summary for r in summ)


def test_borderline_suffix(spark):
    b = spark.createDataFrame([("C100", 1, 2, 0.5), ("C101", 1, 2, 0.9)],
                              "customer_id string, cluster_label int, nearest_alternate_cluster int, boundary_distance_ratio double")
    expl = spark.createDataFrame([("C100", 1, "x."), ("C101", 1, "x.")], "customer_id string, cluster_label int, explanation string")
    out = {r.customer_id: r.explanation for r in S.attach_boundary(expl, b).collect()}
    assert out["C100"] == "x."
    assert out["C101"] == "x. This customer is borderline between Segment 1 and Segment 2."


def test_silhouette_sq_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(4, 1, (30, 3)), rng.normal([0, 5, 0], 1, (5, 3))])
    lab = np.array([0] * 40 + [1] * 30 + [2] * 5)
    rows = [(f"C{i}", *map(float, x[i]), int(lab[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "CUST_ID string, a double, b double, c double, cluster_label int")
    got = C.silhouette_sq(df, ["a", "b", "c"]).first()[0]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert math.isclose(got, float(np.mean(s)), rel_tol=1e-9)


def test_kmeans_fit_invariants(spark):
    df = _two_groups(spark)
    res = C.kmeans_fit(df, ["f1", "f2"], 2, n_init=2, rank_by="f1")
    labels = {r.CUST_ID: r.cluster_label for r in res.labels.collect()}
    assert len(labels) == 20 and set(labels.values()) == {0, 1}
    assert labels["C00000"] == 0  # canonical: highest f1 center gets label 0
    assert res.cost <= min(res.costs.values()) + 1e-9


def test_recommendations_cover_tiers(spark):
    rows = []
    for lbl, spend, freq in [(0, 1000.0, 5.0), (1, 10.0, 0.1), (2, 300.0, 1.0)]:
        for i in range(9):
            rows.append((f"C{lbl}{i}", lbl, spend + i, freq + i * 0.01, 0.9, 1000.0, 0.7, 0.3, 0.5))
    df = spark.createDataFrame(rows, "CUST_ID string, cluster_label int, monthly_spend double, transaction_frequency_per_month double, "
                                     "full_payment_ratio double, credit_headroom double, credit_utilization_ratio double, "
                                     "cash_advance_ratio double, oneoff_purchase_share double")
    recs = {r.cluster_label: r for r in S.cluster_recommendations(df).collect()}
    assert recs[0].tier == "priority" and recs[1].tier == "dormant"
    assert "cash_advance_alternative_credit_line" in recs[0].behavioral_products
    assert recs[0].cross_sell[:3] == ["premium_card_upgrade", "travel_benefits", "cashback_bundle"]
    cust = S.customer_recommendations(df, S.cluster_recommendations(df))
    assert cust.count() == 27


def test_persona_resolution_and_top_n(spark):
    assert P.resolve_persona(" the Revolvers ") == 1 and P.resolve_persona("dormant") == 3
    rows = [(f"C{i}", i % 4, float(i), float(100 - i), float(i % 5), float(i) / 100) for i in range(40)]
    df = spark.createDataFrame(rows, "CUST_ID string, cluster int, PURCHASES double, BALANCE double, CASH_ADVANCE double, BALANCE_FREQUENCY double")
    wp = P.attach_personas(df)
    top = P.persona_top_n(wp, 3).collect()
    assert len(top) == 12
    dormant = [r.sort_value for r in sorted(top, key=lambda r: r["rank"]) if r.cluster == 3]
    assert dormant == sorted(dormant)  # ascending key for the dormant persona
    assert P.top_customers_for_persona(wp, "transactors", 2).first().PURCHASES == 36.0
    assert P.assign_by_profile([[0, 5, 0, 0, 0, 0], [9, 0, 0, 0, 0, 0], [0, 0, 7, 0, 0, 0], [0, 0, 0, 0, 0, 0]],
                               ["BALANCE", "PURCHASES", "CASH_ADVANCE", "CREDIT_UTILIZATION", "PAYMENT_RATIO", "PURCHASES_FREQUENCY"]) == {0: 0, 1: 1, 2: 2, 3: 3}
    _ = F


def test_kmeans_reproducible_across_reruns(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.7, (60, 2)) for c in (0.0, 4.0, 8.0)])
    rows = [(f"C{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "CUST_ID string, f1 double, f2 double").repartition(5)
    a = C.kmeans_fit(df, ["f1", "f2"], 3, n_init=3, rank_by="f1")
    b = C.kmeans_fit(df.repartition(3), ["f1", "f2"], 3, n_init=3, rank_by="f1")
    la = {r.CUST_ID: r.cluster_label for r in a.labels.collect()}
    lb = {r.CUST_ID: r.cluster_label for r in b.labels.collect()}
    assert la == lb and math.isclose(a.cost, b.cost, rel_tol=1e-9)


def test_lloyd_pass_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)) * [1.0, 10.0, 0.1] + 1000.0
    df = spark.createDataFrame([(f"C{i}", *map(float, r)) for i, r in enumerate(x)], "CUST_ID string, a double, b double, c double").repartition(7)
    centers = {s: C.plus_plus(x, 4, s) for s in (1, 2)}
    got = C.lloyd_pass(df, ["a", "b", "c"], centers)
    for s, c in centers.items():
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        for i in range(4):
            n, cost, sums = got[s, i]
            assert n == (own == i).sum() and np.isclose(cost, d[own == i, i].sum()) and np.allclose(sums, x[own == i].sum(axis=0))


def _plain_kmeans(x, k, seed):
    centers = C.plus_plus(x, k, seed)
    for _ in range(100):
        own = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([x[own == i].mean(axis=0) if (own == i).any() else centers[i] for i in range(k)])
    return ((x - centers[own]) ** 2).sum()


def test_seeding_draws_from_all_rows(spark):
    """Eleven far groups of unlike sizes, the smallest 6 of 6,000 rows: the seeds find all of them,
    and the fit costs no more than the best of ten plain k-means++ fits."""

    rng = np.random.default_rng(11)
    sizes = [3000, 1500, 700, 300, 200, 150, 80, 40, 15, 9, 6]
    x = np.vstack([rng.normal((200.0 * i, -100.0 * (i % 3)), 1.0, (n, 2)) for i, n in enumerate(sizes)])
    df = spark.createDataFrame([(f"C{i:05d}", *map(float, r)) for i, r in enumerate(x)], "CUST_ID string, a double, b double").repartition(6)
    seeds = C.seed_centers(df, "CUST_ID", ["a", "b"], 11, [1, 2])
    for centers in seeds.values():
        assert set(np.round(centers[:, 0] / 200)) == set(range(11))
    again = C.seed_centers(df.repartition(3), "CUST_ID", ["a", "b"], 11, [1, 2])
    assert all(np.array_equal(seeds[s], again[s]) for s in seeds)
    fit = C.kmeans_fit(df, ["a", "b"], 11, n_init=2)
    assert fit.converged and fit.cost <= 1.01 * min(_plain_kmeans(x, 11, s) for s in range(10))
    assert not C.kmeans_fit(df, ["a", "b"], 4, n_init=1, max_iter=1, tol=0).converged


def test_seeding_of_few_different_rows(spark):
    df = spark.createDataFrame([(f"C{i}", 1.0, float(i % 2)) for i in range(30)], "CUST_ID string, a double, b double")
    fit = C.kmeans_fit(df, ["a", "b"], 4, n_init=2)
    assert fit.cost == 0 and fit.labels.count() == 30
    with pytest.raises(ValueError):
        C.kmeans_fit(df.limit(0), ["a", "b"], 2)


def _euclidean_silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(lab):
        n = (lab == own).sum()
        a, b = d[i, lab == own].sum() / max(n - 1, 1), min(d[i, lab == k].mean() for k in set(lab) if k != own)
        out.append(0.0 if n == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


def test_silhouette_sampled(spark):
    rng = np.random.default_rng(6)
    lab = np.array([0] * 130 + [1] * 40 + [-1] * 29 + [7])  # one group holds most rows, one has a single row
    x = rng.normal(size=(200, 3)) + lab[:, None]
    x[100:110] = x[100]  # repeated rows
    rows = [(f"C{i:03d}", *map(float, r), int(k), "a") for i, (r, k) in enumerate(zip(x, lab))]
    df = spark.createDataFrame(rows, "CUST_ID string, a double, b double, c double, cluster_label int, x0 string").repartition(5)
    want = _euclidean_silhouette(x, lab)
    whole = C.silhouette_sampled(df, ["a", "b", "c"], sample_rows=500).first()
    assert math.isclose(whole.silhouette_sampled, want.mean(), rel_tol=1e-9) and whole.standard_error == 0
    assert (whole.sampled_rows, whole.cluster_count, whole.row_count) == (200, 4, 200)
    some = C.silhouette_sampled(df, ["a", "b", "c"], sample_rows=60).first()
    assert some.sampled_rows == 60 and 0 < some.standard_error < 0.1
    assert abs(some.silhouette_sampled - want.mean()) < 4 * some.standard_error
    again = C.silhouette_sampled(df.repartition(2), ["a", "b", "c"], sample_rows=60).first()
    assert math.isclose(again.silhouette_sampled, some.silhouette_sampled, rel_tol=1e-12)
    for none in (df.limit(0), df.where("cluster_label = 0")):
        assert C.silhouette_sampled(none, ["a", "b", "c"]).first().silhouette_sampled is None


def test_nearest_is_the_exact_one():
    """Ties, near ties and far-off values are settled as the plain distances say."""

    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(7, 4)), rng.normal(size=(2, 4)) + 1e7])
    points = np.concatenate([points, points[:3], points[:2] + 1e-12])
    x = np.concatenate([rng.normal(size=(200, 4)), points, (points[:7] + points[1:8]) / 2, points[7:9] + rng.normal(size=(2, 4)), np.full((1, 4), np.nan)])
    plain = np.argmin([((x - c) ** 2).sum(axis=1) for c in points], axis=0)
    assert (C.nearest(x, points) == plain).all()
    assert (C.nearest(x, points[:1]) == 0).all() and len(C.nearest(x[:0], points)) == 0


def test_lloyd_pass_compares_rows_by_products(spark, monkeypatch):
    """Well-parted rows are assigned without a distance loop over the centers, with the same sums and costs."""

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 3)) + 20 * i for i in range(4)])
    centers = {0: np.array([[20.0 * i] * 3 for i in range(4)]), 1: x[[0, 50, 90, 130]]}
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    found = C.lloyd_pass(df, ["a", "b", "c"], centers)
    for s, c in centers.items():
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        for i in range(4):
            n, cost, sums = found[s, i]
            assert n == (own == i).sum() and np.isclose(cost, d[own == i, i].sum()) and np.allclose(sums, x[own == i].sum(axis=0))
    assert all(v[1] == 0 for v in C.lloyd_pass(df, ["a", "b", "c"], centers, costs=False).values())
