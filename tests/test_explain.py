"""Surrogate explanations (H1-H3, H5-H8, A17) on the two-feature split fixture."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import explain as H
from cohortlens.operators import segments as S

COLS = ["feature_a", "feature_b", "feature_noise"]


@pytest.fixture(scope="module")
def split_df(spark):
    rng = np.random.default_rng(42)
    a = np.concatenate([rng.normal(10, 0.5, 30), rng.normal(1, 0.5, 30)])
    b = np.concatenate([rng.normal(1, 0.5, 30), rng.normal(10, 0.5, 30)])
    noise = rng.normal(5, 2, 60)
    pdf = pd.DataFrame({"CUST_ID": [f"C{i:05d}" for i in range(60)], "feature_a": a, "feature_b": b, "feature_noise": noise,
                        "cluster_label": [0] * 30 + [1] * 30})
    return spark.createDataFrame(pdf)


def test_shap_additivity_and_top_features(spark, split_df):
    _, forest = H.fit_surrogate(split_df, COLS)
    rows = H.shap_explanations(split_df, COLS, forest).collect()
    assert len(rows) == 60
    for r in rows:
        assert abs(sum(r.shap) + r.base_value - r.prediction) < 1e-6
    top2 = [{c.feature for c in r.contributions[:2]} for r in rows]
    share = np.mean([t == {"feature_a", "feature_b"} for t in top2])
    assert share > 0.9


def test_lime_and_importance(spark, split_df):
    _, forest = H.fit_surrogate(split_df, COLS)
    con = H.lime_explanations(split_df, COLS, forest, H.quartile_bins(split_df, COLS), n_samples=300)
    rows = con.collect()
    assert len(rows) == 60 and all(len(r.contributions) == 3 for r in rows)
    imp = H.segment_importance(con, full_vector_col=None).collect()
    assert {r.cluster_label for r in imp} == {0, 1}


def test_fallback_to_rules_for_single_cluster(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"CUST_ID": [f"C{i}" for i in range(30)], "f1": rng.normal(5, 1, 30), "f2": rng.normal(3, 1, 30),
                        "cluster_label": [0] * 30})
    df = spark.createDataFrame(pdf)
    centers = S.explanation_centers(df, ["f1", "f2"])
    out = H.explain(df, ["f1", "f2"], mode="shap", centers=centers)
    assert (out.explainer, out.reason) == ("rule_based", "one_segment")
    assert out.customers.count() == 30
    out = H.explain(df, ["f1", "f2"], mode="nonsense")
    assert (out.explainer, out.reason) == ("none", "no_centers") and out.customers.count() == out.segments.count() == 0
    assert H.explain(df, ["f1", "f2"], mode="Rule_Based ", centers=centers).reason == "as_requested"


def test_small_segment_and_time_budget(spark, split_df):
    from pyspark.sql import functions as F

    few = split_df.withColumn("cluster_label", F.when(F.col("CUST_ID") < "C00003", 7).otherwise(F.col("cluster_label")))
    centers = S.explanation_centers(split_df, COLS)
    assert H.explain(few, COLS, centers=S.explanation_centers(few, COLS)).reason == "small_segment"
    late = H.explain(split_df, COLS, centers=centers, budget_s=0.2)
    assert (late.explainer, late.reason) == ("rule_based", "out_of_time") and late.customers.count() == 60
    in_time = H.explain(split_df, COLS, centers=centers, budget_s=300)
    assert (in_time.explainer, in_time.reason) == ("shap", "as_requested") and in_time.customers.count() == 60
    assert in_time.segments.count() == 2


def test_perturbations_hang_on_the_row_alone():
    ids = [f"C{i}" for i in range(50)]
    whole, part = H.hashed_uniform(ids, 40, 6, 1), H.hashed_uniform(ids[10:13], 40, 6, 1)
    assert (whole[10:13] == part).all() and abs(whole.mean() - 0.5) < 0.01 and 0 <= whole.min() and whole.max() < 1
    assert len(np.unique(whole)) == whole.size


def _by_hand(x, cls, forest):
    """SHAP values from the definition: all coalitions of features, one row and tree at a time."""

    from itertools import combinations
    from math import factorial

    p, trees = x.shape[1], len(forest["feature"])
    out = np.zeros(x.shape)

    def expected(t, node, row, known, c):
        left, right = forest["left"][t, node], forest["right"][t, node]
        if left < 0:
            return forest["value"][t, node, c]
        f = forest["feature"][t, node]
        if f in known:
            return expected(t, left if row[f] <= forest["threshold"][t, node] else right, row, known, c)
        share = forest["cover"][t, [left, right]] / forest["cover"][t, node]
        return share[0] * expected(t, left, row, known, c) + share[1] * expected(t, right, row, known, c)

    for r, (row, c) in enumerate(zip(x, cls)):
        for t in range(trees):
            for i in range(p):
                others = [j for j in range(p) if j != i]
                for size in range(p):
                    w = factorial(size) * factorial(p - size - 1) / factorial(p)
                    for s in combinations(others, size):
                        out[r, i] += w * (expected(t, 0, row, {*s, i}, c) - expected(t, 0, row, set(s), c)) / trees
    return out


def _random_forest(rng, trees, depth, p, classes):
    n = 2 ** (depth + 1)
    f = {k: np.full((trees, n), -1) for k in ("feature", "left", "right")}
    f |= {"threshold": np.zeros((trees, n)), "cover": np.zeros((trees, n)), "value": rng.dirichlet(np.ones(classes), (trees, n)), "classes": classes}
    for t in range(trees):
        todo, free = [(0, 0, 500)], 1
        while todo:
            node, level, cover = todo.pop()
            f["cover"][t, node] = cover
            if level == depth or cover < 4 or (level and rng.random() < 0.15):
                continue
            cut = int(rng.integers(1, cover))
            f["feature"][t, node], f["threshold"][t, node] = rng.integers(p), rng.integers(-2, 3)
            f["left"][t, node], f["right"][t, node] = free, free + 1
            todo += [(free, level + 1, cut), (free + 1, level + 1, cover - cut)]
            free += 2
    return f


def test_path_tables_give_the_shapley_values():
    rng = np.random.default_rng(8)
    forest = _random_forest(rng, 4, 6, 4, 3)
    x = rng.integers(-3, 4, (25, 4)).astype(float)  # values on the thresholds too
    x[0], x[1], x[2, 1] = np.inf, -np.inf, np.nan
    cls = rng.integers(0, 3, 25)
    tables = H.path_tables(forest)
    phi, base = H.tree_shap(x, cls, tables, chunk=7)
    assert np.allclose(phi, _by_hand(x, cls, forest), atol=1e-9)
    assert np.allclose(base + phi.sum(axis=1), H.forest_proba(x, forest)[np.arange(25), cls], atol=1e-9)
    untabled, _ = H.tree_shap(x, cls, H.path_tables(forest, widest=1))
    assert np.allclose(untabled, phi, atol=1e-12)
    leaf = {k: v[:, :1] for k, v in forest.items() if k != "classes"} | {"left": np.full((4, 1), -1)}
    assert not H.tree_shap(x, cls, H.path_tables(leaf))[0].any()


def random_forest(trees=6, depth=8, features=5, classes=3, seed=4):
    rng = np.random.default_rng(seed)
    n = 2 ** (depth + 1) - 1
    f = {k: np.full((trees, n), -1) for k in ("feature", "left", "right")} | {"threshold": np.zeros((trees, n)), "cover": np.zeros((trees, n)), "value": rng.dirichlet(np.ones(classes), (trees, n)), "classes": classes}
    cuts = np.sort(rng.normal(size=(features, 9)), axis=1)
    for t in range(trees):
        f["cover"][t, 0] = 1000.0
        for i in range(2 ** depth - 1):
            if f["cover"][t, i] > 0 and (i < 3 or rng.random() < 0.9) and t > 0:  # tree 0 is a leaf
                j, share = rng.integers(features), rng.uniform(0.1, 0.9)
                f["feature"][t, i], f["threshold"][t, i], f["left"][t, i], f["right"][t, i] = j, cuts[j, rng.integers(9)], 2 * i + 1, 2 * i + 2
                f["cover"][t, 2 * i + 1], f["cover"][t, 2 * i + 2] = f["cover"][t, i] * share, f["cover"][t, i] * (1 - share)
    return f


def walked(x, f):
    """Leaf of every row and tree, row by row."""

    out = np.zeros((len(f["feature"]), len(x)), dtype=int)
    for t in range(len(out)):
        for r, row in enumerate(x):
            at = 0
            while f["feature"][t, at] >= 0:
                at = f["left"][t, at] if row[f["feature"][t, at]] <= f["threshold"][t, at] else f["right"][t, at]
            out[t, r] = at
    return out


@pytest.mark.parametrize("depth", [3, 8, 10])
def test_leaves_by_bits(depth):
    f = random_forest(depth=depth)
    x = np.random.default_rng(1).normal(size=(131, 5))
    x[5, 2], x[6, 0], x[7] = np.nan, np.inf, f["threshold"][1, 0]
    leaves = walked(x, f)
    assert (np.array(list(H.forest_leaves(list(x.T), f))) == leaves).all()
    want = sum(v[leaf] for v, leaf in zip(f["value"], leaves)) / len(leaves)
    assert np.allclose(H.forest_proba(x, f), want, atol=1e-15)


def test_a_split_is_tested_once_for_a_batch(monkeypatch):
    """The work on a batch is word operations: a (feature, threshold) is compared once, not once a node."""

    f, tested = random_forest(), []
    real = H._word_bits
    monkeypatch.setattr(H, "_word_bits", lambda flags: tested.append(1) or real(flags))
    list(H.forest_leaves(list(np.random.default_rng(1).normal(size=(64, 5)).T), f))
    inner = f["feature"] >= 0
    assert len(tested) == len(set(zip(f["feature"][inner].tolist(), f["threshold"][inner].tolist()))) < inner.sum()


@pytest.mark.parametrize("widest", [9, 2])
def test_shap_values_of_mixed_classes(widest):
    f = random_forest()
    x = np.random.default_rng(2).normal(size=(70, 5))
    cls = np.random.default_rng(3).integers(0, 3, 70)
    tables = H.path_tables(f, widest)
    phi, base = H.tree_shap(x, cls, tables, chunk=16)
    assert np.allclose(phi.sum(axis=1) + base, H.forest_proba(x, f)[np.arange(70), cls], atol=1e-12)
    for c in range(3):
        one, _ = H.tree_shap(x, np.full(70, c), tables)
        assert np.allclose(one[cls == c], phi[cls == c], atol=1e-14)


def _lime_by_hand(x, cls, ids, f, bins, samples, top_n, seed):
    """One row after another, from the numbers of ``hashed_uniform``, the forest walked node by node."""

    p, out = x.shape[1], np.zeros(x.shape)
    for r, row in enumerate(x):
        u = H.hashed_uniform(ids[r:r + 1], samples, 2 * p, seed)[0]
        own = np.array([np.searchsorted(bins["edges"][j], row[j]) for j in range(p)])
        draw = np.array([(u[:, j, None] >= np.cumsum(bins["freq"][j])[None, :3]).sum(axis=1) for j in range(p)]).T
        values = np.array([bins["lo"][j][draw[:, j]] + (bins["hi"][j] - bins["lo"][j])[draw[:, j]] * u[:, p + j] for j in range(p)]).T
        draw[0], values[0] = own, row
        y = np.mean([v[leaf][:, cls[r]] for v, leaf in zip(f["value"], walked(values, f))], axis=0)
        z = (draw == own).astype(float)
        k = np.sqrt(np.exp(-(1 - z).sum(axis=1) / (0.75 * np.sqrt(p)) ** 2))
        z, y = z - k @ z / k.sum(), y - k @ y / k.sum()
        fit = lambda at: np.linalg.solve((z[:, at] * k[:, None]).T @ z[:, at] + np.eye(len(at)), (z[:, at] * k[:, None]).T @ y)
        keep = np.argsort(-np.abs(fit(list(range(p)))), kind="stable")[:top_n]
        out[r, keep] = fit(list(keep))
    return out


def _bins(rng, p):
    edges = np.sort(rng.normal(size=(p, 3)), axis=1)
    span = np.concatenate([edges[:, :1] - 1, edges, edges[:, 2:] + 1], axis=1)
    return {"edges": edges, "lo": span[:, :-1], "hi": span[:, 1:], "freq": np.tile([0.3, 0.2, 0.25, 0.25], (p, 1))}


@pytest.mark.parametrize("depth", [3, 8, 10])
def test_lime_of_mixed_classes_by_hand(depth):
    f, rng = random_forest(depth=depth), np.random.default_rng(6)
    x, cls, ids = rng.normal(size=(11, 5)), rng.integers(0, 3, 11), [f"C{i}" for i in range(11)]
    bins = _bins(rng, 5)
    bins["freq"][1], bins["hi"][1, 2] = [0.0, 0.0, 1.0, 0.0], bins["lo"][1, 2]  # one value for all
    x[2, 0], x[3, 2], x[4, 3] = np.nan, np.inf, f["threshold"][1, 0]
    got = H._lime_batch(x, cls, ids, f, bins, 203, 3, 42)
    assert np.allclose(got, _lime_by_hand(x, cls, ids, f, bins, 203, 3, 42), atol=1e-10)
    alone = np.vstack([H._lime_batch(x[i:i + 1], cls[i:i + 1], ids[i:i + 1], f, bins, 203, 3, 42) for i in range(11)])
    assert np.allclose(got, alone, atol=1e-12)


def test_lime_works_few_perturbed_values_out(monkeypatch):
    """The forest is prepared once for all batches, and of a perturbed value only its place among the thresholds is
    found: from a table, but for the few values near one."""

    f, rng, worked, prepared = random_forest(), np.random.default_rng(6), [], []
    bins, unit, steps = _bins(rng, 5), H._unit, H.forest_steps
    monkeypatch.setattr(H, "_unit", lambda h: worked.append(h.size) or unit(h))
    monkeypatch.setattr(H, "forest_steps", lambda f: prepared.append(1) or steps(f))
    tables = H.lime_tables(f, bins)
    for _ in range(3):
        H._lime_batch(rng.normal(size=(8, 5)), np.zeros(8, dtype=int), [f"C{i}" for i in range(8)], f, bins, 1000, 3, 42, tables=tables)
    assert len(prepared) == 1 and 0 < sum(worked) < 0.02 * 3 * 8 * 5 * 1000
