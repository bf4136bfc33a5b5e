"""Surrogate-model explanations.

* H1: MLlib ``RandomForestClassifier`` (50 trees, depth 8, seed 42) learns the
  cluster labels (noise excluded; ≥ 2 labels with ≥ 5 members each).
* H2: exact path-dependent SHAP values (Lundberg et al., 2018) of the saved
  forest. The node table (bounded: trees × 2^(depth+1) rows) is read from the
  saved model and broadcast once. A task prepares, for each leaf, the features on
  its path and their Shapley share for every pattern of "the row is inside the
  path's interval of this feature"; a row then needs one bit pattern and one table
  row a leaf, in numpy over the Arrow batch (``mapInPandas``).
* H3: LIME-style local surrogate per customer: seeded perturbations drawn from
  the training quartile bins, forest scored in numpy, kernel-weighted ridge on
  bin-membership indicators; seed per row from the customer id.
* H4 lives in ``segments.rule_explanations``; H5/H6 are ``explain``'s mode and
  fallback ladder; H7/H8 the sentence and segment summary; A17/W4 the segment
  importance top-N.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.functions.expr import feature_label, round_half_up
from cohortlens.session import ensure_checkpoint_dir, materialize, remember

LABEL = "cluster_label"
SPREAD_ROWS = 50_000
TABLE_FEATURES = 9  # a leaf's share table has 2^features rows; longer paths are worked out row by row
LIME_SAMPLES = 5_000  # the usual number of perturbations; callers may lower it


#: Why an explanation is of the kind it is.
REASONS = ("as_requested", "one_segment", "small_segment", "out_of_time", "surrogate_error", "no_centers")


class SurrogateError(ValueError):
    """The labels cannot carry a surrogate; ``code`` is one of REASONS."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


# ---------------------------------------------------------------- H1
def check_segments(matrix: DataFrame, label_col: str = LABEL, least: int = catalog.MIN_SURROGATE_SAMPLES) -> None:
    """At least two segments, each with ``least`` members: one aggregate row over all label sizes."""

    sizes = matrix.where(F.col(label_col) >= 0).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    r = sizes.agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", label_col)).alias("low")).first()
    if r["k"] < 2:
        raise SurrogateError("one_segment", f"{r['k']} segments")
    if r["low"]["n"] < least:
        raise SurrogateError("small_segment", f"label {r['low'][label_col]} has {r['low']['n']} rows, {least} are needed")


def fit_surrogate(matrix: DataFrame, cols: Sequence[str], label_col: str = LABEL, trees: int = catalog.SURROGATE_TREES,
                  depth: int = catalog.SURROGATE_DEPTH, seed: int = catalog.SEED):
    check_segments(matrix, label_col)
    train = VectorAssembler(inputCols=list(cols), outputCol="features").transform(
        matrix.where(F.col(label_col) >= 0).select(*[F.col(c).cast("double") for c in cols], F.col(label_col).cast("double").alias("label"))
    )
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(train)
    return model, forest_arrays(model, matrix.sparkSession)


def forest_arrays(model, spark) -> dict:
    """Node table of a fitted forest as numpy arrays (bounded size)."""

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortlens-models/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    remember(spark, path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
    ).collect()
    t = max(r["treeID"] for r in rows) + 1
    n = max(r["id"] for r in rows) + 1
    c = len(rows[0]["impurityStats"])
    feat = np.full((t, n), -1, dtype=np.int64)
    thr = np.zeros((t, n))
    left = np.full((t, n), -1, dtype=np.int64)
    right = np.full((t, n), -1, dtype=np.int64)
    cover = np.zeros((t, n))
    value = np.zeros((t, n, c))
    for r in rows:
        i, j = r["treeID"], r["id"]
        stats = np.asarray(r["impurityStats"], dtype=float)
        cover[i, j] = stats.sum()
        value[i, j] = stats / stats.sum() if stats.sum() > 0 else stats
        if r["leftChild"] >= 0:
            feat[i, j] = r["featureIndex"]
            thr[i, j] = r["leftCategoriesOrThreshold"][0]
            left[i, j], right[i, j] = r["leftChild"], r["rightChild"]
    return {"feature": feat, "threshold": thr, "left": left, "right": right, "cover": cover, "value": value, "classes": c}


def _spread(df: DataFrame, id_col: str) -> DataFrame:
    """CPU-heavy Python stages get one task per core at least, and a task for every
    SPREAD_ROWS rows: hash-partition on the id (AQE would coalesce a small input)."""

    sc = df.sparkSession.sparkContext
    n = max(sc.defaultParallelism * 2, df.count() // SPREAD_ROWS)
    return df.repartition(n, id_col)


# ---------------------------------------------------------------- H2 TreeSHAP by path tables
@dataclass
class TreePaths:
    """The leaves of one tree, prepared once: the features on each leaf's path, the
    interval the path leaves to each, and the Shapley share of each feature for every
    pattern of "row inside the interval" bits. Unused slots of a short path have
    feature 0, an open interval, weight 0 and share 0."""

    feature: np.ndarray   # (leaves, slots)
    low: np.ndarray       # (leaves, slots); the interval is low < x <= high
    high: np.ndarray
    power: np.ndarray     # (leaves, slots); value of a slot's bit
    absent: np.ndarray    # (leaves, slots); cover share that follows the path without the feature
    value: np.ndarray     # (leaves, classes)
    reach: np.ndarray     # (leaves,); share of the training rows
    offset: np.ndarray | None  # (leaves,); first row of a leaf in ``shares``
    shares: np.ndarray | None  # (sum of 2^path length, slots)


def shapley_shares(absent: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Each feature's Shapley value in the game ``prod(inside if known else absent)``
    of a leaf, for arrays of shape (games, features). The average over coalition
    sizes is the integral over t of ``prod over the others of ((1-t) absent + t
    inside)``, a polynomial, which Gauss points integrate exactly; all terms are
    positive, so nothing cancels."""

    games, width = inside.shape
    total = np.zeros((games, width))
    points, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
    for t, w in zip((points + 1) / 2, weights / 2):
        mixed = (1 - t) * absent + t * inside
        before, after = np.ones((games, width)), np.ones((games, width))
        for j in range(1, width):
            before[:, j] = before[:, j - 1] * mixed[:, j - 1]
            after[:, width - 1 - j] = after[:, width - j] * mixed[:, width - j]
        total += w * before * after
    return total * (inside - absent)


def path_tables(forest: dict, widest: int = TABLE_FEATURES) -> list[TreePaths]:
    """The leaves of every tree with their share tables. A path of d different
    features has 2^d patterns; trees with a path of more than ``widest`` features keep
    no table, their shares are worked out from the rows' patterns."""

    out = []
    for ft, th, lc, rc, cv, val in zip(*(forest[k] for k in ("feature", "threshold", "left", "right", "cover", "value"))):
        leaves, open_paths = [], [(0, {})]
        while open_paths:
            node, seen = open_paths.pop()
            if lc[node] < 0:
                leaves.append((node, seen))
                continue
            lo, hi, share = seen.get(ft[node], (-np.inf, np.inf, 1.0))
            for child, bounds in ((lc[node], (lo, min(hi, th[node]))), (rc[node], (max(lo, th[node]), hi))):
                open_paths.append((child, {**seen, ft[node]: (*bounds, share * cv[child] / cv[node])}))
        n, width = len(leaves), max(1, max(len(seen) for _, seen in leaves))
        t = TreePaths(
            feature=np.zeros((n, width), dtype=np.int64), low=np.full((n, width), -np.inf), high=np.full((n, width), np.inf),
            power=np.zeros((n, width), dtype=np.int64), absent=np.ones((n, width)), value=np.array([val[node] for node, _ in leaves]),
            reach=np.array([cv[node] / cv[0] for node, _ in leaves]), offset=None, shares=None)
        for i, (_, seen) in enumerate(leaves):
            for j, (f, (lo, hi, share)) in enumerate(seen.items()):
                t.feature[i, j], t.low[i, j], t.high[i, j], t.absent[i, j], t.power[i, j] = f, lo, hi, share, 1 << j
        if width <= widest:
            sizes = np.array([1 << len(seen) for _, seen in leaves])
            t.offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            leaf = np.repeat(np.arange(n), sizes)
            pattern = np.arange(sizes.sum()) - t.offset[leaf]
            inside = np.where(t.power[leaf] > 0, pattern[:, None] & t.power[leaf] > 0, True).astype(float)
            t.shares = shapley_shares(t.absent[leaf], inside)
        out.append(t)
    return out


def tree_shap(x: np.ndarray, cls: np.ndarray, tables: list[TreePaths], chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """SHAP values of the own-class probability for a batch of rows.

    Returns (phi (rows × features), expected value (rows,)), averaged over trees.
    ``chunk`` rows are worked on at a time, which bounds the memory. All trees ask
    about few different intervals of a feature (its split points are the forest's), so
    each is tested once for a row and a leaf's pattern is read from these tests. Rows
    of one class share the leaves' values, so a leaf gives a row one line of a table."""

    p = x.shape[1]
    tests, asked = {}, []
    for t in tables:
        used = t.power > 0
        own = np.full(t.feature.shape, -1)  # an unused slot asks the last test, which nothing passes
        own[used] = [tests.setdefault(key, len(tests)) for key in zip(t.feature[used].tolist(), t.low[used].tolist(), t.high[used].tolist())]
        asked.append(own)
    feature, low, high = (np.array([key[i] for key in tests], dtype=kind)[:, None] for i, kind in enumerate((np.int64, float, float)))
    phi, base = np.zeros(x.shape), np.zeros(len(x))
    for c in np.unique(cls):
        rows = np.flatnonzero(cls == c)
        parts = [rows[at:at + chunk] for at in range(0, len(rows), chunk)]
        passed = []
        for part in parts:
            v = x[part].T[feature[:, 0]]
            inside = ((low == -np.inf) | ~(v <= low)) & ((high == np.inf) | (v <= high))
            passed.append(np.concatenate([inside, np.zeros((1, len(part)), dtype=bool)]))
        for t, own in zip(tables, asked):
            n, width = t.feature.shape
            base[rows] += (t.reach * t.value[:, c]).sum()
            if t.shares is None:
                to_feature = np.zeros((n * width, p))
                to_feature[np.arange(n * width), t.feature.ravel()] = 1.0
                for part, tested in zip(parts, passed):
                    inside = np.where((t.power > 0)[:, :, None], tested[own], True).transpose(2, 0, 1).reshape(-1, width).astype(float)
                    absent = np.broadcast_to(t.absent, (len(part), n, width)).reshape(-1, width)
                    got = shapley_shares(absent, inside).reshape(len(part), n, width) * t.value[:, c][None, :, None]
                    phi[part] += got.reshape(len(part), -1) @ to_feature
                continue
            leaf = np.repeat(np.arange(n), np.diff(t.offset, append=len(t.shares)))
            lines = np.zeros((len(t.shares), p))
            for j in range(width):
                lines[np.arange(len(leaf)), t.feature[leaf, j]] += t.shares[:, j] * t.value[leaf, c]
            for part, tested in zip(parts, passed):
                pattern = np.zeros((n, len(part)), dtype=np.uint16 if width <= 16 else np.int64)
                for j in range(width):
                    pattern |= tested[own[:, j]].astype(pattern.dtype) << pattern.dtype.type(j)
                phi[part] += lines[pattern + t.offset[:, None]].sum(axis=0)
    return phi / len(tables), base / len(tables)


def _word_bits(flags: np.ndarray) -> np.ndarray:
    """Flags as bits, 64 to a word."""

    packed = np.packbits(flags)
    if len(packed) % 8:
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)])
    return packed.view(np.uint64)


def forest_steps(forest: dict) -> tuple[list[tuple[int, float]], list[tuple[list, dict, int]]]:
    """The forest's different tests (feature, threshold), and of each tree the order of
    its word operations, its leaf by the turns taken, and its depth.

    A step is (test, the slot of the node's rows or -1 for all, level, whether the left
    child is asked on, the right child's slot or -1). The left child takes its parent's
    slot (slot 0 below the root), so few sets of rows are held at a time."""

    tests: dict[tuple[int, float], int] = {}
    trees = []
    for feat, thr, left, right in zip(*(forest[k].tolist() for k in ("feature", "threshold", "left", "right"))):
        steps: list = []
        leaf_of: dict[int, int] = {}
        levels, free, slots = 0, [], 1
        paths = [(0, -1, 0, 0)]  # node, slot of its rows, level, turns taken
        while paths:
            node, rows, level, code = paths.pop()
            if feat[node] < 0:
                leaf_of[code] = node
                continue
            levels = max(levels, level + 1)
            stays, turns = feat[left[node]] >= 0, feat[right[node]] >= 0
            own, other = max(rows, 0), -1
            if turns:
                if not free:
                    free.append(slots)
                    slots += 1
                other = free.pop()
            if not stays:
                free.append(own)
            test = tests.setdefault((feat[node], thr[node]), len(tests))
            steps.append((test, rows, level, stays, other))
            paths += [(left[node], own, level + 1, code), (right[node], other, level + 1, code | 1 << level)]
        trees.append((steps, leaf_of, levels))
    return list(tests), trees


def leaf_codes(n: int, passed: Sequence[np.ndarray], trees: list[tuple[list, dict, int]]):
    """Each tree's turns of ``n`` rows as one number a row, tree by tree; ``passed`` has
    a word of bits for 64 rows, for each test.

    A node sends its rows to its children by two word operations. A level's right
    turns make one bit plane; the planes of a tree, read together, are the numbers."""

    words = -(-n // 64)
    planes = [np.empty(words, dtype=np.uint64) for _ in range(max(levels for _, _, levels in trees))]
    held = [np.empty(words, dtype=np.uint64) for _ in range(len(planes) + 1)]  # the last is for rows that go no further
    for steps, _, levels in trees:
        for plane in planes[:levels]:
            plane.fill(0)
        for test, rows, level, stays, other in steps:
            if rows < 0:
                turned = passed[test]
                if other >= 0:
                    held[other][:] = turned
                if stays:
                    np.invert(turned, held[0])
            else:
                turned = np.bitwise_and(held[rows], passed[test], held[other])
                if stays:
                    np.bitwise_xor(held[rows], turned, held[rows])
            np.bitwise_or(planes[level], turned, planes[level])
        kind = np.uint8 if levels <= 8 else np.uint16 if levels <= 16 else np.uint32
        codes = np.zeros(n, dtype=kind)
        for plane in reversed(planes[:levels]):
            codes += codes
            codes |= np.unpackbits(plane.view(np.uint8), count=n)
        yield codes


def _leaf_table(leaf_of: dict, levels: int) -> np.ndarray:
    table = np.zeros(1 << levels, dtype=np.int64)
    table[list(leaf_of)] = list(leaf_of.values())
    return table


def _leaves(codes: np.ndarray, leaf_of: dict, levels: int) -> np.ndarray:
    if levels <= 16:
        return _leaf_table(leaf_of, levels)[codes]
    known = np.array(sorted(leaf_of))
    return np.array([leaf_of[c] for c in known.tolist()])[np.searchsorted(known, codes)]


def forest_leaves(columns: Sequence[np.ndarray], forest: dict):
    """Each tree's leaf of every row, tree by tree; ``columns`` are the features.

    Rows are bits: a split's outcome for 64 rows is one word, worked out once for all
    nodes that ask the same (feature, threshold)."""

    n, (tests, trees) = len(columns[0]), forest_steps(forest)
    passed = [_word_bits(~(columns[f] <= cut)) for f, cut in tests]  # a NaN turns right
    for codes, (_, leaf_of, levels) in zip(leaf_codes(n, passed, trees), trees):
        yield _leaves(codes, leaf_of, levels)


def forest_proba(x: np.ndarray, forest: dict) -> np.ndarray:
    """Average of per-tree leaf class distributions (MLlib's probability)."""

    out = np.zeros((x.shape[0], forest["value"].shape[2]))
    for value, leaf in zip(forest["value"], forest_leaves([np.ascontiguousarray(c) for c in x.T], forest)):
        out += value[leaf]
    return out / len(forest["feature"])


def with_contributions(df: DataFrame, vector: str, names: Sequence[str], top_n: int, digits: int = 6) -> DataFrame:
    """Add ``contributions``: the ``top_n`` entries of a vector column by size
    (ties by position), ranked inside the row by built-in array functions."""

    place = F.sequence(F.lit(0), F.lit(len(names) - 1))
    entries = F.transform(place, lambda i: F.struct((-F.abs(F.get(F.col(vector), i))).alias("size"), i.alias("i"), F.get(F.col(vector), i).alias("v")))
    top = F.slice(F.array_sort(entries), 1, top_n)
    feature = lambda e: F.get(F.array(*map(F.lit, names)), e["i"])
    shown = F.transform(top, lambda e: F.struct(
        feature(e).alias("feature"), feature_label(feature(e), catalog.FEATURE_LABELS).alias("feature_label"),
        round_half_up(e["v"], digits).alias("value"), F.when(e["v"] > 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction")))
    return df.withColumn("contributions", shown)


def shap_explanations(matrix: DataFrame, cols: Sequence[str], forest: dict, id_col: str = "CUST_ID", label_col: str = LABEL,
                      top_n: int = catalog.TOP_N_FEATURES) -> DataFrame:
    """H2: per customer (noise skipped) top-N SHAP contributions of its own
    class, the base value, the model probability and the full SHAP vector."""

    import pandas as pd

    spark = matrix.sparkSession
    bc = spark.sparkContext.broadcast(forest)
    names = list(cols)

    def run(batches):
        fr, tables = bc.value, None
        for pdf in batches:
            if pdf.empty:
                continue
            tables = tables or path_tables(fr)
            x = pdf[names].to_numpy(dtype=float)
            cls = pdf[label_col].to_numpy(dtype=np.int64)
            phi, base = tree_shap(x, cls, tables)
            prob = forest_proba(x, fr)[np.arange(len(cls)), cls]
            yield pd.DataFrame({
                id_col: pdf[id_col].astype(str).values,
                label_col: cls.astype("int32"),
                "base_value": base,
                "prediction": prob,
                "shap": list(phi),
            })

    schema = f"{id_col} string, {label_col} int, base_value double, prediction double, shap array<double>"
    src = _spread(matrix.where((F.col(label_col) >= 0) & (F.col(label_col) < forest["classes"])).select(id_col, label_col, *[F.col(c).cast("double") for c in names]), id_col)
    return with_contributions(src.mapInPandas(run, schema), "shap", names, top_n)


# ---------------------------------------------------------------- H3 LIME-style local surrogate
def quartile_bins(matrix: DataFrame, cols: Sequence[str]) -> dict:
    """Training quartiles plus per-bin min/max per feature (bounded: p × 4)."""

    from cohortlens.functions.quantile import exact_quantiles

    q = exact_quantiles(matrix, cols, [0.25, 0.5, 0.75])
    edges = {c: [q[c, p] for p in (0.25, 0.5, 0.75)] for c in cols}
    bexpr = {c: F.when(F.col(c) <= edges[c][0], 0).when(F.col(c) <= edges[c][1], 1).when(F.col(c) <= edges[c][2], 2).otherwise(3) for c in cols}
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), bexpr[c].alias("bin"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]))
    st = matrix.select(stacked.alias("s")).groupBy("s.f", "s.bin").agg(F.min("s.v").alias("lo"), F.max("s.v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    lo = np.zeros((len(cols), 4))
    hi = np.zeros((len(cols), 4))
    freq = np.zeros((len(cols), 4))
    for r in st:
        lo[r["f"], r["bin"]], hi[r["f"], r["bin"]], freq[r["f"], r["bin"]] = r["lo"], r["hi"], r["n"]
    for f in range(len(cols)):
        freq[f] = freq[f] / max(freq[f].sum(), 1)
    return {"edges": np.array([edges[c] for c in cols], dtype=float), "lo": lo, "hi": hi, "freq": freq}


def _row_hash(ids: np.ndarray, samples: int, seed: int) -> np.ndarray:
    import pandas as pd

    with np.errstate(over="ignore"):
        h = pd.util.hash_array(np.asarray(ids, dtype=object), categorize=False)[:, None] + np.uint64(seed)
        return h + np.arange(samples, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, place: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The hash of a place up to its last step, which leaves the upper 31 bits as they are."""

    with np.errstate(over="ignore"):
        np.add(h, np.uint64(place) * np.uint64(0xD1B54A32D192ED03), out=out)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(out, np.uint64(shift), out=spare)
        np.bitwise_xor(out, spare, out=out)
        np.multiply(out, np.uint64(factor), out=out)
    return out


def _unit(mixed: np.ndarray) -> np.ndarray:
    """The number in [0, 1) that a mixed hash stands for."""

    return ((mixed ^ mixed >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _uniform(h: np.ndarray, place: int) -> np.ndarray:
    return _unit(_mixed(h, place, np.empty_like(h), np.empty_like(h)))


def hashed_uniform(ids: np.ndarray, samples: int, width: int, seed: int) -> np.ndarray:
    """Uniform numbers that hang on (id, sample, place) alone: one mixed 64-bit
    hash for each, whatever batch a row comes in."""

    h = _row_hash(ids, samples, seed)
    return np.stack([_uniform(h, place) for place in range(width)], axis=2)


@dataclass
class LimeTables:
    """What all rows of a forest and its bins share, prepared once a task."""

    tests: list[tuple[int, float]]     # the forest's, see ``forest_steps``
    trees: list[tuple[list, dict, int]]
    places: list[int]                  # of each test's threshold among its feature's cuts
    cuts: list[np.ndarray]             # a feature's thresholds, ascending
    limits: list[np.ndarray]           # a feature's bin is the number of limits that its first hash reaches
    draws: list[np.ndarray]            # (CELLS,); this bin times CELLS, by upper bits of the hash; -1: look closer
    cells: list[np.ndarray]            # (bins x CELLS,); cuts below a value, by bin and upper bits; the kind's largest number: look closer


CELL_BITS = 12
CELLS = 1 << CELL_BITS


def lime_tables(forest: dict, bins: dict) -> LimeTables:
    """A perturbed value grows with its hash, so the upper bits of the hash tell, for
    all but a few cells, how many of the forest's thresholds lie below the value."""

    tests, trees = forest_steps(forest)
    t = LimeTables(tests, trees, [], [], [], [], [])
    hashes = np.arange(CELLS, dtype=np.uint64) << np.uint64(64 - CELL_BITS)
    first, last = np.arange(CELLS) / CELLS, (np.arange(1, CELLS + 1) * 2.0 ** (53 - CELL_BITS) - 1) / 2.0**53
    for f in range(len(bins["lo"])):
        cuts = np.array(sorted({cut for at, cut in tests if at == f}))
        kind = np.uint8 if len(cuts) < 255 else np.uint16 if len(cuts) < 65535 else np.uint32
        low, wide = bins["lo"][f], bins["hi"][f] - bins["lo"][f]
        with np.errstate(invalid="ignore"):
            begin, end = (np.searchsorted(cuts, (low[:, None] + wide[:, None] * u).ravel()) for u in (first, last))
        t.cuts.append(cuts)
        t.cells.append(np.where(begin == end, begin, np.iinfo(kind).max).astype(kind))
        reached = [np.ceil(c * 2.0**53) for c in np.cumsum(bins["freq"][f])[:3]]
        t.limits.append(np.array([int(c) << 11 for c in reached if c < 2.0**53], dtype=np.uint64))
        begin, end = (np.searchsorted(t.limits[f], h, side="right") for h in (hashes, hashes | np.uint64((1 << 64 - CELL_BITS) - 1)))
        t.draws.append(np.where(begin == end, begin * CELLS, -1))
    t.places = [int(np.searchsorted(t.cuts[f], cut)) for f, cut in tests]
    return t


def _perturbed(x, ids, bins, tables, n_samples, seed, block=4):
    """The perturbations of a batch: of each feature the number of cuts below the value
    (rows x samples), and whether the sample has the row's own bin (rows x features x samples)."""

    b, p = x.shape
    codes = [np.empty((b, n_samples), dtype=cells.dtype) for cells in tables.cells]
    same = np.empty((b, p, n_samples), dtype=bool)
    for at in range(0, b, block):
        rows = slice(at, at + block)
        h = _row_hash(ids[rows], n_samples, seed)
        mixed, spare = np.empty_like(h), np.empty_like(h)
        for f in range(p):
            own = np.searchsorted(bins["edges"][f], x[rows, f], side="left")
            _mixed(h, f, mixed, spare)
            np.right_shift(mixed, np.uint64(64 - CELL_BITS), out=spare)
            cell = tables.draws[f].take(spare.view(np.int64), mode="clip")
            near = np.flatnonzero(cell < 0)
            if len(near):
                whole = mixed.ravel()[near]
                cell.ravel()[near] = np.searchsorted(tables.limits[f], whole ^ whole >> np.uint64(31), side="right") * CELLS
            cell[:, 0] = own * CELLS
            np.equal(cell, own[:, None] * CELLS, out=same[rows, f])
            _mixed(h, p + f, mixed, spare)
            np.right_shift(mixed, np.uint64(64 - CELL_BITS), out=spare)
            cell |= spare.view(np.int64)
            code = tables.cells[f].take(cell, mode="clip")
            near = np.flatnonzero(code == code.dtype.type(np.iinfo(code.dtype).max))
            if len(near):
                draw = cell.ravel()[near] >> CELL_BITS
                lo = bins["lo"][f]
                code.ravel()[near] = np.searchsorted(tables.cuts[f], lo[draw] + (bins["hi"][f] - lo)[draw] * _unit(mixed.ravel()[near]))
            code[:, 0] = np.searchsorted(tables.cuts[f], x[rows, f])
            codes[f][rows] = code
    return codes, same


def _own_class(cls, passed, forest, tables, n_samples, block=4):
    """The forest's probability of each row's own class, for its samples."""

    b = len(cls)
    starts = [0, *(np.flatnonzero(np.diff(cls)) + 1), b]
    runs = [(i, min(i + block, end)) for start, end in zip(starts, starts[1:]) for i in range(start, end, block)]  # rows of one class
    y, got = np.zeros((b, n_samples)), np.empty((block, n_samples))
    for codes, value, (_, leaf_of, levels) in zip(leaf_codes(b * n_samples, passed, tables.trees), forest["value"], tables.trees):
        index, by_class = codes.reshape(b, n_samples), value.T
        if levels <= 16:
            by_class = by_class[:, _leaf_table(leaf_of, levels)]
        else:
            index = _leaves(codes, leaf_of, levels).reshape(b, n_samples)
        by_class = np.ascontiguousarray(by_class)
        for i, end in runs:
            np.take(by_class[cls[i]], index[i:end], out=got[:end - i], mode="clip")
            np.add(y[i:end], got[:end - i], out=y[i:end])
    y /= len(forest["feature"])
    return y


def _lime_batch(x, cls, ids, fr, bins, n_samples, top_n, seed, alpha=1.0, tables=None):
    """Vectorised over the batch, feature by feature: perturb, score once, weighted ridge."""

    b, p = x.shape
    tables = tables or lime_tables(fr, bins)
    codes, same = _perturbed(x, ids, bins, tables, n_samples, seed)
    passed = [_word_bits(codes[f].ravel() > codes[f].dtype.type(place)) for (f, _), place in zip(tables.tests, tables.places)]
    y = _own_class(cls, passed, fr, tables, n_samples)
    width = 0.75 * np.sqrt(p)
    nearness = np.sqrt(np.exp(-np.arange(p + 1.0) / width ** 2))  # by the number of features moved
    gram, pull = np.empty((b, p, p)), np.empty((b, p))
    for r in range(b):
        k = nearness[p - same[r].sum(axis=0, dtype=np.int64)]
        ksum, z = k.sum(), same[r].astype(float)
        z -= ((z @ k) / ksum)[:, None]
        weighted = z * k
        gram[r] = weighted @ z.T
        pull[r] = weighted @ (y[r] - (k * y[r]).sum() / ksum)

    def ridge(a, rhs):
        return np.linalg.solve(a + alpha * np.eye(a.shape[2])[None], rhs[:, :, None])[:, :, 0]

    coef = ridge(gram, pull)
    keep = np.argsort(-np.abs(coef) + np.arange(p)[None, :] * 1e-15, axis=1, kind="stable")[:, :top_n]
    rows = np.arange(b)[:, None]
    full = np.zeros((b, p))
    full[rows, keep] = ridge(gram[rows[:, :, None], keep[:, :, None], keep[:, None, :]], pull[rows, keep])
    return full


def lime_explanations(matrix: DataFrame, cols: Sequence[str], forest: dict, bins: dict, id_col: str = "CUST_ID",
                      label_col: str = LABEL, n_samples: int = LIME_SAMPLES, top_n: int = catalog.TOP_N_FEATURES,
                      seed: int = catalog.SEED, chunk_rows: int = 24) -> DataFrame:
    """H3: per customer top-N local-surrogate weights for its own class."""

    import pandas as pd

    spark = matrix.sparkSession
    bc = spark.sparkContext.broadcast({"forest": forest, "bins": bins})
    names = list(cols)

    def run(batches):
        state, tables = bc.value, None
        for pdf in batches:
            if pdf.empty:
                continue
            tables = tables or lime_tables(state["forest"], state["bins"])
            pdf = pdf.sort_values(label_col, kind="stable")  # rows of one class are scored together
            x = pdf[names].to_numpy(dtype=float)
            cls = pdf[label_col].to_numpy(dtype=np.int64)
            ids = pdf[id_col].astype(str).tolist()
            # bounded memory: rows × samples × features per slice, not per Arrow batch
            step = max(1, chunk_rows)
            full = np.vstack([
                _lime_batch(x[i:i + step], cls[i:i + step], ids[i:i + step], state["forest"], state["bins"], n_samples, top_n, seed, tables=tables)
                for i in range(0, len(ids), step)
            ])
            yield pd.DataFrame({id_col: ids, label_col: cls.astype("int32"), "local": list(full)})

    schema = f"{id_col} string, {label_col} int, local array<double>"
    src = _spread(matrix.where((F.col(label_col) >= 0) & (F.col(label_col) < forest["classes"])).select(id_col, label_col, *[F.col(c).cast("double") for c in names]), id_col)
    out = with_contributions(src.mapInPandas(run, schema), "local", names, top_n)
    return out.withColumn("weights", F.transform("contributions", lambda c: c["value"])).drop("local")


# ---------------------------------------------------------------- A17, W4, H7, H8
def segment_importance(contribs: DataFrame, label_col: str = LABEL, top_n: int = catalog.TOP_N_FEATURES,
                       full_vector_col: str | None = "shap", cols: Sequence[str] | None = None) -> DataFrame:
    """A17 + W4 + H8: mean |contribution| per (segment, feature), top-N per
    segment with the segment's summary; the contributions are read once (a
    customer's first entry counts the customer).

    With the full SHAP vector every feature counts for every customer; with
    top-N contributions (LIME) the sum is divided by the customers of the
    segment, as the reference does."""

    if full_vector_col and cols:
        names = F.array(*[F.lit(c) for c in cols])
        ex = contribs.select(label_col, F.posexplode(full_vector_col).alias("i", "v")).select(
            label_col, F.element_at(names, F.col("i") + 1).alias("feature"), F.abs("v").alias("a"), (F.col("i") == 0).cast("long").alias("one"))
    else:
        ex = contribs.select(label_col, F.posexplode("contributions").alias("i", "c")).select(
            label_col, F.col("c.feature").alias("feature"), F.abs("c.value").alias("a"), (F.col("i") == 0).cast("long").alias("one"))
    agg = ex.groupBy(label_col, "feature").agg(F.sum("a").alias("s"), F.sum("one").alias("one"))
    # all below works on one small row per segment and feature
    own = Window.partitionBy(label_col)
    agg = agg.withColumn("mean_abs", F.col("s") / F.sum("one").over(own))
    w = own.orderBy(F.desc("mean_abs"), F.asc("feature"))
    top = agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    top = top.withColumn("feature_label", feature_label(F.col("feature"), catalog.FEATURE_LABELS))
    named = F.collect_list(F.when(F.col("rank") <= 3, F.col("feature_label"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    text = F.concat(F.lit("Segment "), F.col(label_col).cast("string"), F.lit(" is primarily defined by "), F.array_join(named, ", "), F.lit("."))
    return top.select(label_col, "rank", "feature", "feature_label", round_half_up(F.col("mean_abs"), 6).alias("mean_abs"), text.alias("summary"))


def segment_summaries(importance: DataFrame, label_col: str = LABEL) -> DataFrame:
    """H8: 'Segment k is primarily defined by a, b, c.'"""

    return importance.where(F.col("rank") == 1).select(label_col, "summary")


def contribution_sentences(expl: DataFrame, label_col: str = LABEL) -> DataFrame:
    """H7: sentence from the first two contributions ('high' = positive contribution)."""

    reasons = F.transform(F.slice("contributions", 1, 2), lambda c: F.concat(
        F.when(c["direction"] == "positive", F.lit("high")).otherwise(F.lit("low")), F.lit(" "), c["feature_label"]))
    s = F.concat(F.lit("Assigned to Segment "), F.col(label_col).cast("string"), F.lit(" primarily due to "), F.element_at(reasons, 1),
                 F.when(F.size(reasons) > 1, F.concat(F.lit(" and "), F.element_at(reasons, 2), F.lit("."))).otherwise(F.lit(".")))
    return expl.withColumn("explanation", s)


@dataclass
class Explanation:
    """The frames of one explanation, the explainer that made them and the reason code."""

    explainer: str
    reason: str
    detail: str
    customers: DataFrame
    segments: DataFrame
    importance: DataFrame | None = None


def within(spark, seconds: float, work: Callable):
    """Run ``work`` in a job group of its own, which is cancelled when time is up."""

    sc, group = spark.sparkContext, f"explain-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    sc.setJobGroup(group, "explanation", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        out = work()
        if late.is_set():
            raise SurrogateError("out_of_time", f"over {seconds:g} s")
        return out
    except SurrogateError:
        raise
    except Exception as err:  # noqa: BLE001 - the ladder's next step explains instead
        code = "out_of_time" if late.is_set() else "surrogate_error"
        raise SurrogateError(code, type(err).__name__) from err
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def explain(matrix: DataFrame, cols: Sequence[str], mode: str = "shap", centers: DataFrame | None = None,
            boundary: DataFrame | None = None, id_col: str = "CUST_ID", label_col: str = LABEL, budget_s: float | None = None,
            forest: dict | None = None) -> Explanation:
    """H5 + H6: explain every customer by ``mode`` (shap, lime or rule_based;
    anything else means shap). A surrogate is fitted, executed and written inside
    the time budget; when that fails, the rules on the centers explain, and
    without centers the frames are empty. ``budget_s`` None sets no limit; ``forest``
    is a surrogate already fitted to these labels (``fit_surrogate``)."""

    from cohortlens.operators import segments as S

    spark = matrix.sparkSession
    asked = (mode or "").strip().lower()
    asked = asked if asked in ("shap", "lime", "rule_based") else "shap"
    code, detail = "as_requested", ""

    def surrogate() -> tuple[DataFrame, DataFrame]:
        fitted = forest or fit_surrogate(matrix, cols, label_col)[1]
        if asked == "shap":
            con = materialize(shap_explanations(matrix, cols, fitted, id_col, label_col), "shap")
            return con, materialize(segment_importance(con, label_col, cols=cols), "importance")
        con = materialize(lime_explanations(matrix, cols, fitted, quartile_bins(matrix, cols), id_col, label_col), "lime")
        return con, materialize(segment_importance(con, label_col, full_vector_col=None), "importance")

    if asked != "rule_based":
        try:
            con, imp = within(spark, budget_s, surrogate) if budget_s else surrogate()
            ex = contribution_sentences(con.withColumnRenamed(id_col, "customer_id"), label_col)
            ex = S.attach_boundary(ex.select("customer_id", label_col, "explanation", "contributions"), boundary)
            return Explanation(asked, code, detail, ex, segment_summaries(imp, label_col), imp)
        except SurrogateError as err:
            code, detail = err.code, str(err)
    if centers is None:
        nobody = spark.createDataFrame([], f"customer_id string, {label_col} int, explanation string, nearest_alternate_cluster int, boundary_distance_ratio double")
        return Explanation("none", "no_centers", detail, nobody, spark.createDataFrame([], f"{label_col} int, summary string"))
    ex = S.rule_explanations(matrix, cols, centers, boundary, id_col)
    return Explanation("rule_based", code, detail, ex, S.segment_summaries(ex))
