"""Hard-negative mining by angular triangle filtering.

Every vector keeps its norm and its angles to a few reference directions. On the
sphere, the angle between an anchor and a row is at least the difference of their
angles to a reference, and at most their sum (or what is left of the full circle), so
the stored angles of all references give an interval for the cosine. Times both norms,
and widened by more than any rounding, it bounds the score. A row whose interval does
not overlap the window of scores that is asked for cannot be in the result; only the
others get integer scoring. Rows lie in cells by their nearest reference, sorted by the
angle to it, so a window of scores is first a window of angles, found by search.

Two rounds meet blocks of rows with groups of anchors. The first finds each anchor's
best rows of its own label (the positives; the window starts at the k-th best lower
bound). The second asks, for each positive, for the best rows of other labels whose
score lies between two shares of the positive's score. A block's answer is at most k
rows for each anchor and positive; the best of all blocks are ranked per anchor.

Blocks and groups are bounded in rows and dealt by an id hash, so a hot label or a
crowd of copies is spread, and no task holds the table or all anchors. Rows are copied
once per group of anchors (GROUP of them), anchors once per block that can hold an
answer. The references are fitted on a bounded sample (SAMPLE rows by id hash); they
decide how much is skipped, never the result.

Defined cases: rows whose vector or label is null, whose vector holds a null or a
non-finite component, or a component beyond a long once scaled, take no part; an id
that repeats counts once, with its smallest (label, vector); shorter vectors count as
padded with zeros; zero vectors score 0; ties go to the smaller id; fewer rows than
asked for give them all; an anchor without positives gives no rows; a positive with a
negative score has an empty window; no vectors give no rows. Other columns, whatever
their names, are not read. Scores must fit a long, or an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import hash32, save

#: Reference directions, rows they are fitted on, rows of a block, anchors of a group, anchors bounded at once.
REFERENCES, SAMPLE, BLOCK, GROUP, TILE = 8, 4096, 16384, 8192, 32
#: Angles are stored in single precision and widened by this; bounds by this share of the norms, and by one.
ANGLE_SLACK, SCORE_SLACK = 1e-5, 1e-5


def labelled_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component, for usable rows."""

    limit = float(2**62)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < limit))
    rows = vectors.filter(F.col("embedding").isNotNull() & fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), v.alias("v")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def directions(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Unit vectors far apart: the sample's mean direction, then always the sampled
    direction farthest from those chosen."""

    size = np.linalg.norm(sample, axis=1)
    unit = sample[size > 0] / size[size > 0, None]
    mean = unit.mean(axis=0) if len(unit) else np.zeros(sample.shape[1])
    if not np.linalg.norm(mean) > 1e-9:
        mean = unit[0] if len(unit) else np.eye(1, sample.shape[1])[0]
    chosen = [mean / np.linalg.norm(mean)]
    near = unit @ chosen[0]
    while len(chosen) < most and len(unit) and near.min() < 1 - 1e-9:
        chosen.append(unit[near.argmin()])
        near = np.maximum(near, unit @ chosen[-1])
    return np.array(chosen)


def angles_to(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norm, angle to each reference) of each row; a zero vector has right angles."""

    x = vectors.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    cos = x @ references.T / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cos, -1, 1)).astype(np.float32)


def score_bounds(norm: np.ndarray, angle: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each anchor (norm, angle) and each row (norms, angles)."""

    low = np.zeros((len(norm), len(norms)), dtype=np.float32)
    high = np.full_like(low, np.pi)
    for r in range(angle.shape[1]):
        both = angle[:, r, None] + angles[None, :, r]
        np.maximum(low, np.abs(angle[:, r, None] - angles[None, :, r]), out=low)
        np.minimum(high, np.minimum(both, np.float32(2 * np.pi) - both), out=high)
    size = norm[:, None] * norms[None, :]
    slack = size * SCORE_SLACK + 1
    return size * np.cos(np.minimum(high + ANGLE_SLACK, np.pi)) - slack, size * np.cos(np.maximum(low - ANGLE_SLACK, 0)) + slack


class Block:
    """The rows of one block, sorted by the angle to their cell's reference."""

    def __init__(self, rows: pd.DataFrame, width: int, exact):
        self.cell = int(rows["cell"].iloc[0])
        angles = np.stack(rows["angles"].to_numpy())
        order = np.lexsort((rows["vec_id"].to_numpy(), angles[:, self.cell]))
        self.ids, self.labels = rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order]
        self.norms, self.angles = rows["norm"].to_numpy()[order], angles[order]
        self.x = _matrix(rows["v"], width)[order].astype(exact)
        self.scored = 0

    def window(self, norm: np.ndarray, angle: np.ndarray, least: np.ndarray, most: np.ndarray) -> slice:
        """The rows whose angle to the cell's reference lets some anchor score in its [least, most]."""

        start, stop = angle_window(norm, angle[:, self.cell], least, most, self.norms.min(), self.norms.max())
        some = start <= stop
        if not some.any():
            return slice(0, 0)
        theta = self.angles[:, self.cell]
        return slice(int(np.searchsorted(theta, start[some].min())), int(np.searchsorted(theta, stop[some].max(), side="right")))

    def scores(self, vectors: np.ndarray, member: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, scores, rows), for the rows that are a member for some anchor."""

        used = member.any(axis=0)
        self.scored += int(member.sum())
        found = vectors @ self.x[rows[used]].T
        if found.dtype == object and found.size and max(abs(found.min()), abs(found.max())) >= 1 << 63:
            raise ValueError("scores of these vectors do not fit a long")
        return member[:, used], found.astype(np.int64), rows[used]


def angle_window(norm, angle, least, most, smallest, largest) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) angle to a reference of the rows that can score in [least, most]
    (both 0 or more) with an anchor, given the rows' smallest and largest norm; first
    is after last where no row can."""

    top, bottom = norm * largest, norm * smallest
    least, most = least - (top * SCORE_SLACK + 1), most + (top * SCORE_SLACK + 1)
    floor = np.divide(least, top, out=np.where(least > 0, np.inf, -1.0), where=top > 0)
    widest = np.where(least <= 0, np.pi, np.arccos(np.clip(floor, -1, 1)))
    narrowest = np.arccos(np.clip(np.divide(most, bottom, out=np.ones_like(top), where=bottom > 0), -1, 1))
    first = np.maximum(angle - widest, narrowest - angle) - 2 * ANGLE_SLACK
    last = np.minimum(angle + widest, 2 * np.pi - angle - narrowest) + 2 * ANGLE_SLACK
    return np.where(floor > 1, np.inf, first), last


def _best(score: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, column) of each anchor's k best fitting columns, ties to the smaller id."""

    if not score.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = np.where(fits, score, np.iinfo(np.int64).min)
    at = max(0, held.shape[1] - k)
    q, v = np.nonzero(fits & (held >= np.partition(held, at, axis=1)[:, at][:, None]))
    order = np.lexsort((ids[v], -score[q, v], q))
    q, v = q[order], v[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep]


def block_positives(block: Block, anchors: pd.DataFrame, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """Members of each anchor's best k rows of its own label in this block."""

    ids, norms, angles = anchors["vec_id"].to_numpy(), anchors["norm"].to_numpy(), np.stack(anchors["angles"].to_numpy())
    labels, out = anchors["label"].to_numpy(), [np.zeros((0, 3), np.int64)]
    for label in np.intersect1d(labels, block.labels):
        rows, mine = np.flatnonzero(block.labels == label), np.flatnonzero(labels == label)
        for i in range(0, len(mine), TILE):
            some = mine[i : i + TILE]
            least, most = score_bounds(norms[some], angles[some], block.norms[rows], block.angles[rows])
            other = block.ids[rows][None, :] != ids[some][:, None]
            least = np.where(other, least, -np.inf)
            at = max(0, least.shape[1] - k)
            bar = np.partition(least, at, axis=1)[:, at]
            member, score, used = block.scores(vectors[some], other & (most >= bar[:, None]), rows)
            q, v = _best(score, member, block.ids[used], k)
            out.append(np.stack([ids[some][q], block.ids[used][v], score[q, v]], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=["anchor_id", "positive_id", "positive_score"])


def block_negatives(block: Block, anchors: pd.DataFrame, vectors: np.ndarray, k: int, low: int, high: int) -> pd.DataFrame:
    """For each anchor and positive the best k rows of this block of other labels that
    score from ``low`` to ``high`` percent of the positive."""

    ids, norms, angles = anchors["vec_id"].to_numpy(), anchors["norm"].to_numpy(), np.stack(anchors["angles"].to_numpy())
    labels, least, most = (anchors[c].to_numpy() for c in ("label", "least", "most"))
    order = np.argsort(angles[:, block.cell])
    out = [np.zeros((0, 5), np.int64)]
    for i in range(0, len(order), TILE):
        some = order[i : i + TILE]
        span = block.window(norms[some], angles[some], least[some], most[some])
        if span.start >= span.stop:
            continue
        lower, upper = score_bounds(norms[some], angles[some], block.norms[span], block.angles[span])
        member = (upper >= least[some, None]) & (lower <= most[some, None]) & (block.labels[None, span] != labels[some, None])
        member, score, used = block.scores(vectors[some], member, np.arange(span.start, span.stop))
        positives = [anchors["positives"].iloc[a] for a in some]
        for p in range(max(map(len, positives))):
            named = np.array([(x[p]["positive_id"], x[p]["positive_score"]) if p < len(x) else (0, -1) for x in positives], dtype=np.int64)
            bar = named[:, 1]
            # Whole numbers without overflow: 100 * s >= low * p and 100 * s <= high * p.
            bottom, top = [-(-low * int(b) // 100) for b in bar], [high * int(b) // 100 for b in bar]
            fits = member & (bar >= 0)[:, None] & (score >= np.array(bottom)[:, None]) & (score <= np.array(top)[:, None])
            q, v = _best(score, fits, block.ids[used], k)
            out.append(np.stack([ids[some][q], named[q, 0], bar[q], block.ids[used][v], score[q, v]], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Both
    frames are (vec_id, label, v) of integers; ``anchors`` are rows of ``vectors``."""

    vectors = save(vectors, "hardneg-vectors")
    n, width, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    width = max(width or 0, 1)
    exact = np.float64 if (most or 0) ** 2 * width < 2**53 else object
    sample = vectors.orderBy(hash32(F.col("vec_id"), F.lit(5)), "vec_id").limit(SAMPLE).select("v").toPandas()
    references = directions(_matrix(sample["v"], width).astype(np.float64))

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            norm, angle = angles_to(_matrix(rows["v"], width), references)
            yield rows.assign(norm=norm, angles=list(angle), cell=angle.argmin(axis=1).astype(np.int32))

    kept = "vec_id bigint, label bigint, v array<bigint>, norm double, angles array<float>"
    index = save(vectors.mapInPandas(indexed, f"{kept}, cell int"), "hardneg-index")
    own = F.element_at("angles", F.col("cell") + 1)
    # One row a reference: rows, and the ranges of norms and of angles to it.
    cells = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("n0"), F.max("norm").alias("n1"), F.min(own).alias("t0"), F.max(own).alias("t1")).orderBy("cell").collect()
    slices = {c["cell"]: -(-c["n"] // BLOCK) for c in cells}
    asked = save(index.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi"), "hardneg-anchors")
    groups = max(1, -(-asked.count() // GROUP))
    slice_of = F.coalesce(*[F.when(F.col("cell") == c, F.pmod(hash32(F.col("vec_id"), F.lit(6)), F.lit(s))) for c, s in slices.items()], F.lit(0)).cast("int")
    blocks = index.withColumn("slice", slice_of).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    group_of = F.pmod(hash32(F.col("vec_id"), F.lit(7)), F.lit(groups)).cast("int")

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each anchor once for every block of the cells that can hold an answer."""

        for rows in batches:
            angle, norm = np.stack(rows["angles"].to_numpy()) if len(rows) else np.zeros((0, len(references))), rows["norm"].to_numpy()
            for c in cells:
                if "least" in rows:
                    first, last = angle_window(norm, angle[:, c["cell"]], rows["least"].to_numpy(), rows["most"].to_numpy(), c["n0"], c["n1"])
                    can = (first <= last) & (first <= c["t1"]) & (last >= c["t0"])
                else:
                    can = np.ones(len(rows), dtype=bool)
                for s in range(slices[c["cell"]]):
                    yield rows[can].assign(cell=np.int32(c["cell"]), slice=np.int32(s))

    def met(asked: DataFrame, extra: str, answer, schema: str) -> DataFrame:
        sent = asked.drop("cell").mapInPandas(visits, f"{kept}{extra}, cell int, slice int").withColumn("g", group_of)

        def run(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(some):
                return pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in schema.split(", ")})
            return answer(Block(rows, width, exact), some, _matrix(some["v"], width).astype(exact))

        return blocks.groupBy("cell", "slice", "g").cogroup(sent.groupBy("cell", "slice", "g")).applyInPandas(run, schema)

    found = met(asked, "", lambda b, a, v: block_positives(b, a, v, positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= positives)
    listed = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("positives"), F.max("positive_score").alias("top"), F.min(F.when(F.col("positive_score") >= 0, F.col("positive_score"))).alias("bottom"))
    windows = listed.filter("bottom IS NOT NULL").select(
        F.col("anchor_id").alias("vec_id"), F.transform("positives", lambda p: F.struct(p["positive_id"].alias("positive_id"), p["positive_score"].alias("positive_score"))).alias("positives"),
        (F.col("bottom") * F.lit(low / 100)).cast("double").alias("least"), (F.col("top") * F.lit(high / 100)).cast("double").alias("most"),
    )
    armed = save(asked.join(windows, "vec_id"), "hardneg-windows")
    extra = ", positives array<struct<positive_id:bigint,positive_score:bigint>>, least double, most double"
    result = met(armed, extra, lambda b, a, v: block_negatives(b, a, v, negatives, low, high), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = result.withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, m.label AS label, m.v AS v FROM (SELECT vec_id, min({'label': label, 'v': v}) AS m FROM u GROUP BY vec_id)),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
