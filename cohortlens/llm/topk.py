"""Exact top-k search over an impact-ordered index, score at a time.

Vectors become integers; the score is the integer inner product. Each index block
keeps, for every dimension, postings grouped by quantised impact (the bit length of
a component's size), one segment a level. A block of queries meets a block of the
index: segments are processed by descending impact, all dimensions of a level at
once, adding exact contributions to the accumulators. What a row can still gain
or lose is at most the next level's largest impact times the query's weights on
the row's unprocessed dimensions. A query stops only on proof: when few rows can
still reach its k-th best lower bound, these are rescored exactly. The best k of
all blocks are then ranked for each query.

Blocks are bounded in rows, so no task holds the index or all queries; vectors are
dealt by an id hash, so copies and hot labels do not gather.

Defined cases: vectors that are null or hold a null or a non-finite component take
no part; an id that repeats counts once, with its smallest vector; shorter vectors
count as padded with zeros, empty ones score 0; ties go to the smaller id; fewer
than k candidates give them all; no vectors give no rows. Other columns, whatever
their names, are not read. Scores must fit a long, or an error is raised.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import save

ROWS, QUERIES = 8192, 512
TOGETHER = 64  # queries whose accumulators are held at once
FEW = 4  # rescore when at most FEW * k rows can still be members


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for usable vectors."""

    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable & F.col("vec_id").isNotNull())
    return rows.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


class ImpactIndex:
    """The impact-ordered postings of one block of vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, exact=np.float64):
        """``exact``: a float type that holds every possible score without rounding."""

        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], matrix[order]
        size = np.abs(self.exact)
        level = np.frexp(size.astype(np.float64))[1]  # bit length; 0 for zero
        self.levels = sorted(np.unique(level[level > 0]).tolist(), reverse=True)
        # A level's segments of all dimensions, as one sparse plane; rows and columns without a posting hold 0.
        self.planes = [np.where(level == n, self.exact, 0).astype(exact) for n in self.levels]
        self.most = [float(size[level == n].max()) for n in self.levels]
        self.unread = [((level <= n) & (level > 0)).astype(exact) for n in self.levels]
        self.type = exact

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, score): members of each query's top k in this block."""

        weight, live = queries.astype(self.type), np.arange(len(queries))
        own = self.ids[None, :] == ids[:, None]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        gathered, few, end = np.zeros((len(queries), len(self.ids)), dtype=self.type), FEW * k, len(self.levels)

        def members(some: slice, n: int) -> np.ndarray:
            """Rows that can still be among the best k once the first n levels are read."""

            # The unread levels hold at most most[n] for each of their postings.
            rest = (np.abs(weight[some]) @ self.unread[n].T) * self.type(self.most[n]) if n < end else self.type(0)
            low = np.where(own[live[some]], -np.inf, gathered[some] - rest)
            at = max(0, low.shape[1] - k)
            bar = np.partition(low, at, axis=1)[:, at]
            return (gathered[some] + rest >= bar[:, None]) & ~own[live[some]]

        for n in range(end + 1):
            # A proof is tried for all queries once it is near for one of the first.
            if n == end or n and members(slice(0, 2), n).sum(axis=1).min() <= 2 * few:
                member = members(slice(None), n)
                over = (member.sum(axis=1) <= few) | (n == end)
                q, v = np.nonzero(member[over])
                found.append((live[over][q], v))
                live, weight, gathered = live[~over], weight[~over], gathered[~over]
            if not len(live) or n == end:
                break
            gathered += weight @ self.planes[n].T
        q = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        v = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        score = np.einsum("ij,ij->i", queries[q], self.exact[v]) if len(q) else np.zeros(0, np.int64)
        order = np.lexsort((self.ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        start = np.searchsorted(q, q)
        keep = np.arange(len(q)) - start < k
        return q[keep], v[keep], score[keep]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query; both frames
    are (vec_id, v) of integers, and a row with the query's id is no candidate."""

    vectors, queries = save(vectors, "topk-vectors"), save(queries, "topk-queries")
    n, wide, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    m, qwide, qmost = queries.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    width = max(wide or 0, qwide or 0, 1)
    if (most or 0) * (qmost or 0) * width >= 2**53:
        raise ValueError("scores of these vectors would not be exact")
    exact = np.float32 if (most or 0) * (qmost or 0) * width < 2**22 else np.float64
    blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-m // query_rows))
    index = vectors.withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    index = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = ImpactIndex(left["vec_id"].to_numpy(), _matrix(left["v"], width), exact)
        ids, weights = right["vec_id"].to_numpy(), _matrix(right["v"], width)
        parts = []
        for i in range(0, len(ids) if len(left) and len(ids) else 0, TOGETHER):
            q, v, score = block.search(ids[i : i + TOGETHER], weights[i : i + TOGETHER], k)
            parts.append(pd.DataFrame({"query_id": ids[i : i + TOGETHER][q], "vec_id": block.ids[v], "score": score}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    met = index.groupBy("b", "qb").cogroup(asked.groupBy("b", "qb")).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""
