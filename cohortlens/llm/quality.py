"""Quality: supervised subword embeddings with a softmax output.

A document's features are its white-space separated tokens and the 2- and
3-character runs inside each marked token ``<token>``, hashed into 2^bits buckets
each with a learned vector. The vectors' mean goes through one linear layer and a
softmax; vectors and layer are trained together by stochastic gradient descent in
numpy. As mean and layer are both linear, scoring multiplies the bucket vectors
by the layer once (bucket → class sums), then adds up whole tokens.

Defined cases: a null or empty text has no feature and scores 1 / (number of
classes) by the softmax of zeros plus the learned bias; with no label at all every
score is 0.5; repeated rows score alike; columns of ``docs`` pass through.
"""

import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import labelled_sample

LOW, HIGH = 60, 62  # the marks < and >
MIX = np.uint64(0x9E3779B97F4A7C15)


def token_features(tokens: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, token of each bucket) of distinct tokens: the token itself and
    its 2- and 3-character runs."""

    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join(f"<{t}>" for t in tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(tokens)), [len(t) + 2 for t in tokens])
    words = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), dtype=np.uint64, count=len(tokens))
    with np.errstate(over="ignore"):
        two = (chars[:-1] << np.uint64(21) | chars[1:]) * MIX
        three = (chars[:-2] << np.uint64(42) | chars[1:-1] << np.uint64(21) | chars[2:]) * MIX ^ MIX
        found = np.concatenate([words * MIX, (two ^ two >> np.uint64(29))[owner[:-1] == owner[1:]] * MIX, (three ^ three >> np.uint64(31))[owner[:-2] == owner[2:]] * MIX])
    of = np.concatenate([np.arange(len(tokens)), owner[:-1][owner[:-1] == owner[1:]], owner[:-2][owner[:-2] == owner[2:]]])
    return (found >> np.uint64(64 - bits)).astype(np.int64), of


def text_features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, how often each) of a whole text."""

    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    names, times = np.unique(np.array(tokens, dtype=object), return_counts=True)
    at, of = token_features(names.tolist(), bits)
    buckets, back = np.unique(at, return_inverse=True)
    return buckets.astype(np.int32), np.bincount(back, weights=times[of]).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, bits: int, dim: int, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(bucket → class sums, bias), by SGD with a falling rate."""

    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, times, y = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            share = times / max(times.sum(), 1.0)
            mean = share @ vectors[at]
            out = mean @ layer + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[y] -= 1.0
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            vectors[at] -= (lr * share)[:, None] * back[None, :]
    return (vectors @ layer).astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, rows: int = 8_000, bits: int = 17, dim: int = 12, epochs: int = 5, rate: float = 1.0):
    """The model from at most ``rows`` labelled documents outside fold 0; None
    without any. Executors turn whole texts into bucket counts; only these go to
    the driver."""

    @F.pandas_udf("struct<at:array<int>,times:array<float>>")
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_features(t, bits) for t in texts], columns=["at", "times"])

    sample = labelled_sample(docs, labels, label, folds=folds, rows=rows)
    got = sample.select("id_", "y", features("text").alias("f")).select("id_", "y", "f.at", "f.times").toArrow()
    if got.num_rows == 0:
        return None
    at, times = got["at"].combine_chunks(), got["times"].combine_chunks()
    flat, counts, stops = at.values.to_numpy(), times.values.to_numpy(), at.offsets.to_numpy()
    ids, y = got["id_"].to_numpy(), got["y"].to_numpy()
    cells = [(flat[a:b], counts[a:b]) for a, b in zip(stops, stops[1:])]
    digests = np.array([xxhash.xxh64_intdigest(f.tobytes() + c.tobytes()) for f, c in cells], dtype=np.uint64)
    order = np.lexsort((digests, ids))  # a fixed order, whatever order the rows arrive in
    sums, bias = fit([(*cells[i], int(y[i] > 0)) for i in order], bits=bits, dim=dim, epochs=epochs, rate=rate)
    return sums, bias, bits


class Scorer:
    """Class sums of whole tokens, remembered for a bounded number of them."""

    def __init__(self, sums: np.ndarray, bias: np.ndarray, bits: int, most: int = 400_000):
        self.edge, self.bias, self.bits, self.most = (sums[:, 1] - sums[:, 0]).astype(np.float64), float(bias[1] - bias[0]), bits, most
        self.row: dict[str, int] = {}
        self.sum, self.count = np.zeros(0), np.zeros(0)

    def learn_tokens(self, tokens: list[str]) -> None:
        at, of = token_features(tokens, self.bits)
        self.row.update(zip(tokens, range(len(self.sum), len(self.sum) + len(tokens))))
        self.sum = np.concatenate([self.sum, np.bincount(of, weights=self.edge[at], minlength=len(tokens))])
        self.count = np.concatenate([self.count, np.bincount(of, minlength=len(tokens))])

    def score(self, texts: list[str]) -> list[float]:
        if len(self.row) > self.most:
            self.row, self.sum, self.count = {}, np.zeros(0), np.zeros(0)
        split = [t.split() for t in texts]
        if new := list(set().union(*split).difference(self.row)):
            self.learn_tokens(new)
        out = []
        for tokens in split:
            rows = np.fromiter(map(self.row.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            out.append(self.bias + (self.sum[rows].sum() / self.count[rows].sum() if len(rows) else 0.0))
        return out


_SCORERS: dict[str, Scorer] = {}


def score_texts(docs: DataFrame, model, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into``: the probability of label 1 for each whole text. The model's
    size is bounded by its 2^bits buckets."""

    if model is None:
        return docs.withColumn(into, F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(*sent.value)
        texts, out = ["" if t is None else t for t in texts], []
        start, chars = 0, 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars >= 4_000_000 or i + 1 == len(texts):
                out += _SCORERS[name].score(texts[start : i + 1])
                start, chars = i + 1, 0
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(np.array(out, dtype=float), -35, 35))))

    return docs.withColumn(into, run(F.col(text).cast("string")))
