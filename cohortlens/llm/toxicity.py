"""Toxicity: logistic regression trained by FTRL-proximal over hashed n-grams.

A document's features are its distinct words, word pairs and pairs with one word
between (skip-grams), lower-cased and hashed into 2^bits buckets. FTRL keeps a
learning rate for each coordinate and sets weights with little evidence to
exactly zero, so the model that travels to the executors is a short list of
(bucket, weight). Labels come from a bounded sample (``rows``); every document is
scored over its whole text.

Defined cases: a null or empty text has no feature and scores the model's bias;
with no label at all every score is 0; repeated rows score alike; columns of
``docs``, whatever their names, pass through.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import Remembered, labelled_sample, text_groups

WORDS = re.compile(r"\w+").findall
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


HASHES = Remembered(_word_hash, 100_000)


def forget() -> None:
    """Drop the remembered hashes of this process."""

    HASHES.clear()


def buckets(text: str | None, bits: int) -> np.ndarray:
    """The buckets of all words, pairs and skip-grams of a whole text, repeats included."""

    words = WORDS(text.lower()) if text else []
    HASHES.trim()
    h = np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        grams = [h, h[:-1] * PAIR + (h[1:] ^ PAIR), h[:-2] * SKIP + (h[2:] ^ SKIP)] if len(h) else [h]
        mixed = np.concatenate(grams) * PAIR
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class FtrlProximal:
    """The FTRL-proximal learner: per-coordinate rates, L1 and L2 on 0/1 features."""

    def __init__(self, bits: int, alpha: float = 3.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at.astype(np.int32), self.weights(at).astype(np.float32), float(self.bias())


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, rows: int = 10_000, bits: int = 20, epochs: int = 5):
    """Sparse weights (buckets, weights, bias, bits) from at most ``rows`` labelled
    documents outside fold 0; None without any. Executors turn whole texts into
    buckets; only these go to the driver."""

    @F.pandas_udf("array<int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([np.unique(buckets(t, bits)).astype(np.int32) for t in texts], dtype=object)
        finally:
            forget()

    sample = labelled_sample(docs, labels, label, folds=folds, rows=rows)
    got = sample.select("id_", "y", features("text").alias("at")).toArrow()
    if got.num_rows == 0:
        return None
    ids, y = got["id_"].to_numpy(), got["y"].to_numpy()
    at = got["at"].combine_chunks()
    flat, stops = at.values.to_numpy(), at.offsets.to_numpy()
    digests = np.array([xxhash.xxh64_intdigest(flat[stops[i] : stops[i + 1]].tobytes()) for i in range(len(ids))], dtype=np.uint64)
    first = np.lexsort((digests, ids))  # a fixed order, whatever order the rows arrive in
    model, rng = FtrlProximal(bits), np.random.default_rng(7)
    for _ in range(epochs):
        for i in first[rng.permutation(len(first))]:
            model.learn(flat[stops[i] : stops[i + 1]], int(y[i]))
    return (*model.sparse(), bits)


def score_texts(docs: DataFrame, model, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into``: the probability that a whole text is toxic. The model's size
    is bounded by its 2^bits buckets."""

    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, weights, bias, bits = sent.value
        dense = np.zeros(1 << bits, dtype=np.float32)
        dense[at] = weights
        try:
            for texts in batches:
                out = np.empty(len(texts))
                for i, t in enumerate(t for group in text_groups(texts) for t in group):
                    b = buckets(t, bits)
                    b = np.unique(b[dense[b] != 0])
                    out[i] = dense[b].sum(dtype=np.float64) + bias
                yield pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))
        finally:
            forget()  # the worker goes on to other stages

    return docs.withColumn(into, run(F.col(text).cast("string")))
