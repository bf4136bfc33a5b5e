"""Language identification: words first, shorter and shorter n-grams after.

Per language the model holds log frequencies of known words and of character
n-grams. A known word scores by its own log frequencies. An unseen word scores by
the mean over its longest n-grams of which any is known, each step down to a
shorter length costing ``PENALTY`` of the evidence. A text's score is the softmax of
its mean evidence, held against ``FIRM`` words at most, plus the log share of each
language.

The model is fitted on a bounded sample: about ``docs_each`` documents of each of
the ``languages`` most frequent languages, by id hash; it keeps the ``words`` most
frequent words and ``grams`` n-grams of each length, which bounds what is broadcast.

Defined cases: a null text, or one without a letter, gets ``und`` with score 0; if
no language was learned every text does. Null ids and null languages teach nothing.
Repeated rows get equal results; other columns of ``docs`` pass through.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fold, hash32, save, text_groups

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
LENGTHS = (5, 4, 3, 2, 1)
PENALTY = 0.75
FIRM = 20
#: Unseen words that a worker remembers, and at most so many scores of theirs, one a language.
REMEMBERED, SCORES = 100_000, 8_000_000
#: Counts that a worker holds before it hands them on.
COUNTS = 50_000


def marked_grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def train(docs: DataFrame, *, folds: int = 3, held_out: int = 1, docs_each: int = 1_500, languages: int = 256, words: int = 60_000, grams: int = 12_000):
    """The fitted model, or None if there is nothing to learn from."""

    own = fold(F.col("doc_id"), folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (own != held_out))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not found:
        return None
    names = sorted(r["lang"] for r in found)
    share = {r["lang"]: min(1.0, docs_each / r["count"]) for r in found}
    bar = F.create_map(*[F.lit(x) for k in names for x in (k, share[k] * 2.0**32)])
    sample = rows.filter(F.col("lang").isin(names)).filter(hash32(F.col("doc_id"), F.lit(3)) <= bar[F.col("lang")])

    def rows_of(counts):
        return pd.DataFrame([(k, item, n) for (k, item), n in counts.items()], columns=["lang", "item", "n"])

    def words_of(batches):
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                for w in WORDS(text.lower()):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
                if len(counts) >= COUNTS:
                    yield rows_of(counts)
                    counts = {}
            yield rows_of(counts)

    def grams_of(batches):
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, word, n in zip(batch["lang"], batch["item"], batch["n"]):
                for size in LENGTHS:
                    for g in marked_grams(word, size):
                        counts[lang, g] = counts.get((lang, g), 0) + n
                if len(counts) >= COUNTS:
                    yield rows_of(counts)
                    counts = {}
            yield rows_of(counts)

    made = "lang string, item string, n bigint"
    seen = save(sample.select("lang", "text").mapInPandas(words_of, made).groupBy("lang", "item").agg(F.sum("n").alias("n")), "lang-words")
    parts = save(seen.mapInPandas(grams_of, made).groupBy("lang", "item").agg(F.sum("n").alias("n")), "lang-grams")
    at = {k: i for i, k in enumerate(names)}

    def table(counts: DataFrame, most: int) -> dict[str, np.ndarray]:
        totals = np.ones(len(names))
        for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():  # one row a language
            totals[at[r["lang"]]] = r["n"]
        best = counts.groupBy("item").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        out = {}
        for r in best.orderBy(F.desc("n"), "item").limit(most).toLocalIterator():  # rows are not kept beside the table
            own = np.full(len(names), 0.5)
            for k, n in r["by"].items():
                own[at[k]] += n
            out[r["item"]] = np.log(own / (totals + 0.5 * most)).astype(np.float32)
        return out

    known = table(seen, words)
    by_length = {n: table(parts.filter(F.length("item") == n), grams) for n in LENGTHS}
    prior = np.array([next(r["count"] for r in found if r["lang"] == k) for k in names], dtype=float)
    return names, np.log(prior / prior.sum()), known, by_length


def packed(model):
    """The model as the executors get it: each table as the rows of its items and one
    matrix of centred log frequencies."""

    names, prior, known, by_length = model

    def centred(table):
        m = np.array([*table.values()], dtype=np.float32).reshape(len(table), len(names))
        return {item: i for i, item in enumerate(table)}, m - m.mean(axis=1, keepdims=True)

    return names, prior, centred(known), {n: centred(t) for n, t in by_length.items()}


class Identifier:
    """Scores words with a packed model, remembering a bounded number of unseen ones."""

    def __init__(self, names, prior, known, by_length):
        self.names, self.prior = names, prior
        self.fixed, self.base = known
        self.grams = by_length
        self.most = min(REMEMBERED, SCORES // len(names))
        self.restart()

    def restart(self) -> None:
        self.place, self.rows = dict(self.fixed), self.base

    def remember(self, words: list[str]) -> None:
        """Rows for more words; room for them grows by a quarter, so a row is copied a few times only."""

        used = len(self.place)
        need = used + len(words)
        if need > len(self.rows):
            rows = np.empty((max(need, len(self.rows) * 5 // 4), len(self.names)), dtype=np.float32)
            rows[:used] = self.rows[:used]
            self.rows = rows
        self.rows[used:need] = self.unseen(words)
        self.place.update(zip(words, range(used, need)))

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row for each unseen word: the mean over its longest known n-grams."""

        out = np.zeros((len(words), len(self.names)), dtype=np.float32)
        left, weight = range(len(words)), 1.0
        for n in LENGTHS:
            at, table = self.grams[n]
            get, found, sizes, owners, still = at.get, [], [], [], []
            for j in left:
                marked = f"<{words[j]}>"
                hits = [i for k in range(len(marked) - n + 1) if (i := get(marked[k : k + n])) is not None]
                if hits:
                    found += hits
                    sizes.append(len(hits))
                    owners.append(j)
                else:
                    still.append(j)
            if owners:
                starts = np.cumsum(sizes) - sizes
                out[owners] = weight * np.add.reduceat(table[found], starts, axis=0) / np.array(sizes, dtype=np.float32)[:, None]
            left, weight = still, weight * PENALTY
        return out

    def identify(self, texts: list[str]) -> list[tuple[str, float]]:
        """For some whole texts: language and score."""

        if len(self.place) > len(self.fixed) + self.most:
            self.restart()
        split = [WORDS(t.lower()) for t in texts]
        if new := list(set().union(*split).difference(self.place)):
            self.remember(new)
        out = []
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            total = self.prior + self.rows[at].sum(axis=0, dtype=np.float64) * min(1.0, FIRM / len(at))
            best = int(np.argmax(total))
            out.append((self.names[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def without_prior(model):
    """The model without the languages' shares of the corpus and without the marks of a
    word's ends as single characters, which any script has: a score then rests on the
    text's own words and letters, and a text of which none is known has the same score
    for all languages."""

    if model is None:
        return None
    names, prior, known, by_length = model
    letters = {g: v for g, v in by_length[1].items() if g not in ("<", ">")}
    return names, np.zeros_like(prior), known, {**by_length, 1: letters}


def identify_texts(docs: DataFrame, model, text: str = "text", into: str = "found") -> DataFrame:
    """Add ``into``: struct(lang_pred, score) of each whole text."""

    if model is None:
        return docs.withColumn(into, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")))
    sent = docs.sparkSession.sparkContext.broadcast(packed(model))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        who = Identifier(*sent.value)
        for texts in batches:
            out = [x for group in text_groups(texts) for x in who.identify(group)]
            yield pa.StructArray.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(into, run(F.col(text).cast("string")))
