"""A training corpus from ``documents``: toxic texts go, texts without a clear
language go, one document of each near-duplicate group stays, the sources are
mixed to their target weights, and the mix is encoded.

Each stage works on all rows that its predecessor kept; its result is written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, language, mixing, simhash, toxicity
from cohortlens.llm.common import free_name, read_table, save
from cohortlens.llm.queries import vocabulary_path

#: A text is rejected as toxic from this score on, and as of no clear language below the other.
TOXIC_FROM = 0.5
LANGUAGE_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows scored TOXIC_FROM or more go. Null texts are scored as empty ones;
    without any label nothing goes; repeated rows meet the same decision."""

    score = free_name(docs, "score")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, into=score).filter(F.col(score) < TOXIC_FROM).drop(score)


def drop_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows without a letter, or with no language clearly ahead, go. The
    text alone is asked, not the languages' shares of the corpus, so a text in an
    unlearned script goes whatever the corpus holds. Null and empty texts have no
    letter. Without any learned language only rows without a letter can be told, and
    go. Repeated rows meet the same decision; other columns pass through."""

    found = free_name(docs, "found")
    model = language.train(docs)
    if model is None:
        return docs.filter(F.regexp_like(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\p{L}")))
    clear = (F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= LANGUAGE_FROM)
    return language.identify_texts(docs, language.without_prior(model), into=found).filter(clear).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of linked fingerprints the row with the smallest doc_id
    stays. Null and empty texts share the fingerprint zero, so one of them stays."""

    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as the mix takes it; a null source is a source,
    and documents without words have no say in the sizes."""

    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the ids of each whole text, checked by decoding them; a null text is the
    empty one, and repeated rows repeat their result."""

    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary_path(), into="digest_")
    return coded.select("doc_id", "source", "digest_.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unclear_language),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifiers, the fingerprint groups and the vocabulary have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and reread."""

    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"pipeline-{name}")
    return docs
