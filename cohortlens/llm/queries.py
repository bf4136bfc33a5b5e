"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import align, bpe, hardneg, language, merkle, mixing, quality, sharding, simhash, tokencount, topk, toxicity, urls
from cohortlens.llm.common import fold, read_table

#: The vocabulary file that the BPE query uses, and the model that is aligned with it.
VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizers' package keeps a vocabulary file."""

    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    found = language.identify_texts(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held, "found.lang_pred", "found.score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, vocabulary_path())
    return coded.select("doc_id", "digest.n_tokens", "digest.ids_sha256", "digest.decoded_sha256")


def _judged(scored: DataFrame, bar: float) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return _judged(quality.score_texts(docs.select("doc_id", "text"), model), 0.3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return _judged(toxicity.score_texts(docs.select("doc_id", "text"), model), 0.5)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    vectors = hardneg.labelled_vectors(rows)
    return hardneg.mine(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return tokencount.count_tokens(docs, vocabulary_path()).select("doc_id", size, "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_statistics(read_table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path(PIECE_MODEL))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_topk": op4_topk,
    "op5_mixing": op5_mixing,
    "op6_bpe": op6_bpe,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {"op2_url_filter": urls.SQL, "op4_topk": topk.SQL, "op5_mixing": mixing.SQL, "op7_fingerprints": merkle.SQL, "op11_hard_negatives": hardneg.SQL}
