"""The pipeline against its stages by hand, and its edge cases."""

from collections import Counter

import corpus_pipeline as P
import pytest

from cohortlens.llm import language, mixing, simhash, toxicity
from cohortlens.llm.common import save

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    """Each stage's rows equal its operator's decisions, row by row."""

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in P.STAGES:
        tables.append((name, docs, docs := save(stage(spark, docs, SF), f"test-{name}")))
    assert [n for n, _, _ in tables] == ["toxicity", "language_id", "simhash", "mixing", "bpe"]
    assert all(out.columns == columns for _, _, out in tables[:-1])
    ids = [Counter(r["doc_id"] for r in out.select("doc_id").collect()) for _, _, out in tables]
    (_, start, clean), (_, _, clear), (_, _, single), (_, _, mixed), (_, _, coded) = tables

    model = toxicity.train(start, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["s"] for r in toxicity.score_texts(start, model, into="s").collect()}
    assert set(ids[0]) == {d for d, s in scores.items() if s < P.TOXIC_FROM}
    found = {r["doc_id"]: r["f"] for r in language.identify_texts(clean, language.without_prior(language.train(clean)), into="f").collect()}
    assert set(ids[1]) == {d for d, f in found.items() if f["lang_pred"] != "und" and f["score"] >= P.LANGUAGE_FROM}
    assert set(ids[2]) == {r["component_id"] for r in simhash.with_components(clear).collect()} and max(ids[2].values()) == 1
    assert ids[3] == Counter({r["doc_id"]: len(r["shards"]) for r in mixing.mix(single).collect() if r["shards"]})
    assert ids[4] == ids[3]
    texts = {r["doc_id"]: r["text"] for r in start.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed.collect())
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in P.run(spark, SF).collect()) == Counter((r["doc_id"], r["ids_sha256"]) for r in coded.collect())


@pytest.mark.parametrize("at", range(len(P.STAGES)))
def test_stage_edge_cases(spark, edge_docs, no_docs, at):
    name, stage = P.STAGES[at]
    out = stage(spark, edge_docs, SF)
    kept = {r["doc_id"] for r in out.collect()}
    assert kept <= {r["doc_id"] for r in edge_docs.collect()}
    if name != "bpe":
        assert out.columns == edge_docs.columns
    assert stage(spark, no_docs, SF).count() == 0


def test_unlearned_scripts_go_whatever_the_corpus_shares(spark):
    """With 95 % of one language, Greek and Japanese texts go and clear texts of all learned languages stay."""

    words = {"en": "the house and the garden are with them here", "de": "das haus und der garten sind mit ihnen hier", "fr": "la maison et le jardin sont avec eux ici"}
    rows = [(i, " ".join([words["en"]] * 3) + f" {i}", "en") for i in range(380)] + [(400 + i, " ".join([words["de"], words["fr"]][i % 2 : i % 2 + 1] * 3), ["de", "fr"][i % 2]) for i in range(20)]
    odd = [(500, "Η γλώσσα είναι ένα σύστημα επικοινωνίας των ανθρώπων " * 20, None), (501, "これは日本語の文章です。言語は人間の" * 20, None)]
    docs = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in rows + odd], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in P.drop_unclear_language(spark, docs, SF).collect()}
    assert kept == {i for i, _, _ in rows}
