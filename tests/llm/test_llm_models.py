"""Language, quality, toxicity and BPE: exact twins, held-out accuracy, edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import bpe, language, quality, toxicity
from cohortlens.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        return bpe.ForcedCutBpe(f.read())


def test_bpe_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "a", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 4000 + "y" * 3000, "abc" * 2000 + "é" * 999, "  \n\n  hi", " " * 3000, "'s'll're don't", "　\x85 x", "𒑏 a𐥀1 ꟎"])
def test_bpe_odd_texts(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(own.encode(text)) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_random_texts(own, library):
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x7FF), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x3FFFF)])) for _ in range(rng.randint(0, 60)))
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_cuts_are_certain(own):
    """No token holds a pair that is cut."""

    for t in own.token_bytes[:-1]:
        data = np.frombuffer(t, dtype=np.uint8)
        assert len(own.cuts(data, np.array([0]))) == 1


def test_bpe_frames(edge_docs, no_docs):
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.decode_ids(bpe.encode_texts(edge_docs, path, into="ids_"), path, "ids_", "back_")
    assert coded.filter("back_ <> coalesce(text, '')").count() == 0
    assert coded.count() == edge_docs.count()
    assert bpe.round_trip(no_docs, path).count() == 0


def plain_language(model, text):
    """The language scores of a text, word by word."""

    names, prior, known, by_length = model
    words = language.WORDS((text or "").lower())
    if not words:
        return "und"
    total = np.zeros(len(names))
    for w in words:
        if w in known:
            total += known[w] - known[w].mean()
            continue
        weight = 1.0
        for n in language.LENGTHS:
            hits = [by_length[n][f"<{w}>"[i : i + n]] for i in range(len(w) + 3 - n) if f"<{w}>"[i : i + n] in by_length[n]]
            if hits:
                mean = np.mean(hits, axis=0)
                total += weight * (mean - mean.mean())
                break
            weight *= language.PENALTY
    return names[int(np.argmax(prior + total * min(1.0, language.FIRM / len(words))))]


def test_language_matches_plain_scoring_and_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language.train(docs)
    got = QUERIES["op3_language_id"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] == plain_language(model, rows[r["doc_id"]]["text"])
        assert 0.0 <= r["score"] <= 1.0
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held]) >= 0.97


def test_language_never_learns_from_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in language.train(changed)[0]


def test_language_edge_cases(edge_docs, no_docs):
    model = language.train(edge_docs)
    found = {r["text"]: (r["f_"]["lang_pred"], r["f_"]["score"]) for r in language.identify_texts(edge_docs, model, into="f_").collect()}
    for text in (None, "", " \t\n ", "12345 !!! 77"):
        assert found[text] == ("und", 0.0)
    assert all(v[0] in model[0] for t, v in found.items() if re.search(r"[^\W\d_]", t or ""))
    assert language.train(no_docs) is None
    assert language.identify_texts(edge_docs, None, into="f_").filter("f_.lang_pred <> 'und'").count() == 0
    assert language.identify_texts(no_docs, model).count() == 0


def area(pairs):
    """The chance that a row of label 1 scores above one of label 0."""

    low, high = [s for s, y in pairs if y == 0], [s for s, y in pairs if y == 1]
    return np.mean([(h > l) + 0.5 * (h == l) for h in high for l in low])


@pytest.mark.parametrize("name,label,bar,least", [("op8_quality", "quality", 0.3, 0.9), ("op9_toxicity", "toxic", 0.5, 0.8)])
def test_classifiers_held_out(spark, name, label, bar, least):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES[name](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= bar)
    assert area([(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_edge_cases(spark, edge_docs, no_docs, module):
    marks = spark.createDataFrame([(i, q, 1 - q) for i, q in [(1, 1), (2, 1), (4, 0), (7, 0), (7, 0), (8, 1), (9, 0), (99, 1)]] + [(None, 1, 1), (10, None, None)], "doc_id bigint, quality int, toxic int")
    model = module.train(edge_docs, marks)
    scored = module.score_texts(edge_docs, model, into="s_").collect()
    assert len(scored) == edge_docs.count() and all(0.0 <= r["s_"] <= 1.0 for r in scored)
    assert len({r["s_"] for r in scored if r["doc_id"] in (1, 2)}) == 1
    again = {(r["doc_id"], r["text"]): r["s_"] for r in module.score_texts(edge_docs.repartition(7), module.train(edge_docs.repartition(5), marks), into="s_").collect()}
    assert all(again[r["doc_id"], r["text"]] == pytest.approx(r["s_"], abs=1e-6) for r in scored)
    assert module.train(no_docs, marks) is None
    assert module.train(edge_docs, marks.limit(0)) is None
    assert module.score_texts(edge_docs, None, into="s_").select("s_").distinct().count() == 1
    assert module.score_texts(no_docs, model).count() == 0


def test_toxicity_scores_are_the_weights_sum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    at, weights, bias, bits = model
    of = dict(zip(at.tolist(), weights.tolist()))
    for r in toxicity.score_texts(docs, model, into="s_").limit(40).collect():
        total = bias + sum(of.get(b, 0.0) for b in set(toxicity.buckets(r["text"], bits).tolist()))
        assert r["s_"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)


def test_quality_scores_are_the_softmax_of_mean_vectors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sums, bias, bits = model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in quality.score_texts(docs, model, into="s_").limit(40).collect():
        at, times = quality.text_features(r["text"], bits)
        out = bias + (sums[at] * times[:, None]).sum(axis=0) / max(times.sum(), 1)
        p = np.exp(out - out.max())
        assert r["s_"] == pytest.approx(p[1] / p.sum(), abs=1e-4)


def test_sample_is_bounded_in_rows(spark):
    """An id on a third of all rows adds one row, whatever its texts; both classifiers learn from such a table."""

    from cohortlens.llm.common import labelled_sample

    rows = [(i if i % 3 else 1, f"text {i} of many words") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(900)], "doc_id bigint, quality int, toxic int")
    got = labelled_sample(docs, labels, "quality", folds=5, rows=200).collect()
    assert len(got) == len({r["id_"] for r in got}) == 200
    every = labelled_sample(docs, labels, "quality", folds=5, rows=5000).collect()
    assert 1 in {r["id_"] for r in every} and len(every) == len({r["id_"] for r in every}) < 601
    assert quality.train(docs, labels, rows=50) is not None and toxicity.train(docs, labels, rows=50) is not None


def peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    run()
    try:
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_is_worked_in_small_groups():
    """Words and pieces of a whole Arrow batch are never held at once, nor a stage's memory after its task."""

    import pyarrow as pa

    from cohortlens.llm.common import TOGETHER, text_groups

    texts = pa.array([None, "", "é" * TOGETHER, *["ab " * 1000, None, ""] * 700])
    groups = list(text_groups(texts))
    assert [t for g in groups for t in g] == [t or "" for t in texts.to_pylist()]
    assert all(sum(len(t.encode()) for t in g[:-1]) < TOGETHER for g in groups)
    assert list(text_groups(texts[:0])) == [] and list(text_groups(pa.array([None, ""]))) == [["", ""]]

    names = ["de", "en"]
    who = language.Identifier(*language.packed((names, np.zeros(2), {"ab": np.array([0.0, 1.0])}, {n: {} for n in language.LENGTHS})))
    batch = pa.array(["ab cd " * 500] * 1300)
    assert peak_mb(lambda: [who.identify(g) for g in text_groups(batch)]) < 20


def test_workers_forget(own, monkeypatch):
    """What a worker remembers is bounded, and results do not hang on it."""

    model = (["de", "en"], np.zeros(2), {"x": np.array([0.0, 1.0])}, {n: {"a" * n: np.array([1.0, 0.0])} for n in language.LENGTHS})
    packed = language.packed(model)
    monkeypatch.setattr(language, "REMEMBERED", 100)
    texts = [" ".join("a" * (i % 7 + 1) + chr(98 + j) * (i % 50 + 1) for j in range(20)) for i in range(300)]
    who, fresh = language.Identifier(*packed), language.Identifier(*packed)
    for t in texts:
        assert who.identify([t]) == language.Identifier(*packed).identify([t])
        assert len(who.place) <= 1 + 100 + 20
    assert fresh.identify(texts) == [language.Identifier(*packed).identify([t])[0] for t in texts]

    ids = [list(x) for x in own.encode_many(texts)]
    own.forget()
    assert not own.known and not own.before and [list(x) for x in own.encode_many(texts)] == ids


def test_stages_leave_nothing_in_the_worker(spark):
    """After a stage its Python worker holds neither remembered pieces nor word hashes."""

    path = public_tokenizers.path(VOCABULARY)
    docs = spark.createDataFrame([(i, f"some words {i} here") for i in range(50)], "doc_id bigint, text string").coalesce(1)
    model = (np.array([1], dtype=np.int32), np.array([0.5], dtype=np.float32), 0.0, 20)
    assert toxicity.score_texts(bpe.round_trip(docs, path), model).count() == 50

    def left(batches):
        for batch in batches:
            held = len(toxicity.HASHES) + sum(len(e.known) + len(e.before) for e in bpe._BUILT.values())
            yield batch.assign(held=held)[["held"]]

    toxicity.score_texts(docs, model, into="s_").collect()
    bpe.round_trip(docs, path, into="d_").collect()
    assert {r["held"] for r in docs.mapInPandas(left, "held bigint").collect()} == {0}
