"""Token counts, token alignment and hard negatives: equal to the libraries, to plain twins and to SQL."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import align, hardneg, tokencount
from cohortlens.llm.queries import ORACLES, PIECE_MODEL, QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECE_MODEL)
ODD = [
    "", "a", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 4000 + "y" * 3000, "abc" * 2000 + "é" * 999, "  \n\n  hi", " " * 3000,
    "'s'll're don't", "　\x85 x", "𒑏 a𐥀1 ꟎", "''s 's 've'r 'l", "\n's", "  's\n", "a'<|endoftext|>s", "a \0 b\0", "-" * 500, "aaaa" * 300, "<0x0A> ▁x </s>", " " * 30000 + "b",
]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    wild = ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x7FF), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x3FFFF)])) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return wild + ["".join(rng.choice("aabe tns'rlvm \n1-.") for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(A)


@pytest.fixture(scope="module")
def counter():
    with open(A, "rb") as f:
        return tokencount.Compiled(f.read())


def test_counts_equal_library(counter, library):
    texts = ODD + random_texts(600)
    assert np.concatenate(list(counter.count_many(texts))).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_scan_equals_one_state_after_the_other():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 9, n).astype(np.uint8)
        state, want = tokencount.FRESH, []
        for i, s in enumerate(symbols):
            if tokencount.CUT[state, s]:
                want.append(i)
            state = tokencount.AFTER[state, s]
        assert tokencount.cuts(symbols).tolist() == want


def test_forgotten_states_change_nothing(counter, monkeypatch):
    texts = [t for t in random_texts(40, 9)] + ["qwertyuiop" * 300]
    want = np.concatenate(list(counter.count_many(texts))).tolist()
    monkeypatch.setattr(tokencount, "MOST_STATES", 50)
    monkeypatch.setattr(tokencount, "MOST_PIECES", 10)
    counter.pieces = {}
    got = [int(n) for t in texts for n in np.concatenate(list(counter.count_many([t])))]
    assert got == want


def test_counts_of_other_vocabularies_are_refused():
    spec = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b", "a b"]}, "added_tokens": []}
    with pytest.raises(ValueError):
        tokencount.Compiled(json.dumps(spec).encode())


def test_count_frames(edge_docs, no_docs, library):
    got = tokencount.count_tokens(edge_docs, A, into="n_").select("text", "n_").collect()
    assert len(got) == edge_docs.count()
    assert all(r["n_"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in got)
    assert tokencount.count_tokens(no_docs, A).count() == 0


class PlainAlignment:
    """Every pair of tokens of a text is compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = align.byte_alphabet()
        self.a_bytes = {i: bytes(shown[c] for c in t) for t, i in json.load(open(A))["model"]["vocab"].items() if all(c in shown for c in t)}

    def spans(self, ids, data):
        at, out = 0, []
        for i, d in zip(ids, data):
            out.append((i, at, at + len(d)))
            at += len(d)
        return out

    def __call__(self, text):
        """(a spans, b spans, links, groups)"""

        if not text:
            return [], [], [], ""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        names = [self.b.id_to_piece(i) for i in b]
        a_data = [self.a_bytes[i] for i in a]
        b_data = [bytes([int(n[3:5], 16)]) if len(n) == 6 and n.startswith("<0x") else n.replace("▁", " ").encode() for n in names]
        if not b"".join(a_data) == b"".join(b_data) == (" " + text).encode():
            return [], [], [], ""
        a, b = self.spans(a, a_data), self.spans(b, b_data)
        links = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if max(x[1], y[1]) < min(x[2], y[2])]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(x[0]) for x in side if low < x[2] <= high) for side in (a, b)))
        return a, b, links, ";".join(groups)


@pytest.fixture(scope="module")
def plain():
    return PlainAlignment()


def twin(plain, docs):
    """op13's rows, by brute force."""

    found = [(doc_id, *plain(text)) for doc_id, text in docs]
    held = Counter()
    for _, a, b, links, _ in found:
        held.update({(a[i][0], b[j][0]) for i, j in links})
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    rows = []
    for doc_id, a, b, links, groups in found:
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        n_best, total = sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs)
        rows.append((doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), n_best, total, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(rows, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_all_pairs(spark, plain, monkeypatch):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text")).collect()
    docs = [(r["doc_id"], r["text"]) for r in rows] + [(10_000 + i, t) for i, t in enumerate([t[:500] for t in ODD] + random_texts(60))] + [(None, "same row"), (None, "same row"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = align.link_statistics(df, A, B)
    assert got.columns == COLUMNS
    assert sorted([tuple(r) for r in got.collect()], key=str) == twin(plain, docs)


def test_alignment_of_whole_documents(spark, plain):
    """The query's tokens and groups of whole texts, and the hot-key join of its counts."""

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:120]:
        a, b, links, groups = plain(texts[i])
        assert (got[i]["n_a"], got[i]["n_b"], got[i]["n_links"]) == (len(a), len(b), len(links))
        assert got[i]["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_a_batch_is_aligned_by_the_tokens_of_its_bytes(plain):
    """Texts without tokens (null, empty, changed by side B) lie between others; ids come as arrays."""

    aligner = align.Aligner(open(A, "rb").read(), open(B, "rb").read())
    texts = ["plain words, and numbers 12345", None, "full\uff21width", "", "naïve café", "\u2581", "日本語 text", "x"]
    assert all(isinstance(ids, np.ndarray) for ids in aligner.a.encode([" " + (t or "") for t in texts]))
    x = aligner.align(texts)
    for side in (x.a, x.b):
        assert side.of_bytes().tolist() == [i for i, (low, high) in enumerate(zip(side.start, side.end)) for _ in range(low, high)]
    assert aligner.group_texts(x) == [plain(t)[3].encode() for t in texts]
    assert x.docs == len(texts) and sorted(set(x.a.doc)) == [i for i, t in enumerate(texts) if plain(t)[0]] != list(range(len(texts)))
    first_a, first_b = (np.searchsorted(side.doc, np.arange(x.docs)) for side in (x.a, x.b))
    found = sorted((x.a.doc[i], i - first_a[x.a.doc[i]], j - first_b[x.b.doc[j]]) for i, j in zip(x.link_a, x.link_b))
    assert found == [(d, i, j) for d, t in enumerate(texts) for i, j in plain(t)[2]]


def test_alignment_spans(edge_docs, no_docs, plain):
    out = align.align_texts(edge_docs, A, B, into="spans_").select("text", "spans_").collect()
    assert len(out) == edge_docs.count()
    for r in out:
        if len(r["text"] or "") > 2000:
            continue
        a, b, links, _ = plain(r["text"])
        s = r["spans_"]
        assert list(zip(s["a"], s["a_ends"])) == [(x[0], x[2]) for x in a]
        assert list(zip(s["b"], s["b_ends"])) == [(x[0], x[2]) for x in b]
        assert list(zip(s["link_a"], s["link_b"])) == links
        assert s["group_ends"] == sorted({x[2] for x in a} & {x[2] for x in b})
    assert align.align_texts(no_docs, A, B).count() == 0
    assert align.link_statistics(no_docs, A, B).count() == 0
    assert align.link_statistics(edge_docs, A, B).count() == edge_docs.count()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_hard_negatives_query(spark, parity):
    assert parity(QUERIES["op11_hard_negatives"](spark, SF), ORACLES["op11_hard_negatives"], embeddings=f"{SF}/embeddings.parquet") > 0


def test_hard_negatives_edge_cases(spark, parity, tmp_path):
    """Nulls, copies of one vector on a third of the rows, ties, zero and short vectors, repeated ids."""

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 1.0, 0.0], i % 3) for i in range(300, 450)]
    rows += [(450, None, 1), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (550, [float("nan")] * 6, 1), (600, [1.0] * 6, None), (None, [1.0] * 6, 1), (650, [0.0] * 6, 2), (700, [1.0, 2.0], 2), (750, [], 1), (50, [1.0] * 6, 0), (50, [1.0] * 6, 0)]
    table = vectors(spark, rows).withColumn("score", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("v", F.lit(2))
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert parity(QUERIES["op11_hard_negatives"](spark, str(tmp_path)), ORACLES["op11_hard_negatives"], embeddings=f"{tmp_path}/embeddings.parquet/*.parquet") > 100


def test_hard_negatives_of_few_rows(spark):
    def mined(rows):
        v = hardneg.labelled_vectors(vectors(spark, rows))
        return [tuple(r) for r in hardneg.mine(v, v.filter("vec_id % 50 = 0")).collect()]

    assert mined([]) == []
    assert mined([(0, [1.0], 1)]) == []
    assert mined([(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined([(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.99], 2)]) == [(0, 1, 1, 2, 65536, 32768)]
    # A negative positive score has an empty window, and large scores are still exact.
    assert mined([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]) == []
    big = float(2**22)
    assert mined([(0, [big], 1), (1, [big], 1), (2, [big * 0.75], 2)]) == [(0, 1, 1, 2, 2**60, 3 * 2**58)]
    with pytest.raises(Exception, match="do not fit a long"):
        mined([(0, [big * 1024], 1), (1, [big * 1024], 1)])


def test_bounds_hold_and_skip():
    """Every score lies in its interval; rows near one direction are skipped for anchors near another."""

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 16)) * 300
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(800, 16)) * 15)
    references = hardneg.directions(x[::10])
    norm, angle = hardneg.angles_to(x, references)
    least, most = hardneg.score_bounds(norm, angle, norm, angle)
    exact = x @ x.T
    assert (least <= exact).all() and (exact <= most).all()
    window = exact.diagonal() * 0.8
    assert (most < window[:, None]).mean() > 0.5
    for c in range(len(references)):
        first, last = hardneg.angle_window(norm, angle[:, c], window, exact.diagonal() * 1.2, norm.min(), norm.max())
        fits = (exact >= window[:, None]) & (exact <= exact.diagonal()[:, None] * 1.2)
        inside = (angle[None, :, c] >= first[:, None]) & (angle[None, :, c] <= last[:, None])
        assert not (fits & ~inside).any()
