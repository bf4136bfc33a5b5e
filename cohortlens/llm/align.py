"""Alignment of two tokenizers' tokens over the same bytes.

Side A is a byte-level BPE, side B a sentencepiece model that adds the space before a
text, so A reads the text with that space. A batch of whole texts is one run of bytes,
in which both sides' tokens lie without gaps, so each side has a table that names every
byte's token. It gives for each token start the other side's covering token: once from
A to B, once from B to A. Of two tokens that overlap, the one that starts later starts
inside the other, so the union of both directions is all overlapping pairs; where both
start together they are found twice and kept once.
Bytes at which tokens of both sides end cut the tokens into groups.

How many documents of the corpus hold a pair of ids linked is counted by batch first:
a batch sends one row for each pair it holds, however many documents and links it has,
and gets the corpus's counts back for just these. Documents carry their links as
numbers of their batch's pairs. A batch is bounded in characters (one text at least),
and a pair that nearly all batches hold is joined by broadcast of few hot pairs.

Defined cases: a text that is null or empty, or whose joined tokens of either side
differ from space and text, has no tokens, links or groups, and counts in no pair;
special tokens' strings are plain text; texts are read whole. Every row is a document
of its own, also under a null or repeated id. An empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.bpe import PIECES, ForcedCutBpe, byte_alphabet
from cohortlens.llm.common import join_skewed, save

#: Characters of texts that are taken together.
TOGETHER = 2_000_000
#: The pattern matcher of side A's library cannot hold longer runs of white space.
LONG_RUN = regex.compile(r"\s{20000}")
#: No token of a sentencepiece model has this id, and a pair of ids fits a long.
B_IDS = 1 << 31


class ByteLevel:
    """Side A: a byte-level BPE vocabulary file (its content, as bytes) whose ids follow its merges."""

    def __init__(self, content: bytes):
        import tiktoken

        spec, alphabet = json.loads(content), byte_alphabet()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level vocabulary in the order of its merges")
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.bytes[i] = data
        self.library = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.other = {**spec, "added_tokens": []}, None

    def encode(self, texts: list[str]) -> list:
        return [self._long(t) if len(t) >= 20000 and LONG_RUN.search(t) else self.library.encode_to_numpy(t, disallowed_special=()) for t in texts]

    def _long(self, text: str) -> list[int]:
        if self.other is None:
            self.other = ForcedCutBpe(json.dumps(self.plain).encode())
        return self.other.encode(text).tolist()


class Pieces:
    """Side B: a sentencepiece model file (its content, as bytes)."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        every = range(self.library.get_piece_size())
        names = [self.library.id_to_piece(i) for i in every]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(every, names)]

    def encode(self, texts: list[str]) -> list:
        return self.library.encode(texts, num_threads=1)


@dataclass
class Side:
    """The tokens of one side in a batch, in order."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray  # first byte, counted over the batch
    end: np.ndarray

    def of_bytes(self) -> np.ndarray:
        """The token of each byte of the batch."""

        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.end - self.start)


@dataclass
class Aligned:
    """The alignment of a batch of texts."""

    docs: int
    a: Side
    b: Side
    link_a: np.ndarray  # token numbers of each link
    link_b: np.ndarray
    group_a: np.ndarray  # group number of each token
    group_b: np.ndarray
    group_doc: np.ndarray
    group_end: np.ndarray


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.sizes = [np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        self.bytes = []
        for side in (self.a, self.b):
            self.bytes.append(np.empty(len(side.bytes), dtype=object))
            self.bytes[-1][:] = side.bytes
        widest = len(str(max(len(self.a.bytes), len(self.b.bytes))))
        shown = [str(i).encode() for i in range(max(len(self.a.bytes), len(self.b.bytes)))]
        self.digits = np.array(shown, dtype=f"S{widest + 1}").view(np.uint8).reshape(len(shown), widest + 1)
        self.length = np.array([len(x) for x in shown], dtype=np.uint8)

    def align(self, texts: list[str | None]) -> Aligned:
        spaced = [" " + t if t else "" for t in texts]
        raw = [t.encode() for t in spaced]
        whole, found = np.array([len(r) > 0 for r in raw], dtype=bool), []
        for ids, tokens in ((self.a.encode(spaced), self.bytes[0]), (self.b.encode([t or "" for t in texts]), self.bytes[1])):
            each = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
            stops = np.cumsum(each).tolist()
            joined, start = tokens[flat].tolist(), 0
            for i, (data, stop) in enumerate(zip(raw, stops)):
                if b"".join(joined[start:stop]) != data:
                    whole[i] = False
                start = stop
            found.append((flat, each))
        sides = []
        for (flat, each), sizes in zip(found, self.sizes):
            doc = np.repeat(np.arange(len(each)), each)
            if not whole.all():
                held = whole[doc]
                flat, doc = flat[held], doc[held]
            size = sizes[flat]
            end = np.cumsum(size)
            sides.append(Side(flat, doc, end - size, end))
        left, right = sides
        if not len(left.ids):
            none = np.zeros(0, np.int64)
            return Aligned(len(texts), left, right, none, none, none, none, none, none)
        a_at, b_at = left.of_bytes(), right.of_bytes()
        covering_b, covering_a = b_at[left.start], a_at[right.start]
        only = np.flatnonzero(left.start[covering_a] != right.start)  # the other links are found from A already
        link_a = np.concatenate([np.arange(len(left.ids)), covering_a[only]])
        link_b = np.concatenate([covering_b, only])
        # Tokens that end where one of the other side does.
        last_a, last_b = right.end[b_at[left.end - 1]] == left.end, left.end[a_at[right.end - 1]] == right.end
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        return Aligned(len(texts), left, right, link_a, link_b, group_a, group_b, left.doc[last_a], left.end[last_a])

    def group_texts(self, x: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of its groups."""

        n = len(x.a.ids) + len(x.b.ids)
        if not n:
            return [b""] * x.docs
        upto_a, in_b = np.cumsum(np.bincount(x.group_a)), np.bincount(x.group_b)
        at_a = np.arange(len(x.a.ids)) + (np.cumsum(in_b) - in_b)[x.group_a]
        at_b = np.arange(len(x.b.ids)) + upto_a[x.group_b]
        ids, mark, sizes = np.empty(n, np.int64), np.empty(n, np.uint8), np.zeros(x.docs)
        for at, side, group, last in ((at_a, x.a, x.group_a, b"|"), (at_b, x.b, x.group_b, b";")):
            ids[at] = side.ids
            sizes += np.bincount(side.doc, weights=self.length[side.ids], minlength=x.docs) + np.bincount(side.doc, minlength=x.docs)
            mark[at] = np.where(np.append(group[1:] == group[:-1], False), ord(","), ord(last))
        shown, length = self.digits[ids], self.length[ids]
        shown[np.arange(n), length] = mark
        sizes = sizes.astype(np.int64)
        stops = np.cumsum(sizes)
        flat = shown[np.arange(shown.shape[1], dtype=np.uint8) <= length[:, None]].tobytes()
        return [flat[i : max(i, j - 1)] for i, j in zip((stops - sizes).tolist(), stops.tolist())]


_READY: dict[str, Aligner] = {}


def _files(docs: DataFrame, a_path: str, b_path: str) -> Callable[[], Aligner]:
    """Both vocabulary files as a broadcast (their size is not that of the data), and the
    worker's aligner made of them."""

    contents = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            contents.append(f.read())
        if len(contents[-1]) > 256 << 20:
            raise ValueError(f"{path}: not a vocabulary file")
    key = hashlib.sha256(b"\0".join(contents)).hexdigest()
    held = docs.sparkSession.sparkContext.broadcast(contents)

    def ready() -> Aligner:
        if key not in _READY:
            _READY[key] = Aligner(*held.value)
        return _READY[key]

    return ready


def _batches(texts: list[str | None]) -> Iterator[slice]:
    """Slices of about TOGETHER characters."""

    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= TOGETHER:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _lists(values: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """``values`` (in the order of ``doc``) as one list of ints for each document."""

    offsets = np.searchsorted(doc, np.arange(docs + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


ALIGNMENT = "struct<a:array<int>,a_ends:array<int>,b:array<int>,b_ends:array<int>,link_a:array<int>,link_b:array<int>,group_ends:array<int>>"


def align_texts(docs: DataFrame, a_path: str, b_path: str, text: str = "text", into: str = "alignment") -> DataFrame:
    """Add ``into``: both sides' ids and the bytes at which they end, the links as
    token numbers of both sides (from 0), and the bytes at which groups end."""

    ready = _files(docs, a_path, b_path)

    @F.pandas_udf(ALIGNMENT)
    def run(texts: pd.Series) -> pd.DataFrame:
        parts, texts = [], texts.tolist()
        for some in _batches(texts):
            x = ready().align(texts[some])
            base = np.zeros(x.docs, np.int64)
            np.maximum.at(base, x.a.doc, x.a.end)
            base = np.concatenate([[0], np.maximum.accumulate(base)[:-1]])
            order = np.lexsort((x.link_b, x.link_a))
            doc = x.a.doc[x.link_a[order]]
            first_a, first_b = (np.searchsorted(side.doc, np.arange(x.docs)) for side in (x.a, x.b))
            columns = {
                "a": (x.a.ids, x.a.doc), "a_ends": (x.a.end - base[x.a.doc], x.a.doc), "b": (x.b.ids, x.b.doc), "b_ends": (x.b.end - base[x.b.doc], x.b.doc),
                "link_a": (x.link_a[order] - first_a[doc], doc), "link_b": (x.link_b[order] - first_b[doc], doc), "group_ends": (x.group_end - base[x.group_doc], x.group_doc),
            }
            parts.append(pd.DataFrame({c: [v.astype(np.int32) for v in np.split(values, np.searchsorted(at, np.arange(1, x.docs)))] for c, (values, at) in columns.items()}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in ("a", "a_ends", "b", "b_ends", "link_a", "link_b", "group_ends")})

    return docs.withColumn(into, run(F.col(text).cast("string")))


#: A document's row (``pairs``: numbers of its batch's pairs, ``times``: links of each), or a pair's (``pair`` is not null).
ROWS = "batch bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>, pair bigint, slot int, docs bigint"


def _rows(ready: Callable[[], Aligner]) -> Callable:
    names = [f.split()[0] for f in ROWS.split(", ")]

    def record(columns: dict, n: int) -> pa.RecordBatch:
        types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        kinds = {f.split()[0]: types[f.split()[1]] for f in ROWS.split(", ")}
        arrays = [columns[c].cast(kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names]
        return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(c, kinds[c]) for c in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for some in _batches(texts):
                x = ready().align(texts[some])
                n, number = x.docs, number + 1
                key = x.a.ids[x.link_a] * B_IDS + x.b.ids[x.link_b]
                pairs, slot = np.unique(key, return_inverse=True)
                held, times = np.unique(x.a.doc[x.link_a] * max(len(pairs), 1) + slot, return_counts=True)
                doc, slot = np.divmod(held, max(len(pairs), 1))
                each = lambda doc: pa.array(np.bincount(doc, minlength=n))
                yield record({
                    "batch": pa.array(np.full(n, number)), "doc_id": batch.column("doc_id").slice(some.start, n),
                    "n_a": each(x.a.doc), "n_b": each(x.b.doc), "n_groups": each(x.group_doc), "n_links": each(x.a.doc[x.link_a]),
                    "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in ready().group_texts(x)], pa.string()),
                    "pairs": _lists(slot, doc, n), "times": _lists(times, doc, n),
                }, n)
                yield record({
                    "batch": pa.array(np.full(len(pairs), number)), "pair": pa.array(pairs), "slot": pa.array(np.arange(len(pairs), dtype=np.int32)),
                    "docs": pa.array(np.bincount(slot, minlength=len(pairs))[: len(pairs)]),
                }, len(pairs))

    return run


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best, batches): documents that hold each pair of ids, and whether
    no pair of its A id is held by more. An A id meets at most as many pairs as side B has ids."""

    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"), F.count(F.lit(1)).alias("batches"))
    a = Window.partitionBy(F.floor(F.col("pair") / F.lit(B_IDS)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(a))


def link_statistics(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every
    row of ``docs`` (doc_id, text)."""

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    saved = save(rows.mapInArrow(_rows(_files(docs, a_path, b_path)), ROWS), "align-rows")
    pairs = saved.filter("pair IS NOT NULL").select("batch", "pair", "slot", "docs")
    counts = save(pair_counts(pairs), "align-counts")
    known = join_skewed(pairs.select("batch", "pair", "slot"), counts, "pair", "batches").select(F.col("batch").alias("of"), "slot", "count", "best")
    own = saved.filter("pair IS NULL").drop("pair", "slot", "docs")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def total(batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        count, best = np.zeros((2, len(known)), dtype=np.int64)
        count[known["slot"]], best[known["slot"]] = known["count"], known["best"]
        batch["count_sum"] = [int((count[p] * t).sum()) for p, t in zip(batch["pairs"], batch["times"])]
        batch["n_best"] = [int((best[p] * t).sum()) for p, t in zip(batch["pairs"], batch["times"])]
        batch["doc_id"] = batch["doc_id"].astype("Int64")
        return batch[out]

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return own.groupBy("batch").cogroup(known.groupBy("of")).applyInPandas(total, schema)
