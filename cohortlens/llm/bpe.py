"""Byte-level BPE with forced boundaries.

A byte pair that occurs inside no vocabulary token can never end up inside one,
so wherever it stands in a piece a cut is certain. Each piece of the
pre-tokenizer is cut at such pairs, the fragments are encoded on their own, and
the ids are concatenated; the result equals encoding the whole piece, because no
merge can reach over such a cut. Fragments and pieces repeat heavily, so each
worker remembers a bounded number of them.

Defined cases: a null text encodes as the empty text; an empty text gives no
ids; special-token strings in a text become their own ids, as the tokenizers
library does; a piece of any length is merged with a heap in O(n log n), never
cut short. Rows are independent, so repeated rows repeat their result, and other
columns, whatever their names, pass through untouched.
"""

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import TOGETHER, text_groups

#: How the byte-level pre-tokenizer splits a text (a fixed, public value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that the installed ``regex`` module knows
#: and the pre-tokenizer's older Unicode tables do not; there they are symbols.
NEWER = (
    r"\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    r"\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The same split where such characters occur.
PIECES_NEWER = PIECES.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{NEWER}]|[^\s\p{{L}}\p{{N}}])").replace(r" ?\p{L}+", rf" ?(?:(?![{NEWER}])\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?![{NEWER}])\p{{N}})+")
#: Fragments up to this many bytes are merged side by side in numpy, longer ones one by one with a heap.
SHORT = 48
#: Pieces that a worker remembers in each of two generations.
REMEMBERED = 100_000
NONE = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedCutBpe:
    """Encoder and decoder of one vocabulary file (its content, as bytes)."""

    def __init__(self, content: bytes, remember: int = REMEMBERED):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = {t: bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)}
        top = max([*vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * (top + 1)
        for t, i in vocab.items():
            self.token_bytes[i] = raw.get(t, t.encode())
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.merge: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        order = np.argsort(keys := np.array(list(self.merge), dtype=np.int64))
        self.keys, self.ranks = keys[order], np.array(list(self.merge.values()), dtype=np.int64)[order]
        self.made_ids = np.array(self.made, dtype=np.int64)
        self.byte_ids = np.array(self.byte_id, dtype=np.int64)
        self.inside = np.zeros(65536, dtype=bool)  # true where the pair occurs inside a token
        for t in raw.values():
            b = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
            self.inside[b[:-1] << 8 | b[1:]] = True
        self.find = regex.compile(PIECES).findall
        self.find_newer = regex.compile(PIECES_NEWER).findall
        self.newer = regex.compile(f"[{NEWER}]").search
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.remember = remember
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge ranks of id pairs (NONE: no merge)."""

        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where fragments start in ``data`` (bytes of pieces that start at
        ``starts``): at each piece and at each certain cut."""

        at = np.ones(len(data), dtype=bool)
        pairs = data[:-1].astype(np.int64) << 8 | data[1:]
        at[1:] = ~self.inside[pairs]
        at[starts] = True
        return np.flatnonzero(at)

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece: forced cuts, then fragments merged independently."""

        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        starts = ends - [len(r) for r in raw]
        first = self.cuts(data, starts)
        size = np.diff(np.append(first, len(data)))
        frag = np.repeat(np.arange(len(first)), size)
        short = size <= SHORT
        toks, owners = self._merged_short(self.byte_ids[data[short[frag]]], frag[short[frag]])
        for f in np.flatnonzero(~short):
            ids = self._merged_long(self.byte_ids[data[first[f] : first[f] + size[f]]].tolist())
            toks, owners = np.append(toks, ids), np.append(owners, np.full(len(ids), f))
        order = np.argsort(owners, kind="stable")
        toks, owners = toks[order].tolist(), owners[order]
        piece_of = np.searchsorted(starts, first, side="right") - 1
        stops = np.cumsum(np.bincount(piece_of[owners], minlength=len(pieces))).tolist()
        return [tuple(toks[i:j]) for i, j in zip([0, *stops], stops)]

    def _merged_short(self, ids: np.ndarray, frag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all fragments side by side: in each round every fragment applies
        its lowest-ranked merge, leftmost among equals, until none has one."""

        done_ids, done_frag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rank = np.full(len(ids), NONE)
        if len(ids):
            same = frag[1:] == frag[:-1]
            rank[:-1][same] = self.rank_of(ids[:-1][same], ids[1:][same])
        while len(ids):
            start = np.flatnonzero(np.append(True, frag[1:] != frag[:-1]))
            size = np.diff(np.append(start, len(ids)))
            within = np.arange(len(ids)) - np.repeat(start, size)
            best = np.minimum.reduceat(rank << 6 | within, start)
            live = best >> 6 < NONE
            if not live.all():
                keep = np.repeat(live, size)
                done_ids.append(ids[~keep])
                done_frag.append(frag[~keep])
                ids, frag, rank, size, best = ids[keep], frag[keep], rank[keep], size[live], best[live]
                start = np.cumsum(size) - size
            if not len(ids):
                break
            at = start + (best & 63)
            ids[at] = self.made_ids[best >> 6]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, frag, rank = ids[keep], frag[keep], rank[keep]
            at -= np.arange(len(at))
            for i in (at, at - 1):
                i = i[(i >= 0) & (i + 1 < len(ids))]
                i = i[frag[i] == frag[i + 1]]
                rank[i] = self.rank_of(ids[i], ids[i + 1])
            last = at[(at + 1 == len(ids)) | (frag[np.minimum(at + 1, len(ids) - 1)] != frag[at])]
            rank[last] = NONE
        return np.concatenate(done_ids), np.concatenate(done_frag)

    def _merged_long(self, ids: list[int]) -> list[int]:
        merge, made, n = self.merge, self.made, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := merge.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i] = made[r]
            alive[j] = 0
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (s := merge.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            h = left[i]
            if h >= 0 and (s := merge.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [ids[i] for i in range(n) if alive[i]]

    def pieces(self, text: str) -> list[str]:
        return (self.find if text.isascii() or not self.newer(text) else self.find_newer)(text)

    def encode(self, text: str | None) -> array:
        """The ids of a whole text."""

        return next(self.encode_many([text]))

    def encode_many(self, texts) -> Iterator[array]:
        """The ids of each whole text, some texts at a time."""

        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= TOGETHER:
                yield from self._encode_held(held)
                held, chars = [], 0
        yield from self._encode_held(held)

    def _encode_held(self, texts: list[str]) -> Iterator[array]:
        split = [[p for p in self.at_special.split(t) if p] if self.at_special else [t] for t in texts]
        found = [[[p] if p in self.special else self.pieces(p) for p in parts] for parts in split]
        if len(self.known) > self.remember:
            self.known, self.before = {}, self.known
        new = set().union(*chain.from_iterable(found)).difference(self.known)
        for p in new & self.special.keys():
            self.known[p] = (self.special[p],)
        new -= self.special.keys()
        for p in new & self.before.keys():
            self.known[p] = self.before[p]
        new = list(new - self.before.keys())
        if new:
            self.known.update(zip(new, self.encode_pieces(new)))
        known = self.known.__getitem__
        for parts in found:
            yield array("I", chain.from_iterable(map(known, chain.from_iterable(parts))))

    def forget(self) -> None:
        """Drop the remembered pieces."""

        self.known, self.before = {}, {}

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that form no character become U+FFFD."""

        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_BUILT: dict[bytes, ForcedCutBpe] = {}


def encoder(content: bytes) -> ForcedCutBpe:
    """The encoder of a vocabulary, built once in each Python worker."""

    key = hashlib.sha256(content).digest()
    if key not in _BUILT:
        _BUILT[key] = ForcedCutBpe(content)
    return _BUILT[key]


def _vocabulary(docs: DataFrame, path: str):
    """The vocabulary file as a broadcast: its size is that of the file, not of the data."""

    with open(path, "rb") as f:
        content = f.read()
    if len(content) > 256 << 20:
        raise ValueError(f"{path}: not a vocabulary file")
    return docs.sparkSession.sparkContext.broadcast(content)


def encode_texts(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into``: the ids of every whole text (array of long, as ids are unsigned)."""

    vocabulary = _vocabulary(docs, path)

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(vocabulary.value)
        try:
            for texts in batches:
                yield pd.Series([np.asarray(ids, dtype=np.int64) for ids in bpe.encode_many(texts)], dtype=object)
        finally:
            bpe.forget()

    return docs.withColumn(into, run(F.col(text).cast("string")))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the text that the ids stand for (null ids: the empty text)."""

    vocabulary = _vocabulary(rows, path)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        bpe = encoder(vocabulary.value)
        return pd.Series(["" if x is None else bpe.decode(x) for x in column], dtype=object)

    return rows.withColumn(into, run(F.col(ids)))


DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def round_trip(docs: DataFrame, path: str, text: str = "text", into: str = "digest") -> DataFrame:
    """Add ``into``: number and digest of each text's ids, and the digest of what
    they decode to. One pass: ids and decoded texts never leave the worker."""

    vocabulary = _vocabulary(docs, path)

    @F.arrow_udf(DIGEST)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = encoder(vocabulary.value)
        try:
            for texts in batches:
                sizes, coded, decoded = [], [], []
                for ids in bpe.encode_many(t for group in text_groups(texts) for t in group):
                    sizes.append(len(ids))
                    coded.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                columns = pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())
                yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            bpe.forget()  # the worker goes on to other stages

    return docs.withColumn(into, run(F.col(text).cast("string")))
