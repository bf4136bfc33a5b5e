"""Token counts by finite-state tokenizer compilation.

A byte-level BPE vocabulary becomes two deterministic transducers.

The *splitter* reads characters and says before which of them a new piece of the
pre-tokenizer starts. It has eight states, so a chunk of text is a map from states
to states. The chunks of a whole batch of texts are read side by side, their maps
compose through a parallel prefix scan, and the scan tells the state in which each
chunk is entered; a second sweep then marks the cuts. No chunk waits for another,
however long its text.

The *counter* reads the bytes of a piece. After each byte the library's encoding of
the bytes so far ends in exactly one token: the one whose pair with the last token
before it stays as it is when both are merged. A state holds what later bytes can
ask for: for every position from which a token may still reach further, its place
in the vocabulary's trie, the last token before it and how many tokens fewer there
were. A transition is annotated with the tokens it emits (negative when a longer
token swallows some), so the sum along a piece is its count and no token is ever
made. States are compiled when a text first needs them; each worker remembers a
bounded number of states and of pieces and starts anew when it is full.

Defined cases: a null text counts as the empty text, which has no tokens; a special
token's string counts as one token, and texts beside it are pieces of their own, as
the tokenizers library does by default; texts are read whole. Rows are independent,
so repeated rows repeat their result; an empty table gives no rows; other columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bpe import NEWER, byte_alphabet

#: Symbols the splitter reads: letter, number, other; an apostrophe that can open a contraction of
#: two or of three characters; a space or other white space before a character that is none; white
#: space before white space or an end; an end (also a special token's string).
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, WHITE, RUN, END = range(9)
#: States of the splitter: before anything; inside letters, numbers, others; after a space that the
#: next character joins; inside white space; one or two characters before a contraction's end.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = 8
#: The contractions of the pre-tokenizer, by length.
CONTRACTIONS = {SHORT: ("s", "t", "m", "d"), LONG: ("re", "ve", "ll")}
#: Characters of a chunk; characters of texts that are taken together; states and pieces remembered.
CHUNK = 64
TOGETHER = 2_000_000
MOST_STATES = 120_000
MOST_PIECES = 300_000
NEVER = 1 << 60


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cut before the character) of every state and symbol."""

    after = np.zeros((STATES, 9), dtype=np.uint8)
    cut = np.ones((STATES, 9), dtype=bool)
    after[:] = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_MORE, TWO_MORE, JOINING, FRESH, IN_WHITE, FRESH]
    for state, symbols in {IN_LETTERS: (LETTER,), IN_NUMBERS: (NUMBER,), IN_WHITE: (RUN,), IN_OTHERS: (OTHER, SHORT, LONG), JOINING: (LETTER, NUMBER, OTHER, SHORT, LONG)}.items():
        cut[state, symbols] = False
    for state in (IN_OTHERS, JOINING):  # an apostrophe inside a run opens nothing
        after[state, [SHORT, LONG]] = IN_OTHERS
    after[ONE_MORE, :END], after[TWO_MORE, :END] = FRESH, ONE_MORE
    cut[[ONE_MORE, TWO_MORE], :END] = False
    return after, cut


AFTER, CUT = splitter()


def chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """The state after each chunk (a row of ``symbols``) for every state before it."""

    maps = np.tile(np.arange(STATES, dtype=np.uint8), (len(symbols), 1))
    flat = AFTER.ravel()
    for column in symbols.T:
        maps = flat[maps * np.uint8(9) + column[:, None]]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """The composition of each map with all maps before it, in log2(n) rounds."""

    reach = 1
    while reach < len(maps):
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    return maps


def cuts(symbols: np.ndarray) -> np.ndarray:
    """Where pieces start, given the symbols of a batch of texts."""

    n = len(symbols)
    chunks = np.full((-(-n // CHUNK), CHUNK), END, dtype=np.uint8)
    chunks.ravel()[:n] = symbols
    state = np.full(len(chunks), FRESH, dtype=np.uint8)
    state[1:] = prefix_scan(chunk_maps(chunks))[:-1, FRESH]
    at = np.empty(chunks.shape, dtype=bool)
    after, cut = AFTER.ravel(), CUT.ravel()
    for j in range(CHUNK):
        key = state * np.uint8(9) + chunks[:, j]
        at[:, j] = cut[key]
        state = after[key]
    return np.flatnonzero(at.ravel()[:n])


class Compiled:
    """The transducers of one vocabulary file (its content, as bytes)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        vocab, added = spec["model"]["vocab"], spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that take text beside them cannot be compiled")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._compile_merges(vocab, spec["model"]["merges"])
        self._compile_trie({i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)})
        self.kind = self._kinds()
        self.pieces: dict[str, int] = {}
        self._restart()

    def _compile_merges(self, vocab: dict[str, int], merges: list) -> None:
        """For every token the parts that lie at its two ends while it is built, each
        with the rank of the merge that ends it."""

        self.merge: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if made in parts or any(p in parts and parts[p][2] > rank for p in (left, right)):
                raise ValueError("each token must be made by one merge, after its parts")
            self.merge[left, right], parts[made] = rank, (left, right, rank)
        self.left_ends: dict[int, list[tuple[int, int]]] = {}
        self.right_ends: dict[int, list[tuple[int, int]]] = {}
        for ends, side in ((self.left_ends, 0), (self.right_ends, 1)):
            for token in vocab.values():
                chain, part, until = [], token, NEVER
                while True:
                    chain.append((part, until))
                    if part not in parts:
                        break
                    until = parts[part][2]
                    part = parts[part][side]
                ends[token] = chain
        self.sound: set[int] = set()  # tokens that their own bytes encode to
        for token in sorted(vocab.values(), key=lambda t: parts[t][2] if t in parts else -1):
            if token not in parts or parts[token][0] in self.sound and parts[token][1] in self.sound and self._stays(*parts[token]):
                self.sound.add(token)

    def _stays(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge earlier than ``before`` reaches over the border of a and b.
        A merge of equal rank to the right of the border comes later, one to its left earlier."""

        merge = self.merge.get
        for x, x_until in self.right_ends[a]:
            for y, y_until in self.left_ends[b]:
                rank = merge((x, y))
                if rank is not None and rank < before and rank < x_until and rank <= y_until:
                    return False
        return True

    def _compile_trie(self, raw: dict[int, bytes]) -> None:
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, data in raw.items():
            node = 0
            for byte in data:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[key]
            if token in self.sound:
                self.token_at[node] = token
        self.inner = {key >> 8 for key in self.child}

    @staticmethod
    def _kinds() -> np.ndarray:
        """LETTER, NUMBER, OTHER or WHITE of every code point, by the pre-tokenizer's tables."""

        points = np.arange(0x110000, dtype=np.uint32)
        points[0xD800:0xE000] = 0xFFFD
        every = points.tobytes().decode("utf-32-le")
        kind = np.full(0x110000, OTHER, dtype=np.uint8)
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (f"[{NEWER}]+", OTHER), (r"\s+", WHITE)):
            for found in regex.finditer(pattern, every):
                kind[found.start() : found.end()] = value
        kind[0xD800:0xE000] = OTHER
        return kind

    def _restart(self, at: tuple = ((0, -1, 0),)) -> int:
        """Forget all states but the first and ``at``, and give the number of the latter."""

        self.states = list(dict.fromkeys((((0, -1, 0),), at)))
        self.numbers, self.steps = {state: i for i, state in enumerate(self.states)}, {}
        self.held: dict[tuple[int, int], bool] = {}
        return self.numbers[at]

    def _step(self, number: int, byte: int) -> tuple[int, int]:
        """Compile one transition: (next state, tokens emitted)."""

        live, emitted, last_token = [], None, -1
        for node, last, fewer in self.states[number]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and emitted is None:
                if last >= 0:
                    stays = self.held.get((last, token))
                    if stays is None:
                        stays = self.held[last, token] = self._stays(last, token)
                if last < 0 or stays:
                    emitted, last_token = fewer + 1, token
            if node in self.inner:
                live.append((node, last, fewer))
        state = (*((node, last, fewer - emitted) for node, last, fewer in live), (0, last_token, 0))
        following = self.numbers.get(state)
        if following is None:
            following = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.steps[number << 8 | byte] = found = (following, emitted)
        return found

    def count_piece(self, data: bytes) -> int:
        """The number of tokens of one piece: the annotations along its path, summed."""

        state, total = 0, 0
        for start in range(0, len(data), MOST_STATES):
            if len(self.states) > MOST_STATES:
                state = self._restart(self.states[state])
            steps = self.steps.get
            for byte in data[start : start + MOST_STATES]:
                state, emitted = steps(state << 8 | byte) or self._step(state, byte)
                total += emitted
        return total

    def symbols(self, joined: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what the splitter reads, where special tokens start) of texts joined with
        one character at each of ``ends``."""

        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        end = np.zeros(len(points) + 2, dtype=bool)
        end[ends], end[-2:] = True, True
        special = [m.span() for m in self.at_special.finditer(joined)] if self.at_special else []
        for i, j in special:
            end[i:j] = True
        points[end[:-2]] = 0
        kind = np.append(self.kind[points], [END, END]).astype(np.uint8)
        kind[end] = END
        quote = np.flatnonzero(points == ord("'"))
        white = np.flatnonzero(kind == WHITE)
        following = kind[white + 1]
        plain = (following != WHITE) & (following != END)
        kind[white] = np.where(plain, np.where(points[white] == ord(" "), SPACE, WHITE), RUN)
        if len(quote):
            one, two = (np.append(points, [0, 0])[quote + i] for i in (1, 2))
            for symbol, endings in CONTRACTIONS.items():
                for tail in endings:
                    opens = (one == ord(tail[0])) & (two == ord(tail[1]) if len(tail) > 1 else True)
                    kind[quote[opens]] = symbol
        return kind[:-2], np.array([i for i, _ in special], dtype=np.int64)

    def count_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The token counts of whole texts, some texts at a time."""

        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= TOGETHER:
                yield self._count_held(held)
                held, chars = [], 0
        if held:
            yield self._count_held(held)

    def _count_held(self, texts: list[str]) -> np.ndarray:
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        symbols, special = self.symbols(joined, ends)
        at = cuts(symbols)
        stop = np.append(at[1:], len(joined))
        real = symbols[at] != END
        at, stop = at[real], stop[real]
        pieces = [joined[i:j] for i, j in zip(at.tolist(), stop.tolist())]
        if len(self.pieces) > MOST_PIECES:
            self.pieces = {}
        for piece in set(pieces).difference(self.pieces):
            self.pieces[piece] = self.count_piece(piece.encode("utf-8", "surrogatepass"))
        each = np.fromiter(map(self.pieces.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        counts = np.bincount(np.searchsorted(ends, at), weights=each, minlength=len(texts))
        return counts.astype(np.int64) + np.bincount(np.searchsorted(ends, special), minlength=len(texts))


_COMPILED: dict[bytes, Compiled] = {}


def compiled(content: bytes) -> Compiled:
    """The transducers of a vocabulary, compiled once in each Python worker."""

    key = hashlib.sha256(content).digest()
    if key not in _COMPILED:
        _COMPILED[key] = Compiled(content)
    return _COMPILED[key]


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Add ``into``: the number of tokens of every whole text (long)."""

    with open(path, "rb") as f:
        content = f.read()
    if len(content) > 256 << 20:
        raise ValueError(f"{path}: not a vocabulary file")
    vocabulary = docs.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        counts = list(compiled(vocabulary.value).count_many(texts))
        return pd.Series(np.concatenate(counts) if counts else np.zeros(0, np.int64))

    return docs.withColumn(into, run(F.col(text).cast("string")))
