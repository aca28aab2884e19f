"""Byte-level BPE encoding and decoding: longest matches, backtracking over token pairs that can stand side by side."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import held

# Entries of a worker's memories of pieces and of pairs, which are emptied beyond them. Results do not depend on it.
MEMORY = 400_000
PAIRS = 150_000
# Rows worked on and handed back to Spark together.
ROWS = 256

# Fixed value: the pattern that `split` has in array form; any other one is left to the regex module.
WORDS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTER, _NUMBER, _SPACE = 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point, as the regex module sees it."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "-" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for name, mark in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(name, every):
            table[m.start():m.end()] = mark
    return table


def split(texts: list[str]) -> tuple[list[str], list[int]]:
    """The matches of WORDS_PATTERN in all texts, one after another, and where each text's begin and end in that list.

    A match is a run of one class; a single blank goes with the run after it, white space before a run gives up its
    last character, and an apostrophe that begins a match takes the ending after it.
    """
    whole = "".join(texts)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    if not whole:
        return [], [0] * len(bounds)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = _classes()[codes]
    n = len(kind)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last of a space run that a text goes on after
    last = space & ~edge[1:]
    last[:-1] &= ~space[1:]
    begins |= last
    taken = np.flatnonzero(last & (codes == 32)) + 1  # these runs begin with the blank before them
    begins[taken] = False
    quote = np.flatnonzero(begins & (codes == 39))
    if len(quote):
        around = np.concatenate([codes, np.zeros(3, np.uint32)])
        inside = np.concatenate([edge, np.ones(3, bool)])
        one, two = around[quote + 1], around[quote + 2]
        short = ~inside[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
        both = (one << np.uint32(8)) | np.where(two < 256, two, 0)
        long = ~inside[quote + 1] & ~inside[quote + 2] & (one < 256) & np.isin(
            both, [(ord(a) << 8) | ord(b) for a, b in ("re", "ve", "ll")])
        for found, size in ((quote[short], 2), (quote[long], 3)):
            begins[found + 1] = False
            after = found + size
            begins[after[after < n]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    at = np.searchsorted(starts, bounds).tolist()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())], at


class Vocabulary:
    """Tokens of a rank file (base64 and rank a line), with the merge that makes each and the tokens that begin it."""

    def __init__(self, ranks: bytes, pairs: int = PAIRS):
        self.pairs = pairs
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        top = 1 + max(self.ids.values())
        self.tokens = [b""] * top
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.size = [len(t) for t in self.tokens]
        self.left, self.right = [-1] * top, [-1] * top
        self.shorter = [-1] * top  # the longest proper beginning that merges can make
        self.merges: dict[tuple[int, int], int] = {}
        self.memory: dict[tuple[int, int], bool] = {}
        made = {t: i for t, i in self.ids.items() if len(t) == 1}
        for i in range(top):
            token = self.tokens[i]
            if len(token) < 2:
                continue
            for cut in range(len(token) - 1, 0, -1):
                a, b = made.get(token[:cut]), made.get(token[cut:])
                if a is not None and b is not None and self._apart(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merges[a, b] = i
                    made[token] = i
                    break
        self.automaton = ahocorasick.Automaton()
        for token, i in made.items():
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = next((made[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in made), -1)
        self.automaton.make_automaton()

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between the adjacent tokens a and b alone.

        The merges are undone from the last one on; a merge across the border happens if it ranks before all that
        were undone.
        """
        before = len(self.tokens)
        while True:
            across = self.merges.get((a, b))
            if across is not None and across < before:
                return False
            can_a, can_b = self.right[a] >= 0, self.left[b] >= 0
            if can_a and (a > b or not can_b):
                before, a = a, self.right[a]
            elif can_b:
                before, b = b + 1, self.left[b]
            else:
                return True

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, as the merges by rank make them. Each border is given up once at most."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, memory = self.size, self.shorter, self.memory
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size[token] + 1] = token
        dead, out, at, token, stop = set(), [], 0, longest[0], len(piece)
        while at < stop:
            end = at + size[token]
            if end not in dead and (not out or memory.get((out[-1], token)) or self._remembered(out[-1], token)):
                out.append(token)
                at = end
                if at < stop:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
        return out

    def _remembered(self, a: int, b: int) -> bool:
        known = self.memory.get((a, b))
        if known is None:
            if len(self.memory) > self.pairs:
                self.memory.clear()
            known = self.memory[a, b] = self._apart(a, b)
        return known


class Pieces(dict):
    """Packed ids by piece."""

    def __init__(self, vocabulary: Vocabulary, most: int = MEMORY):
        super().__init__()
        self.most = most
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) > self.most:
            self.clear()
        if len(piece) < 100:
            self[piece] = packed
        return packed


class Codec:
    def __init__(self, ranks: bytes, pattern: str, memory: int = MEMORY, pairs: int = PAIRS):
        self.vocabulary = Vocabulary(ranks, pairs)
        self.pattern = None if pattern == WORDS_PATTERN else regex.compile(pattern)
        self.pieces = Pieces(self.vocabulary, memory)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        get = self.pieces.__getitem__
        if self.pattern is not None:
            return [b"".join(map(get, (m.group() for m in self.pattern.finditer(t)))) for t in texts]
        pieces, at = split(texts)
        packed = list(map(get, pieces))
        return [b"".join(packed[a:b]) for a, b in zip(at, at[1:])]

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


def _codec(ranks: bytes, pattern: str, memory: int = MEMORY, pairs: int = PAIRS) -> Codec:
    """One per worker process, kept over its tasks."""
    return held(Codec, ranks, pattern, memory, pairs)


def _mapped(df: DataFrame, ranks: bytes, pattern: str, schema: str, columns) -> DataFrame:
    """Apply columns(codec, values) to batches of (id, value) rows; its arrays follow the id."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                arrays = columns(codec, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], [f.split(" ")[0] for f in schema.split(", ")])

    return df.mapInArrow(run, schema)


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.select(F.col(id_col)).schema[0].dataType.simpleString()


def encode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row, as the rank file's merges give them.

    Each match of `pattern` is encoded by itself; there are no special tokens. A null or empty text gives no ids.
    Repeated rows and null ids are encoded like any other; other columns are not read.
    """
    asked = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _mapped(
        asked, ranks, pattern, f"doc_id {_id_type(df, id_col)}, ids binary",
        lambda codec, texts: [pa.array(codec.encode(texts), pa.binary())],
    )


def decode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of every row of packed ids; null ids give no bytes."""
    asked = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return _mapped(
        asked, ranks, pattern, f"doc_id {_id_type(df, id_col)}, decoded binary",
        lambda codec, packed: [pa.array([codec.decode(p) for p in packed], pa.binary())],
    )


def round_trip(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded, the latter from the ids: encode and decode in one pass over the rows."""

    def both(codec: Codec, texts: list[str | None]) -> list[pa.Array]:
        packed = codec.encode(texts)
        return [pa.array(packed, pa.binary()), pa.array([codec.decode(p) for p in packed], pa.binary())]

    asked = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _mapped(asked, ranks, pattern, f"doc_id {_id_type(df, id_col)}, ids binary, decoded binary", both)


def digests(coded: DataFrame) -> DataFrame:
    """The result columns of op1 from a round trip."""
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
