"""Best-fit packing under several limits: tokens, documents and attention cost of a sequence."""

from __future__ import annotations

import math
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmine.llm.common import settle

# Texts encoded at once, and the characters after which a long text is cut at its next blank.
ROWS, CUT = 256, 1 << 20
# Words and pieces of words that a worker remembers in one generation; two are kept.
WORDS, PIECES = 100_000, 600_000
# Tokens and pieces that one task packs, on average.
SHARD_TOKENS, SHARD_PIECES = 8_000_000, 500_000

# How the vocabulary's pre-tokenizer cuts a lower-case ASCII text.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
# ASCII marks around something that begins and ends with a Latin letter; an apostrophe before it may start a contraction.
MARKED = re.compile(rf"([!-&(-/:-@\[-`{{-~]*)([{_LETTER}](?:.*[{_LETTER}])?)([!-/:-@\[-`{{-~]*)", re.DOTALL)
BLANK = re.compile(r"[ \n]")
LATIN = re.compile(rf"[{_LETTER}]+")
# A piece that the pre-tokenizer leaves as it is: one run of lower-case Latin letters, a digit, or visible ASCII marks. None of
# these letters changes in NFC or, being in lower case, in the library's Lowercase.
WHOLE = re.compile(r"[a-zß-öø-ɏ]+|[0-9]|[!-/:-@\[-`{-~]+")
# The characters by which a byte-level vocabulary names the bytes that are not visible in Latin-1.
_HIDDEN = [byte for byte in range(256) if not (33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255)]
BYTE_NAMES = {byte: 256 + n for n, byte in enumerate(_HIDDEN)}


class Remembered(dict):
    """What `make` gave for the keys used lately: a full generation becomes the old one, and that before goes."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.most, self.make = most, make
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) < 100:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Words:
    """The ids of a word-BPE vocabulary file as packed bytes, from the tokenizers library, asked once for each piece.

    White space only separates, and an ASCII text needs no normalisation but lower case, so a text is cut where the
    library would cut it and each different piece is encoded once. Words that are not ASCII go to the library whole,
    without the ASCII marks around them.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.encode_special_tokens = True
        self.merge = self.library.model.tokenize
        self.pieces = Remembered(PIECES, self.ask).__getitem__
        self.words = Remembered(WORDS, self.word).__getitem__

    def ask(self, piece: str) -> bytes:
        low = piece.lower()
        if WHOLE.fullmatch(low) and (piece.isascii() or LATIN.fullmatch(piece)):
            # All that the library would do with it is to name its bytes and merge them; asked for that alone, it is faster.
            ids = [token.id for token in self.merge(low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_NAMES))]
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        if word.isascii():
            return b"".join(map(self.pieces, ASCII.findall(word.lower())))
        marked = MARKED.fullmatch(word)
        if marked is None:
            return self.pieces(word)
        return b"".join([*map(self.pieces, ASCII.findall(marked[1])), self.pieces(marked[2]), *map(self.pieces, ASCII.findall(marked[3]))])

    def encode(self, text: str | None) -> bytes:
        return b"".join(self._part(part) for part in _parts(text or ""))

    def _part(self, text: str) -> bytes:
        if text.isascii():
            return b"".join(map(self.pieces, ASCII.findall(text.lower())))
        return b"".join(map(self.words, text.replace("\n", " ").split(" ")))


def _parts(text: str) -> Iterator[str]:
    begin = 0
    while len(text) - begin > CUT:
        blank = BLANK.search(text, begin + CUT)
        if blank is None:
            break
        yield text[begin:blank.start()]
        begin = blank.end()
    yield text[begin:] if begin else text


@lru_cache(maxsize=2)
def _words(vocabulary: str) -> Words:
    """One per worker process, kept over its tasks."""
    return Words(vocabulary)


def longest(length: int, cost: int | None) -> int:
    """The tokens of a whole piece: a sequence's, or fewer if the attention cost of so many is too high."""
    return min(length, math.isqrt(cost)) if cost is not None else length


def pieces(
    docs: DataFrame, vocabulary: str, end: int, length: int = 4096, cost: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids: the pieces of every document's token ids.

    `vocabulary` is the JSON of a word-BPE file of the tokenizers library. A document's ids are those of its text,
    without special tokens, and then `end`. Only a document longer than a sequence may be (`length` tokens, or the
    square root of `cost`) is cut, into whole pieces and a last one. ids are little-endian unsigned 32-bit numbers; start
    counts the document's ids before the piece. A null text is empty, so each row has at least the piece of its `end`.
    Repeated rows and null ids are documents of their own; other columns are not read.
    """
    whole = longest(length, cost)
    if whole < 1:
        raise ValueError("a sequence must hold a token")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = asked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = _words(shared.value).encode, struct.pack("<I", end)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                ids = [encode(text) + last for text in part.column(1).to_pylist()]
                sizes = np.array([len(i) // 4 for i in ids])
                counts = -(-sizes // whole)
                owner = np.repeat(np.arange(len(ids)), counts)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = number * whole
                size = np.minimum(sizes[owner] - start, whole)
                cut = [ids[o][4 * s:4 * (s + n)] for o, s, n in zip(owner.tolist(), start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(size), pa.array(cut, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

    return asked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def vector_best_fit(sizes: np.ndarray, limits: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """The bin of every item and the number of bins. Rows of `sizes` are an item's demands, none above `limits`.

    The largest items by weight go first. An item goes to a bin with room for all its demands: by "norm" the one whose
    weighted residual would be shortest, by "dot" the one whose residual has the largest weighted product with the
    item; a new bin is opened only where none has room. Equal items follow into the bin while they fit.
    """
    share = sizes / limits
    order = np.lexsort((*sizes.T, share @ weights))[::-1]
    runs = np.flatnonzero(np.append(True, (sizes[order[1:]] != sizes[order[:-1]]).any(1))) if len(order) else np.zeros(0, int)
    smallest = np.minimum.accumulate(sizes[order][::-1], axis=0)[::-1]  # of the items not placed yet
    owner = np.empty(len(sizes), np.int64)
    left = np.empty((64, len(limits)), np.int64)
    number, bins, n = np.empty(64, np.int64), 0, 0  # rows of `left` in use are the bins that may take more
    for run, stop in zip(runs.tolist(), [*runs[1:].tolist(), len(order)]):
        item = sizes[order[run]]
        able = (left[:n] >= smallest[run]).all(1)
        if 2 * able.sum() < n:
            kept = np.flatnonzero(able)
            left[:len(kept)], number[:len(kept)] = left[kept], number[kept]
            n = len(kept)
        at = run
        while at < stop:
            room = np.flatnonzero((left[:n] >= item).all(1))
            if not len(room):
                if n == len(left):
                    left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
                left[n], number[n] = limits, bins
                chosen, n, bins = n, n + 1, bins + 1
            elif rule == "norm":
                chosen = room[((((left[room] - item) / limits) ** 2) @ weights).argmin()]
            else:
                chosen = room[((left[room] / limits) @ (weights * item / limits)).argmax()]
            fit = min(stop - at, int((left[chosen] // np.maximum(item, 1))[item > 0].min(initial=stop - at)))
            owner[order[at:at + fit]] = number[chosen]
            left[chosen] -= fit * item
            at += fit
    return owner, bins


def fewest_bins(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, int]:
    """The best of both rules, with limits weighed by their scarcity (what all items ask of one) and by the scarcest alone."""
    scarce = (sizes / limits).sum(0)
    scarce = scarce / max(scarce.max(initial=0), 1e-300)
    alone = (scarce == scarce.max(initial=0)).astype(float)
    tried = [vector_best_fit(sizes, limits, weights, rule) for weights, rule in ((alone, "norm"), (scarce, "norm"), (scarce, "dot"))]
    return min(tried, key=lambda found: found[1])


def pack(
    cut: DataFrame, length: int = 4096, documents: int | None = None, cost: int | None = None, length_col: str = "length",
    shard_tokens: int = SHARD_TOKENS, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """The rows of `cut`, each with sequence_id and offset: its sequence and its place there, without gaps from 0.

    A sequence holds at most `length` tokens, `documents` pieces (default: `length`) and an attention cost of `cost`, the
    sum of the squares of its pieces' lengths (default: the square of `length`). Pieces that fill a sequence alone are
    one as they are; the others are dealt evenly over tasks, each of which packs about `shard_tokens` tokens and keeps the
    best of its trials, so at most one sequence in `shard_tokens / length` is part empty for that. Pieces of one document
    may be in any sequences. Rows without a length, or with one below 1 or beyond the limits, are refused with an error.
    Repeated rows are pieces of their own; an empty table gives no rows; columns sequence_id and offset must not be there.
    """
    documents, cost = documents or length, cost if cost is not None else length * length
    limits = np.array([length, documents, cost], np.int64)
    marked = {c.lower() for c in cut.columns}
    seq, shard = _free(marked, "seq"), _free(marked, "shard")
    size = F.col(length_col)
    rows = settle(cut.withColumn(seq, F.monotonically_increasing_id()), "pieces")
    total = rows.agg(
        F.count_if(size.isNull() | (size < 1) | (size > longest(length, cost))).alias("wrong"), F.sum(F.when(size < length, size)).alias("tokens"),
        F.count_if(size < length).alias("n")).first()
    if total["wrong"]:
        raise ValueError(f"{total['wrong']} pieces do not fit a sequence")
    shards = max(1, math.ceil((total["tokens"] or 0) / shard_tokens), math.ceil(total["n"] / shard_pieces))
    full = rows.filter(size == length).withColumn("sequence_id", -1 - F.col(seq)).withColumn("offset", F.lit(0).cast("long")).drop(seq)
    dealt = rows.filter(size < length).withColumn(shard, F.pmod(F.xxhash64(seq), F.lit(shards))).drop(seq)
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    at = dealt.columns.index(length_col)
    where = dealt.columns.index(shard)

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column(at).to_numpy().astype(np.int64)
        owner, _ = fewest_bins(np.stack([sizes, np.ones_like(sizes), sizes**2], 1), limits)
        order = np.lexsort((-sizes, owner))
        ends = np.cumsum(sizes[order])
        first = np.append(True, owner[order][1:] != owner[order][:-1])
        offset = np.empty_like(sizes)
        offset[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        number = (table.column(where)[0].as_py() << 32) + owner
        return table.remove_column(where).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return full.unionByName(dealt.groupBy(shard).applyInArrow(run, schema))


def _free(taken: set[str], name: str) -> str:
    while name in taken:
        name += "_"
    return name


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids, doc_ids, starts, offsets: a row per sequence, from packed rows that still have their ids.

    ids are the joined ids of the pieces in the order of their offsets, positions of which start again at each offset.
    A sequence is bounded by its length, so its pieces fit a row.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda all, part: F.concat(all, part["ids"]))
    return grouped.select(
        "sequence_id", "n_tokens", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"),
        F.col("parts.offset").alias("offsets"))


def digests(cut: DataFrame) -> DataFrame:
    """Pieces with a checksum in the place of their ids: what has to be shuffled when only places are asked for."""
    return cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
