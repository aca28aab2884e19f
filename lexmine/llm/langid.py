"""Language identification by cross-parsing: which language's labelled text spells a text in the fewest phrases."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmine.llm.common import held

UNDETERMINED = "und"
# Blocks of so many symbols are parsed side by side; where one block leaves the automaton, the next one enters it.
BLOCK = 256
BLOCKS_AT_ONCE = 8192
# Bytes of text that a worker parses together; a longer text is parsed by itself.
BYTES_AT_ONCE = 1 << 20
# How often blocks that were entered elsewhere are parsed again side by side; what then is still open is parsed in order.
ROUNDS = 3
# Letters with a symbol of their own; the rest share SHARED symbols by code point.
OWN, SHARED = 192, 60
_BLANK = 0


def training_text(labelled: DataFrame, text_col: str, lang_col: str, texts: int, chars: int) -> dict[str, list[str]]:
    """For each language, a window of `chars` characters of `texts` different texts, those whose hash is smallest.

    The hash also places the window, so common openings do not fill the sample. Rows without a text or a language are left out. Copies count once, so a text that is repeated often does not fill
    the sample. What reaches the driver is bounded by languages x texts x chars.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= texts)
    window = F.pmod("h", F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    found = (
        rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h")
        .agg(F.min(F.substring("text", window, F.lit(chars))).alias("text"))
    )
    sample: dict[str, list[str]] = {}
    for row in sorted(found.collect()):
        sample.setdefault(row["lang"], []).append(row["text"])
    return sample


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        state, last = last, new
        while state >= 0 and symbol not in follow[state]:
            follow[state][symbol] = new
            state = link[state]
        if state < 0:
            continue
        target = follow[state][symbol]
        if length[target] == length[state] + 1:
            link[new] = target
            continue
        copy = len(follow)
        follow.append(dict(follow[target]))
        link.append(link[target])
        length.append(length[state] + 1)
        while state >= 0 and follow[state].get(symbol) == target:
            follow[state][symbol] = copy
            state = link[state]
        link[target] = link[new] = copy
    return follow


class Model:
    """A transition table per language. Its size is about 1.5 x sample characters x the language's own alphabet x 4 bytes."""

    def __init__(self, sample: dict[str, list[str]]):
        self.langs = sorted(sample)
        counts = Counter(c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha())
        own = {c: i + 1 for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:OWN])}
        self.width = 1 + len(own) + SHARED + 1
        self.pad = self.width - 1
        self.symbol = np.zeros(0x110000, np.uint8)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                low = low if len(low) == 1 else c
                self.symbol[point] = own.get(low) or 1 + len(own) + ord(low) % SHARED
        self.tables, self.columns, self.bits = [], [], []
        for lang in self.langs:
            spelt, _ = self.spelt(sample[lang])
            follow = automaton(spelt.tolist())
            # Only the sample's own symbols have a column each; all that the language lacks share one, padding has the last.
            own = sorted(follow[0])
            width = len(own) + 2
            columns = np.full(self.width, len(own), np.uint8)
            columns[own] = np.arange(len(own))
            columns[self.pad] = width - 1
            # Where each column leads, in table places, doubled; odd if a phrase ends before it. The last state is where
            # a symbol that the language lacks leads: a phrase by itself.
            table = np.full((len(follow) + 1, width), len(follow) * width * 2 + 1, np.int32)
            table[0] -= 1
            column = columns.tolist()
            for symbol, state in follow[0].items():
                table[1:, column[symbol]] = state * width * 2 + 1
            for state, steps in enumerate(follow):
                for symbol, target in steps.items():
                    table[state, column[symbol]] = target * width * 2
            table[:, -1] = np.arange(len(table)) * width * 2
            self.tables.append(table.ravel())
            self.columns.append(columns)
            self.bits.append(math.log2(max(2, len(spelt))))

    def spelt(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, runs of other characters as one blank between letters, and the texts' lengths."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        found = self.symbol[codes]
        first = np.zeros(len(codes), bool)
        starts = np.concatenate([[0], ends[:-1]])
        first[starts[starts < len(codes)]] = True
        kept = found != _BLANK
        kept[1:] |= (found[:-1] != _BLANK) & ~first[1:]
        return found[kept], np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(kept)])[ends]]))

    @staticmethod
    def _walk(table: np.ndarray, grid: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases that end in each block, and the places in the table where blocks entered at such places are left."""
        ended, left = np.zeros(len(grid), np.int32), np.empty(len(grid), np.int32)
        for start in range(0, len(grid), BLOCKS_AT_ONCE):
            part = slice(start, start + BLOCKS_AT_ONCE)
            place, count = entered[part], np.zeros(len(entered[part]), np.int32)
            for column in np.ascontiguousarray(grid[part].T):
                step = table.take(place + column)
                count += step & 1
                place = step >> 1
            ended[part], left[part] = count, place
        return ended, left

    def _parsed(self, table: np.ndarray, grid: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The phrases that end in each block when every text is parsed in one piece.

        All blocks are first entered at the start, then again where the block before left off. Parses of different
        starts soon end their phrases at the same symbols, so after few rounds no block is entered elsewhere than
        before. Texts that keep shifting (runs of one letter) are finished block by block, so the work stays linear.
        """
        entered = np.zeros(len(grid), np.int32)
        ended, left = self._walk(table, grid, entered)
        late = np.zeros(0, np.int64)
        for _ in range(ROUNDS):
            handed = np.where(heads, 0, np.roll(left, 1)).astype(np.int32)
            late = np.flatnonzero(handed != entered)
            if not len(late):
                return ended
            entered = handed
            ended[late], left[late] = self._walk(table, grid[late], handed[late])
        for block in late.tolist():
            block += 1
            while block < len(grid) and not heads[block] and entered[block] != left[block - 1]:
                entered[block] = place = int(left[block - 1])
                count = 0
                for symbol in grid[block].tolist():
                    step = table.item(place + symbol)
                    count += step & 1
                    place = step >> 1
                ended[block], left[block] = count, place
                block += 1
        return ended

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (language x text) and the texts' lengths in symbols."""
        spelt, lengths = self.spelt(texts)
        blocks = -(-lengths // BLOCK)
        first = np.cumsum(blocks) - blocks
        grid = np.full(int(blocks.sum()) * BLOCK, self.pad, np.uint8)
        grid[np.repeat(np.tile([True, False], len(texts)), np.stack([lengths, blocks * BLOCK - lengths], 1).ravel())] = spelt
        grid = grid.reshape(-1, BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        heads = np.zeros(len(grid), bool)
        heads[first[blocks > 0]] = True
        counts = np.zeros((len(self.langs), len(texts)))
        for k, table in enumerate(self.tables):
            counts[k] = np.bincount(owner, self._parsed(table, self.columns[k][grid], heads), len(texts)) + (blocks > 0)
        return counts, lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts, lengths = self.phrases([t or "" for t in texts])
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cost = counts * np.array(self.bits)[:, None] / np.maximum(lengths, 1)
        best = cost.argmin(0)
        ranked = np.sort(cost, 0)
        score = ranked[1] / (ranked[0] + ranked[1] + 1e-300) if len(self.langs) > 1 else np.ones(len(texts))
        known = lengths > 0
        return (
            [self.langs[i] if k else UNDETERMINED for i, k in zip(best, known)],
            np.where(known, score, 0.0).tolist(),
        )


def _model(sample: tuple) -> Model:
    return Model({lang: list(texts) for lang, texts in sample})


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, about BYTES_AT_ONCE of them together, whatever an Arrow batch holds."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        most = BYTES_AT_ONCE + (ends[first - 1] if first else 0)
        last = max(first + 1, int(np.searchsorted(ends, most, "right")))
        yield texts.slice(first, last - first)
        first = last


def fit(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = 64, chars: int = 400,
) -> dict[str, list[str]]:
    """The labelled sample that predictions parse with: `texts` texts of `chars` characters per language at most.

    Empty tables, or tables without labels, give an empty sample, with which every text is undetermined.
    """
    return training_text(labelled, text_col, lang_col, texts, chars)


def identify(df: DataFrame, sample: dict[str, list[str]], text_col: str = "text") -> Column:
    """A column struct<lang_pred string, score double> for the rows of df.

    The language whose text needs the fewest phrases per character, each weighed with the bits of a pointer into that
    text, wins; of equals, the first by name. score is the runner-up's cost as a share of both (0.5: a tie; 1 if only
    one language is known). `und` and 0 if the text is null or has no letter. Whole texts are parsed in one piece.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple((k, tuple(v)) for k, v in sorted(sample.items())))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held(_model, shared.value)
        for batch in batches:
            langs, scores = [], []
            for piece in _pieces(batch):
                found = model.predict(piece.to_pylist())
                langs += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predicted.asNondeterministic()(F.col(text_col))


def held_out(id_column: Column) -> Column:
    """The fold that never teaches: crc32 of the id as text leaves 2 when divided by 4. A null id is not in it."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def identify_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = 64, chars: int = 400,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, taught by the labelled rows that are not held out.

    Repeated rows each give a row; columns other than these three are not read.
    """
    sample = fit(docs.filter(~held_out(F.col(id_col))), text_col, lang_col, texts, chars)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", identify(rows, sample).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")
