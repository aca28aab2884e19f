"""Hard negatives: exact integer scores of anchors and all rows, tile by tile with Strassen's multiplication, kept in heaps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmine.llm.centroids import finite, integers
from lexmine.llm.common import settle

# Products with a side of this or less are multiplied directly.
LEAF = 16
# Numbers in a block of rows and in one of anchors, and the most rows of each.
BLOCK, ANCHORS = 1 << 17, 1 << 15
MOST_ROWS, MOST_ANCHORS = 2048, 512
# Blocks that a task orders by label before it cuts them.
HELD = 8
# Blocks of rows and of anchors that meet in one cell of the grid.
ROW_GROUP, ANCHOR_GROUP = 4, 16
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of 64-bit integers by seven products of halves; odd sides are padded with zeros.

    Sums that leave 64 bits on the way wrap and come back, so the product is exact wherever it fits itself.
    """
    m, d, n = len(a), a.shape[1], b.shape[1]
    if min(m, d, n) <= leaf:
        return a @ b
    p, q, r = (m + 1) // 2, (d + 1) // 2, (n + 1) // 2
    if (m, d) != (2 * p, 2 * q):
        a = np.pad(a, ((0, 2 * p - m), (0, 2 * q - d)))
    if (d, n) != (2 * q, 2 * r):
        b = np.pad(b, ((0, 2 * q - d), (0, 2 * r - n)))
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    one = strassen(a11 + a22, b11 + b22, leaf)
    two = strassen(a21 + a22, b11, leaf)
    three = strassen(a11, b12 - b22, leaf)
    four = strassen(a22, b21 - b11, leaf)
    five = strassen(a11 + a12, b22, leaf)
    six = strassen(a21 - a11, b11 + b12, leaf)
    seven = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * p, 2 * r), np.int64)
    out[:p, :r] = one + four - five + seven
    out[:p, r:] = three + five
    out[p:, :r] = two + four
    out[p:, r:] = one - two + three + six
    return out[:m, :n]


class Heaps:
    """For each of m lines the k best entries so far: higher scores first, ties by place (null ids last), then by row."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.scores, self.ids, self.absent = np.full((m, k), NONE), np.zeros((m, k), np.int64), np.zeros((m, k), bool)

    def merge(self, lines: np.ndarray, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        """Take in a tile's candidates for some lines; columns are ordered by id. Entries of NONE are no candidates."""
        scores = scores.copy()
        best = []
        for _ in range(min(self.k, scores.shape[1])):
            at = scores.argmax(1)  # the first of equal scores has the smallest id
            best.append((scores[np.arange(len(at)), at], ids[at], absent[at]))
            scores[np.arange(len(at)), at] = NONE
        if best:
            self.join(lines, *(np.stack(column, 1) for column in zip(*best)))

    def join(self, lines: np.ndarray, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        """Take in the entries of other heaps of the same lines."""
        scores = np.concatenate([self.scores[lines], scores], 1)
        ids = np.concatenate([self.ids[lines], ids], 1)
        absent = np.concatenate([self.absent[lines], absent], 1)
        # ~score grows as the score falls and does not overflow
        order = np.lexsort((ids, absent, ~scores), axis=1)[:, :self.k]
        self.scores[lines], self.ids[lines], self.absent[lines] = (np.take_along_axis(v, order, 1) for v in (scores, ids, absent))

    def entries(self) -> tuple[np.ndarray, ...]:
        """line, score, id and absent of all entries."""
        line, slot = np.nonzero(self.scores > NONE)
        return line, self.scores[line, slot], self.ids[line, slot], self.absent[line, slot]


FIELDS = [("row", np.int64), ("id", np.int64), ("absent", np.bool_), ("label", np.int64), ("asked", np.bool_), ("vec", np.float64)]
BLOCK_SCHEMA = "block long, dim int, low long, high long, " + ", ".join(f"{name}s binary" for name, _ in FIELDS)


def _arrays(block: dict) -> dict[str, np.ndarray]:
    found = {name: np.frombuffer(block[f"{name}s"], kind) for name, kind in FIELDS}
    found["vec"] = found["vec"].reshape(len(found["row"]), block["dim"])
    return found


class Packer:
    """Collects rows of each dimension and cuts them into blocks, ordered by label over blocks and by id within one."""

    def __init__(self, numbers: int, most: int):
        self.numbers, self.most = numbers, most
        self.held: dict[int, list[dict]] = {}
        self.made = 0

    def size(self, dim: int) -> int:
        return max(1, min(self.most, self.numbers // max(dim, 1)))

    def add(self, dim: int, part: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        waiting = self.held.setdefault(dim, [])
        waiting.append(part)
        if sum(len(p["row"]) for p in waiting) >= HELD * self.size(dim):
            yield from self.cut(dim)

    def cut(self, dim: int) -> Iterator[pa.RecordBatch]:
        parts = self.held.pop(dim)
        every = {name: np.concatenate([p[name] for p in parts]) for name, _ in FIELDS}
        by_label = np.argsort(every["label"], kind="stable")
        size = self.size(dim)
        for begin in range(0, len(by_label), size):
            at = by_label[begin:begin + size]
            at = at[np.lexsort((every["row"][at], every["id"][at], every["absent"][at]))]
            labels = every["label"][at]
            block = (TaskContext.get().partitionId() << 32) + self.made
            self.made += 1
            yield pa.RecordBatch.from_pylist(
                [{"block": block, "dim": dim, "low": labels.min(), "high": labels.max()} | {f"{n}s": np.ascontiguousarray(every[n][at], t).tobytes() for n, t in FIELDS}],
                pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), *[(f"{n}s", pa.binary()) for n, _ in FIELDS]]))

    def rest(self) -> Iterator[pa.RecordBatch]:
        for dim in list(self.held):
            yield from self.cut(dim)


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks of all rows, as the tasks read them: nothing is shuffled and no label can be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, row = Packer(BLOCK, MOST_ROWS), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, labels, asked, vecs = batch.columns
            dims = np.diff(vecs.offsets.to_numpy())
            values, starts = vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()
            given = {
                "row": row + np.arange(batch.num_rows), "id": ids.fill_null(0).to_numpy(), "absent": ids.is_null().to_numpy(zero_copy_only=False),
                "label": labels.to_numpy(), "asked": asked.to_numpy(zero_copy_only=False),
            }
            row += batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vec = values[starts[at][:, None] + np.arange(dim)]
                yield from packer.add(dim, {name: v[at] for name, v in given.items()} | {"vec": vec})
        yield from packer.rest()

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _anchors(blocks: DataFrame) -> DataFrame:
    """Blocks of the rows that are anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(ANCHORS, MOST_ANCHORS)
        for batch in batches:
            for block in batch.to_pylist():
                found = _arrays(block)
                if found["asked"].any():
                    yield from packer.add(block["dim"], {name: v[found["asked"]] for name, v in found.items()})
        yield from packer.rest()

    return blocks.mapInArrow(run, BLOCK_SCHEMA)


class Tiles:
    """The scores of a cell's anchors and rows, a pair of blocks at a time."""

    def __init__(self, table: pa.Table, scale: int):
        self.anchors, self.rows = [], []
        for block in table.to_pylist():
            arrays = _arrays(block)
            arrays["vec"] = integers(arrays["vec"], scale)
            arrays["most"] = int(np.abs(arrays["vec"]).max(initial=0))
            (self.anchors if block["anchor"] else self.rows).append(block | arrays)

    def scores(self, ours: dict, theirs: dict) -> np.ndarray:
        if ours["dim"] * ours["most"] * theirs["most"] >= 1 << 62:
            raise OverflowError("scores of these vectors do not fit 64-bit integers")
        if "turned" not in theirs:
            theirs["turned"] = np.asfortranarray(theirs["vec"].T)
        return strassen(ours["vec"], theirs["turned"])


def _cells(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of rows, in cells of a bounded number of blocks of both."""
    across = max(1, math.ceil(anchors.count() / ANCHOR_GROUP))
    down = max(1, math.ceil(blocks.count() / ROW_GROUP))

    def dealt(own: str, n: int, other: str, m: int) -> list[Column]:
        return [F.pmod(F.xxhash64("block"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other)]

    ours = anchors.select("*", F.lit(True).alias("anchor"), *dealt("i", across, "j", down))
    theirs = blocks.select("*", F.lit(False).alias("anchor"), *dealt("j", down, "i", across))
    return ours.unionByName(theirs, allowMissingColumns=True).groupBy("dim", "i", "j")


def _window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score n with low * positive <= 100 * n <= high * positive; no product can overflow."""
    whole, left = np.divmod(positive, 100)
    return whole * low - (-left * low // 100), whole * high + left * high // 100


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of vectors of integers floor(scale * x). An anchor is a row for which the condition
    `anchor` holds; its positives are the `positives` other rows of its label with the highest scores, and for each
    of them the result has the `negatives` rows of other labels with the highest scores from `low` to `high` per cent
    of the positive's. Equal scores are ordered by id, a null id last. Rows with a null label, a null vector or a null
    or non-finite component take no part; vectors of different lengths are not compared. Rows that repeat an id are
    rows of their own: another row with the anchor's id can be its positive. Ids and labels are integers. An empty
    table, or one without anchors, gives no rows. Every anchor meets every row, in cells of bounded numbers of both,
    so a label may hold any share of the rows. Components too large for exact 64-bit scores are refused with an error.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asked"),
        F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("label").isNotNull() & finite(F.col("vec")))
    blocks = settle(_packed(rows), "blocks")
    anchors = settle(_anchors(blocks), "anchors")
    found = "anchor long, anchor_block long, anchor_id long, place int, score long, id long, absent boolean"
    names = [f.split(" ")[0] for f in found.split(", ")]

    def table(ours: dict, heaps: Heaps, per: int) -> pa.Table:
        """The heaps' entries; `per` lines belong to an anchor."""
        line, score, ids, absent = heaps.entries()
        at = line // per
        return pa.table([
            pa.array(ours["row"][at]), pa.array(np.full(len(at), ours["block"])), pa.array(ours["id"][at]), pa.array((line % per).astype(np.int32)),
            pa.array(score), pa.array(ids, mask=absent), pa.array(absent)], names)

    def best_positives(cell: pa.Table) -> pa.Table:
        tiles, out = Tiles(cell, scale), []
        for ours in tiles.anchors:
            heaps = Heaps(len(ours["row"]), positives)
            for theirs in tiles.rows:
                if ours["low"] > theirs["high"] or theirs["low"] > ours["high"]:
                    continue
                able = (ours["label"][:, None] == theirs["label"]) & (ours["row"][:, None] != theirs["row"])
                lines = np.flatnonzero(able.any(1))
                if len(lines):
                    scores = np.where(able, tiles.scores(ours, theirs), NONE)
                    heaps.merge(lines, scores[lines], theirs["id"], theirs["absent"])
            out.append(table(ours, heaps, 1))
        return pa.concat_tables(out) if out else _nothing(names, found)

    def best_negatives(cell: pa.Table) -> pa.Table:
        tiles, out = Tiles(cell, scale), []
        for ours in tiles.anchors:
            line = np.searchsorted(ours["row"], np.array(ours["anchor_rows"], np.int64), sorter=(order := np.argsort(ours["row"])))
            least, most = np.full((len(order), positives), 1), np.zeros((len(order), positives), np.int64)
            at = order[line], np.array(ours["places"], np.int64)
            least[at], most[at] = _window(np.array(ours["scores"], np.int64), low, high)
            heaps = Heaps(len(order) * positives, negatives)
            for theirs in tiles.rows:
                if ours["low"] == ours["high"] == theirs["low"] == theirs["high"]:
                    continue
                scores = np.where(ours["label"][:, None] != theirs["label"], tiles.scores(ours, theirs), NONE)
                top = scores.max(1)
                for p in range(positives):
                    lines = np.flatnonzero((most[:, p] >= least[:, p]) & (top >= least[:, p]))
                    if not len(lines):
                        continue
                    mine = scores[lines]
                    mine = np.where((mine >= least[lines, p, None]) & (mine <= most[lines, p, None]), mine, NONE)
                    hit = mine.max(1) > NONE
                    heaps.merge(lines[hit] * positives + p, mine[hit], theirs["id"], theirs["absent"])
            out.append(table(ours, heaps, positives))
        return pa.concat_tables(out) if out else _nothing(names, found)

    def ranked(heaps: DataFrame, by: list[str], k: int) -> DataFrame:
        """The k best of the heaps of all cells."""
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "absent", "id")
        return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    best = ranked(_cells(anchors, blocks).applyInArrow(best_positives, found), ["anchor"], positives)
    best = settle(best.select("anchor", "anchor_block", "anchor_id", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lists = best.groupBy(F.col("anchor_block").alias("block")).agg(F.collect_list(F.struct("anchor", "place", "positive_score")).alias("all")).select(
        "block", F.col("all.anchor").alias("anchor_rows"), F.col("all.place").alias("places"), F.col("all.positive_score").alias("scores"))
    windows = _cells(anchors.join(lists, "block"), blocks).applyInArrow(best_negatives, found)
    chosen = ranked(windows, ["anchor", "place"], negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(chosen, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _nothing(names: list[str], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.table([pa.array([], kinds[f.split(" ")[1]]) for f in schema.split(", ")], names)
