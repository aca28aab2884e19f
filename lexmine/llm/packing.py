"""Token-id output: documents packed into rows of one length by best fit, the longest pieces first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.bpe import ROWS, _codec

# Tokens that a task holds before it packs them: a shard of the output.
SHARD_TOKENS = 4_000_000
# Pieces and pairs of tokens that a worker remembers; packing runs alone, so it may remember more than encoding does.
MEMORY = 1_000_000
# Rows of a batch handed back to Spark.
PACKS = 512


class Capacities:
    """Open rows by what they have left, with a segment tree over capacities: each node counts the rows below it."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least capacity of `size` or more, and that capacity; it is no longer open."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return row, capacity


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Pieces of 1 to `length` tokens to rows of `length`: the longest first, each where it leaves the least room."""
    open_rows, rows = Capacities(length), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        found = open_rows.take(size) if size < length else None
        if found is None:
            rows.append([piece])
            row, left = len(rows) - 1, length - size
        else:
            row, capacity = found
            rows[row].append(piece)
            left = capacity - size
        if left:
            open_rows.add(left, row)
    return rows


def _packed(ids: list, tokens: list[np.ndarray], length: int, pad: int) -> Iterator[dict]:
    """The rows of one shard. Each document is cut into whole rows and a rest; only rests share rows."""
    documents, starts, sizes = [], [], []
    for k, row in enumerate(tokens):
        for start in range(0, len(row), length):
            documents.append(k)
            starts.append(start)
            sizes.append(min(length, len(row) - start))
    for pieces in best_fit(np.array(sizes, np.int64), length):
        line, places, bounds = np.full(length, pad, "<u4"), np.zeros(length, "<u4"), [0]
        for piece in pieces:
            begin, end = bounds[-1], bounds[-1] + sizes[piece]
            line[begin:end] = tokens[documents[piece]][starts[piece]:starts[piece] + sizes[piece]]
            places[begin:end] = np.arange(sizes[piece])
            bounds.append(end)
        yield {
            "ids": line.tobytes(), "positions": places.tobytes(), "cu_seqlens": bounds,
            "doc_ids": [ids[documents[p]] for p in pieces], "starts": [starts[p] for p in pieces],
        }


def pack(
    docs: DataFrame, ranks: bytes, pattern: str, length: int = 2048, pad: int = 50256, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """shard, row, ids, positions, cu_seqlens, doc_ids, starts: one packed row of `length` token ids each.

    ids and positions are binary rows of `length` little-endian unsigned 32-bit numbers: token ids, filled up with
    `pad`, and each token's place in its segment, which starts again at 0. Segment k is the tokens from cu_seqlens[k] to
    cu_seqlens[k + 1]; it belongs to doc_ids[k], of whose tokens it begins at starts[k]. Every token of every document
    is in one row: longer ones are cut, in whole rows and a rest. A task packs what it reads, shard by shard as its
    memory allows, so nothing is shuffled and no key can be hot; the shards follow the splits of the input. Null and
    empty texts have no tokens and are in no row; repeated rows and null ids are packed like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"shard string, row int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, starts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value, MEMORY, MEMORY)
        task, shard = TaskContext.get().partitionId(), 0
        names = ["ids", "positions", "cu_seqlens", "doc_ids", "starts"]
        id_type = None

        def written(ids: list, tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            types = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64())]
            lines: list[dict] = []

            def batch(first: int) -> pa.RecordBatch:
                columns = [pa.array([line[n] for line in lines], t) for n, t in zip(names, types)]
                marks = [pa.array([f"{task:05d}-{shard:05d}"] * len(lines)), pa.array(range(first, first + len(lines)), pa.int32())]
                return pa.RecordBatch.from_arrays([*marks, *columns], ["shard", "row", *names])

            done = 0
            for line in _packed(ids, tokens, length, pad):
                lines.append(line)
                if len(lines) == PACKS:
                    yield batch(done)
                    done += len(lines)
                    lines.clear()
            if lines:
                yield batch(done)

        ids, tokens, held = [], [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                for key, packed in zip(part.column(0).to_pylist(), codec.encode(part.column(1).to_pylist())):
                    if packed:
                        ids.append(key)
                        tokens.append(np.frombuffer(packed, "<u4"))
                        held += len(packed) // 4
                if held >= SHARD_TOKENS:
                    yield from written(ids, tokens)
                    ids, tokens, held = [], [], 0
                    shard += 1
        if tokens:
            yield from written(ids, tokens)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def write(packed: DataFrame, folder: str) -> None:
    """Write packed rows as files of a folder that Spark can reach; `matrix` reads rows of them back."""
    packed.write.mode("error").parquet(folder)


def matrix(column: list[bytes]) -> np.ndarray:
    """Packed rows as one matrix of token ids or positions."""
    return np.stack([np.frombuffer(row, "<u4") for row in column])


def summary(packed: DataFrame) -> DataFrame:
    """A row per packed row: its segments as doc_id:start:length, its size, and digests of its numbers."""
    segments = F.transform(
        F.arrays_zip("doc_ids", "starts", F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("ends"),
                     F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("begins")),
        lambda s: F.concat_ws(":", s["doc_ids"].cast("string"), s["starts"].cast("string"), (s["ends"] - s["begins"]).cast("string")))
    return packed.select(
        "shard", "row", F.element_at("cu_seqlens", -1).alias("n_tokens"), F.size("doc_ids").alias("n_segments"),
        F.array_join(segments, ",").alias("segments"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
