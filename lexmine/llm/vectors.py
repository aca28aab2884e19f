"""Near-duplicate embeddings: inverted lists, product-quantised residuals, exact cosines of what is left."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import components, forest, salted_join, settle

# Rounding of single-precision distances.
SLACK = 1e-3
# Queries compared with a block of a list at once.
QUERIES_AT_ONCE = 512


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: exact, and no square can be lost."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def _centres(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        owner = _squares(points, centres).argmin(1)
        counts = np.bincount(owner, minlength=len(centres))
        sums = np.stack([np.bincount(owner, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Quantizer:
    """Coarse centres of unit vectors, and codebooks for the parts of what is left after the nearest centre."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int):
        sample = _unit(sample)
        self.coarse = _centres(sample, lists)
        self.apart = np.sqrt(_squares(self.coarse, self.coarse))
        rest = sample - self.coarse[_squares(sample, self.coarse).argmin(1)]
        self.cuts = [c for c in np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1])) if len(c)]
        self.books = [_centres(rest[:, cut], codes) for cut in self.cuts]

    def lists(self, unit: np.ndarray) -> np.ndarray:
        return _squares(unit, self.coarse).argmin(1)

    def probes(self, unit: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) wherever a vector within `reach` may be in the list.

        A vector of list c lies on c's side of the plane between c and the row's own centre, so that plane is no
        further from the row than `reach`. No list that fails this can hold a link: the probes are sufficient.
        """
        squares = _squares(unit, self.coarse)
        own = squares.argmin(1)
        gap = squares - squares[np.arange(len(unit)), own][:, None]
        return np.nonzero(gap <= 2 * (reach + SLACK) * self.apart[own] + SLACK)

    def encode(self, unit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and each one's distance from what its codes stand for."""
        rest = unit - self.coarse[owner]
        codes = np.stack([_squares(rest[:, cut], book).argmin(1) for cut, book in zip(self.cuts, self.books)], 1).astype(np.uint8)
        told = np.zeros_like(rest)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            told[:, cut] = book[codes[:, m]]
        return codes, np.linalg.norm(rest - told, axis=1)

    def distances(self, unit: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of query rows to coded members of one list, by table look-up."""
        rest = unit - self.coarse[which]
        total = np.zeros((len(unit), len(codes)), np.float32)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            total += _squares(rest[:, cut], book).astype(np.float32).take(codes[:, m], 1)
        return np.sqrt(total)


def _rows(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_pylist()])


def checked(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vec, dim and digest (of label and components; null where the vector links with nothing)."""
    asked = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for label, vec in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                good = label is not None and vec is not None and len(vec) > 0 and None not in vec
                row = np.asarray(vec, np.float64) + 0.0 if good else None
                good = good and bool(np.isfinite(row).all()) and bool(row.any())
                digests.append(hashlib.blake2b(repr(label).encode() + b"/" + row.tobytes(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["vec_id", "label", "vec", "digest"])

    found = asked.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec {kinds['vec']}, digest binary")
    return found.withColumn("dim", F.size("vec"))


def fit(groups: DataFrame, sample: int, lists: int, parts: int, codes: int) -> dict[int, Quantizer]:
    """A quantizer per dimension, from at most `sample` different vectors, chosen by hash."""
    n = max(1, groups.count())
    share = 1 << 30
    chosen = groups.filter(F.pmod(F.xxhash64("digest"), F.lit(share)) < min(share, share * sample // n)).orderBy("digest").limit(2 * sample)
    by_dim: dict[int, list] = {}
    for row in chosen.select("dim", "vec").collect():
        by_dim.setdefault(row["dim"], []).append(row["vec"])
    for row in groups.groupBy("dim").agg(F.min_by("vec", "digest").alias("vec")).collect():  # of rare dimensions
        by_dim.setdefault(row["dim"], []).append(row["vec"])
    return {dim: Quantizer(np.array(rows, np.float64), lists, parts, codes) for dim, rows in by_dim.items()}


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93,
    lists: int = 32, parts: int = 16, codes: int = 64, sample: int = 8192, block: int = 2048,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row.

    Vectors of one label are linked when their cosine is `least` or more, in double precision. Every vector is in the
    index; a query goes to each list that can hold a link, and a coded member is left out only if its distance, less
    the error of its code, is beyond the threshold. So no link is lost, whatever the sample was. A list is compared in
    blocks; a block answers with link counts and a forest of its links, never with all pairs. Equal vectors are one
    entry. Null, empty or zero vectors, those with null or non-finite components, and null labels link with nothing;
    vectors of different lengths do not link. Rows that repeat an id are vectors of their own, linked and counted by
    themselves; component_id is the smallest id among the vectors reached. A row without an id links with nothing, has
    itself (null) as its component and is kept. Ids are integers.
    """
    rows = settle(checked(vectors, id_col, vec_col, label_col), "vectors")
    groups = settle(
        rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL").groupBy("digest")
        .agg(F.min("vec_id").cast("long").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
        .withColumn("rep", F.monotonically_increasing_id()), "groups")  # a number for each different vector, fixed by writing it
    reach = math.sqrt(2 - 2 * least)
    model = vectors.sparkSession.sparkContext.broadcast(fit(groups, sample, lists, parts, codes))
    label_kind, vec_kind = groups.schema["label"].dataType.simpleString(), groups.schema["vec"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per vector with its own list, and one per list that it probes."""
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims):
                for at in np.array_split(np.flatnonzero(dims == dim), -(-int((dims == dim).sum()) // 2048)):
                    part = batch.take(pa.array(at))
                    unit = _unit(_rows(part.column(part.schema.get_field_index("vec"))))
                    quantizer = model.value[int(dim)]
                    who, which = quantizer.probes(unit, reach)
                    own = quantizer.lists(unit)
                    for member, row, cell in ((True, np.arange(len(at)), own), (False, who, which)):
                        taken = part.take(pa.array(row))
                        names = ["rep", "copies", "label", "dim", "vec"]
                        yield pa.RecordBatch.from_arrays(
                            [*(taken.column(taken.schema.get_field_index(n)) for n in names), pa.array(cell.astype(np.int32)), pa.array([member] * len(row))],
                            [*names, "list", "member"])

    cells = groups.select("rep", "copies", "label", "dim", "vec").mapInArrow(
        placed, f"rep long, copies long, label {label_kind}, dim int, vec {vec_kind}, list int, member boolean")
    cells = settle(cells, "cells")
    of = ["label", "dim", "list"]
    blocks = cells.groupBy(*of).agg(
        F.ceil(F.count_if("member") / block).alias("m_blocks"), F.ceil(F.count_if(~F.col("member")) / block).alias("q_blocks"))
    blocks = blocks.filter("m_blocks > 0 AND q_blocks > 0")
    spread = cells.join(blocks, of)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("member"), F.col("m_blocks")).otherwise(F.col("q_blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("member"), F.col("q_blocks")).otherwise(F.col("m_blocks")) - 1))
    spread = spread.withColumn("own", own).withColumn("other", every)
    spread = spread.withColumn("m_block", F.when(F.col("member"), F.col("own")).otherwise(F.col("other"))).withColumn(
        "q_block", F.when(F.col("member"), F.col("other")).otherwise(F.col("own")))

    def compared(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        quantizer, which = model.value[int(key[1])], int(key[2])
        ours, theirs = frame[~frame["member"]], frame[frame["member"]]
        out = []
        if len(ours) and len(theirs):
            a, b = (_scaled(np.stack(f["vec"].to_numpy()).astype(np.float64)) for f in (ours, theirs))
            ids_a, ids_b, copies = ours["rep"].to_numpy(), theirs["rep"].to_numpy(), theirs["copies"].to_numpy()
            size_b = np.linalg.norm(b, axis=1)
            unit_b = b / size_b[:, None]
            coded, error = quantizer.encode(unit_b, np.full(len(b), which))
            for begin in range(0, len(a), QUERIES_AT_ONCE):
                x, ids_x = a[begin:begin + QUERIES_AT_ONCE], ids_a[begin:begin + QUERIES_AT_ONCE]
                size_x = np.linalg.norm(x, axis=1)
                near = quantizer.distances(x / size_x[:, None], which, coded) <= (reach + SLACK + error).astype(np.float32)
                q, m = np.nonzero(near)
                other = ids_x[q] != ids_b[m]
                q, m = q[other], m[other]
                for cut in range(0, len(q), 1 << 17):
                    i, j = q[cut:cut + (1 << 17)], m[cut:cut + (1 << 17)]
                    linked = np.einsum("ij,ij->i", x[i], b[j]) / (size_x[i] * size_b[j]) >= least
                    i, j = i[linked], j[linked]
                    if not len(i):
                        continue
                    n = np.bincount(i, copies[j], len(x)).astype(np.int64)
                    hit = np.flatnonzero(n)
                    out.append(pd.DataFrame({"a": ids_x[hit], "b": ids_x[hit], "n": n[hit]}))
                    one, two = forest(ids_x[i], ids_b[j])
                    out.append(pd.DataFrame({"a": one, "b": two, "n": np.zeros(len(one), np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")

    found = settle(
        spread.select("label", "dim", "list", "m_block", "q_block", "rep", "copies", "vec", "member")
        .groupBy("label", "dim", "list", "m_block", "q_block").applyInPandas(compared, "a long, b long, n long"), "found")
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    parts_of = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("id", "rep")
    told = groups.select("digest", "rep", "low", "copies").join(counts, "rep", "left").join(parts_of, "rep", "left")
    told = settle(told.withColumn("component", F.coalesce("component", "rep")), "told")
    lowest = told.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes"))
    told = salted_join(told, lowest, ["component"], "nodes", F.col("rep"), told.count()).select(
        "digest", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = salted_join(
        rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "digest"), told, ["digest"], "copies", F.col("vec_id"), rows.count())
    alone = rows.filter("digest IS NULL OR vec_id IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    result = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
