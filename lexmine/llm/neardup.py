"""Near-duplicate documents: bottom-k sketches, inverted lists of their values, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmine.llm.common import components, forest, salted_join, settle
from lexmine.llm.shingles import digest, shingle_sets

# Values of a sketch, and how far below the threshold an estimate from them may lie: four deviations at 64 values.
K = 64
MARGIN = 0.2
# Values of the wider sketches of documents that share lists but are left apart.
WIDE = 256
# Documents of a group that a task compares with as many others.
BLOCK = 512


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set) and sketch (its K smallest hashes)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                sizes, digests, kept = [], [], []
                for found in shingle_sets(part.column(1), words):
                    sizes.append(len(found))
                    digests.append(digest(found))
                    kept.append(found[:K])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "sketch"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and its whole set, packed."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                packed = [s.tobytes() for s in shingle_sets(part.column(1), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, packed binary")


@F.arrow_udf(T.LongType())
def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a, b)
    return pa.array([
        len(np.intersect1d(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), assume_unique=True))
        for x, y in pairs], pa.int64())


def _overlaps(ours: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """The number of common values of each two sets."""
    total = np.zeros((len(ours), len(theirs)), np.float32)
    common = np.intersect1d(np.unique(np.concatenate(ours)), np.unique(np.concatenate(theirs)), assume_unique=True)
    if not len(common):
        return total

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        found = common[at] == values
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[found], at[found]

    sides = [placed(ours), placed(theirs)]
    for first in range(0, len(common), 4096):
        grids = []
        for (row, at), n in zip(sides, total.shape):
            grid = np.zeros((n, min(4096, len(common) - first)), np.float32)
            here = (at >= first) & (at < first + 4096)
            grid[row[here], at[here] - first] = 1
            grids.append(grid)
        total += grids[0] @ grids[1].T
    return total


class Search:
    """The inverted lists of one table of representatives (rep, n_shingles, sketch)."""

    def __init__(self, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.reps, self.percent, self.least = reps, percent, percent / 100 - MARGIN
        self.lists = settle(self._lists(reps, K), "lists")
        asked = self.lists.select(F.col("rep").alias("id")).distinct()
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(asked.hint("shuffle_hash"), "id", "left_semi")
        self.sets = settle(full_sets(texts.dropDuplicates(["id"]), "id", "text", words), "sets")

    def _lists(self, sketched: DataFrame, size: int) -> DataFrame:
        """value, rep, n_shingles: the values by which a document is found, of sketches (rep, n_shingles, sketch) of `size`.

        Two sketches of which one's share `least` is in the other meet in the first values of both in any common
        order, past which less than that share is left. Rare values come first, so lists are short; values of only
        one sketch take their places but need no list. The margin of an estimate narrows with the root of the size;
        where the sketches of a document and of all that can be similar are whole sets, there is none.
        """
        values = sketched.select("rep", "n_shingles", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
        total = sketched.agg(F.sum(F.size("sketch"))).first()[0] or 0
        counts = values.groupBy("value").agg(F.count("*").alias("n_docs")).filter("n_docs > 1")
        shared = salted_join(values, settle(counts, "counts"), ["value"], "n_docs", F.col("rep"), total)
        of_doc = Window.partitionBy("rep")
        least = self.percent / 100 - MARGIN * (K / size) ** 0.5
        whole = F.expr(f"(n_shingles * {self.percent} + 99) div 100")
        needed = F.when(F.col("n_shingles") * 100 <= size * self.percent, whole).otherwise(F.floor(F.col("held") * least))
        placed = shared.withColumn("alone", F.col("held") - F.count("*").over(of_doc)).withColumn(
            "place", F.col("alone") + F.row_number().over(of_doc.orderBy("n_docs", "value")))
        return placed.filter(F.col("place") <= F.col("held") - F.greatest(F.lit(1), needed) + 1).select("value", "rep", "n_shingles")

    def _wider(self, asked: DataFrame) -> DataFrame:
        """rep, n_shingles and sketch (the WIDE smallest hashes) of the documents `asked` (rep)."""
        kind = asked.schema["rep"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [np.frombuffer(p.as_py(), np.int64) for p in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:WIDE] for s in sets], pa.list_(pa.int64()))],
                    ["rep", "n_shingles", "sketch"])

        return self.sets.withColumnRenamed("id", "rep").join(asked, "rep", "left_semi").mapInArrow(
            run, f"rep {kind}, n_shingles long, sketch array<long>")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among pairs: first by the sketch of the union, then on whole sets."""
        pairs = settle(pairs, "pairs")
        total, hubs = pairs.count(), settle(pairs.groupBy("a").agg(F.count("*").alias("n_pairs")), "hubs")
        one = self.reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")).join(hubs, "a")
        two = self.reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
        joined = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, K)
        both = F.array_intersect(joined, F.array_intersect("sketch_a", "sketch_b"))
        near = salted_join(pairs, one, ["a"], "n_pairs", F.col("b"), total).join(two, "b")
        near = near.filter(F.size(both) >= F.lit(self.least) * F.size(joined)).select("a", "b")
        sets = self.sets.select(F.col("id").alias("a"), F.col("packed").alias("set_a")).join(hubs, "a")
        near = salted_join(near, sets, ["a"], "n_pairs", F.col("b"), total).drop("n_pairs")
        near = near.join(self.sets.select(F.col("id").alias("b"), F.col("packed").alias("set_b")), "b")
        found = near.select(
            "a", "b", _overlap("set_a", "set_b").alias("same"), ((F.length("set_a") + F.length("set_b")) / 8).cast("long").alias("sizes"))
        return found.filter(F.col("same") * 100 >= (F.col("sizes") - F.col("same")) * self.percent).select("a", "b")

    def stars(self) -> DataFrame:
        """Links between the first document of each list and the others."""
        n = F.col("n_shingles")
        firsts = self.lists.groupBy("value").agg(F.min(F.struct(F.col("rep").alias("a"), n.alias("n"))).alias("first"), F.count("*").alias("n_docs"))
        pairs = salted_join(self.lists, firsts, ["value"], "n_docs", F.col("rep"), self.lists.count()).select(
            F.col("first.a").alias("a"), F.col("first.n").alias("n"), F.col("rep").alias("b"), "n_shingles")
        near_in_size = F.least("n", "n_shingles") * 100 >= F.greatest("n", "n_shingles") * self.percent
        return self.verified(pairs.filter("a <> b").filter(near_in_size).select("a", "b").distinct())

    @staticmethod
    def _apart(lists: DataFrame, known: DataFrame) -> DataFrame:
        """part, rep, component of the documents whose lists `known` leaves in several connected parts.

        Lists with one part are done. The others are put together by their largest part, `part`.
        """
        members = lists.join(known.withColumnRenamed("id", "rep"), "rep", "left").select(
            "value", "rep", F.coalesce("component", "rep").alias("component"))
        members = settle(members, "members")
        parts = members.groupBy("value", "component").agg(F.count("*").alias("n"))
        largest = parts.groupBy("value").agg(
            F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n_docs"), F.count("*").alias("parts")).filter("parts > 1")
        largest = settle(largest.select("value", F.col("top.component").alias("part"), "n_docs"), "largest")
        met = salted_join(members, largest, ["value"], "n_docs", F.col("rep"), members.count())
        return settle(met.select("part", "rep", "component").distinct(), "grouped")

    def open_groups(self, known: DataFrame) -> DataFrame:
        """part, rep, component: the groups in which documents are yet to be compared.

        A passage that many documents share fills their lists, although no two of them may be similar. So what the
        lists leave apart gets lists anew, from wider sketches: the wider, the more of a document the passage has to be.
        """
        asked = self._apart(self.lists, known).select("rep").distinct()
        wide = settle(self._wider(asked), "wide")
        return self._apart(settle(self._lists(wide, WIDE), "lists"), known)

    def rest(self, known: DataFrame) -> DataFrame:
        """A forest of the links between documents that share a list and that `known` does not connect.

        Of each open group, the documents outside its part are compared with all. They are dealt in blocks, and a task
        answers with a forest of the links that it finds, so no pairs are made into rows.
        """
        grouped = self.open_groups(known)
        outside = F.col("component") != F.col("part")
        blocks = grouped.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("m_blocks"), F.ceil(F.count_if(outside) / BLOCK).alias("q_blocks"))
        roles = grouped.select("*", F.explode(F.when(outside, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("member"))
        own = F.pmod(F.xxhash64("rep"), F.when(F.col("member"), F.col("m_blocks")).otherwise(F.col("q_blocks")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("member"), F.col("q_blocks")).otherwise(F.col("m_blocks")) - 1))
        dealt = roles.join(blocks.filter("q_blocks > 0"), "part").withColumn("own", own).withColumn("other", every).select(
            "part", F.when(F.col("member"), F.col("own")).otherwise(F.col("other")).alias("m_block"),
            F.when(F.col("member"), F.col("other")).otherwise(F.col("own")).alias("q_block"), "member", F.col("rep").alias("id"), "component")
        percent, least = self.percent, self.least

        def compared(frame: pd.DataFrame) -> pd.DataFrame:
            ours, theirs = frame[~frame["member"]], frame[frame["member"]]
            found = []
            if len(ours) and len(theirs):
                sides = [[np.frombuffer(p, np.int64) for p in f["packed"]] for f in (ours, theirs)]
                sizes = [np.array([len(s) for s in side]) for side in sides]
                needed = [np.maximum(1, np.floor(np.minimum(n, K) * least)) for n in sizes]
                small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
                apart = ours["component"].to_numpy()[:, None] != theirs["component"].to_numpy()
                near = apart & (small * 100 >= large * percent)
                near &= _overlaps(*[[s[:K] for s in side] for side in sides]) >= np.minimum.outer(*needed)
                rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if len(rows):
                    same = _overlaps([sides[0][i] for i in rows], [sides[1][j] for j in columns])
                    union = np.add.outer(sizes[0][rows], sizes[1][columns]) - same
                    i, j = np.nonzero((same * 100 >= union * percent) & near[np.ix_(rows, columns)])
                    if len(i):
                        one, two = forest(ours["id"].to_numpy()[rows[i]], theirs["id"].to_numpy()[columns[j]])
                        found.append(pd.DataFrame({"a": one, "b": two}))
            return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}).astype("int64")

        return dealt.join(self.sets, "id").groupBy("part", "m_block", "q_block").applyInPandas(compared, "a long, b long")

    def links(self) -> DataFrame:
        """Links that connect all documents that links connect.

        First every document of a list is compared with the list's first one. What is connected then needs no more
        comparing, so a group of near copies costs about one comparison per document and list; what is left apart is
        compared in blocks.
        """
        first = settle(self.stars(), "links")
        return first.unionByName(settle(self.rest(components(first)), "links"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row.

    Documents are linked when their sets of `words`-word shingles have a Jaccard similarity of `percent` per cent or
    more; component_id is the smallest id reachable, and its document stays. Equal sets are one entry of the search,
    however many rows have them. A text without words is linked with nothing. Ids identify texts: rows that repeat an
    id are to repeat its text. A row with a null id joins its text's group but is never kept; if no row of a text has
    an id, the text has no component_id.
    """
    rows = settle(sketches(docs, id_col, text_col, words), "sketches")
    groups = rows.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count("*").alias("n_rows"))
    groups = settle(groups, "groups")
    links = Search(groups.filter("rep IS NOT NULL"), docs, id_col, text_col, words, percent).links()
    found = components(links)
    placed = groups.select("digest", "rep", "n_rows").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id"), "n_rows")
    narrow = rows.select("doc_id", "n_shingles", "digest")
    linked = salted_join(narrow.filter("n_shingles > 0"), placed, ["digest"], "n_rows", F.col("doc_id"), rows.count())
    empty = narrow.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")]
    return linked.select(*columns).unionByName(empty.select(*columns))
