"""Fit one clustering per root: TF-IDF rows -> truncated SVD -> unit length -> k-means, for all roots at once.

A root's keywords are cut into chunks of a bounded size, and the fit is a sequence of steps, each one Spark job for all
roots: every chunk answers a step with a small array, the answers of a root are added up in a tree of bounded fan-in, and
the sum moves the root's state on. Nothing but the number of roots still at work reaches the driver, and the clusters
do not depend on the size of the chunks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from lexmine import rules
from lexmine.operators.clusters import MIN_ROWS, ROOT, cluster_count, component_count
from lexmine.operators.features import tfidf
from lexmine.operators.joins import salted_join
from lexmine.session import cut_lineage

CHUNK_ROWS = 20_000  # keywords whose sparse rows a task holds
FAN_IN = 16  # answers added up at once
SALTS = 32  # copies of the state of a root with many chunks
SAMPLE_ROWS = 1024  # points of a root among which k-means starts are drawn
REFINE = 10  # moves of the starts within that sample
BLOCK_ROWS = 2048  # rows whose entries are multiplied at a time
OVERSAMPLE = 10
POWER_STEPS = 4
TOLERANCE = 1e-4


# ---- arithmetic on a chunk ----------------------------------------------------------------------

def pack(frame: pd.DataFrame) -> dict:
    """The sparse rows (idx, weight) of a chunk as flat arrays; a row may be empty."""
    frame = frame.sort_values("keyword", ignore_index=True)
    lengths = np.array([len(i) for i in frame["idx"]], np.int64)
    flat = lambda name, kind: np.concatenate([np.asarray(v, kind) for v in frame[name]] + [np.zeros(0, kind)])
    return {
        "keywords": frame["keyword"].tolist(), "hashes": frame["hash"].to_numpy(np.int64), "lengths": lengths,
        "idx": flat("idx", np.int64), "weight": flat("weight", np.float64),
    }


def blocks(chunk: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries of some of a chunk's rows at a time: the row, counted from 0 in each block, the column and the weight."""
    ends = np.concatenate([[0], np.cumsum(chunk["lengths"])])
    for start in range(0, len(chunk["lengths"]), BLOCK_ROWS):
        lengths = chunk["lengths"][start:start + BLOCK_ROWS]
        part = slice(ends[start], ends[start + len(lengths)])
        yield np.repeat(np.arange(len(lengths)), lengths), chunk["idx"][part], chunk["weight"][part]


def gathered(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of values that have the same place, for places 0 to n - 1."""
    return np.stack([np.bincount(places, weights=column, minlength=n) for column in values.T], axis=1)


def scores(chunk: dict, basis: np.ndarray) -> np.ndarray:
    """The rows times the basis, from their entries alone: rows have tens of entries among thousands of columns."""
    out = np.zeros((len(chunk["lengths"]), basis.shape[1]))
    for start, (rows, columns, weights) in zip(range(0, len(out), BLOCK_ROWS), blocks(chunk)):
        part = out[start:start + BLOCK_ROWS]
        part[:] = gathered(rows, basis[columns] * weights[:, None], len(part))
    return out


def gram_product(chunk: dict, basis: np.ndarray) -> np.ndarray:
    """X'X times the basis, for the rows given."""
    projected, out = scores(chunk, basis), np.zeros_like(basis)
    for start, (rows, columns, weights) in zip(range(0, len(projected), BLOCK_ROWS), blocks(chunk)):
        out += gathered(columns, projected[start + rows] * weights[:, None], len(basis))
    return out


def start_basis(width: int, rank: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, rank))


def rotation(inner: np.ndarray, dims: int) -> np.ndarray:
    """Leading right singular directions from Y'Y."""
    values, vectors = np.linalg.eigh(inner)
    return vectors[:, np.argsort(values)[::-1][:dims]]


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest centre of each point and the squared distance to it."""
    squared = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]
    ids = squared.argmin(1)
    return ids, np.maximum(squared[np.arange(len(points)), ids], 0)


def cluster_sums(points: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.column_stack([np.bincount(ids, weights=column, minlength=k) for column in points.T])


def variates(hashes: np.ndarray, seed: int) -> np.ndarray:
    """A number in the unit interval for every keyword, the same wherever it is computed."""
    with np.errstate(over="ignore"):
        mixed = hashes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + seed)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    return (mixed.astype(np.float64) + 0.5) / 2.0**64


def least(rows: np.ndarray, n: int) -> np.ndarray:
    """The n rows with the least first number."""
    return rows[np.argsort(rows[:, 0], kind="stable")[:n]]


def starts(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """For every start k centres: points of the sample, each drawn by its squared distance to those before it, then moved
    a few times within the sample, which saves moves over all points."""
    out = np.zeros((rules.KMEANS_STARTS, k, points.shape[1]))
    for i in range(len(out)):
        rng = np.random.default_rng([seed, i])
        gap = np.ones(len(points))
        for j in range(k):
            share = np.cumsum(gap) if gap.sum() > 0 else np.cumsum(np.ones(len(points)))
            out[i, j] = points[min(np.searchsorted(share, rng.random() * share[-1], side="right"), len(points) - 1)]
            reached = ((points - out[i, j]) ** 2).sum(1)
            gap = reached if j == 0 else np.minimum(gap, reached)
        for _ in range(REFINE):
            ids, _ = nearest(points, out[i])
            sizes = np.bincount(ids, minlength=k)[:, None]
            out[i] = np.where(sizes > 0, cluster_sums(points, ids, k) / np.maximum(sizes, 1), out[i])
    return out


# ---- the steps of one root ----------------------------------------------------------------------

def begin(n: int, width: int, n_clusters: int, n_components: int, seed: int) -> dict:
    k = cluster_count(n, n_clusters)
    if n < MIN_ROWS or k < 2:
        return {"step": "done", "centres": None}
    dims = component_count(n, k, n_components)
    return {
        "step": "product", "turn": 0, "k": k, "dims": dims, "seed": seed, "basis": start_basis(width, dims + OVERSAMPLE, seed),
        "moving": np.ones(rules.KMEANS_STARTS, bool), "cost": np.full(rules.KMEANS_STARTS, np.inf), "centres": None,
    }


def project(chunk: dict, state: dict) -> dict:
    """A chunk with the points of its rows in place of the rows."""
    kept = {"keywords": chunk["keywords"], "hashes": chunk["hashes"]}
    return kept | {"points": None if state["step"] == "done" else unit(scores(chunk, state["basis"]))}


def answer(chunk: dict, state: dict) -> list[np.ndarray]:
    """What a chunk adds to the root's next step."""
    step = state["step"]
    if step == "product":
        return [gram_product(chunk, state["basis"])]
    if step == "inner":
        projected = scores(chunk, state["basis"])
        return [projected.T @ projected]
    points, k, dims = chunk["points"], state["k"], state["dims"]
    if step == "spread":
        sample = np.column_stack([variates(chunk["hashes"], state["seed"]), points])
        return [np.vstack([points.sum(0), (points**2).sum(0), np.full(dims, len(points))]), least(sample, SAMPLE_ROWS)]
    out = np.zeros((len(state["centres"]), k, dims + 2))
    for i in np.flatnonzero(state["moving"]):
        ids, gap = nearest(points, state["centres"][i])
        out[i, :, :dims] = cluster_sums(points, ids, k)
        out[i, :, dims], out[i, :, dims + 1] = np.bincount(ids, minlength=k), np.bincount(ids, weights=gap, minlength=k)
    return [out]


def together(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    """Two answers to one step as one: sums, and of two samples the least."""
    return [one[0] + two[0], *[least(np.vstack([a, b]), SAMPLE_ROWS) for a, b in zip(one[1:], two[1:])]]


def advance(state: dict, total: list[np.ndarray]) -> dict:
    """The state after a step, given the answers of all chunks."""
    state = dict(state)
    step, dims, found = state["step"], state["dims"], total[0]
    if step == "product":
        basis, _ = np.linalg.qr(found)
        state["basis"] = np.pad(basis, ((0, 0), (0, found.shape[1] - basis.shape[1])))
        state["turn"] += 1
        state["step"] = "inner" if state["turn"] == POWER_STEPS else "product"
    elif step == "inner":
        state["basis"], state["step"] = state["basis"] @ rotation(found, dims), "spread"
    elif step == "spread":
        n = found[2, 0]
        state["limit"], state["step"] = TOLERANCE * float((found[1] / n - (found[0] / n) ** 2).mean()), "move"
        state["basis"], state["turn"], state["centres"] = state["basis"][:0], 0, starts(total[1][:, 1:], state["k"], state["seed"])
    else:
        sizes, moving = found[:, :, dims:dims + 1], state["moving"]
        state["cost"] = np.where(moving, found[:, :, dims + 1].sum(1), state["cost"])
        moved = np.where(moving[:, None, None] & (sizes > 0), found[:, :, :dims] / np.maximum(sizes, 1), state["centres"])
        shift = ((moved - state["centres"]) ** 2).sum((1, 2))
        state["centres"], state["moving"] = moved, moving & (shift > state["limit"])
        state["turn"] += 1
        if not state["moving"].any() or state["turn"] == rules.KMEANS_ITERATIONS:
            best = int(state["cost"].argmin())
            state["centres"], state["step"] = state["centres"][best:best + 1], "done"
    return state


def assigned(chunk: dict, state: dict) -> np.ndarray:
    if state["centres"] is None:
        return np.zeros(len(chunk["keywords"]), np.int32)
    return nearest(chunk["points"], state["centres"][0])[0].astype(np.int32)


# ---- Spark steps --------------------------------------------------------------------------------

_IDS = f"{ROOT} string, keyword string, cluster_id int"
_STATES = f"{ROOT} string, chunks long, state binary, done boolean"
_ANSWERS = f"{ROOT} string, chunk_no long, answer binary"


def _packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    width = 1 + max((int(max(i)) for i in frame["idx"] if len(i)), default=0)
    rows, chunks = int(frame["rows"].iloc[0]), int(frame["chunks"].iloc[0])
    return pd.DataFrame({ROOT: [key[0]], "chunk_no": [int(key[1])], "rows": [rows], "chunks": [chunks], "salt": [int(key[1]) % min(chunks, SALTS)], "width": [width], "chunk": [pickle.dumps(pack(frame))]})


def _answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [pickle.dumps(answer(pickle.loads(c), pickle.loads(s))) for c, s in zip(batch["chunk"], batch["state"])]
        yield pd.DataFrame({ROOT: list(batch[ROOT]), "chunk_no": list(batch["chunk_no"]), "answer": got})


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    total = reduce(together, map(pickle.loads, frame["answer"]))
    return pd.DataFrame({ROOT: [frame[ROOT].iloc[0]], "chunk_no": [int(frame["chunk_no"].iloc[0])], "answer": [pickle.dumps(total)]})


def _moved(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    now = advance(pickle.loads(state["state"].iloc[0]), reduce(together, map(pickle.loads, frame.sort_values("chunk_no")["answer"])))
    return pd.DataFrame({ROOT: [state[ROOT].iloc[0]], "chunks": [int(state["chunks"].iloc[0])], "state": [pickle.dumps(now)], "done": [now["step"] == "done"]})


def _projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [pickle.dumps(project(pickle.loads(c), pickle.loads(s))) for c, s in zip(batch["chunk"], batch["state"])]
        yield pd.DataFrame({ROOT: list(batch[ROOT]), "chunk_no": list(batch["chunk_no"]), "salt": list(batch["salt"]), "chunk": got})


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for root, chunk, state in zip(batch[ROOT], batch["chunk"], batch["state"]):
            chunk = pickle.loads(chunk)
            ids = assigned(chunk, pickle.loads(state))
            yield pd.DataFrame({ROOT: [root] * len(ids), "keyword": chunk["keywords"], "cluster_id": ids})


def _with_states(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """Each chunk with its root's state. The chunks of a large root are dealt over several copies of it."""
    last = F.least(F.col("chunks"), F.lit(SALTS)) - 1
    every = states.select(ROOT, "state", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("salt"))
    return chunks.select(ROOT, "chunk_no", "salt", "chunk").join(every, [ROOT, "salt"])


def _summed(answers: DataFrame, most: int) -> DataFrame:
    """At most FAN_IN answers of each root, each the sum of up to FAN_IN ones at every level of a tree."""
    while most > FAN_IN:
        answers = answers.withColumn("chunk_no", F.expr(f"chunk_no div {FAN_IN}")).groupBy(ROOT, "chunk_no").applyInPandas(_added, _ANSWERS)
        most = -(-most // FAN_IN)
    return answers


def _written(states: DataFrame) -> tuple[DataFrame, int]:
    """The states as a table, and how many roots are still at work."""
    seen = Observation()
    table = cut_lineage(states.observe(seen, F.count_if(~F.col("done")).alias("live")))
    return table, seen.get["live"]


def fit(
    df: DataFrame,
    n_clusters: int = rules.N_CLUSTERS,
    n_components: int = rules.N_COMPONENTS,
    seed: int = rules.SEED,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Cluster id of every keyword: (root_keyword, keyword, cluster_id). Keywords are unique inside a root.

    Every keyword has a row, also one of whose grams the vocabulary has none. ``chunk_rows`` changes how the work is
    dealt, not the clusters.
    """
    terms = tfidf(df.select(ROOT, "keyword"), grams=False).select(
        ROOT, "keyword", F.col("terms.idx").alias("idx"), F.col("terms.weight").alias("weight"), F.xxhash64("keyword").alias("hash")
    )
    sizes = df.groupBy(ROOT).agg(F.count(F.lit(1)).alias("rows")).withColumn("chunks", F.ceil(F.col("rows") / chunk_rows))
    rows = salted_join(terms, sizes, [ROOT], "keyword").withColumn("chunk_no", F.pmod("hash", F.col("chunks")))
    kept = f"{ROOT} string, chunk_no long, rows long, chunks long, salt long, width int, chunk binary"
    chunks = cut_lineage(rows.groupBy(ROOT, "chunk_no").applyInPandas(_packed, kept))

    def begun(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            states = [begin(int(n), int(w), n_clusters, n_components, seed) for n, w in zip(frame["rows"], frame["width"])]
            yield pd.DataFrame({
                ROOT: list(frame[ROOT]), "chunks": list(frame["chunks"]), "state": [pickle.dumps(s) for s in states], "done": [s["step"] == "done" for s in states]})

    roots = chunks.groupBy(ROOT).agg(F.max("rows").alias("rows"), F.max("width").alias("width"), F.max("chunks").alias("chunks"))
    states, left = _written(roots.mapInPandas(begun, _STATES))
    most = states.agg(F.max("chunks")).first()[0] or 0
    turn, done = 0, None
    while left:
        if turn == POWER_STEPS + 1:  # all roots have their directions now
            every = states if done is None else states.unionByName(done)
            chunks = cut_lineage(_with_states(chunks, every).mapInPandas(_projected, f"{ROOT} string, chunk_no long, salt long, chunk binary"))
        fresh = states.where("done")
        done = fresh if done is None else done.unionByName(fresh)
        live = states.where("not done")
        answers = _summed(_with_states(chunks, live).mapInPandas(_answered, _ANSWERS), most)
        states, left = _written(answers.groupBy(ROOT).cogroup(live.groupBy(ROOT)).applyInPandas(_moved, _STATES))
        turn += 1
    return _with_states(chunks, states if done is None else states.unionByName(done)).mapInPandas(_told, _IDS)
