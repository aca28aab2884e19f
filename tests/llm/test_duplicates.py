import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmine.llm import neardup
from lexmine.llm.common import components
from lexmine.llm.exact import build_index, directory, exact_dedup, routed
from lexmine.llm.neardup import near_duplicates
from lexmine.llm.shingles import shingle_sets
from lexmine.llm.vectors import near_vectors
from tests.llm.frames import documents, edge_docs, edge_rows, empty_docs


def parts(ids, linked):
    """The smallest id reachable from each, by plain search."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    wanted = parts({i for p in links for i in p}, links)
    assert found == {i: c for i, c in wanted.items() if any(i in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_wanted(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1] or "", []).append(row[0])
    out = []
    for row in rows:
        ids = groups[row[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((row[0], keep, len(ids), row[0] == keep, hashlib.sha256((row[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("key", [F.xxhash64, lambda text: F.length(text).cast("long"), lambda text: F.lit(7).cast("long")])
@pytest.mark.parametrize("capacity", [2, 4096])
def test_exact_dedup_with_good_and_bad_hashes(spark, key, capacity):
    found = exact_dedup(edge_docs(spark), capacity=capacity, key=key)
    assert sorted((tuple(r) for r in found.collect()), key=str) == exact_wanted(edge_rows())


def test_exact_dedup_of_documents_and_of_nothing(spark):
    docs = documents(spark)
    found = sorted((tuple(r) for r in exact_dedup(docs, capacity=16).collect()), key=str)
    assert found == exact_wanted([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert exact_dedup(empty_docs(spark)).count() == 0


def test_owners_chain_keys_of_their_range(spark):
    """Different texts of one key are links of one chain; a bucket is a range of keys; a hot text leaves in few rows."""
    texts = [f"{'x' * (i % 40)}{i % 7}" for i in range(2000)] + ["the same text everywhere"] * 1000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    rows = docs.withColumn("h", F.xxhash64(F.length("text")))
    keys = rows.groupBy("h").agg(F.count("*").alias("n_rows"))
    index, buckets, bits, total = build_index(rows, keys, 4)
    found = index.collect()
    assert total == len(texts) and sum(r["group_size"] for r in found) == total and len(found) == len(set(texts))
    chains, places = {}, {}
    for r in found:
        chains.setdefault(r["h"], []).append(r["link"])
        places.setdefault((r["h"] & (2**64 - 1)) >> (64 - bits), set()).add(r["bucket"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values()) and max(map(len, chains.values())) > 1
    assert {c: {b} for c, b in ((r["cell"], r["bucket"]) for r in buckets.collect())} == places
    sent = routed(rows, keys, total).groupBy("text").agg(F.count("*").alias("n"), F.sum("group_size").alias("size")).collect()
    wanted = {t: texts.count(t) for t in set(texts)}
    assert {r["text"]: r["size"] for r in sent} == wanted
    assert {r["text"]: r["n"] for r in sent}["the same text everywhere"] <= 9


def test_directory_splits_only_what_is_overfull(spark):
    crowded = [(i << 40,) for i in range(64)]  # all in the first bucket until deep
    apart = [((-1) ** (i % 2) * (i << 57),) for i in range(32)]
    entries = spark.createDataFrame(crowded + apart, "h long")
    cells, bits = directory(entries, 96, 8)
    rows = cells.collect()
    loads = {}
    for (h,) in crowded + apart:
        cell = (h & (2**64 - 1)) >> (64 - bits)
        row = next(r for r in rows if r["cell"] == cell)
        assert row["bucket"] == cell >> (bits - row["depth"]) << (bits - row["depth"])
        loads.setdefault((row["bucket"], row["depth"]), []).append(h)
    assert all(len(v) <= 8 or depth == bits for (_, depth), v in loads.items())
    assert len({depth for _, depth in loads}) > 1


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def shingles_of(text, n):
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def near_wanted(rows, n):
    sets = {i: shingles_of(t, n) for i, t in rows}
    linked = [
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = parts(sets, linked)
    return sorted((i, len(sets[i]), found[i], found[i] == i) for i in sets)


def near_found(spark, rows, n):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in near_duplicates(docs, words=n).collect())


def test_shingle_sets_have_the_sizes_of_word_sets():
    import pyarrow as pa

    texts = [r[1] for r in edge_rows()] + ["A b\x0bC d e F", "a a a a a a", "q w e r t " * 30_000]
    for n in (1, 4, 5):
        assert [len(s) for s in shingle_sets(pa.array(texts), n)] == [len(shingles_of(t, n)) for t in texts]
        joined = [set(s.tolist()) for s in shingle_sets(pa.array(["x y Z w v", "u x  y\nz w v"]), n)]
        assert len(joined[0] & joined[1]) == len(shingles_of("x y z w v", n))


@pytest.mark.parametrize("n", [1, 4, 5])
def test_shingle_sets_of_chunks_of_few_words(n):
    """A chunk that holds fewer words than a shingle: small arrays, and long texts, which are chunks by themselves."""
    import pyarrow as pa

    few = ["a", "a b", "A b c", "a b c d", "a b c d e"]
    together = [s.tolist() for s in shingle_sets(pa.array([*few, "and other words to fill the chunk"]), n)]
    for k, text in enumerate(few):
        for texts in ([text], [None, text, "", " "]):
            found = [s.tolist() for s in shingle_sets(pa.array(texts), n)]
            assert found == [together[k] if t == text else [] for t in texts]
    long = "x" * (1 << 20)
    texts = [f"{long} y", "a b", f"{long} y z", f"y {long}", "a b c"]
    found = [s.tolist() for s in shingle_sets(pa.array(texts), n)]
    assert found[1] == together[1] and found[4] == together[2]
    assert [len(s) for s in found] == [len(shingles_of(t, n)) for t in texts]


def test_near_duplicates_of_two_words_alone(spark):
    rows = [(1, "one two"), (2, None), (3, "One  two"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for n in (4, 5):
        found = sorted(tuple(r) for r in near_duplicates(docs, words=n).collect())
        assert found == near_wanted(rows, n)


def test_near_duplicates_of_documents(spark):
    docs = documents(spark)
    found = sorted(tuple(r) for r in near_duplicates(docs, words=4).collect())
    assert found == near_wanted([(r["doc_id"], r["text"]) for r in docs.collect()], 4)


def edited(rng, words, share):
    words = list(words)
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def test_chains_groups_and_shared_passages(spark):
    """A chain whose ends are no pair, a large group of near copies, and a passage that unrelated texts share."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, chain = [], fresh(200)
    for k in range(8):
        texts.append(chain[:])
        chain[k * 4 + 20] = f"c{k}"
    core = fresh(300)
    texts += [edited(rng, core, 0.01) for _ in range(120)] + [core, core]
    passage = fresh(60)
    texts += [fresh(15) + passage + fresh(15) for _ in range(60)]
    texts += [fresh(n) for n in (1, 1, 3, 4, 5) for _ in range(4)] + [["one"], ["one"], ["one", "two"]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for n in (4, 5):
        assert near_found(spark, rows, n) == near_wanted(rows, n)


def test_documents_with_a_common_passage_are_not_compared_in_pairs(spark, monkeypatch):
    """5,000 texts of which seven tenths are one passage: none is similar to another, but for one copy of every 50th."""
    rng, compared = random.Random(1), []
    common = " ".join(f"c{i}" for i in range(70))
    texts = [" ".join([*(f"w{rng.randrange(10**7)}" for _ in range(15)), common, *(f"w{rng.randrange(10**7)}" for _ in range(15))]) for _ in range(5000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10000 + i, t + " more") for i, t in enumerate(texts) if i % 50 == 0]
    open_groups = neardup.Search.open_groups

    def counted(self, known):
        found = open_groups(self, known)
        compared.append(sum(n * n for _, n in found.groupBy("part").count().collect()))
        return found

    monkeypatch.setattr(neardup.Search, "open_groups", counted)
    found = {r[0]: r[2] for r in near_found(spark, rows, 4)}
    assert found == {i: i - 10000 if i >= 10000 else i for i, _ in rows}
    assert compared[0] < 20 * len(rows)


@pytest.mark.parametrize(("wide", "n"), [(16, 4), (40, 2), (256, 5)])
def test_wider_lists_lose_no_link(spark, monkeypatch, wide, n):
    """Texts of many sizes around one passage, some similar, whether or not their wider sketches are whole sets."""
    monkeypatch.setattr(neardup, "WIDE", max(wide, neardup.K))
    rng = random.Random(wide)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(160):
        cut = rng.randrange(120)
        rows.append((i, " ".join([*common[:cut], *(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30))), *common[cut:][:rng.randrange(60, 121)]])))
    assert near_found(spark, rows, n) == near_wanted(rows, n)


def test_near_duplicates_of_edge_rows(spark):
    found = [tuple(r) for r in near_duplicates(edge_docs(spark)).collect()]
    assert len(found) == len(edge_rows())
    told = {r[0]: r for r in found if r[0] is not None}
    assert told[1] == (1, 0, 1, True) and told[2] == (2, 0, 2, True) and told[3] == (3, 0, 3, True)
    assert told[4][2:] == (4, True) and told[5][2:] == (4, False) and told[11][2:] == (4, False) and told[7][2] == 6
    assert [r[2:] for r in found if r[0] is None] == [(None, False)]
    assert near_duplicates(empty_docs(spark)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, digest string, rep long"


def vectors_wanted(rows, least):
    def good(row):
        v = row[1]
        return row[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    wide = any(good(r) and not 1e-30 < max(map(abs, r[1])) < 1e30 for r in rows)
    unit = {k: np.array(r[1], float if wide else np.float32).astype(float) for k, r in enumerate(rows) if good(r)}
    if wide:
        unit = {k: v / np.abs(v).max() for k, v in unit.items()}
    linked = [
        (a, b) for a, b in itertools.combinations(unit, 2)
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b])
        and unit[a] @ unit[b] / np.sqrt(unit[a] @ unit[a]) / np.sqrt(unit[b] @ unit[b]) >= least]
    found = parts(list(range(len(rows))), linked)
    low = {}
    for k, root in found.items():
        if rows[k][0] is not None:
            low[root] = min(low.get(root, rows[k][0]), rows[k][0])
    counts = np.bincount([x for p in linked for x in p], minlength=len(rows))
    own = [None if r[0] is None else low[found[k]] for k, r in enumerate(rows)]
    return sorted((r[0], int(counts[k]), own[k], own[k] == r[0]) for k, r in enumerate(rows))


@pytest.mark.parametrize("block", [16, 2048])
def test_near_vectors_against_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    rows = []
    centres = rng.normal(size=(12, 24))
    for k in range(400):
        v = rng.normal(size=24) if k % 3 else centres[k % 12] + 0.2 * rng.normal(size=24)
        rows.append((k, (v * (k % 5 + 1)).astype(np.float32).tolist(), k % 4 if k % 50 else None, "x", 1))
    rows += [(500 + k, rows[1][1], 1, "x", 1) for k in range(20)]
    rows += [(600, None, 1, "x", 1), (601, [0.0] * 24, 1, "x", 1), (602, [float("nan")] * 24, 1, "x", 1), (603, [], 1, "x", 1),
             (604, [None] + [1.0] * 23, 1, "x", 1), (605, [float("inf")] * 24, 1, "x", 1), (606, [1.0, 2.0], 1, "x", 1), (607, [2.0, 4.0], 1, "x", 1)]
    found = near_vectors(spark.createDataFrame(rows, VECTORS), block=block, sample=100, lists=5, codes=8)
    assert sorted(tuple(r) for r in found.collect()) == vectors_wanted(rows, 0.93)


def test_vectors_that_share_an_id_and_extreme_ones(spark):
    """Rows of one id are vectors of their own; very small and very large components keep their direction."""
    schema = "vec_id long, embedding array<double>, label int"
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (5, [0.0, 0.0, 1.0], 1), (5, [0.0, 0.01, 1.0], 1),
        (7, [0.0, 1e-170, 0.0], 1), (8, [3e300, 1e290, 0.0], 1), (9, [5e-324, 0.0, 0.0], 1), (9, [5e-324, 0.0, 0.0], 1), (10, [-1e308, 1e308, 0.0], 1),
        (11, [-1e-300, 1e-300, 0.0], 1), (12, [0.0, 0.0, 0.0], 1),
    ]
    found = near_vectors(spark.createDataFrame(rows, schema).repartition(3), sample=5, lists=3, codes=4, parts=2)
    assert sorted(tuple(r) for r in found.collect()) == vectors_wanted(rows, 0.93)
    told = near_vectors(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1), (3, [1.0], 1)], schema)).collect()
    assert sorted(map(str, map(tuple, told))) == sorted(map(str, [(None, 0, None, True), (None, 0, None, True), (3, 0, 3, True)]))


def test_near_vectors_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    lone = near_vectors(spark.createDataFrame([(1, None, None, "x", 1), (2, None, 3, "x", 1)], VECTORS))
    assert sorted(tuple(r) for r in lone.collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_vectors_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in near_vectors(table).collect()) == vectors_wanted(rows, 0.93)
