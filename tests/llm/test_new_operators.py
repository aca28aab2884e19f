"""Centroid clustering, hard negatives and packing under several limits, against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmine.llm.bestfit import Words, digests, fewest_bins, pack, pieces, sequences, vector_best_fit
from lexmine.llm.centroids import Bisectors, cluster, summary
from lexmine.llm.negatives import Heaps, hard_negatives, strassen
from lexmine.llm.queries import QUERIES
from tests.llm.frames import columns, edge_docs, edge_rows, empty_docs

VECTORS = "vec_id long, embedding array<double>, label int, vec array<string>, cluster string, row string, block string, place int, id string, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, ["x"], "c", "r", "b", 1, "i", 2) for i, v, l in rows], VECTORS)


def odd_vectors(dim=64, n=120, seed=3):
    """Random vectors with ties, repeats, nulls and others that take no part."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3]) for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    rows += [rows[5], rows[50], (50, rows[7][1], rows[50][2]), (None, rows[9][1], 1), (None, rows[9][1], 1)]
    rows += [(500, None, 1), (501, [], 1), (502, [None] * dim, 1), (503, [math.nan] * dim, 2), (504, [math.inf] * dim, 0), (505, rows[1][1], None), (550, rows[1][1][:5], 1), (551, rows[1][1][:5], 1)]
    return rows


def good(vec):
    return vec is not None and all(x is not None and math.isfinite(x) for x in vec)


# --- clustering -----------------------------------------------------------------------------------------------------

def plain_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if good(v) and len(v) == dim]
    key = {n: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for n, (i, v) in enumerate(kept)}
    centres = [kept[n][1] for n in sorted(key, key=lambda n: (key[n], kept[n][1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), number) for number, c in enumerate(centres))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(mine[c]) for x in zip(*mine[c])] if c in mine else centres[c] for c in range(len(centres))]
    return Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centres


@pytest.mark.parametrize("k, rounds", [(16, 3), (3, 1), (500, 2)])
def test_clusters_against_plain_search(spark, k, rounds):
    rows = odd_vectors()
    want, centres = plain_clusters(rows, k, rounds, 64, 64, 1)
    found, model = cluster(vectors(spark, rows).repartition(5), k=k, rounds=rounds)
    assert Counter(columns(found, "vec_id", "cluster", "distance")) == want
    assert model == centres


def test_summary_of_clusters(spark):
    rows = odd_vectors()
    found, model = cluster(vectors(spark, rows))
    told = summary(found, model).collect()
    totals = defaultdict(int)
    for row in told:
        totals[row["cluster"]] += row["distance"]
    for row in told:
        assert row["cluster_inertia"] == totals[row["cluster"]] and row["inertia"] == sum(totals.values())
        assert row["centroid_sha256"] == hashlib.sha256(",".join(map(str, model[row["cluster"]])).encode()).hexdigest()


def test_clusters_of_nothing_and_of_what_takes_no_part(spark):
    for rows in ([], [(1, None, 1), (2, [0.0] * 63, 1), (3, [None] * 64, 1)]):
        found, model = cluster(vectors(spark, rows))
        assert found.count() == 0 and model == [] and summary(found, model).collect() == []


def test_ties_and_equal_centroids_go_to_the_smaller_number():
    model = Bisectors([[0, 0], [4, 0], [0, 0], [0, 4]])
    winner, distance = model.nearest(np.array([[2, 0], [0, 2], [2, 2], [4, 0], [3, 3]]))
    assert winner.tolist() == [0, 0, 0, 1, 1] and distance.tolist() == [4, 4, 8, 0, 10]


def test_too_large_vectors_are_refused():
    with pytest.raises(OverflowError):
        Bisectors([[1 << 40]]).nearest(np.array([[5]]))


# --- hard negatives ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (17, 64, 33), (40, 1, 40), (65, 31, 129), (5, 0, 4), (0, 3, 2)])
@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_strassen_is_exact(shape, leaf):
    rng = np.random.default_rng(7)
    m, d, n = shape
    a, b = rng.integers(-(1 << 28), 1 << 28, (m, d)), rng.integers(-(1 << 28), 1 << 28, (d, n))
    assert (strassen(a, b, leaf) == a @ b).all()


def test_strassen_where_sums_on_the_way_leave_64_bits():
    a = np.full((32, 32), 1 << 28) * np.where(np.arange(32) % 2, 1, -1)
    b = np.full((32, 32), 1 << 28)
    assert (strassen(a, b, 1) == (a.astype(object) @ b.astype(object)).astype(np.int64)).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(5)
    scores, ids = rng.integers(0, 6, (4, 90)), np.arange(90)
    for cuts in ([30, 60], [1, 2, 80], []):
        heaps = Heaps(4, 5)
        for at in reversed(np.split(np.arange(90), cuts)):
            other = Heaps(4, 5)
            other.merge(np.arange(4), scores[:, at], ids[at], np.zeros(len(at), bool))
            heaps.join(np.arange(4), other.scores, other.ids, other.absent)
        for line in range(4):
            assert list(zip((-heaps.scores[line]).tolist(), heaps.ids[line].tolist())) == sorted(zip((-scores[line]).tolist(), ids.tolist()))[:5]


def plain_negatives(rows, scale=256, positives=5, negatives=3, low=50, high=95):
    kept = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if l is not None and good(v)]
    out = Counter()
    for n, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), i is None, i or 0, i, l == label) for m, (i, v, l) in enumerate(kept) if m != n and len(v) == len(a)]
        for minus, _, _, positive, _ in sorted(s for s in scored if s[4])[:positives]:
            window = sorted(s for s in scored if not s[4] and low * -minus <= 100 * -s[0] <= high * -minus)[:negatives]
            out.update((anchor, positive, rank, s[3], -minus, -s[0]) for rank, s in enumerate(window, 1))
    return out


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("dim", [64, 3, 1])
def test_negatives_against_all_pairs(spark, dim):
    rows = odd_vectors(dim, 230)
    found = hard_negatives(vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0)
    assert found.columns == NEGATIVES
    want = plain_negatives(rows)
    assert want and Counter(columns(found, *NEGATIVES)) == want


def test_negatives_over_many_small_blocks(spark, monkeypatch):
    from lexmine.llm import negatives

    monkeypatch.setattr(negatives, "MOST_ROWS", 8)
    monkeypatch.setattr(negatives, "MOST_ANCHORS", 2)
    monkeypatch.setattr(negatives, "ANCHOR_GROUP", 1)
    rows = [(i * 10, v, l) for i, v, l in odd_vectors(8, 150) if i is not None]
    found = hard_negatives(vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0)
    assert Counter(columns(found, *NEGATIVES)) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 2)], [(50, [1.0], 1), (2, [1.0], 2)], [(50, None, 1)], [(None, [1.0], 1)]):
        assert hard_negatives(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect() == []


# --- packing ------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(vocabulary):
    made = Tokenizer.from_str(vocabulary)
    made.encode_special_tokens = True
    return made


def plain_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


ODD = [
    "don't DON'T I'LL x's 's'S '''s we'd've", "<|endoftext|> <|startoftext|>x", "a≠b ≮ ,̧c", "İstanbul ΣΑΣ ς ﬁne ½ ² Ⅷ ٣",
    "\x00\x1c\x1d\x85\xa0 　﻿\x0bb\x0c", "größe, 'größe' (größe)'s größe's!", "é ẹ̀ ́x x́", "日本語、テキスト。한국어 ไทย",
    "🙂🙂a🙂 👩‍👩‍👧", "...!!!??? --- 1234567 1,000.5 a1b2", "퟿", "A'Š 'š š' !'s ß's 'ßs", "\n\n a\nb\r\nc\t\td  e ",
]


def test_words_equal_the_library(vocabulary, library):
    words, rng = Words(vocabulary), random.Random(11)
    alphabet = "abSsTtdlm'' .,!-=<>\n\t\r 019éÉßŠ×÷Ωςı̸̧́日🙂\xa0 \x1c"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == plain_ids(library, text), repr(text)


def test_words_of_latin_letters_are_merged_without_the_rest_of_the_library(vocabulary, library):
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]]
    marks = [chr(c) for c in range(0x21, 0x7F)]
    odd = ["Å", "K", "ẞ", "İ", "i̇", "e\u0301", "ſt", "Ⱥ", "ß", "·", "\u00ad", "\x7f", "²", "٣", "ǅ", "'s", "l'été", "<|endoftext|>"]
    words, rng = Words(vocabulary), random.Random(13)
    mixed = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(2000)]
    for piece in [*letters, *marks, *odd, *mixed, *["".join(rng.choices(marks, k=3)) for _ in range(500)]]:
        for text in (piece, f"a{piece}", f"{piece}b"):
            assert np.frombuffer(words.ask(text), "<u4").tolist() == plain_ids(library, text), text

    class Silent:
        def encode(self, *args, **kwargs):
            raise AssertionError(args)

    words.library = Silent()
    assert words.encode("A newword1, Étéxx über; (žluťoučký) kůň")


def test_words_of_long_texts(vocabulary, library, monkeypatch):
    from lexmine.llm import bestfit

    monkeypatch.setattr(bestfit, "CUT", 50)
    text = " ".join(ODD * 5)
    assert np.frombuffer(Words(vocabulary).encode(text), "<u4").tolist() == plain_ids(library, text)


def test_words_are_forgotten(vocabulary, library, monkeypatch):
    from lexmine.llm import bestfit

    monkeypatch.setattr(bestfit, "PIECES", 3)
    monkeypatch.setattr(bestfit, "WORDS", 2)
    words = Words(vocabulary)
    for text in ODD * 2:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == plain_ids(library, text)


def check_packing(rows, want, length, documents=None, cost=None):
    """Every piece of every document, in sequences without gaps or overlaps, within all limits. Returns their number."""
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    bins = defaultdict(list)
    for row in rows:
        bins[row["sequence_id"]].append((row["offset"], row["length"]))
    for placed in bins.values():
        at = 0
        for offset, size in sorted(placed):
            assert offset == at
            at += size
        assert at <= length and len(placed) <= (documents or length)
        assert cost is None or sum(size * size for _, size in placed) <= cost
    return len(bins)


def wanted(library, docs, whole):
    out = Counter()
    for doc_id, text in docs:
        n = len(plain_ids(library, text)) + 1
        out.update((doc_id, k, s, min(whole, n - s)) for k, s in enumerate(range(0, n, whole)))
    return out


@pytest.mark.parametrize("documents, cost", [(None, None), (2, None), (None, 3000), (3, 2500)])
def test_packing_of_edge_rows_under_every_limit(spark, vocabulary, library, documents, cost):
    docs = [(r[0], r[1]) for r in edge_rows()]
    whole = min(64, math.isqrt(cost)) if cost else 64
    cut = pieces(edge_docs(spark).repartition(3), vocabulary, end=1, length=64, cost=cost)
    rows = pack(cut, 64, documents, cost).collect()
    check_packing(rows, wanted(library, docs, whole), 64, documents, cost)


def test_packing_of_documents_is_tight_and_exact(spark, vocabulary, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = QUERIES["op13_best_fit"](spark, "/root/testdata/sf0.001").collect()
    texts = columns(docs, "doc_id", "text")
    used = check_packing(rows, wanted(library, texts, 4096), 4096)
    assert used <= 1 + math.ceil(sum(r["length"] for r in rows) / 4096)
    import zlib

    by_id = {i: np.array([*plain_ids(library, t), 1], "<u4") for i, t in texts}
    for row in rows:
        assert row["ids_crc32"] == zlib.crc32(by_id[row["doc_id"]][row["start"]:row["start"] + row["length"]].tobytes())


def test_sequences_hold_all_ids(spark, vocabulary, library):
    packed = pack(pieces(edge_docs(spark), vocabulary, end=1, length=64), 64)
    want = Counter()
    for doc_id, text in [(r[0], r[1]) for r in edge_rows()]:
        ids = [*plain_ids(library, text), 1]
        want.update((doc_id, s, tuple(ids[s:s + 64])) for s in range(0, len(ids), 64))
    got = Counter()
    for row in sequences(packed).collect():
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert len(ids) == row["n_tokens"] <= 64
        for doc_id, start, at, stop in zip(row["doc_ids"], row["starts"], row["offsets"], [*row["offsets"][1:], len(ids)]):
            got[doc_id, start, tuple(ids[at:stop])] += 1
    assert got == want


def test_packing_in_many_shards_and_of_nothing(spark, vocabulary, library):
    cut = pieces(edge_docs(spark), vocabulary, end=1, length=64)
    rows = pack(cut, 64, shard_tokens=40, shard_pieces=3).collect()
    check_packing(rows, wanted(library, [(r[0], r[1]) for r in edge_rows()], 64), 64)
    assert pack(digests(pieces(empty_docs(spark), vocabulary, end=1))).collect() == []
    with pytest.raises(ValueError):
        pack(spark.sql("SELECT 1L AS doc_id, 5000L AS length"))


def plain_fit(sizes, limits, weights, rule):
    """The same rule, one item and one bin at a time, in fractions of floating point."""
    order = sorted(range(len(sizes)), key=lambda i: (sum(w * s / m for w, s, m in zip(weights, sizes[i], limits)), sizes[i][::-1], i), reverse=True)
    bins, previous, last = [], None, None
    for i in order:
        fits = [b for b, left in enumerate(bins) if all(x >= y for x, y in zip(left, sizes[i]))]
        if previous == sizes[i] and last in fits:
            best = last
        elif fits:
            key = (lambda b: sum(w * ((x - y) / m) ** 2 for w, x, y, m in zip(weights, bins[b], sizes[i], limits))) if rule == "norm" else (
                lambda b: -sum(w * x * y / m / m for w, x, y, m in zip(weights, bins[b], sizes[i], limits)))
            best = min(fits, key=key)
        else:
            bins.append(list(limits))
            best = len(bins) - 1
        bins[best] = [x - y for x, y in zip(bins[best], sizes[i])]
        previous, last = sizes[i], best
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_against_a_plain_search(rule):
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 200):
        sizes = np.stack([rng.integers(1, 90, n), rng.integers(0, 4, n), rng.integers(0, 40, n)], 1)
        limits, weights = np.array([100, 6, 60]), np.array([1.0, 0.5, 0.7])
        owner, bins = vector_best_fit(sizes, limits, weights, rule)
        assert bins == len(set(owner.tolist()))
        for b in range(bins):
            assert (sizes[owner == b].sum(0) <= limits).all()
        assert abs(bins - plain_fit([tuple(s) for s in sizes.tolist()], limits.tolist(), weights.tolist(), rule)) <= 1
    assert fewest_bins(np.array([[50, 1, 1]] * 4), np.array([100, 6, 60]))[1] == 2
