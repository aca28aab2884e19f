import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from lexmine.llm import bpe
from lexmine.llm.packing import best_fit, matrix, pack, summary, write
from lexmine.llm.queries import ranks
from tests.llm.frames import columns, documents, edge_docs, edge_rows, empty_docs

PATTERN = public_tokenizers.PATTERN
POOLS = ["ab", "abc d", "\x00\x1c\x85  　x1²", "éß日本語 ‍🙂", "the and ing tion er  ", "  \n\t\r'sS'll1", "'stremvld  '!1"]


@pytest.fixture(scope="module")
def library():
    listed = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks().splitlines())}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=listed, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(ranks(), PATTERN)


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        pool = rng.choice(POOLS)
        yield "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))


def test_the_array_split_is_the_pattern():
    compiled, several = regex.compile(PATTERN), list(texts(3000, 1))
    pieces, at = bpe.split(several)
    for text, a, b in zip(several, at, at[1:]):
        assert pieces[a:b] == compiled.findall(text)


def test_encoding_equals_the_library(codec, library):
    several = list(texts(3000, 2)) + ["a" * 5000, "ab" * 3000 + "!" * 999, " " * 4000 + "x"]
    for text, packed in zip(several, codec.encode(several)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_another_pattern_and_vocabulary():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        raw = file.read()
    listed = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    other = tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks=listed, special_tokens={})
    several = list(texts(500, 3))
    for text, packed in zip(several, bpe.Codec(raw, r"\S+|\s+").encode(several)):
        assert np.frombuffer(packed, "<u4").tolist() == other.encode_ordinary(text)


def test_adjacent_tokens_against_merging(codec, library):
    rng, vocabulary = random.Random(4), codec.vocabulary
    for _ in range(2000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        whole = vocabulary.tokens[a] + vocabulary.tokens[b]
        merged = [vocabulary.ids[bytes([c])] for c in whole]
        while True:
            joined = [vocabulary.ids.get(vocabulary.tokens[x] + vocabulary.tokens[y]) for x, y in zip(merged, merged[1:])]
            ranked = [j for j in joined if j is not None]
            if not ranked:
                break
            at = joined.index(min(ranked))
            merged[at:at + 2] = [joined[at]]
        assert vocabulary._apart(a, b) == (merged == [a, b])


def test_edge_rows_are_encoded(spark, library):
    found = columns(bpe.digests(bpe.round_trip(edge_docs(spark), ranks(), PATTERN)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    wanted = []
    for row in edge_rows():
        ids = np.array(library.encode_ordinary(row[1] or ""), "<u4")
        wanted.append((row[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert bpe.round_trip(empty_docs(spark), ranks(), PATTERN).count() == 0


def test_encode_then_decode(spark):
    docs = documents(spark)
    coded = bpe.encode(docs, ranks(), PATTERN)
    told = {r[0]: bytes(r[1]).decode() for r in bpe.decode(coded, ranks(), PATTERN).collect()}
    assert told == {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize("length", [1, 2, 7, 16, 100])
def test_best_fit_against_a_plain_search(length):
    sizes = np.random.default_rng(0).integers(1, length + 1, 400)
    rows, left = best_fit(sizes, length), []
    for piece in np.argsort(-sizes, kind="stable"):
        fits = [(room, i) for i, room in enumerate(left) if room >= sizes[piece]]
        if fits:
            left[min(fits)[1]] -= sizes[piece]
        else:
            left.append(length - sizes[piece])
    assert sorted(p for r in rows for p in r) == list(range(400))
    assert sorted(length - sizes[r].sum() for r in rows) == sorted(left)


def test_packing_loses_no_token(spark, library, tmp_path):
    docs = edge_docs(spark).unionByName(edge_docs(spark).limit(0))
    write(pack(docs, ranks(), PATTERN, length=64), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    pieces = []
    for row, ids, places in zip(rows, matrix([r["ids"] for r in rows]), matrix([r["positions"] for r in rows])):
        bounds = row["cu_seqlens"]
        assert bounds[0] == 0 and bounds[-1] <= 64 and (ids[bounds[-1]:] == 50256).all()
        for doc, start, a, b in zip(row["doc_ids"], row["starts"], bounds, bounds[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.append((doc, start, ids[a:b].tolist()))
    wanted = []
    for row in edge_rows():
        ids = library.encode_ordinary(row[1] or "")
        wanted += [(row[0], k, ids[k:k + 64]) for k in range(0, len(ids), 64)]
    assert sorted(pieces, key=str) == sorted(wanted, key=str)
    assert pack(empty_docs(spark), ranks(), PATTERN).count() == 0


def test_summary_counts_all_tokens(spark, library):
    docs = documents(spark)
    total = summary(pack(docs, ranks(), PATTERN)).selectExpr("sum(n_tokens)").first()[0]
    assert total == sum(len(library.encode_ordinary(r["text"] or "")) for r in docs.collect())
