"""Secrets by rules and by a linear-chain conditional random field over the tokens of a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.spans import TYPE, Reach, digest

KINDS = ["assign", "access", "hex"]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# The same rules for the choice of the training sample.
_ANY = r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6})|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

BEGIN, INSIDE, OUTSIDE = range(3)
BUCKETS = 4096
# Characters whose features are made together; tokens of all texts of a batch are decoded side by side.
CHARS_AT_ONCE = 1 << 21


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each rule that do not overlap within their kind; one that fails its length is dropped."""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return found


# --- features -------------------------------------------------------------------------------------------------------

_LENGTHS = np.array([2, 4, 8, 16, 20, 24, 32, 48])
_SIZES = (len(_LENGTHS) + 1, 5, 4, 2, 3)  # length, share of digits, case, hex, changes between letters and digits
_WORDS = int(np.prod(_SIZES))
SHAPES = _WORDS + 64  # the rest: what a token of other characters begins with
FILES = 27


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 blank, 1 in words, 2 other; counts of digits, capitals and small letters; hex and class."""
    kind = np.full(0x110000, 2, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isspace() or point < 32:
            kind[point] = 0
        elif c.isalnum() or c in "_-+/.":
            kind[point] = 1
    cases, hexes = np.zeros(0x110000, np.uint64), np.zeros(0x110000, np.uint64)
    for c in "0123456789":
        cases[ord(c)] = 1
    for c in range(26):
        cases[65 + c], cases[97 + c] = 1 << 21, 1 << 42
    for c in "0123456789abcdef":
        hexes[ord(c)] = 1
    return kind, cases, hexes


_RANDOM = np.random.default_rng(7)
_BY_PLACE = _RANDOM.integers(1, 2**63, 32, np.uint64) | np.uint64(1)
_BY_CHARACTER = _RANDOM.integers(1, 2**63, 1024, np.uint64)


class Tokens:
    """Tokens of texts, one text after another: places, shapes, word buckets, and the kind of file of each."""

    def __init__(self, texts: list[str]):
        kind_of, cases_of, hexes_of = _characters()
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(sizes + 1) - sizes - 1
        kind = kind_of[codes]
        if not len(codes):
            kind = np.zeros(1, np.uint8)
            codes = np.full(1, 32, np.uint32)
        change = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
        word = kind[change[:-1]] != 0
        start, end = change[:-1][word], change[1:][word]
        owner = np.searchsorted(begin, start, "right") - 1
        is_word = kind[start] == 1
        length = end - start

        def counted(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
            return total[end] - total[start]

        cases = counted(cases_of[codes])
        field = np.uint64((1 << 21) - 1)
        digits, upper, lower = (((cases >> np.uint64(s)) & field).astype(np.int64) for s in (0, 21, 42))
        digit = cases_of[codes] == 1
        turns = np.zeros(len(codes), np.uint64)
        turns[1:] = digit[1:] != digit[:-1]
        more = counted(hexes_of[codes] + (turns << np.uint64(32)))
        hexes, turns = (more & np.uint64(0xFFFFFFFF)).astype(np.int64), (more >> np.uint64(32)).astype(np.int64)
        share = np.where(digits == 0, 0, np.where(digits == length, 4, 1 + (digits * 4 >= length) + (digits * 4 >= 3 * length)))
        case = (upper > 0) * 2 + (lower > 0)
        shape = np.searchsorted(_LENGTHS, length, "right")
        for size, value in zip(_SIZES[1:], (share, case, hexes == length, np.minimum(2, (turns * 10 >= length) + (turns * 10 >= 3 * length)))):
            shape = shape * size + value
        self.shape = np.where(is_word, shape, _WORDS + (codes[start] & 63)).astype(np.int32)

        place = np.arange(len(codes)) - np.repeat(change[:-1], np.diff(change))
        small = codes + 32 * ((codes >= 65) & (codes <= 90))
        hashed = counted(np.where(place < 32, _BY_CHARACTER[small & 1023] * _BY_PLACE[np.minimum(place, 31)], 0))
        bucket = ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        self.bucket = np.where(length < 16, bucket, 0).astype(np.int32)
        self.start, self.end, self.owner = (start - begin[owner]).astype(np.int32), (end - begin[owner]).astype(np.int32), owner
        self.counts = np.bincount(owner, minlength=len(texts))
        n = np.maximum(1, self.counts)
        numbers = np.bincount(owner, digits > 0, len(texts)) * 20 / n
        marks = np.bincount(owner, ~is_word, len(texts)) * 10 / n
        self.file = (np.digitize(numbers, [1, 4]) * 9 + np.digitize(marks, [2, 6]) * 3 + np.digitize(n, [100, 1000])).astype(np.int32)

    def features(self) -> list[np.ndarray]:
        """For each token its place in each weight table; the last row of a table stands for the end of the text."""
        first = np.zeros(len(self.owner), bool)
        first[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = True
        last = np.roll(first, -1)

        def before(values: np.ndarray, edge: int) -> np.ndarray:
            return np.where(first, edge, np.roll(values, 1))

        def after(values: np.ndarray, edge: int) -> np.ndarray:
            return np.where(last, edge, np.roll(values, -1))

        prior = before(self.bucket, BUCKETS)
        return [
            self.shape, before(self.shape, SHAPES), after(self.shape, SHAPES),
            self.bucket, prior, before(prior, BUCKETS), after(self.bucket, BUCKETS), self.file[self.owner],
        ]


TABLES = [SHAPES + 1] * 3 + [BUCKETS + 1] * 4 + [FILES]


@lru_cache(maxsize=1)
def _parts() -> np.ndarray:
    """The single features of each shape, beside the shape itself: places in a table of their own."""
    shape = np.arange(_WORDS)
    columns, base = [], sum(_SIZES)
    for size in reversed(_SIZES):
        base -= size
        columns.append(base + shape % size)
        shape = shape // size
    parts = np.full((SHAPES + 1, len(_SIZES)), sum(_SIZES))
    parts[:_WORDS] = np.stack(columns, 1)
    return parts


# --- the field ------------------------------------------------------------------------------------------------------

Field = tuple[list[np.ndarray], np.ndarray]


def emissions(features: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    total = tables[0].take(features[0], 0)
    for table, places in zip(tables[1:], features[1:]):
        total += table.take(places, 0)
    return total


def fit(texts: list[str], rounds: int = 30, length: int = 64, rate: float = 0.5, ridge: float = 1e-4) -> Field | None:
    """Weights from texts whose secrets the base rules mark: the likelihood of the tags is climbed by adaptive steps.

    Texts are cut in sequences of `length` tokens. None if no text has a secret.
    """
    tokens = Tokens(texts)
    tags = np.full(len(tokens.owner), OUTSIDE)
    edges = np.cumsum(tokens.counts)
    for k, text in enumerate(texts):
        span = slice(edges[k] - tokens.counts[k], edges[k])
        for _, _, end, value in sorted(base_spans(text), key=lambda s: (s[3], s[2])):
            hit = np.flatnonzero((tokens.start[span] < end) & (tokens.end[span] > value)) + span.start
            fresh = hit[tags[hit] == OUTSIDE]
            if len(fresh) == len(hit) and len(hit):
                tags[hit] = INSIDE
                tags[hit[0]] = BEGIN
    if not (tags == BEGIN).any():
        return None
    features = tokens.features()
    # sequences side by side; the place one past the last token pads
    n = len(tags)
    within = np.arange(n) - np.repeat(edges - tokens.counts, tokens.counts)
    fresh = np.flatnonzero(within % length == 0)
    sizes = np.diff(np.append(fresh, n))
    rows = np.arange(length)[None, :] + fresh[:, None]
    real = np.arange(length)[None, :] < sizes[:, None]
    rows = np.where(real, rows, n)
    padded = [np.append(f, 0)[rows] for f in features]
    tag = np.append(tags, OUTSIDE)[rows]
    parts = _parts()
    weights = [np.zeros((size, 3)) for size in TABLES] + [np.zeros((sum(_SIZES) + 1, 3)) for _ in range(3)] + [np.zeros((4, 3))]
    squares = [np.full_like(w, 1e-2) for w in weights]
    goal = np.eye(3)[tag] * real[..., None]
    joined = real[:, 1:]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (tag[:, :-1][joined], tag[:, 1:][joined]), 1)
    begun = np.eye(3)[tag[:, 0]].sum(0)
    scale = 1 / (tags != OUTSIDE).sum()

    def total() -> list[np.ndarray]:
        return [w + weights[8 + k][parts].sum(1) if k < 3 else w for k, w in enumerate(weights[:8])]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis)
        return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))

    for _ in range(rounds):
        score = emissions(padded, total()) * real[..., None]
        move = weights[11]
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + move[3]
        for t in range(1, length):
            step = lse(ahead[:, t - 1, :, None] + move[:3], 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = lse(move[:3] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(real[:, t + 1, None], step, 0)
        whole = lse(ahead[:, -1], 1)
        state = np.exp(ahead + back - whole[:, None, None]) * real[..., None]
        both = np.exp(
            ahead[:, :-1, :, None] + move[:3] + (score[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        ) * joined[..., None, None]
        error = (goal - state)[real]
        steps = []
        for places, size in zip(padded, TABLES):
            at = places[real]
            steps.append(np.stack([np.bincount(at, error[:, s], size) for s in range(3)], 1))
        for k in range(3):
            steps.append(np.stack([
                sum(np.bincount(parts[:, c], steps[k][:, s], sum(_SIZES) + 1) for c in range(len(_SIZES))) for s in range(3)], 1))
        steps.append(np.vstack([pairs - both.sum((0, 1)), begun - state[:, 0].sum(0)]))
        for w, g, q in zip(weights, steps, squares):
            g = g * scale - ridge * w
            q += g * g
            w += rate * g / np.sqrt(q)
    return [t.astype(np.float32) for t in total()], weights[11].astype(np.float32)


def viterbi(score: np.ndarray, counts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of every text; texts are decoded side by side, the longest first."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    begin = (np.cumsum(counts) - counts)[order]
    tags = np.full(len(score), OUTSIDE, np.int8)
    from_state = np.zeros((len(score), 3), np.int8)
    alive = int((sizes > 0).sum())
    if not alive:
        return tags
    best = score[begin[:alive]] + move[3]
    ends = np.zeros((len(counts), 3), np.float32)
    longest = int(sizes[0])
    still = np.searchsorted(-sizes, -np.arange(longest + 1), "left")  # texts with more than t tokens
    arrive = [np.ascontiguousarray(move[:3, s]) for s in range(3)]
    for t in range(1, longest):
        now = int(still[t])
        if now < len(best):
            ends[now:len(best)] = best[now:]
            best = best[:now]
        at = begin[:now] + t
        fresh = np.empty_like(best)
        for s in range(3):
            via = best + arrive[s]
            pick = via.argmax(1)
            from_state[at, s] = pick
            fresh[:, s] = via[np.arange(now), pick]
        best = fresh + score[at]
    ends[:len(best)] = best
    state = ends[:alive].argmax(1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        now = int(still[t])
        at = begin[:now] + t
        tags[at] = state[:now]
        if t:
            state[:now] = from_state[at, state[:now]]
    return tags


def tagged_spans(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """For each text the places that the field tags as secrets."""
    tables, move = field
    groups, size = [[]], 0
    for k, text in enumerate(texts):
        if size + len(text) > CHARS_AT_ONCE and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(k)
        size += len(text) + 1
    scores, counts, starts, ends = [], [], [], []
    for group in groups:
        tokens = Tokens([texts[k] for k in group])
        scores.append(emissions(tokens.features(), tables))
        counts.append(tokens.counts)
        starts.append(tokens.start)
        ends.append(tokens.end)
    counts = np.concatenate(counts)
    start, end = np.concatenate(starts), np.concatenate(ends)
    tags = viterbi(np.concatenate(scores), counts, move)
    edges = np.cumsum(counts)
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    hits = np.flatnonzero(tags != OUTSIDE)
    for k, i in zip(np.searchsorted(edges, hits, "right").tolist(), hits.tolist()):
        goes_on = tags[i] == INSIDE and found[k] and tags[i - 1] != OUTSIDE and found[k][-1][1] == end[i - 1]
        if goes_on:
            found[k][-1] = (found[k][-1][0], int(end[i]))
        else:
            found[k].append((int(start[i]), int(end[i])))
    return found


# --- on tables ------------------------------------------------------------------------------------------------------

def training_texts(docs: DataFrame, text_col: str, rows: int, texts: int, chars: int) -> list[str]:
    """Windows of `chars` characters: around the first secret of `texts` texts with one, and of twice as many without.

    They are taken from about `rows` rows, those whose text's hash is in the share of all hashes that gives so many;
    copies count once. What reaches the driver is bounded by 3 x texts x chars.
    """
    n = max(1, docs.count())
    parts = 1 << 30
    kept = docs.select(F.col(text_col).alias("text")).dropna().withColumn("h", F.xxhash64("text"))
    kept = kept.filter(F.pmod("h", F.lit(parts)) < min(parts, parts * rows // n))
    at = F.regexp_instr("text", F.lit(_ANY))
    found = kept.select("h", at.alias("at"), F.substring(F.col("text"), F.greatest(at - chars // 2, F.lit(1)), F.lit(chars)).alias("part"))
    found = found.groupBy("h").agg(F.min_by("part", "part").alias("part"), F.max("at").alias("at"))
    marked = found.filter("at > 0").orderBy("h").limit(texts)
    plain = found.filter("at = 0").orderBy("h").limit(2 * texts)
    return [r["part"] for r in marked.unionByName(plain).select("part").collect()]


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000, texts: int = 300, chars: int = 600,
) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row.

    Spans of the base rules, and of kind crf those that the field tags and no base span overlaps. The field is taught
    by a bounded sample (see training_texts) that the base rules label; with no labelled secret only base spans are
    found. Whole texts are tagged. A null or empty text has no spans; repeated rows and null ids give rows like any
    other; other columns are not read.
    """
    field = fit(training_texts(docs, text_col, rows, texts, chars))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a fixed number of weights

    @F.arrow_udf(TYPE)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            yield pa.array(all_spans(["" if t is None else t for t in batch.to_pylist()], shared.value), kind)

    return docs.select(F.col(id_col).alias("doc_id"), found.asNondeterministic()(F.col(text_col)).alias("spans"))


def all_spans(texts: list[str], field: Field | None) -> list[list[dict]]:
    tagged = tagged_spans(texts, field) if field and texts else [[] for _ in texts]
    out = []
    for text, extra in zip(texts, tagged):
        base = base_spans(text)
        spans = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b, _ in base]
        reach = Reach((a, b) for _, a, b, _ in base)
        spans += [{"kind": "crf", "start": a, "end": b, "base": False} for a, b in extra if reach.before(b) <= a]
        out.append(spans)
    return out


def secrets_digest(docs: DataFrame) -> DataFrame:
    return digest(find_secrets(docs), KINDS, by_kind=False)
