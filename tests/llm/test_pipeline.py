import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmine.llm.mixing import mix, mixed_documents, schedule, sizes, targets
from tests.llm.frames import columns, documents, edge_docs, edge_rows, empty_docs
from tests.llm.test_duplicates import near_wanted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(by_source, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing again and again what the stopped sources leave."""
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, found = set(names), share * sum(by_source.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= most * by_source[s]]
        for s in over or list(open_):
            found[s] = float(most * by_source[s]) if over else weight[s] * level
            open_.remove(s)
            left -= found[s]
    return found


def mixture_holds(rows, found):
    """rows: (doc_id, text, source); found: (doc_id, source, size, source_size, target, taken, by pass)."""
    assert len(found) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    total, taken = Counter(), Counter()
    for _, text, source in rows:
        total[source] += size(text)
    wanted = goals(total)
    assert Counter((d, s, size(t)) for d, t, s in rows) == Counter(f[:3] for f in found)
    for _, source, n, source_size, target, words, by_pass in found:
        assert source_size == total[source] and abs(target - wanted[source]) < 1e-6 * max(1, target)
        assert 0 <= words <= 2 * n and sum(by_pass) == words and max(by_pass) <= n
        taken[source] += words
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 0.5


NAMES = ["doc_id", "source", "size", "source_size", "target", "taken", "taken_by_pass"]


@pytest.mark.parametrize("block", [7, 256])
def test_mixture_of_documents(spark, block):
    docs = documents(spark)
    rows = columns(docs, "doc_id", "text", "source")
    mixture_holds(rows, columns(mix(docs, block=block), *NAMES))


def test_mixture_with_stopped_sources(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(30), rng.choice(["a", "b", "b", "c", "c", "c", "c", "d", None])) for i in range(300)]
    rows += [(500, "w " * 9000, "e"), (501, "w", "f"), (502, "", "g"), (503, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture_holds(rows, columns(mix(docs, block=16), *NAMES))
    again = columns(mix(docs.repartition(7), block=16), *NAMES)
    assert sorted(map(str, again)) == sorted(map(str, columns(mix(docs, block=16), *NAMES)))


def test_schedule_keeps_to_the_weights_all_along(spark):
    docs = spark.createDataFrame([(i, "w " * 100, f"s{i % 5}") for i in range(400)], "doc_id long, text string, source string")
    wanted = targets(sizes(docs, "doc_id", "text", "source"), (3, 1, 2), 1.5, 2)
    quota = {r["source_no"]: r["quota"] for r in wanted.collect()}
    order = [r["source_no"] for r in schedule(wanted, 50).orderBy("slot").collect()]
    for n in range(100, len(order), 100):
        seen = Counter(order[:n])
        assert all(abs(seen[s] - n * q / sum(quota.values())) <= 5 for s, q in quota.items())


def test_documents_are_played_where_the_points_say(spark):
    """Slots of the documents against a plain walk over golden-ratio points; another step gives other slots."""
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(120)], "doc_id long, text string, source string")
    block, quota = 50, {r[0]: r[1] for r in columns(targets(sizes(docs, "doc_id", "text", "source"), (3, 1, 2), 1.5, 2), "source", "quota")}

    def played(step):
        total, slots, count = sum(quota.values()), {}, Counter()
        edges = [0.0]
        for s in sorted(quota):
            edges.append(edges[-1] + quota[s])
        for i in range(-(-total // block)):
            u = i * step % 1.0
            s = next(s for k, s in enumerate(sorted(quota)) if edges[k] / total <= u < edges[k + 1] / total)
            if count[s] * block < quota[s]:
                slots.setdefault(s, []).append(i)
            count[s] += 1
        return slots

    found, got = columns(mixed_documents(docs, block=block, slot_col="slot"), "source", "slot"), {}
    for source, slot in found:
        got.setdefault(source, []).append(slot)
    golden = played(0.6180339887498949)
    for source, slots in golden.items():
        assert sorted(got[source])[:len(slots)] == slots  # a document is a block here
    assert any(sorted(got[s])[:len(p)] != p for s, p in played(0.5).items())


def test_mixture_of_edge_rows(spark):
    rows = [(r[0], r[1], r[3]) for r in edge_rows()]
    mixture_holds(rows, columns(mix(edge_docs(spark)), *NAMES))
    assert mix(empty_docs(spark)).count() == 0 and mixed_documents(empty_docs(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = documents(spark)
    plan = {r[0]: r[1] for r in columns(mix(docs), "doc_id", "taken")}
    texts, words = dict(columns(docs, "doc_id", "text")), Counter()
    for doc, text in columns(mixed_documents(docs), "doc_id", "text"):
        assert texts[doc].startswith(text)
        words[doc] += len(WORD.findall(text))
    assert words == Counter({d: n for d, n in plan.items() if n})


def test_rows_without_or_with_equal_ids_have_their_own_decisions(spark):
    """Every row's texts in the mix add up to the plan of its source, whatever the ids; reruns agree."""
    rng = random.Random(4)
    rows = [(rng.choice([None, None, 7, 8]), " ".join(f"w{i}" for i in range(rng.randrange(1, 60))) + f" r{k}", "en", rng.choice("ab")) for k in range(60)]
    rows += [(None, "same text", "en", "a")] * 5 + [(9, "same text", "de", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wanted = goals({s: sum(len(WORD.findall(r[1])) for r in rows if r[3] == s) for s in "ab"})
    mixed = columns(mixed_documents(docs, block=16), "doc_id", "text", "lang", "source")
    taken = Counter()
    for _, text, _, source in mixed:
        taken[source] += len(WORD.findall(text))
    assert all(abs(taken[s] - wanted[s]) <= 0.5 for s in wanted)
    # a text is whole but for one cut per source; no row is played more than twice
    pool = Counter((r[0], r[1], r[2], r[3]) for r in rows)
    whole = Counter(m for m in map(tuple, mixed) if m in pool)
    assert all(n <= 2 * pool[m] for m, n in whole.items()) and len(mixed) - sum(whole.values()) <= 2
    again = columns(mixed_documents(docs.repartition(5), block=16), "doc_id", "text", "lang", "source")
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_language_stage_loses_nothing_and_fills_languages(spark):
    schema = "doc_id long, text string, lang string, source string"
    plain = [(i, f"some words of text {i}", None, "a") for i in range(5)] + [(None, "words without an id", None, "a"), (9, "123", None, "a"), (10, None, None, "a")]
    kept = columns(corpus_pipeline.language_id(spark, spark.createDataFrame(plain, schema), ""), "doc_id", "text", "lang")
    assert sorted(map(str, kept)) == sorted(str(r[:3]) for r in plain if r[0] not in (9, 10))
    docs = documents(spark)
    blanked = docs.withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang")))
    before = dict(columns(docs, "doc_id", "lang"))
    after = dict(columns(corpus_pipeline.language_id(spark, blanked, ""), "doc_id", "lang"))
    filled = [d for d in after if d % 10 == 0 and before[d]]
    assert all(after[d] == before[d] for d in after if d % 10 and before[d]) and None not in after.values()
    assert filled and sum(after[d] == before[d] for d in filled) >= 0.9 * len(filled)


def test_rows_that_differ_beside_id_and_text(spark):
    """Of rows with one id and text the first by the other columns stays, however the rows come."""
    rows = [(1, "one text", lang, source) for lang in ("de", "en", None) for source in ("a", "b")] + [(2, "other", "en", "a")]
    schema = "doc_id long, text string, lang string, source string"
    found = {tuple(sorted(map(str, columns(corpus_pipeline.exact(spark, spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(3), ""), "doc_id", "text", "lang", "source")))) for k in range(0, 6, 2)}
    assert len(found) == 1 and len(found.pop()) == 2


def test_stages_have_the_columns_of_documents(spark, tmp_path):
    docs = documents(spark)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, kept, "/root/testdata/sf0.001")
        assert found.columns == docs.columns
        found.write.parquet(str(tmp_path / name))
        kept, before = spark.read.parquet(str(tmp_path / name)), kept
        ids, texts = [r[0] for r in columns(kept, "doc_id")], dict(columns(before, "doc_id", "text"))
        if name == "language_id":
            assert sorted(ids) == sorted(d for d, t in texts.items() if t and any(c.isalpha() for c in t))
        if name == "exact_dedup":
            last = {}
            for d in sorted(texts):
                last[texts[d]] = d
            assert sorted(ids) == sorted(last.values())
        if name == "near_dedup":
            assert sorted(ids) == [d for d, _, _, keep in near_wanted(list(texts.items()), 5) if keep]
    coded = corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001")
    assert coded.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and coded.count() == kept.count()
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, whole.collect())) == sorted(map(str, coded.collect()))


def test_stages_stand_edge_rows(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, "")
            assert found.columns == docs.columns
            rows = found.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    exact = [r[0] for r in corpus_pipeline.exact(spark, edge_docs(spark), "").collect()]
    assert sorted(exact, key=str) == sorted([3, 2, 5, 7, None, 8, 9, 10, 11], key=str)
