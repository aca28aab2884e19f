"""Types against many roots, incremental cleaning, ordered export."""

import csv
import glob
import itertools
import os
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmine import rules
from lexmine.functions.text import fold
from lexmine.operators import clusters, labels, roots
from lexmine.operators.cleaning import clean
from lexmine.operators.increment import CleanedTable
from lexmine.operators.ordered import with_positions
from lexmine.plans.analysis import analyze, final_keyword_map, map_order
from lexmine.sinks import files
from tests.helpers import keyword_frame


def words_of(rng, n, size):
    return ["".join(rng.choices("abc1", k=rng.randrange(1, size))) for _ in range(n)]


def root_frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "root_keyword string")


def test_types_against_all_roots(spark):
    """Random short words, so that words lie inside others; against the rule for a list of root columns."""
    rng = random.Random(5)
    names = [" ".join(words_of(rng, rng.randrange(1, 4), 5)) for _ in range(25)] + ["", "   ", "ABC  a1\tx", "price", "zzz steel"]
    keywords = [" ".join(words_of(rng, rng.randrange(1, 5), 7)) for _ in range(400)] + ["used abc", "price list", "steel zzz", "zzzsteelx", "ab", "größe zzz"]
    keywords += [f"{n} x".lower() for n in names if n.strip()]
    frame = spark.createDataFrame([(k,) for k in keywords + keywords[:50]], "keyword string")
    kw = F.col("keyword")
    literal = [F.lit(n) for n in names if n.strip()]
    want = frame.distinct().select("keyword", labels.keyword_type(kw, *literal, match=fold(kw)).alias("keyword_type"))
    got = roots.classify(frame, root_frame(spark, names))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.keyword_type for r in got.collect()} >= {rules.CORE, rules.LOW_INTENT, rules.INDUSTRIAL, rules.LONG_TAIL}


def test_types_without_roots(spark):
    frame = spark.createDataFrame([("abc",), ("used abc",), ("a b c d",)], "keyword string")
    got = sorted(map(tuple, roots.classify(frame, root_frame(spark, [])).collect()))
    assert got == [("a b c d", rules.LONG_TAIL), ("abc", rules.INDUSTRIAL), ("used abc", rules.LOW_INTENT)]
    assert roots.classify(frame.limit(0), root_frame(spark, ["abc"])).collect() == []


def test_no_comparison_of_every_keyword_with_every_root(spark, capsys):
    frame = spark.range(10).select(F.col("id").cast("string").alias("keyword"))
    roots.classify(frame, root_frame(spark, ["a b", "c"])).explain("simple")
    plan = capsys.readouterr().out
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def many(spark, n=300, seed=3):
    rng = random.Random(seed)
    tails = ["Price", "for  sale", "&amp; parts", "used", "***", "how to", "x" * 130, "ÉLAN", "a b c", ""]
    frame = keyword_frame(spark, [f"w{rng.randrange(40)} {rng.choice(tails)}" if rng.random() < 0.9 else "how to" for _ in range(n)])
    root = F.concat(F.lit("root "), (F.col("seq") % 5).cast("string"))
    return frame.withColumn("root_keyword", root).withColumn("source", F.concat(F.lit("s"), (F.col("seq") % 7).cast("string")))


def test_batches_in_any_order_clean_like_one(spark, tmp_path):
    every = many(spark)
    want = sorted(map(tuple, clean(every).select(*every.columns).collect()))
    for n, order in enumerate(itertools.permutations([0, 1, 2])):
        if n in (0, 3):
            table = CleanedTable(spark, str(tmp_path / f"t{n}"), every.schema, buckets=4)
            for batch in (*order, order[0]):
                table.add(every.where(F.col("seq") % 3 == batch))
            assert sorted(map(tuple, table.keywords().collect())) == want


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    every = many(spark)
    table = CleanedTable(spark, str(tmp_path / "t"), every.schema, buckets=64)
    assert len(table.add(every)) <= 5
    assert len(table.add(every.where("root_keyword = 'root 1'"))) == 1
    assert table.add(every.limit(0)) == []
    assert table.keywords().count() == clean(every).count()
    empty = CleanedTable(spark, str(tmp_path / "e"), every.schema)
    assert empty.keywords().collect() == [] and empty.keywords().columns == every.columns


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_positions_are_the_places_in_the_order(spark, partitions):
    frame = spark.range(200).select((F.col("id") * 37 % 101).alias("a"), F.col("id").cast("string").alias("b")).repartition(7)
    rows = with_positions(frame, "a", F.desc("b"), partitions=partitions).collect()
    want = sorted(((r.a, r.b) for r in rows), key=lambda r: (r[0], [-ord(c) for c in r[1]] + [1]))
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(1, 201))
    assert with_positions(frame.limit(0), "a", partitions=partitions).collect() == []


def test_ordered_export_finds_any_row(spark, tmp_path):
    final = final_keyword_map(analyze(many(spark)), sort=False)
    path = str(tmp_path / "map")
    assert files.write_ordered_csv(final, path, map_order(), rows_per_part=10)
    want = [r.keyword for r in final_keyword_map(analyze(many(spark))).collect()]
    parts = sorted(p for p in os.listdir(path) if p.startswith("part="))
    assert parts == [f"part={n:09d}" for n in range(-(-len(want) // 10))]
    got = []
    for part in parts:
        (name,) = glob.glob(f"{path}/{part}/*.csv")
        with open(name, newline="", encoding="utf-8") as f:
            got.append([r["keyword"] for r in csv.DictReader(f)])
    assert [len(g) for g in got[:-1]] == [10] * (len(got) - 1) and sum(got, []) == want
    assert not files.write_ordered_csv(final.limit(0), str(tmp_path / "none"), map_order()) and not os.path.exists(tmp_path / "none")


def test_limits_of_every_root(spark):
    frame = spark.createDataFrame([(f"r{n}", i) for n in (1, 2, 3, 10, 21, 60) for i in range(n)], "root_keyword string, i int")
    got = {r.root_keyword: (r.rows, r.clusters, r.components) for r in clusters.limits(frame).collect()}
    for n in (3, 10, 21, 60):
        k = clusters.cluster_count(n)
        assert got[f"r{n}"] == (n, k, clusters.component_count(n, k))
    assert got["r1"] == (1, 1, 0) and got["r2"] == (2, 1, 0)


def test_products_of_sparse_rows_take_no_dense_rows():
    from lexmine.operators.cluster_fit import gram_product, scores

    rng = np.random.default_rng(3)
    lengths, width = rng.integers(0, 6, 3000), 20_000
    idx = np.concatenate([rng.choice(width, n, replace=False) for n in lengths]).astype(np.int64)
    chunk, basis = {"lengths": lengths, "idx": idx, "weight": rng.random(len(idx))}, rng.standard_normal((width, 3))
    dense = np.zeros((len(lengths), width), np.float32)
    dense[np.repeat(np.arange(len(lengths)), lengths), idx] = chunk["weight"]
    assert np.allclose(scores(chunk, basis), dense @ basis, atol=1e-5)
    assert np.allclose(gram_product(chunk, basis), dense.T @ (dense @ basis), atol=1e-4)
    tracemalloc.start()
    gram_product(chunk, basis)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6


def test_scripts_of_a_page_are_parsed_once(spark):
    from lexmine.sources.dom import ELEMENT_TYPE
    from lexmine.sources.markets import script_names

    asked = spark.createDataFrame([(None,)], f"els {ELEMENT_TYPE}").select(script_names(F.col("els")).alias("names"))
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1
