"""What large tables need: copies of keys that are not broadcast, repeats merged by hashing, pages parsed piece by piece."""

import pyarrow as pa
from pyspark.sql import functions as F

from lexmine.operators import increment
from lexmine.operators.cleaning import merge_duplicates, repeats_merged
from lexmine.operators.joins import salted_filter, salted_join
from lexmine.sources import dom
from tests.helpers import keyword_frame


def test_copies_of_keys_are_not_broadcast(spark, capsys):
    left = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    keys = spark.range(3).select(F.col("id").alias("k"))
    joins = [salted_join(left, keys, ["k"], "id"), salted_filter(left, keys, ["k"], "id"), salted_filter(left, keys, ["k"], "id", present=False)]
    for join, present in zip(joins, (True, True, False)):
        assert sorted(r.id for r in join.collect()) == [i for i in range(100) if (i % 7 < 3) == present]
        join.explain("simple")
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_repeats_are_merged_by_hashing(spark, capsys):
    frame = keyword_frame(spark, ["abc"] * 3).withColumn("source", F.lit("s"))
    frame = frame.unionByName(frame.withColumn("seq", F.lit(None).cast("long")))
    assert sorted((r.keyword, r.seq) for r in repeats_merged(frame).where("seq IS NOT NULL").collect()) == [("abc", 0)]
    assert repeats_merged(frame).count() == 2
    (row,) = merge_duplicates(frame).collect()
    assert (row.seq, row.source, row.title) == (0, "s", "")
    (first,) = increment.state(frame).select("first.seq").collect()
    assert first.seq is None
    for made in (merge_duplicates(frame), increment.state(frame)):
        made.explain("simple")
        assert "HashAggregate(keys=[root_keyword" in capsys.readouterr().out.replace("ObjectHashAggregate", "")


def test_pages_are_parsed_piece_by_piece(spark, monkeypatch):
    pages = pa.array(["aaaa", None, "bb", "c" * 30, "", "dd"])
    monkeypatch.setattr(dom, "PIECE_BYTES", 6)
    pieces = list(dom._pieces(pages))
    assert pieces == [slice(0, 3), slice(3, 4), slice(4, 6)]
    assert list(dom._pieces(pa.array([], pa.string()))) == [slice(0, 0)]
    monkeypatch.undo()
    body = F.concat(F.lit("<b>"), F.repeat(F.lit("x"), F.lit(300_000)), F.lit("</b><i>"), F.col("id").cast("string"), F.lit("</i>"))
    rows = spark.range(0, 24, 1, 2).select("id", F.when(F.col("id") % 5 > 0, body).alias("body"))
    wanted = [("i", None, None)]
    for els in (dom.elements(F.col("body"), wanted), dom.elements_by(F.lit("k"), F.col("body"), {"k": wanted})):
        got = {r.id: r.text for r in rows.select("id", els["text"].alias("text")).collect()}
        assert got == {i: [str(i)] if i % 5 else None for i in range(24)}
