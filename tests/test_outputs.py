import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from lexmine import rules
from lexmine.operators import clusters, features, reports
from lexmine.operators.cluster_fit import fit
from lexmine.plans.analysis import analyze, cluster
from lexmine.plans.mining import mine
from lexmine.sinks import files
from lexmine.streaming.ingest import label_stream, land_stream
from tests.helpers import keyword_frame, response, responses

GROUPS = ["hydraulic", "banana", "quartz", "xylophone"]


def planted(spark):
    words = [f"{w} {i % 9}{i}" for i in range(40) for w in GROUPS]
    return keyword_frame(spark, words)


def test_planted_groups_are_recovered_with_any_chunks(spark):
    """A root of one chunk and a root of several give the same clusters, not only the same groups."""
    whole = sorted(map(tuple, fit(planted(spark), n_clusters=4).collect()))
    groups = {}
    for _, keyword, cluster_id in whole:
        groups.setdefault(keyword.split()[0], set()).add(cluster_id)
    assert len(whole) == 160 and all(len(ids) == 1 for ids in groups.values())
    assert {i for ids in groups.values() for i in ids} == {0, 1, 2, 3}
    assert sorted(map(tuple, fit(planted(spark), n_clusters=4, chunk_rows=60).collect())) == whole
    # more chunks than are added up at once
    assert sorted(map(tuple, fit(planted(spark), n_clusters=4, chunk_rows=8).collect())) == whole


def test_no_keyword_is_lost_to_the_vocabulary(spark, monkeypatch):
    rows = features.tfidf(planted(spark), max_features=3).collect()
    assert len(rows) == 160 and any(not r.terms for r in rows) and all(len(r.terms) <= 3 for r in rows)
    monkeypatch.setattr(features.tfidf, "__defaults__", (*features.tfidf.__defaults__[:1], 3, *features.tfidf.__defaults__[2:]))
    assert fit(planted(spark), n_clusters=4).count() == 160
    assert cluster(analyze(planted(spark)), n_clusters=4).count() == analyze(planted(spark)).count()


def test_same_seed_same_clusters_in_any_partitioning(spark):
    def ids(df):
        return sorted(map(tuple, fit(df, n_clusters=5).collect()))

    assert ids(planted(spark)) == ids(planted(spark).repartition(5))


def test_small_roots_and_labels(spark):
    both = keyword_frame(spark, ["one", "two"], root="tiny").union(planted(spark))
    rows = cluster(analyze(both)).collect()
    assert {(r.cluster_id, r.cluster_label) for r in rows if r.root_keyword == "tiny"} == {(0, "cluster_0")}
    assert clusters.small_clusters(both).count() == 2
    for r in rows:
        if r.root_keyword != "tiny":
            assert 0 <= r.cluster_id < 20 and r.cluster_label.startswith(f"[{r.cluster_id}] ")


def test_limits():
    assert [clusters.cluster_count(n) for n in (3, 21, 500)] == [2, 20, 20]
    assert clusters.cluster_count(500, 80) == 50
    assert [clusters.component_count(n, clusters.cluster_count(n)) for n in (3, 500)] == [2, 20]


def test_label_prefers_short_then_first(spark):
    df = keyword_frame(spark, ["a b c d", "xx yy", "zz ww", "long one two", "e f g h i"]).withColumn("cluster_id", F.expr("int(seq >= 4)"))
    got = {r.cluster_id: r.cluster_label for r in clusters.labels(df).collect()}
    assert got == {0: "[0] xx yy", 1: "[1] e f g h i"}


@pytest.mark.parametrize("raw, clean, text", [
    (8, 7, "12.5%"), (16, 7, "56.2%"), (16, 9, "43.8%"), (2000, 1993, "0.3%"), (1000, 432, "56.8%"), (10, 10, "0.0%"), (3, 1, "66.7%"),
    (400, 399, "0.2%"), (2000, 1, "100.0%"), (0, 0, "N/A"),
])
def test_rate_text(spark, raw, clean, text):
    df = spark.createDataFrame([(raw, clean)], "raw long, clean long")
    got = df.select(reports.dedup_rate(F.col("raw"), F.col("clean"))[1]).first()[0]
    assert got == text
    if raw:
        assert got == f"{(1 - clean / max(raw, 1)) * 100:.1f}%"


def test_ranking_beyond_the_pushed_limit(spark):
    df = spark.range(5000).select(F.lit("r").alias("g"), F.col("id").cast("string").alias("keyword"), "id")
    got = reports.ranked(df, ["g"], [F.col("id")], 1500)
    assert sorted((r.rank, r.id) for r in got.collect()) == [(i + 1, i) for i in range(1500)]


def read_csv(path):
    rows = []
    for name in glob.glob(f"{path}/*.csv"):
        with open(name, newline="", encoding="utf-8") as f:
            rows += list(csv.DictReader(f))
    return rows


def test_csv_round_trip(spark, tmp_path):
    df = keyword_frame(spark, ['say "hi", you', " padded ", "plain"]).withColumn("extra", F.lit("e"))
    path = str(tmp_path / "out")
    assert files.write_csv(df, path)
    rows = read_csv(path)
    assert list(rows[0])[:16] == rules.OUTPUT_COLUMNS and list(rows[0])[16:] == ["extra"]
    assert {r["keyword"] for r in rows} == {'say "hi", you', " padded ", "plain"}
    assert {r["collected_at"] for r in rows} == {"2024-01-01T10:00:00.500000"} and {r["cluster_id"] for r in rows} == {""}
    assert not files.write_csv(df.limit(0), str(tmp_path / "none")) and not os.path.exists(tmp_path / "none")
    per_root = str(tmp_path / "roots")
    assert files.write_csv_per_root(df, per_root) and not files.write_csv_per_root(df.limit(0), str(tmp_path / "no_roots"))
    assert [r.keyword for r in files.root_rows(spark, per_root, "scissor lift", ["extra"]).collect()] == ['say "hi", you', " padded ", "plain"]
    assert files.root_rows(spark, per_root, "other").count() == 0


def test_streamed_labels_equal_batch_labels(spark, tmp_path):
    df = keyword_frame(spark, ["Scissor &amp; lift", "how to", "steel price list today"])
    source = str(tmp_path / "in")
    df.write.parquet(source)
    stream = label_stream(spark.readStream.schema(df.schema).parquet(source))
    land_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("keyword", "keyword_type", "page_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, label_stream(df).select("keyword", "keyword_type", "page_type").collect()))


def test_whole_run(spark, tmp_path):
    body = '["q",["scissor lift","scissor lift price","electric scissor lift for sale","used scissor lift","scissor lift price"]]'
    rows = responses(spark, response("google", "suggest", body), response("bing", "suggest", body, seq=1))
    roots = spark.createDataFrame([("scissor lift", 0)], "root_keyword string, position int")
    final = mine(spark, rows, roots, str(tmp_path), "2024-01-01 00:00:00")
    assert final.count() == 3 and {r.source for r in final.collect()} == {"bing_suggest|google_suggest"}
    report = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/reports/bucket=*/*.txt")))
    lines = report.split("\n")
    assert lines[:3] == ["=" * 60, "  SEO 关键词采集摘要报告", "  词根: scissor lift"]
    assert "  原始关键词:      10 条" in lines and "  去重率:      60.0%" in lines
    assert "  google                             5 条" in lines
    whole = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/summary_report/*.txt"))).split("\n")
    assert whole[1] == "  SEO 关键词采集 - 全局汇总报告" and "  · scissor lift" in whole
    assert len(read_csv(f"{tmp_path}/final_keyword_map/part=000000000")) == 3
