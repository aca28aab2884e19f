"""Landing in buckets, the run ledger, attempts and the frontier in generations."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from lexmine import rules
from lexmine.plans import crawl, ledger, mining
from lexmine.plans.ledger import CLEARED, EXPORTED, LANDED, Ledger, fold, pending
from lexmine.sinks import landing, versions
from lexmine.sources import attempts
from lexmine.sources.frontier import frontier
from tests.helpers import RESPONSE, keyword_frame, response, responses


def keywords(df):
    return sorted((r.root_keyword, r.keyword) for r in df.collect())


# --- landing ------------------------------------------------------------------------------------

def test_landing_replaces_only_its_roots(spark, tmp_path):
    path = str(tmp_path / "landed")
    first = keyword_frame(spark, ["a1", "a2"], root="a").union(keyword_frame(spark, ["b1"], root="b"))
    landing.land(first, path, buckets=1)  # both roots share the bucket
    entries = landing.land(keyword_frame(spark, ["a3"], root="a"), path, buckets=1).collect()
    assert keywords(landing.read(spark, path, first.schema)) == [("a", "a3"), ("b", "b1")]
    assert sorted((r.root_keyword, r.rows) for r in entries) == [("a", 1), ("b", 1)]
    assert keywords(landing.read(spark, path, first.schema, roots=["b"])) == [("b", "b1")]
    assert landing.read(spark, path, first.schema, roots=["c"]).count() == 0
    with pytest.raises(ValueError):
        landing.land(first, path, buckets=2)


def test_many_roots_in_few_folders_and_few_rewritten(spark, tmp_path):
    path = str(tmp_path / "landed")
    frame = keyword_frame(spark, ["x"])
    many = spark.range(10_000).crossJoin(frame.drop("root_keyword")).select(F.concat(F.lit("root "), "id").alias("root_keyword"), *frame.columns[1:])
    before = {r.root_keyword: r for r in landing.land(many, path, buckets=32).collect()}
    assert len(before) == 10_000 and all(r.rows == 1 and r.files >= 1 for r in before.values())
    folders = [f for f in os.listdir(os.path.join(path, next(iter(before.values())).folder)) if f.startswith("bucket=")]
    assert sorted(folders) == sorted({f"bucket={landing.bucket_number(r, 32)}" for r in before})
    three = many.where(F.col("root_keyword").isin("root 1", "root 2", "root 3")).withColumn("keyword", F.lit("y"))
    after = {r.root_keyword: r for r in landing.land(three, path, buckets=32).collect()}
    changed = {r.bucket for r in after.values() if r.folder != before[r.root_keyword].folder}
    assert changed == {landing.bucket_number(f"root {i}", 32) for i in (1, 2, 3)} and len(after) == 10_000
    rows = landing.read(spark, path, frame.schema)
    assert rows.count() == 10_000 and rows.where("keyword = 'y'").count() == 3
    landing.prune(spark, path)
    assert landing.read(spark, path, frame.schema).count() == 10_000
    assert len(os.listdir(f"{path}/data")) == 2


def test_landing_nothing_and_odd_roots(spark, tmp_path):
    path = str(tmp_path / "landed")
    empty = keyword_frame(spark, ["x"]).limit(0)
    assert landing.land(empty, path).count() == 0 and landing.read(spark, path, empty.schema).count() == 0
    odd = keyword_frame(spark, ["x"], root="größe / =% 日本").union(keyword_frame(spark, ["y"], root=""))
    landing.land(odd, path)
    assert keywords(landing.read(spark, path, odd.schema)) == [("", "y"), ("größe / =% 日本", "x")]


def test_a_landing_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "landed")
    first = keyword_frame(spark, ["a1"], root="a")
    landing.land(first, path)

    def die(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "publish", die)
    with pytest.raises(KeyboardInterrupt):
        landing.land(keyword_frame(spark, ["a2"], root="a"), path)
    monkeypatch.undo()
    assert keywords(landing.read(spark, path, first.schema)) == [("a", "a1")]
    landing.land(keyword_frame(spark, ["a2"], root="a"), path)
    landing.prune(spark, path)
    assert keywords(landing.read(spark, path, first.schema)) == [("a", "a2")] and len(os.listdir(f"{path}/data")) == 1


def test_versions_have_one_writer(spark, tmp_path):
    path = str(tmp_path / "table")
    versions.publish(spark.range(1), path, 0)
    with pytest.raises(RuntimeError):
        versions.publish(spark.range(2), path, 0)
    versions.publish(spark.range(3), path, 1)
    assert versions.latest(spark, path) == 2 and versions.read(spark, path, "id long").count() == 3
    versions.prune(spark, path)
    assert versions.children(spark, path) == ["v00000002"]


# --- run ledger ---------------------------------------------------------------------------------



def test_folded_states(spark):
    events = [("a", 0, LANDED, 5), ("a", 0, EXPORTED, 5), ("b", 0, LANDED, 0), ("c", 0, CLEARED, 3), ("c", 1, LANDED, 4), ("d", 0, CLEARED, 2), ("a", 0, LANDED, 5)]
    want = [("a", 0, EXPORTED, 5), ("b", 0, LANDED, 0), ("c", 1, LANDED, 4), ("d", 0, CLEARED, 2)]
    for order in itertools.islice(itertools.permutations(events), 0, 5040, 1200):
        frames = [spark.createDataFrame([e], ledger.SCHEMA) for e in order]
        found = fold(*frames)
        assert sorted(map(tuple, found.collect())) == want
    roots = spark.createDataFrame([(r,) for r in "abcde"], "root_keyword string")
    assert sorted(r.root_keyword for r in pending(roots, found).collect()) == ["b", "d", "e"]


def test_ledger_moves_on(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "ledger"))
    roots = spark.createDataFrame([("a",), ("b",)], "root_keyword string")
    rows = spark.createDataFrame([("a", 3)], "root_keyword string, rows long")
    book.landed(roots, rows)
    assert sorted(map(tuple, book.state().collect())) == [("a", 0, LANDED, 3), ("b", 0, LANDED, 0)]
    book.move(LANDED, EXPORTED)
    book.move(EXPORTED, CLEARED)
    assert sorted(map(tuple, book.state().collect())) == [("a", 0, CLEARED, 3), ("b", 0, LANDED, 0)]
    book.landed(roots, rows)
    assert sorted(map(tuple, book.state().collect())) == [("a", 1, LANDED, 3), ("b", 0, LANDED, 0)]


@pytest.fixture
def one_cluster(monkeypatch):
    """Runs without fitting clusters: these tests are about what runs, not about what it finds."""
    monkeypatch.setattr(mining, "cluster", lambda df: df.withColumn("cluster_id", F.lit(0)).withColumn("cluster_label", F.lit("[0] one")))


BODY = '["q",["scissor lift","scissor lift price","electric scissor lift for sale","used scissor lift"]]'


def captured(spark):
    return responses(spark, response("google", "suggest", BODY), response("bing", "suggest", BODY, root="pallet jack", seq=1))


def test_a_second_run_requests_nothing(spark, tmp_path, one_cluster, monkeypatch):
    roots = spark.createDataFrame([("scissor lift", 0), ("pallet jack", 1), ("silent", 2)], "root_keyword string, position int")
    folder = str(tmp_path)
    assert mining.requests(spark, roots, folder).select("root_keyword").distinct().count() == 3
    final = mining.mine(spark, captured(spark), roots, folder, "2024-01-01 00:00:00")
    want = sorted(r.keyword for r in final.collect())
    left = mining.requests(spark, roots, folder)
    assert {r.root_keyword for r in left.select("root_keyword").distinct().collect()} == {"silent"}

    def never(*args, **kwargs):
        raise AssertionError("exported again")

    with monkeypatch.context() as patch:
        patch.setattr(mining, "export_all", never)
        again = mining.mine(spark, captured(spark).limit(0), roots, folder, "2024-01-01 00:00:00")
    assert sorted(r.keyword for r in again.collect()) == want
    mining.mine(spark, captured(spark), roots, folder, "2024-01-01 00:00:00", clear=True)
    assert mining.requests(spark, roots, folder).select("root_keyword").distinct().count() == 3


@pytest.mark.parametrize("dies_in", ["analyze", "landed"])
def test_a_killed_run_resumes_without_landing_again(spark, tmp_path, one_cluster, monkeypatch, dies_in):
    roots = spark.createDataFrame([("scissor lift", 0), ("pallet jack", 1)], "root_keyword string, position int")

    def die(*args, **kwargs):
        raise KeyboardInterrupt

    # either after the ledger knows, or between the published landing and the ledger
    with monkeypatch.context() as patch:
        patch.setattr(*((mining, "analyze") if dies_in == "analyze" else (Ledger, "landed")), die)
        with pytest.raises(KeyboardInterrupt):
            mining.mine(spark, captured(spark), roots, str(tmp_path), "2024-01-01 00:00:00")
    monkeypatch.setattr(mining, "land", die)
    final = mining.mine(spark, captured(spark), roots, str(tmp_path), "2024-01-01 00:00:00")
    assert final.count() == 6 and os.path.isdir(tmp_path / "final_keyword_map")
    states = {r.state for r in Ledger(spark, f"{tmp_path}/ledger").state().collect()}
    assert states == {EXPORTED}


def test_new_roots_join_the_old_ones(spark, tmp_path, one_cluster):
    one = spark.createDataFrame([("scissor lift", 0)], "root_keyword string, position int")
    both = spark.createDataFrame([("scissor lift", 0), ("pallet jack", 1)], "root_keyword string, position int")
    assert mining.mine(spark, captured(spark), one, str(tmp_path), "2024-01-01 00:00:00").count() == 3
    assert mining.mine(spark, captured(spark), both, str(tmp_path), "2024-01-01 00:00:00").count() == 6


# --- attempts -----------------------------------------------------------------------------------

def test_next_attempts_whatever_the_order(spark):
    rows = [("a", 1, 500), ("a", 2, 200), ("b", 1, 404), ("c", 1, 500), ("c", 2, 503), ("c", 3, 429), ("d", 2, 500), ("e", 4, 200), ("a", 2, 200)]
    frames = [spark.createDataFrame([r], "request_id string, attempt int, status int") for r in rows]
    requests = spark.createDataFrame([(x,) for x in "abcdef"], "request_id string")
    for batches in (frames, frames[::-1], frames[4:] + frames[:4]):
        known = None
        for batch in batches:
            known = attempts.state(batch) if known is None else attempts.merge(known, attempts.state(batch))
        got = sorted(map(tuple, attempts.next_attempts(requests, known).collect()))
        assert got == [("b", 2, 2), ("d", 3, 4), ("f", 1, 0)]
        assert sorted(r.request_id for r in attempts.given_up(known).collect()) == ["c", "e"]
    every = frames[0]
    for frame in frames[1:]:
        every = every.union(frame)
    assert [tuple(r) for r in attempts.answers(every, known).collect()] == [("a", 2, 200)]


# --- generations --------------------------------------------------------------------------------

LINKS = '<div class="g"><h3>x</h3><a href="{0}/p">a</a></div><div class="g"><a href="https://www.google.com/y">b</a><a href="{1}/q">c</a></div>'


def web(spark, flaky=()):
    """A web that answers discovery with two links, pages with a title and flaky requests at the third attempt only."""
    def answer(requests):
        hosts = [F.concat(F.lit(f"https://{n}."), F.replace("root_keyword", F.lit(" "), F.lit("-")), F.lit(".example")) for n in ("one", "two")]
        found = F.format_string(LINKS.replace("{0}", "%s").replace("{1}", "%s"), *hosts)
        body = F.when(F.col("endpoint") == "discovery", found).when(F.col("endpoint") == "page", F.lit("<title>page title</title>")).when(
            F.col("endpoint") == "suggest_legacy", F.lit('["q",["legacy one"]]')).otherwise(F.lit("<html>"))
        ok = ~F.col("request_id").isin(*flaky) | (F.col("attempt") == 3) if flaky else F.lit(True)
        columns = [f.split(" ")[0] for f in RESPONSE.split(", ")]
        return requests.withColumn("status", F.when(ok, 200).otherwise(503)).withColumn("body", body).select(*columns)

    return answer


def test_generations_reach_a_fixed_point(spark):
    roots = spark.createDataFrame([("a b",), ("c",)], "root_keyword string")
    switches = {s: s in ("amazon_suggest", "competitor") for s in rules.DEFAULT_SWITCHES}
    flaky = ["competitor/discovery/0/a b", "competitor/page/1/c"]
    issued, captured_ = crawl.generations(roots, web(spark, flaky), switches=switches)
    rows = issued.collect()
    by = {n: sorted(r.request_id for r in rows if r.generation == n) for n in {r.generation for r in rows}}
    assert sorted(by) == [0, 1]
    assert by[0] == sorted(r.request_id for r in frontier(roots, None, switches).collect())
    assert by[1] == sorted([f"amazon/suggest_legacy/0/{r}" for r in ("a b", "c")] + [f"competitor/page/{i}/{r}" for i in (0, 1) for r in ("a b", "c")])
    assert len({r.request_id for r in rows}) == len(rows) and len({(r.root_keyword, r.seq) for r in rows}) == len(rows)
    urls = {r.request_id: r.url for r in rows}
    assert urls["competitor/page/0/a b"] == "https://one.a-b.example/p" and urls["competitor/page/1/c"] == "https://two.c.example/q"
    tried = captured_.groupBy("request_id").agg(F.max("attempt").alias("n")).collect()
    assert {r.request_id for r in tried if r.n == 3} == set(flaky) and len(tried) == len(rows)


def test_generations_with_domains_discover_nothing(spark):
    roots = spark.createDataFrame([("a",)], "root_keyword string")
    switches = {s: s == "competitor" for s in rules.DEFAULT_SWITCHES}
    issued, _ = crawl.generations(roots, web(spark), domains=["x.example"], switches=switches)
    assert sorted((r.generation, r.url) for r in issued.collect()) == [(0, "https://x.example"), (0, "https://x.example/search?q=a")]


def test_requests_without_any_answer_use_their_attempts(spark):
    roots = spark.createDataFrame([("a",)], "root_keyword string")
    switches = {s: s == "competitor" for s in rules.DEFAULT_SWITCHES}
    calls = []

    def silent(requests):
        calls.append(sorted(r.attempt for r in requests.collect()))
        return spark.createDataFrame([], RESPONSE)

    issued, captured_ = crawl.generations(roots, silent, switches=switches)
    assert calls == [[1], [2], [3]] and captured_.count() == 0 and issued.count() == 1
