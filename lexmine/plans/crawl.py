"""The frontier in generations: answers name further requests, until a generation names none that is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lexmine.session import cut_lineage
from lexmine.sources import attempts
from lexmine.sources.frontier import fallback_requests, frontier, numbered
from lexmine.sources.responses import resolve
from lexmine.sources.webpages import discovered

KEY = "request_id"
# Requests -> what was captured for them (lexmine.schemas.RESPONSES). A capture may answer some, all or none.
Answer = Callable[[DataFrame], DataFrame]


def named(roots: DataFrame, responses: DataFrame, issued: DataFrame) -> DataFrame:
    """Requests that the answers ask for: competitor pages found on result pages, and legacy suggestions where the
    primary ones were asked for and have no readable answer. With request_id and seq, without those already issued."""
    resolved = resolve(responses)
    asked = issued.where("channel = 'amazon' AND endpoint = 'suggest'").select("root_keyword").distinct()
    found = discovered(resolved).unionByName(fallback_requests(asked, resolved))
    return numbered(found).join(issued.select(KEY), KEY, "left_anti")


def asked_until_answered(requests: DataFrame, answer: Answer) -> DataFrame:
    """Captured responses of the requests, each sent again while its attempts fail and are not used up."""
    known, captured = None, None
    todo = requests.withColumn("attempt", F.lit(1)).withColumn("wait_s", F.lit(0))
    while True:
        got = cut_lineage(answer(todo))
        captured = got if captured is None else captured.unionByName(got)
        # A request that got no response at all has used its attempt too.
        sent = todo.select(KEY, F.lit(None).cast("int").alias("best"), F.col("attempt").alias("used"))
        parts = [attempts.state(got), sent] + ([known] if known is not None else [])
        known = cut_lineage(attempts.merge(*parts))
        todo = cut_lineage(attempts.next_attempts(requests, known))
        if todo.isEmpty():
            return captured


def generations(
    roots: DataFrame, answer: Answer, domains: list[str] | None = None, switches: dict[str, bool] | None = None, first: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(requests with their generation, all captured responses).

    Generation 0 is the frontier of the roots (or ``first``); generation n + 1 is what the answers up to n name and
    nobody asked for yet. Requests are identified by request_id, of which there are finitely many for an answer's
    links, so the loop ends. Each generation is two tables in the shared folder; only emptiness reaches the driver.
    """
    wave = cut_lineage(frontier(roots, domains, switches) if first is None else first)
    issued, captured, number = wave.withColumn("generation", F.lit(0)), None, 0
    while True:
        got = asked_until_answered(wave, answer)
        captured = got if captured is None else captured.unionByName(got)
        wave = cut_lineage(named(roots, captured, issued))
        if wave.isEmpty():
            return issued, captured
        number += 1
        issued = issued.unionByName(wave.withColumn("generation", F.lit(number)))
