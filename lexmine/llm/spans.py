"""Spans of text found by rules: their order, written form and digest."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]
TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"


class Reach:
    """Spans by their starts, to be asked in logarithmic time how far those that start early enough go."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        inorder = sorted(spans)
        self.starts = [a for a, _ in inorder]
        self.ends = list(accumulate((b for _, b in inorder), max))

    def before(self, place: int) -> int:
        """The furthest end of the spans that start before a place; -1 where none does."""
        n = bisect_left(self.starts, place)
        return self.ends[n - 1] if n else -1


def span_column(text: Column, make: Callable[[], Callable[[str], list[tuple[str, int, int, bool]]]]) -> Column:
    """A column of spans (kind, start, end in code points, whether the base rules found it) of a text column.

    `make` gives the finder; it is called once per task. A null text has no spans.
    """

    @F.arrow_udf(TYPE)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = make()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch:
                spans = finder(text.as_py()) if text.is_valid else []
                out.append([{"kind": k, "start": a, "end": b, "base": c} for k, a, b, c in spans])
            yield pa.array(out, kind)

    return found.asNondeterministic()(text)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ordered(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """Spans by kind as listed and then start, or by start and then kind; kinds not listed come after, by name."""

    def keyed(s: Column) -> Column:
        place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), s["kind"]), F.lit(0).cast("long")), F.lit(99).cast("long"))
        first = [place.alias("p"), s["start"].alias("q")] if by_kind else [s["start"].alias("q"), place.alias("p")]
        return F.struct(*first, s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))

    return F.array_sort(F.transform(spans, keyed))


def digest(found: DataFrame, kinds: list[str], by_kind: bool) -> DataFrame:
    """doc_id, a count per kind, base_sha256 and spans, from doc_id and spans."""
    sort = found.select("doc_id", ordered(F.col("spans"), kinds, by_kind).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return sort.select(
        "doc_id",
        *map(number, kinds),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
