"""Records -> labelled keywords -> final keyword map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.operators.cleaning import clean
from lexmine.operators.cluster_fit import fit
from lexmine.operators.clusters import SMALL_LABEL, is_small, with_labels
from lexmine.operators.joins import salted_join
from lexmine.operators.labels import label
from lexmine.session import cut_lineage


def analyze(records: DataFrame) -> DataFrame:
    """Clean and label: one lazy plan with the two shuffles of cleaning."""
    return label(clean(records))


def value_order(value: Column) -> Column:
    order = F.when(value == rules.HIGH_VALUE, 0).when(value == rules.MEDIUM_VALUE, 1)
    return order.when(value == rules.LOW_VALUE, 2).otherwise(3)


def map_order() -> list[Column | str]:
    """The order of the final map, which tells all its rows apart."""
    return [value_order(F.col("commercial_value")), "keyword_type", "keyword", "root_keyword"]


def final_keyword_map(labelled: DataFrame, include_low: bool = True, sort: bool = True) -> DataFrame:
    """Everything but low-intent keywords, by value, type and keyword.

    The sort is range-partitioned. ``include_low=False`` also drops low-value keywords.
    """
    kept = labelled.where(F.col("keyword_type") != rules.LOW_INTENT)
    if not include_low:
        kept = kept.where(F.col("commercial_value") != rules.LOW_VALUE)
    if not sort:
        return kept
    return kept.orderBy(*map_order())


def cluster(labelled: DataFrame, **settings) -> DataFrame:
    """Add cluster_id and cluster_label, one model per root; roots below three keywords get the fixed label.

    The fit reads its input several times, so the input is written to the checkpoint folder first. Errors are
    raised, not turned into a single cluster.
    """
    labelled = cut_lineage(labelled)
    ids = cut_lineage(fit(labelled, **settings))  # read twice: for the rows and for their labels
    found = labelled.join(ids, ["root_keyword", "keyword"])
    sizes = labelled.groupBy("root_keyword").agg(F.count(F.lit(1)).alias("_rows"))
    named = salted_join(with_labels(found), sizes, ["root_keyword"], "keyword")
    text = F.when(is_small(F.col("_rows")), SMALL_LABEL).otherwise(F.col("cluster_label"))
    return named.select(*labelled.columns, "cluster_id", text.alias("cluster_label"))
