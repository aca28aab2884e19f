"""The whole run: captured responses -> landed records -> labelled and clustered keywords -> exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmine.operators.reports import ROOT, global_report_lines, report_lines
from lexmine.plans.analysis import analyze, cluster, final_keyword_map, map_order
from lexmine.plans.collection import extract_all
from lexmine.plans.ledger import CLEARED, EXPORTED, LANDED, Ledger, pending
from lexmine.schemas import RECORDS
from lexmine.session import cut_lineage
from lexmine.sinks.files import export_all, export_per_root, write_global_report, write_root_reports
from lexmine.sinks.landing import land, manifest, read
from lexmine.sinks.versions import children
from lexmine.sources.frontier import frontier


def table(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as a table and read it back: later steps start from files, not from recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def requests(spark: SparkSession, roots: DataFrame, folder: str, **settings) -> DataFrame:
    """The requests that a run still needs: the frontier of the roots that its ledger does not have as done."""
    return frontier(pending(roots, Ledger(spark, f"{folder}/ledger").state()), **settings)


def mine(
    spark: SparkSession, responses: DataFrame, roots: DataFrame, folder: str, generated_at: str,
    trends: DataFrame | None = None, clear: bool = False,
) -> DataFrame:
    """Run every stage and return the final keyword map. ``roots`` has root_keyword and position.

    The ledger below ``folder`` is asked first: only roots that have not landed are extracted, exports are written only
    if a root has landed since, and a run that was stopped goes on where it was. Answers of other roots are left out.
    ``clear`` lets all exported roots start again in the next run.
    """
    ledger, landing, tables = Ledger(spark, f"{folder}/ledger"), f"{folder}/tables/records", f"{folder}/tables"
    _catch_up(ledger, spark, landing)
    todo = cut_lineage(pending(roots.select(ROOT), ledger.state()))
    if not todo.isEmpty():
        found = extract_all(_of(responses, todo), None if trends is None else _of(trends, todo))
        ledger.landed(todo, land(found, landing))
    if not ledger.state().where((F.col("state") == LANDED) & (F.col("rows") > 0)).isEmpty():
        records = read(spark, landing, RECORDS)
        labelled = table(analyze(records), f"{tables}/labelled")
        clustered = table(cluster(labelled), f"{tables}/clustered")
        export_per_root(records, labelled, clustered, f"{folder}/per_root")
        export_all(records, labelled, clustered, final_keyword_map(labelled, sort=False), map_order(), folder)
        write_root_reports(report_lines(records, labelled, clustered, generated_at), f"{folder}/reports")
        lines = global_report_lines(records, labelled, clustered, roots, generated_at)
        write_global_report(lines, f"{folder}/summary_report")
        ledger.move(LANDED, EXPORTED)
    if clear:
        ledger.move(EXPORTED, CLEARED)
    if not children(spark, f"{tables}/labelled"):
        return final_keyword_map(analyze(read(spark, landing, RECORDS)))
    return final_keyword_map(spark.read.parquet(f"{tables}/labelled"))


def _of(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, ROOT, "left_semi").select(*rows.columns)


def _catch_up(ledger: Ledger, spark: SparkSession, landing: str) -> None:
    """Note roots whose landing was published by a run that died before it could say so."""
    landed = manifest(spark, landing)
    missed = cut_lineage(landed.join(ledger.state(), ROOT, "left_anti").select(ROOT, "rows"))
    if not missed.isEmpty():
        ledger.landed(missed, missed)
