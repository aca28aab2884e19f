"""The corpus pipeline over documents: language ID, exact dedup, near-dedup, mixing, BPE encoding.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Rows without
a doc_id cannot be told apart and pass the deduplicating stages as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmine.llm import bpe
from lexmine.llm.common import settle
from lexmine.llm.exact import exact_dedup
from lexmine.llm.langid import UNDETERMINED, fit, held_out, identify
from lexmine.llm.mixing import mixed_documents
from lexmine.llm.neardup import near_duplicates
from lexmine.llm.queries import ranks


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with one of ids; of rows that repeat an id and a text, the first by their other columns."""
    number = _free(docs, "copy_no")
    same = Window.partitionBy("doc_id", "text").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)])
    found = docs.join(ids.distinct(), "doc_id", "left_semi").select(*docs.columns)
    found = found.withColumn(number, F.row_number().over(same)).filter(F.col(number) == 1).drop(number)
    return found.unionByName(docs.filter("doc_id IS NULL"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of which a language can be told; a null lang becomes the predicted one.

    Where no labelled document teaches a language, documents with letters are kept as they are.
    """
    sample = fit(docs.filter(~held_out(F.col("doc_id"))))
    if not sample:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    name = _free(docs, "found")
    found = docs.withColumn(name, identify(docs, sample)).filter(F.col(name)["lang_pred"] != UNDETERMINED)
    told = F.coalesce(F.col("lang"), F.col(name)["lang_pred"])
    return found.select(*[told.alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return _kept(docs, exact_dedup(docs).filter("kept").select("doc_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, the rule of stages), the one with the smallest id."""
    return _kept(docs, near_duplicates(docs).filter("kept").select("doc_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, twice where it takes them twice, cut where a source's quota ends."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.digests(bpe.round_trip(docs, ranks(), public_tokenizers.PATTERN))


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("bpe", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
