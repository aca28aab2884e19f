"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmine.llm.common import settle

WORD = r"[^\x20\x09-\x0D]+"
# 1 / golden ratio; the multiples of it, without their whole parts, fill the unit interval evenly at every length.
STEP = 0.6180339887498949
# Slots are ranked within chunks of so many, and documents within as many hash ranges of their source.
CHUNK = 65536
BINS = 4096


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size in words, the hash by which a source's documents are shuffled, one that orders rows of one
    id, and the number of the row, where it has one."""
    number = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    whole = [F.col(f"`{c}`") for c in docs.columns if c != row_col and "map<" not in docs.schema[c].dataType.simpleString()]
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
        F.xxhash64(*whole).alias("tie"), number.alias("row"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source_no, source, source_size, target and quota (whole words) of every source; a row for each source.

    Sources are ordered by code point, null last, and take the weights in turn. Ordered by limit over weight, a source
    stops at its limit while that is no more than what the words and weights left give it; the rest share what remains.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "source_no")
    found = (
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1))
        .withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("left_words", F.lit(share) * F.sum("source_size").over(everything)
                    - (F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit")))
        .withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("stopped", F.col("ratio") <= F.col("level"))
        .withColumn("common", F.max(F.when(~F.col("stopped"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("common")))
    )
    return found.select("source_no", "source", "source_size", "target", F.round("target").cast("long").alias("quota"))


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """slot, source_no, block_no, until: the mix in its order; each slot plays one block of a source's words.

    Slot i belongs to the source in whose part of the unit interval, by quota, the i-th golden-ratio point falls. The
    n-th slot of a source plays its block n, up to `until` words of the source in all. Where the points give a source
    a slot or two less than its quota, its last blocks follow at the end.
    """
    spark = goals.sparkSession
    total, sources = goals.agg(F.sum("quota"), F.count("*")).first()
    total = total or 0
    cells = max(4096, 4 * sources)
    before = F.sum("quota").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    parts = (
        goals.withColumn("through", before).withColumn("low", (F.col("through") - F.col("quota")) / F.lit(float(total or 1)))
        .withColumn("high", F.col("through") / F.lit(float(total or 1))).filter("quota > 0")
        .select("source_no", "quota", "low", "high", F.explode(F.sequence(
            F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long")))).alias("cell"))
    )
    points = spark.range(-(-total // block)).select(F.col("id").alias("slot"), (F.col("id") * F.lit(STEP)).alias("p"))
    points = points.select("slot", (F.col("p") - F.floor("p")).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    slots = points.join(parts, "cell").filter("low <= u AND u < high").select(
        "slot", "source_no", "quota", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    chunks = slots.groupBy("source_no", "chunk").agg(F.count("*").alias("n")).withColumn(
        "base", F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("n"))
    ranked = slots.join(chunks, ["source_no", "chunk"]).withColumn(
        "block_no", F.col("base") + F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1)
    played = chunks.groupBy("source_no").agg(F.sum("n").alias("played"))
    rest = (
        goals.join(played, "source_no", "left").withColumn("played", F.coalesce("played", F.lit(0)))
        .filter(F.col("played") * block < F.col("quota"))
        .select("source_no", "quota", F.explode(F.sequence(F.col("played"), F.ceil(F.col("quota") / block) - 1)).alias("block_no"))
        .withColumn("slot", F.lit(-(-total // block)) + F.col("block_no"))
    )
    columns = ["slot", "source_no", "block_no", F.least((F.col("block_no") + 1) * block, F.col("quota")).alias("until")]
    return ranked.select(*columns).unionByName(rest.select(*columns)).filter(F.col("block_no") * block < F.col("until"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 256, row_col: str | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, taken_by_pass, slot_by_pass (arrays of `most` numbers) and row,
    a row per row.

    A source's documents, shuffled by the hash of their ids, are one stream of words, which is played up to `most`
    times over and cut in equal blocks; the schedule says which blocks are in the mix. taken is the sum of the words
    of a document's blocks that are, slot_by_pass where the schedule plays its words in each pass for the first time
    (null: not at all); ordered by these slots, the mix has its sources in proportion all along. The words taken of a source are its target, rounded. A null text has no words, a
    null source is a source by itself, repeated rows are documents of their own; an empty table gives an empty mix.
    row is what `row_col` numbers a row with, so that decisions can be told apart where ids cannot; else null.
    Reruns agree, as nothing depends on the order or partitions of the rows.
    """
    rows = settle(sizes(docs, id_col, text_col, source_col, row_col).withColumn("bin", F.substring("key", 1, 3)), "sizes")
    goals = settle(targets(rows, weights, share, most), "targets")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn(
        "base", F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words"))
    bins = bins.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        "b.source", "bin", "base", "source_no", "source_size", "target", "quota")
    in_bin = Window.partitionBy("source_no", "bin").orderBy("key", "doc_id", "size", "tie")
    placed = (
        rows.alias("r").join(bins.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin")))
        .select("doc_id", "r.source", "size", "key", "tie", "row", "r.bin", "base", "source_no", "source_size", "target", "quota")
        .withColumn("place", F.row_number().over(in_bin))
        .withColumn("start", F.col("base") + F.sum("size").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    )
    passes = placed.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(most)])))
    passes = passes.withColumn("start", F.col("start") + F.col("pass") * F.col("source_size"))
    last = F.least(F.col("start") + F.col("size"), F.col("quota"))
    pieces = passes.withColumn("end", F.col("start") + F.col("size")).withColumn("block_no", F.explode_outer(
        F.when(last > F.col("start"), F.sequence(F.floor(F.col("start") / block), F.floor((last - 1) / block)))))
    found = pieces.join(schedule(goals, block), ["source_no", "block_no"], "left").withColumn(
        "words", F.when(F.col("until").isNotNull(), F.greatest(
            F.least("end", "until") - F.greatest(F.col("start"), F.col("block_no") * block), F.lit(0))).otherwise(0))
    same = ["doc_id", "source", "size", "source_size", "target", "row"]
    return found.groupBy("source_no", "bin", "place").agg(
        *[F.first(c).alias(c) for c in same], F.sum("words").alias("taken"),
        F.array(*[F.sum(F.when(F.col("pass") == p, F.col("words")).otherwise(0)) for p in range(most)]).alias("taken_by_pass"),
        F.array(*[F.min(F.when((F.col("pass") == p) & (F.col("words") > 0), F.col("slot"))) for p in range(most)]).alias("slot_by_pass"),
    ).select(*same[:-1], "taken", "taken_by_pass", "slot_by_pass", "row")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None, **settings,
) -> DataFrame:
    """The documents of the mix, with the columns of docs: a row for each pass in which words of a document are taken.

    A document of which only the first words are taken (one per source, where the quota ends) has its text cut after
    them. Every row has its own decision, also where rows share an id or have none: the documents are written once with
    a number for each row, by which they meet their decisions. `slot_col` adds each row's slot in the schedule: writing
    the documents in its order gives the mix that the points schedule.
    """
    row = "mix_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plan = mix(numbered, id_col, text_col, source_col, row_col=row, **settings).filter("taken > 0")
    plan = plan.select(F.col("row").alias("mix_id"), F.col("size").alias("mix_size"), F.inline(F.arrays_zip(
        F.col("taken_by_pass").alias("mix_words"), F.col("slot_by_pass").alias("mix_slot"))))
    joined = numbered.alias("d").join(plan.filter("mix_words > 0").alias("m"), F.col(f"d.{row}") == F.col("m.mix_id"))
    whole = F.col(f"d.{text_col}")
    spaced = F.regexp_extract_all(whole, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(F.col("m.mix_words") >= F.col("m.mix_size"), whole).otherwise(
        F.array_join(F.slice(spaced, F.lit(1), F.col("m.mix_words").cast("int")), ""))
    slot = [] if slot_col is None else [F.col("m.mix_slot").alias(slot_col)]
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns], *slot)
