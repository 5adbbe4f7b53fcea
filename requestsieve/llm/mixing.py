"""Mixing of sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; the words of this stream are
cut into blocks of equal size. Slot i of the mix takes the point i / golden ratio (mod 1) through
the cumulative shares of the sources; the r-th slot of a source takes its r-th block, starting
over at the end of the stream. Slots beyond a source's target are dropped and the few that the
points leave open are appended, so every source gives exactly its target, rounded to words, and
no document is taken more than twice over.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from requestsieve.llm.common import (
    ROW_KEY,
    WORD,
    chunk_bits,
    row_key,
    running,
    whole_text,
    written,
)

# The golden ratio as a fraction of 2^31; odd, so the points of 2^31 slots are all different.
MODULUS = 1 << 31
STEP = 1_327_217_885
WEIGHTS = (3, 1, 2)
MOST = 2
HASH_BITS = 60


def shuffle_hash(seed: str = "mix") -> Column:
    """A uniform number of 60 bits by doc_id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Row key, size in words (null text: 0) and source key; a null source sorts last."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        F.when(F.col("source").isNull(), "1")
        .otherwise(F.concat(F.lit("0"), F.col("source")))
        .alias("__rs_source"),
        *row_key(),
        shuffle_hash().alias("__rs_hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = 1.5) -> DataFrame:
    """Per source: source_size, target and its words, from one row of sizes per source.

    Sources in code-point order weigh `weights` in turn and share `ratio` of all words. A target
    stops at twice its source; the excess is shared again by weight until none is above. Sources
    that stop are those with the least cap per weight, so one pass in that order finds the level
    at which the others share. There is one row per source, so a single task may order them.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("__rs_source")
    by_cap = Window.orderBy("__rs_ratio", "__rs_source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    turn = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    cap = (F.col("source_size") * MOST).cast("double")
    shared = F.sum("source_size").over(everything) * F.lit(ratio)
    level = (shared - F.coalesce(F.sum("__rs_cap").over(before), F.lit(0.0))) / F.sum(
        "__rs_weight"
    ).over(onward)
    stops = F.col("__rs_ratio") <= F.col("__rs_level")
    share = F.min(
        F.when(~stops, F.struct(F.col("__rs_ratio"), F.col("__rs_source"), F.col("__rs_level")))
    ).over(everything)["__rs_level"]
    return (
        sizes.withColumns(
            {"__rs_weight": F.get(F.array(*map(F.lit, weights)), turn), "__rs_cap": cap}
        )
        .withColumn("__rs_ratio", F.col("__rs_cap") / F.col("__rs_weight"))
        .withColumn("__rs_level", level)
        .withColumn("target", F.when(stops, F.col("__rs_cap")).otherwise(F.col("__rs_weight") * share))
        .select(
            "__rs_source",
            "source_size",
            "target",
            F.least(F.col("source_size") * MOST, F.floor(F.col("target") + 0.5)).alias("words"),
        )
    )


def slot_needs(sources: DataFrame, block: int) -> DataFrame:
    """With the blocks of each source, and the slots that its target fills."""
    size, words = F.col("source_size"), F.col("words")
    some = F.when(size > 0, size)
    full = F.coalesce(F.floor(words / some), F.lit(0))
    return sources.withColumns(
        {
            "blocks": F.ceil(size / block),
            "full": full,
            "rest": words - full * size,
        }
    ).withColumn("need", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block))


def schedule(spark: SparkSession, sources: DataFrame, slots: int, cells: int = 4096) -> DataFrame:
    """(slot, source, rank) of every slot of the mix.

    A point finds its source among those whose stretch of the unit interval meets the point's
    cell, so this is a join on equal cells. Ranks are counted by stretches of slots.
    """
    ahead = Window.orderBy("__rs_source").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("need").over(ahead), F.lit(0))
    scale = F.lit(MODULUS / max(slots, 1))
    width = MODULUS // cells
    stretches = (
        sources.select("__rs_source", "need", before.alias("before"))
        .filter("need > 0")
        .select(
            "__rs_source",
            F.floor(F.col("before") * scale).alias("low"),
            F.floor((F.col("before") + F.col("need")) * scale).alias("high"),
        )
        .filter("low < high")
        .withColumn(
            "cell",
            F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))),
        )
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(MODULUS)) * STEP, F.lit(MODULUS)).alias("at")
    )
    inside = (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    dealt = (
        points.withColumn("cell", F.floor(F.col("at") / width))
        .join(stretches, "cell")
        .filter(inside)
        .select("slot", "__rs_source", F.floor(F.col("slot") / 65536).alias("stretch"), F.lit(1).alias("one"))
    )
    ranked = running(dealt, ["__rs_source"], "stretch", ["slot"], "one").select(
        "slot", "__rs_source", F.col("__rs_rank").alias("rank")
    )
    ranked = written(ranked, "slots")
    given = ranked.groupBy("__rs_source").agg(F.count(F.lit(1)).alias("given"))
    open_slots = (
        sources.select("__rs_source", "need")
        .join(given, "__rs_source", "left")
        .withColumn("given", F.coalesce("given", F.lit(0)))
        .filter("given < need")
        .withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("need") - 1)))
        .select((F.lit(slots) + F.col("rank")).alias("slot"), "__rs_source", "rank")
    )
    return (
        ranked.unionByName(open_slots)
        .join(sources.select("__rs_source", "need", "blocks", "full", "rest"), "__rs_source")
        .filter("rank < need")
        .select(
            "slot",
            "__rs_source",
            F.floor(F.col("rank") / F.col("blocks")).alias("epoch"),
            (F.col("rank") % F.col("blocks")).alias("block"),
            F.when(F.floor(F.col("rank") / F.col("blocks")) == F.col("full"), F.col("rest")).alias(
                "stop"
            ),
        )
    )


def block_pieces(laid: DataFrame, block: int) -> DataFrame:
    """Documents cut where blocks end: (source, block, row, from, words), from in the stream."""
    start, end = F.col("__rs_start"), F.col("__rs_start") + F.col("size")
    first = F.col("block") * block
    return (
        laid.filter("size > 0")
        .withColumn(
            "block",
            F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))),
        )
        .select(
            "__rs_source",
            "block",
            "doc_id",
            "__rs_rank",
            F.col("__rs_start").alias("doc_from"),
            F.greatest(start, first).alias("from"),
            F.least(end, first + block).alias("to"),
        )
    )


def lay(docs: DataFrame) -> DataFrame:
    """Rows with their place in their source's shuffled stream of words (`__rs_start`)."""
    bits = chunk_bits(docs.sparkSession)
    rows = sized(docs).withColumn("__rs_chunk", F.shiftright("__rs_hash", HASH_BITS - bits))
    order = ["__rs_hash", *ROW_KEY]
    return running(rows, ["__rs_source"], "__rs_chunk", order, "size").drop("__rs_chunk")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    ratio: float = 1.5,
    block: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """The laid-out documents with their source's figures, and the mix.

    The mix has a row for each piece of a document in a slot: slot, doc_id, the row's rank in
    its source, first word within the document, and words. Null and empty texts have no words
    and are never taken; repeated rows are documents of their own; no rows give no mix.
    """
    spark = docs.sparkSession
    laid = written(lay(docs), "laid")
    sizes = laid.groupBy("__rs_source").agg(F.sum("size").alias("source_size"))
    sources = written(slot_needs(targets(sizes, weights, ratio), block), "sources")
    slots = sources.agg(F.sum("need")).first()[0] or 0
    plan = schedule(spark, sources, slots)
    to = F.least(F.col("to"), F.coalesce("stop", F.col("to")))
    mixed = (
        plan.join(block_pieces(laid, block), ["__rs_source", "block"])
        .withColumn("words", to - F.col("from"))
        .filter("words > 0")
        .select(
            "slot",
            "epoch",
            "__rs_source",
            "__rs_rank",
            "doc_id",
            (F.col("from") - F.col("doc_from")).alias("first_word"),
            "words",
        )
    )
    placed = laid.join(sources.select("__rs_source", "source_size", "target"), "__rs_source")
    return placed, mixed


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target and the words that the mix takes of it.

    Sums start from zero rows of the documents themselves, so no join brings them back.
    """
    placed, mixed = mix(docs, **options)
    sums = (
        placed.select("__rs_source", "__rs_rank", F.lit(0).alias("words"))
        .unionByName(mixed.select("__rs_source", "__rs_rank", "words"))
        .groupBy("__rs_source", "__rs_rank")
        .agg(F.sum("words").alias("taken"))
    )
    return placed.join(sums, ["__rs_source", "__rs_rank"])


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with their own columns.

    Only one document of a source is taken in part, where its target ends; it is rounded. Rows
    that tie in id and text share what is taken of them.
    """
    times = F.floor(F.sum("taken") / F.sum("size") + F.lit(0.5))
    counted = (
        taken(docs, **options)
        .filter("size > 0")
        .groupBy("__rs_id", "__rs_row")
        .agg(times.cast("int").alias("__rs_times"))
        .filter("__rs_times > 0")
    )
    keyed = docs.withColumns(dict(zip(ROW_KEY, row_key(), strict=True)))
    return (
        keyed.join(written(counted, "times"), ROW_KEY)
        .withColumn("__rs_n", F.explode(F.sequence(F.lit(1), F.col("__rs_times"))))
        .select(docs.columns)
    )
