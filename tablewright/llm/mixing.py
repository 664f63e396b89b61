"""Mix sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm._spark import durable, free_name, numbered, word_count

#: Slots that one task expands or ranks at a time.
CELL_BITS = 14


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of ``sizes(source, source_size)`` by capped proportional filling.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes.  No target passes ``most`` times its source's size;
    what a cap cuts off is shared again by weight.  That fixed point is one
    level: sorted by cap over weight, the first source whose cap the level does
    not reach sets it.  The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w) for w in weights])
    named = sizes.withColumn("ordinal", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("ordinal") % len(weights) + 1).cast("int")).cast("double")
    )
    capped = named.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "ordinal")
    level = (
        capped.withColumn("pool", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("filled", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("pool") - F.col("filled")) / F.col("open"))
        .withColumn("holds", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
        # Levels fall until they hold, so the first that holds is the largest.
        .withColumn("level", F.coalesce(F.max("holds").over(every), F.lit(float("inf"))))
    )
    return level.select("source", "ordinal", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _reversed_bits(value: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.conv(value.cast("string"), 10, 2), bits, "0")), 2, 10).cast("long")


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """``(slot, ordinal, rank)``: which source fills each slot, and its rank there.

    A source of target T owns ``ceil(T / block)`` consecutive cells of the unit
    interval cut into 2**m cells.  Slot i goes to the source that owns the i-th
    van der Corput point (its bits reversed), so every stretch of slots is close
    to the weights.  Points past the last cell are skipped.  Expansion and
    ranking run in cells of 2**14 slots, so a large source is spread out.
    """
    running = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    owned = targets.withColumn("slots", F.ceil(F.col("taking") / F.lit(block)).cast("long")).withColumn("low", F.coalesce(F.sum("slots").over(running), F.lit(0)))
    total = owned.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (max(1, total) - 1).bit_length())
    step = 1 << CELL_BITS
    pieces = (
        owned.where("slots > 0")
        .select("ordinal", "low", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {step})")).alias("piece"))
        .repartition("ordinal", "piece")
        .select(
            "ordinal",
            F.explode(F.sequence(F.col("low") + F.col("piece") * step, F.col("low") + F.least(F.col("slots"), (F.col("piece") + 1) * step) - 1)).alias("point"),
        )
    )
    slots = pieces.select(_reversed_bits(F.col("point"), bits).alias("slot"), "ordinal").withColumn("cell", F.shiftright("slot", min(bits, CELL_BITS)))
    counts = slots.groupBy("ordinal", "cell").count()
    earlier = Window.partitionBy("ordinal").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("ordinal", "cell", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("ordinal", "cell").orderBy("slot")
    return slots.withColumn("within", F.row_number().over(here) - 1).join(offsets, ["ordinal", "cell"]).select("slot", "ordinal", (F.col("before") + F.col("within")).alias("rank"))


def _laid(docs: DataFrame, row: str, weights, share, most, seed, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame]:
    """Every row's place in its source's shuffled stream, and the sources' targets."""
    slim = durable(
        docs.select(
            F.col(f"`{row}`").alias("row"),
            F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
            # Rows without an id, or that repeat one, are still spread by their text.
            F.md5(F.concat_ws("|", F.lit(seed), F.col(f"`{id_col}`").cast("string")).cast("binary")).alias("shuffle_key"),
            F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")).alias("text_key"),
        )
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sizes, weights, share, most).withColumn("taking", F.floor(F.col("target") + 0.5).cast("long")))
    named = slim.join(targets.drop("weight"), slim["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # Prefix sums in two levels: 4096 hash ranges of a source, then rows of a range.
    # Null ids share a shuffle key, so their range comes from the text.
    ranged = named.withColumn("shuffle_key", F.when(F.col("doc_id").isNull(), F.col("text_key")).otherwise(F.col("shuffle_key"))).withColumn("range", F.substring("shuffle_key", 1, 3))
    earlier = Window.partitionBy("ordinal").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("ordinal", "range").agg(F.sum("size").alias("words"))
    offsets = totals.select("ordinal", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("ordinal", "range").orderBy("shuffle_key", "doc_id", "size", "text_key", "row")
    laid = (
        ranged.withColumn("within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(offsets, ["ordinal", "range"])
        .withColumn("start", F.col("before") + F.col("within"))
    )
    return durable(laid.select("row", "doc_id", "size", "source_size", "target", "ordinal", "taking", "start")), targets


def _parts(laid: DataFrame, targets: DataFrame, most: float, block: int) -> DataFrame:
    """``(row, lap, words, rank, slot)``: what each slot takes of each row.

    Slot of rank r takes block r of its source's stream.  Only slots decide:
    a block whose rank no slot has is not taken.
    """
    laps = F.sequence(F.lit(0), F.lit(max(0, -int(-most // 1) - 1)))
    pieces = (
        laid.where("size > 0")
        .select("row", "ordinal", "size", "source_size", "taking", "start", F.explode(laps).alias("lap"))
        .withColumn("from", F.col("start") + F.col("lap") * F.col("source_size"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("taking")))
        .where("from < to")
        .select("row", "ordinal", "lap", "from", "to", F.explode(F.expr(f"sequence(from div {block}, (to - 1) div {block})")).alias("rank"))
        .withColumn("words", F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block))
    )
    # Both sides grow with the documents: sorted and merged, never broadcast.
    return pieces.join(slot_schedule(targets, block).hint("merge"), ["ordinal", "rank"]).select("row", "lap", "from", "rank", "slot", "words")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 1024,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot.

    Each source's documents are shuffled by a hash of seed and id and laid end
    to end, ``most`` times over; that stream is cut into blocks of ``block``
    words.  The schedule's slot of rank r takes block r, the last one only up
    to the rounded target.  ``taken`` sums what the slots take of a document and
    ``first_slot`` is the earliest slot that takes some of it (null: none).  So
    a source's taken words equal its rounded target and no document passes
    ``most`` times its size.

    Null text has size 0.  A null source is a source, the last.  Repeated rows
    are separate documents; rows that share an id are ordered by size and text.
    Null ids are shuffled by their text.  An empty table gives an empty result.
    """
    row = free_name(docs, "row")
    laid, targets = _laid(docs.withColumn(row, F.monotonically_increasing_id()), row, weights, share, most, seed, id_col, text_col, source_col)
    taken = _parts(laid, targets, most, block).groupBy("row").agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    return laid.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 1024,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` repeated or left out as the mix takes them, columns unchanged.

    A row stands as often as its taken words hold its size, rounded half up, and
    each copy at the slot that takes its first word: the result is sorted by
    slot, so any stretch of it is close to the target weights.  Rows are followed
    by a number of their own, so null and repeated ids are mixed like others.
    Rows without words have no share in the mix and are left out.
    """
    row = free_name(docs, "row")
    keyed = numbered(docs, row)
    laid, targets = _laid(keyed, row, weights, share, most, seed, id_col, text_col, source_col)
    parts = _parts(laid, targets, most, block).groupBy("row", "lap").agg(F.sum("words").alias("words"), F.min_by("slot", "rank").alias("slot"))
    times = parts.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("lap", "slot"))).alias("laps"))  # at most ``most`` laps
    copies = (
        times.join(laid.select("row", "size").hint("merge"), "row")
        .withColumn("laps", F.slice("laps", 1, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")))
        .select(F.col("row").alias(row), F.explode("laps").alias("lap"))
    )
    number, slot = free_name(docs, "copy_number"), free_name(docs, "copy_slot")
    copies = copies.select(row, F.col("lap.lap").alias(number), F.col("lap.slot").alias(slot))
    return keyed.join(copies.hint("merge"), row).repartitionByRange(F.col(slot), F.col(row)).sortWithinPartitions(slot, row, number).select(docs.columns)
