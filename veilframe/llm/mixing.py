"""Mixing sources to target weights by a low-discrepancy schedule.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_of

#: Default weights by the source's place in code-point order (repeating), size of the mix as a share of all words, most repetitions.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: The schedule has 2**m slots: 2**LEAST_SLOT_BITS at least, and blocks of at most BLOCK words.
LEAST_SLOT_BITS, BLOCK = 16, 8192
#: Slots are ranked, and documents laid out, in groups of this many bits, so that no source is one group.
CHUNK_BITS, LAY_BITS = 8, 12
#: Sources that are broadcast at most, and the parts into which the rows of a source are dealt beyond that.
MOST_BROADCAST, SALTS = 10_000, 64


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, part, rank``: sources in code-point order, null last, numbered from 0.  They are sorted over many tasks, each numbers its own ``part``, and the parts' counts are added up."""
    ordered = sizes.orderBy(F.col("source").isNull(), F.col("source")).withColumn("at", F.monotonically_increasing_id())
    placed = stored(ordered.select("source", "source_size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    ahead = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return placed.join(F.broadcast(ahead), "part").select("source", "source_size", "part", (F.col("at") + F.col("ahead")).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Targets of sources: ``source, source_size`` to ``source, source_size, rank, target, part, below, upto``.

    Sources in code-point order, null last, get the weights in turn.  The mix has ``share`` times all words, split by weight; a target
    stops at ``repeats`` times its source's size, and the excess goes to the others by weight until none is above: each round sums caps and
    weights over all sources, so no task sees more than its own.  ``below, upto``: the source's stretch of the cumulative targets.
    """
    ranked = numbered_sources(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats)), "ranked")
    total = float(share) * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level if capped >= 0 else F.lit(False)
        n, caps, rest = ranked.agg(F.coalesce(F.sum(full.cast("int")), F.lit(0)), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not rest:
            break
        level, capped = (total - caps) / rest, n
    share_of = F.least(F.col("cap"), F.col("weight") * level) if rest else F.col("cap")
    aimed = ranked.select("source", "source_size", "rank", "part", share_of.alias("target"))
    within = Window.partitionBy("part").orderBy("rank")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    sums = aimed.withColumn("run", F.sum("target").over(within)).groupBy("part").agg(F.max_by("run", "rank").alias("held"))
    ahead = sums.select("part", F.coalesce(F.sum("held").over(before), F.lit(0.0)).alias("ahead"))
    placed = aimed.join(F.broadcast(ahead), "part").withColumn("upto", F.col("ahead") + F.sum("target").over(within))
    return placed.withColumn("below", F.coalesce(F.lag("upto").over(within), F.col("ahead"))).drop("ahead")


def _reversed_bits(value: Column, bits: int) -> Column:
    """Van der Corput point of an index, times ``2**bits``: its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(value), bits, "0")), 2, 10).cast("long")


def schedule(targets: DataFrame, slots: int, block: int, taken: int) -> DataFrame:
    """``slot, source_rank, nth``: the source of each of the first ``taken`` of ``2**slots`` slots, and the slot's number within it.

    Slot k stands at the van der Corput point of k, which falls into one source's stretch of the cumulative targets.  A source's slots
    are ranked in slot order.
    """
    spark = targets.sparkSession
    total = targets.agg(F.max("upto")).first()[0] or 0.0
    edges = targets.select(F.col("rank").alias("source_rank"), "below", "upto", F.lit(total).alias("total"))
    # the points are the 2**slots fractions j / 2**slots, each once: a source holds those from ceil(below) to ceil(upto)
    scaled = lambda c: F.ceil(F.col(c) / F.col("total") * float(1 << slots)).cast("long")
    held = edges.where(F.col("total") > 0).select("source_rank", scaled("below").alias("first"), F.when(F.col("upto") == F.col("total"), F.lit(1 << slots)).otherwise(scaled("upto")).alias("end"))
    cells = min(CHUNK_BITS, slots)  # points are dealt to the sources whose stretch meets their coarse cell
    met = held.where("end > first").select("*", F.explode(F.sequence(F.shiftright("first", slots - cells), F.shiftright(F.col("end") - 1, slots - cells))).alias("cell"))
    points = spark.range(0, taken).select(F.col("id").alias("slot"), _reversed_bits(F.col("id"), slots).alias("point")).withColumn("cell", F.shiftright("point", slots - cells))
    chosen = points.join(met, "cell").where("point >= first and point < end").select("slot", "source_rank", F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    before = Window.partitionBy("source_rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chosen.groupBy("source_rank", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select("source_rank", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    local = F.row_number().over(Window.partitionBy("source_rank", "chunk").orderBy("slot")) - 1
    ranked = chosen.withColumn("local", local).join(offsets, ["source_rank", "chunk"]).withColumn("nth", F.col("ahead") + F.col("local"))
    return ranked.select("slot", "source_rank", "nth")


def block_plan(targets: DataFrame, scheduled: DataFrame, block: int) -> DataFrame:
    """``source_rank, block, upto, times``: how often the mix takes each block of a source, up to which word of the source.

    A source's slots take its blocks in turn, again from the first after the last.  The slot that reaches the target is trimmed to it, further ones take nothing; where the points that fall to
    a source do not reach its target (or none falls to it, as its stretch lies between two), its last slot is extended over the blocks that follow.  So each source is taken to its target in whole words.
    """
    whole = lambda a, b: F.call_function("div", a, b)
    size, aim = F.col("source_size"), F.round("target").cast("long")
    sized = targets.where(size > 0).select(F.col("rank").alias("source_rank"), size.alias("size"), F.ceil(size / F.lit(block)).cast("long").alias("blocks"), whole(aim, size).alias("laps"), (aim % size).alias("rest"))
    sized = sized.withColumn("needed", F.col("laps") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block)).cast("long"))
    held = scheduled.groupBy("source_rank").agg(F.count("*").alias("held"))
    extended = sized.join(held, "source_rank", "left").withColumn("held", F.coalesce("held", F.lit(0))).where("held < needed").select("source_rank", F.explode(F.sequence("held", F.col("needed") - 1)).alias("nth"))
    taken = scheduled.select("source_rank", "nth").unionByName(extended)
    few = sized.count() <= MOST_BROADCAST
    if not few:  # a source may hold a third of all slots
        taken = taken.withColumn("salt", F.col("nth") % SALTS)
        sized = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    placed = taken.join(F.broadcast(sized) if few else sized, ["source_rank"] if few else ["source_rank", "salt"]).where("nth < needed").withColumn("block", F.col("nth") % F.col("blocks"))
    end = F.least((F.col("block") + 1) * block, F.when(whole(F.col("nth"), F.col("blocks")) < F.col("laps"), F.col("size")).otherwise(F.col("rest")))
    return placed.select("source_rank", "block", end.alias("upto")).groupBy("source_rank", "block", "upto").agg(F.count("*").alias("times"))


def laid_out(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source's documents in hashed order on one axis of words: adds ``source_rank, source_size, target, low, high``.

    The order is that of ``md5(doc_id)``; its first bits make the groups within which running sums are taken, and the groups' totals are
    summed up first, so a source that holds a third of all rows is many groups.
    """
    keyed = docs.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("group", F.conv(F.substring("order", 1, LAY_BITS // 4), 16, 10).cast("int"))
    named = targets.select(F.col("source").alias("target_source"), "source_size", "target", F.col("rank").alias("source_rank"))
    same = F.col("source").eqNullSafe(F.col("target_source"))
    if targets.count() <= MOST_BROADCAST:
        keyed = keyed.join(F.broadcast(named), same).drop("target_source")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_")
        keyed = keyed.withColumn("salt", F.col("group") % SALTS).join(named.select("*", salts), same & (F.col("salt") == F.col("salt_"))).drop("target_source", "salt", "salt_")
    before = Window.partitionBy("source_rank").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("source_rank", "group").agg(F.sum("size").alias("held"))
    starts = totals.select("source_rank", "group", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source_rank", "group").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(within)).join(starts, ["source_rank", "group"])
    return placed.withColumn("high", F.col("ahead") + F.col("upto")).withColumn("low", F.col("high") - F.col("size")).drop("order", "group", "upto", "ahead")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, carried: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes.

    Each source is cut into blocks of equally many words over its shuffled documents; the schedule's slots join the blocks (:func:`block_plan`); a document
    takes its overlap with each block as often as the block is taken, at most ``repeats`` times.  One rule holds for sources of every size: each is taken to its target in words.  Deterministic: reruns agree.

    Returns ``doc_id, size, source_size, target, taken, source`` for every row of ``docs``; repeated rows stay repeated.  Null or empty
    texts have size 0 and take nothing; a null source is a source, last in order; a source without words has target 0; an empty table
    gives an empty result; further columns are ignored, but for those ``carried`` along.  Sizes are summed first, so no source's rows meet in one task.
    """
    sized = stored(docs.select("doc_id", "source", *carried, F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")), "sizes")
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats), "targets")
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = max(LEAST_SLOT_BITS, int(max(1.0, total) / BLOCK).bit_length())
    block = max(1, int(-(-total // (1 << slots))))
    used = min(1 << slots, round(total / block))
    placed = laid_out(sized, targets)
    plan = block_plan(targets, schedule(targets, slots, block, used), block)
    some = placed.where(F.col("size") > 0).select("source_rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))).alias("block"))
    overlap = F.greatest(F.least("high", "upto") - F.greatest("low", F.col("block") * block), F.lit(0))
    taken = some.join(plan, ["source_rank", "block"]).groupBy("source_rank", "low", "high").agg(F.sum(overlap * F.col("times")).alias("got"))
    out = placed.join(taken, ["source_rank", "low", "high"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "source", *carried)
