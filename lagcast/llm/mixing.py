"""Mixing sources to target weights by entropy balancing.

The rates of documents differ as little as possible (in relative entropy, between 0 and
the cap) from even rates while each source's words meet its target. The dual has one
multiplier per source; a document's rate is its exponential tilt, cap / (1 + exp(-multiplier *
size / mean size)). Newton iterations solve it: each is one aggregate over the counts
of (source, size). Rates become whole copies by systematic rounding in the order of size,
and the words still missing or in excess are made up by the smallest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagcast.llm.common import running, table, unused
from lagcast.session import materialize

#: Words: longest runs of anything but space and tab to carriage return.
WORDS = r"[^\x20\x09-\x0D]+"
#: Rates as integers, for exact running sums.
UNIT = 1 << 20
ROUNDS, TOLERANCE = 40, 1e-9
#: Multipliers stay within this range; there the rates are 0 or the cap.
LARGEST = 60.0
#: Sources up to which their facts (some 60 bytes each) are sent to every task; beyond, rows and facts meet by a shuffle that splits hot sources.
BROADCAST_SOURCES = 100_000


def beside(rows: DataFrame, facts: DataFrame, small: bool, columns: list[str], how: str = "inner") -> DataFrame:
    """The rows with some columns of their source's one row; a third of all rows may have one source, so they are not dealt by it."""
    f = F.broadcast(facts) if small else facts
    return rows.alias("r").join(f.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")), how).select("r.*", *(f"f.{c}" for c in columns))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, docs -> also weight and target.

    Sources by code point (null last) weigh `weights`, repeating. They share `share` of all words by
    weight; no target is above `cap` times its source, and the excess is shared by weight among the
    others until none is above. In the order of cap / weight, the first sources are those at their cap.
    """
    named = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = named.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    # Levels fall after the first source that is not full, so its level is the largest; all are full only if cap <= share.
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full") | last.isNull(), F.col("most")).otherwise(last * F.col("weight"))
    return levels.withColumn("target", target).select("source", "source_size", "docs", "weight", "most", "target")


def multipliers(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """source, multiplier, mean: the dual solution; counts: source, size, n."""
    goals = materialize(
        targets.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
        .withColumn("low", F.lit(-LARGEST * 1e6))
        .withColumn("high", F.lit(LARGEST * 1e6))
        .withColumn("multiplier", F.lit(0.0))
        .select("source", "target", "mean", "most", "low", "high", "multiplier")
    )
    joined = lambda now: counts.alias("c").join(now.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
    for _ in range(ROUNDS):
        x = F.col("c.size") / F.col("g.mean")
        odds = F.exp(F.least(F.lit(700.0), -F.col("multiplier") * x))
        rate = F.lit(cap) / (1 + odds)
        words = F.col("n") * F.col("c.size")
        state = ["target", "mean", "most", "low", "high", "multiplier"]
        sums = (
            joined(goals)
            .groupBy("g.source")
            .agg(F.sum(words * rate).alias("met"), F.sum(words * rate * (1 - rate / cap) * x).alias("slope"), *(F.max(c).alias(c) for c in state))
        )
        gap = F.col("met") - F.col("target")
        # The multiplier lies between low and high; a Newton step that leaves them is replaced by their middle.
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        bound = F.greatest(low, F.least(high, newton, F.col("multiplier") + 8.0), F.col("multiplier") - 8.0)
        inside = (bound > low) & (bound < high)
        # A source at 0 or at its cap has no finite multiplier.
        edge = F.when(F.col("target") <= 0, -LARGEST * 1e6).when(F.col("target") >= F.col("most"), LARGEST * 1e6)
        following = F.coalesce(edge, F.when(inside, bound).otherwise((low + high) / 2))
        near = edge.isNotNull() & (F.col("multiplier") == edge) | edge.isNull() & (F.abs(gap) <= TOLERANCE * F.col("target") + 0.5)
        goals = materialize(
            sums.select(
                "source", "target", "mean", "most", low.alias("low"), high.alias("high"),
                F.when(near, F.col("multiplier")).otherwise(following).alias("multiplier"), near.alias("done"),
            )
        )
        if goals.where(~F.col("done")).isEmpty():
            break
    return goals.select("source", "multiplier", "mean")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Copies of every document: doc_id, row_key (hash of doc_id and text), size, source_size, target, source, rate, copies, taken.

    Size is the number of words of the whole text (null: 0); a document of size 0 gets one copy.
    Rows of a repeated or null doc_id are documents of their own, a null source is a source.
    No document gets more than `cap` copies. Equal input gives equal copies: documents of one
    size are taken in the order of a hash of doc_id, and rows alike in all columns are alike.
    Extra columns are left out; no rows give no rows.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("row_key"), "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows.withColumn("mark", F.xxhash64("doc_id")))
    counts = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    targets = materialize(source_targets(totals, weights, share, cap))
    small = targets.count() <= BROADCAST_SOURCES
    duals = multipliers(counts, targets, float(cap))
    facts = materialize(targets.alias("t").join(duals.alias("d"), F.col("t.source").eqNullSafe(F.col("d.source"))).select("t.source", "t.source_size", "t.target", "d.multiplier", "d.mean"))

    rate = F.lit(float(cap)) / (1 + F.exp(F.least(F.lit(700.0), -F.col("multiplier") * F.col("size") / F.col("mean"))))
    rated = (
        beside(rows, facts, small, ["source_size", "target", "multiplier", "mean"])
        .select("doc_id", "row_key", "source", "size", "mark", "source_size", "target", rate.alias("rate"))
        .withColumn("units", F.when(F.col("size") > 0, F.round(F.col("rate") * UNIT)).otherwise(UNIT).cast("long"))
    )
    # Rows alike in all these columns are interchangeable.
    by_size = [F.col("source").asc_nulls_last(), F.col("size"), F.col("mark"), F.col("doc_id"), F.col("row_key")]
    summed = materialize(running(rated, by_size, "units").drop("index"))
    bases = summed.groupBy("source").agg(F.min("start").alias("base"))
    placed = beside(summed, bases, small, ["base"]).withColumn("from", F.col("start") - F.col("base")).drop("base")
    # A document gets the whole units that its rate passes; running sums of copies stay within one of those of rates.
    whole = lambda c: F.floor((c + F.lit(UNIT // 2)) / F.lit(UNIT))
    copied = placed.withColumn("copies", (whole(F.col("from") + F.col("units")) - whole(F.col("from"))).cast("long")).drop("start", "from", "units")
    copied = materialize(copied)
    return _repaired(copied, by_size, cap, small)


def _gaps(rows: DataFrame, small: bool) -> DataFrame:
    """Rows with `gap` (words that their source lacks), and `words`: the size where a copy may be added or taken away for it, else 0."""
    gaps = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    held = beside(rows, gaps, small, ["gap"])
    room = F.when(F.col("gap") > 0, F.col("copies") < F.col("cap")).otherwise(F.col("copies") > 0)
    return held.withColumn("words", F.when(room, F.col("size")).otherwise(F.lit(0)).cast("long"))


def _changed(rows: DataFrame, which: Column) -> DataFrame:
    step = F.when(which, F.signum("gap").cast("long")).otherwise(F.lit(0))
    return rows.withColumn("copies", F.col("copies") + step)


def _repaired(copied: DataFrame, order: list, cap: int, small: bool, single: int = 2) -> DataFrame:
    """One copy more or less of the smallest documents, as far as a source's words differ from its target; then of the best single ones."""
    names = ["doc_id", "row_key", "source", "size", "source_size", "target", "rate", "copies", "cap"]
    summed = materialize(running(_gaps(copied.withColumn("cap", F.lit(cap)), small), order, "words"))
    bases = summed.groupBy("source").agg(F.min("start").alias("base"))
    placed = beside(summed, bases, small, ["base"])
    # Documents that end within the gap change.
    within = (F.col("words") > 0) & (F.col("start") - F.col("base") + F.col("words") <= F.abs("gap"))
    rows = materialize(_changed(placed, within).select(*names, "index"))
    for _ in range(single):
        held = _gaps(rows, small)
        best = held.where("words > 0").groupBy("source").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("words")).alias("off"), "index")).alias("best"))
        joined = beside(held, best, small, ["best"], "left")
        better = (F.col("index") == F.col("best.index")) & (F.col("best.off") < F.abs("gap"))
        rows = materialize(_changed(joined, better).select(*names, "index"))
    return rows.select(*names[:8], (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """Rows of `docs`, each as often as the mix takes it. Rows alike share their copies."""
    key, check, many, copy = (unused(docs, c) for c in ("row_key", "row_check", "row_copies", "row_copy"))
    copies = mix(docs).groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias(many)).where(F.col(many) > 0)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    taken = keyed.join(copies, key).withColumn(check, F.crc32(F.coalesce("text", F.lit("")))).dropDuplicates([key, check, "doc_id"])
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(many)))).select(*docs.columns)


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the targets of their sources."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
