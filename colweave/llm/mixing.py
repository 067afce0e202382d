"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, ``-ln(u) / quality weight``; the documents of a
source in ascending key order are a weighted sample without replacement of any size.
A source's target is met by complete epochs first, and the rest by the documents whose
prefix sum of sizes in key order stays within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colweave.session import materialise

SOURCE_WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Rows of the input per slice of keys; only the slice at a source's cut is ever sorted.
SLICE_ROWS = 20_000
MIN_SLICES = 256
WORD = r"[^\x20\x09-\x0D]+"


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from the md5 of seed and id: reruns agree on any cluster."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple = SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets per source from ``(source, source_size, ...)``, one row per source.

    Sources in code-point order, null last, take ``weights`` in turn and share the sum
    of all sizes.  A target is at most ``max_epochs`` times its source's size; what is
    above goes to the others by weight until none is above.  That end state is a water
    level: with the sources ordered by size over weight, the first ones are capped and
    the others share what is left, so one pass over the table of sources finds it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    before = (Window.orderBy(F.col("source_size") / F.col("weight"), "place")
              .rowsBetween(Window.unboundedPreceding, -1))
    everything = Window.partitionBy()
    sums = (ranked.withColumn("total", F.sum("source_size").over(everything))
            .withColumn("left_size", F.col("total") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            # Above the water level: its cap is below its share of what the ones before leave.
            .withColumn("capped", max_epochs * F.col("source_size") * F.col("left_weight") <= F.col("weight") * F.col("left_size")))
    level = (sums.withColumn("level_size", F.min(F.when(~F.col("capped"), F.struct((-F.col("left_weight")).alias("order"), "left_weight", "left_size"))).over(everything)))
    return level.select(
        *[c for c in sizes.columns],
        F.when(F.col("capped"), max_epochs * F.col("source_size").cast("double"))
        .otherwise(F.col("weight") * F.col("level_size.left_size") / F.col("level_size.left_weight")).alias("target"))


def mix_shares(docs: DataFrame, quality: DataFrame | None = None, weights: tuple = SOURCE_WEIGHTS,
               max_epochs: int = MAX_EPOCHS, seed: int = 7, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)``, one row per document.

    ``size`` is the number of words (0 for a null text).  ``copies`` says how often the
    mix takes the document: the complete epochs of its source, and one more for the
    documents of the fractional epoch, which are taken in key order; the document at
    the cut is taken if that brings the sum nearer to the target.  Whole documents are
    taken, so a source misses its target by at most half the document at its cut.

    ``quality``: ``(doc_id, weight)`` with positive weights; documents without a row, a
    weight or an id weigh 1, several rows of an id count as their mean.  A null source
    is a source of its own.  Rows with the same id share a key and stand in order of
    size; equal rows are interchangeable.  Documents without words are never cut.

    No source is sorted as a whole: keys are cut into slices, slice sums tell in which
    slice a source's cut lies, and only that slice is sorted.
    """
    base = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    weight = F.lit(1.0)
    if quality is not None:
        known = (quality.where("doc_id IS NOT NULL AND weight > 0").groupBy(F.col("doc_id").alias("_id"))
                 .agg(F.avg("weight").alias("_weight")))
        base = base.join(known, base.doc_id == known["_id"], "left")
        weight = F.coalesce("_weight", F.lit(1.0))
    keyed = materialise(base.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), weight, seed).alias("key")))
    slices = max(MIN_SLICES, -(-keyed.count() // slice_rows))
    # 1 - exp(-key) is the key's share of its range; it keeps the key's order.
    place = F.least(F.floor((1 - F.exp(-F.col("key"))) * slices), F.lit(slices - 1)).cast("long")
    sliced = keyed.withColumn("slice", place)
    sums = materialise(sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    sizes = sums.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = (source_targets(sizes, weights, max_epochs)
               .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
               .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    targets = materialise(targets)
    reached = Window.partitionBy("source").orderBy("slice")
    # The cut lies in the first slice whose running sum passes the rest.
    cuts = (sums.withColumn("upto", F.sum("slice_size").over(reached))
            .join(targets, sums.source.eqNullSafe(targets.source)).drop(targets.source)
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source").agg(F.min_by(F.struct(F.col("slice").alias("cut_slice"), (F.col("upto") - F.col("slice_size")).alias("cut_before")), "slice").alias("cut")))
    plan = materialise(targets.join(cuts, targets.source.eqNullSafe(cuts.source), "left").drop(cuts.source)
                       .select(F.col("source").alias("_source"), "source_size", "target", "epochs", "rest", "cut.cut_slice", "cut.cut_before"))
    joined = sliced.join(plan, sliced.source.eqNullSafe(plan["_source"])).drop("_source")
    inside = F.coalesce(F.col("slice") == F.col("cut_slice"), F.lit(False))
    clear = joined.where(~inside).withColumn("extra", F.coalesce(F.col("slice") < F.col("cut_slice"), F.lit(False)))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = (joined.where(inside).withColumn("upto", F.col("cut_before") + F.sum("size").over(order))
            .withColumn("extra", F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size")))
            .drop("upto"))
    return clear.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") + F.col("extra").cast("long")).alias("copies"))


def mix(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as the mix takes it, columns unchanged."""
    shares = mix_shares(docs, quality, **options)
    # Rows that share id, source and size may differ in copies; they are told apart by number.
    counts = materialise(shares.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
                         .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_copies", "_rows")
                         .where("_copies > 0"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("_number_in_mix", F.lit(1))
    if counts.where("_rows > 1").limit(1).count():
        same = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
        rows = docs.withColumn("_number_in_mix", F.row_number().over(same))
    joined = rows.join(counts, rows.doc_id.eqNullSafe(counts["_id"]) & rows.source.cast("string").eqNullSafe(counts["_source"])
                       & (size == counts["_size"]))
    times = F.expr("_copies div _rows + IF(_number_in_mix <= _copies % _rows, 1, 0)").cast("int")
    repeated = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return joined.withColumn("_copy_in_mix", repeated).select(*[docs[c] for c in docs.columns])


def label_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """``(doc_id, weight)`` from quality labels: 1 gives ``good``, 0 gives ``bad``; others are left out."""
    return (labels.where("quality IN (0, 1)")
            .select("doc_id", F.when(F.col("quality") == 1, good).otherwise(bad).alias("weight")))
