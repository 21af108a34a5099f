"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash. A source that is to give its words q whole times and a rest takes every document q times and,
once more, those whose hash is below the source's threshold. The threshold comes from histograms of words by source and hash
bucket, 4,096 buckets a level: the first level covers all documents, each further one only the bucket in which the budget
runs out, until that bucket holds one document. Budgets are nested: a larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.common import WORD_PATTERN, named, written

HASH_BITS = 60
LEVEL_BITS = 12
#: Fixed by the contract: weights by source order, repeated; total as a share of all words; most that a source may repeat.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """First 60 bits of md5 over identifier and text, so that only repeated rows tie; nulls count as empty."""
    line = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash), without the text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): the total shared by weight, no target above ``most`` times its source.

    ``weights`` repeat over the sources in code-point order, null last. What capped sources leave goes to the others by weight:
    with the sources ordered by cap over weight, the level at which the rest is poured is the first that does not pass the
    next cap, which is the highest of those that do not (capping a source that would not overflow only lowers the level).
    The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    budget = F.sum("source_size").over(everything) * share
    poured = ranked.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    leveled = poured.withColumn("fit", F.max(fits).over(everything))
    target = F.when(F.col("fit").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fit") * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def _next_level(docs: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    """Bounds one level finer: (source, rest, prefix, below, in_bucket, rows); prefix is the bucket in which the rest runs out."""
    shift, upper = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level - 1)
    same = docs["source"].eqNullSafe(bounds["source"])
    inside = docs.join(bounds.drop("in_bucket", "rows"), same).where(F.shiftright("hash", upper) == F.col("prefix"))
    histogram = inside.groupBy(bounds["source"], "rest", "prefix", "below", F.shiftright("hash", shift).alias("bucket")).agg(
        F.sum("size").alias("words"), F.count("*").alias("rows"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows a source
    start = F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0))
    over = histogram.withColumn("start", start).where(F.col("start") + F.col("words") > F.col("rest"))
    first = over.groupBy("source").agg(F.min_by(F.struct("rest", "bucket", "start", "words", "rows"), "bucket").alias("b"))
    return first.select(
        "source", "b.rest", F.col("b.bucket").alias("prefix"), F.col("b.start").alias("below"), F.col("b.words").alias("in_bucket"), "b.rows")


def thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, threshold): whole passes, and the hash below which documents are taken once more."""
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = written(targets.withColumn("passes", F.floor(share).cast("long")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")
    bounds = plan.where("rest > 0").select(
        "source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"),
        F.lit(0).cast("long").alias("in_bucket"), F.lit(2).cast("long").alias("rows"))
    ends = None
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        bounds = written(_next_level(docs, bounds, level), "mix-bounds")
        shift = HASH_BITS - LEVEL_BITS * level
        open_ = (F.col("rows") > 1) if shift else F.lit(False)
        # the last bucket is taken when that ends nearer to the target
        nearer = F.when((F.col("rest") - F.col("below")) * 2 >= F.col("in_bucket"), 1).otherwise(0)
        done = bounds.where(~open_).select("source", F.shiftleft(F.col("prefix") + nearer, shift).alias("threshold"))
        ends = done if ends is None else ends.unionByName(done)
        bounds = bounds.where(open_)
        if not bounds.agg(F.count("*")).first()[0]:
            break
    same = plan["source"].eqNullSafe(ends["source"])
    return plan.join(ends, same, "left").select(plan["source"], "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every document.

    ``copies`` is how often the document is taken, ``taken`` the words that gives. A source's words miss its target by at most
    half of one document (a repeated row ties with its like: all or none). Null text has no words, null source is a source
    and comes last, a source without words has target 0. Empty input gives no rows.
    """
    sizes = written(measured(docs), "mix-sizes")
    ends = written(thresholds(sizes, source_targets(sizes, weights, share, most)), "mix-ends").withColumnRenamed("source", "of_source")
    joined = sizes.join(ends, sizes["source"].eqNullSafe(ends["of_source"]))
    copies = (F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int")
    return joined.select("doc_id", "hash", "size", F.col("source_size").cast("long"), "target", copies.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns as they came, whatever their names."""
    sizes = written(measured(docs), "mix-sizes")
    ends = written(thresholds(sizes, source_targets(sizes, **how)), "mix-ends").select(F.col("source").alias("of_source"), "passes", "threshold")
    whole = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("whole"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"), F.col("source").cast("string").alias("source"))
    taken = whole.join(ends, F.col("source").eqNullSafe(F.col("of_source")))
    copies = (F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int")
    return taken.select("whole", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("whole.*")
