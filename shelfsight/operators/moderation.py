"""Editorial state: moderation events, manual intake and summary refresh deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfsight.functions import lexicons as lx, text as t
from shelfsight.operators import metadata as md


def apply_moderation(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Reviews after all events. Events: review_id, seq, kind (status | override), status, sentiment, highlights_text, duplicate_of.

    The last override sets sentiment, highlights and duplicate (blank clears them); status follows
    the last event that sets one, and naming a duplicate flags the review. A hot review is safe:
    both aggregates keep one row per review and combine map-side.
    """
    other = F.when(t.blank_to_null(F.col("duplicate_of")) != F.col("review_id"), t.blank_to_null(F.col("duplicate_of")))
    override = F.col("kind") == "override"
    typed = events.select(
        "review_id", "seq", override.alias("is_override"), t.blank_to_null(F.col("sentiment")).alias("sentiment"),
        t.split_list(F.coalesce("highlights_text", F.lit("")), ",", 4).alias("highlights"), other.alias("duplicate_of"),
        F.when(~override, F.col("status")).when(other.isNotNull(), "flagged").alias("new_status"))
    last = typed.groupBy("review_id").agg(
        F.max_by(F.when(F.col("is_override"), F.struct("sentiment", "highlights", "duplicate_of")), F.when(F.col("is_override"), F.col("seq"))).alias("_o"),
        F.max_by("new_status", F.when(F.col("new_status").isNotNull(), F.col("seq"))).alias("_status"),
        F.count_if("is_override").alias("override_count"))
    edited = F.col("_o").isNotNull()
    return reviews.join(last, "review_id", "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "sentiment": F.when(edited, F.col("_o.sentiment")).otherwise(F.col("sentiment")),
        "highlights": F.when(edited, F.col("_o.highlights")).otherwise(F.col("highlights")),
        "duplicate_of": F.col("_o.duplicate_of"),
        "highlight_override": F.coalesce(F.size("_o.highlights") > 0, F.lit(False)),
        "override_count": F.coalesce("override_count", F.lit(0)),
    }).drop("_o", "_status")


def manual_intake(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted pending reviews, quarantined rows): release, source and url are required, blanks become null."""
    typed = rows.withColumns({c: t.blank_to_null(F.col(c)) for c in ("release_key", "source_key", "source_url", "author_name", "title", "excerpt", "sentiment")})
    typed = typed.withColumn("score", t.parse_number(F.col("score_text")).cast("int"))
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("release_key", "source_key", "source_url")])
    bad_sentiment = F.col("sentiment").isNotNull() & ~F.col("sentiment").isin(*lx.SENTIMENTS)
    judged = typed.withColumn("error", F.when(missing != "", F.concat(F.lit("missing "), missing)).when(bad_sentiment, "sentiment"))
    accepted = judged.filter("error IS NULL").drop("error", "score_text").withColumn("status", F.lit("pending"))
    return accepted, judged.filter("error IS NOT NULL")


def refresh_delta(changed: DataFrame, summaries: DataFrame, had_summary: DataFrame, timestamp: Column) -> DataFrame:
    """History event per changed release: generated, refreshed, or cleared when no approved review is left."""
    rows = changed.select("release_id").distinct().join(had_summary, "release_id").join(summaries, "release_id", "left")
    event = F.when(F.col("provider").isNull(), "cleared").when(F.col("had_summary"), "refreshed").otherwise("generated")
    zero = F.lit(0)
    return rows.select(
        "release_id", timestamp.alias("timestamp"), event.alias("event_type"), "provider", "overview", "overall_sentiment", "confidence",
        *[F.coalesce(c, zero).alias(c) for c in ("review_count", "source_count", "evidence_count")])


def refresh_counters(delta: DataFrame) -> DataFrame:
    e = F.col("event_type")
    return delta.agg(F.count_if(e == "generated").alias("generated"), F.count_if(e == "refreshed").alias("refreshed"),
                     F.count_if(e == "cleared").alias("skipped"), F.count_if(F.col("provider") == "heuristic").alias("heuristic"))


def had_summary(metadata: DataFrame) -> DataFrame:
    return metadata.select("release_id", F.expr(md.truth_sql("try_parse_json(metadata)", f"$.{md.SUMMARY_KEY}")).alias("had_summary"))
