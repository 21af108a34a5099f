"""Dashboard feeds: display texts, recent rows and labelled histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfsight.functions import text as t
from shelfsight.operators import metadata as md

# --- fixed values: feed sizes -------------------------------------------------------
RECENT_REVIEWS = 50
RECENT_RELEASES = 20
RECENT_RUNS = 20
RECENT_EVENTS = 12


def first_text(*candidates: Column) -> Column:
    """First candidate that is not blank, trimmed."""
    return F.coalesce(*[t.blank_to_null(c) for c in candidates])


def author_shown(author: Column, source: Column) -> Column:
    """Hidden when it only repeats the source's name."""
    return F.when(F.lower(t.trim_ws(author)) != F.lower(t.trim_ws(source)), author)


def recent(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def labelled_histories(parts: list[DataFrame], limit: int = RECENT_EVENTS) -> DataFrame:
    """Newest events of several histories sharing (label, timestamp, event)."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.orderBy(F.col("timestamp").desc(), "label", "event").limit(limit)


def run_feed(runs: DataFrame, column: str = "metadata") -> DataFrame:
    """Run rows with typed metadata fields."""
    v = "_v"
    typed = runs.withColumn("_v", F.try_parse_json(F.col(column)))
    return typed.select(
        *[c for c in runs.columns if c != column],
        md.read_number(v, "$.averageCandidateConfidence").alias("average_confidence"),
        md.read_number(v, "$.maxCandidateConfidence").alias("max_confidence"),
        md.read_number(v, "$.fallbackCount").alias("fallback_count"),
        md.read_string(v, "$.failureStage").alias("failure_stage"),
        md.read_string(v, "$.noHitReason").alias("no_hit_reason"))


def duplicate_candidates(feed: DataFrame) -> DataFrame:
    """Other reviews of the same release inside the bounded moderation feed."""
    other = feed.select("release_id", F.col("review_id").alias("candidate_id"), F.coalesce("title", "source_name").alias("candidate"))
    return feed.select("review_id", "release_id").join(other, "release_id").filter("review_id <> candidate_id")


def global_counts(brands: DataFrame, families: DataFrame, sources: DataFrame, reviews: DataFrame) -> DataFrame:
    """Dashboard totals; each small total enters the review aggregate as a scalar."""
    def total(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    return reviews.agg(F.count("*").alias("reviews"), F.count_if(F.col("status") == "pending").alias("pending")).select(
        total(brands).alias("brands"), total(families).alias("families"), total(sources).alias("sources"), "reviews", "pending")


def review_feed(reviews: DataFrame, release: DataFrame, source: DataFrame, order: list[Column], limit: int = RECENT_REVIEWS) -> DataFrame:
    """Newest reviews of any status with labels; the cut comes before the joins."""
    newest = recent(reviews, order, limit)
    labels = release.select("release_id", F.concat_ws(" ", "family", "version_name").alias("release_label"))
    return newest.join(labels, "release_id").join(source.select("source_id", "source_name"), "source_id")


def release_feed(release: DataFrame, spec: DataFrame, status: DataFrame, limit: int = RECENT_RELEASES) -> DataFrame:
    """Newest releases with specs and summary state."""
    newest = recent(release, [F.col("release_year").desc_nulls_first(), F.col("family"), F.col("release_id")], limit)
    return newest.join(spec, "release_id", "left").join(status, "release_id", "left")


def gist(detail: DataFrame) -> DataFrame:
    """First available of buyer signal, overview, review text, usage and ride profile."""
    return detail.withColumn("gist", F.coalesce("buyer_signal", "summary.overview", "intelligence_text", "usage_summary", "ride_profile"))
