"""Score, confidence, agreement and wording rules shared by cards, details and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfsight.functions import lexicons as lx
from shelfsight.functions.text import round_half_up


def sentiment_score(sentiment: Column) -> Column:
    return (
        F.when(sentiment == "positive", lx.SENTIMENT_SCORE["positive"])
        .when(sentiment == "negative", lx.SENTIMENT_SCORE["negative"])
        .when(sentiment.isNotNull(), lx.SENTIMENT_SCORE["mixed"])
    )


def summary_sentiment_score(sentiment: Column, confidence: Column) -> Column:
    shift = F.when(confidence == "high", 3).when(confidence == "low", -3).otherwise(0)
    return sentiment_score(sentiment) + shift


def dominant_positive_first(positive: Column, mixed: Column, negative: Column) -> Column:
    """Heaviest class, ties positive > mixed > negative; null when nothing weighs."""
    return (
        F.when(F.greatest(positive, mixed, negative) <= 0, None)
        .when((positive >= mixed) & (positive >= negative), "positive")
        .when(mixed >= negative, "mixed").otherwise("negative")
    )


def dominant_never_null(positive: Column, mixed: Column, negative: Column) -> Column:
    """Heaviest class, ties positive > negative > mixed; never null."""
    return (
        F.when((positive >= mixed) & (positive >= negative), "positive")
        .when((negative >= mixed) & (negative >= positive), "negative").otherwise("mixed")
    )


def agreement(positive: Column, mixed: Column, negative: Column) -> Column:
    total = positive + mixed + negative
    return (
        F.when(total == 0, "mixed")
        .when((positive > 0) & (negative > 0) & (F.abs(positive - negative) <= 1), "split")
        .when(mixed >= total / 2, "mixed").otherwise("strong")
    )


def confidence_level(reviews: Column, sources: Column, summary_confidence: Column, agreed: Column | None = None) -> Column:
    points = (
        F.when(reviews >= 5, 2).when(reviews >= 3, 1).otherwise(0)
        + F.when(sources >= 3, 2).when(sources >= 2, 1).otherwise(0)
        + F.when(summary_confidence == "high", 1).when(summary_confidence == "low", -1).otherwise(0)
    )
    if agreed is not None:
        points = points - F.when(agreed == "split", 1).otherwise(0)
    return F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")


def source_alignment(editorial: Column, community: Column) -> Column:
    opposite = F.concat(editorial, F.lit("/"), community).isin("positive/negative", "negative/positive")
    return (
        F.when(editorial.isNull() | community.isNull(), "mixed")
        .when(editorial == community, "aligned").when(opposite, "divergent").otherwise("mixed")
    )


def composite(rating: Column, sentiment: Column) -> Column:
    """Unrounded mix of rating (.55) and sentiment (.45) over whichever is known."""
    return (
        F.when(rating.isNotNull() & sentiment.isNotNull(), (rating * F.lit(0.55) + sentiment * F.lit(0.45)) / (F.lit(0.55) + F.lit(0.45)))
        .when(rating.isNotNull(), rating * F.lit(0.55) / F.lit(0.55))
        .when(sentiment.isNotNull(), sentiment * F.lit(0.45) / F.lit(0.45))
    )


def intelligence_text(score: Column, sources: Column, reviews: Column) -> Column:
    tone = F.when(score >= 88, "Very strong").when(score >= 80, "Strong").when(score >= 70, "Mixed-positive").otherwise("Mixed")
    shown = F.when(sources == 0, reviews).otherwise(sources)
    return F.when(score.isNull(), "Review summary will appear here as soon as approved sources are available.").otherwise(
        F.concat(tone, F.lit(" review signal across "), shown.cast("string"), F.lit(" indexed sources and "),
                 reviews.cast("string"), F.lit(" approved reviews.")))


def channel_text(channel: str, score: Column, sentiment: Column) -> Column:
    tone = (
        F.when(sentiment == "positive", "positive").when(sentiment == "negative", "cautious").when(sentiment.isNotNull(), "mixed")
        .when(score >= 88, "very positive").when(score >= 80, "positive").when(score >= 72, "mixed-positive")
        .when(score >= 64, "mixed").otherwise("cautious")
    )
    return F.when(score.isNotNull() | sentiment.isNotNull(), F.concat(F.lit(f"{channel} sentiment reads "), tone, F.lit(".")))


def buyer_signal_text(score: Column) -> Column:
    tone = F.when(score >= 88, "Broadly positive").when(score >= 80, "Positive").when(score >= 72, "Mixed-positive").otherwise("Mixed")
    return F.when(score.isNull(), "Buyer guidance will appear here as more review content is indexed.").otherwise(
        F.concat(tone, F.lit(" buyer signal from the current mix of editorial and community reviews.")))


def coverage_grade(reviews: Column, sources: Column, days_since_freshest: Column) -> Column:
    return (
        F.when(reviews == 0, "thin").when(days_since_freshest > 365, "stale")
        .when((reviews < 2) | (sources < 2), "developing").otherwise("strong")
    )


def comparison_coverage(reviews: Column, sources: Column) -> Column:
    return F.when(reviews == 0, "thin").when((sources < 2) | (reviews < 2), "developing").otherwise("strong")


def coverage_status(approved: Column, editorial: Column, reddit: Column) -> Column:
    return (
        F.when(approved == 0, "thin").when(editorial == 0, "missing-editorial")
        .when(reddit == 0, "missing-community").when(approved >= 3, "healthy").otherwise("thin")
    )


def coverage_severity(status: Column) -> Column:
    return F.when(status == "missing-editorial", 0).when(status == "missing-community", 1).when(status == "thin", 2).otherwise(3)


def aggregate_intelligence(df: DataFrame) -> DataFrame:
    """Review read from (review_count, average_score, summary) alone; adds its columns."""
    s = F.col("summary")
    base = df.withColumns({
        "source_count": F.coalesce(s["source_count"], F.lit(0)),
        "evidence_count": F.coalesce(F.size(s["evidence"]), F.lit(0)).cast("bigint"),
        "sentiment_score": summary_sentiment_score(s["overall_sentiment"], s["confidence"]),
    })
    mixed = composite(F.col("average_score"), F.col("sentiment_score"))
    scored = base.withColumns({
        "review_score": round_half_up(mixed),
        "rating_score": round_half_up(F.col("average_score")),
        "confidence": confidence_level(F.col("review_count"), F.col("source_count"), s["confidence"]),
    })
    return scored.withColumns({
        "agreement": F.when(s["overall_sentiment"] == "mixed", "mixed")
        .when(F.col("confidence") == "high", "strong").otherwise("mixed"),
        "source_alignment": F.coalesce(s["source_alignment"], F.lit("mixed")),
        "intelligence_text": intelligence_text(F.col("review_score"), F.col("source_count"), F.col("review_count")),
    })
