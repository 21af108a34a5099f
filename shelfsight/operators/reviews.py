"""Review intelligence: weights, signals, themes, coverage and the full per-release read.

Sums run over integer ten-thousandths, so results do not depend on the order in which
partial aggregates meet, and every aggregate combines map-side before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfsight.functions import text as t
from shelfsight.operators import scoring


def review_star(reviews: DataFrame, release: DataFrame, family: DataFrame, source: DataFrame, author: DataFrame | None = None) -> DataFrame:
    """Approved reviews with catalog, source and optional author columns."""
    star = (
        reviews.filter(F.col("status") == "approved")
        .join(release, "release_id").join(family, "family_id").join(source, "source_id")
    )
    return star.join(author, "author_id", "left") if author is not None else star


def review_features(reviews: DataFrame, source: DataFrame, as_of: Column) -> DataFrame:
    """Approved reviews with source type, source key and weight."""
    published_day = F.date_trunc("day", F.col("published_at"))
    return (
        reviews.filter(F.col("status") == "approved")
        .join(source.select("source_id", "source_name", "source_type"), "source_id")
        .withColumns({
            "source_key": F.concat_ws(":", "source_type", "source_name"),
            "weight_e4": t.review_weight_e4(F.col("source_type"), published_day, as_of),
        })
    )


def feed_order() -> list[Column]:
    """Newest publication first, unknown dates before all, then the newest row, then the id."""
    return [F.col("published_at").desc_nulls_first(), F.col("created_at").desc_nulls_first(), F.col("review_id")]


def feed_position(*more: str) -> Column:
    """The feed order as one ascending value, so that the first of a group is a minimum."""
    return F.struct((-F.unix_micros("published_at")).alias("published"), (-F.unix_micros("created_at")).alias("created"), "review_id", *more)


def e2(sum_e4: Column) -> Column:
    """Ten-thousandths to two decimals, half up."""
    return F.floor((sum_e4 + 50) / 100) / 100


def weighted_average(value: Column, weight: Column) -> Column:
    """Aggregate of sum(v*w)/sum(w) over known values; null when empty or weightless."""
    known = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.sum(known))


def sentiment_weights(prefix: str = "") -> list[Column]:
    s, w = F.col("sentiment"), F.col("weight_e4")
    return [
        out for name in ("positive", "mixed", "negative")
        for out in (F.count_if(s == name).alias(f"{prefix}{name}_count"),
                    F.coalesce(F.sum(F.when(s == name, w)), F.lit(0)).alias(f"{prefix}{name}_e4"))
    ]


def highlight_rollup(features: DataFrame) -> DataFrame:
    """Count and weight per (release, highlight)."""
    return (
        features.select("release_id", "weight_e4", F.explode("highlights").alias("label"))
        .groupBy("release_id", "label")
        .agg(F.count("*").alias("mentions"), F.sum("weight_e4").alias("label_e4"))
    )


def top_highlights(rollup: DataFrame, limit: int = 4) -> DataFrame:
    heaviest = Window.partitionBy("release_id").orderBy(F.col("label_e4").desc(), F.col("mentions").desc(), "label")
    return rollup.withColumn("rank", F.row_number().over(heaviest)).filter(F.col("rank") <= limit)


def signal_summary(features: DataFrame) -> DataFrame:
    """Sentiment breakdown, weighted sentiment, dominant class, sources and top highlights per release."""
    counted = features.groupBy("release_id").agg(
        *sentiment_weights(), F.count_distinct("source_name").alias("source_count"))
    ranked = top_highlights(highlight_rollup(features)).groupBy("release_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "label", "mentions", e2(F.col("label_e4")).alias("weight")))).alias("top_highlights"))
    return counted.join(ranked, "release_id", "left").withColumn(
        "dominant", scoring.dominant_positive_first(F.col("positive_e4"), F.col("mixed_e4"), F.col("negative_e4")))


def review_coverage(features: DataFrame, as_of: Column) -> DataFrame:
    """Grade of approved coverage per release that has any."""
    freshest = F.date_trunc("day", F.col("freshest"))
    days = F.floor(t.age_micros(freshest, as_of) / t.DAY_MICROS)
    return (
        features.groupBy("release_id")
        .agg(F.count("*").alias("review_count"), F.count_distinct("source_key").alias("source_count"),
             F.max("published_at").alias("freshest"))
        .withColumn("days_since_freshest", days)
        .withColumn("grade", scoring.coverage_grade(F.col("review_count"), F.col("source_count"), F.col("days_since_freshest")))
        .withColumn("freshest", t.iso_date(F.col("freshest")))
    )


# --- themes -----------------------------------------------------------------------

def theme_rows(features: DataFrame) -> DataFrame:
    """One row per (review, theme); needs a `themes` array."""
    return features.select("*", F.posexplode("themes").alias("theme_pos", "theme")).withColumn("feed_position", feed_position("theme_pos"))


def theme_rollup(rows: DataFrame) -> DataFrame:
    """Sentiment counts, sources and reviews per (release, theme); no sentiment counts as mixed."""
    s = F.coalesce("sentiment", F.lit("mixed"))
    return rows.groupBy("release_id", "theme").agg(
        F.count_if(s == "positive").alias("positive"), F.count_if(s == "mixed").alias("mixed"),
        F.count_if(s == "negative").alias("negative"), F.count_distinct("source_key").alias("source_count"),
        F.count("*").alias("review_count"), F.min("feed_position").alias("first_position"))


def score_themes(rollup: DataFrame) -> DataFrame:
    dominant = scoring.dominant_never_null(F.col("positive"), F.col("mixed"), F.col("negative"))
    dominant_count = (F.when(F.col("dominant") == "positive", F.col("positive"))
                      .when(F.col("dominant") == "negative", F.col("negative")).otherwise(F.col("mixed")))
    ratio = dominant_count / F.col("review_count")
    return rollup.withColumn("dominant", dominant).withColumns({
        "confidence": F.when((F.col("source_count") >= 2) & (F.col("review_count") >= 2) & (ratio >= 0.7), "high")
        .when((F.col("source_count") >= 1) & (F.col("review_count") >= 1) & (ratio >= 0.5), "medium").otherwise("low"),
        "contested": (F.col("positive") > 0) & (F.col("negative") > 0),
    })


def top_themes(scored: DataFrame, notes: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Most sourced themes per release, ignored ones dropped before the cut."""
    rows = scored
    if notes is not None:
        ignored = notes.select("release_id", F.explode("ignored_themes").alias("theme")).distinct()
        rows = scored.join(ignored, ["release_id", "theme"], "left_anti")
    order = Window.partitionBy("release_id").orderBy(
        F.col("source_count").desc(), F.col("review_count").desc(), "first_position", "theme")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def takeaway_text(theme: Column) -> Column:
    verb = (F.when(theme["dominant"] == "positive", "leans positive")
            .when(theme["dominant"] == "negative", "leans negative").otherwise("is mixed"))
    contested = F.concat(theme["theme"], F.lit(" is contested across "), theme["source_count"].cast("string"), F.lit(" sources."))
    return F.when(theme["contested"], contested).otherwise(F.concat(theme["theme"], F.lit(" "), verb, F.lit(" across current reviews.")))


def themes_by_release(top: DataFrame) -> DataFrame:
    fields = ("rank", "theme", "dominant", "confidence", "contested", "source_count", "review_count")
    return top.groupBy("release_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("themes"),
        F.count_if("contested").alias("contradiction_count"))


def theme_reconciliation(features: DataFrame, notes: DataFrame) -> DataFrame:
    """Top themes, contradictions and takeaways; pinned takeaways replace derived ones."""
    top = top_themes(score_themes(theme_rollup(theme_rows(features))), notes)
    nested = themes_by_release(top).join(notes, "release_id", "left")
    derived = F.transform(F.slice("themes", 1, 3), takeaway_text)
    return nested.withColumn("takeaways", F.when(F.size("pinned_takeaways") > 0, F.col("pinned_takeaways")).otherwise(derived))


def quote_of(excerpt: Column, body: Column, length: int = 180) -> Column:
    """Evidence text of a review; cheap to compute once per text before it is joined to reviews."""
    return F.substring(t.trim_ws(F.coalesce(excerpt, body, F.lit(""))), 1, length)


def theme_evidence(features: DataFrame, limit: int = 3) -> DataFrame:
    """First non-empty quotes per (release, theme) in feed order; needs `quote` and `themes` columns."""
    quotes = theme_rows(features).filter(F.col("quote") != "")
    order = Window.partitionBy("release_id", "theme").orderBy(*feed_order())
    return (
        quotes.select("release_id", "theme", "published_at", "created_at", "review_id", "source_name", "source_type", "quote")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    )


def fallback_insights(themes: Column) -> dict[str, Column]:
    """Positive, concern, consensus and debate sentences from a release's top themes."""
    def say(rows: Column, limit: int, text) -> Column:
        return F.transform(F.slice(rows, 1, limit), text)

    def name(x: Column, suffix: str) -> Column:
        return F.concat(x["theme"], F.lit(suffix))

    calm = F.filter(themes, lambda x: ~x["contested"])
    contested = F.filter(themes, lambda x: x["contested"])
    return {
        "positives": say(F.filter(calm, lambda x: x["dominant"] == "positive"), 2, lambda x: name(x, " trends positive.")),
        "concerns": say(F.filter(themes, lambda x: (x["dominant"] == "negative") | x["contested"]), 2,
                        lambda x: F.when(x["contested"], name(x, " feedback is mixed.")).otherwise(name(x, " is the main concern."))),
        "consensus_points": say(calm, 3, lambda x: F.when(x["dominant"] == "positive", name(x, " leans positive.")).otherwise(name(x, " is mixed."))),
        "debates": say(contested, 3, lambda x: name(x, " is contested across sources.")),
    }


# --- the full read ------------------------------------------------------------------

CLASSES = ("positive", "mixed", "negative")


def release_sums(features: DataFrame) -> DataFrame:
    """Everything the full read needs, as one algebraic aggregate per release."""
    w, score, s = F.col("weight_e4"), F.col("score"), F.coalesce("sentiment", F.lit("unknown"))
    editorial = F.col("source_type") == "editorial"
    scored = score.isNotNull()

    def total(condition: Column, value: Column = w) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    columns = [
        F.count("*").alias("review_count"), F.count_distinct("source_key").alias("source_count"), F.avg("score").alias("average_score"),
        total(scored, score * w).alias("rated_vw"), total(scored).alias("rated_w"),
        total(scored & editorial, score * w).alias("ed_rated_vw"), total(scored & editorial).alias("ed_rated_w"),
        total(scored & ~editorial, score * w).alias("co_rated_vw"), total(~editorial).alias("co_w"),
        F.count_if(editorial).alias("ed_count"),
    ]
    for name in (*CLASSES, "unknown"):
        columns += [
            total((s == name) & editorial).alias(f"ed_{name}"), total((s == name) & ~editorial).alias(f"co_{name}"),
            total((s == name) & ~editorial & ~scored).alias(f"co_unrated_{name}"),
            F.count_if(s == name).alias(f"n_{name}"),
        ]
    return features.groupBy("release_id").agg(*columns)


def review_intelligence(features: DataFrame, summaries: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """Scores, channel reads, alignment, confidence, agreement and texts for every reviewed release."""
    joined = release_sums(features).join(summaries.select("release_id", "summary"), "release_id", "left")
    summary = F.col("summary")
    fallback = F.coalesce(summary["overall_sentiment"], F.lit("mixed"))

    def with_unknown(prefix: str, name: str) -> Column:
        return F.col(f"{prefix}{name}") + F.when(fallback == name, F.col(f"{prefix}unknown")).otherwise(0)

    def sentiment_mass(prefix: str) -> Column:
        return sum((scoring.sentiment_score(F.lit(name)) * with_unknown(prefix, name) for name in CLASSES), F.lit(0))

    channels = joined.withColumns({f"{p}{n}_all": with_unknown(p, n) for p in ("ed_", "co_") for n in CLASSES})
    all_mass = sentiment_mass("ed_") + sentiment_mass("co_")
    all_weight = sum((F.col(f"{p}{n}_all") for p in ("ed_", "co_") for n in CLASSES), F.lit(0))
    co_mass = F.col("co_rated_vw") + sentiment_mass("co_unrated_")

    def dominant(prefix: str, empty: Column) -> Column:
        return F.when(empty, summary["overall_sentiment"]).otherwise(
            scoring.dominant_positive_first(*[F.col(f"{prefix}{n}_all") for n in CLASSES]))

    scored = channels.withColumns({
        "rating": F.coalesce(F.try_divide("rated_vw", "rated_w"), F.col("average_score")),
        "sentiment_avg": F.coalesce(F.try_divide(all_mass, all_weight),
                                    scoring.summary_sentiment_score(summary["overall_sentiment"], summary["confidence"])),
        "editorial_avg": F.try_divide("ed_rated_vw", "ed_rated_w"),
        "community_avg": F.try_divide(co_mass, F.col("co_w")),
        "editorial_sentiment": F.coalesce(summary["editorial_sentiment"], dominant("ed_", F.col("ed_count") == 0)),
        "community_sentiment": F.coalesce(summary["community_sentiment"], dominant("co_", F.col("ed_count") == F.col("review_count"))),
        "agreement": scoring.agreement(F.col("n_positive"), F.col("n_mixed"), F.col("n_negative")),
        "evidence_count": F.coalesce(F.size(summary["evidence"]), F.least(F.col("review_count"), F.lit(6))).cast("bigint"),
    })
    rounded = scored.withColumns({
        "review_score": t.round_half_up(scoring.composite(F.col("rating"), F.col("sentiment_avg"))),
        "rating_score": t.round_half_up(F.col("rating")),
        "sentiment_score": t.round_half_up(F.col("sentiment_avg")),
        "editorial_score": t.round_half_up(F.col("editorial_avg")),
        "community_score": t.round_half_up(F.col("community_avg")),
        "confidence": scoring.confidence_level(F.col("review_count"), F.col("source_count"), summary["confidence"], F.col("agreement")),
        "source_alignment": F.coalesce(summary["source_alignment"],
                                       scoring.source_alignment(F.col("editorial_sentiment"), F.col("community_sentiment"))),
    })
    told = rounded.withColumns({
        "editorial_text": scoring.channel_text("Editorial", F.col("editorial_avg"), F.col("editorial_sentiment")),
        "community_text": scoring.channel_text("Community", F.col("community_avg"), F.col("community_sentiment")),
        "intelligence_text": scoring.intelligence_text(F.col("review_score"), F.col("source_count"), F.col("review_count")),
        "buyer_signal": F.coalesce(summary["buyer_signal"], scoring.buyer_signal_text(F.col("review_score"))),
    })
    keep = ["release_id", "review_count", "source_count", "evidence_count", "review_score", "rating_score", "sentiment_score",
            "editorial_score", "community_score", "editorial_sentiment", "community_sentiment", "source_alignment", "confidence",
            "agreement", "editorial_text", "community_text", "intelligence_text", "buyer_signal"]
    if themes is None:
        return told.select(*keep)
    lists = fallback_insights(F.col("themes"))
    stored = {"positives": F.slice(summary["pros"], 1, 2), "concerns": F.slice(summary["cons"], 1, 2),
              "consensus_points": F.slice(summary["consensus_points"], 1, 3), "debates": F.slice(summary["debates"], 1, 3)}
    empty = F.array().cast("array<string>")
    return told.join(themes.select("release_id", "themes"), "release_id", "left").select(
        *keep, *[F.coalesce(stored[name], lists[name], empty).alias(name) for name in lists])
