"""Catalog star, cards, spec resolution, release diffs and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfsight.functions import text as t
from shelfsight.operators import scoring
from shelfsight.session import cut_lineage

SPEC_FIELDS = ("weight_oz", "heel_mm", "forefoot_mm", "drop_mm", "fit_notes", "source_notes")


def release_star(release: DataFrame, family: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    star = release.join(family, "family_id")
    return star.join(spec, "release_id", "left") if spec is not None else star


def approved_stats(reviews: DataFrame) -> DataFrame:
    """Approved count and plain average per release; aggregated before any join."""
    return (
        reviews.filter(F.col("status") == "approved")
        .groupBy("release_id")
        .agg(F.count("*").alias("review_count"), F.avg("score").alias("average_score"))
    )


def ride_profile(foam: Column, is_plated: Column) -> Column:
    return F.concat_ws(", ", F.nullif(foam, F.lit("")), F.when(is_plated, "Plated").otherwise("Non-plated"))


def catalog_cards(release: DataFrame, family: DataFrame, spec: DataFrame, reviews: DataFrame, summaries: DataFrame) -> DataFrame:
    """One card per release with display values, specs and the aggregate review read."""
    joined = (
        release_star(release, family, spec)
        .join(approved_stats(reviews), "release_id", "left")
        .join(summaries.select("release_id", "summary"), "release_id", "left")
        .withColumn("review_count", F.coalesce("review_count", F.lit(0)))
    )
    shown = joined.select(
        "release_id", "brand", F.col("family").alias("model"), "family_id", F.col("version_name").alias("release"),
        t.slugify(F.col("version_name")).alias("release_slug"),
        t.slugify(F.col("family_id")).alias("family_slug"),
        "release_year",
        t.humanize(F.col("category")).alias("category"),
        t.humanize(F.col("terrain")).alias("terrain"),
        t.capitalize(F.col("stability")).alias("stability"),
        "foam", ride_profile(F.col("foam"), F.col("is_plated")).alias("ride_profile"), "usage_summary",
        F.col("msrp_usd").cast("double").alias("price_usd"),
        F.col("weight_oz").cast("double").alias("weight_oz"),
        "heel_mm", "forefoot_mm", "drop_mm", "review_count", "average_score", "is_plated", "is_current", "summary",
    )
    return scoring.aggregate_intelligence(shown)


def variants_by_release(variants: DataFrame) -> DataFrame:
    """Nested variants, primary first then label."""
    ordered = F.array_sort(F.collect_list(F.struct(
        (~F.col("is_primary")).alias("not_primary"), "display_label", "variant_key", "audience", "is_primary",
        "weight_oz", "heel_mm", "forefoot_mm", "drop_mm",
    )))
    return variants.groupBy("release_id").agg(
        F.transform(ordered, lambda v: v.dropFields("not_primary")).alias("variants"),
        (F.bool_or(F.col("audience") == "mens") & F.bool_or(F.col("audience") == "womens")).alias("has_mens_and_womens"),
    )


def pick_variant(variants: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Requested key, else the primary, else the first label: one variant per release."""
    rows = variants
    match = F.lit(0)
    if requested is not None:
        rows = variants.join(requested.select("release_id", F.col("variant_key").alias("wanted_key")), "release_id", "left")
        match = F.coalesce((F.col("variant_key") == F.col("wanted_key")).cast("int"), F.lit(0))
    best = Window.partitionBy("release_id").orderBy(
        match.desc(), F.col("is_primary").desc(), "display_label", "variant_key")
    return rows.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank", "wanted_key")


def resolve_specs(release: DataFrame, spec: DataFrame, chosen: DataFrame) -> DataFrame:
    """Selected variant's value, else the one-to-one spec's, for every spec field."""
    old = spec.select("release_id", *[F.col(c).alias(f"old_{c}") for c in SPEC_FIELDS])
    return (
        release.join(chosen.select("release_id", "variant_key", *SPEC_FIELDS), "release_id", "left")
        .join(old, "release_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"old_{c}")) for c in SPEC_FIELDS})
        .drop(*[f"old_{c}" for c in SPEC_FIELDS])
    )


# --- release over release ---------------------------------------------------------

def line_order() -> list[Column]:
    return [F.col("release_year").desc_nulls_first(), F.col("is_current").desc(), F.col("version_name"), F.col("release_id")]


def with_previous(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Adds `previous`, the next older release of the family.

    The whole order (family, then newest first) is cut into ranges, so a family of any size spreads over tasks. Inside a range the next row is
    local; a range's last row looks at the first row of the following one, and there is one such row per range.
    """
    order = [F.col("family_id"), *line_order()]
    head = F.struct("family_id", "_kept")
    ranged = rows.withColumn("_kept", F.struct(*fields)).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33))
    heads = placed.groupBy("_part").agg(F.min_by(head, "_place").alias("_head"))
    following = heads.select("_part", F.lead("_head").over(Window.orderBy("_part")).alias("_following"))
    local = placed.withColumn("_next", F.lead(head).over(Window.partitionBy("_part").orderBy("_place")))
    joined = local.join(F.broadcast(following), "_part", "left").withColumn("_next", F.coalesce("_next", "_following"))
    previous = F.when(F.col("_next.family_id").eqNullSafe(F.col("family_id")) & F.col("_next").isNotNull(), F.col("_next._kept"))
    return joined.withColumn("previous", previous).drop("_part", "_place", "_next", "_following", "_kept")


def plain_number(c: Column) -> Column:
    """Decimal text without trailing zeros: 130.00 -> 130."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def format_usd(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), plain_number(c)), F.lit("unknown"))


def format_oz(c: Column) -> Column:
    return F.coalesce(F.concat(plain_number(c), F.lit(" oz")), F.lit("unknown"))


def format_mm(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0)) == 0, "unknown").otherwise(F.concat(c.cast("string"), F.lit(" mm")))


def format_stack(heel: Column, forefoot: Column) -> Column:
    missing = (F.coalesce(heel, F.lit(0)) == 0) | (F.coalesce(forefoot, F.lit(0)) == 0)
    return F.when(missing, "unknown").otherwise(
        F.concat(heel.cast("string"), F.lit("/"), forefoot.cast("string"), F.lit(" mm")))


DIFF_FIELDS = ["version_name", "foam", "is_plated", "msrp_usd", "weight_oz", "heel_mm", "forefoot_mm", "drop_mm", "summary"]
DIFF_SUMMARY_FIELDS = ("overview", "overall_sentiment", "best_for", "pros", "review_count", "source_count")
BASELINE_TEXT = "Baseline release for this shoe line in the current catalog."
NO_CHANGE_TEXT = "No major structured changes detected from the previous version."


def _changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _lead_shift(before: Column, after: Column, prefix: str) -> Column:
    old, new = F.get(before, F.lit(0)), F.get(after, F.lit(0))
    return F.when((old != "") & (new != "") & (old != new), F.concat(F.lit(prefix + " “"), old, F.lit("” to “"), new, F.lit("”.")))


def change_items(limit: int = 4) -> Column:
    """Ordered change sentences of a release against its `previous`; null items are dropped."""
    def now(c):
        return F.col(c)

    def was(c):
        return F.col(f"previous.{c}")

    new_sum, old_sum = F.col("summary"), F.col("previous.summary")
    comparable = (
        (new_sum["review_count"] >= 2) & (old_sum["review_count"] >= 2)
        & (new_sum["source_count"] >= 1) & (old_sum["source_count"] >= 1)
    )
    comparable = F.coalesce(comparable, F.lit(False))
    items = F.array(
        F.when(_changed(now("foam"), was("foam")), F.concat(
            F.lit("Foam changed from "), F.coalesce(was("foam"), F.lit("unknown")), F.lit(" to "),
            F.coalesce(now("foam"), F.lit("unknown")), F.lit("."))),
        F.when(now("is_plated") != was("is_plated"), F.when(now("is_plated"), "Plate added to this version.")
               .otherwise("Plate removed from this version.")),
        F.when(_changed(now("msrp_usd"), was("msrp_usd")), F.concat(
            F.lit("MSRP moved from "), format_usd(was("msrp_usd")), F.lit(" to "), format_usd(now("msrp_usd")), F.lit("."))),
        F.when(_changed(now("weight_oz"), was("weight_oz")), F.concat(
            F.lit("Men's weight shifted from "), format_oz(was("weight_oz")), F.lit(" to "), format_oz(now("weight_oz")), F.lit("."))),
        F.when(_changed(now("heel_mm"), was("heel_mm")) | _changed(now("forefoot_mm"), was("forefoot_mm")), F.concat(
            F.lit("Stack changed from "), format_stack(was("heel_mm"), was("forefoot_mm")), F.lit(" to "),
            format_stack(now("heel_mm"), now("forefoot_mm")), F.lit("."))),
        F.when(_changed(now("drop_mm"), was("drop_mm")), F.concat(
            F.lit("Drop changed from "), format_mm(was("drop_mm")), F.lit(" to "), format_mm(now("drop_mm")), F.lit("."))),
        F.when(comparable & (new_sum["overall_sentiment"] != old_sum["overall_sentiment"]), F.concat(
            F.lit("Overall review sentiment shifted from "), old_sum["overall_sentiment"], F.lit(" to "),
            new_sum["overall_sentiment"], F.lit("."))),
        F.when(comparable, _lead_shift(old_sum["best_for"], new_sum["best_for"], "Best-for signal moved from")),
        F.when(comparable, _lead_shift(old_sum["pros"], new_sum["pros"], "Reviewers shifted from")),
        F.when(~comparable & (new_sum["overview"] != old_sum["overview"]),
               F.lit("Review sentiment changed noticeably from the previous version.")),
    )
    return F.slice(F.array_compact(items), 1, limit)


def release_changes(rows: DataFrame) -> DataFrame:
    """Change sentences for every release against the previous one in its family."""
    paired = with_previous(rows, DIFF_FIELDS).withColumn("_items", change_items())
    return paired.select(
        "family_id", "release_id", F.col("version_name").alias("release"),
        F.col("previous.version_name").alias("previous_release"),
        F.when(F.col("previous").isNull(), F.array(F.lit(BASELINE_TEXT)))
        .when(F.size("_items") == 0, F.array(F.lit(NO_CHANGE_TEXT)))
        .otherwise(F.col("_items")).alias("changes"),
    )


def change_teaser(changes: DataFrame) -> DataFrame:
    return changes.withColumn("teaser", F.slice("changes", 1, 2))


def featured_release(rows: DataFrame) -> DataFrame:
    """Newest release per family."""
    newest = Window.partitionBy("family_id").orderBy(*line_order())
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def first_seen_values(rows: DataFrame, value: str, position: Column) -> DataFrame:
    """Distinct values ranked by where they first occur."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.min(position).alias("first_position"))


def release_detail(cards: DataFrame, spec: DataFrame, variants: DataFrame, chosen: DataFrame, intelligence: DataFrame,
                   coverage: DataFrame, signals: DataFrame, themes: DataFrame) -> DataFrame:
    """Full page record per release: card, resolved specs, nested variants and every review roll-up.

    Each part is one row per release, so the parts meet in co-partitioned left joins.
    """
    base = resolve_specs(cards.drop(*SPEC_FIELDS, *_ROLLUPS), spec, chosen)
    rows = base.join(variants_by_release(variants), "release_id", "left")
    read = intelligence.select("release_id", *[c for c in intelligence.columns if c not in rows.columns])
    parts = (
        read,
        coverage.select("release_id", "grade", "freshest"),
        signals.select("release_id", "dominant", "top_highlights"),
        themes.select("release_id", "themes", "contradiction_count", "takeaways"),
    )
    for part in parts:
        rows = rows.join(part, "release_id", "left")
    return rows


_ROLLUPS = ("review_count", "average_score", "source_count", "evidence_count", "sentiment_score", "review_score", "rating_score",
            "confidence", "agreement", "source_alignment", "intelligence_text")
