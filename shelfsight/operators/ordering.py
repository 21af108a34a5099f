"""Catalog orderings. Missing numbers rank lowest; ties fall to brand and release in the same direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfsight.session import cut_lineage

# sort name -> (key, direction)
NAMED_SORTS = {
    "latest": ("latest", "desc"), "oldest": ("latest", "asc"), "brand-a-z": ("brand", "asc"),
    "price-low": ("price", "asc"), "price-high": ("price", "desc"),
    "weight-light": ("weight", "asc"), "weight-heavy": ("weight", "desc"),
    "drop-low": ("drop", "asc"), "drop-high": ("drop", "desc"),
    "review-score": ("review-score", "desc"), "most-reviewed": ("review-count", "desc"),
}
SORT_COLUMNS = {
    "brand": ("brand", "model"), "price": ("price_usd",), "release-year": ("release_year",), "weight": ("weight_oz",),
    "heel-stack": ("heel_mm",), "forefoot-stack": ("forefoot_mm",), "drop": ("drop_mm",),
    "review-score": ("review_score",), "review-count": ("review_count",),
}


def relevance(q: str) -> Column:
    """5 for brand+release, 4 for brand+model, 2 for anywhere, 1 for current."""
    needle = q.strip().lower()
    exact = F.lower(F.concat_ws(" ", "brand", "release"))
    line = F.lower(F.concat_ws(" ", "brand", "model"))
    anywhere = F.concat_ws(" ", line, exact, F.lower(F.coalesce("usage_summary", F.lit(""))), F.lower("ride_profile"))
    return (
        F.when(exact.contains(needle), 5).otherwise(0) + F.when(line.contains(needle), 4).otherwise(0)
        + F.when(anywhere.contains(needle), 2).otherwise(0) + F.col("is_current").cast("int")
    )


def sort_keys(sort: str | None = None, direction: str | None = None, q: str | None = None, reference_order: bool = False) -> list[Column]:
    name = sort or ("relevance" if (q or "").strip() else "latest")
    latest = [F.col("is_current"), F.coalesce("release_year", F.lit(0))]
    if name == "relevance":
        parts = [relevance(q or ""), *latest]
        ranked = [p.asc() if reference_order else p.desc() for p in parts]
        return [*ranked, F.col("brand"), F.col("release"), F.col("release_id")]
    key, default = NAMED_SORTS.get(name, (name, "asc" if name == "brand" else "desc"))
    way = default if name in NAMED_SORTS and name != "latest" else (direction or default)
    parts = [F.col(c) for c in SORT_COLUMNS[key]] if key in SORT_COLUMNS else latest
    parts = [*parts, F.col("brand"), F.col("release"), F.col("release_id")]
    return [p.asc_nulls_first() if way == "asc" else p.desc_nulls_last() for p in parts]


def sort_catalog(cards: DataFrame, sort: str | None = None, direction: str | None = None, q: str | None = None,
                 reference_order: bool = False) -> DataFrame:
    return cards.orderBy(*sort_keys(sort, direction, q, reference_order))


def positioned(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Numbers the rows of an ordered frame from 1: place inside the sorted partition plus the counts of the partitions before it.

    Only one count per partition reaches the driver; no task holds more than its own range of the order.
    """
    placed = cut_lineage(ordered).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for number, count in counts:
        offsets += [F.lit(number), F.lit(before)]
        before += count
    start = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return placed.withColumn(name, (start + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).cast("bigint")).drop("_place")
