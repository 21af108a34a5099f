"""Faceted catalog filters, feed filters and type-ahead; blank arguments mean no filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfsight.functions import text as t

RANGE_COLUMNS = {
    "release_year": "release_year", "price": "price_usd", "weight": "weight_oz",
    "heel": "heel_mm", "forefoot": "forefoot_mm", "drop": "drop_mm",
}


def parse_bound(value) -> float | None:
    """Numeric filter argument; blank or unreadable text is ignored."""
    try:
        number = float(str(value).strip()) if value is not None and str(value).strip() else None
    except ValueError:
        return None
    return number if number is not None and abs(number) < float("inf") else None


def text_contains(q: str | None) -> Column:
    needle = (q or "").strip().lower()
    if not needle:
        return F.lit(True)
    none = F.lit("")
    haystack = F.concat_ws(" ", "brand", "model", "release", F.coalesce("usage_summary", none), "ride_profile", F.coalesce("foam", none))
    return F.lower(haystack).contains(needle)


def in_range(column: str, low=None, high=None) -> Column:
    """Inclusive; a missing value fails only when a bound is set."""
    lo, hi = parse_bound(low), parse_bound(high)
    rule = F.lit(True)
    if lo is not None:
        rule = rule & (F.col(column) >= lo)
    if hi is not None:
        rule = rule & (F.col(column) <= hi)
    return rule


def cushion_band(level: str | None) -> Column:
    if not (level or "").strip():
        return F.lit(True)
    stack = F.coalesce("heel_mm", "forefoot_mm")
    bands = {"low": stack <= 29, "moderate": stack.between(30, 35), "max": stack >= 36}
    return bands.get(level, stack.isNotNull())


def filter_catalog(cards: DataFrame, *, q=None, brand=None, category=None, terrain=None, stability=None, plated=None,
                   current=None, cushion=None, min_review_score=None, min_review_count=None, **ranges) -> DataFrame:
    """Ranges are given as min_<name> / max_<name> for release_year, price, weight, heel, forefoot, drop."""
    rules = [text_contains(q), cushion_band(cushion)]
    for column, wanted in (("brand", brand), ("category", category), ("terrain", terrain), ("stability", stability)):
        if wanted:
            rules.append(F.col(column) == wanted)
    if plated in ("plated", "non-plated"):
        rules.append(F.col("is_plated") == (plated == "plated"))
    if current == "current":
        rules.append(F.col("is_current"))
    for name, column in RANGE_COLUMNS.items():
        rules.append(in_range(column, ranges.pop(f"min_{name}", None), ranges.pop(f"max_{name}", None)))
    if ranges:
        raise TypeError(f"unknown filters {sorted(ranges)}")
    score, count = parse_bound(min_review_score), parse_bound(min_review_count)
    if score is not None:
        rules.append(F.coalesce("review_score", F.lit(-1)) >= score)
    if count is not None:
        rules.append(F.col("review_count") >= count)
    out = cards
    for rule in rules:
        out = out.filter(rule)
    return out


def filter_feed(feed: DataFrame, *, brand=None, family=None, release=None, source=None) -> DataFrame:
    """The release filter counts only when that release belongs to the chosen family."""
    out = feed
    if brand:
        out = out.filter(F.col("brand") == brand)
    if family:
        out = out.filter(F.col("family_slug") == family)
        if release:
            belongs = feed.filter((F.col("family_slug") == family) & (F.col("release_slug") == release)).exists()
            out = out.filter(~belongs | (F.col("release_slug") == release))
    if source:
        out = out.filter(F.col("source_id") == source)
    return out


def simple_normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def type_ahead(options: DataFrame, query: Column, label: str = "search_label") -> DataFrame:
    """Options whose label holds every query term; a blank query passes all."""
    terms = F.filter(F.split(simple_normal(query), " "), lambda w: w != "")
    return options.filter(t.let(simple_normal(F.col(label)), lambda h: F.forall(terms, lambda w: h.contains(w))))
