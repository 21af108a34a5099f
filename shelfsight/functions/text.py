"""Text, number and date expressions: Column in, Column out, all JVM side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from shelfsight.functions import lexicons as lx

# Whitespace as browsers define it: ASCII plus no-break, en/em and ideographic spaces.
WS = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expensive expression once; plain reuse would be inlined and re-evaluated per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def clean_text(c: Column) -> Column:
    """Runs of whitespace become one space. Printable ASCII is ruled out by one range, and a lone space stays as it is."""
    return F.trim(F.regexp_replace(c, f"(?=[^!-~])(?! (?!{WS})){WS}++", " "))


def blank_to_null(c: Column) -> Column:
    return let(trim_ws(c), lambda v: F.when(v != "", v))


def normalize_search_text(c: Column) -> Column:
    """Lower case, letter/digit borders split, everything else one space; a single pass that looks back from digits only where a letter can end.

    A lone space stays as it is, so that plain words cost no replacement."""
    pattern = "(?! [a-z0-9])[^a-z0-9]++|(?=[0-9])(?<=[a-z])|(?<=[0-9])(?=[a-z])"
    return F.trim(F.regexp_replace(F.lower(c), pattern, " "))


def search_aliases(c: Column) -> Column:
    normal = normalize_search_text(c)
    both = F.array_distinct(F.array(normal, F.replace(normal, F.lit(" "), F.lit(""))))
    return F.filter(both, lambda a: a != "")


def summarize_parts(parts: Sequence[Column], max_length: int | None = 420) -> Column:
    cleaned = F.concat_ws(" ", *[F.nullif(clean_text(p), F.lit("")) for p in parts])
    return F.trim(cleaned if max_length is None else F.substring(cleaned, 1, max_length))


def contains_any(haystack: Column, words: Sequence[str]) -> Column:
    return any_of([haystack.contains(w) for w in words])


def contains_any_word(haystack: Column, words: Sequence[str]) -> Column:
    """Whole-word variant for callers who do not want substring hits."""
    padded = F.concat(F.lit(" "), haystack, F.lit(" "))
    return any_of([padded.contains(f" {w} ") for w in words])


def count_hits(haystack: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [haystack.contains(w).cast("int") for w in words])


def sentiment_from_hits(positive: Column, negative: Column) -> Column:
    return (
        F.when(positive >= negative + 2, "positive")
        .when(negative >= positive + 2, "negative")
        .otherwise("mixed")
    )


def derive_sentiment(
    texts: Sequence[Column],
    positive: Sequence[str] = lx.POSITIVE_SIGNALS,
    negative: Sequence[str] = lx.NEGATIVE_SIGNALS,
) -> Column:
    counted = let(
        normalize_search_text(F.concat_ws(" ", *texts)),
        lambda h: F.struct(count_hits(h, positive).alias("positive"), count_hits(h, negative).alias("negative")),
    )
    return let(counted, lambda n: sentiment_from_hits(n["positive"], n["negative"]))


def labels_in(haystack: Column, patterns=lx.HIGHLIGHT_PATTERNS) -> Column:
    """Labels, in declared order, with any of their words in the normalised haystack."""
    return F.array_compact(F.array(*[F.when(contains_any(haystack, words), F.lit(label)) for label, words in patterns]))


def matching_labels(text: Column, patterns=lx.HIGHLIGHT_PATTERNS) -> Column:
    return let(normalize_search_text(text), lambda h: labels_in(h, patterns))


def extract_highlights(texts: Sequence[Column], max_highlights: int = 3, patterns=lx.HIGHLIGHT_PATTERNS) -> Column:
    """First labels found in any one of the texts; texts are joined by a border no word crosses."""
    per_text = F.concat_ws("\n", *[normalize_search_text(x) for x in texts])
    return F.slice(let(per_text, lambda h: labels_in(h, patterns)), 1, max_highlights)


def infer_themes(explicit: Column, texts: Sequence[Column], patterns=lx.HIGHLIGHT_PATTERNS) -> Column:
    known = F.coalesce(explicit, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(known, matching_labels(F.concat_ws(" ", *texts), patterns)))


def infer_terms(texts: Sequence[Column], patterns=lx.TERM_PATTERNS) -> Column:
    return matching_labels(F.concat_ws(" ", *texts), patterns)


def title_fingerprint(c: Column) -> Column:
    tokens = F.split(normalize_search_text(c), " ")
    return F.array_join(F.filter(tokens, lambda t: F.length(t) > 1), " ")


def token_set(fingerprint: Column) -> Column:
    return F.array_distinct(F.split(fingerprint, " "))


def overlap_is_similar(overlap: Column, size_a: Column, size_b: Column) -> Column:
    return overlap >= F.greatest(F.lit(2), F.least(size_a, size_b) - 1)


def fingerprints_similar(a: Column, b: Column) -> Column:
    left, right = token_set(a), token_set(b)
    shared = F.size(F.array_intersect(left, right))
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), False)
        .when(a == b, True)
        .otherwise(overlap_is_similar(shared, F.size(left), F.size(right)))
    )


def truncate_text(c: Column, limit: int) -> Column:
    def shorten(v: Column) -> Column:
        return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.substring(v, 1, limit - 1), F.lit("…")))

    return let(trim_ws(F.nullif(c, F.lit(""))), shorten)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim_ws(F.lower(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify_spelled_and(c: Column) -> Column:
    spelled = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def humanize(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "-"), capitalize), " ")


def humanize_url_slug(url: Column, prefix_pattern: str = "^https?://[^/]+/", fallback: Column | None = None) -> Column:
    """Last path segment with its extension and dashes removed."""
    path = F.regexp_replace(F.regexp_replace(url, prefix_pattern, ""), r"\.html$", "")
    segment = F.element_at(F.split(F.regexp_replace(path, "/$", ""), "/"), -1)
    words = clean_text(F.replace(segment, F.lit("-"), F.lit(" ")))
    return F.when(segment != "", words).otherwise(url if fallback is None else fallback)


def resolve_url(href: Column, base: str) -> Column:
    """Absolute form of a link, null when it cannot be one."""
    scheme = base.split(":", 1)[0]
    absolute = (
        F.when(href.rlike("(?i)^https?://[^/]+"), href)
        .when(href.startswith("//"), F.concat(F.lit(f"{scheme}:"), href))
        .when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(href.startswith("/"), F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(f"{base}/"), href))
    )
    return F.when(F.try_parse_url(absolute, F.lit("HOST")).isNotNull(), absolute)


def split_list(c: Column, separator: str, limit: int) -> Column:
    items = F.transform(F.split(c, separator), trim_ws)
    return F.slice(F.filter(items, lambda i: i != ""), 1, limit)


def site_url(c: Column) -> Column:
    full = F.when(c.rlike("(?i)^https?://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.regexp_replace(full, "/$", "")


def base_domain(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"(?i)^www\.", "")


def dedupe_texts(parts: Sequence[Column], limit: int = 3) -> Column:
    """First spelling of each case- and punctuation-insensitive text, order kept."""
    empty = F.array().cast("array<string>")
    merged = F.concat(*[F.coalesce(p, empty) for p in parts])
    trimmed = F.filter(F.transform(merged, trim_ws), lambda t: t != "")

    def first_seen(texts: Column) -> Column:
        keys = F.transform(texts, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
        return let(keys, lambda k: F.filter(texts, lambda _t, i: F.array_position(k, F.get(k, i)) == i + 1))

    return F.slice(let(trimmed, first_seen), 1, limit)


# --- numbers ---------------------------------------------------------------------

def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def normalize_score(value: Column, scale: Column) -> Column:
    ratio = round_half_up(value / scale * 100)
    return F.when(ratio.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), ratio)))


def auto_scale_score(value: Column) -> Column:
    return F.when(value <= 10, round_half_up(value * 10)).otherwise(round_half_up(value))


def clamp_confidence(points: Column) -> Column:
    """Integer hundredths to a 0..1 confidence; exact where float steps would drift."""
    return F.greatest(F.lit(0), F.least(F.lit(100), points)) / 100


def parse_number(c: Column) -> Column:
    parsed = trim_ws(c).try_cast("double")
    return F.when(F.abs(parsed) < float("inf"), parsed)


# --- dates -----------------------------------------------------------------------

DAY_MICROS = 86_400_000_000


def parse_timestamp(c: Column) -> Column:
    return F.coalesce(
        c.try_cast("timestamp"),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(c, F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(c, F.lit("MMM d, yyyy")),
        F.try_to_timestamp(c, F.lit("M/d/yyyy")),
    )


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def age_micros(ts: Column, as_of: Column) -> Column:
    return F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))


def freshness_e2(published_at: Column, as_of: Column) -> Column:
    """Freshness weight in hundredths by fractional age in days."""
    age = age_micros(published_at, as_of)
    rule = F.when(published_at.isNull(), lx.FRESHNESS_UNKNOWN)
    for days, weight in lx.FRESHNESS_STEPS:
        rule = rule.when(age <= days * DAY_MICROS, weight)
    return rule.otherwise(lx.FRESHNESS_OLD)


def source_weight_e4(source_type: Column) -> Column:
    return (
        F.when(source_type == "editorial", lx.SOURCE_WEIGHT_E4["editorial"])
        .when(source_type == "reddit", lx.SOURCE_WEIGHT_E4["reddit"])
        .otherwise(lx.SOURCE_WEIGHT_E4["user"])
    )


def review_weight_e4(source_type: Column, published_at: Column, as_of: Column) -> Column:
    """Source weight times freshness in ten-thousandths: an exact integer, so sums never drift."""
    return (source_weight_e4(source_type) * freshness_e2(published_at, as_of) / 100).cast("bigint")
