"""Enum domains, word lists, weights and wording that results depend on.

Every operator takes its lexicon as a parameter and falls back to these defaults.
"""

from __future__ import annotations

# --- fixed values: enum domains ------------------------------------------------
SOURCE_TYPES = ("editorial", "reddit", "user")
SENTIMENTS = ("positive", "mixed", "negative")
REVIEW_STATUSES = ("pending", "approved", "rejected", "flagged")
CONFIDENCES = ("low", "medium", "high")
ALIGNMENTS = ("aligned", "mixed", "divergent")
AUDIENCES = ("mens", "womens", "unisex", "other", "unknown")
RUN_STATUSES = ("queued", "running", "succeeded", "partial", "failed")
CADENCES = ("manual", "hourly", "daily", "weekly")
HISTORY_EVENTS = ("generated", "refreshed", "cleared", "override-enabled", "override-disabled")
SUMMARY_PROVIDERS = ("openai", "heuristic")
HISTORY_PROVIDERS = ("openai", "heuristic", "editorial")

# --- fixed values: sentiment words ---------------------------------------------
POSITIVE_SIGNALS = (
    "love", "great", "excellent", "favorite", "fast", "smooth",
    "comfortable", "fun", "impressive", "stable", "versatile", "responsive",
)
NEGATIVE_SIGNALS = (
    "bad", "harsh", "firm", "unstable", "disappointing", "hate",
    "issue", "problem", "blister", "pain", "stiff", "awkward",
)

# --- fixed values: highlight / theme labels in declared order -------------------
HIGHLIGHT_PATTERNS = (
    ("Cushioning", ("cushion", "soft", "firm", "stack", "foam", "protective")),
    ("Fit", ("fit", "sizing", "wide", "narrow", "upper", "lockdown")),
    ("Ride", ("ride", "smooth", "transition", "responsive", "bouncy", "snappy")),
    ("Stability", ("stable", "stability", "wobble", "tippy", "support")),
    ("Speed", ("tempo", "fast", "race", "workout", "interval", "uptempo")),
    ("Value", ("value", "price", "worth", "msrp", "expensive", "cheap")),
    ("Traction", ("traction", "grip", "outsole", "wet", "slip")),
    ("Durability", ("durable", "durability", "wear", "miles", "hold up")),
)

# --- fixed values: summary terms in declared order ------------------------------
TERM_PATTERNS = (
    ("Fit", ("fit", "upper", "toe box", "lockdown", "roomy", "narrow")),
    ("Ride", ("ride", "transition", "roll", "stable ride", "smooth")),
    ("Cushioning", ("cushion", "soft", "firm", "protective", "comfort")),
    ("Speed", ("fast", "tempo", "speed", "snappy", "responsive")),
    ("Value", ("value", "price", "worth", "expensive", "overpriced")),
    ("Stability", ("stable", "stability", "supportive", "tippy")),
    ("Traction", ("traction", "grip", "outsole", "slippery")),
    ("Durability", ("durable", "durability", "wear", "rubber")),
)
NEGATIVE_BIASED_TERMS = ("Value", "Fit")
MIXED_SIGNAL_TERMS = ("Fit", "Ride", "Value", "Stability")

# --- fixed values: weights, kept as ten-thousandths so sums are exact ------------
SOURCE_WEIGHT_E4 = {"editorial": 10000, "reddit": 7000, "user": 5500}
FRESHNESS_STEPS = ((120, 100), (365, 85), (730, 70))
FRESHNESS_OLD = 55
FRESHNESS_UNKNOWN = 65
SENTIMENT_SCORE = {"positive": 86, "mixed": 69, "negative": 48}

# --- fixed values: summary wording ----------------------------------------------
POSITIVE_TERM_TEXT = {
    "Fit": "Fit feedback trends positive overall.",
    "Ride": "Ride quality is a recurring positive theme.",
    "Cushioning": "Cushioning is generally well received.",
    "Speed": "Speed and responsiveness show up consistently.",
    "Value": "Value looks strong relative to the market.",
    "Stability": "Stability and control are recurring positives.",
    "Traction": "Traction feedback is mostly favorable.",
    "Durability": "Durability signal looks positive so far.",
}
NEGATIVE_TERM_TEXT = {
    "Fit": "Fit is the most common area of hesitation.",
    "Ride": "Ride feel is a recurring complaint.",
    "Cushioning": "Cushioning setup is a frequent tradeoff.",
    "Speed": "Speed expectations are not universally met.",
    "Value": "Price-to-performance is a common concern.",
    "Stability": "Stability is a concern in some reviews.",
    "Traction": "Traction confidence is uneven.",
    "Durability": "Durability confidence is still weak.",
}
SUMMARY_TEXT = {
    "pros_fallback": "Promising overall ride signal across current sources.",
    "cons_fallback_positive": "Tradeoffs are still limited in the current review set.",
    "cons_fallback": "Mixed feedback across the current review set.",
    "best_speed": "Runners who want a shoe that can handle faster training and uptempo work.",
    "best_cushioning": "Runners looking for a more protective daily or long-run ride.",
    "best_trail": "Trail runners who care about grip and underfoot confidence.",
    "best_stability": "Runners who want extra guidance without moving into a heavy stability shoe.",
    "best_fallback": "Runners comparing this model against its direct category peers.",
    "watch_fit": "Fit comments vary enough that sizing and upper shape should be checked closely.",
    "watch_value": "Price-to-performance comes up often, so compare MSRP against close alternatives.",
    "watch_mixed": (
        "Fit your expectations to the shoe's more specific use case rather than treating it "
        "like a do-everything option."
    ),
    "consensus_fallback": "Consensus is still forming across the current sources.",
    "debates_fallback": "Sources disagree on a few buying tradeoffs.",
}

# --- fixed values: candidate filters --------------------------------------------
PAGE_CHROME_TOKENS = ("subscribe", "newsletter", "follow us", "shop", "podcast")
PARTNER_CHROME_TOKENS = (
    "road trail run receives", "shopping at our partners", "comments are moderated",
)
NON_REVIEW_SLUG_TOKENS = (
    "best ", "preview", "drops", "sale", "currently running",
    "weekly rundown", "blue jean mile", "believe in the run austin",
)
NON_REVIEW_LINK_TOKENS = (
    "best-", "gift-guide", "preview", "previews", "race-report", "stories",
    "gear-review", "watch-review", "sock-review", "jacket-review",
)
DEAL_TOKENS = (
    "discount", "sale", "deal", "coupon", "promo", "code", "rei x", "rei",
    "running warehouse", "runningwarehouse", "saucony com", "sauconycom",
    "nike com", "nikecom", "dicks", "sporting goods",
)
THREAD_REVIEW_TOKENS = (
    "review", "impressions", "impression", "first run", "first run thoughts", "thoughts",
    "fit", "sizing", "miles", "kilometers", "km", "trainer rotation", "compared", "comparison",
)
