"""Heuristic release summaries and validation of summary candidates that arrive as text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfsight.functions import lexicons as lx, text as t
from shelfsight.operators import metadata as md, reviews as rv, scoring

EVIDENCE_LENGTH = 220
WORDING = lx.SUMMARY_TEXT


def _lookup(texts: dict[str, str], term: Column, suffix: str) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*texts.items())])
    return F.coalesce(F.get(F.filter(F.map_entries(table), lambda e: e["key"] == term), F.lit(0))["value"], F.concat(term, F.lit(suffix)))


def positive_text(term: Column) -> Column:
    return _lookup(lx.POSITIVE_TERM_TEXT, term, " trends positive.")


def negative_text(term: Column) -> Column:
    return _lookup(lx.NEGATIVE_TERM_TEXT, term, " trends negative.")


def term_rollup(reviews: DataFrame) -> DataFrame:
    """Mentions, positive and negative counts and first place in the feed per (release, term); needs a `terms` array."""
    return (
        reviews.select("release_id", "sentiment", "published_at", "created_at", "review_id", F.posexplode("terms").alias("pos", "term"))
        .groupBy("release_id", "term")
        .agg(F.count("*").alias("mentions"), F.count_if(F.col("sentiment") == "positive").alias("positive"),
             F.count_if(F.col("sentiment") == "negative").alias("negative"), F.min(rv.feed_position("pos")).alias("first_position"))
    )


def summary_confidence(reviews: Column, named_sources: Column) -> Column:
    return (F.when((reviews >= 5) & (named_sources >= 3), "high")
            .when((reviews >= 2) & (named_sources >= 2), "medium").otherwise("low"))


def review_evidence(reviews: DataFrame, limit: int = md.EVIDENCE_LIMIT) -> DataFrame:
    """First six quotes per release in feed order; needs an `evidence_text` column."""
    order = Window.partitionBy("release_id").orderBy(*rv.feed_order())
    return (
        reviews.filter(F.coalesce("evidence_text", F.lit("")) != "")
        .select("release_id", "published_at", "created_at", "review_id", "source_name", "source_type", "title", "evidence_text")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    )


def evidence_text(excerpt: Column, body: Column, title: Column) -> Column:
    return t.truncate_text(F.coalesce(excerpt, body, title), EVIDENCE_LENGTH)


def _fallback(values: Column, default: Column) -> Column:
    return F.slice(F.when(F.size(values) > 0, values).otherwise(default), 1, 3)


def release_summaries(reviews: DataFrame, releases: DataFrame) -> DataFrame:
    """One generated summary per release that has at least one approved review with text.

    Needs reviews with source columns, `terms` and `evidence_text`; releases with label, category,
    terrain and stability. Terms with equally many mentions keep the order of their first mention in the feed. Sentiment sums are exact integers (a null sentiment adds .7 to mixed).
    """
    w, s = t.source_weight_e4(F.col("source_type")), F.col("sentiment")
    editorial = F.col("source_type") == "editorial"

    def mass(condition: Column, factor: int = 10) -> Column:
        return F.coalesce(F.sum(F.when(condition, w * factor)), F.lit(0))

    sums = {f"w_{n}": mass(s == n) for n in rv.CLASSES}
    sums |= {f"{p}_{n}": mass((s == n) & c) for p, c in (("ed", editorial), ("co", ~editorial)) for n in rv.CLASSES}
    sums |= {"w_unknown": mass(s.isNull(), 7), "ed_unknown": mass(s.isNull() & editorial), "co_unknown": mass(s.isNull() & ~editorial),
             "n_ed": F.count_if(editorial), "review_count": F.count("*")}
    # Per source first, then per source name, then per release: both source counts come out of one pass,
    # and a hot release is spread over its sources.
    again = [F.sum(name).alias(name) for name in sums]
    totals = (
        reviews.groupBy("release_id", "source_name", "source_key").agg(*[c.alias(name) for name, c in sums.items()])
        .groupBy("release_id", "source_name").agg(*again, F.count("*").alias("source_count"))
        .groupBy("release_id").agg(*again, F.sum("source_count").alias("source_count"), F.count("*").alias("named_sources"))
    )
    terms = term_rollup(reviews).groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("mentions")).alias("order"), "first_position", "term", "positive", "negative"))).alias("ranked"))
    evidence = review_evidence(reviews).groupBy("release_id").agg(F.count("*").alias("evidence_count"))
    c = F.col
    overall = scoring.dominant_never_null(c("w_positive"), c("w_mixed") + c("w_unknown"), c("w_negative"))
    base = (
        totals.join(terms, "release_id", "left").join(evidence, "release_id", "left").join(releases, "release_id")
        .withColumn("overall_sentiment", overall)
        .withColumns({
            "ranked": F.coalesce("ranked", F.array().cast(terms.schema["ranked"].dataType)),
            "confidence": summary_confidence(c("review_count"), c("named_sources")),
            "evidence_count": F.coalesce("evidence_count", F.lit(0)),
        })
    )

    def channel(prefix: str, empty: Column) -> Column:
        def all_of(n: str) -> Column:
            return c(f"{prefix}_{n}") + F.when(c("overall_sentiment") == n, c(f"{prefix}_unknown")).otherwise(0)

        return F.when(~empty, scoring.dominant_never_null(*[all_of(n) for n in rv.CLASSES]))

    def texts(rows: Column, render) -> Column:
        return F.transform(F.slice(rows, 1, 3), lambda x: render(x["term"]))

    told = base.withColumns({
        "editorial_sentiment": channel("ed", c("n_ed") == 0),
        "community_sentiment": channel("co", c("n_ed") == c("review_count")),
        "raw_pros": texts(F.filter("ranked", lambda x: x["positive"] >= x["negative"]), positive_text),
        "raw_cons": texts(F.filter("ranked", lambda x: x["negative"] > x["positive"]), negative_text),
        "term_names": F.transform("ranked", lambda x: x["term"]),
    })
    mood, empty = c("overall_sentiment"), F.array().cast("array<string>")

    def listed(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(cond, F.lit(WORDING[key])) for cond, key in pairs]))

    def has(term: str) -> Column:
        return F.array_contains("term_names", term)

    best = listed((has("Speed"), "best_speed"), (has("Cushioning"), "best_cushioning"),
                  (F.lower("terrain") == "trail", "best_trail"), (F.lower("stability") == "stability", "best_stability"))
    watch = listed((has("Fit"), "watch_fit"), (has("Value"), "watch_value"), (mood.isin("mixed", "negative"), "watch_mixed"))
    watch_default = F.concat(F.lit("Compare this "), F.lower("category"), F.lit(" model against shoes with a similar ride profile and intended use."))
    consensus = F.filter("term_names", lambda x: ~x.isin(*lx.NEGATIVE_BIASED_TERMS))
    debates = F.filter("term_names", lambda x: x.isin(*lx.MIXED_SIGNAL_TERMS) | ((mood == "mixed") & x.isin(*lx.NEGATIVE_BIASED_TERMS)))
    phrase = F.when(mood == "positive", "mostly positive").when(mood == "negative", "mostly negative").otherwise("mixed")
    tone = F.when(mood == "positive", "Broadly positive").when(mood == "negative", "Cautious").otherwise("Mixed")
    first_con = F.regexp_replace(F.get("raw_cons", F.lit(0)), r"\.$", "")
    return told.select(
        "release_id", "overall_sentiment", "confidence", "editorial_sentiment", "community_sentiment",
        scoring.source_alignment(c("editorial_sentiment"), c("community_sentiment")).alias("source_alignment"),
        F.concat_ws(" ", F.concat(c("label"), F.lit(" is landing with "), phrase, F.lit(" sentiment across the current approved review set.")),
                    F.get("raw_pros", F.lit(0)), F.concat(F.lit("Main caution: "), first_con, F.lit("."))).alias("overview"),
        F.concat(tone, F.lit(" buyer signal for "), F.lower("category"), F.lit(" use with "), c("confidence"), F.lit(" confidence.")).alias("buyer_signal"),
        _fallback(c("raw_pros"), F.when(mood == "negative", empty).otherwise(F.array(F.lit(WORDING["pros_fallback"])))).alias("pros"),
        _fallback(c("raw_cons"), F.array(F.when(mood == "positive", WORDING["cons_fallback_positive"]).otherwise(WORDING["cons_fallback"]))).alias("cons"),
        _fallback(best, F.array(F.lit(WORDING["best_fallback"]))).alias("best_for"),
        _fallback(watch, F.array(watch_default)).alias("watch_outs"),
        _fallback(F.transform(F.slice(consensus, 1, 3), lambda x: F.when(mood == "negative", negative_text(x)).otherwise(positive_text(x))),
                  F.array(F.lit(WORDING["consensus_fallback"]))).alias("consensus_points"),
        _fallback(F.transform(F.slice(debates, 1, 3), lambda x: F.concat(F.lit("Some reviews diverge on "), F.lower(x), F.lit("."))),
                  F.when(mood == "mixed", F.array(F.lit(WORDING["debates_fallback"]))).otherwise(empty)).alias("debates"),
        "review_count", "source_count", "evidence_count", F.lit("heuristic").alias("provider"),
    )


# --- candidates ---------------------------------------------------------------------

TEXT_LIMITS = {"pros": 120, "cons": 120, "bestFor": 120, "watchOuts": 120, "consensusPoints": 140, "debates": 140}


def json_object_text(c: Column) -> Column:
    """Outermost braces of a text that may carry words around its JSON."""
    whole = t.trim_ws(c)
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(whole)


def validate_candidates(df: DataFrame, column: str = "candidate") -> DataFrame:
    """Typed fields plus `error`, the first broken rule; rows with an error belong to quarantine."""
    v = "_v"
    parsed = df.withColumn("_v", F.try_parse_json(json_object_text(F.col(column))))

    def text_field(key: str, limit: int) -> Column:
        return F.expr(f"substring({md.trimmed_sql(md.string_sql(v, '$.' + key))}, 1, {limit})")

    def nullable_enum_ok(key: str) -> Column:
        return F.expr(f"{md.kind_sql(v, '$.' + key)} = 'VOID' OR {md.enum_sql(v, '$.' + key, lx.SENTIMENTS)} IS NOT NULL")

    def items_sql(key: str) -> str:
        return f"slice(try_variant_get({v}, '$.{key}', 'array<variant>'), 1, 4)"

    def list_ok(key: str) -> Column:
        return F.expr(f"forall({items_sql(key)}, e -> schema_of_variant(e) = 'STRING')")

    def list_field(key: str, limit: int) -> Column:
        text = "try_variant_get(e, '$', 'string')"
        cut = f"substring({md.trimmed_sql(text)}, 1, {limit})"
        return F.expr(f"filter(transform({items_sql(key)}, e -> {cut}), x -> x <> '')")

    rules = [
        (F.col(v).isNotNull(), "not json"),
        (text_field("overview", 500) != "", "overview"),
        (md.read_enum(v, "$.overallSentiment", lx.SENTIMENTS).isNotNull(), "overallSentiment"),
        (md.read_enum(v, "$.confidence", lx.CONFIDENCES).isNotNull(), "confidence"),
        (nullable_enum_ok("editorialSentiment"), "editorialSentiment"),
        (nullable_enum_ok("communitySentiment"), "communitySentiment"),
        (md.read_enum(v, "$.sourceAlignment", lx.ALIGNMENTS).isNotNull(), "sourceAlignment"),
        (F.expr(f"{md.kind_sql(v, '$.buyerSignal')} = 'VOID'") | (text_field("buyerSignal", 220) != ""), "buyerSignal"),
        *[(list_ok(key), key) for key in TEXT_LIMITS],
    ]
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules])
    return parsed.select(
        *df.columns, error.alias("error"), text_field("overview", 500).alias("overview"),
        md.read_enum(v, "$.overallSentiment", lx.SENTIMENTS).alias("overall_sentiment"),
        md.read_enum(v, "$.confidence", lx.CONFIDENCES).alias("confidence"),
        text_field("buyerSignal", 220).alias("buyer_signal"),
        *[list_field(key, limit).alias(t_name) for (key, limit), t_name in zip(
            TEXT_LIMITS.items(), ("pros", "cons", "best_for", "watch_outs", "consensus_points", "debates"), strict=True)],
    )
