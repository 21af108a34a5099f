"""Review joins, aggregates, themes, coverage and the full per-release read."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import text as t
from shelfsight.operators import filters as flt, metadata as md, planning as pln, reviews as rv, scoring
from shelfsight.plans import duck as d
from shelfsight.plans.catalog_queries import summaries
from shelfsight.plans.registry import query
from shelfsight.plans.text_queries import PROSE_PATTERNS
from shelfsight.session import cut_lineage
from shelfsight.sources.fixtures import as_of

d.VIEWS["v_feature"] = f"""SELECT r.*, s.source_name, s.source_type, s.source_type || ':' || s.source_name AS source_key,
    {d.weight('s.source_type', 'r.published_at')} AS weight_e4 FROM v_review r JOIN v_source s ON r.source_id = s.source_id WHERE r.status = 'approved'"""


def features(fx):
    return rv.review_features(fx.review(), fx.source(), as_of())


def themed_features(fx, quotes: bool = True):
    """Themes of a text are inferred once per document, before the text meets its reviews; quotes only where they are read."""
    quote = [rv.quote_of(F.col("excerpt"), F.col("body")).alias("quote")] if quotes else []
    docs = cut_lineage(fx.document(spread=True).select("doc_id", t.matching_labels(F.concat_ws(" ", "excerpt", "body"), PROSE_PATTERNS).alias("inferred"), *quote))
    reviews = fx.attach_text(fx.review().filter("status = 'approved'"), docs)
    with_themes = reviews.withColumn("themes", F.array_distinct(F.concat("highlights", "inferred")))
    return rv.review_features(with_themes, fx.source(), as_of())


def notes(fx):
    return md.read_release_notes(fx.metadata()).select("release_id", "notes.*")


@query("jn_2_review_star", """SELECT v.review_id, r.brand, f.category, s.source_name, a.c_name AS author, v.score FROM v_review v
    JOIN v_release r ON v.release_id = r.release_id JOIN v_family f ON r.family_id = f.family_id JOIN v_source s ON s.source_id = v.source_id
    JOIN orders o ON o.o_orderkey = v.l_orderkey LEFT JOIN customer a ON a.c_custkey = o.o_custkey WHERE v.status = 'approved'""")
def _(fx):
    author = fx.table("customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author"))
    return rv.review_star(fx.review(with_author=True), fx.release(), fx.family(), fx.source(), author).select(
        "review_id", "brand", "category", "source_name", "author", "score")


@query("jn_3_coverage_join", """SELECT r.release_id, count(v.review_id) AS reviews, count(s.source_id) AS sourced, count(DISTINCT s.source_type) AS channels
    FROM v_release r LEFT JOIN v_review v ON v.release_id = r.release_id LEFT JOIN v_source s ON s.source_id = v.source_id WHERE r.is_current GROUP BY r.release_id""")
def _(fx):
    counted = fx.review().join(fx.source(), "source_id", "left").groupBy("release_id").agg(
        F.count("*").alias("reviews"), F.count("source_type").alias("sourced"), F.count_distinct("source_type").alias("channels"))
    zero = F.lit(0)
    return fx.release().filter("is_current").select("release_id").join(counted, "release_id", "left").select(
        "release_id", *[F.coalesce(c, zero).alias(c) for c in ("reviews", "sourced", "channels")])


@query("sco_1_review_weight", """SELECT source_type, weight_e4 / 10000.0::DOUBLE AS weight, count(*) AS n FROM v_feature GROUP BY ALL""")
def _(fx):
    return features(fx).groupBy("source_type", (F.col("weight_e4") / 10000).alias("weight")).agg(F.count("*").alias("n"))


@query("sco_2_sentiment_score", """SELECT sentiment, confidence, count(*) AS n, CASE sentiment WHEN 'positive' THEN 86 WHEN 'negative' THEN 48 WHEN 'mixed' THEN 69 END
    + CASE confidence WHEN 'high' THEN 3 WHEN 'low' THEN -3 ELSE 0 END AS points FROM (SELECT sentiment, CASE release_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence FROM v_review) GROUP BY sentiment, confidence""")
def _(fx):
    k = F.col("release_id") % 3
    rows = fx.review().select("sentiment", F.when(k == 0, "high").when(k == 1, "low").otherwise("medium").alias("confidence"))
    return rows.groupBy("sentiment", "confidence").agg(F.count("*").alias("n")).withColumn(
        "points", scoring.summary_sentiment_score(F.col("sentiment"), F.col("confidence")))


_SENT = ", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}_count, CAST(coalesce(sum(weight_e4) FILTER (sentiment = '{s}'), 0) AS BIGINT) AS {s}_e4" for s in ("positive", "mixed", "negative"))


@query("agg_6_sentiment_breakdown", f"""SELECT release_id, positive_count, mixed_count, negative_count, {d.e4('positive_e4')} AS positive_weight,
    {d.e4('mixed_e4')} AS mixed_weight, {d.e4('negative_e4')} AS negative_weight FROM (SELECT release_id, {_SENT} FROM v_feature GROUP BY release_id)""")
def _(fx):
    sums = features(fx).groupBy("release_id").agg(*rv.sentiment_weights())
    return sums.select("release_id", "positive_count", "mixed_count", "negative_count",
                       *[rv.e2(F.col(f"{s}_e4")).alias(f"{s}_weight") for s in ("positive", "mixed", "negative")])


@query("agg_7_weighted_average", """SELECT release_id, round(sum(score * weight_e4) FILTER (score IS NOT NULL) / nullif(sum(weight_e4) FILTER (score IS NOT NULL), 0), 6) AS weighted_score
    FROM v_feature GROUP BY release_id""")
def _(fx):
    return features(fx).groupBy("release_id").agg(F.round(rv.weighted_average(F.col("score"), F.col("weight_e4")), 6).alias("weighted_score"))


@query("agg_9_distinct_sources", "SELECT release_id, count(DISTINCT source_key) AS keyed, count(DISTINCT source_name) AS named FROM v_feature GROUP BY release_id")
def _(fx):
    per_source = features(fx).groupBy("release_id", "source_key", "source_name").agg(F.count("*").alias("n"))
    return per_source.groupBy("release_id").agg(F.count_distinct("source_key").alias("keyed"), F.count_distinct("source_name").alias("named"))


@query("agg_5_highlight_rollup", f"""SELECT release_id, label, count(*) AS mentions, {d.e4('sum(weight_e4)')} AS weight
    FROM (SELECT release_id, weight_e4, unnest(highlights) AS label FROM v_feature) GROUP BY release_id, label""")
def _(fx):
    return rv.highlight_rollup(features(fx)).select("release_id", "label", "mentions", rv.e2(F.col("label_e4")).alias("weight"))


_TOPHL = """SELECT release_id, label, count(*) AS mentions, sum(weight_e4) AS label_e4, row_number() OVER (PARTITION BY release_id ORDER BY sum(weight_e4) DESC, count(*) DESC, label) AS rank
    FROM (SELECT release_id, weight_e4, unnest(highlights) AS label FROM v_feature) GROUP BY release_id, label QUALIFY rank <= 4"""


@query("srt_7_top_highlights", f"SELECT release_id, label, mentions, CAST(rank AS INTEGER) AS rank FROM ({_TOPHL})")
def _(fx):
    return rv.top_highlights(rv.highlight_rollup(features(fx))).select("release_id", "label", "mentions", "rank")


@query("sco_16_signal_summary", f"""SELECT b.release_id, positive_count, mixed_count, negative_count, source_count, top_labels,
    CASE WHEN greatest(positive_e4, mixed_e4, negative_e4) <= 0 THEN NULL WHEN positive_e4 >= mixed_e4 AND positive_e4 >= negative_e4 THEN 'positive'
      WHEN mixed_e4 >= negative_e4 THEN 'mixed' ELSE 'negative' END AS dominant
    FROM (SELECT release_id, {_SENT}, count(DISTINCT source_name) AS source_count FROM v_feature GROUP BY release_id) b
    LEFT JOIN (SELECT release_id, string_agg(label, '|' ORDER BY rank) AS top_labels FROM ({_TOPHL}) GROUP BY release_id) h ON h.release_id = b.release_id""")
def _(fx):
    return rv.signal_summary(features(fx)).select(
        "release_id", "positive_count", "mixed_count", "negative_count", "source_count", "dominant",
        F.array_join(F.transform("top_highlights", lambda h: h["label"]), "|").alias("top_labels"))


@query("sco_3_dominant_class", f"""SELECT release_id, CASE WHEN greatest(p, m, n) <= 0 THEN NULL WHEN p >= m AND p >= n THEN 'positive' WHEN m >= n THEN 'mixed' ELSE 'negative' END AS rule_a,
    CASE WHEN p >= m AND p >= n THEN 'positive' WHEN n >= m AND n >= p THEN 'negative' ELSE 'mixed' END AS rule_b
    FROM (SELECT release_id, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'mixed') AS m, count(*) FILTER (sentiment = 'negative') AS n FROM v_feature GROUP BY release_id)""")
def _(fx):
    c = F.col
    counts = features(fx).groupBy("release_id").agg(*rv.sentiment_weights())
    args = (c("positive_count"), c("mixed_count"), c("negative_count"))
    return counts.select("release_id", scoring.dominant_positive_first(*args).alias("rule_a"), scoring.dominant_never_null(*args).alias("rule_b"))


@query("sco_6_agreement", """SELECT release_id, CASE WHEN p + m + n = 0 THEN 'mixed' WHEN p > 0 AND n > 0 AND abs(p - n) <= 1 THEN 'split' WHEN m >= (p + m + n) / 2 THEN 'mixed' ELSE 'strong' END AS agreement
    FROM (SELECT release_id, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'mixed') AS m, count(*) FILTER (sentiment = 'negative') AS n FROM v_feature GROUP BY release_id)""")
def _(fx):
    c = F.col
    counts = features(fx).groupBy("release_id").agg(*rv.sentiment_weights())
    return counts.select("release_id", scoring.agreement(c("positive_count"), c("mixed_count"), c("negative_count")).alias("agreement"))


@query("agg_13_freshest_review", f"""SELECT release_id, {d.iso_date('max(published_at)')} AS freshest,
    CAST(floor((epoch_us({d.AS_OF}) - epoch_us(max(published_at))) / 86400000000.0) AS BIGINT) AS days FROM v_feature GROUP BY release_id""")
def _(fx):
    return rv.review_coverage(features(fx), as_of()).select("release_id", "freshest", F.col("days_since_freshest").alias("days"))


@query("sco_14_coverage_grade", f"""SELECT release_id, review_count, source_count, CASE WHEN days > 365 THEN 'stale' WHEN review_count < 2 OR source_count < 2 THEN 'developing' ELSE 'strong' END AS grade
    FROM (SELECT release_id, count(*) AS review_count, count(DISTINCT source_key) AS source_count,
      floor((epoch_us({d.AS_OF}) - epoch_us(max(published_at))) / 86400000000.0) AS days FROM v_feature GROUP BY release_id)""")
def _(fx):
    return rv.review_coverage(features(fx), as_of()).select("release_id", "review_count", "source_count", "grade")


@query("sco_14_comparison_coverage", """SELECT r.release_id, CASE WHEN coalesce(s.review_count, 0) = 0 THEN 'thin' WHEN coalesce(m.source_count, 0) < 2 OR s.review_count < 2 THEN 'developing' ELSE 'strong' END AS grade
    FROM v_release r LEFT JOIN v_stats s ON s.release_id = r.release_id LEFT JOIN v_summary m ON m.release_id = r.release_id""")
def _(fx):
    from shelfsight.plans.catalog_queries import cards
    return cards(fx).select("release_id", scoring.comparison_coverage(F.col("review_count"), F.col("source_count")).alias("grade"))


# --- themes ---------------------------------------------------------------------------

_INFERRED = d.labels("h", PROSE_PATTERNS)
d.VIEWS["v_docthemes"] = f"""SELECT doc_id, {_INFERRED} AS inferred, quote FROM (SELECT doc_id, {d.norm("concat_ws(' ', excerpt, body)")} AS h,
    substring({d.trim_ws('coalesce(excerpt, body)')}, 1, 180) AS quote FROM v_document)"""
d.VIEWS["v_theme"] = """SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY published_at DESC NULLS FIRST, created_at DESC, review_id, pos) AS feed_position FROM (
    SELECT f.*, d.quote, unnest(list_concat(f.highlights, d.inferred)) AS theme, generate_subscripts(list_concat(f.highlights, d.inferred), 1) AS pos
    FROM v_feature f JOIN v_docthemes d ON d.doc_id = f.doc_slot % (SELECT count(*) FROM documents))"""
d.VIEWS["v_theme_score"] = """SELECT *, CASE WHEN dominant = 'positive' THEN positive WHEN dominant = 'negative' THEN negative ELSE mixed END / review_count AS ratio FROM (SELECT *,
      CASE WHEN positive >= mixed AND positive >= negative THEN 'positive' WHEN negative >= mixed AND negative >= positive THEN 'negative' ELSE 'mixed' END AS dominant,
      positive > 0 AND negative > 0 AS contested FROM (
    SELECT release_id, theme, count(*) FILTER (coalesce(sentiment, 'mixed') = 'positive') AS positive, count(*) FILTER (coalesce(sentiment, 'mixed') = 'mixed') AS mixed,
      count(*) FILTER (coalesce(sentiment, 'mixed') = 'negative') AS negative, count(DISTINCT source_key) AS source_count, count(DISTINCT review_id) AS review_count, min(feed_position) AS first_position
    FROM v_theme GROUP BY release_id, theme))"""
_CONF = "CASE WHEN source_count >= 2 AND review_count >= 2 AND ratio >= 0.7 THEN 'high' WHEN source_count >= 1 AND review_count >= 1 AND ratio >= 0.5 THEN 'medium' ELSE 'low' END"
_TOP = """SELECT t.*, row_number() OVER (PARTITION BY t.release_id ORDER BY t.source_count DESC, t.review_count DESC, first_position, theme) AS rank FROM v_theme_score t"""
d.VIEWS["v_top_theme"] = f"SELECT * FROM ({_TOP} LEFT JOIN v_summary m ON m.release_id = t.release_id WHERE NOT coalesce(list_contains(m.ignored_themes, theme), false)) WHERE rank <= 5"
d.VIEWS["v_plain_top_theme"] = f"SELECT * FROM ({_TOP}) WHERE rank <= 5"


@query("agg_4_theme_rollup", "SELECT release_id, theme, positive, mixed, negative, source_count, review_count FROM v_theme_score")
def _(fx):
    return rv.theme_rollup(rv.theme_rows(themed_features(fx, quotes=False))).select(
        "release_id", "theme", "positive", "mixed", "negative", "source_count", "review_count")


@query("agg_4_theme_evidence", """SELECT release_id, theme, source_name, quote, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY release_id, theme ORDER BY published_at DESC NULLS FIRST, created_at DESC, review_id) AS rank FROM v_theme WHERE quote <> '') WHERE rank <= 3""")
def _(fx):
    return rv.theme_evidence(themed_features(fx)).select("release_id", "theme", "source_name", "quote", "rank")


@query("sco_4_theme_confidence", f"SELECT release_id, theme, dominant, {_CONF} AS confidence FROM v_theme_score")
def _(fx):
    return rv.score_themes(rv.theme_rollup(rv.theme_rows(themed_features(fx, quotes=False)))).select("release_id", "theme", "dominant", "confidence")


@query("srt_6_top_themes", "SELECT release_id, theme, CAST(rank AS INTEGER) AS rank FROM v_top_theme")
def _(fx):
    scored = rv.score_themes(rv.theme_rollup(rv.theme_rows(themed_features(fx, quotes=False))))
    return rv.top_themes(scored, notes(fx)).select("release_id", "theme", "rank")


_TAKE = """CASE WHEN contested THEN theme || ' is contested across ' || source_count || ' sources.' ELSE theme || ' ' ||
    CASE dominant WHEN 'positive' THEN 'leans positive' WHEN 'negative' THEN 'leans negative' ELSE 'is mixed' END || ' across current reviews.' END"""


@query("sco_5_theme_takeaways", f"""SELECT k.release_id, contradictions, CASE WHEN len(m.pinned_takeaways) > 0 THEN array_to_string(m.pinned_takeaways, '|') ELSE derived END AS takeaways
    FROM (SELECT release_id, count(*) FILTER (contested) AS contradictions, string_agg({_TAKE}, '|' ORDER BY rank) FILTER (rank <= 3) AS derived FROM v_top_theme GROUP BY release_id) k
    LEFT JOIN v_summary m ON m.release_id = k.release_id""")
def _(fx):
    return rv.theme_reconciliation(themed_features(fx, quotes=False), notes(fx)).select(
        "release_id", F.col("contradiction_count").alias("contradictions"), F.array_join("takeaways", "|").alias("takeaways"))


@query("sco_17_theme_reconciliation", f"""SELECT k.release_id, themes, contradictions, m.summary_note FROM (SELECT release_id, count(*) FILTER (contested) AS contradictions,
    string_agg(theme || ':' || dominant || ':' || {_CONF} || ':' || source_count || ':' || review_count, '|' ORDER BY rank) AS themes FROM v_top_theme GROUP BY release_id) k
    LEFT JOIN v_summary m ON m.release_id = k.release_id""")
def _(fx):
    def shown(x):
        return F.concat_ws(":", x["theme"], x["dominant"], x["confidence"], x["source_count"].cast("string"), x["review_count"].cast("string"))

    return rv.theme_reconciliation(themed_features(fx, quotes=False), notes(fx)).select(
        "release_id", F.array_join(F.transform("themes", shown), "|").alias("themes"), F.col("contradiction_count").alias("contradictions"), "summary_note")


_FALLBACK = """SELECT release_id, coalesce(array_to_string(list(theme || ' trends positive.' ORDER BY rank) FILTER (dominant = 'positive' AND NOT contested)[1:2], '|'), '') AS positives,
    coalesce(array_to_string(list(CASE WHEN contested THEN theme || ' feedback is mixed.' ELSE theme || ' is the main concern.' END ORDER BY rank) FILTER (dominant = 'negative' OR contested)[1:2], '|'), '') AS concerns,
    coalesce(array_to_string(list(theme || CASE WHEN dominant = 'positive' THEN ' leans positive.' ELSE ' is mixed.' END ORDER BY rank) FILTER (NOT contested)[1:3], '|'), '') AS consensus_points,
    coalesce(array_to_string(list(theme || ' is contested across sources.' ORDER BY rank) FILTER (contested)[1:3], '|'), '') AS debates FROM v_plain_top_theme GROUP BY release_id"""
LISTS = ("positives", "concerns", "consensus_points", "debates")


def plain_themes(fx):
    return rv.themes_by_release(rv.top_themes(rv.score_themes(rv.theme_rollup(rv.theme_rows(themed_features(fx, quotes=False))))))


@query("sco_13_fallback_insights", _FALLBACK)
def _(fx):
    lists = rv.fallback_insights(F.col("themes"))
    return plain_themes(fx).select("release_id", *[F.array_join(lists[name], "|").alias(name) for name in LISTS])


# --- the full read -----------------------------------------------------------------------

_S2N = "CASE coalesce(f.sentiment, m.overall_sentiment, 'mixed') WHEN 'positive' THEN 86 WHEN 'negative' THEN 48 ELSE 69 END"
_EFF = "coalesce(f.sentiment, m.overall_sentiment, 'mixed')"


def _argmax(channel: str) -> str:
    p, x, n = (f"coalesce(sum(weight_e4) FILTER ({channel} AND {_EFF} = '{s}'), 0)" for s in ("positive", "mixed", "negative"))
    return (f"CASE WHEN count(*) FILTER ({channel}) = 0 THEN any_value(m.overall_sentiment) WHEN greatest({p}, {x}, {n}) <= 0 THEN NULL "
            f"WHEN {p} >= {x} AND {p} >= {n} THEN 'positive' WHEN {x} >= {n} THEN 'mixed' ELSE 'negative' END")


_ED, _CO = "f.source_type = 'editorial'", "f.source_type <> 'editorial'"
d.VIEWS["v_intel"] = f"""SELECT *, CASE WHEN score IS NULL THEN NULL ELSE score END AS review_score FROM (SELECT *,
    CASE WHEN rating IS NOT NULL AND sentiment_avg IS NOT NULL THEN {d.half_up('(rating * 0.55::DOUBLE + sentiment_avg * 0.45::DOUBLE) / (0.55::DOUBLE + 0.45::DOUBLE)')}
      WHEN rating IS NOT NULL THEN {d.half_up('rating * 0.55::DOUBLE / 0.55::DOUBLE')} ELSE {d.half_up('sentiment_avg * 0.45::DOUBLE / 0.45::DOUBLE')} END AS score,
    coalesce(stored_editorial, derived_editorial) AS editorial_sentiment, coalesce(stored_community, derived_community) AS community_sentiment,
    CASE WHEN p + x + n = 0 THEN 'mixed' WHEN p > 0 AND n > 0 AND abs(p - n) <= 1 THEN 'split' WHEN x >= (p + x + n) / 2 THEN 'mixed' ELSE 'strong' END AS agreement FROM (
    SELECT f.release_id, count(*) AS review_count, count(DISTINCT source_key) AS source_count,
      coalesce(any_value(m.evidence_count), least(count(*), 6)) AS evidence_count,
      coalesce(CAST(sum(score * weight_e4) AS DOUBLE) / nullif(sum(weight_e4) FILTER (score IS NOT NULL), 0), avg(score)) AS rating,
      CAST(sum(score * weight_e4) FILTER ({_ED}) AS DOUBLE) / nullif(sum(weight_e4) FILTER ({_ED} AND score IS NOT NULL), 0) AS editorial_avg,
      CAST(sum(coalesce(score, {_S2N}) * weight_e4) FILTER ({_CO}) AS DOUBLE) / sum(weight_e4) FILTER ({_CO}) AS community_avg,
      CAST(sum({_S2N} * weight_e4) AS DOUBLE) / sum(weight_e4) AS sentiment_avg,
      {_argmax(_ED)} AS derived_editorial, {_argmax(_CO)} AS derived_community,
      any_value(m.editorial_sentiment) AS stored_editorial, any_value(m.community_sentiment) AS stored_community, any_value(m.source_alignment) AS stored_alignment,
      any_value(m.confidence) AS summary_confidence, any_value(m.buyer_signal) AS stored_buyer, any_value(m.pros) AS s_pros, any_value(m.cons) AS s_cons,
      any_value(m.consensus_points) AS s_consensus, any_value(m.debates) AS s_debates,
      count(*) FILTER (f.sentiment = 'positive') AS p, count(*) FILTER (f.sentiment = 'mixed') AS x, count(*) FILTER (f.sentiment = 'negative') AS n
    FROM v_feature f LEFT JOIN v_summary m ON m.release_id = f.release_id GROUP BY f.release_id))"""
_POINTS = """CASE WHEN review_count >= 5 THEN 2 WHEN review_count >= 3 THEN 1 ELSE 0 END + CASE WHEN source_count >= 3 THEN 2 WHEN source_count >= 2 THEN 1 ELSE 0 END
    + CASE summary_confidence WHEN 'high' THEN 1 WHEN 'low' THEN -1 ELSE 0 END - CASE WHEN agreement = 'split' THEN 1 ELSE 0 END"""
_CONFIDENCE = f"CASE WHEN {_POINTS} >= 4 THEN 'high' WHEN {_POINTS} >= 2 THEN 'medium' ELSE 'low' END"
_ALIGN = """coalesce(stored_alignment, CASE WHEN editorial_sentiment IS NULL OR community_sentiment IS NULL THEN 'mixed' WHEN editorial_sentiment = community_sentiment THEN 'aligned'
    WHEN (editorial_sentiment, community_sentiment) IN (('positive', 'negative'), ('negative', 'positive')) THEN 'divergent' ELSE 'mixed' END)"""


def _channel(name: str, avg: str, sentiment: str) -> str:
    return (f"CASE WHEN {avg} IS NULL AND {sentiment} IS NULL THEN NULL ELSE '{name} sentiment reads ' || CASE WHEN {sentiment} = 'positive' THEN 'positive' "
            f"WHEN {sentiment} = 'negative' THEN 'cautious' WHEN {sentiment} = 'mixed' THEN 'mixed' WHEN {avg} >= 88 THEN 'very positive' WHEN {avg} >= 80 THEN 'positive' "
            f"WHEN {avg} >= 72 THEN 'mixed-positive' WHEN {avg} >= 64 THEN 'mixed' ELSE 'cautious' END || '.' END")


_TEXT = """CASE WHEN review_score >= 88 THEN 'Very strong' WHEN review_score >= 80 THEN 'Strong' WHEN review_score >= 70 THEN 'Mixed-positive' ELSE 'Mixed' END
      || ' review signal across ' || source_count || ' indexed sources and ' || review_count || ' approved reviews.'"""
_BUYER = """coalesce(stored_buyer, CASE WHEN review_score >= 88 THEN 'Broadly positive' WHEN review_score >= 80 THEN 'Positive' WHEN review_score >= 72 THEN 'Mixed-positive' ELSE 'Mixed' END
      || ' buyer signal from the current mix of editorial and community reviews.')"""
_SCORES = f"""{d.half_up('rating')} AS rating_score, {d.half_up('sentiment_avg')} AS sentiment_score, {d.half_up('editorial_avg')} AS editorial_score, {d.half_up('community_avg')} AS community_score"""


def _list(stored: str, limit: int, name: str) -> str:
    return f"coalesce(array_to_string({stored}[1:{limit}], '|'), b.{name}, '') AS {name}"


@query("sco_10_review_intelligence", f"""SELECT i.release_id, review_count, source_count, evidence_count, review_score, {_SCORES}, editorial_sentiment, community_sentiment,
    {_ALIGN} AS source_alignment, {_CONFIDENCE} AS confidence, agreement, {_channel('Editorial', 'editorial_avg', 'editorial_sentiment')} AS editorial_text,
    {_channel('Community', 'community_avg', 'community_sentiment')} AS community_text, {_TEXT} AS intelligence_text, {_BUYER} AS buyer_signal,
    {_list('s_pros', 2, 'positives')}, {_list('s_cons', 2, 'concerns')}, {_list('s_consensus', 3, 'consensus_points')}, {_list('s_debates', 3, 'debates')}
    FROM v_intel i LEFT JOIN ({_FALLBACK}) b ON b.release_id = i.release_id""")
def _(fx):
    full = rv.review_intelligence(features(fx), summaries(fx), plain_themes(fx))
    return full.withColumns({name: F.array_join(name, "|") for name in LISTS})


def intelligence(fx):
    return rv.review_intelligence(features(fx), summaries(fx))


@query("agg_8_channel_sentiment", "SELECT release_id, editorial_sentiment, community_sentiment FROM v_intel")
def _(fx):
    return intelligence(fx).select("release_id", "editorial_sentiment", "community_sentiment")


@query("sco_7_confidence_points", f"SELECT release_id, {_CONFIDENCE} AS confidence FROM v_intel")
def _(fx):
    return intelligence(fx).select("release_id", "confidence")


@query("sco_8_source_alignment", f"SELECT release_id, {_ALIGN} AS source_alignment FROM v_intel")
def _(fx):
    return intelligence(fx).select("release_id", "source_alignment")


@query("sco_9_composite_score", f"SELECT release_id, review_score, {_SCORES} FROM v_intel")
def _(fx):
    return intelligence(fx).select("release_id", "review_score", "rating_score", "sentiment_score", "editorial_score", "community_score")


@query("sco_12_tone_texts", f"""SELECT release_id, {_channel('Editorial', 'editorial_avg', 'editorial_sentiment')} AS editorial_text,
    {_channel('Community', 'community_avg', 'community_sentiment')} AS community_text, {_TEXT} AS intelligence_text, {_BUYER} AS buyer_signal FROM v_intel""")
def _(fx):
    return intelligence(fx).select("release_id", "editorial_text", "community_text", "intelligence_text", "buyer_signal")


# --- feed -----------------------------------------------------------------------------------

d.VIEWS["v_feed"] = f"""SELECT v.review_id, r.brand, {d.slug('r.family_id')} AS family_slug, {d.slug('r.version_name')} AS release_slug, v.source_id, v.score, v.published_at, v.created_at
    FROM v_review v JOIN v_release r ON v.release_id = r.release_id WHERE v.status = 'approved'"""


def feed(fx):
    slugged = fx.release().select("release_id", "brand", t.slugify(F.col("family_id")).alias("family_slug"), t.slugify(F.col("version_name")).alias("release_slug"))
    return fx.review().filter("status = 'approved'").join(slugged, "release_id")


@query("flt_7_feed_filters", """SELECT review_id, 'own' AS kind FROM v_feed WHERE family_slug = 'brand-2-small-ring' AND release_slug = 'small-ring-v0'
    UNION ALL SELECT review_id, 'foreign' FROM v_feed WHERE family_slug = 'brand-2-small-ring' AND source_id = 7""")
def _(fx):
    rows = feed(fx)
    own = flt.filter_feed(rows, brand="Brand#2", family="brand-2-small-ring", release="small-ring-v0")
    foreign = flt.filter_feed(rows, family="brand-2-small-ring", release="red-widget-v1", source=7)
    return own.select("review_id", F.lit("own").alias("kind")).unionByName(foreign.select("review_id", F.lit("foreign").alias("kind")))


@query("srt_5_feed_order", "SELECT review_id, row_number() OVER (ORDER BY published_at DESC NULLS FIRST, created_at DESC, review_id) AS position FROM v_feed")
def _(fx):
    from shelfsight.operators.ordering import positioned
    return positioned(feed(fx).orderBy(*rv.feed_order()).select("review_id"))


@query("prj_9_display_chains", f"""SELECT v.review_id, coalesce(nullif({d.trim_ws('dc.excerpt')}, ''), nullif({d.trim_ws('dc.title')}, '')) IS NULL AS empty, md5(coalesce(nullif({d.trim_ws('dc.body')}, ''), {d.trim_ws('dc.excerpt')})) AS body,
    coalesce({d.trim_ws('m.overview')}, {d.trim_ws('m.buyer_signal')}, 'none') AS stack, CASE WHEN lower({d.trim_ws('a.display_name')}) <> lower(s.source_name) THEN a.display_name END AS author
    FROM v_review v JOIN v_document dc ON dc.doc_id = v.doc_slot % (SELECT count(*) FROM documents) JOIN v_source s ON s.source_id = v.source_id
    LEFT JOIN v_author a ON a.author_id = v.source_id LEFT JOIN v_summary m ON m.release_id = v.release_id WHERE v.status = 'approved'""")
def _(fx):
    from shelfsight.operators.feeds import author_shown, first_text
    docs = fx.document().select("doc_id", first_text(F.col("excerpt"), F.col("title")).isNull().alias("empty"), F.md5(first_text(F.col("body"), F.col("excerpt"))).alias("body"))
    rows = fx.attach_text(fx.review().filter("status = 'approved'"), docs).join(fx.source(), "source_id")
    rows = rows.join(fx.author().withColumnRenamed("author_id", "source_id"), "source_id", "left").join(summaries(fx).select("release_id", "summary"), "release_id", "left")
    return rows.select("review_id", "empty", "body",
                       first_text(F.col("summary.overview"), F.col("summary.buyer_signal"), F.lit("none")).alias("stack"),
                       author_shown(F.col("display_name"), F.col("source_name")).alias("author"))


@query("sco_15_coverage_status", """SELECT r.release_id, CASE WHEN a = 0 THEN 'thin' WHEN e = 0 THEN 'missing-editorial' WHEN c = 0 THEN 'missing-community' WHEN a >= 3 THEN 'healthy' ELSE 'thin' END AS status FROM
    (SELECT r.release_id, count(f.review_id) AS a, count(f.review_id) FILTER (f.source_type = 'editorial') AS e, count(f.review_id) FILTER (f.source_type = 'reddit') AS c
     FROM v_release r LEFT JOIN v_feature f ON f.release_id = r.release_id GROUP BY r.release_id) r""")
def _(fx):
    c = F.col
    rows = pln.with_empty_coverage(fx.release().select("release_id"), pln.coverage_rollup(fx.review(), fx.source()))
    return rows.select("release_id", scoring.coverage_status(c("approved_count"), c("editorial_count"), c("reddit_count")).alias("status"))


@query("set_1_ordered_distinct", """SELECT review_id, array_to_string(list_concat(highlights, list_filter(['Ride', 'Own', 'Fit'], lambda v: NOT list_contains(highlights, v))), '|') AS labels FROM v_review""")
def _(fx):
    extra = F.array(F.lit("Ride"), F.lit("Own"), F.lit("Fit"))
    return fx.review().select("review_id", F.array_join(F.array_distinct(F.concat("highlights", extra)), "|").alias("labels"))


@query("set_2_dedupe_texts", """SELECT release_id, array_to_string(list_filter(items, lambda v, i: list_position(list_transform(items, lambda k: regexp_replace(lower(k), '[^a-z0-9]+', ' ', 'g')),
      regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) = i)[1:3], '|') AS praised
    FROM (SELECT release_id, list_concat(coalesce(pros, []), ['smooth-ride', ' GRIP  wet '.trim(), 'Other']) AS items FROM v_summary)""")
def _(fx):
    extra = F.array(F.lit("smooth-ride"), F.lit(" GRIP  wet "), F.lit("Other"))
    return md.read_release_summary(fx.metadata(), ["pros"]).select("release_id", F.array_join(t.dedupe_texts([F.col("summary.pros"), extra]), "|").alias("praised"))


@query("set_5_token_intersection", """SELECT release_id, CASE WHEN usage_summary IS NOT NULL THEN CAST(len(list_intersect(list_distinct(string_split(lower(version_name), ' ')), list_distinct(string_split(lower(usage_summary || ' ring v1'), ' ')))) AS INTEGER) END AS shared FROM v_release""")
def _(fx):
    a, b = t.token_set(F.lower("version_name")), t.token_set(F.lower(F.concat("usage_summary", F.lit(" ring v1"))))
    return fx.release().select("release_id", F.when(F.col("usage_summary").isNotNull(), F.size(F.array_intersect(a, b))).alias("shared"))


@query("prj_8_release_detail", f"""SELECT c.release_id, c.release_slug, c.category, i.review_score, {_CONFIDENCE.replace('review_count', 'i.review_count').replace('source_count', 'i.source_count').replace('summary_confidence', 'i.summary_confidence').replace('agreement', 'i.agreement')} AS confidence,
    CAST(coalesce(x.weight_oz, s.weight_oz) AS DOUBLE) AS weight_oz, (SELECT count(*) FROM v_variant v WHERE v.release_id = c.release_id) AS variants, g.grade, th.themes,
    coalesce({_BUYER.replace('review_score', 'i.review_score')}, m.overview, c.usage_summary, c.ride_profile) AS gist
    FROM v_card c LEFT JOIN v_intel i ON i.release_id = c.release_id LEFT JOIN v_spec s ON s.release_id = c.release_id LEFT JOIN v_summary m ON m.release_id = c.release_id
    LEFT JOIN (SELECT * FROM v_variant WHERE variant_key = 'default') x ON x.release_id = c.release_id
    LEFT JOIN (SELECT release_id, string_agg(theme, '|' ORDER BY rank) AS themes FROM v_top_theme GROUP BY release_id) th ON th.release_id = c.release_id
    LEFT JOIN (SELECT release_id, CASE WHEN days > 365 THEN 'stale' WHEN review_count < 2 OR source_count < 2 THEN 'developing' ELSE 'strong' END AS grade FROM (SELECT release_id, count(*) AS review_count,
      count(DISTINCT source_key) AS source_count, floor((epoch_us({d.AS_OF}) - epoch_us(max(published_at))) / 86400000000.0) AS days FROM v_feature GROUP BY release_id)) g ON g.release_id = c.release_id
    WHERE i.release_id IS NOT NULL""")
def _(fx):
    from shelfsight.operators import catalog as cat, feeds as fd
    from shelfsight.plans.catalog_queries import cards
    rows = themed_features(fx, quotes=False)
    detail = cat.release_detail(
        cards(fx), fx.spec(), fx.variant(), cat.pick_variant(fx.variant()), rv.review_intelligence(features(fx), summaries(fx)),
        rv.review_coverage(features(fx), as_of()), rv.signal_summary(features(fx)), rv.theme_reconciliation(rows, notes(fx)))
    return fd.gist(detail).filter("review_count IS NOT NULL").select(
        "release_id", "release_slug", "category", "review_score", "confidence", F.col("weight_oz").cast("double").alias("weight_oz"), F.size("variants").cast("bigint").alias("variants"),
        "grade", F.array_join(F.transform("themes", lambda x: x["theme"]), "|").alias("themes"), "gist")


@query("edt_6_review_feed", """SELECT v.review_id, v.status, r.family || ' ' || r.version_name AS release_label, s.source_name FROM (SELECT * FROM v_review ORDER BY published_at DESC NULLS FIRST, created_at DESC, review_id LIMIT 50) v
    JOIN v_release r ON r.release_id = v.release_id JOIN v_source s ON s.source_id = v.source_id""")
def _(fx):
    from shelfsight.operators import feeds as fd
    return fd.review_feed(fx.review(), fx.release(), fx.source(), rv.feed_order()).select("review_id", "status", "release_label", "source_name")


@query("edt_6_release_feed", """SELECT r.release_id, CAST(s.weight_oz AS DOUBLE) AS weight_oz, CASE WHEN NOT t.is_valid THEN 'missing' WHEN t.o_enabled THEN 'override' ELSE 'generated' END AS summary_state
    FROM (SELECT * FROM v_release ORDER BY release_year DESC NULLS FIRST, family, release_id LIMIT 20) r LEFT JOIN v_spec s ON s.release_id = r.release_id LEFT JOIN v_stored t ON t.release_id = r.release_id""")
def _(fx):
    from shelfsight.operators import feeds as fd, metadata as md
    return fd.release_feed(fx.release(), fx.spec(), md.summary_status(summaries(fx))).select("release_id", F.col("weight_oz").cast("double").alias("weight_oz"), "summary_state")
