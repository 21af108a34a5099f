"""Comparison sets, heuristic summaries and summary state."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import lexicons as lx, text as t
from shelfsight.operators import catalog as cat, compare as cmp, metadata as md, moderation as mod, reviews as rv, summary as sm
from shelfsight.plans import duck as d
from shelfsight.plans.catalog_queries import _CHOSEN, cards, requested_variants, summaries
from shelfsight.plans.registry import query
from shelfsight.plans.review_queries import notes
from shelfsight.session import cut_lineage
from shelfsight.sources.fixtures import as_of

# Sets: five consecutive releases per set asked for, of which the first four are compared; every ninth set is a single.
d.VIEWS["v_member"] = """SELECT release_id // 5 AS set_id, release_id, release_id % 5 AS position FROM v_release
    WHERE (release_id // 5) % 9 <> 0 OR release_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY release_id // 5 ORDER BY release_id % 5) <= 4"""
d.VIEWS["v_cmp"] = f"""SELECT m.set_id, c.* EXCLUDE (weight_oz), coalesce(CAST(x.weight_oz AS DOUBLE), c.weight_oz) AS weight_oz, c.brand || ' ' || c.release AS name,
      coalesce(s.source_count >= 2 OR s.review_count >= 2 OR s.evidence_count >= 2, false) AS has_signal, coalesce(s.pros, []) AS pros, s.best_for, s.overview, s.buyer_signal, coalesce(s.pinned_takeaways, []) AS takeaways,
      row_number() OVER (PARTITION BY m.set_id ORDER BY c.brand, c.model, c.release_id) AS slot
    FROM v_member m JOIN v_card c ON c.release_id = m.release_id LEFT JOIN ({_CHOSEN}) x ON x.release_id = m.release_id LEFT JOIN v_summary s ON s.release_id = m.release_id"""
d.VIEWS["v_gate"] = """SELECT set_id, count(*) AS members, count(*) FILTER (has_signal) >= 2 AS allow_themes, count(*) FILTER (has_signal) >= 2 AND sum(evidence_count) >= 6 AS allow_shared FROM v_cmp GROUP BY set_id"""


def members(fx):
    k = F.col("release_id")
    sets = fx.release().select(F.floor(k / 5).cast("bigint").alias("set_id"), k, (k % 5).alias("position"))
    return sets.filter((F.col("set_id") % 9 != 0) | (F.col("position") == 0))


def comparison(fx):
    return cmp.comparison_rows(members(fx), cards(fx), cat.pick_variant(fx.variant(), requested_variants(fx)), notes(fx))


@query("cmp_1_comparison_rows", """SELECT set_id, release_id, name, weight_oz, price_usd, review_score, has_signal, array_to_string(pros, '|') AS pros, array_to_string(takeaways, '|') AS takeaways FROM v_cmp""")
def _(fx):
    return comparison(fx).select("set_id", "release_id", "name", "weight_oz", "price_usd", "review_score", "has_signal",
                                 F.array_join("pros", "|").alias("pros"), F.array_join("takeaways", "|").alias("takeaways"))


@query("cmp_2_overview", """SELECT set_id, CASE WHEN count(*) >= 2 THEN concat_ws(' ', string_agg(name, ', ' ORDER BY slot) || ' serve different buying priorities.',
    list(name ORDER BY weight_oz, slot) FILTER (weight_oz IS NOT NULL)[1] || ' is the lightest option in this set.',
    list(name ORDER BY review_score DESC, slot) FILTER (review_score IS NOT NULL)[1] || ' currently has the strongest review signal.') END AS overview FROM v_cmp GROUP BY set_id""")
def _(fx):
    return cmp.overview(comparison(fx)).select("set_id", "overview")


def _num(x: str) -> str:
    return f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


_MONEY = f"CASE WHEN coalesce(price_usd, 0) = 0 THEN 'Pending' ELSE '$' || {_num('CAST(price_usd AS DECIMAL(12,2))')} END"
_OZ = _num("CAST(weight_oz AS DECIMAL(6,1))")
_THEME = "coalesce(takeaways[1], pros[1])"
_PRICE = "list(name ORDER BY price_usd, slot) FILTER (price_usd IS NOT NULL)"
_WEIGHT = "list(name ORDER BY weight_oz, slot) FILTER (weight_oz IS NOT NULL)"
_INSIGHTS = f"""SELECT c.set_id, CASE WHEN count(*) >= 2 THEN list_filter([
      CASE WHEN count(price_usd) >= 2 AND max(price_usd) - min(price_usd) >= 20 THEN 'Price spread: ' || {_PRICE}[1] || ' is the cheaper option, while ' || {_PRICE}[-1] || ' sits at the top of the price range. ['
        || string_agg(name || ': ' || {_MONEY}, ';' ORDER BY price_usd, slot) FILTER (price_usd IS NOT NULL) || ']' END,
      CASE WHEN count(weight_oz) >= 2 AND round(max(weight_oz) - min(weight_oz), 6) >= 0.5 THEN 'Weight: ' || {_WEIGHT}[1] || ' is meaningfully lighter than ' || {_WEIGHT}[-1] || '. ['
        || string_agg(name || ': ' || {_OZ} || ' oz', ';' ORDER BY weight_oz, slot) FILTER (weight_oz IS NOT NULL) || ']' END,
      CASE WHEN bool_or(is_plated) AND NOT bool_and(is_plated) THEN 'Ride construction: ' || string_agg(name, ', ' ORDER BY slot) FILTER (is_plated) || ' bring plated geometry into the mix, while '
        || string_agg(name, ', ' ORDER BY slot) FILTER (NOT is_plated) || ' stay non-plated. [' || string_agg(name || ': ' || CASE WHEN is_plated THEN 'Plated' ELSE 'Non-plated' END, ';' ORDER BY slot) || ']' END,
      CASE WHEN bool_and(g.allow_themes) AND count({_THEME}) >= 2 THEN 'Review takeaway: ' || string_agg(name || ': ' || {_THEME}, ' ' ORDER BY slot) FILTER ({_THEME} <> '') || ' ['
        || string_agg(name || ': ' || {_THEME}, ';' ORDER BY slot) FILTER ({_THEME} <> '') || ']' END
    ], lambda v: v IS NOT NULL)[1:4] ELSE [] END AS insights FROM v_cmp c JOIN v_gate g ON g.set_id = c.set_id GROUP BY c.set_id"""


def _insight_text(x):
    return F.concat(x["title"], F.lit(": "), x["summary"], F.lit(" ["), F.array_join(x["evidence"], ";"), F.lit("]"))


@query("cmp_3_differences", f"SELECT set_id, array_to_string(insights, '|') AS insights FROM ({_INSIGHTS})")
def _(fx):
    rows = comparison(fx)
    return cmp.differences(rows, cmp.confidence_gate(rows)).select("set_id", F.array_join(F.transform("insights", _insight_text), "|").alias("insights"))


@query("cmp_4_confidence_gate", f"""SELECT set_id, allow_themes, allow_shared, CASE WHEN members < 2 THEN NULL WHEN NOT allow_themes THEN {d.quoted(cmp.THIN_CAUTION)}
    WHEN NOT allow_shared THEN {d.quoted(cmp.DEVELOPING_CAUTION)} END AS caution FROM v_gate""")
def _(fx):
    return cmp.confidence_gate(comparison(fx)).select("set_id", "allow_themes", "allow_shared", "caution")


_GUIDE = """SELECT set_id, 'Choose ' || name || ' if ' || lower(cue[1:1]) || cue[2:] AS guidance, row_number() OVER (PARTITION BY set_id ORDER BY slot) AS rank FROM (SELECT *, coalesce(nullif(best_for[1], ''), nullif(usage_summary, ''),
    CASE WHEN is_plated THEN 'Better fit for runners prioritizing a plated feel.' ELSE 'Safer fit for runners avoiding plated ride dynamics.' END) AS cue FROM v_cmp WHERE has_signal) QUALIFY rank <= 3"""


@query("cmp_5_chooser_guidance", f"SELECT set_id, CAST(rank AS INTEGER) AS rank, guidance FROM ({_GUIDE})")
def _(fx):
    return cmp.chooser_guidance(comparison(fx)).select("set_id", "rank", "guidance")


_SHARED = f"""SELECT set_id, list(signal ORDER BY slot, i)[1:4] AS shared FROM (SELECT set_id, signal, slot, i FROM (
      SELECT c.set_id, c.slot, unnest(list_concat(c.pros, c.takeaways)) AS signal, generate_subscripts(list_concat(c.pros, c.takeaways), 1) AS i FROM v_cmp c) x
    JOIN v_gate g USING (set_id) WHERE g.allow_shared AND NOT EXISTS (SELECT 1 FROM v_cmp o WHERE o.set_id = x.set_id AND NOT coalesce(list_bool_or(list_transform(list_concat(o.pros, o.takeaways),
      lambda v: contains({d.norm('v')}, string_split({d.norm('x.signal')}, ' ')[1]))), false))
    QUALIFY row_number() OVER (PARTITION BY set_id, signal ORDER BY slot, i) = 1) GROUP BY set_id"""


@query("set_6_shared_signals", f"SELECT g.set_id, coalesce(array_to_string(shared, '|'), '') AS shared FROM v_gate g LEFT JOIN ({_SHARED}) s USING (set_id) WHERE g.allow_shared")
def _(fx):
    rows = comparison(fx)
    return cmp.shared_signals(rows, cmp.confidence_gate(rows)).select("set_id", F.array_join("shared_signals", "|").alias("shared"))


@query("cmp_6_narrative", f"""SELECT g.set_id, coalesce((SELECT string_agg(guidance, '|' ORDER BY rank) FROM ({_GUIDE}) q WHERE q.set_id = g.set_id AND g.members >= 2), '') AS guidance,
    array_to_string(i.insights, '|') AS insights, CASE WHEN g.members >= 2 THEN coalesce(array_to_string(s.shared, '|'), '') ELSE '' END AS shared
    FROM v_gate g JOIN ({_INSIGHTS}) i ON i.set_id = g.set_id LEFT JOIN ({_SHARED}) s ON s.set_id = g.set_id""")
def _(fx):
    return cmp.narrative(comparison(fx)).select(
        "set_id", F.array_join("guidance", "|").alias("guidance"), F.array_join(F.transform("insights", _insight_text), "|").alias("insights"),
        F.array_join("shared_signals", "|").alias("shared"))


def _measure(x: str, suffix: str) -> str:
    return f"CASE WHEN coalesce({x}, 0) = 0 THEN 'Pending' ELSE {_num(f'CAST({x} AS DECIMAL(12,1))')} || '{suffix}' END"


_CELLS = ["category", "coalesce(usage_summary, 'Pending')", _MONEY, _measure("weight_oz", " oz"), _measure("heel_mm", " mm"), _measure("forefoot_mm", " mm"), _measure("drop_mm", " mm"),
          "CASE WHEN is_plated THEN 'Plated' ELSE 'Non-plated' END", _measure("review_score", "/100"), _measure("floor(average_score + 0.5)", "/100"), _measure("sentiment_score", "/100"),
          "'Pending'", "'Pending'", "coalesce(summary_alignment, 'mixed')", "coalesce(buyer_signal, 'Pending')", "coalesce(overview, 'Pending')",
          "CASE WHEN len(takeaways) > 0 THEN array_to_string(takeaways, ' • ') ELSE 'Pending' END"]
_LINES = " UNION ALL ".join(f"SELECT set_id, slot, {i} AS line, {d.quoted(label)} AS label, {cell} AS value FROM v_cmp" for i, (label, cell) in enumerate(zip(cmp.MATRIX_LABELS, _CELLS, strict=True)))


@query("set_4_comparison_matrix", f"SELECT set_id, line, label, {', '.join(f'max(value) FILTER (slot = {i}) AS value_{i}' for i in range(1, 5))} FROM ({_LINES}) GROUP BY set_id, line, label")
def _(fx):
    return cmp.comparison_matrix(comparison(fx))


# --- generated summaries ----------------------------------------------------------------

# --- fixed values: term words drawn from the test prose ---
PROSE_TERMS = (
    ("Fit", ("the an", "hean")), ("Ride", ("der ", "ung")), ("Cushioning", ("eau", "que")), ("Speed", ("cion", "los ")),
    ("Value", ("wh", "sh")), ("Stability", ("onen", "reat")), ("Traction", ("keit", "ver ")), ("Durability", ("ment", "ado ")),
)
d.VIEWS["v_docterms"] = f"""SELECT doc_id, {d.labels('h', PROSE_TERMS)} AS terms, title, CASE WHEN length(e) <= 220 THEN e ELSE substring(e, 1, 219) || '…' END AS evidence_text
    FROM (SELECT doc_id, title, {d.norm("concat_ws(' ', title, excerpt, body)")} AS h, {d.trim_ws('coalesce(excerpt, body, title)')} AS e FROM v_document)"""
d.VIEWS["v_sumrev"] = """SELECT f.*, t.terms, t.title, t.evidence_text FROM v_feature f JOIN v_docterms t ON t.doc_id = f.doc_slot % (SELECT count(*) FROM documents)"""
d.VIEWS["v_term"] = f"""SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY mentions DESC, first_position) AS rank FROM (
    SELECT release_id, term, count(*) AS mentions, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, min(place) AS first_position
    FROM (SELECT release_id, sentiment, term, row_number() OVER (PARTITION BY release_id ORDER BY published_at DESC NULLS FIRST, created_at DESC, review_id, pos) AS place
      FROM (SELECT *, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM v_sumrev)) GROUP BY release_id, term)"""


def summary_reviews(fx):
    texts = [F.col("title"), F.col("excerpt"), F.col("body")]
    docs = cut_lineage(fx.document(spread=True).select("doc_id", "title", t.infer_terms(texts, PROSE_TERMS).alias("terms"),
                                            sm.evidence_text(F.col("excerpt"), F.col("body"), F.col("title")).alias("evidence_text")))
    return rv.review_features(fx.attach_text(fx.review().filter("status = 'approved'"), docs), fx.source(), as_of())


@query("agg_12_term_rollup", "SELECT release_id, term, mentions, positive, negative FROM v_term")
def _(fx):
    return sm.term_rollup(summary_reviews(fx)).select("release_id", "term", "mentions", "positive", "negative")


@query("sum_2_summary_confidence", """SELECT release_id, CASE WHEN n >= 5 AND s >= 3 THEN 'high' WHEN n >= 2 AND s >= 2 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT release_id, count(*) AS n, count(DISTINCT source_name) AS s FROM v_feature GROUP BY release_id)""")
def _(fx):
    rows = rv.review_features(fx.review(), fx.source(), as_of()).groupBy("release_id").agg(F.count("*").alias("n"), F.count_distinct("source_name").alias("s"))
    return rows.select("release_id", sm.summary_confidence(F.col("n"), F.col("s")).alias("confidence"))


@query("sum_3_review_evidence", """SELECT release_id, CAST(rank AS INTEGER) AS rank, source_name, evidence_text FROM (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY published_at DESC NULLS FIRST, created_at DESC, review_id) AS rank
    FROM v_sumrev WHERE evidence_text <> '') WHERE rank <= 6""")
def _(fx):
    return sm.review_evidence(summary_reviews(fx)).select("release_id", "rank", "source_name", "evidence_text")


def _case(texts: dict[str, str], x: str) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN {d.quoted(k)} THEN {d.quoted(v)}" for k, v in texts.items()) + " END)"


def _or(values: str, default: str) -> str:
    return f"array_to_string((CASE WHEN len({values}) > 0 THEN {values} ELSE {default} END)[1:3], '|')"


def _said(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {d.quoted(lx.SUMMARY_TEXT[key])} END" for cond, key in pairs) + "], lambda v: v IS NOT NULL)"


_TXT = {k: d.quoted(v) for k, v in lx.SUMMARY_TEXT.items()}


def _mass(cond: str, channel: str = "true", factor: int = 10) -> str:
    return f"coalesce(sum(w * {factor}) FILTER ({cond} AND {channel}), 0)"


def _dom(p: str, m: str, n: str) -> str:
    return f"CASE WHEN {p} >= {m} AND {p} >= {n} THEN 'positive' WHEN {n} >= {m} AND {n} >= {p} THEN 'negative' ELSE 'mixed' END"


def _chan(channel: str) -> str:
    cols = [f"coalesce(sum(w) FILTER (coalesce(sentiment, mood) = '{s}' AND {channel}), 0)" for s in ("positive", "mixed", "negative")]
    return f"CASE WHEN count(*) FILTER ({channel}) > 0 THEN {_dom(*cols)} END"


d.VIEWS["v_generated"] = f"""SELECT *, CASE WHEN review_count >= 5 AND named >= 3 THEN 'high' WHEN review_count >= 2 AND named >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (
    SELECT x.release_id, any_value(mood) AS mood, count(*) AS review_count, count(DISTINCT source_key) AS source_count, count(DISTINCT source_name) AS named,
      least(count(*) FILTER (evidence_text <> ''), 6) AS evidence_count, {_chan("source_type = 'editorial'")} AS ed, {_chan("source_type <> 'editorial'")} AS co
    FROM (SELECT *, {d.source_weight('source_type')} AS w FROM v_sumrev) x JOIN (
      SELECT release_id, {_dom(_mass("sentiment = 'positive'"), "(" + _mass("sentiment = 'mixed'") + " + " + _mass("sentiment IS NULL", factor=7) + ")", _mass("sentiment = 'negative'"))} AS mood
      FROM (SELECT *, {d.source_weight('source_type')} AS w FROM v_sumrev) GROUP BY release_id) m ON m.release_id = x.release_id GROUP BY x.release_id)"""
d.VIEWS["v_gensum"] = f"""SELECT g.release_id, mood AS overall_sentiment, confidence, ed AS editorial_sentiment, co AS community_sentiment,
      CASE WHEN ed IS NULL OR co IS NULL THEN 'mixed' WHEN ed = co THEN 'aligned' WHEN ed || co IN ('positivenegative', 'negativepositive') THEN 'divergent' ELSE 'mixed' END AS source_alignment,
      concat_ws(' ', r.brand || ' ' || r.version_name || ' is landing with ' || CASE mood WHEN 'positive' THEN 'mostly positive' WHEN 'negative' THEN 'mostly negative' ELSE 'mixed' END
        || ' sentiment across the current approved review set.', pros[1], 'Main caution: ' || regexp_replace(cons[1], '\\.$', '') || '.') AS overview,
      CASE mood WHEN 'positive' THEN 'Broadly positive' WHEN 'negative' THEN 'Cautious' ELSE 'Mixed' END || ' buyer signal for ' || lower(f.category) || ' use with ' || confidence || ' confidence.' AS buyer_signal,
      {_or('pros', f"CASE WHEN mood = 'negative' THEN [] ELSE [{_TXT['pros_fallback']}] END")} AS pros,
      {_or('cons', f"[CASE WHEN mood = 'positive' THEN {_TXT['cons_fallback_positive']} ELSE {_TXT['cons_fallback']} END]")} AS cons,
      {_or(_said(("list_contains(names, 'Speed')", 'best_speed'), ("list_contains(names, 'Cushioning')", 'best_cushioning'), ("f.terrain = 'trail'", 'best_trail'), ("f.stability = 'stability'", 'best_stability')), f"[{_TXT['best_fallback']}]")} AS best_for,
      {_or(_said(("list_contains(names, 'Fit')", 'watch_fit'), ("list_contains(names, 'Value')", 'watch_value'), ("mood IN ('mixed', 'negative')", 'watch_mixed')), "['Compare this ' || lower(f.category) || ' model against shoes with a similar ride profile and intended use.']")} AS watch_outs,
      {_or(f"list_transform(list_filter(names, lambda x: x NOT IN ('Value', 'Fit'))[1:3], lambda x: CASE WHEN mood = 'negative' THEN {_case(lx.NEGATIVE_TERM_TEXT, 'x')} ELSE {_case(lx.POSITIVE_TERM_TEXT, 'x')} END)", f"[{_TXT['consensus_fallback']}]")} AS consensus_points,
      {_or("list_transform(list_filter(names, lambda x: x IN ('Fit', 'Ride', 'Value', 'Stability'))[1:3], lambda x: 'Some reviews diverge on ' || lower(x) || '.')", f"CASE WHEN mood = 'mixed' THEN [{_TXT['debates_fallback']}] ELSE [] END")} AS debates,
      review_count, source_count, evidence_count FROM (SELECT v.*, coalesce(k.names, []) AS names, coalesce(k.pros, []) AS pros, coalesce(k.cons, []) AS cons FROM v_generated v LEFT JOIN (
        SELECT release_id, list(term ORDER BY rank) AS names, coalesce(list({_case(lx.POSITIVE_TERM_TEXT, 'term')} ORDER BY rank) FILTER (positive >= negative), [])[1:3] AS pros,
          coalesce(list({_case(lx.NEGATIVE_TERM_TEXT, 'term')} ORDER BY rank) FILTER (negative > positive), [])[1:3] AS cons FROM v_term GROUP BY release_id) k ON k.release_id = v.release_id) g
    JOIN v_release r ON r.release_id = g.release_id JOIN v_family f ON f.family_id = r.family_id"""
SUMMARY_LISTS = ("pros", "cons", "best_for", "watch_outs", "consensus_points", "debates")


def generated(fx):
    releases = cat.release_star(fx.release(), fx.family()).select("release_id", F.concat_ws(" ", "brand", "version_name").alias("label"), "category", "terrain", "stability")
    return sm.release_summaries(summary_reviews(fx), releases)


@query("sum_1_release_summaries", "SELECT * FROM v_gensum")
def _(fx):
    return generated(fx).withColumns({c: F.array_join(c, "|") for c in SUMMARY_LISTS}).drop("provider")


@query("sum_4_validate_candidates", f"""SELECT release_id, CASE WHEN doc IS NULL THEN 'not json' WHEN coalesce({d.trim_ws(d.jstr('$.overview'))}, '') = '' THEN 'overview'
      WHEN {d.jenum('$.overallSentiment', lx.SENTIMENTS)} IS NULL THEN 'overallSentiment' WHEN json_type(doc, '$.pros') IS DISTINCT FROM 'ARRAY' THEN 'pros'
      WHEN len(list_filter(json_extract(doc, '$.pros[*]')[1:4], lambda e: json_type(e) <> 'VARCHAR')) > 0 THEN 'pros' END AS error,
      {d.trim_ws(d.jstr('$.overview'))} AS overview
    FROM (SELECT release_id, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS doc FROM (SELECT release_id, '{{"overview":' || CASE WHEN release_id % 7 = 0 THEN '3' ELSE '"  Text ' || release_id || ' "' END || ',"overallSentiment":"' ||
      CASE WHEN release_id % 5 = 0 THEN 'odd' ELSE 'mixed' END || '","confidence":"low","editorialSentiment":null,"communitySentiment":"mixed","sourceAlignment":"mixed","buyerSignal":null,"pros":' ||
      CASE release_id % 6 WHEN 0 THEN '"x"' WHEN 1 THEN '["a",1]' WHEN 2 THEN '["a","b","c","d",5]' ELSE '[" a ",""]' END || ',"cons":[],"bestFor":[],"watchOuts":[],"consensusPoints":[],"debates":[]' || CASE WHEN release_id % 11 = 0 THEN '' ELSE '}}' END AS j FROM v_release))""")
def _(fx):
    k, text = F.col("release_id"), F.col("release_id").cast("string")
    m = k % 6
    candidate = F.concat(
        F.lit('Here it is: {"overview":'), F.when(k % 7 == 0, "3").otherwise(F.concat(F.lit('"  Text '), text, F.lit(' "'))),
        F.lit(',"overallSentiment":"'), F.when(k % 5 == 0, "odd").otherwise("mixed"),
        F.lit('","confidence":"low","editorialSentiment":null,"communitySentiment":"mixed","sourceAlignment":"mixed","buyerSignal":null,"pros":'),
        F.when(m == 0, '"x"').when(m == 1, '["a",1]').when(m == 2, '["a","b","c","d",5]').otherwise('[" a ",""]'),
        F.lit(',"cons":[],"bestFor":[],"watchOuts":[],"consensusPoints":[],"debates":[]'), F.when(k % 11 == 0, "").otherwise("} Hope it helps."))
    return sm.validate_candidates(fx.release().select("release_id", candidate.alias("candidate"))).select("release_id", "error", "overview")


# --- state ------------------------------------------------------------------------------

@query("edt_5_refresh_delta", """SELECT r.release_id, CASE WHEN g.release_id IS NULL THEN 'cleared' WHEN s.doc IS NOT NULL AND json_type(s.doc, '$.aiReviewSummary') = 'OBJECT' THEN 'refreshed' ELSE 'generated' END AS event_type,
    g.overview, coalesce(g.review_count, 0) AS review_count, coalesce(g.evidence_count, 0) AS evidence_count
    FROM (SELECT DISTINCT release_id FROM v_review WHERE published_at >= TIMESTAMP '2001-06-01') r LEFT JOIN v_gensum g ON g.release_id = r.release_id LEFT JOIN v_doc s ON s.release_id = r.release_id""")
def _(fx):
    changed = fx.review().filter(F.col("published_at") >= F.lit("2001-06-01").cast("timestamp")).select("release_id")
    return mod.refresh_delta(changed, generated(fx), mod.had_summary(fx.metadata()), as_of()).select(
        "release_id", "event_type", "overview", "review_count", "evidence_count")


@query("agg_14_refresh_counters", """SELECT count(*) FILTER (g.release_id IS NOT NULL AND coalesce(json_type(s.doc, '$.aiReviewSummary'), '') <> 'OBJECT') AS generated,
    count(*) FILTER (g.release_id IS NOT NULL AND json_type(s.doc, '$.aiReviewSummary') = 'OBJECT') AS refreshed, count(*) FILTER (g.release_id IS NULL) AS skipped, count(g.release_id) AS heuristic
    FROM v_release r LEFT JOIN (SELECT DISTINCT release_id FROM v_feature) g ON g.release_id = r.release_id LEFT JOIN v_doc s ON s.release_id = r.release_id""")
def _(fx):
    return mod.refresh_counters(mod.refresh_delta(fx.release(), generated(fx), mod.had_summary(fx.metadata()), as_of()))


@query("edt_1_merge_metadata", """SELECT release_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(CASE WHEN json_type(doc) = 'OBJECT' THEN json_keys(doc) ELSE [] END, CASE WHEN release_id % 3 = 0 THEN ['editorialReviewSummary'] ELSE [] END)),
      lambda k: NOT (release_id % 3 = 1 AND k = 'aiReviewSummary'))), '|') AS keys,
    CASE WHEN release_id % 3 = 0 THEN 'Patched' ELSE n_note END AS note FROM v_stored""")
def _(fx):
    k = F.col("release_id") % 3
    patch = {"editorialReviewSummary": (k == 0, F.lit('{"summaryNote":"Patched"}')), "aiReviewSummary": (k == 1, F.lit(None).cast("string"))}
    merged = fx.metadata().select("release_id", md.merge_metadata(F.col("metadata"), patch).alias("metadata"))
    keys = F.array_join(F.array_sort(F.json_object_keys("metadata")), "|")
    return merged.select("release_id", keys.alias("keys"), md.read_string("try_parse_json(metadata)", "$.editorialReviewSummary.summaryNote").alias("note"))
