"""Catalog scans, projections, filters, orderings, diffs and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import lexicons as lx, text as t
from shelfsight.operators import catalog as cat, filters as flt, metadata as md, ordering as srt, scoring
from shelfsight.plans import duck as d
from shelfsight.plans.registry import query

d.VIEWS["v_card"] = f"""SELECT *, CASE WHEN average_score IS NULL AND sentiment_score IS NULL THEN NULL
      WHEN average_score IS NULL THEN {d.half_up('sentiment_score * 0.45::DOUBLE / 0.45::DOUBLE')}
      WHEN sentiment_score IS NULL THEN {d.half_up('average_score * 0.55::DOUBLE / 0.55::DOUBLE')}
      ELSE {d.half_up('(average_score * 0.55::DOUBLE + sentiment_score * 0.45::DOUBLE) / (0.55::DOUBLE + 0.45::DOUBLE)')} END AS review_score FROM (
    SELECT r.release_id, r.brand, r.family AS model, r.family_id, r.version_name AS release, {d.slug('r.version_name')} AS release_slug,
    {d.slug('r.family_id')} AS family_slug, r.release_year,
    {d.humanize('f.category')} AS category, {d.humanize('f.terrain')} AS terrain, {d.capitalize('f.stability')} AS stability,
    r.foam, concat_ws(', ', nullif(r.foam, ''), CASE WHEN r.is_plated THEN 'Plated' ELSE 'Non-plated' END) AS ride_profile, r.usage_summary,
    CAST(r.msrp_usd AS DOUBLE) AS price_usd, CAST(s.weight_oz AS DOUBLE) AS weight_oz, s.heel_mm, s.forefoot_mm, s.drop_mm,
    coalesce(st.review_count, 0) AS review_count, st.average_score, r.is_plated, r.is_current,
    coalesce(m.source_count, 0) AS source_count, coalesce(m.evidence_count, 0) AS evidence_count, m.overall_sentiment, m.confidence AS summary_confidence,
    m.source_alignment AS summary_alignment,
    CASE m.overall_sentiment WHEN 'positive' THEN 86 WHEN 'negative' THEN 48 WHEN 'mixed' THEN 69 END
      + CASE m.confidence WHEN 'high' THEN 3 WHEN 'low' THEN -3 ELSE 0 END AS sentiment_score
    FROM v_release r JOIN v_family f ON r.family_id = f.family_id LEFT JOIN v_spec s ON s.release_id = r.release_id
    LEFT JOIN v_stats st ON st.release_id = r.release_id LEFT JOIN v_summary m ON m.release_id = r.release_id)"""


def summaries(fx):
    return md.read_release_metadata(fx.metadata())


def cards(fx):
    return cat.catalog_cards(fx.release(), fx.family(), fx.spec(), fx.review(), summaries(fx))


@query("src_1_dimension_options", """SELECT f.family_id AS id, r.brand || ' ' || r.family AS label FROM v_family f
    JOIN (SELECT DISTINCT family_id, brand, family FROM v_release) r ON f.family_id = r.family_id""")
def _(fx):
    names = fx.release().select("family_id", "brand", "family").distinct()
    return fx.family().join(names, "family_id").orderBy("brand", "family").select(
        F.col("family_id").alias("id"), F.concat_ws(" ", "brand", "family").alias("label"))


@query("src_2_resolve_natural_keys", f"""SELECT 'resolved' AS outcome, count(*) AS n, CAST(sum(r.release_id) AS BIGINT) AS checksum
      FROM (SELECT *, CASE WHEN release_id % 10 = 0 THEN {d.slug('family_id')} || ':missing' ELSE {d.slug('family_id')} || ':' || version_name END AS k FROM v_release) b
      JOIN (SELECT release_id, {d.slug('family_id')} || ':' || version_name AS k FROM v_release) r ON b.k = r.k
    UNION ALL SELECT 'unresolved', count(*), CAST(sum(release_id) AS BIGINT) FROM v_release WHERE release_id % 10 = 0""")
def _(fx):
    from shelfsight.operators.merge import resolve_keys
    release = fx.release().withColumn("slug", t.slugify(F.col("family_id")))
    known = release.select("release_id", F.concat_ws(":", "slug", "version_name").alias("release_key"))
    batch = release.select(F.col("release_id").alias("batch_id"), F.concat_ws(
        ":", "slug", F.when(F.col("release_id") % 10 == 0, "missing").otherwise(F.col("version_name"))).alias("release_key"))
    resolved, unresolved = resolve_keys(batch, known, ["release_key"])

    def tally(df, outcome, key):
        return df.agg(F.lit(outcome).alias("outcome"), F.count("*").alias("n"), F.sum(key).alias("checksum"))

    return tally(resolved, "resolved", "release_id").unionByName(tally(unresolved, "unresolved", "batch_id"))


@query("src_8_release_page", """SELECT release_id, version_name FROM v_release ORDER BY version_name, release_id LIMIT 50 OFFSET 100""")
def _(fx):
    return fx.release().select("release_id", "version_name").orderBy("version_name", "release_id").offset(100).limit(50)


@query("prj_5_ride_profile", """SELECT release_id, concat_ws(', ', foam, CASE WHEN is_plated THEN 'Plated' ELSE 'Non-plated' END) AS ride FROM v_release""")
def _(fx):
    return fx.release().select("release_id", cat.ride_profile(F.col("foam"), F.col("is_plated")).alias("ride"))


_CHOSEN = """SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.release_id ORDER BY
    CASE WHEN v.variant_key = CASE v.release_id % 3 WHEN 0 THEN 'womens' WHEN 1 THEN 'mens' END THEN 1 ELSE 0 END DESC, v.is_primary DESC, v.display_label) AS rk
    FROM v_variant v) WHERE rk = 1"""


def requested_variants(fx):
    k = F.col("release_id")
    return fx.release().select("release_id", F.when(k % 3 == 0, "womens").when(k % 3 == 1, "mens").alias("variant_key")).filter("variant_key IS NOT NULL")


@query("prj_6_resolve_specs", f"""SELECT r.release_id, c.variant_key, CAST(coalesce(c.weight_oz, s.weight_oz) AS DOUBLE) AS weight_oz,
    coalesce(c.heel_mm, s.heel_mm) AS heel_mm, coalesce(c.drop_mm, s.drop_mm) AS drop_mm, coalesce(c.fit_notes, s.fit_notes) AS fit_notes
    FROM v_release r LEFT JOIN ({_CHOSEN}) c ON r.release_id = c.release_id LEFT JOIN v_spec s ON s.release_id = r.release_id""")
def _(fx):
    chosen = cat.pick_variant(fx.variant(), requested_variants(fx))
    return cat.resolve_specs(fx.release(), fx.spec(), chosen).select(
        "release_id", "variant_key", F.col("weight_oz").cast("double").alias("weight_oz"), "heel_mm", "drop_mm", "fit_notes")


@query("jn_5_selected_variant", f"SELECT release_id, variant_key, audience, is_primary, CAST(weight_oz AS DOUBLE) AS weight_oz FROM ({_CHOSEN})")
def _(fx):
    return cat.pick_variant(fx.variant(), requested_variants(fx)).select(
        "release_id", "variant_key", "audience", "is_primary", F.col("weight_oz").cast("double").alias("weight_oz"))


@query("jn_4_nested_variants", """SELECT release_id, string_agg(variant_key || '=' || coalesce(CAST(CAST(weight_oz AS DOUBLE) AS VARCHAR), '?'), ',' ORDER BY is_primary DESC, display_label) AS variants
    FROM v_variant GROUP BY release_id""")
def _(fx):
    shown = F.transform("variants", lambda v: F.concat(v["variant_key"], F.lit("="), F.coalesce(v["weight_oz"].cast("double").cast("string"), F.lit("?"))))
    return cat.variants_by_release(fx.variant()).select("release_id", F.array_join(shown, ",").alias("variants"))


@query("agg_15_variant_checks", """SELECT release_id, bool_or(audience = 'mens') AND bool_or(audience = 'womens') AS both_cuts FROM v_variant GROUP BY release_id""")
def _(fx):
    return cat.variants_by_release(fx.variant()).select("release_id", F.col("has_mens_and_womens").alias("both_cuts"))


CARD_COLUMNS = ("release_id, brand, model, release, release_slug, release_year, category, terrain, stability, foam, ride_profile, usage_summary, "
                "price_usd, weight_oz, heel_mm, forefoot_mm, drop_mm, review_count, is_plated, is_current, review_score").split(", ")


@query("prj_7_catalog_cards", f"SELECT {', '.join(CARD_COLUMNS)} FROM v_card")
def _(fx):
    return cards(fx).select(*CARD_COLUMNS)


@query("jn_1_catalog_star", """SELECT r.release_id, r.brand, f.category, CAST(s.weight_oz AS DOUBLE) AS weight_oz, coalesce(st.review_count, 0) AS review_count
    FROM v_release r JOIN v_family f ON r.family_id = f.family_id LEFT JOIN v_spec s ON s.release_id = r.release_id LEFT JOIN v_stats st ON st.release_id = r.release_id""")
def _(fx):
    return cat.release_star(fx.release(), fx.family(), fx.spec()).join(cat.approved_stats(fx.review()), "release_id", "left").select(
        "release_id", "brand", "category", F.col("weight_oz").cast("double").alias("weight_oz"), F.coalesce("review_count", F.lit(0)).alias("review_count"))


@query("agg_1_approved_stats", "SELECT release_id, review_count, round(average_score, 6) AS average_score FROM v_stats")
def _(fx):
    return cat.approved_stats(fx.review()).select("release_id", "review_count", F.round("average_score", 6).alias("average_score"))


@query("flt_8_zero_review_releases_kept", """SELECT r.release_id, count(v.review_id) AS approved FROM v_release r
    LEFT JOIN v_review v ON v.release_id = r.release_id AND v.status = 'approved' GROUP BY r.release_id""")
def _(fx):
    return fx.release().select("release_id").join(cat.approved_stats(fx.review()), "release_id", "left").select(
        "release_id", F.coalesce("review_count", F.lit(0)).alias("approved"))


@query("jn_6_semi_join_ids", "SELECT release_id, version_name FROM v_release WHERE release_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(fx):
    wanted = fx.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("release_id"))
    return fx.release().select("release_id", "version_name").join(wanted, "release_id", "left_semi")


# --- filters --------------------------------------------------------------------------

def _filter_query(name, where, **arguments):
    @query(name, f"SELECT release_id, release, review_score FROM v_card WHERE {where}")
    def _(fx):
        return flt.filter_catalog(cards(fx), **arguments).select("release_id", "release", "review_score")


_filter_query("flt_1_text_contains", "contains(lower(concat_ws(' ', brand, model, release, coalesce(usage_summary, ''), ride_profile, coalesce(foam, ''))), 'brand#2 red')", q="  BRAND#2 Red ")
_filter_query("flt_2_equality_facets", "brand = 'Brand#3' AND category = 'Economy Trainer' AND terrain IN ('Road') AND stability = 'Neutral'", brand="Brand#3", category="Economy Trainer", terrain="Road", stability="Neutral")
_filter_query("flt_3_plated_current", "NOT is_plated AND is_current", plated="non-plated", current="current")
_filter_query("flt_4_ranges", "release_year BETWEEN 2017 AND 2023 AND price_usd >= 905 AND weight_oz <= 11.5 AND heel_mm BETWEEN 22 AND 40 AND forefoot_mm >= 15 AND drop_mm <= 9",
              min_release_year="2017", max_release_year="2023", min_price=" 905 ", max_price="many", max_weight="11.5", min_heel="22", max_heel="40", min_forefoot="15", max_drop="9")
_filter_query("flt_5_cushion_band", "coalesce(heel_mm, forefoot_mm) BETWEEN 30 AND 35", cushion="moderate")
_filter_query("flt_6_min_score_count", "coalesce(review_score, -1) >= 62 AND review_count >= 4", min_review_score="62", min_review_count="4")


@query("flt_5_cushion_bands", "SELECT release_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s <= 29 THEN 'low' WHEN s BETWEEN 30 AND 35 THEN 'moderate' ELSE 'max' END AS band FROM (SELECT release_id, coalesce(heel_mm, forefoot_mm) AS s FROM v_spec)")
def _(fx):
    band = F.when(flt.cushion_band("low"), "low").when(flt.cushion_band("moderate"), "moderate").when(flt.cushion_band("max"), "max").otherwise("unknown")
    return fx.spec().select("release_id", band.alias("band"))


@query("flt_14_under_covered", """SELECT r.release_id, r.release_year, coalesce(s.review_count, 0) AS approved FROM v_release r LEFT JOIN v_stats s USING (release_id)
    WHERE coalesce(s.review_count, 0) < 2""")
def _(fx):
    from shelfsight.operators.planning import under_covered
    return under_covered(fx.release(), fx.review(), 2).select("release_id", "release_year", F.col("review_count").alias("approved"))


@query("flt_16_type_ahead", "SELECT release_id, search_label FROM (SELECT release_id, concat_ws(' ', brand, model, release, CAST(release_year AS VARCHAR)) AS search_label FROM v_card) WHERE contains(trim(regexp_replace(lower(search_label), '[^a-z0-9]+', ' ', 'g')), 'red') AND contains(trim(regexp_replace(lower(search_label), '[^a-z0-9]+', ' ', 'g')), '2019')")
def _(fx):
    labelled = fx.release().select("release_id", F.concat_ws(" ", "brand", "family", "version_name", F.col("release_year").cast("string")).alias("search_label"))
    return flt.type_ahead(labelled, F.lit(" Red, 2019 "))


@query("prj_15_option_labels", """SELECT release_id, brand || ' ' || release AS label,
    category || ' · ' || coalesce(CAST(release_year AS VARCHAR), 'Year TBD') || ' · ' || CASE WHEN is_plated THEN 'Plated' ELSE 'Non-plated' END AS detail,
    concat_ws(' ', brand, model, release, CAST(release_year AS VARCHAR)) AS search_label FROM v_card""")
def _(fx):
    from shelfsight.operators.compare import option_labels
    return option_labels(cards(fx))


@query("prj_14_query_text", "SELECT release_id, concat_ws(' ', nullif(trim(brand), ''), nullif(trim(version_name), '')) AS query FROM v_release")
def _(fx):
    from shelfsight.operators.matching import query_text
    return fx.release().select("release_id", query_text(F.col("brand"), F.col("version_name")).alias("query"))


# --- orderings: the position is part of the answer --------------------------------------

_SORT_SQL = {
    "latest": "is_current DESC, coalesce(release_year, 0) DESC, brand DESC, release DESC, release_id DESC",
    "oldest": "is_current, coalesce(release_year, 0), brand, release, release_id",
    "brand-a-z": "brand, model, brand, release, release_id",
    "price-low": "price_usd NULLS FIRST, brand, release, release_id",
    "price-high": "price_usd DESC NULLS LAST, brand DESC, release DESC, release_id DESC",
    "weight-light": "weight_oz NULLS FIRST, brand, release, release_id",
    "weight-heavy": "weight_oz DESC NULLS LAST, brand DESC, release DESC, release_id DESC",
    "drop-low": "drop_mm NULLS FIRST, brand, release, release_id",
    "drop-high": "drop_mm DESC NULLS LAST, brand DESC, release DESC, release_id DESC",
    "review-score": "review_score DESC NULLS LAST, brand DESC, release DESC, release_id DESC",
    "most-reviewed": "review_count DESC, brand DESC, release DESC, release_id DESC",
    "heel-stack": "heel_mm DESC NULLS LAST, brand DESC, release DESC, release_id DESC",
}


def _sort_query(name, sort, order_sql, **kwargs):
    @query(name, f"SELECT release_id, release, row_number() OVER (ORDER BY {order_sql}) AS position FROM v_card")
    def _(fx):
        return srt.positioned(srt.sort_catalog(cards(fx), sort, **kwargs).select("release_id", "release"))


for _name, _order in _SORT_SQL.items():
    _sort_query(f"srt_1_{_name.replace('-', '_')}", _name, _order)

_sort_query("srt_2_latest_ascending", "latest", _SORT_SQL["oldest"], direction="asc")
_sort_query("srt_3_nulls_lowest_asc", "release-year", "release_year NULLS FIRST, brand, release, release_id", direction="asc")
_REL = """CASE WHEN contains(lower(brand || ' ' || release), 'red') THEN 5 ELSE 0 END + CASE WHEN contains(lower(brand || ' ' || model), 'red') THEN 4 ELSE 0 END
    + CASE WHEN contains(lower(concat_ws(' ', brand, model, brand, release, coalesce(usage_summary, ''), ride_profile)), 'red') THEN 2 ELSE 0 END + CAST(is_current AS INTEGER)"""
_sort_query("srt_4_relevance", None, f"{_REL} DESC, is_current DESC, coalesce(release_year, 0) DESC, brand, release, release_id", q="Red")
_sort_query("srt_4_relevance_reference_order", None, f"{_REL}, is_current, coalesce(release_year, 0), brand, release, release_id", q="Red", reference_order=True)


# --- diffs --------------------------------------------------------------------------------

def _num_text(x: str) -> str:
    return f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def _mm(x: str) -> str:
    return f"CASE WHEN coalesce({x}, 0) = 0 THEN 'unknown' ELSE CAST({x} AS VARCHAR) || ' mm' END"


def _stack(h: str, f: str) -> str:
    return f"CASE WHEN coalesce({h}, 0) = 0 OR coalesce({f}, 0) = 0 THEN 'unknown' ELSE CAST({h} AS VARCHAR) || '/' || CAST({f} AS VARCHAR) || ' mm' END"


_LEAD_FIELDS = "release_id version_name foam is_plated msrp_usd weight_oz heel_mm forefoot_mm drop_mm has_summary overview overall_sentiment best_for pros review_count source_count".split()
d.VIEWS["v_diff"] = f"""SELECT family_id, release_id, version_name, p_version_name, p_release_id IS NULL AS is_first,
    list_filter([
      CASE WHEN foam IS DISTINCT FROM p_foam THEN 'Foam changed from ' || coalesce(p_foam, 'unknown') || ' to ' || coalesce(foam, 'unknown') || '.' END,
      CASE WHEN is_plated <> p_is_plated THEN CASE WHEN is_plated THEN 'Plate added to this version.' ELSE 'Plate removed from this version.' END END,
      CASE WHEN msrp_usd IS DISTINCT FROM p_msrp_usd THEN 'MSRP moved from ' || coalesce('$' || {_num_text('p_msrp_usd')}, 'unknown') || ' to ' || coalesce('$' || {_num_text('msrp_usd')}, 'unknown') || '.' END,
      CASE WHEN weight_oz IS DISTINCT FROM p_weight_oz THEN 'Men''s weight shifted from ' || coalesce({_num_text('p_weight_oz')} || ' oz', 'unknown') || ' to ' || coalesce({_num_text('weight_oz')} || ' oz', 'unknown') || '.' END,
      CASE WHEN heel_mm IS DISTINCT FROM p_heel_mm OR forefoot_mm IS DISTINCT FROM p_forefoot_mm THEN 'Stack changed from ' || {_stack('p_heel_mm', 'p_forefoot_mm')} || ' to ' || {_stack('heel_mm', 'forefoot_mm')} || '.' END,
      CASE WHEN drop_mm IS DISTINCT FROM p_drop_mm THEN 'Drop changed from ' || {_mm('p_drop_mm')} || ' to ' || {_mm('drop_mm')} || '.' END,
      CASE WHEN comparable AND overall_sentiment <> p_overall_sentiment THEN 'Overall review sentiment shifted from ' || p_overall_sentiment || ' to ' || overall_sentiment || '.' END,
      CASE WHEN comparable AND best_for[1] <> p_best_for[1] THEN 'Best-for signal moved from “' || p_best_for[1] || '” to “' || best_for[1] || '”.' END,
      CASE WHEN comparable AND pros[1] <> p_pros[1] THEN 'Reviewers shifted from “' || p_pros[1] || '” to “' || pros[1] || '”.' END,
      CASE WHEN NOT comparable AND overview <> p_overview THEN 'Review sentiment changed noticeably from the previous version.' END
    ], lambda v: v IS NOT NULL)[1:4] AS items FROM (
    SELECT *, coalesce(review_count >= 2 AND p_review_count >= 2 AND source_count >= 1 AND p_source_count >= 1, false) AS comparable FROM (
    SELECT *, {', '.join(f'lead({f}) OVER w AS p_{f}' for f in _LEAD_FIELDS)} FROM (
      SELECT r.*, s.weight_oz, s.heel_mm, s.forefoot_mm, s.drop_mm, m.has_summary, m.overview, m.overall_sentiment, m.best_for, m.pros, m.review_count, m.source_count
      FROM v_release r LEFT JOIN v_spec s ON r.release_id = s.release_id LEFT JOIN v_summary m ON m.release_id = r.release_id)
    WINDOW w AS (PARTITION BY family_id ORDER BY release_year DESC NULLS FIRST, is_current DESC, version_name, release_id)))"""


def changes(fx):
    told = md.read_release_summary(fx.metadata(), cat.DIFF_SUMMARY_FIELDS)
    rows = fx.release().join(fx.spec(), "release_id", "left").join(told, "release_id", "left")
    return cat.release_changes(rows)


@query("win_1_previous_release", "SELECT release_id, p_version_name AS previous_release FROM v_diff")
def _(fx):
    rows = cat.with_previous(fx.release(), ["release_id", "version_name"])
    return rows.select("release_id", F.col("previous.version_name").alias("previous_release"))


@query("win_2_release_changes", f"""SELECT release_id, p_version_name AS previous_release, array_to_string(CASE WHEN is_first THEN ['{cat.BASELINE_TEXT}']
    WHEN len(items) = 0 THEN ['{cat.NO_CHANGE_TEXT}'] ELSE items END, '|') AS changes FROM v_diff""")
def _(fx):
    return changes(fx).select("release_id", "previous_release", F.array_join("changes", "|").alias("changes"))


@query("win_3_change_teaser", f"""SELECT release_id, array_to_string((CASE WHEN is_first THEN ['{cat.BASELINE_TEXT}']
    WHEN len(items) = 0 THEN ['{cat.NO_CHANGE_TEXT}'] ELSE items END)[1:2], '|') AS teaser FROM v_diff""")
def _(fx):
    return cat.change_teaser(changes(fx)).select("release_id", F.array_join("teaser", "|").alias("teaser"))


@query("win_4_featured_release", """SELECT family_id, release_id, version_name FROM v_release
    QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY release_year DESC NULLS FIRST, is_current DESC, version_name, release_id) = 1""")
def _(fx):
    return cat.featured_release(fx.release()).select("family_id", "release_id", "version_name")


@query("prj_10_diff_formatters", f"""SELECT r.release_id, coalesce('$' || {_num_text('msrp_usd')}, 'unknown') AS usd, coalesce({_num_text('weight_oz')} || ' oz', 'unknown') AS oz,
    {_stack('heel_mm', 'forefoot_mm')} AS stack, {_mm('drop_mm')} AS drop_text FROM v_release r JOIN v_spec s ON r.release_id = s.release_id""")
def _(fx):
    return fx.release().join(fx.spec(), "release_id").select(
        "release_id", cat.format_usd(F.col("msrp_usd")).alias("usd"), cat.format_oz(F.col("weight_oz")).alias("oz"),
        cat.format_stack(F.col("heel_mm"), F.col("forefoot_mm")).alias("stack"), cat.format_mm(F.col("drop_mm")).alias("drop_text"))


# --- facets ---------------------------------------------------------------------------------

_FEED_SELECTED = {"brand": ("Brand#11", "Brand#22", "Brand#33", "Brand#3", "Brand#1"), "source_type": ("editorial", "reddit"), "sentiment": ("positive",)}


def _facet_statement(facet: str) -> str:
    """A facet's values under the selections of the others, as a statement of its own."""
    others = " AND ".join(f"coalesce({name} IN {values if len(values) > 1 else '(' + repr(values[0]) + ')'}, false)" for name, values in _FEED_SELECTED.items() if name != facet)
    own = f"coalesce({facet} IN ({', '.join(map(repr, _FEED_SELECTED[facet]))}), false)" if facet in _FEED_SELECTED else "false"
    return f"SELECT '{facet}' AS facet, {facet} AS value, count(*) AS n, {own} AS is_selected FROM feed WHERE {others or 'true'} GROUP BY {facet}"


@query("agg_11_dependent_facets", f"""WITH feed AS (SELECT c.brand, c.category, c.terrain, s.source_type, v.sentiment FROM v_review v JOIN v_card c ON c.release_id = v.release_id JOIN v_source s ON s.source_id = v.source_id WHERE v.status = 'approved')
    {" UNION ALL ".join(_facet_statement(f) for f in ("brand", "category", "terrain", "source_type", "sentiment"))}""")
def _(fx):
    """Filter options of the review feed, each under what is chosen in the others."""
    from shelfsight.operators.compare import dependent_facets
    star = cat.release_star(fx.release(), fx.family()).select("release_id", "brand", t.humanize(F.col("category")).alias("category"), t.humanize(F.col("terrain")).alias("terrain"))
    feed = fx.review().filter("status = 'approved'").select("release_id", "source_id", "sentiment").join(star, "release_id").join(fx.source().select("source_id", "source_type"), "source_id")
    names = ("brand", "category", "terrain", "source_type", "sentiment")
    return dependent_facets(feed, {name: F.col(name) for name in names}, _FEED_SELECTED)


@query("agg_11_facet_values", """SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM v_card GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM v_card GROUP BY 2
    UNION ALL SELECT 'terrain', terrain, count(*) FROM v_card GROUP BY 2 UNION ALL SELECT 'stability', stability, count(*) FROM v_card GROUP BY 2""")
def _(fx):
    from shelfsight.operators.compare import facet_values
    star = cat.release_star(fx.release(), fx.family()).select(
        "brand", t.humanize(F.col("category")).alias("category"), t.humanize(F.col("terrain")).alias("terrain"), t.capitalize(F.col("stability")).alias("stability"))
    return facet_values(star, ["brand", "category", "terrain", "stability"])


@query("agg_11_first_seen_order", """SELECT value, first_position FROM (SELECT brand AS value, min(release_id) AS first_position FROM v_release GROUP BY brand)""")
def _(fx):
    return cat.first_seen_values(fx.release(), "brand", F.col("release_id"))


@query("win_6_keep_first", """SELECT brand, release_id, version_name FROM v_release QUALIFY row_number() OVER (PARTITION BY brand, release_year ORDER BY release_id) = 1""")
def _(fx):
    from shelfsight.operators.merge import keep_first
    return keep_first(fx.release(), ["brand", "release_year"], [F.col("release_id")]).select("brand", "release_id", "version_name")


# --- metadata reads ---------------------------------------------------------------------------

@query("arr_1_typed_string_list", "SELECT release_id, array_to_string(s_pros, '|') AS pros, array_to_string(s_watch_outs, '|') AS watch_outs, array_to_string(n_ignored, '|') AS ignored FROM v_stored")
def _(fx):
    v = "_v"
    base = fx.metadata().select("release_id", F.try_parse_json("metadata").alias("_v"))
    return base.select(
        "release_id", F.array_join(md.read_string_list(v, "$.aiReviewSummary.pros", 4), "|").alias("pros"),
        F.array_join(md.read_string_list(v, "$.aiReviewSummary.watchOuts", 4), "|").alias("watch_outs"),
        F.array_join(md.read_string_list(v, "$.editorialReviewSummary.ignoredThemes", 8), "|").alias("ignored"))


@query("arr_2_typed_evidence", "SELECT release_id, s_evidence AS evidence_count FROM v_stored")
def _(fx):
    base = fx.metadata().select("release_id", F.try_parse_json("metadata").alias("_v"))
    return base.select("release_id", F.size(md.read_evidence("_v", "$.aiReviewSummary.evidence")).cast("bigint").alias("evidence_count"))


@query("jsn_1_typed_scalars", "SELECT release_id, s_sentiment AS sentiment, s_confidence AS confidence, s_editorial AS editorial, s_community AS community, s_alignment AS alignment, s_buyer AS buyer, s_review_count AS review_count, s_provider AS provider FROM v_stored")
def _(fx):
    v, p = "_v", "$.aiReviewSummary"
    base = fx.metadata().select("release_id", F.try_parse_json("metadata").alias("_v"))
    return base.select(
        "release_id", md.read_enum(v, f"{p}.overallSentiment", lx.SENTIMENTS).alias("sentiment"), md.read_enum(v, f"{p}.confidence", lx.CONFIDENCES).alias("confidence"),
        md.read_enum(v, f"{p}.editorialSentiment", lx.SENTIMENTS).alias("editorial"), md.read_enum(v, f"{p}.communitySentiment", lx.SENTIMENTS).alias("community"),
        F.coalesce(md.read_enum(v, f"{p}.sourceAlignment", lx.ALIGNMENTS), F.lit("mixed")).alias("alignment"), md.read_string(v, f"{p}.buyerSignal").alias("buyer"),
        md.read_count(v, f"{p}.reviewCount").alias("review_count"), md.read_enum(v, f"{p}.provider", lx.SUMMARY_PROVIDERS).alias("provider"))


@query("jsn_2_record_validity", "SELECT release_id, is_valid, CASE WHEN is_valid THEN s_overview END AS overview FROM v_stored")
def _(fx):
    return summaries(fx).select("release_id", F.col("stored").isNotNull().alias("is_valid"), F.col("stored.overview").alias("overview"))


@query("edt_2_override_overlay", """SELECT release_id, overview, overall_sentiment, confidence, array_to_string(pros, '|') AS pros, array_to_string(cons, '|') AS cons, is_override FROM v_summary""")
def _(fx):
    s = F.col("summary")
    return summaries(fx).select("release_id", s["overview"].alias("overview"), s["overall_sentiment"].alias("overall_sentiment"), s["confidence"].alias("confidence"),
                                F.array_join(s["pros"], "|").alias("pros"), F.array_join(s["cons"], "|").alias("cons"), s["is_override"].alias("is_override"))


@query("edt_3_summary_status", """SELECT release_id, is_valid OR o_enabled OR o_updated_at IS NOT NULL AS has_any_summary,
    CASE WHEN NOT is_valid THEN 'missing' WHEN o_enabled THEN 'override' ELSE 'generated' END AS summary_state,
    CASE WHEN is_valid THEN s_generated_at END AS generated_at, CASE WHEN is_valid THEN CASE WHEN o_enabled THEN coalesce(o_overview, s_overview) ELSE s_overview END END AS preview,
    CASE WHEN is_valid THEN s_source_count ELSE 0 END AS source_count, CASE WHEN is_valid THEN s_review_count ELSE 0 END AS review_count,
    CASE WHEN is_valid THEN s_evidence ELSE 0 END AS evidence_count, o_enabled AS override_enabled FROM v_stored""")
def _(fx):
    return md.summary_status(summaries(fx))


@query("sco_11_aggregate_intelligence", f"""SELECT release_id, review_score, sentiment_score, {d.half_up('average_score')} AS rating_score, confidence,
    CASE WHEN overall_sentiment = 'mixed' THEN 'mixed' WHEN confidence = 'high' THEN 'strong' ELSE 'mixed' END AS agreement, coalesce(summary_alignment, 'mixed') AS source_alignment,
    CASE WHEN review_score IS NULL THEN 'Review summary will appear here as soon as approved sources are available.' ELSE
      CASE WHEN review_score >= 88 THEN 'Very strong' WHEN review_score >= 80 THEN 'Strong' WHEN review_score >= 70 THEN 'Mixed-positive' ELSE 'Mixed' END
      || ' review signal across ' || CASE WHEN source_count = 0 THEN review_count ELSE source_count END || ' indexed sources and ' || review_count || ' approved reviews.' END AS intelligence_text
    FROM (SELECT *, CASE WHEN p >= 4 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *,
      CASE WHEN review_count >= 5 THEN 2 WHEN review_count >= 3 THEN 1 ELSE 0 END + CASE WHEN source_count >= 3 THEN 2 WHEN source_count >= 2 THEN 1 ELSE 0 END
      + CASE summary_confidence WHEN 'high' THEN 1 WHEN 'low' THEN -1 ELSE 0 END AS p FROM v_card))""")
def _(fx):
    return cards(fx).select("release_id", "review_score", "sentiment_score", "rating_score", "confidence", "agreement", "source_alignment", "intelligence_text")
