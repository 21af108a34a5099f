"""Merges with their conflict rules, run planning, moderation and dashboard feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import text as t
from shelfsight.operators import catalog as cat, feeds as fd, merge as mg, metadata as md, moderation as mod, planning as pln, scoring, upsert
from shelfsight.plans import duck as d
from shelfsight.plans.registry import query
from shelfsight.sources.fixtures import RUN_AS_OF, as_of


def rid():
    return F.col("release_id")


def dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


# --- sinks -------------------------------------------------------------------------------------

@query("snk_1_insert_ignore", """SELECT run_id, url, page_id FROM (SELECT page_id % 2 AS run_id, 'u' || (page_id // 6) AS url, page_id, row_number() OVER (PARTITION BY page_id % 2, page_id // 6 ORDER BY page_id) AS rk FROM pages) b
    WHERE rk = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT page_id % 2 AS r, 'u' || (page_id // 6) AS u FROM pages WHERE page_id % 5 = 0) s WHERE s.r = b.run_id AND s.u = b.url)""")
def _(fx):
    rows = fx.page().select((F.col("page_id") % 2).alias("run_id"), F.concat(F.lit("u"), F.expr("page_id div 6").cast("string")).alias("url"), "page_id")
    return mg.insert_ignore(rows.filter("page_id % 5 = 0"), rows, ["run_id", "url"], [F.col("page_id")])


# The batches below repeat keys; the row that arrives first or last is not the smallest or largest by value.

@query("snk_2_backfill_default_variants", """SELECT release_id, variant_key, CAST(weight_oz AS DOUBLE) AS weight_oz FROM v_variant WHERE NOT (variant_key = 'default' AND release_id % 3 = 0)
    UNION ALL SELECT release_id, 'default', CAST(weight_oz + CASE WHEN release_id % 6 = 0 THEN 1 ELSE 0 END AS DOUBLE) FROM v_spec WHERE release_id % 3 = 0""")
def _(fx):
    have = fx.variant().filter(~((F.col("variant_key") == "default") & (rid() % 3 == 0)))
    legacy = fx.spec().select("release_id", F.lit("default").alias("variant_key"), F.lit("Default").alias("display_label"), F.lit("unknown").alias("audience"),
                              F.lit(True).alias("is_primary"), *cat.SPEC_FIELDS, F.lit(2).alias("seq"))
    earlier = legacy.filter(rid() % 6 == 0).withColumns({"weight_oz": (F.col("weight_oz") + 1).cast(legacy.schema["weight_oz"].dataType), "seq": F.lit(1)})
    return mg.insert_select_ignore(have, legacy.unionByName(earlier), ["release_id", "variant_key"], [F.col("seq")]).select("release_id", "variant_key", *dbl("weight_oz"))


@query("snk_3_overwrite_upsert", """SELECT coalesce(t.source_id, s.source_id) AS source_id, CASE WHEN s.source_id IS NOT NULL THEN s.source_name ELSE t.source_name END AS source_name, CASE WHEN s.source_id IS NOT NULL THEN true ELSE t.is_active END AS is_active
    FROM (SELECT source_id, source_name, source_id % 2 = 0 AS is_active FROM v_source) t FULL JOIN (SELECT s_suppkey + 50 AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE lower(s_name) END AS source_name FROM supplier) s ON s.source_id = t.source_id""")
def _(fx):
    target = fx.source().select("source_id", "source_name", (F.col("source_id") % 2 == 0).alias("is_active"))
    first = fx.source().select((F.col("source_id") + 50).alias("source_id"), F.lower("source_name").alias("source_name"), F.lit(1).alias("seq"))
    last = fx.source().filter("source_id % 3 = 0").select((F.col("source_id") + 50).alias("source_id"), F.upper("source_name").alias("source_name"), F.lit(2).alias("seq"))
    return mg.overwrite_upsert(target, first.unionByName(last), ["source_id"], [F.col("seq")], forced={"is_active": F.lit(True)})


@query("snk_4_fill_null_upsert", """WITH b AS (SELECT * FROM (SELECT release_id, 1 AS seq, CASE WHEN release_id % 4 = 0 THEN NULL ELSE CAST(9.9 AS DECIMAL(4,1)) END AS weight_oz, CAST(release_id % 3 AS INTEGER) AS drop_mm FROM v_release
      UNION ALL SELECT release_id, 2, CAST(1.1 AS DECIMAL(4,1)), 1 FROM v_release WHERE release_id % 3 = 0) WHERE coalesce(weight_oz, 0) <> 0 OR coalesce(drop_mm, 0) <> 0),
    s AS (SELECT release_id, arg_min(weight_oz, seq) FILTER (weight_oz IS NOT NULL) AS weight_oz, arg_min(drop_mm, seq) FILTER (drop_mm IS NOT NULL) AS drop_mm FROM b GROUP BY release_id)
    SELECT coalesce(t.release_id, s.release_id) AS release_id, CAST(coalesce(t.weight_oz, s.weight_oz) AS DOUBLE) AS weight_oz, coalesce(t.drop_mm, s.drop_mm) AS drop_mm
    FROM (SELECT release_id, weight_oz, drop_mm FROM v_spec WHERE release_id % 5 <> 0) t FULL JOIN s ON s.release_id = t.release_id""")
def _(fx):
    target = fx.spec().filter(rid() % 5 != 0).select("release_id", "weight_oz", "drop_mm")
    first = fx.release().select("release_id", F.when(rid() % 4 != 0, F.lit(9.9).cast("decimal(4,1)")).alias("weight_oz"), (rid() % 3).cast("int").alias("drop_mm"), F.lit(1).alias("seq"))
    later = fx.release().filter(rid() % 3 == 0).select("release_id", F.lit(1.1).cast("decimal(4,1)").alias("weight_oz"), F.lit(1).alias("drop_mm"), F.lit(2).alias("seq"))
    return mg.fill_null_upsert(target, first.unionByName(later), ["release_id"], ["weight_oz", "drop_mm"], [F.col("seq")]).select("release_id", *dbl("weight_oz"), "drop_mm")


@query("snk_5_patch_upsert", """SELECT coalesce(t.release_id, p.release_id) AS release_id, CASE WHEN p.has_fit_notes THEN nullif(trim(p.fit_notes), '') ELSE t.fit_notes END AS fit_notes, t.source_notes
    FROM (SELECT release_id, fit_notes, source_notes FROM v_spec WHERE release_id % 6 <> 0) t
    FULL JOIN (SELECT release_id, CASE WHEN release_id % 5 = 0 THEN ' A late note' WHEN release_id % 2 = 0 THEN '  ' ELSE ' New ' || release_id END AS fit_notes, release_id % 4 <> 3 OR release_id % 5 = 0 AS has_fit_notes FROM v_release) p ON p.release_id = t.release_id""")
def _(fx):
    target = fx.spec().filter(rid() % 6 != 0).select("release_id", "fit_notes", "source_notes")
    first = fx.release().select("release_id", F.when(rid() % 2 == 0, "  ").otherwise(F.concat(F.lit(" New "), rid().cast("string"))).alias("fit_notes"), (rid() % 4 != 3).alias("has_fit_notes"), F.lit(1).alias("seq"))
    late = fx.release().filter(rid() % 5 == 0).select("release_id", F.lit(" A late note").alias("fit_notes"), F.lit(True).alias("has_fit_notes"), F.lit(2).alias("seq"))
    return mg.patch_upsert(target, first.unionByName(late), ["release_id"], ["fit_notes"], [F.col("seq")])


@query("snk_6_promote_variants", """WITH inc AS (SELECT r.release_id, CASE r.release_id % 4 WHEN 0 THEN 'mens' WHEN 1 THEN 'unisex' WHEN 2 THEN 'womens' ELSE 'default' END AS variant_key, CAST(s.weight_oz - CASE WHEN r.release_id % 6 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS weight_oz
      FROM v_release r JOIN v_spec s ON s.release_id = r.release_id WHERE r.release_id % 3 = 0),
    ex AS (SELECT release_id, variant_key, CAST(weight_oz AS DOUBLE) AS weight_oz FROM v_variant WHERE NOT (release_id % 9 = 0 AND variant_key = 'default'))
    SELECT i.release_id, i.variant_key, i.weight_oz, CASE WHEN e.release_id IS NOT NULL THEN 'updated' WHEN i.variant_key IN ('mens', 'unisex') AND o.release_id IS NOT NULL THEN 'renamed' ELSE 'inserted' END AS action
    FROM inc i LEFT JOIN ex e ON e.release_id = i.release_id AND e.variant_key = i.variant_key LEFT JOIN ex o ON o.release_id = i.release_id AND o.variant_key = 'default'
    UNION ALL SELECT e.release_id, e.variant_key, e.weight_oz, 'kept' FROM ex e LEFT JOIN inc i ON i.release_id = e.release_id
    WHERE (i.release_id IS NULL OR i.variant_key <> e.variant_key) AND NOT (e.variant_key = 'default' AND i.variant_key IS NOT NULL AND i.variant_key IN ('mens', 'unisex'))""")
def _(fx):
    existing = fx.variant().filter(~((rid() % 9 == 0) & (F.col("variant_key") == "default"))).select("release_id", "variant_key", "weight_oz")
    m = rid() % 4
    first = fx.spec().filter(rid() % 3 == 0).select("release_id", F.when(m == 0, "mens").when(m == 1, "unisex").when(m == 2, "womens").otherwise("default").alias("variant_key"), "weight_oz", F.lit(1).alias("seq"))
    last = first.filter(rid() % 6 == 0).withColumns({"weight_oz": (F.col("weight_oz") - 1).cast(first.schema["weight_oz"].dataType), "seq": F.lit(2)})
    return mg.promote_variants(existing, first.unionByName(last), [F.col("seq")]).select("release_id", "variant_key", *dbl("weight_oz"), "action")


@query("snk_7_single_primary", """SELECT release_id, variant_key, row_number() OVER (PARTITION BY release_id ORDER BY (variant_key = 'womens' AND release_id % 8 = 0) DESC, is_primary DESC, variant_key) = 1 AS is_primary FROM v_variant""")
def _(fx):
    requested = (F.col("variant_key") == "womens") & (rid() % 8 == 0)
    return mg.single_primary(fx.variant(), requested).select("release_id", "variant_key", "is_primary")


@query("snk_7_delete_variants", """SELECT release_id, variant_key, row_number() OVER (PARTITION BY release_id ORDER BY is_primary DESC, variant_key) = 1 AS is_primary FROM v_variant
    WHERE variant_key <> 'default' OR release_id IN (SELECT release_id FROM v_variant GROUP BY release_id HAVING count(*) = 1)""")
def _(fx):
    doomed = fx.variant().filter("variant_key = 'default'").select("release_id", "variant_key")
    return mg.delete_variants(fx.variant(), doomed)[0].select("release_id", "variant_key", "is_primary")


@query("snk_8_shadow_specs", """SELECT s.release_id, CAST(CASE WHEN v.release_id IS NOT NULL THEN v.weight_oz ELSE s.weight_oz END AS DOUBLE) AS weight_oz FROM v_spec s LEFT JOIN v_variant v ON v.release_id = s.release_id AND v.variant_key = 'womens'""")
def _(fx):
    primary = fx.variant().withColumn("is_primary", F.col("variant_key") == "womens")
    return mg.shadow_specs(fx.spec(), primary, list(cat.SPEC_FIELDS)).select("release_id", *dbl("weight_oz"))


# Reviews of every second order share urls of their release; a stored url is unique.
_SHARED = "'https://new.example.com/r/' || release_id || '/' || (l_orderkey % 5)"
d.VIEWS["v_upsert_stored"] = f"""SELECT review_id, source_id, release_id, title, CASE WHEN shared IS NOT NULL AND row_number() OVER (PARTITION BY shared ORDER BY review_id) = 1 THEN shared ELSE 'https://r.example.com/' || review_id END AS source_url
    FROM (SELECT *, 'T' || (l_orderkey % 3) AS title, CASE WHEN l_orderkey % 2 = 0 THEN {_SHARED} END AS shared FROM v_review WHERE status = 'approved')"""
d.VIEWS["v_upsert_incoming"] = f"""SELECT review_id AS incoming_id, source_id, release_id, 'T' || (l_orderkey % 3) AS title, CASE WHEN l_orderkey % 2 = 0 THEN {_SHARED} ELSE 'https://r.example.com/' || review_id END AS source_url,
    row_number() OVER (PARTITION BY release_id ORDER BY review_id) AS step FROM v_review WHERE status = 'pending'"""


# Row after row: the table of a release is a list in order of arrival, of which each step changes or adds one row.
@query("snk_9_review_upsert_ids", """WITH RECURSIVE start AS (
      SELECT i.release_id, coalesce(any_value(s.st), []) AS st FROM v_upsert_incoming i LEFT JOIN (
        SELECT release_id, list({'id': review_id, 'made': NULL::VARCHAR, 'url': source_url, 'title': source_id || ':' || title} ORDER BY review_id) AS st FROM v_upsert_stored GROUP BY release_id) s ON s.release_id = i.release_id GROUP BY i.release_id
    ), walk AS (
      SELECT release_id, 0::BIGINT AS step, NULL::VARCHAR AS incoming_id, NULL::BIGINT AS hit, st FROM start
      UNION ALL
      SELECT release_id, step, incoming_id, hit, CASE WHEN hit IS NULL THEN list_append(st, {'id': NULL::VARCHAR, 'made': incoming_id, 'url': url, 'title': title})
        ELSE list_transform(st, lambda x, k: CASE WHEN k = hit THEN {'id': x.id, 'made': x.made, 'url': url, 'title': title} ELSE x END) END AS st
      FROM (SELECT i.release_id, i.step::BIGINT AS step, i.incoming_id, i.source_url AS url, i.source_id || ':' || i.title AS title, w.st,
          coalesce(nullif(list_position(list_transform(w.st, lambda x: x.url), i.source_url), 0), nullif(list_position(list_transform(w.st, lambda x: x.title), i.source_id || ':' || i.title), 0))::BIGINT AS hit
        FROM walk w JOIN v_upsert_incoming i ON i.release_id = w.release_id AND i.step = w.step + 1)
    )
    SELECT incoming_id, st[coalesce(hit, len(st))].id AS target_id, st[coalesce(hit, len(st))].made AS same_as, CASE WHEN hit IS NULL THEN 'insert' ELSE 'update' END AS action FROM walk WHERE step > 0""")
def _(fx):
    order = F.substring_index("review_id", "-", 1).cast("bigint")
    rows = fx.review().withColumns({"title": F.concat(F.lit("T"), (order % 3).cast("string")), "source_url": F.concat(F.lit("https://r.example.com/"), "review_id"), "slot": F.when(order % 2 == 0, order % 5)}).withColumn(
        "shared", F.concat(F.lit("https://new.example.com/r/"), rid().cast("string"), F.lit("/"), F.col("slot").cast("string")))
    columns = ("source_url", "source_id", "release_id", "title")
    incoming = rows.filter("status = 'pending'").withColumn("source_url", F.coalesce("shared", "source_url")).select(F.col("review_id").alias("incoming_id"), *columns)
    stored = rows.filter("status = 'approved'")
    first = stored.filter("shared IS NOT NULL").groupBy("release_id", "slot").agg(F.min("review_id").alias("review_id"), F.lit(True).alias("first"))  # the parts of a shared url
    stored = stored.join(first, ["release_id", "slot", "review_id"], "left").withColumn("source_url", F.when(F.col("first"), F.col("shared")).otherwise(F.col("source_url")))
    return upsert.review_upsert_ids(incoming, stored.select("review_id", *columns)).select("incoming_id", "target_id", "same_as", "action")


@query("snk_10_get_or_create_authors", """SELECT i.source_id, i.display_name, a.author_id IS NOT NULL AS existed, count(*) AS n FROM (SELECT o_custkey % 10 AS source_id, CASE WHEN o_custkey % 7 <> 0 THEN 'N' || (o_custkey % 40) END AS display_name FROM orders) i
    LEFT JOIN (SELECT DISTINCT c_custkey % 10 AS source_id, 'N' || (c_custkey % 40) AS display_name, 1 AS author_id FROM customer WHERE c_custkey % 40 < 25) a ON a.source_id = i.source_id AND a.display_name = i.display_name GROUP BY ALL""")
def _(fx):
    c, o = F.col("c_custkey"), F.col("o_custkey")
    authors = fx.table("customer").filter(c % 40 < 25).select((c % 10).alias("source_id"), F.concat(F.lit("N"), (c % 40).cast("string")).alias("display_name"), c.cast("string").alias("author_id"))
    records = fx.table("orders").select((o % 10).alias("source_id"), F.when(o % 7 != 0, F.concat(F.lit("N"), (o % 40).cast("string"))).alias("display_name"))
    joined, _created = mg.get_or_create_authors(records, authors)
    return joined.groupBy("source_id", "display_name", F.coalesce(~F.col("author_id").startswith("a-"), F.lit(False)).alias("existed")).agg(F.count("*").alias("n"))


@query("snk_11_run_ledger", """SELECT run_id, arg_max(status, seq) AS status, arg_max(stored, seq) AS stored FROM (SELECT event_id AS run_id, 0 AS seq, 'running' AS status, NULL AS stored FROM events
    UNION ALL SELECT event_id, 1, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END, event_id % 5 FROM events WHERE event_type <> 'view') GROUP BY run_id""")
def _(fx):
    k = F.col("event_id")
    opened = fx.table("events").select(k.alias("run_id"), F.lit(0).alias("seq"), F.lit("running").alias("status"), F.lit(None).cast("bigint").alias("stored"))
    closed = fx.table("events").filter("event_type <> 'view'").select(k.alias("run_id"), F.lit(1).alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), (k % 5).alias("stored"))
    return mg.latest_run_state(opened.unionByName(closed))


@query("snk_12_guarded_delete", """SELECT release_id, NOT EXISTS (SELECT 1 FROM v_review v WHERE v.release_id = r.release_id AND v.status = 'rejected') AS deletable FROM v_release r""")
def _(fx):
    free, refused = mg.guarded_delete(fx.release().select("release_id"), fx.review().filter("status = 'rejected'"), "release_id")
    return free.withColumn("deletable", F.lit(True)).unionByName(refused.withColumn("deletable", F.lit(False)))


_GONE = "SELECT release_id FROM v_release WHERE family_id LIKE 'Brand#2%' OR release_id % 97 = 0"


@query("snk_13_cascade_delete", f"""WITH gone AS ({_GONE}) SELECT 'family' AS level, count(DISTINCT family_id) FILTER (family_id NOT LIKE 'Brand#2%') AS kept, count(DISTINCT family_id) FILTER (family_id LIKE 'Brand#2%') AS gone FROM v_release
    UNION ALL SELECT 'release', count(*) - count(g.release_id), count(g.release_id) FROM v_release r LEFT JOIN gone g ON g.release_id = r.release_id
    UNION ALL SELECT 'spec', count(*) - count(g.release_id), count(g.release_id) FROM v_spec r LEFT JOIN gone g ON g.release_id = r.release_id
    UNION ALL SELECT 'variant', count(*) - count(g.release_id), count(g.release_id) FROM v_variant r LEFT JOIN gone g ON g.release_id = r.release_id
    UNION ALL SELECT 'review', count(*) FILTER (g.release_id IS NULL AND r.source_id % 41 <> 0), count(*) FILTER (g.release_id IS NOT NULL OR r.source_id % 41 = 0) FROM v_review r LEFT JOIN gone g ON g.release_id = r.release_id
    UNION ALL SELECT 'source', count(*) FILTER (source_id % 41 <> 0), count(*) FILTER (source_id % 41 = 0) FROM v_source""")
def _(fx):
    """Some families, single releases and sources go, with all that refers to them."""
    tables = {"family": (fx.release().select("family_id").distinct(), ["family_id"]), "release": (fx.release().select("release_id", "family_id"), ["release_id"]), "spec": (fx.spec().select("release_id"), ["release_id"]),
              "variant": (fx.variant().select("release_id", "variant_key"), ["release_id", "variant_key"]), "source": (fx.source().select("source_id"), ["source_id"]),
              "review": (fx.review().select("review_id", "release_id", "source_id"), ["review_id"])}
    references = [("release", "family_id", "family", "family_id"), *[(child, "release_id", "release", "release_id") for child in ("spec", "variant", "review")], ("review", "source_id", "source", "source_id")]
    doomed = {"family": tables["family"][0].filter("family_id LIKE 'Brand#2%'"), "release": tables["release"][0].filter(rid() % 97 == 0), "source": tables["source"][0].filter("source_id % 41 = 0")}
    judged = mg.cascade_delete(doomed, tables, references)
    rows = [part.select(F.lit(name).alias("level"), F.lit(k).alias("side")) for name, parts in judged.items() for k, part in enumerate(parts)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.groupBy("level").agg(F.count_if(F.col("side") == 0).alias("kept"), F.count_if(F.col("side") == 1).alias("gone"))


TRUSTED = ["importer-1", "importer-3"]


@query("snk_14_bulk_status", "SELECT CASE WHEN status = 'pending' AND importer IN ('importer-1', 'importer-3') THEN 'approved' ELSE status END AS status, count(*) AS n FROM v_review GROUP BY 1")
def _(fx):
    ids = fx.review().filter((F.col("status") == "pending") & F.col("importer").isin(*TRUSTED)).select("review_id")
    return mg.set_status(fx.review(), ids, "review_id", "approved").groupBy("status").agg(F.count("*").alias("n"))


@query("flt_15_trusted_pending", "SELECT review_id FROM v_review WHERE status = 'pending' AND importer IN ('importer-1', 'importer-3')")
def _(fx):
    documents = fx.review().withColumn("metadata", F.to_json(F.struct("importer")))
    return pln.trusted_pending(documents, TRUSTED).select("review_id")


@query("prj_12_rewrite_review_urls", """SELECT v.review_id, CASE WHEN v.source_id % 3 = 0 THEN 'https://site' || v.source_id || '.example.org/seed-reviews/' || substring(v.source_url, 9) ELSE v.source_url END AS source_url,
      strftime(coalesce(d.first_seen, v.published_at), '%Y-%m-%d') AS published_on
    FROM v_review v LEFT JOIN (SELECT release_id, source_id, min(published_at) AS first_seen FROM v_review WHERE status = 'pending' GROUP BY ALL) d ON d.release_id = v.release_id AND d.source_id = v.source_id WHERE v.status = 'approved'""")
def _(fx):
    """Dates of a release and source that are still under review, where there are any, take the place of the published reviews' own."""
    reviews = fx.review().filter("status = 'approved'").withColumn("source_url", F.when(
        F.col("source_id") % 3 == 0, F.concat(F.lit("https://placeholder.example/"), F.expr("substring(source_url, 9)"))).otherwise(F.col("source_url")))
    sites = fx.source().select("source_id", F.concat(F.lit("https://site"), F.col("source_id").cast("string"), F.lit(".example.org/")).alias("site_url"))
    dates = fx.review().filter("status = 'pending'").groupBy("release_id", "source_id").agg(F.min("published_at").alias("published_at"))
    moved = mg.rewrite_review_urls(reviews, sites, dates, "https://placeholder.example/")
    return moved.select("review_id", "source_url", F.date_format("published_at", "yyyy-MM-dd").alias("published_on"))


@query("prj_13_expand_variants", """SELECT release_id, CASE WHEN release_id % 10 = 0 THEN 'unisex' WHEN release_id % 3 = 0 THEN 'mens' ELSE 'default' END AS variant_key, CASE WHEN release_id % 10 = 0 THEN 'Maker' END AS source_label FROM v_spec
    UNION ALL SELECT release_id, 'womens', NULL FROM v_spec WHERE release_id % 4 = 0""")
def _(fx):
    base = fx.spec().select("release_id", F.lit("default").alias("variant_key"), F.lit("Default").alias("display_label"), F.lit("unknown").alias("audience"), F.lit(True).alias("is_primary"), F.lit(None).cast("string").alias("source_label"))
    unisex = fx.release().filter(rid() % 10 == 0).select("release_id", F.lit("Maker").alias("source_label"))
    womens = fx.spec().filter(rid() % 4 == 0).select("release_id", F.lit("womens").alias("variant_key"), F.lit("Women").alias("display_label"), F.lit("womens").alias("audience"), F.lit(False).alias("is_primary"))
    return mg.expand_variants(base, unisex, fx.release().filter(rid() % 3 == 0), womens).select("release_id", "variant_key", "source_label")


# --- coverage and planning -----------------------------------------------------------------------

_SRCNAMES = "string_agg(DISTINCT CASE WHEN v.status = 'approved' THEN s.source_name END, '|' ORDER BY CASE WHEN v.status = 'approved' THEN s.source_name END)"
d.VIEWS["v_cov"] = """SELECT v.release_id, count(*) FILTER (v.status = 'approved') AS approved_count, count(*) FILTER (v.status = 'approved' AND s.source_type = 'editorial') AS editorial_count,
    count(*) FILTER (v.status = 'approved' AND s.source_type = 'reddit') AS reddit_count, count(*) FILTER (v.status = 'approved' AND s.source_type = 'user') AS user_count, count(*) FILTER (v.status = 'pending') AS pending_count,
    count(DISTINCT v.source_id) FILTER (v.status = 'approved') AS source_count, coalesce(list_sort(list(DISTINCT s.source_name) FILTER (v.status = 'approved')), []) AS source_names,
    coalesce(list(DISTINCT v.source_id) FILTER (v.status = 'approved'), []) AS approved_sources, coalesce(list(DISTINCT v.source_id) FILTER (v.status = 'pending'), []) AS pending_sources
    FROM v_review v JOIN v_source s ON s.source_id = v.source_id GROUP BY v.release_id"""


@query("agg_3_coverage_rollup", "SELECT release_id, approved_count, editorial_count, reddit_count, user_count, pending_count, source_count, array_to_string(source_names, '|') AS source_names FROM v_cov")
def _(fx):
    return pln.coverage_rollup(fx.review(), fx.source()).select("release_id", *pln.COUNT_COLUMNS, F.array_join("source_names", "|").alias("source_names"))


_SHOWN = "(SELECT release_id FROM v_release WHERE is_current UNION SELECT release_id FROM (SELECT release_id FROM v_release ORDER BY release_year DESC NULLS FIRST, family, release_id LIMIT 20))"


@query("jn_10_current_and_recent", f"SELECT release_id FROM {_SHOWN}")
def _(fx):
    return pln.current_and_recent(fx.release())


_STATUS = "CASE WHEN a = 0 THEN 'thin' WHEN e = 0 THEN 'missing-editorial' WHEN c = 0 THEN 'missing-community' WHEN a >= 3 THEN 'healthy' ELSE 'thin' END"
_BOARD = f"""SELECT r.release_id, r.family || ' ' || r.version_name AS label, coalesce(v.approved_count, 0) AS a, coalesce(v.editorial_count, 0) AS e, coalesce(v.reddit_count, 0) AS c, coalesce(v.approved_sources, []) AS have
    FROM v_release r JOIN {_SHOWN} x ON x.release_id = r.release_id LEFT JOIN v_cov v ON v.release_id = r.release_id"""


def board(fx):
    return pln.coverage_board(fx.release(), fx.review(), fx.source(), fx.crawl_source())


@query("jn_7_missing_sources", f"""SELECT release_id, coalesce((SELECT string_agg(s.source_name, '|' ORDER BY s.source_name) FROM v_crawl_source k JOIN v_source s ON s.source_id = k.source_id WHERE k.is_active AND NOT list_contains(have, k.source_id)), '') AS missing FROM ({_BOARD})""")
def _(fx):
    return board(fx).select("release_id", F.array_join(F.transform("missing", lambda s: s["source_name"]), "|").alias("missing"))


@query("srt_10_coverage_board", f"""SELECT release_id, status, row_number() OVER (ORDER BY CASE status WHEN 'missing-editorial' THEN 0 WHEN 'missing-community' THEN 1 WHEN 'thin' THEN 2 ELSE 3 END, label, release_id) AS position
    FROM (SELECT *, {_STATUS} AS status FROM ({_BOARD}))""")
def _(fx):
    from shelfsight.operators.ordering import positioned
    order = [scoring.coverage_severity(F.col("coverage_status")), F.col("label"), F.col("release_id")]
    return positioned(board(fx).select("release_id", "label", "coverage_status").orderBy(*order).select("release_id", F.col("coverage_status").alias("status")))


@query("src_7_newest_runs", "SELECT crawl_source_id, run_id, CAST(rk AS INTEGER) AS run_rank FROM (SELECT *, row_number() OVER (PARTITION BY crawl_source_id ORDER BY created_at DESC, run_id DESC) AS rk FROM v_run) WHERE rk <= 120")
def _(fx):
    return pln.newest_runs(fx.run(), pln.RUN_LOOKBACK).select("crawl_source_id", "run_id", "run_rank")


_LATEST = "SELECT crawl_source_id, arg_max(run_id, created_at) AS last_run_id, arg_max(status, created_at) AS last_status, max(created_at) AS last_run_at FROM v_run GROUP BY crawl_source_id"


@query("jn_13_latest_run", f"SELECT k.crawl_source_id, k.importer_key, last_run_id, last_status FROM v_crawl_source k LEFT JOIN ({_LATEST}) r ON r.crawl_source_id = k.crawl_source_id")
def _(fx):
    return fx.crawl_source().join(pln.latest_run(fx.run()), "crawl_source_id", "left").select("crawl_source_id", "importer_key", "last_run_id", "last_status")


_PER_RELEASE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_source_id, release_id ORDER BY rk) AS rr FROM (
    SELECT *, row_number() OVER (PARTITION BY crawl_source_id ORDER BY created_at DESC, run_id DESC) AS rk FROM v_run) WHERE rk <= 120) WHERE rr = 1"""


@query("win_5_latest_run_per_release", f"SELECT crawl_source_id, release_id, run_id, status FROM ({_PER_RELEASE})")
def _(fx):
    return pln.latest_run_per_release(fx.run()).select("crawl_source_id", "release_id", "run_id", "status")


@query("pln_3_backoff", f"""SELECT crawl_source_id, release_id, CASE WHEN status = 'failed' AND age < 86400000000 THEN 'recent failed run backoff' WHEN status = 'partial' AND age < 21600000000 THEN 'recent partial run backoff'
    WHEN status = 'running' THEN 'run already in progress' END AS reason FROM (SELECT *, epoch_us({d.RUN_NOW}) - epoch_us(created_at) AS age FROM ({_PER_RELEASE}))""")
def _(fx):
    return pln.latest_run_per_release(fx.run()).select("crawl_source_id", "release_id", pln.backoff_reason(F.col("status"), F.col("created_at"), as_of(RUN_AS_OF)).alias("reason"))


_CAD = "CASE WHEN lower(trim(cadence_label)) IN ('manual', 'hourly', 'daily', 'weekly') THEN lower(trim(cadence_label)) ELSE 'manual' END"
_DUE = f"""SELECT *, CASE WHEN NOT is_active THEN 'inactive' WHEN cadence = 'manual' THEN 'manual cadence' WHEN last_run_at IS NULL THEN 'never run' WHEN {d.RUN_NOW} >= next_run THEN 'due now' ELSE 'not due' END AS due_reason FROM (
    SELECT k.*, {_CAD} AS cadence, r.last_run_at, r.last_status, CASE WHEN is_active THEN r.last_run_at + CASE {_CAD} WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'daily' THEN INTERVAL 24 HOUR WHEN 'weekly' THEN INTERVAL 168 HOUR END END AS next_run
    FROM v_crawl_source k LEFT JOIN ({_LATEST}) r ON r.crawl_source_id = k.crawl_source_id)"""


@query("pln_1_source_due", f"SELECT crawl_source_id, cadence, due_reason, due_reason IN ('never run', 'due now') AS is_due, {d.iso_ts('next_run')} AS next_run FROM ({_DUE})")
def _(fx):
    due = pln.source_due(fx.crawl_source(), fx.run(), as_of(RUN_AS_OF))
    return due.select("crawl_source_id", "cadence", "due_reason", "is_due", F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("dat_4_next_run", """SELECT run_id, strftime(created_at + CASE run_id % 4 WHEN 0 THEN INTERVAL 1 HOUR WHEN 1 THEN INTERVAL 24 HOUR WHEN 2 THEN INTERVAL 168 HOUR END, '%Y-%m-%d %H:%M:%S') AS next_run FROM v_run""")
def _(fx):
    k = F.col("run_id") % 4
    label = F.when(k == 0, "hourly").when(k == 1, " DAILY").when(k == 2, "weekly").otherwise("twice-daily")
    return fx.run().select("run_id", F.date_format(pln.next_run_at(pln.cadence(label), F.col("created_at")), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


_PRIORITY = """CASE WHEN a = 0 THEN 100 ELSE 0 END + CASE WHEN e = 0 THEN 40 ELSE 0 END + CASE WHEN c = 0 THEN 35 ELSE 0 END + CASE WHEN NOT list_contains(have, k.source_id) THEN 45 ELSE 0 END
    + CASE WHEN n < 2 THEN 20 WHEN n < 3 THEN 10 ELSE 0 END + CASE WHEN a < 3 THEN 20 ELSE 0 END - CASE WHEN list_contains(wait, k.source_id) THEN 10 ELSE 0 END - p * 5"""
_RANKED = f"""SELECT k.crawl_source_id, r.release_id, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY k.crawl_source_id ORDER BY {_PRIORITY} DESC, release_year DESC NULLS FIRST, r.release_id) AS slot
    FROM (SELECT n.release_id, release_year, coalesce(approved_count, 0) AS a, coalesce(editorial_count, 0) AS e, coalesce(reddit_count, 0) AS c, coalesce(pending_count, 0) AS p, coalesce(source_count, 0) AS n, coalesce(approved_sources, []) AS have,
      coalesce(pending_sources, []) AS wait FROM (SELECT release_id, release_year FROM v_release WHERE is_current ORDER BY release_year DESC NULLS FIRST, release_id LIMIT 12) n LEFT JOIN v_cov v ON v.release_id = n.release_id) r
    CROSS JOIN {{sources}} k QUALIFY slot <= 6"""


@query("pln_2_gap_ranking", "SELECT crawl_source_id, release_id, CAST(priority AS BIGINT) AS priority, CAST(slot AS INTEGER) AS slot FROM (" + _RANKED.format(sources="v_crawl_source") + ")")
def _(fx):
    return pln.gap_ranking(fx.release(), fx.review(), fx.source(), fx.crawl_source()).select("crawl_source_id", "release_id", F.col("priority").cast("bigint").alias("priority"), "slot")


_PLAN_REASON = f"""CASE WHEN status = 'failed' AND epoch_us({d.RUN_NOW}) - epoch_us(created_at) < 86400000000 THEN 'recent failed run backoff'
    WHEN status = 'partial' AND epoch_us({d.RUN_NOW}) - epoch_us(created_at) < 21600000000 THEN 'recent partial run backoff' WHEN status = 'running' THEN 'run already in progress' END"""


@query("pln_4_work_plan", f"""SELECT crawl_source_id, CAST(NULL AS BIGINT) AS release_id, CAST(NULL AS INTEGER) AS slot, 'skip-source' AS action, due_reason AS reason FROM ({_DUE}) WHERE due_reason NOT IN ('never run', 'due now')
    UNION ALL SELECT x.crawl_source_id, x.release_id, CAST(slot AS INTEGER), CASE WHEN {_PLAN_REASON} IS NULL THEN 'run' ELSE 'skip-release' END, {_PLAN_REASON}
    FROM ({_RANKED.format(sources=f"(SELECT * FROM ({_DUE}) WHERE due_reason IN ('never run', 'due now'))")}) x LEFT JOIN ({_PER_RELEASE}) l ON l.crawl_source_id = x.crawl_source_id AND l.release_id = x.release_id""")
def _(fx):
    return pln.work_plan(fx.release(), fx.review(), fx.source(), fx.crawl_source(), fx.run(), as_of(RUN_AS_OF))


@query("pln_5_backfill_plan", """SELECT release_id, before, approvable, before + approvable AS after, approvable > 0 AS improved, before + approvable < 2 AS remaining FROM (
    SELECT r.release_id, count(v.review_id) FILTER (v.status = 'approved') AS before, count(v.review_id) FILTER (v.status = 'pending' AND v.importer IN ('importer-1', 'importer-3')) AS approvable
    FROM v_release r LEFT JOIN v_review v ON v.release_id = r.release_id GROUP BY r.release_id) WHERE before < 2""")
def _(fx):
    return pln.backfill_plan(fx.release(), fx.review(), TRUSTED)


@query("agg_14_backfill_counters", """SELECT count(*) AS processed, count(*) FILTER (approvable > 0) AS improved, count(*) FILTER (before + approvable < 2) AS remaining, CAST(coalesce(sum(approvable), 0) AS BIGINT) AS approved_pending FROM (
    SELECT r.release_id, count(v.review_id) FILTER (v.status = 'approved') AS before, count(v.review_id) FILTER (v.status = 'pending' AND v.importer IN ('importer-1', 'importer-3')) AS approvable
    FROM v_release r LEFT JOIN v_review v ON v.release_id = r.release_id GROUP BY r.release_id) WHERE before < 2""")
def _(fx):
    return pln.outcome_counters(pln.backfill_plan(fx.release(), fx.review(), TRUSTED))


@query("srt_11_under_covered_order", """SELECT release_id, row_number() OVER (ORDER BY release_year DESC NULLS LAST, family_id, version_name, release_id) AS position FROM v_release r LEFT JOIN v_stats s USING (release_id) WHERE coalesce(s.review_count, 0) < 2""")
def _(fx):
    from shelfsight.operators.ordering import positioned
    order = [F.col("release_year").desc_nulls_last(), F.col("family_id"), F.col("version_name"), F.col("release_id")]
    return positioned(pln.under_covered(fx.release(), fx.review()).orderBy(*order).select("release_id"))


@query("ing_7_run_status", """SELECT run_id, CASE WHEN f = 0 THEN 'succeeded' WHEN s = 0 OR b > 0 THEN 'partial' ELSE 'succeeded' END AS with_fallback, CASE WHEN f = 0 THEN 'succeeded' WHEN s = 0 THEN 'partial' ELSE 'succeeded' END AS simple
    FROM (SELECT run_id, value % 3 AS f, value % 2 AS s, run_id % 4 AS b FROM v_run)""")
def _(fx):
    v = F.col("value")
    return fx.run().select("run_id", pln.run_status(v % 3, v % 2, F.col("run_id") % 4).alias("with_fallback"), pln.run_status(v % 3, v % 2).alias("simple"))


@query("ing_8_run_metrics", """SELECT run_id, release_id, d AS discovered, s AS stored, f AS fallback, avg_c AS average_confidence, max_c AS max_confidence, CASE WHEN d = 0 THEN 'succeeded' WHEN s = 0 OR f > 0 THEN 'partial' ELSE 'succeeded' END AS status,
    CASE WHEN d = 0 THEN 'nothing found' END AS no_hit_reason FROM (SELECT l_orderkey AS run_id, l_partkey AS release_id, count(*) FILTER (c IS NOT NULL) AS d, count(*) FILTER (c IS NOT NULL AND l_linenumber > 2) AS s,
      count(*) FILTER (c IS NOT NULL AND l_linenumber = 5) AS f, floor(avg(c) + 0.5) / 100.0::DOUBLE AS avg_c, max(c) / 100.0::DOUBLE AS max_c
      FROM (SELECT *, CASE WHEN l_tax > 0 THEN CAST(l_quantity AS INTEGER) + 40 END AS c FROM lineitem) GROUP BY 1, 2)""")
def _(fx):
    c = F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("int") + 40)
    rows = fx.table("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("release_id"), c.alias("confidence_e2"),
                                       (F.col("l_linenumber") > 2).alias("is_stored"), (F.col("l_linenumber") == 5).alias("used_fallback"))
    return pln.run_metrics(rows, "nothing found")


@query("agg_2_global_counts", """SELECT (SELECT count(DISTINCT brand) FROM v_release) AS brands, (SELECT count(*) FROM v_family) AS families, (SELECT count(*) FROM v_source) AS sources, count(*) AS reviews, count(*) FILTER (status = 'pending') AS pending FROM v_review""")
def _(fx):
    return fd.global_counts(fx.release().select("brand").distinct(), fx.family(), fx.source(), fx.review())


# --- moderation and feeds ---------------------------------------------------------------------------

_EV = """SELECT v.review_id, e.event_id AS seq, CASE WHEN e.event_type = 'click' THEN 'status' ELSE 'override' END AS kind, CASE WHEN e.value > 50 THEN 'approved' ELSE 'rejected' END AS status,
      CASE e.event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'positive' WHEN 2 THEN 'mixed' ELSE 'negative' END AS sentiment, CASE e.event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Fit, Ride,, Value' ELSE ' a,b,c,d,e' END AS highlights_text,
      CASE WHEN e.event_id % 14 = 0 THEN v.review_id WHEN e.event_id % 7 = 0 THEN 'dup-1' ELSE '' END AS dup FROM v_review v JOIN events e ON e.event_id % 5000 = v.l_orderkey"""


def moderation_events(fx):
    k = F.col("event_id")
    reviews = fx.review().select("review_id", F.split("review_id", "-")[0].cast("bigint").alias("order_key"))
    events = fx.table("events").withColumn("order_key", k % 5000)
    return reviews.join(events, "order_key").select(
        "review_id", k.alias("seq"), F.when(F.col("event_type") == "click", "status").otherwise("override").alias("kind"), F.when(F.col("value") > 50, "approved").otherwise("rejected").alias("status"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "positive").when(k % 4 == 2, "mixed").otherwise("negative").alias("sentiment"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "Fit, Ride,, Value").otherwise(" a,b,c,d,e").alias("highlights_text"),
        F.when(k % 14 == 0, F.col("review_id")).when(k % 7 == 0, "dup-1").otherwise("").alias("duplicate_of"))


@query("edt_4_apply_moderation", f"""SELECT v.review_id, coalesce(new_status, v.status) AS status, CASE WHEN o IS NOT NULL THEN nullif(o.s, '') ELSE v.sentiment END AS sentiment,
    CASE WHEN o IS NOT NULL THEN CASE o.h WHEN '' THEN '' WHEN ' a,b,c,d,e' THEN 'a|b|c|d' ELSE 'Fit|Ride|Value' END ELSE array_to_string(v.highlights, '|') END AS highlights, o.d AS duplicate_of, coalesce(n, 0) AS override_count
    FROM v_review v LEFT JOIN (SELECT review_id, arg_max({{'s': sentiment, 'h': highlights_text, 'd': nullif(nullif(dup, ''), review_id)}}, seq) FILTER (kind = 'override') AS o, count(*) FILTER (kind = 'override') AS n,
      arg_max(CASE WHEN kind = 'status' THEN status ELSE 'flagged' END, seq) FILTER (kind = 'status' OR (dup <> '' AND dup <> review_id)) AS new_status FROM ({_EV}) GROUP BY review_id) e ON e.review_id = v.review_id""")
def _(fx):
    done = mod.apply_moderation(fx.review(), moderation_events(fx))
    return done.select("review_id", "status", "sentiment", F.array_join("highlights", "|").alias("highlights"), "duplicate_of", "override_count")


@query("edt_7_manual_intake", """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'release_key' END, CASE WHEN doc_id % 7 = 0 THEN 'source_key' END) AS missing, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 101 AS INTEGER) END AS score FROM documents""")
def _(fx):
    k = F.col("doc_id")
    rows = fx.table("documents").select(
        "doc_id", F.when(k % 5 != 0, k.cast("string")).otherwise("  ").alias("release_key"), F.when(k % 7 != 0, "s").alias("source_key"), F.lit(" u ").alias("source_url"), F.lit("").alias("author_name"),
        F.lit(None).cast("string").alias("title"), F.lit(" e ").alias("excerpt"), F.lit("mixed").alias("sentiment"), F.when(k % 3 != 0, (k % 101).cast("string")).otherwise("n/a").alias("score_text"))
    accepted, refused = mod.manual_intake(rows)
    both = accepted.withColumn("missing", F.lit("")).select("doc_id", "missing", "score").unionByName(
        refused.select("doc_id", F.regexp_replace("error", "^missing ", "").alias("missing"), "score"))
    return both


def run_documents(fx):
    k = F.col("run_id")
    doc = F.concat(F.lit('{"averageCandidateConfidence":'), F.when(k % 3 == 0, '"x"').otherwise("0.5"), F.lit(',"fallbackCount":'), (k % 4).cast("string"), F.lit(',"failureStage":'), F.when(k % 2 == 0, '"fetch"').otherwise("null"), F.lit("}"))
    return fx.run().withColumn("metadata", doc)


@query("edt_6_run_feed", """SELECT run_id, CASE WHEN run_id % 3 <> 0 THEN 0.5::DOUBLE END AS average_confidence, CAST(run_id % 4 AS DOUBLE) AS fallback_count, CASE WHEN run_id % 2 = 0 THEN 'fetch' END AS failure_stage, status FROM v_run ORDER BY created_at DESC, run_id DESC LIMIT 20""")
def _(fx):
    newest = fd.recent(run_documents(fx), [F.col("created_at").desc(), F.col("run_id").desc()], fd.RECENT_RUNS)
    return fd.run_feed(newest).select("run_id", "average_confidence", "fallback_count", "failure_stage", "status")


_FEED50 = "SELECT review_id, release_id, source_id FROM v_review ORDER BY published_at DESC NULLS FIRST, release_id, review_id LIMIT 50"


@query("jn_11_duplicate_candidates", f"SELECT a.review_id, b.review_id AS candidate_id FROM ({_FEED50}) a JOIN ({_FEED50}) b ON a.release_id = b.release_id AND a.review_id <> b.review_id")
def _(fx):
    newest = fd.recent(fx.review(), [F.col("published_at").desc_nulls_first(), rid(), F.col("review_id")], fd.RECENT_REVIEWS)
    return fd.duplicate_candidates(newest.withColumns({"title": F.lit(None).cast("string"), "source_name": F.col("source_id").cast("string")})).select("review_id", "candidate_id")


_HIST = """SELECT 'review ' || (event_id % 9) AS label, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'override' AS event FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'release ' || (event_id % 5), strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'generated' FROM events WHERE event_type = 'view'"""


@query("set_3_labelled_histories", f"SELECT * FROM ({_HIST}) ORDER BY timestamp DESC, label, event LIMIT 12")
def _(fx):
    def part(kind: str, label: str, mod_by: int, event: str):
        return fx.table("events").filter(F.col("event_type") == kind).select(
            F.concat(F.lit(label + " "), (F.col("event_id") % mod_by).cast("string")).alias("label"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(event).alias("event"))

    return fd.labelled_histories([part("click", "review", 9, "override"), part("view", "release", 5, "generated")])


@query("win_7_bounded_history", """SELECT user_id, CAST(least(count(*), 20) AS INTEGER) AS kept, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id DESC) FILTER (rk <= 20) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) GROUP BY user_id""")
def _(fx):
    from pyspark.sql import Window
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    newest = fx.table("events").select("user_id", "ts", "event_id").withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= md.HISTORY_LIMIT)
    return newest.groupBy("user_id").agg(F.count("*").cast("int").alias("kept"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rk", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("newest"))
