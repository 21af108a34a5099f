"""Matching, near-duplicate titles, extraction and thread assembly over the document, page and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import lexicons as lx, text as t
from shelfsight.operators import dedupe as dd, extract as ex, matching as mt, planning as pln
from shelfsight.plans import duck as d
from shelfsight.plans.registry import query
from shelfsight.plans.text_queries import PROSE_NEGATIVE, PROSE_PATTERNS, PROSE_POSITIVE
from shelfsight.sources import captures

# --- text x release matching: brands and aliases are words of the texts themselves ----------

d.VIEWS["v_hay"] = f"SELECT doc_id, {d.norm('text')} AS haystack FROM documents"
d.VIEWS["v_entity"] = """SELECT r.release_id AS entity_id, w[1] AS brand, array_to_string(CASE WHEN r.release_id % 50 = 0 THEN w[3:3] WHEN r.release_id % 50 = 1 THEN w[2:3] ELSE w[2:4] END, ' ') AS alias
    FROM v_release r JOIN (SELECT doc_id, string_split(haystack, ' ') AS w FROM v_hay) h ON h.doc_id = r.release_id % (SELECT count(*) FROM documents) WHERE len(w) >= 4"""


def haystacks(fx):
    texts = fx.spread(fx.table("documents").select("doc_id", "text"), "doc_id")
    return texts.select("doc_id", t.normalize_search_text(F.col("text")).alias("haystack"))


def entities(fx):
    # Words are runs of letters or of digits: the first four are found before the rest of a text is normalised.
    head = F.regexp_extract(F.lower("text"), "^(?:[^a-z0-9]*+(?:[a-z]++|[0-9]++)){4}", 0)
    words = fx.table("documents").select("doc_id", F.split(t.normalize_search_text(head), " ").alias("w")).filter(F.size("w") >= 4)
    slots = fx.release().select("release_id", (F.col("release_id") % fx.document_count()).alias("doc_id"))
    k = F.col("release_id") % 50
    alias = F.when(k == 0, F.slice("w", 3, 1)).when(k == 1, F.slice("w", 2, 2)).otherwise(F.slice("w", 2, 3))
    return slots.join(words, "doc_id").select(F.col("release_id").alias("entity_id"), F.get("w", F.lit(0)).alias("brand"), F.array(F.array_join(alias, " ")).alias("aliases"))


@query("jn_8_match_documents", "SELECT h.doc_id, e.entity_id FROM v_hay h JOIN v_entity e ON contains(h.haystack, e.brand) AND contains(h.haystack, e.alias)")
def _(fx):
    return mt.match_documents(haystacks(fx), entities(fx))


@query("flt_9_page_candidates", f"""SELECT page_id, CASE WHEN {d.contains_any('n', lx.NON_REVIEW_SLUG_TOKENS + ('ref x', 'top'))} THEN 'non-review' WHEN contains(url, '/en/') AND contains(n, 'example') AND contains(n, 'http') THEN 'candidate' ELSE 'other' END AS kind
    FROM (SELECT page_id, url, {d.norm('url')} AS n FROM pages)""")
def _(fx):
    hay = t.normalize_search_text(F.col("url"))
    tokens = lx.NON_REVIEW_SLUG_TOKENS + ("ref x", "top")
    named = mt.mentions(F.col("n"), F.lit("example"), F.array(F.lit("http")))
    return fx.page().withColumn("n", hay).select("page_id", F.when(mt.is_non_review(F.col("url"), tokens), "non-review").when(
        F.col("url").contains("/en/") & named, "candidate").otherwise("other").alias("kind"))


@query("srt_9_page_candidate_caps", f"""SELECT release_id, page_id, CAST(rank AS INTEGER) AS rank FROM (SELECT e.release_id, p.page_id, row_number() OVER (PARTITION BY e.release_id ORDER BY p.page_id, p.url) AS rank
    FROM (SELECT DISTINCT lang AS release_id FROM documents) e JOIN (SELECT page_id, url, {d.norm('url')} AS n FROM pages) p ON contains(p.n, ' ' || e.release_id || ' ') AND contains(p.url, '/' || e.release_id || '/')
    WHERE NOT {d.contains_any('n', lx.NON_REVIEW_SLUG_TOKENS)}) WHERE rank <= 10""")
def _(fx):
    langs = fx.table("documents").select(F.col("lang").alias("release_id")).distinct()
    pages = fx.page().select("url", "page_id", F.col("page_id").alias("position"), t.normalize_search_text(F.col("url")).alias("haystack")).withColumn(
        "release_id", F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1))
    pairs = pages.join(langs, "release_id").withColumns({"brand": F.lit("http"), "aliases": F.array(F.concat(F.lit(" "), "release_id", F.lit(" ")))})
    return mt.page_candidates(pairs, "/").select("release_id", "page_id", "rank")


_DEAL = lx.DEAL_TOKENS
_THREAD = f"""SELECT conv_id, turn, {d.norm('string_split(text, chr(10))[1]')} AS title, {d.norm('text')} AS body, length(text) % 12 AS comments FROM conversations"""


@query("flt_10_thread_candidates", f"""SELECT conv_id, turn, (contains(title, 'an') OR contains(body, 'an')) AND (contains(title, 'the') OR contains(body, 'the')) AND NOT {d.contains_any('title', _DEAL)}
    AND (contains(trim(title || ' ' || body), 'the an') OR {d.contains_any("trim(title || ' ' || body)", ('onen', 'reat'))} OR length(body) >= 120 OR comments >= 8) AS is_candidate FROM ({_THREAD})""")
def _(fx):
    rows = fx.table("conversations").select("conv_id", "turn", t.normalize_search_text(F.regexp_extract("text", "^([^\n]*)", 1)).alias("title"),
                                            t.normalize_search_text(F.col("text")).alias("body"), (F.length("text") % 12).alias("comments"))
    rule = mt.is_thread_candidate(F.col("title"), F.col("body"), F.col("comments"), F.lit("the"), F.array(F.lit("an")), F.lit("the an"), ("onen", "reat"))
    return rows.select("conv_id", "turn", rule.alias("is_candidate"))


_ANCHOR = r"""SELECT page_id, unnest(regexp_extract_all(v, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1)) AS href,
    unnest(regexp_extract_all(v, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 2)) AS inner_html,
    generate_subscripts(regexp_extract_all(v, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1), 1) - 1 AS position
    FROM (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') AS v FROM pages)"""


@query("ext_10_anchors", f"SELECT page_id, position, href, {d.clean('inner_html')} AS title FROM ({_ANCHOR})")
def _(fx):
    return ex.anchors(fx.page()).select("page_id", F.col("position").cast("bigint").alias("position"), "href", "title")


_LINK_TITLE = f"""(SELECT page_id, position, href, 'https://www.site.example.com' || href AS url, {d.clean('inner_html')} AS title FROM ({_ANCHOR}) WHERE starts_with(href, '/'))"""
_LINK_BLOCKED = tuple(w.replace("-", " ") for w in lx.NON_REVIEW_LINK_TOKENS)


# A page's search: its site, and as aliases the title of one of its own anchors and a letter that many have.
@query("flt_11_link_candidates", f"""SELECT page_id, href, CAST(rank AS INTEGER) AS rank, least(100, 66 + CASE WHEN contains(h, alias) THEN 14 ELSE 0 END + CASE WHEN contains(h, 'th') THEN 8 ELSE 0 END + CASE WHEN contains(h, 'site example') THEN 4 ELSE 0 END) / 100.0::DOUBLE AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS rank FROM (
      SELECT l.page_id, l.position, l.href, a.alias, {d.norm("l.title || ' ' || l.url")} AS h FROM (
        SELECT page_id, href, url, min(position) AS position, arg_min(title, position) AS title FROM {_LINK_TITLE} WHERE title <> '' AND NOT contains(url, '/search?') GROUP BY ALL) l
      JOIN (SELECT page_id, any_value({d.norm('title')}) AS alias FROM {_LINK_TITLE} WHERE position = page_id % 6 GROUP BY page_id) a ON a.page_id = l.page_id)
      WHERE contains(h, 'site') AND (contains(h, alias) OR contains(h, 'n')) AND NOT {d.contains_any('h', _LINK_BLOCKED)}) WHERE rank <= 5""")
def _(fx):
    links = ex.anchors(fx.page())
    own = links.filter(F.col("position") == F.col("page_id") % 6).select("page_id", t.normalize_search_text(F.col("title")).alias("query"))
    searches = own.select("page_id", F.lit("site").alias("brand"), F.array("query", F.lit("n")).alias("aliases"), "query")
    found = mt.ranked_links(links, searches, "https://www.site.example.com", "site.example.com", review_words=("th",), domain_words="site example")
    return found.select("page_id", "href", "rank", t.clamp_confidence(F.col("confidence_points")).alias("confidence"))


@query("flt_12_ui_chrome", f"""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda p: {d.contains_any('lower(p)', ('the', 'und '))})) AS INTEGER) AS chrome,
    CAST(len(list_filter(string_split(text, chr(10)), lambda p: {d.contains_any('lower(p)', lx.PAGE_CHROME_TOKENS)})) AS INTEGER) AS default_chrome FROM documents""")
def _(fx):
    lines = F.split("text", "\n")
    return fx.table("documents").select("doc_id", F.size(F.filter(lines, lambda p: mt.is_ui_chrome(p, ("the", "und ")))).alias("chrome"),
                                        F.size(F.filter(lines, lambda p: mt.is_ui_chrome(p))).alias("default_chrome"))


@query("flt_13_generic_title", f"""SELECT page_id, CASE WHEN n IN ('the site') OR starts_with(n, 'the') OR length(n) < 6 THEN CASE WHEN s <> '' THEN {d.clean("replace(s, '-', ' ')")} ELSE url END ELSE title END AS title FROM (
    SELECT page_id, url, title, {d.norm('title')} AS n, string_split(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '\\.html$', ''), '/$', ''), '/')[-1] AS s
    FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages))""")
def _(fx):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    generic = mt.is_generic_title(F.col("title"), ("the site",), ("the",))
    return fx.page().withColumn("title", title).select("page_id", F.when(generic, t.humanize_url_slug(F.col("url"))).otherwise(F.col("title")).alias("title"))


# --- confidence ------------------------------------------------------------------------------

@query("ing_1_sitemap_confidence", f"""SELECT page_id, least(100, 50 + CASE WHEN contains(h, 'example') THEN 15 ELSE 0 END + CASE WHEN contains(h, 'en') THEN 20 ELSE 0 END + CASE WHEN contains(h, 'example com en') THEN 10 ELSE 0 END
    + CASE WHEN contains(url, '/en/') THEN 5 ELSE 0 END) / 100.0::DOUBLE AS confidence FROM (SELECT page_id, url, {d.norm('url')} AS h FROM pages)""")
def _(fx):
    rows = fx.page().select("page_id", "url", t.normalize_search_text(F.col("url")).alias("h"))
    points = mt.sitemap_confidence(F.col("h"), F.col("url"), F.lit("example"), F.lit("en"), F.lit("example com en"), "/en/")
    return rows.select("page_id", t.clamp_confidence(points).alias("confidence"))


@query("ing_2_link_confidence", f"""SELECT page_id, least(100, 66 + CASE WHEN contains(h, 'example com en') THEN 14 ELSE 0 END + CASE WHEN contains(h, 'page') THEN 8 ELSE 0 END + CASE WHEN contains(h, 'example net') THEN 4 ELSE 0 END) / 100.0::DOUBLE AS confidence
    FROM (SELECT page_id, {d.norm('url')} AS h FROM pages)""")
def _(fx):
    rows = fx.page().select("page_id", t.normalize_search_text(F.col("url")).alias("h"))
    return rows.select("page_id", t.clamp_confidence(mt.link_confidence(F.col("h"), F.lit("example com en"), ("page",), "example net")).alias("confidence"))


@query("ing_3_thread_confidence", f"""SELECT conv_id, turn, (45 + CASE WHEN {d.contains_any('title', ('onen', 'reat'))} THEN 20 ELSE 0 END + CASE WHEN length(body) >= 150 THEN 10 ELSE 0 END
    + CASE WHEN comments >= 10 THEN 10 ELSE 0 END + CASE WHEN turn >= 4 THEN 5 ELSE 0 END) / 100.0::DOUBLE AS confidence FROM (SELECT *, 0 AS z FROM ({_THREAD}))""")
def _(fx):
    score = F.when(F.col("turn") >= 4, 15).otherwise(3)
    points = mt.thread_confidence(F.regexp_extract("text", "^([^\n]*)", 1), F.col("text"), F.length("text") % 12, score, ("onen", "reat"))
    return fx.table("conversations").select("conv_id", "turn", t.clamp_confidence(points).alias("confidence"))


_COMBINED = d.clean("coalesce(excerpt, '') || ' ' || body")


@query("ing_4_enriched_confidence", f"""SELECT doc_id, least(100, 80 + CASE WHEN length(c) >= 600 THEN 10 ELSE 0 END + CASE WHEN length(c) >= 1200 THEN 5 ELSE 0 END
    + CASE WHEN len({d.labels(d.norm('c'), PROSE_PATTERNS)}) > 0 THEN 5 ELSE 0 END) / 100.0::DOUBLE AS confidence FROM (SELECT doc_id, {_COMBINED} AS c FROM v_document)""")
def _(fx):
    points = mt.enriched_page_confidence(F.lit(80), F.col("excerpt"), F.col("body"), PROSE_PATTERNS)
    return fx.document().select("doc_id", t.clamp_confidence(points).alias("confidence"))


@query("agg_10_confidence_stats", """SELECT lang, floor(avg(points) + 0.5) / 100.0::DOUBLE AS average_confidence, max(points) / 100.0::DOUBLE AS max_confidence FROM (SELECT lang, 45 + doc_id % 53 AS points FROM documents) GROUP BY lang""")
def _(fx):
    rows = fx.table("documents").select("lang", (45 + F.col("doc_id") % 53).alias("points"))
    return rows.groupBy("lang").agg(*pln.confidence_stats(F.col("points")))


@query("ing_5_review_records", f"""SELECT doc_id, CASE WHEN p >= n + 2 THEN 'positive' WHEN n >= p + 2 THEN 'negative' ELSE 'mixed' END AS sentiment, array_to_string(labels[1:3], '|') AS highlights, fp AS fingerprint, confidence FROM (
    SELECT doc_id, {d.count_hits('h', PROSE_POSITIVE)} AS p, {d.count_hits('h', PROSE_NEGATIVE)} AS n, {d.labels('h', PROSE_PATTERNS)} AS labels, fp, (40 + doc_id % 61) / 100.0::DOUBLE AS confidence
    FROM (SELECT doc_id, {d.norm("concat_ws(' ', title, body)")} AS h, array_to_string(list_filter(string_split({d.norm('title')}, ' '), lambda w: length(w) > 1), ' ') AS fp FROM v_document))""")
def _(fx):
    rows = fx.document().select(
        F.col("doc_id").alias("release_id"), F.lit(1).alias("source_id"), F.lit("u").alias("url"), "title", F.col("title").alias("summary"), "body",
        F.lit(None).cast("int").alias("score"), F.lit(None).cast("timestamp").alias("published_at"), (40 + F.col("doc_id") % 61).alias("confidence_e2"))
    made = mt.review_records(rows, "importer-1", PROSE_POSITIVE, PROSE_NEGATIVE, PROSE_PATTERNS)
    return made.select(F.col("release_id").alias("doc_id"), "sentiment", F.array_join("highlights", "|").alias("highlights"),
                       F.get_json_object("metadata", "$.titleFingerprint").alias("fingerprint"),
                       F.get_json_object("metadata", "$.importerConfidence").cast("double").alias("confidence"))


@query("ext_12_fallback_records", """SELECT d.doc_id, p.page_id IS NULL AS used_fallback, md5(CASE WHEN p.page_id IS NOT NULL THEN p.url ELSE coalesce(d.excerpt, d.title) END) AS summary
    FROM v_document d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def _(fx):
    candidates = fx.document().select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "title", "excerpt")
    pages = fx.page().select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), F.col("url").alias("title"), F.col("url").alias("summary"), F.col("url").alias("body"))
    return mt.with_fallback(candidates, pages).select("doc_id", "used_fallback", F.md5("summary").alias("summary"))


@query("jn_12_run_context", "SELECT r.release_id, c.crawl_source_id FROM v_release r JOIN v_crawl_source c ON c.source_id = 2 AND c.importer_key = 'importer-2'")
def _(fx):
    return mt.run_context(fx.release(), fx.crawl_source(), 2, "importer-2").select("release_id", "crawl_source_id")


# --- near duplicates -----------------------------------------------------------------------------

d.VIEWS["v_titled"] = f"""SELECT doc_id, lang, source, 'https://x/' || (doc_id % 400) AS url, fp, list_distinct(string_split(fp, ' ')) AS toks FROM (SELECT doc_id, lang, source,
    array_to_string(list_filter(string_split({d.norm("regexp_extract(text, '^[^.]*', 0)")}, ' '), lambda w: length(w) > 1), ' ') AS fp FROM documents)"""
_SIMILAR = """(a.url = b.url OR (a.fp <> '' AND b.fp <> '' AND (a.fp = b.fp OR len(list_intersect(a.toks, b.toks)) >= greatest(2, least(len(a.toks), len(b.toks)) - 1))))"""
BLOCK = ("lang", "source")


def titled(fx):
    rows = fx.table("documents").select("doc_id", "lang", "source", F.concat(F.lit("https://x/"), (F.col("doc_id") % 400).cast("string")).alias("url"),
                                        F.struct(F.col("doc_id").alias("id")).alias("ord"), F.regexp_extract("text", "^[^.]*", 0).alias("_title"))
    return dd.with_set_key(fx.spread(rows, "doc_id"), F.col("_title")).drop("_title")


@query("jn_9_first_duplicate", f"""SELECT a.doc_id, min(b.doc_id) AS duplicate_of FROM v_titled a LEFT JOIN v_titled b ON a.lang = b.lang AND a.source = b.source AND b.doc_id < a.doc_id AND {_SIMILAR} GROUP BY a.doc_id""")
def _(fx):
    return dd.first_duplicates(titled(fx), BLOCK).select("doc_id", "duplicate_of")


# One record after the other in each block; the records of a block are a list that grows by what is kept.
@query("ing_6_suppress_duplicates", """WITH RECURSIVE b AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS step FROM v_titled WHERE doc_id % 10 <> 0
    ), s AS (
      SELECT lang, source, list({'url': url, 'fp': fp, 'toks': toks} ORDER BY doc_id) AS st FROM v_titled WHERE doc_id % 10 = 0 GROUP BY lang, source
    ), walk AS (
      SELECT b.lang, b.source, 0::BIGINT AS step, NULL::BIGINT AS doc_id, false AS kept, coalesce(any_value(s.st), []) AS st FROM b LEFT JOIN s ON s.lang = b.lang AND s.source = b.source GROUP BY b.lang, b.source
      UNION ALL
      SELECT lang, source, step, doc_id, kept, CASE WHEN kept THEN list_append(st, {'url': url, 'fp': fp, 'toks': toks}) ELSE st END FROM (
        SELECT b.*, w.st, len(list_filter(w.st, lambda x: x.url = b.url OR (x.fp <> '' AND b.fp <> '' AND (x.fp = b.fp OR len(list_intersect(x.toks, b.toks)) >= greatest(2, least(len(x.toks), len(b.toks)) - 1))))) = 0 AS kept
        FROM walk w JOIN b ON b.lang = w.lang AND b.source = w.source AND b.step = w.step + 1)
    )
    SELECT doc_id, kept FROM walk WHERE step > 0""")
def _(fx):
    rows = titled(fx)
    batch, stored = rows.filter("doc_id % 10 <> 0"), rows.filter("doc_id % 10 = 0")
    return dd.suppress_duplicates(batch, stored, BLOCK).select("doc_id", "kept")


# --- extraction ------------------------------------------------------------------------------------

_VISIBLE = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"


def _strip(x: str) -> str:
    plain = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for entity, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):  # all that the given pages hold
        plain = f"replace({plain}, {d.quoted(entity)}, {d.quoted(value)})"
    return d.clean(plain)


@query("src_3_raw_documents", "SELECT page_id, url, md5(html) AS raw FROM pages")
def _(fx):
    return captures.raw_documents(fx.page()).select("page_id", "url", F.md5("raw_text").alias("raw"))


@query("ext_1_page_title", f"SELECT page_id, {_strip(r'''regexp_extract(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>', 1)''')} AS title FROM pages")
def _(fx):
    return fx.page().select("page_id", ex.page_title(F.col("html")).alias("title"))


_BLOCKEND = r"'(?is)(</p>|</?(div|ul|ol|table|section|article|main|h[1-6])[\s>]).*$'"
_REGION = rf"regexp_extract({_VISIBLE}, '(?is)<article\b.*?</article\s*>', 0)"


@query("ext_2_page_body", f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex({_REGION}, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda p: {_strip(f"regexp_replace(p, {_BLOCKEND}, '')")}),
    lambda p: length(p) > 40 AND NOT {d.contains_any('lower(p)', lx.PAGE_CHROME_TOKENS)}), chr(10) || chr(10)) AS body FROM pages""")
def _(fx):
    return fx.page().select("page_id", ex.page_body(F.col("html")).alias("body"))


@query("ext_3_json_ld_article")
def _(fx):
    return fx.page().select("page_id", ex.json_ld_article(F.col("html")).alias("a")).select("page_id", "a.*")


@query("ext_4_published_at")
def _(fx):
    article = ex.json_ld_article(F.col("html"))
    return fx.page().withColumn("a", article).select("page_id", F.date_format(ex.published_at(F.col("html"), F.col("a")), "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("ext_5_author")
def _(fx):
    article = ex.json_ld_article(F.col("html"))
    return fx.page().withColumn("a", article).select("page_id", ex.author_name(F.col("html"), F.col("a")).alias("author"))


# Spec and score lines are appended to the given texts: the prose itself never contains one.
_LABELLED = """text || ' Score: ' || (doc_id % 11) || ' out of 10. Audience verdict ' || (10 + doc_id % 90) || ' Weight: about ' || (7 + doc_id % 6) || '.' || (doc_id % 10) || ' oz Heel stack measured '
    || (20 + doc_id % 25) || '.5 mm Forefoot stack ' || (15 + doc_id % 20) || ' mm Drop ' || (doc_id % 13) || ' mm'"""


def labelled(fx):
    k = F.col("doc_id")

    def s(c):
        return c.cast("string")

    tail = F.concat(F.lit(" Score: "), s(k % 11), F.lit(" out of 10. Audience verdict "), s(10 + k % 90), F.lit(" Weight: about "), s(7 + k % 6), F.lit("."), s(k % 10),
                    F.lit(" oz Heel stack measured "), s(20 + k % 25), F.lit(".5 mm Forefoot stack "), s(15 + k % 20), F.lit(" mm Drop "), s(k % 13), F.lit(" mm"))
    return fx.table("documents").select("doc_id", F.concat("text", tail).alias("text"))


def _scored(pattern: str) -> str:
    return f"nullif(regexp_extract(v, {d.quoted(pattern)}, 1), '')"


_P1, _P2, _P3 = ex.SCORE_PATTERNS
_VAL = f"coalesce({_scored(_P1)}, {_scored(_P2)}, {_scored(_P3)})"
_SCALE = f"CASE WHEN {_scored(_P1)} IS NOT NULL THEN regexp_extract(v, {d.quoted(_P1)}, 2) WHEN {_scored(_P2)} IS NOT NULL THEN regexp_extract(v, {d.quoted(_P2)}, 2) ELSE regexp_extract(v, {d.quoted(_P3)}, 2) END"


@query("ext_6_page_score", f"""SELECT doc_id, CASE WHEN val IS NOT NULL THEN greatest(0, least(100, {d.half_up('CAST(val AS DOUBLE) / CAST(scale AS DOUBLE) * 100')})) END AS score FROM (SELECT doc_id, {_VAL} AS val, nullif({_SCALE}, '') AS scale
    FROM (SELECT doc_id, {d.clean(_LABELLED)} AS v FROM documents))""")
def _(fx):
    return labelled(fx).withColumn("text", t.clean_text(F.col("text"))).select("doc_id", ex.page_score(F.col("text"), F.col("text"))["score"].alias("score"))


@query("ext_7_verdict_and_product_score", f"""SELECT doc_id, CAST(nullif(regexp_extract({_LABELLED}, '(?i)\\bAudience verdict\\s+(\\d{{2}})\\b', 1), '') AS INTEGER) AS verdict,
    CASE WHEN raw <= 10 THEN {d.half_up('raw * 10')} ELSE {d.half_up('raw')} END AS product FROM (SELECT *, (doc_id % 95) / 2.0::DOUBLE AS raw FROM documents)""")
def _(fx):
    raw = F.concat(F.lit('{"score" : '), F.round(F.col("doc_id") % 95 / 2, 1).cast("string"), F.lit("}"))
    return labelled(fx).select("doc_id", ex.audience_verdict(F.col("text")).alias("verdict"), ex.product_score(raw).alias("product"))


@query("ext_8_lab_specs", f"""SELECT doc_id, {', '.join((f"round(CAST({{0}} AS DOUBLE), 1)" if name == 'weight_oz' else d.half_up("CAST({0} AS DOUBLE)")).format(f"nullif(regexp_extract(v, {d.quoted(p)}, 1), '')") + f' AS {name}' for name, p in ex.SPEC_PATTERNS.items())}
    FROM (SELECT doc_id, {_LABELLED} AS v FROM documents)""")
def _(fx):
    return labelled(fx).select("doc_id", *[c.alias(name) for name, c in ex.lab_specs(F.col("text")).items()])


@query("ext_9_lists_under_headings")
def _(fx):
    page = F.concat(F.col("html"), F.lit("<h3>Pros</h3><div><ul><li> Light &amp; fast<li>Soft</ul></div><h2><b>Cons</b></h2><ul><li>Dear</li></ul><h2>Our verdict</h2><p>Fine <i>shoe</i>.</p>"))
    return fx.page().select("page_id", page.alias("html")).select(
        "page_id", F.array_join(ex.list_under_heading(F.col("html"), "Pros"), "|").alias("pros"),
        F.array_join(ex.list_under_heading(F.col("html"), "Cons"), "|").alias("cons"), ex.paragraph_after_heading(F.col("html"), "Our verdict").alias("verdict"))


# --- article pages made of the given texts: what each field must be follows from how the page was put together ---

FOOTER = "This closing sentence is long enough for a paragraph of its own, but it belongs to none of the containers."
d.VIEWS["v_article"] = f"""SELECT doc_id, doc_id % 6 AS shape, doc_id % 4 AS meta, regexp_replace(coalesce(lines[1], ''), '[<>&]', '', 'g') AS p1, regexp_replace(coalesce(lines[2], ''), '[<>&]', '', 'g') AS p2, {d.quoted(FOOTER)} AS foot
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"""


def articles(fx):
    """Pages of six shapes (containers, nested articles, none) and four kinds of metadata (none, broken, one node, a graph)."""
    k = F.col("doc_id")
    lines = F.split("text", "\n")
    line = lambda i: F.regexp_replace(F.coalesce(F.get(lines, F.lit(i)), F.lit("")), "[<>&]", "")

    def glued(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    p1, p2, foot = glued("<p>", line(0), "</p>"), glued("<P class=x>", line(1), "</P>"), glued("<p>", FOOTER, "</p>")
    shapes = [
        glued("<article><div class='entry-content wide'><div>", p1, "</div>", p2, "</div>", foot, "</article>"),
        glued("<article><span class='byline'><a href='/a'>Ann ", k % 5, "</a></span><section id=s class=\"x post-content\">", p1, "</section>", foot, "</article>"),
        glued("<article><div><div itemprop=\"articleBody\">", p1, "</div></div>", foot, "</article>"),
        glued("<article><h1>One ", k, "</h1><article>", p1, "</article>", p2, "<time datetime='2024-02-02T10:00:00Z'>t</time></article><b class='author'>Nobody</b>", foot),
        glued("<div class=\"post-body\">", p1, "<div>x</div></div>", foot),
        glued("<article><!-- <article> --><div class='entry-contents'>", p1, "</div></article>", foot),
    ]
    body = F.coalesce(*[F.when(k % 6 == i, s) for i, s in enumerate(shapes)])
    node = glued('{"@type":["NewsArticle"],"headline":" Head  ', k, '","description":"About ', k, '","datePublished":"2024-03-05","author":[{"name":"Writer ', k % 7, '"}]}')
    script = F.when(k % 4 == 1, '{"@type":"Article",').when(k % 4 == 2, node).when(k % 4 == 3, glued('{"@graph":[{"@type":"WebSite","headline":"no"},', node, "]}"))
    head = glued("<html><head><title>T</title><meta property='og:title' content='Og &#x26; ", k, "'><meta content='2024-05-06' property='article:published_time'>",
                 F.coalesce(glued("<script type=\"application/ld+json\">", script, "</script>"), F.lit("")), "</head><body>")
    words = F.slice(F.filter(F.split(F.regexp_replace(line(0), "[^A-Za-z ]", ""), " "), lambda w: w != ""), 1, 10)
    items = lambda start, end: F.array_join(F.transform(words, lambda w: F.concat(F.lit(start), w, F.lit(end))), "")
    lists = glued("<h3>Pros</h3><div><ul>", items("<li> ", " &amp; more</li>"), "</ul></div><h2><b>Cons</b></h2><ul>", items("<li>", ""), "</ul><h2>Our verdict</h2><p>", line(1), " <i>so</i></p>")
    return fx.table("documents").select("doc_id", F.concat(head, body, lists, F.lit("</body></html>")).alias("html"))


_KEEP = f"lambda p: length(p) > 40 AND NOT {d.contains_any('lower(p)', lx.PAGE_CHROME_TOKENS)}"
_FIRST, _SECOND = d.clean("p1"), d.clean("p2")


@query("ext_1_article_title", "SELECT doc_id, CASE WHEN shape = 3 THEN 'One ' || doc_id WHEN meta >= 2 THEN 'Head ' || doc_id ELSE 'Og & ' || doc_id END AS title FROM v_article")
def _(fx):
    rows = articles(fx).withColumn("a", ex.json_ld_article(F.col("html")))
    return rows.select("doc_id", ex.page_title(F.col("html"), article=F.col("a")).alias("title"))


@query("ext_2_article_body", f"""SELECT doc_id, array_to_string(CASE WHEN len(own) > 0 THEN own WHEN shape < 3 THEN [foot] ELSE [] END, chr(10) || chr(10)) AS body
    FROM (SELECT doc_id, shape, foot, list_filter(CASE WHEN shape IN (0, 3) THEN [{_FIRST}, {_SECOND}] ELSE [{_FIRST}] END, {_KEEP}) AS own FROM v_article)""")
def _(fx):
    return articles(fx).select("doc_id", ex.page_body(F.col("html")).alias("body"))


@query("ext_3_article_nodes", """SELECT doc_id, CASE WHEN meta >= 2 THEN 'Head ' || doc_id END AS headline, CASE WHEN meta >= 2 THEN 'About ' || doc_id END AS description,
    CASE WHEN meta >= 2 THEN '2024-03-05' END AS published, CASE WHEN meta >= 2 THEN 'Writer ' || (doc_id % 7) END AS author FROM v_article""")
def _(fx):
    return articles(fx).select("doc_id", ex.json_ld_article(F.col("html")).alias("a")).select("doc_id", "a.*")


@query("ext_4_article_dates", "SELECT doc_id, CASE WHEN shape = 3 THEN '2024-02-02 10:00:00' WHEN meta >= 2 THEN '2024-03-05 00:00:00' ELSE '2024-05-06 00:00:00' END AS published_at FROM v_article")
def _(fx):
    rows = articles(fx).withColumn("a", ex.json_ld_article(F.col("html")))
    return rows.select("doc_id", F.date_format(ex.published_at(F.col("html"), F.col("a")), "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("ext_5_article_authors", "SELECT doc_id, CASE WHEN shape = 1 THEN 'Ann ' || (doc_id % 5) WHEN meta >= 2 THEN 'Writer ' || (doc_id % 7) END AS author FROM v_article")
def _(fx):
    rows = articles(fx).withColumn("a", ex.json_ld_article(F.col("html")))
    return rows.select("doc_id", ex.author_name(F.col("html"), F.col("a")).alias("author"))


@query("ext_9_article_lists", f"""SELECT doc_id, array_to_string(list_transform(w[1:8], lambda x: x || ' & more'), '|') AS pros, array_to_string(w[1:8], '|') AS cons, {d.clean("p2 || ' so'")} AS verdict
    FROM (SELECT doc_id, p2, list_filter(string_split(regexp_replace(p1, '[^A-Za-z ]', '', 'g'), ' '), lambda x: x <> '')[1:10] AS w FROM v_article)""")
def _(fx):
    html = F.col("html")
    return articles(fx).select("doc_id", F.array_join(ex.list_under_heading(html, "Pros"), "|").alias("pros"), F.array_join(ex.list_under_heading(html, "Cons"), "|").alias("cons"),
                               ex.paragraph_after_heading(html, "Our verdict").alias("verdict"))


# --- threads ---------------------------------------------------------------------------------------

_POST = "(SELECT conv_id, arg_min(text, turn) AS text, min(turn) AS post_turn FROM conversations WHERE role = 'user' GROUP BY conv_id)"
_TOPC = f"""(SELECT conv_id, body, role, rank FROM (SELECT c.conv_id, c.role, substring({d.clean('c.text')}, 1, 280) AS body, row_number() OVER (PARTITION BY c.conv_id ORDER BY length(c.text) % 50 DESC, c.turn) AS rank
    FROM conversations c JOIN {_POST} p ON p.conv_id = c.conv_id AND c.turn <> p.post_turn WHERE c.text <> '') WHERE rank <= 3 AND body <> '')"""


def threads(fx):
    rows = fx.table("conversations")
    posts = rows.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("selftext"), F.min("turn").alias("post_turn"))
    comments = rows.join(posts.select("conv_id", "post_turn"), "conv_id").filter("turn <> post_turn").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("position"), F.col("role").alias("author"), (F.length("text") % 50).alias("score"), F.lit(False).alias("stickied"), F.col("text").alias("body"))
    titled_posts = posts.select(F.col("conv_id").alias("thread_id"), F.concat(F.lit("Thread "), F.col("conv_id").cast("string")).alias("title"), "selftext", F.lit("").alias("excerpt"))
    return titled_posts, comments


@query("srt_8_top_comments", f"SELECT conv_id AS thread_id, CAST(rank AS INTEGER) AS rank, role AS author, body FROM {_TOPC}")
def _(fx):
    return ex.top_comments(threads(fx)[1], width=ex.COMMENT_LIMIT).select("thread_id", "rank", "author", "body")


@query("ext_11_thread_assembly", f"""SELECT p.conv_id AS thread_id, trim(substring(concat_ws(' ', nullif({d.clean('p.text')}, ''), nullif({d.clean("coalesce(bodies, '')")}, '')), 1, 420)) AS summary,
    substring(concat_ws(chr(10) || chr(10), 'Thread ' || p.conv_id, nullif({d.clean('p.text')}, ''), quotes), 1, 4000) AS body FROM {_POST} p LEFT JOIN (
      SELECT conv_id, string_agg(body, ' ' ORDER BY rank) AS bodies, string_agg('Top comment by ' || role || ': ' || body, chr(10) || chr(10) ORDER BY rank) AS quotes FROM {_TOPC} GROUP BY conv_id) c ON c.conv_id = p.conv_id""")
def _(fx):
    return ex.assemble_threads(*threads(fx), comment_width=ex.COMMENT_LIMIT, summary_width=ex.SUMMARY_LIMIT, body_width=ex.BODY_LIMIT).select("thread_id", "summary", "body")


def search_payloads(fx):
    """Conversations regrouped as search responses, one per conversation."""
    child = F.struct(F.struct(F.concat(F.lit(" Thread  "), F.col("turn").cast("string")).alias("title"), F.col("text").alias("selftext"),
                              F.concat(F.lit("/r/x/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("permalink"),
                              F.col("role").alias("author"), F.col("turn").alias("score"), F.lit(1704067200.0).alias("created_utc")).alias("data"), F.col("turn").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", child.alias("c")))), lambda x: x["c"])
    return fx.table("conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(ordered.alias("children")).alias("data"))).alias("payload"))


@query("src_4_thread_search", f"""SELECT conv_id, turn AS score, 'Thread ' || turn AS title, md5({d.clean('substring(text, 1, 400)')}) AS excerpt, 'https://forum.example.com/r/x/' || conv_id || '/' || turn AS url, '2024-01-01' AS published FROM conversations""")
def _(fx):
    return captures.thread_search(search_payloads(fx), excerpt_width=400).select("conv_id", "score", "title", F.md5("excerpt").alias("excerpt"), "url", t.iso_date(F.col("published_at")).alias("published"))


@query("src_5_thread_detail", f"""SELECT conv_id AS thread_id, 'comment' AS kind, turn AS score, md5(text) AS body FROM conversations WHERE turn > 0
    UNION ALL SELECT conv_id, 'post', NULL, md5(coalesce(any_value(text) FILTER (turn = 0), '')) FROM conversations GROUP BY conv_id""")
def _(fx):
    rows = fx.table("conversations")
    post = rows.filter("turn = 0").select("conv_id", F.struct(F.lit("t").alias("title"), F.col("text").alias("selftext")).alias("data"))
    comment = F.struct(F.struct(F.col("text").alias("body"), F.col("turn").alias("score")).alias("data"))
    comments = rows.filter("turn > 0").groupBy("conv_id").agg(F.collect_list(comment).alias("children"))
    payload = F.concat(F.lit('[{"data":{"children":['), F.to_json(F.struct("data")), F.lit(']}},{"data":'), F.to_json(F.struct("children")), F.lit("}]"))
    listings = comments.join(post, "conv_id", "full").withColumns({
        "data": F.coalesce("data", F.struct(F.lit("t").alias("title"), F.lit("").alias("selftext"))), "children": F.coalesce("children", F.array().cast(comments.schema["children"].dataType))})
    posts, replies = captures.thread_detail(listings.select(F.col("conv_id").alias("thread_id"), payload.alias("payload")))
    return replies.select("thread_id", F.lit("comment").alias("kind"), "score", F.md5("body").alias("body")).unionByName(
        posts.select("thread_id", F.lit("post").alias("kind"), "score", F.md5("selftext").alias("body")))


@query("src_6_sitemap_entries", f"""SELECT page_id, replace(url, '&', '+') AS loc, CASE WHEN page_id % 3 = 0 THEN '2024-01-05' END AS lastmod FROM pages""")
def _(fx):
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("+")), F.lit("</loc>"), F.when(F.col("page_id") % 3 == 0, "<lastmod>2024-01-05</lastmod>").otherwise(""),
                   F.lit("</url><url><lastmod>2024-02-02</lastmod></url>"))
    sitemaps = fx.page().select("page_id", F.concat(F.lit("<urlset>"), loc, F.lit("</urlset>")).alias("xml"))
    return captures.sitemap_entries(sitemaps).select("page_id", "loc", t.iso_date(F.col("lastmod")).alias("lastmod"))
