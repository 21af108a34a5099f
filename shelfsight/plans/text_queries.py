"""Scalar text, number and date functions over the document and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import lexicons as lx, text as t
from shelfsight.plans import duck as d
from shelfsight.plans.registry import query
from shelfsight.sources.fixtures import as_of

# --- fixed values: lexicons drawn from the test prose, whose words the defaults never hit ---
PROSE_POSITIVE = ("the", "tion", "an", "on", "re")
PROSE_NEGATIVE = ("ch", "qu", "eau", "der", "ung")
PROSE_PATTERNS = (
    ("Alpha", ("the an", "hean")),
    ("Beta", ("der ", "ung")),
    ("Gamma", ("eau", "que")),
    ("Delta", ("cion", "los ")),
    ("Epsilon", ("wh", "sh")),
)

TITLE = "string_split(text, chr(10))[1]"


def first_line():
    return F.regexp_extract("text", "^([^\n]*)", 1)


@query("txt_1_clean_text", f"SELECT doc_id, md5({d.clean('text')}) AS cleaned, length({d.clean('text')}) AS n FROM documents")
def _(fx):
    c = t.clean_text(F.col("text"))
    return fx.table("documents").select("doc_id", F.md5(c).alias("cleaned"), F.length(c).cast("bigint").alias("n"))


@query("txt_2_normalize_search_text", f"SELECT doc_id, md5({d.norm('text')}) AS normal, {d.norm(TITLE)} AS title FROM documents")
def _(fx):
    return fx.table("documents").select(
        "doc_id", F.md5(t.normalize_search_text(F.col("text"))).alias("normal"),
        t.normalize_search_text(first_line()).alias("title"),
    )


@query("txt_3_search_aliases", f"""SELECT release_id, array_to_string(list_filter(
    CASE WHEN n = replace(n, ' ', '') THEN [n] ELSE [n, replace(n, ' ', '')] END, lambda a: a <> ''), '|') AS aliases
    FROM (SELECT release_id, {d.norm('version_name')} AS n FROM v_release)""")
def _(fx):
    return fx.release().select("release_id", F.array_join(t.search_aliases(F.col("version_name")), "|").alias("aliases"))


@query("txt_4_summarize_parts", f"""SELECT doc_id, trim(substring(concat_ws(' ', nullif({d.clean('coalesce(excerpt, chr(32))')}, ''),
    nullif({d.clean('title')}, ''), nullif({d.clean('body')}, '')), 1, 420)) AS summary FROM v_document""")
def _(fx):
    return fx.document().select("doc_id", t.summarize_parts([F.col("excerpt"), F.col("title"), F.col("body")]).alias("summary"))


@query("txt_5_derive_sentiment", f"""SELECT doc_id, p AS positive_hits, n AS negative_hits,
    CASE WHEN p >= n + 2 THEN 'positive' WHEN n >= p + 2 THEN 'negative' ELSE 'mixed' END AS sentiment,
    CASE WHEN dp >= dn + 2 THEN 'positive' WHEN dn >= dp + 2 THEN 'negative' ELSE 'mixed' END AS default_sentiment
    FROM (SELECT doc_id, {d.count_hits('h', PROSE_POSITIVE)} AS p, {d.count_hits('h', PROSE_NEGATIVE)} AS n,
      {d.count_hits('h', lx.POSITIVE_SIGNALS)} AS dp, {d.count_hits('h', lx.NEGATIVE_SIGNALS)} AS dn
      FROM (SELECT doc_id, {d.norm('text')} AS h FROM documents))""")
def _(fx):
    docs = fx.table("documents").select("doc_id", t.normalize_search_text(F.col("text")).alias("h"))
    counted = docs.select(
        "doc_id",
        t.count_hits(F.col("h"), PROSE_POSITIVE).alias("positive_hits"),
        t.count_hits(F.col("h"), PROSE_NEGATIVE).alias("negative_hits"),
        t.sentiment_from_hits(t.count_hits(F.col("h"), lx.POSITIVE_SIGNALS), t.count_hits(F.col("h"), lx.NEGATIVE_SIGNALS)).alias("default_sentiment"),
    )
    return counted.withColumn("sentiment", t.sentiment_from_hits(F.col("positive_hits"), F.col("negative_hits")))


@query("txt_6_extract_highlights", f"""SELECT doc_id, array_to_string({d.labels('h', PROSE_PATTERNS)}[1:3], '|') AS highlights,
    array_to_string({d.labels('h', lx.HIGHLIGHT_PATTERNS)}[1:3], '|') AS default_highlights
    FROM (SELECT doc_id, {d.norm('text')} AS h FROM documents)""")
def _(fx):
    return fx.table("documents").select(
        "doc_id",
        F.array_join(t.extract_highlights([F.col("text")], 3, PROSE_PATTERNS), "|").alias("highlights"),
        F.array_join(t.extract_highlights([F.col("text")]), "|").alias("default_highlights"),
    )


@query("txt_7_infer_themes", f"""SELECT doc_id, array_to_string(list_concat(['Epsilon', 'Own'],
    list_filter({d.labels('h', PROSE_PATTERNS)}, lambda v: v <> 'Epsilon')), '|') AS themes
    FROM (SELECT doc_id, {d.norm("concat_ws(' ', excerpt, body)")} AS h FROM v_document)""")
def _(fx):
    explicit = F.array(F.lit("Epsilon"), F.lit("Own"))
    return fx.document().select(
        "doc_id", F.array_join(t.infer_themes(explicit, [F.col("excerpt"), F.col("body")], PROSE_PATTERNS), "|").alias("themes")
    )


@query("txt_8_infer_terms", f"""SELECT doc_id, array_to_string({d.labels('h', PROSE_PATTERNS[::-1])}, '|') AS terms,
    array_to_string({d.labels('h', lx.TERM_PATTERNS)}, '|') AS default_terms
    FROM (SELECT doc_id, {d.norm("concat_ws(' ', title, excerpt, body)")} AS h FROM v_document)""")
def _(fx):
    texts = [F.col("title"), F.col("excerpt"), F.col("body")]
    return fx.document().select(
        "doc_id",
        F.array_join(t.infer_terms(texts, PROSE_PATTERNS[::-1]), "|").alias("terms"),
        F.array_join(t.infer_terms(texts), "|").alias("default_terms"),
    )


@query("txt_9_title_fingerprint", f"""SELECT doc_id, array_to_string(list_filter(string_split({d.norm(TITLE)}, ' '),
    lambda w: length(w) > 1), ' ') AS fingerprint FROM documents""")
def _(fx):
    return fx.table("documents").select("doc_id", t.title_fingerprint(first_line()).alias("fingerprint"))


def _similar_sql(a: str, b: str) -> str:
    def tokens(x):
        return f"list_distinct(string_split({x}, ' '))"

    return f"""CASE WHEN {a} = '' OR {b} = '' THEN false WHEN {a} = {b} THEN true
      ELSE len(list_intersect({tokens(a)}, {tokens(b)})) >= greatest(2, least(len({tokens(a)}), len({tokens(b)})) - 1) END"""


def _fp_sql(x: str) -> str:
    return f"array_to_string(list_filter(string_split({d.norm(x)}, ' '), lambda w: length(w) > 1), ' ')"


@query("txt_10_fingerprints_similar", f"""SELECT x.page_id, {_similar_sql('x.fp', 'y.fp')} AS is_similar,
    CAST(len(list_intersect(list_distinct(string_split(x.fp, ' ')), list_distinct(string_split(y.fp, ' ')))) AS BIGINT) AS overlap
    FROM (SELECT page_id, {_fp_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS fp FROM pages) x
    JOIN (SELECT doc_id, {_fp_sql(TITLE)} AS fp FROM documents) y ON x.page_id = y.doc_id""")
def _(fx):
    pages = fx.page().select("page_id", t.title_fingerprint(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("a"))
    docs = fx.table("documents").select("doc_id", t.title_fingerprint(first_line()).alias("b"))
    return pages.join(docs, F.col("page_id") == F.col("doc_id")).select(
        "page_id", t.fingerprints_similar(F.col("a"), F.col("b")).alias("is_similar"),
        F.size(F.array_intersect(t.token_set(F.col("a")), t.token_set(F.col("b")))).cast("bigint").alias("overlap"),
    )


@query("txt_11_truncate_text", f"""SELECT doc_id, CASE WHEN length(v) <= 220 THEN v ELSE substring(v, 1, 219) || '…' END AS short
    FROM (SELECT doc_id, {d.trim_ws("coalesce(excerpt, nullif(title, ''))")} AS v FROM v_document)""")
def _(fx):
    return fx.document().select("doc_id", t.truncate_text(F.coalesce(F.col("excerpt"), F.col("title")), 220).alias("short"))


@query("txt_12_humanize_url_slug", f"""SELECT page_id, CASE WHEN s <> '' THEN {d.clean("replace(s, '-', ' ')")} ELSE url END AS label
    FROM (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '\\.html$', ''), '/$', ''), '/')[-1] AS s FROM pages)""")
def _(fx):
    return fx.page().select("page_id", t.humanize_url_slug(F.col("url")).alias("label"))


@query("txt_13_resolve_url", """SELECT page_id, href,
    CASE WHEN href LIKE '/%' THEN 'https://base.example.com' || href ELSE 'https://base.example.com/' || href END AS resolved
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^" <>ßäöüáéíóúñàèùâêîôûçë]*)"', 1)) AS href FROM pages)""")
def _(fx):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^" <>ßäöüáéíóúñàèùâêîôûçë]*)"'), 1)
    return fx.page().select("page_id", F.explode(hrefs).alias("href")).select(
        "page_id", "href", t.resolve_url(F.col("href"), "https://base.example.com").alias("resolved")
    )


@query("txt_14_split_list", f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(title, ','), lambda i: {d.trim_ws('i')}),
      lambda i: i <> '')[1:8], '|') AS by_comma,
    array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda i: {d.trim_ws('i')}), lambda i: i <> '')[1:5], '|') AS by_line
    FROM v_document""")
def _(fx):
    return fx.document().select(
        "doc_id", F.array_join(t.split_list(F.col("title"), ",", 8), "|").alias("by_comma"),
        F.array_join(t.split_list(F.col("body"), "\n", 5), "|").alias("by_line"),
    )


LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id"


def line_id():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id")


@query("num_1_normalize_score", f"""SELECT {LINE_KEY}, greatest(0, least(100, {d.half_up('l_quantity / (l_linenumber * 8.0::DOUBLE) * 100')})) AS score FROM lineitem""")
def _(fx):
    scale = F.col("l_linenumber") * F.lit(8.0)
    return fx.table("lineitem").select(line_id(), t.normalize_score(F.col("l_quantity"), scale).cast("bigint").alias("score"))


@query("num_2_auto_scale_score", f"""SELECT {LINE_KEY}, CASE WHEN v <= 10 THEN {d.half_up('v * 10')} ELSE {d.half_up('v')} END AS score
    FROM (SELECT *, l_quantity / 2 AS v FROM lineitem)""")
def _(fx):
    return fx.table("lineitem").select(line_id(), t.auto_scale_score(F.col("l_quantity") / 2).alias("score"))


@query("num_3_clamp_confidence", f"""SELECT {LINE_KEY}, greatest(0, least(100, CAST(l_quantity AS INTEGER) * 4 - 30)) / 100.0::DOUBLE AS confidence FROM lineitem""")
def _(fx):
    return fx.table("lineitem").select(line_id(), t.clamp_confidence(F.col("l_quantity").cast("int") * 4 - 30).alias("confidence"))


@query("num_4_parse_number", """SELECT event_id, CASE WHEN abs(p) < 'infinity'::DOUBLE THEN p END AS parsed FROM (
    SELECT event_id, try_cast(nullif(trim(raw), '') AS DOUBLE) AS p FROM (
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'x' || event_id WHEN 2 THEN ' ' || event_id || ' ' WHEN 3 THEN event_id || '.5' END AS raw FROM events))""")
def _(fx):
    k = F.col("event_id")
    raw = (F.when(k % 5 == 0, "  ").when(k % 5 == 1, F.concat(F.lit("x"), k.cast("string")))
           .when(k % 5 == 2, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(".5"))))
    return fx.table("events").select("event_id", t.parse_number(raw).alias("parsed"))


@query("dat_1_parse_timestamp", f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN {d.iso_ts("date_trunc('second', ts)")}
    WHEN 1 THEN {d.iso_ts("date_trunc('day', ts)")} WHEN 2 THEN {d.iso_ts("date_trunc('day', ts)")} END AS parsed FROM events""")
def _(fx):
    k = F.col("event_id")
    raw = (F.when(k % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.date_format("ts", "MMMM d, yyyy"))
           .when(k % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("not a date"))
    return fx.table("events").select("event_id", F.date_format(t.parse_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("dat_2_epoch_and_date", f"""SELECT event_id, {d.iso_ts("date_trunc('second', ts)")} AS created, {d.iso_date('ts')} AS created_date FROM events""")
def _(fx):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    made = t.epoch_to_timestamp(seconds)
    return fx.table("events").select("event_id", F.date_format(made, "yyyy-MM-dd HH:mm:ss").alias("created"), t.iso_date(made).alias("created_date"))


@query("dat_3_freshness_weight", f"""SELECT weight, count(*) AS reviews, CAST(sum(source_id) AS BIGINT) AS checksum FROM (
    SELECT {d.freshness('published_at')} / 100.0::DOUBLE AS weight, source_id FROM v_review) GROUP BY weight""")
def _(fx):
    weight = t.freshness_e2(F.col("published_at"), as_of()) / 100
    return fx.review().select(weight.alias("weight"), "source_id").groupBy("weight").agg(
        F.count("*").alias("reviews"), F.sum("source_id").alias("checksum"))


@query("prj_1_slugify", f"SELECT doc_id, {d.slug(TITLE)} AS slug FROM documents")
def _(fx):
    return fx.table("documents").select("doc_id", t.slugify(first_line()).alias("slug"))


@query("prj_2_slugify_spelled_and", f"""SELECT page_id, regexp_replace(regexp_replace(replace(lower(x), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
    FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS x FROM pages)""")
def _(fx):
    return fx.page().select("page_id", t.slugify_spelled_and(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("prj_3_humanize", f"SELECT doc_id, {d.humanize('s')} AS label FROM (SELECT doc_id, {d.slug(TITLE)} AS s FROM documents)")
def _(fx):
    return fx.table("documents").select("doc_id", t.humanize(t.slugify(first_line())).alias("label"))


@query("prj_4_capitalize", f"SELECT doc_id, {d.capitalize('title')} AS capital, lower(title[1:1]) || title[2:] AS lowered FROM v_document")
def _(fx):
    return fx.document().select("doc_id", t.capitalize(F.col("title")).alias("capital"), t.lower_first(F.col("title")).alias("lowered"))


@query("prj_11_site_url", """SELECT page_id, regexp_replace(CASE WHEN regexp_matches(raw, '^https?://') THEN raw ELSE 'https://' || raw END, '/$', '') AS site,
    regexp_replace(regexp_extract(raw, '^(?:https?://)?([^/?#]+)', 1), '^www\\.', '') AS domain
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS raw FROM pages)""")
def _(fx):
    raw = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return fx.page().select("page_id", t.site_url(raw).alias("site")).select("page_id", "site", t.base_domain(F.col("site")).alias("domain"))
