"""Structured columns from captured pages and threads. All parsing is expressions over whole texts."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfsight.functions import lexicons as lx, text as t
from shelfsight.operators import metadata as md

# --- fixed values: patterns, and the widths that a caller may ask for by name; without, texts stay whole ---
BODY_LIMIT, SUMMARY_LIMIT, COMMENT_LIMIT, TOP_COMMENTS = 4000, 420, 280, 3
MIN_PARAGRAPH, MAX_PARAGRAPHS, SCORE_TEXT, SPEC_TEXT = 40, 12, 12000, 15000
SCORE_PATTERNS = (
    r"(?i)(\d+(?:\.\d+)?)\s*/\s*(10|5|100)\b",
    r"(?i)\bscore[:\s]+(\d+(?:\.\d+)?)\s*(?:out of)?\s*(10|5|100)\b",
    r"(?i)\brating[:\s]+(\d+(?:\.\d+)?)\s*(?:out of)?\s*(10|5|100)\b",
)
SPEC_PATTERNS = {
    "weight_oz": r"(?is)\bWeight.{0,140}?(\d{1,2}(?:\.\d)?)\s*oz\b",
    "heel_mm": r"(?is)\bHeel stack.{0,160}?(\d{2}(?:\.\d)?)\s*mm\b",
    "forefoot_mm": r"(?is)\bForefoot stack.{0,160}?(\d{2}(?:\.\d)?)\s*mm\b",
    "drop_mm": r"(?is)\bDrop.{0,120}?(\d{1,2}(?:\.\d)?)\s*mm\b",
}
BLOCK_END = r"(?is)(</p>|</?(div|ul|ol|table|section|article|main|h[1-6])[\s>]).*$"
REFERENCE = r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]{1,7});"
#: Characters of named references, from the standard table; a space that does not break is a space, as in the text that readers see.
NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}


def cut(c: Column, width: int | None) -> Column:
    return c if width is None else F.substring(c, 1, width)


def character(code: Column) -> Column:
    """The character of a code point; the replacement character for what is none."""
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal references in one pass, so that nothing is decoded twice; unknown names stay."""
    names = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])

    def one(ref: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(ref, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10)
        return (F.when(ref.rlike("^&#[xX]"), character(hexadecimal.try_cast("long"))).when(ref.startswith("&#"), character(F.regexp_extract(ref, "(\\d+)", 1).try_cast("long")))
                .otherwise(F.coalesce(names[F.regexp_replace(ref, "[&;]", "")], ref)))

    gaps, refs = F.split(c, REFERENCE), F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), 0), one)
    whole = F.array_join(F.zip_with(gaps, F.concat(refs, F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
    return F.when(F.regexp_like(c, F.lit(REFERENCE)), whole).otherwise(c)


def drop_hidden(html: Column) -> Column:
    """Without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")


def strip_tags(html: Column) -> Column:
    return t.clean_text(decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", "")))


def element_text(html: Column, tag: str) -> Column:
    """Text of the first element of a tag, null when absent or empty."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.nullif(strip_tags(inner), F.lit(""))


def attribute(html: Column, element: str, name: str) -> Column:
    """Attribute of the first element whose opening tag matches, in either attribute order."""
    tag = F.regexp_extract(html, rf"(?is)<{element}[^>]*>", 0)
    value = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.nullif(t.clean_text(decode_entities(value)), F.lit(""))


def meta(html: Column, key: str, value: str) -> Column:
    return attribute(html, rf"meta(?=[^>]*\b{key}\s*=\s*[\"']{value}[\"'])", "content")


def with_class(*names: str) -> str:
    """Opening tag of an element that has one of the classes, in any quotes."""
    word = rf"(?<![\w-])(?:{'|'.join(names)})(?![\w-])"
    return rf"<[a-z][a-z0-9]*\b[^>]*\bclass\s*=\s*(?:\"[^\">]*{word}|'[^'>]*{word}|{word})[^>]*>"


def with_attribute(name: str, value: str) -> str:
    return rf"<[a-z][a-z0-9]*\b[^>]*\b{name}\s*=\s*[\"']?{value}(?![\w-])[^>]*>"


def element(html: Column, opening: str) -> Column:
    """The first element whose opening tag matches, to its own closing tag: elements of the same name inside it are counted. Empty when there is none.

    One pass over the tags of that name: the depth after each is folded until it returns to zero. An element that never closes runs to the end.
    """
    def whole(rest: Column) -> Column:
        tag = F.concat(F.lit("(?is)</?"), F.regexp_extract(rest, "^<([A-Za-z][A-Za-z0-9]*)", 1), F.lit(r"(?=[\s/>])[^>]*>"))
        pairs = F.arrays_zip(F.split(rest, tag).alias("gap"), F.regexp_extract_all(rest, tag, F.lit(0)).alias("tag"))

        def step(at: Column, pair: Column) -> Column:
            depth = at["depth"] + F.when(pair["tag"].startswith("</"), -1).otherwise(1)
            width = at["width"] + F.length(pair["gap"]) + F.length(pair["tag"])
            return F.when(at["closed"] | pair["tag"].isNull(), at).otherwise(F.struct(depth.alias("depth"), width.alias("width"), (depth == 0).alias("closed")))

        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("width"), F.lit(False).alias("closed"))
        return F.aggregate(pairs, start, step, lambda at: F.when(at["closed"], rest.substr(F.lit(1), at["width"])).otherwise(rest))

    return t.let(F.regexp_extract(html, rf"(?is){opening}.*", 0), lambda rest: F.when(rest == "", "").otherwise(whole(rest)))


ARTICLE = r"<article(?=[\s>])[^>]*>"
#: Where the paragraphs of a page are looked for, in this order, inside its first article if it has one.
CONTAINERS = (with_class("entry-content"), with_class("post-content"), with_attribute("itemprop", "articleBody"), with_class("post-body"), ARTICLE, r"<main(?=[\s>])[^>]*>")


def article_scope(html: Column) -> Column:
    """The page's first article without scripts, styles and comments; the whole page when it has none."""
    return t.let(drop_hidden(html), lambda page: t.let(element(page, ARTICLE), lambda found: F.when(found == "", page).otherwise(found)))


def page_title(html: Column, candidate: Column | None = None, suffix: str | None = None, article: Column | None = None) -> Column:
    """h1 of the article, post title, JSON-LD headline (of ``article``), og:title, document title, then the candidate's own; a site suffix is cut."""
    found = F.coalesce(element_text(article_scope(html), "h1"), element_text(html, r"h3(?=[^>]*post-title)"), *([F.nullif(article["headline"], F.lit(""))] if article is not None else []),
                       meta(html, "property", "og:title"), element_text(html, "title"), *([candidate] if candidate is not None else []))
    return F.regexp_replace(found, rf"(?i)\s*-\s*{suffix}$", "") if suffix else found


def paragraphs(region: Column, chrome: Sequence[str] = lx.PAGE_CHROME_TOKENS, limit: int | None = None) -> Column:
    """Readable paragraphs, all or the first ``limit``; an unclosed one ends where the next block starts."""
    parts = F.split(region, r"(?i)<p(?:\s[^>]*)?>")
    raw = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: strip_tags(F.regexp_replace(p, BLOCK_END, "")))
    kept = F.filter(raw, lambda p: (F.length(p) > MIN_PARAGRAPH) & ~t.contains_any(F.lower(p), chrome))
    return kept if limit is None else F.slice(kept, 1, limit)


def page_body(html: Column, containers: Sequence[str] = CONTAINERS, chrome: Sequence[str] = lx.PAGE_CHROME_TOKENS, limit: int | None = None, width: int | None = None) -> Column:
    """Paragraphs of the first container that has any, joined by blank lines; empty when none has. ``limit`` paragraphs and ``width`` characters, if given."""
    def body_of(scope: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(*[t.let(paragraphs(element(scope, c), chrome, limit), lambda p: F.when(F.size(p) > 0, p)) for c in containers], none)

    return cut(t.let(article_scope(html), lambda scope: F.array_join(body_of(scope), "\n\n")), width)


def json_ld_article(html: Column) -> Column:
    """First Article, NewsArticle or WebPage node of the page's JSON-LD: headline, description, date, first author."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    roots = F.filter(F.transform(scripts, F.try_parse_json), lambda v: v.isNotNull())
    nodes = F.flatten(F.transform(roots, lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))))

    def is_article(n: Column) -> Column:
        single = F.array(F.try_variant_get(n, "$['@type']", "string"))
        kinds = F.coalesce(F.try_variant_get(n, "$['@type']", "array<string>"), single)
        return F.exists(kinds, lambda k: k.isin("Article", "NewsArticle", "WebPage"))

    article = F.get(F.filter(nodes, is_article), F.lit(0))
    return t.let(article, lambda n: F.when(n.isNotNull(), F.struct(
        t.clean_text(F.coalesce(F.try_variant_get(n, "$.headline", "string"), F.try_variant_get(n, "$.name", "string"))).alias("headline"),
        t.clean_text(F.try_variant_get(n, "$.description", "string")).alias("description"),
        F.try_variant_get(n, "$.datePublished", "string").alias("published"),
        F.coalesce(F.try_variant_get(n, "$.author[0].name", "string"), F.try_variant_get(n, "$.author.name", "string")).alias("author"))))


def published_at(html: Column, article: Column) -> Column:
    """First date by precedence: time element of the article, JSON-LD, article meta, any time element, item property, date header."""
    time = r"time(?=[^>]*datetime)"
    inside = element(drop_hidden(html), ARTICLE)
    candidates = F.coalesce(
        attribute(inside, time, "datetime"), article["published"], meta(html, "property", "article:published_time"),
        attribute(html, time, "datetime"), meta(html, "itemprop", "datePublished"), element_text(html, r"h2(?=[^>]*date-header)"), attribute(html, r"abbr(?=[^>]*published)", "title"))
    return t.parse_timestamp(candidates)


AUTHOR = rf"(?:{with_attribute('rel', 'author')}|{with_class('author', 'post-author', 'byline')})"


def author_name(html: Column, article: Column) -> Column:
    """Marked author of the article (of the page without one): the link inside, else the whole element; else the author of its JSON-LD."""
    marked = t.let(element(article_scope(html), AUTHOR), lambda found: F.coalesce(element_text(found, "a"), F.nullif(strip_tags(found), F.lit(""))))
    return F.coalesce(marked, F.nullif(article["author"], F.lit("")))


def _pattern_score(text: Column, pattern: str) -> Column:
    value, scale = (F.regexp_extract(text, pattern, i) for i in (1, 2))
    return F.when(value != "", F.struct(value.try_cast("double").alias("value"), scale.try_cast("double").alias("scale")))


def page_score(html: Column, visible_text: Column, width: int | None = None) -> Column:
    """Struct value, scale, score from meta rating or the first score pattern of the text (of its first ``width`` characters, if given)."""
    rating = meta(html, "itemprop", "ratingValue").try_cast("double")
    best = F.coalesce(meta(html, "itemprop", "bestRating"), F.lit("10")).try_cast("double")
    opening = cut(visible_text, width)
    found = F.coalesce(F.when(rating.isNotNull() & (best > 0), F.struct(rating.alias("value"), best.alias("scale"))),
                       *[_pattern_score(opening, p) for p in SCORE_PATTERNS])
    return t.let(found, lambda s: F.when(s.isNotNull(), F.struct(
        F.round(s["value"], 1).alias("value"), s["scale"].alias("scale"), t.normalize_score(s["value"], s["scale"]).alias("score"))))


def audience_verdict(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)\bAudience verdict\s+(\d{2})\b", 1), F.lit("")).cast("int")


def product_score(html: Column) -> Column:
    """Score from product metadata or an embedded JSON field, scaled to 100."""
    raw = F.coalesce(meta(html, "name", "twitter:data1").try_cast("double"), meta(html, "property", "product:rating:average").try_cast("double"),
                     F.regexp_extract(html, r'"score"\s*:\s*(\d+(?:\.\d+)?)', 1).try_cast("double"))
    return t.auto_scale_score(raw)


def lab_specs(text: Column, width: int | None = None) -> dict[str, Column]:
    """Measurements near their labels in a page text (in its first ``width`` characters, if given)."""
    opening = cut(text, width)
    found = {name: F.regexp_extract(opening, pattern, 1).try_cast("double") for name, pattern in SPEC_PATTERNS.items()}
    return {name: F.round(v, 1) if name == "weight_oz" else t.round_half_up(v) for name, v in found.items()}


def list_under_heading(html: Column, heading: str, limit: int = 8) -> Column:
    """Items of the first list after an h2 or h3 with this text."""
    block = F.regexp_extract(drop_hidden(html), rf"(?is)<(h[23])\b[^>]*>\s*(?:<[^>]+>\s*)*{heading}\s*(?:</[^>]+>\s*)*</\1\s*>.*?<ul\b[^>]*>(.*?)</ul\s*>", 2)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?is)<li\b[^>]*>(.*?)(?:</li\s*>|(?=<li\b)|$)"), 1), strip_tags)
    return F.slice(F.filter(items, lambda i: i != ""), 1, limit)


def paragraph_after_heading(html: Column, heading: str) -> Column:
    found = F.regexp_extract(drop_hidden(html), rf"(?is)<(h[23])\b[^>]*>\s*{heading}\s*</\1\s*>.*?<p\b[^>]*>(.*?)</p\s*>", 2)
    return strip_tags(found)


def anchors(pages: DataFrame) -> DataFrame:
    """Links of every page in document order: page_id, position, href, title."""
    pattern = r"(?is)<a\b[^>]*?\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>(.*?)</a\s*>"
    visible = drop_hidden(F.col("html"))
    hrefs = F.transform(F.regexp_extract_all(visible, F.lit(pattern), 1), lambda h: F.regexp_replace(h, r"^[\"']|[\"']$", ""))
    pairs = F.arrays_zip(hrefs.alias("href"), F.regexp_extract_all(visible, F.lit(pattern), 2).alias("inner"))
    return pages.select("page_id", F.posexplode(pairs).alias("position", "a")).select(
        "page_id", "position", decode_entities(F.col("a.href")).alias("href"), strip_tags(F.col("a.inner")).alias("title"))


# --- threads ------------------------------------------------------------------------------

def top_comments(comments: DataFrame, limit: int = TOP_COMMENTS, width: int | None = None) -> DataFrame:
    """Best-scored comments per thread, each whole or its first ``width`` characters; a comment that is empty after cleaning still uses its place."""
    usable = comments.filter((F.coalesce("body", F.lit("")) != "") & ~F.coalesce("stickied", F.lit(False)))
    best = Window.partitionBy("thread_id").orderBy(F.coalesce("score", F.lit(0)).desc(), "position")
    ranked = usable.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return ranked.withColumn("body", cut(t.clean_text(F.col("body")), width)).filter("body <> ''")


def assemble_threads(posts: DataFrame, comments: DataFrame, comment_width: int | None = None, summary_width: int | None = None, body_width: int | None = None) -> DataFrame:
    """Summary and body per thread, whole where no width is given. posts: thread_id, title, selftext, excerpt; comments: thread_id, position, author, score, stickied, body."""
    nested = top_comments(comments, width=comment_width).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("rank", "author", "body"))).alias("top"))
    empty = F.array().cast(nested.schema["top"].dataType)
    rows = posts.join(nested, "thread_id", "left").withColumn("top", F.coalesce("top", empty))
    quotes = F.transform("top", lambda c: F.concat(F.lit("Top comment by "), F.coalesce(c["author"], F.lit("unknown")), F.lit(": "), c["body"]))
    self_text = F.nullif(t.clean_text(F.coalesce("selftext", F.lit(""))), F.lit(""))
    summary = t.summarize_parts([F.col("selftext"), F.col("excerpt"), F.array_join(F.transform("top", lambda c: c["body"]), " ")], summary_width)
    return rows.select("thread_id", "title", summary.alias("summary"),
                       cut(F.concat_ws("\n\n", F.col("title"), self_text, quotes), body_width).alias("body"), F.size("top").alias("comment_count"))
