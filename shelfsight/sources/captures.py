"""Scans of captured payloads: pages, sitemaps, thread searches and thread details."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfsight.functions import text as t

SEARCH_SCHEMA = ("struct<data:struct<children:array<struct<data:struct<title:string,selftext:string,permalink:string,author:string,"
                 "score:bigint,num_comments:bigint,created_utc:double>>>>>")


def raw_documents(pages: DataFrame, width: int | None = None) -> DataFrame:
    """Raw capture rows; the stored text is whole, or its first ``width`` characters where a capture table bounds its column."""
    raw = F.col("html") if width is None else F.substring("html", 1, width)
    return pages.select("page_id", "url", F.lit("text/html").alias("content_type"), raw.alias("raw_text"))


def thread_search(payloads: DataFrame, column: str = "payload", base: str = "https://forum.example.com", excerpt_width: int | None = None) -> DataFrame:
    """One row per found post with typed fields and absolute url; the excerpt is the whole text, or its first ``excerpt_width`` characters."""
    parsed = payloads.withColumn("_p", F.from_json(column, SEARCH_SCHEMA)).select("*", F.posexplode_outer("_p.data.children").alias("position", "_c"))
    d = F.col("_c.data")
    text = F.coalesce(d["selftext"], F.lit(""))
    return parsed.filter(d.isNotNull()).select(
        *[c for c in payloads.columns if c != column], "position",
        t.clean_text(F.coalesce(d["title"], F.lit("Untitled thread"))).alias("title"), d["selftext"].alias("selftext"),
        t.clean_text(text if excerpt_width is None else F.substring(text, 1, excerpt_width)).alias("excerpt"),
        t.resolve_url(d["permalink"], base).alias("url"), d["author"].alias("author"), d["score"].alias("score"),
        d["num_comments"].alias("comment_count"), t.epoch_to_timestamp(d["created_utc"]).alias("published_at"))


def thread_detail(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(posts, comments) of two-part thread listings; rows are told apart by the keys they carry."""
    listing = payloads.withColumn("_v", F.try_parse_json(column)).drop(column)

    def children(i: int) -> str:
        return f"try_variant_get(_v, '$[{i}].data.children', 'array<variant>')"

    def field(key: str, kind: str = "string") -> str:
        return f"try_variant_get(_d, '$.data.{key}', '{kind}')"

    def has(key: str) -> str:
        return f"try_variant_get(_d, '$.data.{key}', 'variant') IS NOT NULL"

    post = listing.withColumn("_d", F.expr(f"get({children(0)}, 0)")).filter(f"{has('title')} OR {has('selftext')} OR {has('permalink')}")
    posts = post.selectExpr("thread_id", f"{field('title')} AS title", f"{field('selftext')} AS selftext", f"{field('author')} AS author",
                            f"{field('score', 'bigint')} AS score", f"{field('num_comments', 'bigint')} AS num_comments", f"{field('created_utc', 'double')} AS created_utc")
    comment = listing.select("thread_id", F.expr(f"posexplode({children(1)}) AS (position, _d)")).filter(f"{has('body')} OR {has('stickied')}")
    comments = comment.selectExpr("thread_id", "position", f"{field('author')} AS author", f"{field('score', 'bigint')} AS score",
                                  f"{field('stickied', 'boolean')} AS stickied", f"{field('body')} AS body")
    return posts, comments


def sitemap_index(documents: DataFrame, column: str = "xml", pattern: str = r"/shoe-sitemap\d*\.xml$") -> DataFrame:
    locations = F.regexp_extract_all(column, F.lit(r"<loc>([^<]+)</loc>"), 1)
    return documents.select(*[c for c in documents.columns if c != column], F.explode(locations).alias("loc")).filter(F.col("loc").rlike(pattern))


def sitemap_entries(documents: DataFrame, column: str = "xml") -> DataFrame:
    """(loc, lastmod, title) of each url block; blocks without a location are dropped."""
    blocks = documents.select(*[c for c in documents.columns if c != column], F.posexplode(F.regexp_extract_all(column, F.lit(r"(?s)<url>(.*?)</url>"), 1)).alias("position", "_b"))
    loc = F.nullif(F.regexp_extract("_b", r"<loc>([^<]+)</loc>", 1), F.lit(""))
    lastmod = F.nullif(F.regexp_extract("_b", r"<lastmod>([^<]+)</lastmod>", 1), F.lit(""))
    return blocks.withColumns({"loc": loc, "lastmod": t.parse_timestamp(lastmod)}).filter("loc IS NOT NULL").withColumn(
        "title", t.humanize_url_slug(F.col("loc"))).drop("_b")
