from pyspark.sql import functions as F

from shelfsight.operators import extract as ex, matching as mt, merge as mg
from shelfsight.sources import captures
from shelfsight.streaming import imports

PAGE = """<html><head><title>Doc - Site</title><meta property="og:title" content="Og &amp; title">
<meta content="4.5" itemprop="ratingValue"><meta itemprop="bestRating" content="5">
<script type="application/ld+json">{"@graph":[{"@type":"Person"},{"@type":["Article"],"headline":" Head  line ","datePublished":"2024-03-05","author":[{"name":"Ann"}],"description":"d"}]}</script>
<script>var x = "<p>this paragraph sits inside a script and must never be read</p>";</script></head>
<body><article><p>Short.<p>This is a sufficiently long paragraph about the &lt;ride&gt; of it.<div>aside</div>
<p>Please subscribe to our newsletter for many more such long articles.</p><p>Another paragraph that is long enough to be kept here.</p></article>
<h3>Pros</h3><ul><li>Light<li>Fast &amp; soft</ul><h2>Our verdict</h2><p>Buy <b>it</b>.</p><time datetime="2024-02-01">x</time></body></html>"""


def page(spark, column):
    return spark.createDataFrame([(PAGE,)], "html string").select(column.alias("x")).collect()[0]["x"]


def test_page_fields(spark):
    html = F.col("html")
    assert page(spark, ex.page_title(html)) == "Og & title"
    assert page(spark, ex.page_title(F.regexp_replace(html, "og:title", "no"), suffix="Site")) == "Doc"
    article = page(spark, ex.json_ld_article(html))
    assert (article["headline"], article["author"], article["published"]) == ("Head line", "Ann", "2024-03-05")
    assert page(spark, ex.page_body(html)) == "This is a sufficiently long paragraph about the <ride> of it.\n\nAnother paragraph that is long enough to be kept here."
    assert page(spark, ex.page_score(html, html))["score"] == 90
    assert page(spark, ex.list_under_heading(html, "pros")) == ["Light", "Fast & soft"]
    assert page(spark, ex.list_under_heading(html, "cons")) == []
    assert page(spark, ex.paragraph_after_heading(html, "our verdict")) == "Buy it."
    with_article = spark.createDataFrame([(PAGE,)], "html string").withColumn("a", ex.json_ld_article(html))
    row = with_article.select(F.date_format(ex.published_at(html, F.col("a")), "yyyy-MM-dd").alias("d"), ex.author_name(html, F.col("a")).alias("n")).collect()[0]
    assert (row["d"], row["n"]) == ("2024-03-05", "Ann")
    within = F.regexp_replace(html, "<article>", "<article><time datetime='2024-04-06'>y</time>")
    assert page(spark, F.date_format(ex.published_at(within, ex.json_ld_article(within)), "yyyy-MM-dd")) == "2024-04-06"


def test_numeric_entities_and_unknown_pages(spark):
    df = spark.createDataFrame([("caf&#233; &amp;lt;",), (None,), ("",)], "html string")
    assert [r["x"] for r in df.select(ex.decode_entities(F.col("html")).alias("x")).collect()] == ["café &lt;", None, ""]
    assert [r["x"] for r in df.select(ex.page_title(F.col("html")).alias("x")).collect()] == [None, None, None]


def test_thread_detail_tells_posts_from_comments(spark):
    payload = '[{"data":{"children":[{"data":{"title":"T","score":3}}]}},{"data":{"children":[{"data":{"body":"hi","stickied":true}},{"data":{"count":4}}]}}]'
    posts, comments = captures.thread_detail(spark.createDataFrame([("t", payload), ("u", "{}")], "thread_id string, payload string"))
    assert [(r["thread_id"], r["title"]) for r in posts.collect()] == [("t", "T")]
    assert [(r["body"], r["stickied"]) for r in comments.collect()] == [("hi", True)]


def test_comment_emptied_by_cleaning_keeps_its_place(spark):
    rows = [("t", 0, "a", 9, False, "  "), ("t", 1, "b", 8, False, "x"), ("t", 2, None, 7, False, "y"), ("t", 3, "d", 6, False, "z"), ("t", 4, "e", 99, True, "pinned")]
    comments = spark.createDataFrame(rows, "thread_id string, position int, author string, score int, stickied boolean, body string")
    assert sorted(r["body"] for r in ex.top_comments(comments).collect()) == ["x", "y"]


def test_sitemaps(spark):
    df = spark.createDataFrame([("<loc>https://x/shoe-sitemap2.xml</loc><loc>https://x/page-sitemap.xml</loc>",)], "xml string")
    assert [r["loc"] for r in captures.sitemap_index(df).collect()] == ["https://x/shoe-sitemap2.xml"]
    urls = spark.createDataFrame([("<url><loc>https://x/shoe-reviews/nike-peg-41/</loc></url><url><lastmod>2024</lastmod></url>",)], "xml string")
    assert [r["title"] for r in captures.sitemap_entries(urls).collect()] == ["nike peg 41"]


def state(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_upserts_are_idempotent(spark):
    target = spark.createDataFrame([("a", 1, True), ("b", None, False)], "k string, v int, active boolean")
    batch = spark.createDataFrame([("b", 5), ("c", 7)], "k string, v int")
    once = mg.overwrite_upsert(target, batch, ["k"], [F.col("v")], {"active": F.lit(True)})
    assert state(once, "k", "v", "active") == [("a", 1, True), ("b", 5, True), ("c", 7, True)]
    assert state(mg.overwrite_upsert(once, batch, ["k"], [F.col("v")], {"active": F.lit(True)}), "k", "v") == state(once, "k", "v")
    filled = mg.fill_null_upsert(target.drop("active"), spark.createDataFrame([("a", 9), ("b", 9), ("z", 0)], "k string, v int"), ["k"], ["v"], [F.col("v")])
    assert state(filled, "k", "v") == [("a", 1), ("b", 9)]


def test_patch_keeps_missing_and_blanks_supplied(spark):
    target = spark.createDataFrame([(1, "x", "n")], "id int, note string, other string")
    patch = spark.createDataFrame([(1, " ", True), (2, "new", True)], "id int, note string, has_note boolean")
    assert state(mg.patch_upsert(target, patch, ["id"], ["note"], [F.lit(0)]).fillna("-"), "id", "note", "other") == [(1, "-", "n"), (2, "new", "-")]


def test_variant_promotion_and_primaries(spark):
    schema = "release_id int, variant_key string, is_primary boolean, weight_oz double"
    existing = spark.createDataFrame([(1, "default", True, 9.0), (2, "default", True, 9.0), (2, "mens", False, 8.0), (3, "womens", True, 7.0)], schema)
    incoming = spark.createDataFrame([(1, "mens", True, 8.5), (2, "mens", True, 8.2), (3, "womens", True, 7.1), (4, "womens", True, 6.0)], schema)
    assert state(mg.promote_variants(existing, incoming, [F.lit(0)]), "release_id", "variant_key", "action") == [
        (1, "mens", "renamed"), (2, "mens", "updated"), (3, "womens", "updated"), (4, "womens", "inserted")]
    primaries = mg.single_primary(existing.unionByName(incoming.filter("release_id = 1")), F.lit(False)).filter("is_primary").groupBy("release_id").count()
    assert {r["count"] for r in primaries.collect()} == {1}
    remaining, refused = mg.delete_variants(existing, existing.filter("variant_key in ('default', 'womens')"))
    assert state(refused, "release_id") == [(1,), (3,)]
    assert state(remaining.filter("is_primary"), "release_id", "variant_key") == [(1, "default"), (2, "mens"), (3, "womens")]


def test_import_batch_replays_to_nothing(spark):
    schema = "release_id string, source_id string, url string, title string, fetched_at int"
    stored = spark.createDataFrame([("r", "s", "u1", "nike pegasus review", 1)], schema)
    batch = spark.createDataFrame([("r", "s", "u2", "nike pegasus thoughts", 2), ("r", "s", "u3", "hoka clifton test", 3), ("r", "s", "u3", "other", 4), ("q", "s", "u4", "nike pegasus review", 5)], schema)
    added = imports.import_batch(batch, stored)
    assert state(added, "url") == [("u3",), ("u4",)]
    assert imports.import_batch(batch, stored.unionByName(added)).count() == 0


def test_anchors_of_every_quote_style(spark):
    html = """<a href=/x>X</a> <a class='b' href='/y?a="1"'>Y <b>z</b></a> <a data-href="no" href="/q">Q</a> <a name="n">none</a>"""
    rows = ex.anchors(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("position").collect()
    assert [(r["href"], r["title"]) for r in rows] == [("/x", "X"), ('/y?a="1"', "Y z"), ("/q", "Q")]


def test_elements_are_balanced(spark):
    pages = {
        "<p>x</p><article id=1>a<article>b</article>c</article>d": "<article id=1>a<article>b</article>c</article>",
        "<ARTICLE>a<articles>b</articles></Article>c": "<ARTICLE>a<articles>b</articles></Article>",
        "<article>never closed <div>": "<article>never closed <div>", "no element": "", "<article></article><article>2</article>": "<article></article>"}
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", ex.element(F.col("html"), ex.ARTICLE).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in rows] == list(pages.values())
    classes = {"<div class='a entry-content b'>x</div>": True, '<section data-x=1 class="entry-content">x': True, "<i class=entry-content>x": True, '<div class="my-entry-content">x': False, '<div class="entry-contents">x': False, '<div title="entry-content">x': False}
    rows = spark.createDataFrame(list(enumerate(classes)), "k int, html string").select("k", (ex.element(F.col("html"), ex.with_class("entry-content")) != "").alias("x")).orderBy("k").collect()
    assert [r["x"] for r in rows] == list(classes.values())


def test_references_are_decoded_once(spark):
    texts = {"&amp;lt; &amp;amp;lt;": "&lt; &amp;lt;", "&#x41;&#X1F600;&#8364;&eacute;&Eacute;&mdash;": "A\U0001f600€éÉ—", "&#0;&#xD800;&#1114112;": "\ufffd\ufffd\ufffd", "&unknown; & &;": "&unknown; & &;", "a&nbsp;b&apos;": "a b'", "&#38;lt;": "&lt;"}
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", ex.decode_entities(F.col("x")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in rows] == list(texts.values())


def test_texts_stay_whole_unless_a_width_is_named(spark):
    long = "word " * 6000 + "Score: 9 out of 10. Weight: 8.5 oz"
    one = spark.createDataFrame([(long, "<article>" + f"<p>{'long paragraph ' * 30}</p>" * 20 + "</article>")], "t string, html string")
    row = one.select(ex.page_score(F.col("t"), F.col("t"))["score"].alias("whole"), ex.page_score(F.col("t"), F.col("t"), ex.SCORE_TEXT)["score"].alias("cut"), ex.lab_specs(F.col("t"))["weight_oz"].alias("oz"),
                     F.length(ex.page_body(F.col("html"))).alias("body"), F.length(ex.page_body(F.col("html"), limit=ex.MAX_PARAGRAPHS, width=ex.BODY_LIMIT)).alias("short")).collect()[0]
    assert (row["whole"], row["cut"], row["oz"]) == (90, None, 8.5) and row["body"] > 8000 and row["short"] == ex.BODY_LIMIT
    deep = captures.raw_documents(spark.createDataFrame([(1, "u", "x" * 30000)], "page_id int, url string, html string"))
    assert len(deep.collect()[0]["raw_text"]) == 30000


def test_links_of_a_result_page(spark):
    links = [(1, 0, "/2024/a.html", "Brand Model 3 review"), (1, 1, "/2024/a.html", "again"), (1, 2, "/2024/b.html", "Brand other"), (1, 3, "https://else.org/c.html", "Brand Model 3"), (1, 4, "/2024/d.txt", "Brand Model 3"), (1, 5, "/2024/e.html", ""),
             *[(1, 10 + k, f"/2024/model-3-{k}.html", "Brand") for k in range(7)], (2, 0, "/2024/x.html", "Brand Model 3")]
    searches = spark.createDataFrame([(1, "brand", ["model 3"], "brand model 3")], "page_id int, brand string, aliases array<string>, query string")
    got = mt.ranked_links(spark.createDataFrame(links, "page_id int, position int, href string, title string"), searches, "https://www.site.com", "site.com/20", ".html").orderBy("rank").collect()
    assert [(r["rank"], r["position"]) for r in got] == [(1, 0), (2, 10), (3, 11), (4, 12), (5, 13)]
    assert got[0]["confidence_points"] > got[1]["confidence_points"]
