from pyspark.sql import functions as F

from shelfsight.functions import text as t


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    row = spark.createDataFrame([tuple(v[1] for v in values.values())], schema) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0]["x"]


def text(spark, build, value):
    return one(spark, build(F.col("c")), c=("string", value))


def test_cleaning_and_search_text(spark):
    assert text(spark, t.clean_text, " a  b\t\nc ") == "a b c"
    assert text(spark, t.normalize_search_text, "SC-Elite v4 a1b2 été") == "sc elite v 4 a 1 b 2 t"
    assert text(spark, t.search_aliases, "Pegasus 41") == ["pegasus 41", "pegasus41"]
    assert text(spark, t.search_aliases, " !! ") == []
    assert text(spark, t.blank_to_null, "  ") is None


def test_slugs_and_case(spark):
    assert text(spark, t.slugify, "  Gel-Nimbus  26! ") == "gel-nimbus-26"
    assert text(spark, t.slugify_spelled_and, "Track & Field") == "track-and-field"
    assert text(spark, t.humanize, "daily-TRAINER") == "Daily TRAINER"
    assert text(spark, t.lower_first, "Daily use") == "daily use"
    assert text(spark, lambda c: t.humanize_url_slug(c), "https://x.example/2024/03/nike-peg-41.html") == "nike peg 41"
    assert text(spark, lambda c: t.resolve_url(c, "https://x.example"), "/a") == "https://x.example/a"
    assert text(spark, lambda c: t.resolve_url(c, "https://x.example"), "mailto:a@b") is None
    assert text(spark, t.base_domain, "https://www.x.example/a") == "x.example"


def test_truncation_boundary(spark):
    assert text(spark, lambda c: t.truncate_text(c, 5), "abcde") == "abcde"
    assert text(spark, lambda c: t.truncate_text(c, 5), "abcdef") == "abcd…"
    assert text(spark, lambda c: t.truncate_text(c, 5), "") is None


def test_sentiment_needs_a_margin_of_two(spark):
    assert text(spark, lambda c: t.derive_sentiment([c]), "great fun") == "positive"
    assert text(spark, lambda c: t.derive_sentiment([c]), "great but harsh") == "mixed"
    assert text(spark, lambda c: t.derive_sentiment([c]), "harsh and stiff") == "negative"
    # a substring hit: "unstable" counts for both sides
    assert text(spark, lambda c: t.derive_sentiment([c]), "unstable pain") == "mixed"


def test_highlights_stop_after_three_in_declared_order(spark):
    assert text(spark, lambda c: t.extract_highlights([c]), "grip, price, fit and foam") == ["Cushioning", "Fit", "Value"]
    assert text(spark, lambda c: t.infer_terms([c]), "overpriced, roomy") == ["Fit", "Value"]


def test_fingerprint_similarity(spark):
    def similar(a, b):
        return one(spark, t.fingerprints_similar(F.col("a"), F.col("b")), a=("string", a), b=("string", b))

    assert similar("nike pegasus review", "nike pegasus thoughts")
    assert not similar("nike review", "nike thoughts")
    assert similar("review", "review")
    assert not similar("review", "review nike")
    assert not similar("", "")
    assert similar("nike peg", "peg nike")


def test_dedupe_texts_ignores_case_and_punctuation(spark):
    a, b = F.array(F.lit(" Soft-ride "), F.lit("soft ride"), F.lit("")), F.array(F.lit("Grip"), F.lit("GRIP"), F.lit("x"), F.lit("y"))
    assert one(spark, t.dedupe_texts([a, b])) == ["Soft-ride", "Grip", "x"]


def test_numbers(spark):
    assert text(spark, t.parse_number, " 12.5 ") == 12.5
    assert text(spark, t.parse_number, "abc") is None
    assert one(spark, t.normalize_score(F.lit(9.25), F.lit(10.0))) == 93
    assert one(spark, t.normalize_score(F.lit(None).cast("double"), F.lit(10.0))) is None
    assert one(spark, t.auto_scale_score(F.lit(8.55))) == 86
    assert one(spark, t.auto_scale_score(F.lit(84.5))) == 85
    assert one(spark, t.clamp_confidence(F.lit(120))) == 1.0


def test_freshness_boundaries(spark):
    as_of = F.lit("2024-12-31 00:00:00").cast("timestamp")
    for days, expected in ((0, 100), (120, 100), (121, 85), (365, 85), (366, 70), (730, 70), (731, 55)):
        published = F.timestamp_seconds(F.unix_seconds(as_of) - days * 86400)
        assert one(spark, t.freshness_e2(published, as_of)) == expected
    assert one(spark, t.freshness_e2(F.lit(None).cast("timestamp"), as_of)) == 65
    assert one(spark, t.review_weight_e4(F.lit("user"), F.lit(None).cast("timestamp"), as_of)) == 3575


def test_timestamps_are_lenient(spark):
    for raw in ("2024-03-05", "2024-03-05T00:00:00Z", "March 5, 2024", "3/5/2024"):
        assert text(spark, lambda c: t.iso_date(t.parse_timestamp(c)), raw) == "2024-03-05"
    assert text(spark, t.parse_timestamp, "soon") is None


def test_trims_and_cleans_only_whitespace_at_borders(spark):
    rows = [(" 　 a \t b \n", "a \t b", "a b"), (" ﻿", "", ""), ("a b", "a b", "a b"), ("é  è", "é  è", "é è"), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "c string")
    assert [tuple(r) for r in df.select(t.trim_ws(F.col("c")), t.clean_text(F.col("c"))).collect()] == [r[1:] for r in rows]


def test_metadata_is_parsed_by_many_tasks(spark, tmp_path):
    from shelfsight.sources.fixtures import Fixtures

    spark.range(500).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = Fixtures(spark, str(tmp_path)).metadata()
    assert rows.rdd.getNumPartitions() > 1 and rows.select("release_id").distinct().count() == 500


def test_notes_alone_equal_those_of_the_whole_document(spark):
    from shelfsight.operators import metadata as md

    docs = ['{"editorialReviewSummary":{"summaryNote":"n","pinnedTakeaways":[" a ",3,""],"ignoredThemes":["Fit"]}}', "{broken", "[1]", "{}", None]
    df = spark.createDataFrame(list(enumerate(docs)), "release_id int, metadata string")
    want = md.read_release_metadata(df).select("release_id", "notes").collect()
    assert sorted(md.read_release_notes(df).collect(), key=str) == sorted(want, key=str) and want[0]["notes"]["pinned_takeaways"] == ["a"]


def test_documents_are_dealt_out_before_their_texts_are_read(spark, tmp_path):
    from shelfsight.sources.fixtures import Fixtures

    rows = spark.range(300).selectExpr("id AS doc_id", "concat('Title ', id, '\n', 'Body') AS text", "'en' AS lang", "'s' AS source")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    fx = Fixtures(spark, str(tmp_path))
    dealt = fx.document(spread=True)
    assert dealt.rdd.getNumPartitions() > 1
    assert sorted(dealt.collect()) == sorted(fx.document().collect())


def test_a_narrow_summary_has_the_values_of_the_whole_one(spark):
    from shelfsight.operators import metadata as md

    base = '"overview":" o ","overallSentiment":"mixed","confidence":"low","generatedAt":"g","provider":"heuristic","pros":[" a ",1,"\u3000b\u00a0"],"reviewCount":3'
    over = '"editorialAiReviewSummaryOverride":{"isEnabled":%s,"overview":"e","pros":["p"]}'
    docs = ["{broken", "{}", None, '{"aiReviewSummary":{%s}}' % base, '{"aiReviewSummary":{%s},%s}' % (base, over % "true"), '{"aiReviewSummary":{%s},%s}' % (base, over % "false"),
            '{"aiReviewSummary":{%s},%s}' % (base.replace("low", "odd"), over % "true")]
    df = spark.createDataFrame(list(enumerate(docs)), "release_id int, metadata string")
    fields = ["overview", "pros", "review_count", "is_override"]
    want = {r["release_id"]: r["summary"] for r in md.read_release_metadata(df).collect()}
    got = {r["release_id"]: r["summary"] for r in md.read_release_summary(df, fields[:3]).collect()}
    assert {k: v and [v[f] for f in fields] for k, v in got.items()} == {k: v and [v[f] for f in fields] for k, v in want.items()}
    assert got[3]["pros"] == ["a", "b"] and got[4]["pros"] == ["p"] and got[0] is None and got[6] is None
    assert got[3].asDict().keys() == set(fields)
