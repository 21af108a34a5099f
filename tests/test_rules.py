import json

from pyspark.sql import functions as F

from shelfsight.operators import filters as flt, metadata as md, moderation as mod, planning as pln, reviews as rv, scoring, summary as sm
from shelfsight.operators import catalog as cat


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_dominant_ties(spark):
    lit = F.lit
    assert value(spark, scoring.dominant_positive_first(lit(1), lit(1), lit(1))) == "positive"
    assert value(spark, scoring.dominant_positive_first(lit(0), lit(2), lit(2))) == "mixed"
    assert value(spark, scoring.dominant_positive_first(lit(0), lit(0), lit(0))) is None
    assert value(spark, scoring.dominant_never_null(lit(0), lit(2), lit(2))) == "negative"
    assert value(spark, scoring.dominant_never_null(lit(0), lit(0), lit(0))) == "positive"


def test_agreement_and_confidence(spark):
    lit = F.lit
    assert value(spark, scoring.agreement(lit(0), lit(0), lit(0))) == "mixed"
    assert value(spark, scoring.agreement(lit(2), lit(0), lit(1))) == "split"
    assert value(spark, scoring.agreement(lit(3), lit(0), lit(1))) == "strong"
    assert value(spark, scoring.agreement(lit(1), lit(1), lit(0))) == "mixed"
    assert value(spark, scoring.confidence_level(lit(5), lit(3), lit(None).cast("string"))) == "high"
    assert value(spark, scoring.confidence_level(lit(5), lit(3), lit("low"))) == "medium"
    assert value(spark, scoring.confidence_level(lit(3), lit(1), lit(None).cast("string"), lit("split"))) == "low"


def test_coverage_thresholds(spark):
    lit = F.lit
    assert value(spark, scoring.coverage_grade(lit(3), lit(2), lit(365))) == "strong"
    assert value(spark, scoring.coverage_grade(lit(3), lit(2), lit(366))) == "stale"
    assert value(spark, scoring.coverage_grade(lit(1), lit(2), lit(None).cast("int"))) == "developing"
    assert value(spark, scoring.coverage_status(lit(2), lit(1), lit(1))) == "thin"
    assert value(spark, scoring.coverage_status(lit(3), lit(1), lit(1))) == "healthy"


def test_cushion_and_ranges(spark):
    rows = spark.createDataFrame([(1, 29, None), (2, 30, None), (3, 35, 1), (4, 36, 1), (5, None, 36), (6, None, None)], "id int, heel_mm int, forefoot_mm int")

    def ids(rule):
        return {r["id"] for r in rows.filter(rule).collect()}

    assert ids(flt.cushion_band("low")) == {1}
    assert ids(flt.cushion_band("moderate")) == {2, 3}
    assert ids(flt.cushion_band("max")) == {4, 5}
    assert ids(flt.cushion_band("odd")) == {1, 2, 3, 4, 5}
    assert ids(flt.cushion_band(" ")) == {1, 2, 3, 4, 5, 6}
    assert ids(flt.in_range("heel_mm", "30", None)) == {2, 3, 4}
    assert ids(flt.in_range("heel_mm", "n/a", "")) == {1, 2, 3, 4, 5, 6}


def test_formatters(spark):
    assert value(spark, cat.format_usd(F.lit("130.00").cast("decimal(8,2)"))) == "$130"
    assert value(spark, cat.format_usd(F.lit("129.50").cast("decimal(8,2)"))) == "$129.5"
    assert value(spark, cat.format_mm(F.lit(0))) == "unknown"
    assert value(spark, cat.format_stack(F.lit(38), F.lit(30))) == "38/30 mm"


def test_previous_release_matches_a_plain_window(spark):
    rows = [("f", 2024 if i % 3 else None, i % 2 == 0, f"v{i % 7}", i) for i in range(60)] + [("g", 2020, True, "only", 99)]
    df = spark.createDataFrame(rows, "family_id string, release_year int, is_current boolean, version_name string, release_id int")
    got = {r["release_id"]: r["previous"] and r["previous"]["release_id"] for r in cat.with_previous(df, ["release_id"]).collect()}
    for family in ("f", "g"):
        line = sorted((r for r in rows if r[0] == family), key=lambda r: (r[1] is not None, -(r[1] or 0), not r[2], r[3], r[4]))
        for now, before in zip(line, [*line[1:], None]):
            assert got[now[4]] == (before[4] if before else None)


def metadata(spark, document):
    df = spark.createDataFrame([(1, document)], "release_id int, metadata string")
    return md.read_release_metadata(df).collect()[0]


SUMMARY = {"overview": " Good ", "overallSentiment": "positive", "confidence": "high", "generatedAt": "t", "provider": "heuristic",
           "pros": [" a ", 3, "", "b", "c", "d", "e"], "reviewCount": "9", "sourceCount": 3, "buyerSignal": 4}


def test_metadata_reads_are_strict_about_types(spark):
    row = metadata(spark, json.dumps({"aiReviewSummary": SUMMARY}))
    s = row["summary"]
    assert (s["overview"], s["pros"], s["review_count"], s["source_count"], s["buyer_signal"]) == ("Good", ["a", "b", "c", "d"], 0, 3, None)
    assert s["source_alignment"] == "mixed" and s["is_override"] is False
    for bad in (None, "{", "[]", "3", json.dumps({"aiReviewSummary": {**SUMMARY, "confidence": "sure"}}), json.dumps({"aiReviewSummary": {**SUMMARY, "overview": " "}})):
        assert metadata(spark, bad)["summary"] is None


def test_override_overlay_and_truthiness(spark):
    override = {"isEnabled": 1, "overview": "Edited", "pros": [], "cons": ["x"]}
    s = metadata(spark, json.dumps({"aiReviewSummary": SUMMARY, "editorialAiReviewSummaryOverride": override}))["summary"]
    assert (s["overview"], s["pros"][0], s["cons"], s["is_override"]) == ("Edited", "a", ["x"], True)
    off = metadata(spark, json.dumps({"aiReviewSummary": SUMMARY, "editorialAiReviewSummaryOverride": {**override, "isEnabled": 0}}))
    assert off["summary"]["overview"] == "Good" and off["override"] is None


def test_histories_are_bounded(spark):
    long = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: i.cast("string"))
    assert value(spark, md.prepend_history(long, F.lit("new")))[:2] == ["new", "1"]
    assert len(value(spark, md.prepend_history(long, F.lit("new")))) == 20
    assert value(spark, md.append_history(long, F.lit("new")))[-1] == "new"
    assert len(value(spark, md.append_history(long, F.lit("new")))) == 10
    assert value(spark, md.append_history(F.array(F.lit("a")), F.lit("b"))) == ["a", "b"]
    events = json.dumps({"aiReviewSummaryHistory": [{"timestamp": "t", "eventType": "generated", "reviewCount": 2}, {"timestamp": "t", "eventType": "odd"}, 4]})
    df = spark.createDataFrame([(events,)], "metadata string").select(F.try_parse_json("metadata").alias("v"))
    assert [e["review_count"] for e in df.select(md.summary_history("v").alias("h")).collect()[0]["h"]] == [2]


def test_candidate_validation(spark):
    good = {"overview": "O", "overallSentiment": "mixed", "confidence": "low", "editorialSentiment": None, "communitySentiment": "positive", "sourceAlignment": "aligned",
            "buyerSignal": None, "pros": [" p "] * 6, "cons": [], "bestFor": [], "watchOuts": [], "consensusPoints": [], "debates": [""]}
    cases = [(f"Sure: {json.dumps(good)} done", None), (json.dumps({**good, "pros": "x"}), "pros"), (json.dumps({**good, "buyerSignal": " "}), "buyerSignal"),
             (json.dumps({k: v for k, v in good.items() if k != "editorialSentiment"}), "editorialSentiment"), ("no braces", "not json"), (json.dumps({**good, "debates": [1]}), "debates")]
    rows = sm.validate_candidates(spark.createDataFrame([(c,) for c, _ in cases], "candidate string")).collect()
    assert [r["error"] for r in rows] == [e for _, e in cases]
    assert rows[0]["pros"] == ["p"] * 4 and rows[0]["debates"] == []


def test_weighted_average_stays_inside_its_values_and_is_null_when_empty(spark):
    df = spark.createDataFrame([("a", 80, 10000), ("a", 60, 5500), ("a", None, 7000), ("b", None, 7000)], "k string, v int, w bigint")
    got = {r["k"]: r["x"] for r in df.groupBy("k").agg(rv.weighted_average(F.col("v"), F.col("w")).alias("x")).collect()}
    assert 60 <= got["a"] <= 80 and got["b"] is None


def test_backoff_and_due_edges(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")

    def reason(status, at):
        return value(spark, pln.backoff_reason(F.lit(status), F.lit(at).cast("timestamp"), as_of))

    assert reason("failed", "2024-01-01 00:00:00") is None
    assert reason("failed", "2024-01-01 00:00:01") == "recent failed run backoff"
    assert reason("partial", "2024-01-01 18:00:00") is None
    assert reason("partial", "2024-01-01 18:00:01") == "recent partial run backoff"
    assert reason("running", "2020-01-01 00:00:00") == "run already in progress"
    sources = spark.createDataFrame([(1, 1, "a", "daily", True), (2, 2, "b", "daily", True)], "crawl_source_id bigint, source_id bigint, importer_key string, cadence_label string, is_active boolean")
    runs = spark.createDataFrame([(1, 1, "queued")], "run_id bigint, crawl_source_id bigint, status string").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    due = {r["crawl_source_id"]: r["due_reason"] for r in pln.source_due(sources, runs, as_of).collect()}
    assert due == {1: "due now", 2: "never run"}


def test_moderation_last_event_wins_and_blank_clears(spark):
    reviews = spark.createDataFrame([("r1", "pending", "positive", ["a"]), ("r2", "approved", None, [])], "review_id string, status string, sentiment string, highlights array<string>")
    events = spark.createDataFrame([
        ("r1", 1, "status", "approved", None, None, None), ("r1", 2, "override", None, "mixed", "x", "r9"), ("r1", 3, "override", None, " ", "", "r1")],
        "review_id string, seq int, kind string, status string, sentiment string, highlights_text string, duplicate_of string")
    got = {r["review_id"]: r for r in mod.apply_moderation(reviews, events).collect()}
    assert (got["r1"]["status"], got["r1"]["sentiment"], got["r1"]["highlights"], got["r1"]["duplicate_of"]) == ("flagged", None, [], None)
    assert (got["r2"]["status"], got["r2"]["override_count"]) == ("approved", 0)
