"""Ties of themes and terms follow the feed: newest publication, newest row, id, then the place within the review."""

from pyspark.sql import functions as F

from shelfsight.operators import reviews as rv, summary as sm

ROWS = [  # review_id, published, created, labels
    ("r2", "2024-05-01", "2024-06-01", ["A", "B"]), ("r1", "2024-05-01", "2024-06-01", ["C", "A"]),
    ("r3", "2024-05-01", "2024-06-02", ["D"]), ("r4", None, "2024-01-01", ["E"]), ("r5", "2024-05-02", "2024-01-01", ["F"]),
]


def features(spark):
    rows = spark.createDataFrame([(1, i, p, c, v, v, "positive", "s:" + i) for i, p, c, v in ROWS],
                                 "release_id int, review_id string, p string, c string, themes array<string>, terms array<string>, sentiment string, source_key string")
    return rows.withColumns({"published_at": F.col("p").cast("timestamp"), "created_at": F.col("c").cast("timestamp")})


def test_theme_ties(spark):
    top = rv.top_themes(rv.score_themes(rv.theme_rollup(rv.theme_rows(features(spark)))), limit=9)
    assert [r["theme"] for r in top.orderBy("rank").collect()] == ["A", "E", "F", "D", "C", "B"]


def test_term_ties(spark):
    rows = sm.term_rollup(features(spark)).orderBy(F.desc("mentions"), "first_position").collect()
    assert [r["term"] for r in rows] == ["A", "E", "F", "D", "C", "B"]
