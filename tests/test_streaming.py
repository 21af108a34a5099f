"""Epoch writes: a repeated epoch leaves one copy, late and url-less rows stay, the health table holds each source's last state."""

from collections import Counter
from datetime import datetime, timedelta

from shelfsight.streaming import health, imports

SCHEMA = "release_id string, source_id string, url string, title string, fetched_at timestamp"
DAY = datetime(2024, 1, 10)


def rows(spark, *items):
    return spark.createDataFrame([("r", "s", url, title, DAY + timedelta(hours=h)) for url, title, h in items], SCHEMA)


def titles(spark, folder):
    return Counter(r["title"] for r in imports.read_imported(spark, folder, SCHEMA).collect())


def test_an_epoch_that_runs_again_replaces_its_own(spark, tmp_path):
    store, late = f"{tmp_path}/store", f"{tmp_path}/late"
    first = rows(spark, ("u1", "alpha beta gamma", 0), ("u2", "delta epsilon zeta", 1), ("u1", "theta iota", 2), (None, "kappa lambda", 3), (None, "mu nu xi", 3), (None, "mu nu xi", 4))
    want = Counter(["alpha beta gamma", "delta epsilon zeta", "kappa lambda", "mu nu xi"])
    for _ in range(3):  # the write went through, the commit did not
        imports.import_epoch(first, 0, store, late, "feed")
        assert titles(spark, store) == want
    second = rows(spark, ("u1", "again one", 5), ("u3", "alpha beta delta", 5), ("u4", "omicron pi rho", 6), ("u5", "sigma tau", -30))
    for _ in range(2):
        imports.import_epoch(second, 1, store, late, "feed")
    assert titles(spark, store) == want + Counter(["omicron pi rho"]) and titles(spark, late) == Counter(["sigma tau"])
    imports.import_epoch(first.unionByName(second), 0, store, late, "other", lateness=None)  # another stream: only the late row is new
    assert titles(spark, store) == want + Counter(["omicron pi rho", "sigma tau"])


def test_health_keeps_the_last_change(spark, tmp_path):
    schema = "crawl_source_id int, run_id int, status string, created_at timestamp"
    folder = f"{tmp_path}/runs"
    spark.createDataFrame([(1, 1, "running", DAY), (2, 2, "failed", DAY)], schema).write.parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        health.start_health(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
        return {r["crawl_source_id"]: (r["last_run_id"], r["last_status"], r["running_runs"], r["succeeded_runs"]) for r in health.read_health(spark, f"{tmp_path}/table").collect()}

    assert run() == {1: (1, "running", 1, 0), 2: (2, "failed", 0, 0)}
    spark.createDataFrame([(1, 3, "succeeded", DAY + timedelta(1))], schema).write.mode("append").parquet(folder)
    assert run() == {1: (3, "succeeded", 1, 1), 2: (2, "failed", 0, 0)} == run()
