"""Ingestion analytics: coverage, due sources, gap priorities, backoff and work plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfsight.functions import lexicons as lx, text as t
from shelfsight.operators import scoring
from shelfsight.operators.catalog import approved_stats

# --- fixed values: plan limits and intervals --------------------------------------
RELEASES_PER_RUN = 12
RELEASES_PER_SOURCE = 6
RUN_LOOKBACK = 120
FAILED_BACKOFF_HOURS = 24
PARTIAL_BACKOFF_HOURS = 6
TARGET_APPROVED = 2
CADENCE_HOURS = {"hourly": 1, "daily": 24, "weekly": 168}
HOUR_MICROS = 3_600_000_000


def under_covered(release: DataFrame, reviews: DataFrame, target: int = TARGET_APPROVED) -> DataFrame:
    """Releases with fewer approved reviews than the target, newest year first and unknown years last."""
    counted = release.join(approved_stats(reviews).select("release_id", "review_count"), "release_id", "left").withColumn(
        "review_count", F.coalesce("review_count", F.lit(0)))
    return counted.filter(F.col("review_count") < target).orderBy(F.col("release_year").desc_nulls_last(), "family_id", "version_name")


def coverage_rollup(reviews: DataFrame, source: DataFrame) -> DataFrame:
    """Counts per release by status and channel with distinct approved sources and their sorted names."""
    approved = F.col("status") == "approved"
    return (
        reviews.select("release_id", "source_id", "status").join(source, "source_id")
        .groupBy("release_id", "source_id", "source_name", "source_type")
        .agg(F.count_if(approved).alias("a"), F.count_if(F.col("status") == "pending").alias("p"))
        .groupBy("release_id")
        .agg(
            F.sum("a").alias("approved_count"),
            *[F.sum(F.when(F.col("source_type") == name, F.col("a")).otherwise(0)).alias(f"{name}_count") for name in lx.SOURCE_TYPES],
            F.sum("p").alias("pending_count"),
            F.count_if(F.col("a") > 0).alias("source_count"),
            F.array_sort(F.collect_set(F.when(F.col("a") > 0, F.col("source_name")))).alias("source_names"),
            F.collect_set(F.when(F.col("a") > 0, F.col("source_id"))).alias("approved_sources"),
            F.collect_set(F.when(F.col("p") > 0, F.col("source_id"))).alias("pending_sources"),
            F.collect_set(F.when(F.col("a") > 0, F.struct("source_name", "source_id"))).alias("approved_named"),
        )
    )


COUNT_COLUMNS = ("approved_count", "editorial_count", "reddit_count", "user_count", "pending_count", "source_count")


def with_empty_coverage(releases: DataFrame, rollup: DataFrame) -> DataFrame:
    """Releases without any review get zero counts and empty lists."""
    joined = releases.join(rollup, "release_id", "left")
    lists = {c: F.coalesce(F.col(c), F.array().cast(rollup.schema[c].dataType)) for c in ("source_names", "approved_sources", "pending_sources", "approved_named")}
    return joined.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in COUNT_COLUMNS}, **lists})


def current_and_recent(release: DataFrame, limit: int = 20) -> DataFrame:
    """Current releases plus the newest twenty of any kind, each once."""
    recent = release.orderBy(F.col("release_year").desc_nulls_first(), "family", "release_id").limit(limit).select("release_id")
    return release.filter("is_current").select("release_id").union(recent).distinct()


def crawl_targets(crawl_source: DataFrame, source: DataFrame) -> Column:
    """Active crawl sources by name as one array, for per-release set differences instead of a product with releases."""
    named = crawl_source.filter("is_active").select("source_id").distinct().join(source.select("source_id", "source_name"), "source_id")
    return named.agg(F.array_sort(F.collect_list(F.struct("source_name", "source_id")))).scalar()


def coverage_board(release: DataFrame, reviews: DataFrame, source: DataFrame, crawl_source: DataFrame) -> DataFrame:
    """Coverage status per current or recent release with missing sources, worst first."""
    shown = current_and_recent(release).join(release, "release_id").select("release_id", F.concat_ws(" ", "family", "version_name").alias("label"))
    rows = with_empty_coverage(shown, coverage_rollup(reviews, source))
    status = scoring.coverage_status(F.col("approved_count"), F.col("editorial_count"), F.col("reddit_count"))
    board = rows.withColumn("coverage_status", status).withColumn(
        "missing", F.array_except(crawl_targets(crawl_source, source), F.col("approved_named")))
    return board.orderBy(scoring.coverage_severity(F.col("coverage_status")), "label")


# --- runs -------------------------------------------------------------------------------

def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    """Last `limit` runs per crawl source."""
    newest = Window.partitionBy("crawl_source_id").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    return runs.withColumn("run_rank", F.row_number().over(newest)).filter(F.col("run_rank") <= limit)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("crawl_source_id").agg(
        F.max_by(F.struct("run_id", "status", "created_at"), F.struct("created_at", "run_id")).alias("_r")
    ).select("crawl_source_id", F.col("_r.run_id").alias("last_run_id"), F.col("_r.status").alias("last_status"), F.col("_r.created_at").alias("last_run_at"))


def latest_run_per_release(runs: DataFrame, lookback: int = RUN_LOOKBACK) -> DataFrame:
    """Newest run of each (source, release) within the source's last runs."""
    latest = Window.partitionBy("crawl_source_id", "release_id").orderBy("run_rank")
    return newest_runs(runs, lookback).withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")


def cadence(label: Column) -> Column:
    known = t.trim_ws(F.lower(label))
    return F.when(known.isin(*lx.CADENCES), known).otherwise("manual")


def next_run_at(cadence_name: Column, last_run_at: Column) -> Column:
    hours = F.when(cadence_name == "hourly", CADENCE_HOURS["hourly"]).when(cadence_name == "daily", CADENCE_HOURS["daily"]).when(
        cadence_name == "weekly", CADENCE_HOURS["weekly"])
    return F.timestamp_micros(F.unix_micros(last_run_at) + hours * F.lit(HOUR_MICROS))


def source_due(crawl_source: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Due state of every crawl source; the last run of any status counts."""
    named = crawl_source.join(latest_run(runs), "crawl_source_id", "left").withColumn("cadence", cadence(F.col("cadence_label")))
    timed = named.withColumn("next_run_at", F.when(F.col("is_active"), next_run_at(F.col("cadence"), F.col("last_run_at"))))
    reason = (
        F.when(~F.col("is_active"), "inactive").when(F.col("cadence") == "manual", "manual cadence")
        .when(F.col("last_run_at").isNull(), "never run").when(as_of >= F.col("next_run_at"), "due now").otherwise("not due")
    )
    return timed.withColumn("due_reason", reason).withColumn("is_due", F.col("due_reason").isin("never run", "due now"))


def gap_priority(source_id: Column) -> Column:
    """Points of a release for one source; needs coverage counts and source arrays."""
    def when(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    c = F.col
    return (
        when(c("approved_count") == 0, 100) + when(c("editorial_count") == 0, 40) + when(c("reddit_count") == 0, 35)
        + when(~F.array_contains("approved_sources", source_id), 45)
        + F.when(c("source_count") < 2, 20).when(c("source_count") < 3, 10).otherwise(0)
        + when(c("approved_count") < 3, 20) - when(F.array_contains("pending_sources", source_id), 10) - c("pending_count") * 5
    )


def gap_ranking(release: DataFrame, reviews: DataFrame, source: DataFrame, sources: DataFrame, per_run: int = RELEASES_PER_RUN,
                per_source: int = RELEASES_PER_SOURCE) -> DataFrame:
    """Top current releases per crawl source by coverage gap.

    The candidate releases are a fixed handful, so each due source carries them as an array:
    work grows with the sources, and no product of two tables is formed.
    """
    newest = release.filter("is_current").orderBy(F.col("release_year").desc_nulls_first(), "release_id").limit(per_run).select("release_id", "release_year")
    wanted = reviews.join(F.broadcast(newest.select("release_id")), "release_id", "left_semi")
    candidates = with_empty_coverage(newest, coverage_rollup(wanted, source))
    bundle = candidates.agg(F.collect_list(F.struct(*candidates.columns))).scalar()
    scored = sources.select("crawl_source_id", "source_id", F.explode(bundle).alias("_c")).select("crawl_source_id", "source_id", "_c.*").withColumn(
        "priority", gap_priority(F.col("source_id")))
    best = Window.partitionBy("crawl_source_id").orderBy(F.col("priority").desc(), F.col("release_year").desc_nulls_first(), "release_id")
    return scored.withColumn("slot", F.row_number().over(best)).filter(F.col("slot") <= per_source).select(
        "crawl_source_id", "release_id", "priority", "slot")


def backoff_reason(status: Column, created_at: Column, as_of: Column) -> Column:
    age = t.age_micros(created_at, as_of)
    return (
        F.when((status == "failed") & (age < FAILED_BACKOFF_HOURS * HOUR_MICROS), "recent failed run backoff")
        .when((status == "partial") & (age < PARTIAL_BACKOFF_HOURS * HOUR_MICROS), "recent partial run backoff")
        .when(status == "running", "run already in progress")
    )


def work_plan(release: DataFrame, reviews: DataFrame, source: DataFrame, crawl_source: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Next round: one row per skipped source and per (due source, release slot); a skipped release still uses its slot."""
    due = source_due(crawl_source, runs, as_of)
    skipped = due.filter(~F.col("is_due")).select(
        "crawl_source_id", F.lit(None).cast("bigint").alias("release_id"), F.lit(None).cast("int").alias("slot"),
        F.lit("skip-source").alias("action"), F.col("due_reason").alias("reason"))
    ranked = gap_ranking(release, reviews, source, due.filter("is_due"))
    last = latest_run_per_release(runs).select("crawl_source_id", "release_id", "status", "created_at")
    judged = ranked.join(last, ["crawl_source_id", "release_id"], "left").withColumn(
        "reason", backoff_reason(F.col("status"), F.col("created_at"), as_of))
    planned = judged.select("crawl_source_id", "release_id", "slot", F.when(F.col("reason").isNull(), "run").otherwise("skip-release").alias("action"), "reason")
    return skipped.unionByName(planned)


def run_status(discovered: Column, stored: Column, fallback: Column | None = None) -> Column:
    partial = stored == 0
    if fallback is not None:
        partial = partial | (fallback > 0)
    return F.when(discovered == 0, "succeeded").when(partial, "partial").otherwise("succeeded")


def confidence_stats(points: Column) -> list[Column]:
    """Average and maximum candidate confidence at two decimals from integer hundredths; null when empty."""
    return [(t.round_half_up(F.avg(points)) / 100).alias("average_confidence"), (F.max(points) / 100).alias("max_confidence")]


def run_metrics(candidates: DataFrame, no_hit_reason: str) -> DataFrame:
    """Per (run, release): discovered, stored, fallback, confidences, status and the reason for an empty run."""
    hit = F.col("confidence_e2").isNotNull()
    counted = candidates.groupBy("run_id", "release_id").agg(
        F.count_if(hit).alias("discovered"), F.count_if(hit & F.col("is_stored")).alias("stored"),
        F.count_if(hit & F.col("used_fallback")).alias("fallback"), *confidence_stats(F.col("confidence_e2")))
    return counted.withColumns({
        "status": run_status(F.col("discovered"), F.col("stored"), F.col("fallback")),
        "no_hit_reason": F.when(F.col("discovered") == 0, no_hit_reason),
    })


def backfill_plan(release: DataFrame, reviews: DataFrame, trusted: list[str], target: int = TARGET_APPROVED) -> DataFrame:
    """Under-covered releases with the approvals their trusted pending reviews would bring."""
    approved = F.col("status") == "approved"
    pending = (F.col("status") == "pending") & F.col("importer").isin(*trusted)
    counted = reviews.groupBy("release_id").agg(F.count_if(approved).alias("before"), F.count_if(pending).alias("approvable"))
    rows = release.select("release_id").join(counted, "release_id", "left").withColumns(
        {"before": F.coalesce("before", F.lit(0)), "approvable": F.coalesce("approvable", F.lit(0))})
    return rows.filter(F.col("before") < target).withColumns({
        "after": F.col("before") + F.col("approvable"),
        "improved": F.col("approvable") > 0,
        "remaining": F.col("before") + F.col("approvable") < target,
    })


def outcome_counters(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("processed"), F.count_if("improved").alias("improved"), F.count_if("remaining").alias("remaining"),
                    F.coalesce(F.sum("approvable"), F.lit(0)).alias("approved_pending"))


def trusted_pending(reviews: DataFrame, trusted: list[str]) -> DataFrame:
    importer = F.get_json_object("metadata", "$.importer")
    return reviews.filter((F.col("status") == "pending") & importer.isin(*trusted))
