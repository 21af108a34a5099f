"""Streaming jobs run to completion over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfsight.plans import duck as d
from shelfsight.plans.registry import query
from shelfsight.session import ensure_checkpoint_dir
from shelfsight.streaming import health, imports


def shared_folder(fx, name: str) -> str:
    """A fresh folder where the cluster keeps its checkpoints."""
    ensure_checkpoint_dir(fx.spark)
    return f"{fx.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("str_2_run_health", f"""SELECT crawl_source_id, arg_max(run_id, created_at) AS last_run_id, arg_max(status, created_at) AS last_status,
    {', '.join(f"count(*) FILTER (status = '{s}') AS {s}_runs" for s in ('queued', 'running', 'succeeded', 'partial', 'failed'))} FROM v_run GROUP BY crawl_source_id""")
def _(fx):
    source = fx.spark.readStream.schema(fx.table("events").schema).parquet(f"{fx.sf_dir}/events.parquet*")
    folder = shared_folder(fx, "health")
    health.start_health(fx.run_rows(source), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return health.read_health(fx.spark, f"{folder}/table")


d.VIEWS["v_capture"] = f"""SELECT *, list_distinct(string_split(fp, ' ')) AS toks FROM (SELECT doc_id, lang AS release_id, source AS source_id, CASE WHEN doc_id % 17 <> 0 THEN 'https://x/' || (doc_id // 3) END AS url, title,
    array_to_string(list_filter(string_split({d.norm("title")}, ' '), lambda w: length(w) > 1), ' ') AS fp FROM (SELECT *, regexp_extract(text, '^[^.]*', 0) AS title FROM documents))"""
# Stored before: the first row of each url, and the rows without one, among every tenth.
d.VIEWS["v_stored_before"] = "SELECT * FROM v_capture WHERE doc_id % 10 = 0 QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1"
d.VIEWS["v_fresh"] = """SELECT *, row_number() OVER (PARTITION BY release_id, source_id ORDER BY doc_id) AS step FROM (
    SELECT * FROM v_capture WHERE url IS NULL OR url NOT IN (SELECT url FROM v_stored_before WHERE url IS NOT NULL) QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1)"""
_TITLED = "{'url': url, 'fp': fp, 'toks': toks}"


# One capture after the other in each block; the table of a block is a list that grows by what is kept.
@query("str_1_incremental_import", f"""WITH RECURSIVE start AS (
      SELECT f.release_id, f.source_id, coalesce(any_value(s.st), []) AS st FROM v_fresh f LEFT JOIN (
        SELECT release_id, source_id, list({_TITLED} ORDER BY doc_id) AS st FROM v_stored_before GROUP BY ALL) s ON s.release_id = f.release_id AND s.source_id = f.source_id GROUP BY ALL
    ), walk AS (
      SELECT release_id, source_id, 0::BIGINT AS step, NULL::BIGINT AS doc_id, false AS kept, st FROM start
      UNION ALL
      SELECT release_id, source_id, step, doc_id, kept, CASE WHEN kept THEN list_append(st, {_TITLED}) ELSE st END FROM (
        SELECT f.release_id, f.source_id, f.step, f.doc_id, f.url, f.fp, f.toks, w.st, len(list_filter(w.st, lambda x: coalesce(x.url = f.url, false) OR (x.fp <> '' AND f.fp <> '' AND (x.fp = f.fp
          OR len(list_intersect(x.toks, f.toks)) >= greatest(2, least(len(x.toks), len(f.toks)) - 1))))) = 0 AS kept
        FROM walk w JOIN v_fresh f ON f.release_id = w.release_id AND f.source_id = w.source_id AND f.step = w.step + 1)
    )
    SELECT c.doc_id, c.release_id, c.url FROM v_capture c WHERE c.doc_id IN (SELECT doc_id FROM walk WHERE kept UNION ALL SELECT doc_id FROM v_stored_before)""")
def _(fx):
    """Every tenth document is stored before; the stream of all documents is then imported twice, as a lost checkpoint would make it."""
    k = F.col("doc_id")

    def captures(rows):
        return rows.select(F.col("lang").alias("release_id"), F.col("source").alias("source_id"), F.when(k % 17 != 0, F.concat(F.lit("https://x/"), F.expr("doc_id div 3").cast("string"))).alias("url"),
                           F.regexp_extract("text", "^[^.]*", 0).alias("title"), F.timestamp_seconds(k).alias("fetched_at"))

    folder = shared_folder(fx, "import")
    before = captures(fx.table("documents").filter(k % 10 == 0))
    first = before.filter("url IS NOT NULL").groupBy("url").agg(F.min("fetched_at").alias("fetched_at"))
    imports.write_epoch(before.join(first, ["url", "fetched_at"], "left_semi").unionByName(before.filter("url IS NULL")), f"{folder}/store", "before", 0)
    source = fx.spark.readStream.schema(fx.table("documents").schema).parquet(f"{fx.sf_dir}/documents.parquet*")
    for attempt in range(2):
        imports.start_import(captures(source), f"{folder}/store", f"{folder}/late", f"{folder}/checkpoint-{attempt}", f"attempt-{attempt}", lateness=None).awaitTermination()
    return imports.read_imported(fx.spark, f"{folder}/store").select(F.unix_timestamp("fetched_at").alias("doc_id"), "release_id", "url")
