"""Exact deduplication as a stream with keyed state that never expires.

The state (RocksDB, on the executors' disks and in the shared checkpoint) holds per digest of the normalised text the best
document so far (most code points, then smallest identifier), the file that its content came from, and the number of rows. The state is read back as a table when the stream
has taken in all there is; a later run over the same state folder takes in only new files.

Digests only propose: the full normalised bytes of every document whose digest was hit are compared by grouping on the bytes
themselves, and a digest that stands for two contents is split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import ROW, SPACE_CLASS, numbered, numbered_texts, scratch_path, without, written

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space reserved ahead
}
#: Bits of the filter that picks the documents for the byte comparison: at most 2**22 / 64 rows of 16 bytes are broadcast, at any size.
FILTER_BITS = 22


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS + "+", "")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def locator_of(docs: DataFrame) -> Column:
    """The file a row comes from; empty where the rows have no single file source (a join, rows made in memory)."""
    try:
        docs.select(F.input_file_name())
    except AnalysisException:
        return F.lit("")
    return F.input_file_name()


def ingest(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex, with_number: bool = False) -> DataFrame:
    """(doc_id, digest, n_chars, locator): what the state needs to know of each document, without its text; numbered rows keep their number if asked."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(normalised(F.col("text"))).alias("digest"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("n_chars"), locator_of(docs).alias("locator"),
        *([ROW] if with_number else []))


def update_state(arrivals: DataFrame, state_path: str, files_per_batch: int = 1000) -> None:
    """Runs the stream over all files of the written table ``arrivals`` that the state folder has not yet taken in."""
    spark = arrivals.sparkSession
    folder = arrivals.inputFiles()[0].rsplit("/", 1)[0] if arrivals.inputFiles() else None
    if folder is None:
        return
    before = {key: spark.conf.get(key, None) for key in ROCKSDB}
    try:
        for key, value in ROCKSDB.items():
            spark.conf.set(key, value)
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").alias("doc_id"), F.col("locator").alias("locator")))
        query = (
            stream.groupBy("digest").agg(best.alias("best"), F.count("*").alias("rows"))
            .writeStream.outputMode("update").format("noop").option("checkpointLocation", state_path).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_state(spark, state_path: str) -> DataFrame:
    """(digest, keep_id, keep_chars, keep_locator, group_size) of every digest in the state."""
    state = spark.read.format("statestore").load(state_path)
    best, rows = (F.col(f"value.`{name}`") for name in state.schema["value"].dataType.names)
    return state.select(
        F.col("key.digest").alias("digest"), best["doc_id"].alias("keep_id"), (-best["shorter"]).alias("keep_chars"),
        best["locator"].alias("keep_locator"), rows.cast("long").alias("group_size"))


def _hit_documents(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Content of the documents whose digest falls on a bit that a hit digest has set; a superset of the hits."""
    bit = lambda column: F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    words = hits.select(bit("digest").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    content = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("n_chars"))
    content = content.withColumn("digest", digest(F.col("content"))).withColumn("bit", bit("digest"))
    near = content.join(F.broadcast(words), F.shiftright("bit", 6) == F.col("word"))
    return near.where(F.expr("shiftright(mask, cast(bit & 63 as int)) & 1L") == 1).select("doc_id", "content", "n_chars", "digest")


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex, files_per_batch: int = 1000, with_number: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, keep_locator) for every document, dropped ones too.

    Texts are equal when identical without white space. Of equal texts the row with the most code points stays, then the one
    with the smallest doc_id (a null doc_id is smaller than any other). Rows that share both doc_id and content share the
    decision and are each counted in group_size; one doc_id with two contents is judged for each. Null text is empty text,
    and empty texts are equal to each other. Other columns are not read. Empty input gives no rows. With ``with_number`` numbered rows come out with
    their number, their code points and (with the digest) what names their group.
    """
    extra = [ROW, "n_chars", "part"] if with_number else []
    spark = docs.sparkSession
    arrivals = written(ingest(docs, digest, with_number), "arrivals")
    state_path = scratch_path(spark, "dedup-state")
    update_state(arrivals, state_path, files_per_batch)
    if not arrivals.inputFiles() or arrivals.isEmpty():
        return arrivals.select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest",
            F.col("locator").alias("keep_locator"), *[F.lit(None).cast("long").alias(c) if c == "part" else c for c in extra])
    state = written(read_state(spark, state_path), "dedup-groups")
    contents = _hit_documents(docs, state.where("group_size > 1"), digest).groupBy("digest", "content").agg(F.count("*").alias("n"))
    split = written(contents.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest"), "split-digests")
    judged = arrivals.select("doc_id", "digest", *[F.lit(None).cast("long").alias(c) if c == "part" else c for c in extra]).join(state, "digest")
    if split.agg(F.count("*")).first()[0]:
        judged = judged.join(split, "digest", "left_anti").unionByName(_by_content(docs, split, digest, with_number))
    return judged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "keep_locator", *extra)


def _by_content(docs: DataFrame, split: DataFrame, digest: Callable[[Column], Column], with_number: bool) -> DataFrame:
    """Groups by the bytes themselves, for digests that stand for more than one content."""
    number = [ROW] if with_number else []
    content = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content"), locator_of(docs).alias("locator"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("n_chars"), *number).withColumn("digest", digest(F.col("content")))
    content = content.join(split, "digest", "left_semi")
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").alias("doc_id"), F.col("locator").alias("locator")))
    groups = content.groupBy("digest", "content").agg(
        best.alias("best"), F.count("*").alias("group_size"), *[F.min(c).alias("part") for c in number])
    extra = [*number, "n_chars"] if number else []
    return content.select("doc_id", "digest", "content", *extra).join(groups, ["digest", "content"]).select(
        "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.shorter")).alias("keep_chars"),
        F.col("best.locator").alias("keep_locator"), "group_size", *extra, *(["part"] if extra else []))


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay, all columns as they came: one row of each group. Of several rows that may stay it is the longest, then the first."""
    rows = numbered(docs)
    judged = written(deduplicate(numbered_texts(rows), with_number=True, **how).select(ROW, "digest", "part", "kept", "n_chars"), "judged")
    best = judged.where("kept").groupBy("digest", "part").agg(F.min(F.struct(-F.col("n_chars"), ROW)).alias("best")).select(f"best.{ROW}")
    return without(rows, judged.select(ROW).join(best, ROW, "left_anti"))
