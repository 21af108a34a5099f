"""Helpers that the training-data operators share: written tables, label folds and bounded label samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.session import ensure_checkpoint_dir

#: White space of the word rule: space and the code points 9 to 13. A word is a maximal run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, keeps columns prunable."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Number of a row of a stage's input; the input's own columns lie inside a struct, so no name can clash.
ROW = "row_number"


def named(column: str) -> Column:
    """A column by its whole name, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> DataFrame:
    """(whole, row_number): the rows as a written table with a number each, so that rows alike in all columns can be told apart."""
    whole = F.struct(*[named(c) for c in docs.columns]).alias("whole")
    return written(docs.select(whole, F.monotonically_increasing_id().alias(ROW)), "numbered")


def numbered_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, text, row_number) of numbered rows."""
    return rows.select(F.col("whole.doc_id").cast("long").alias("doc_id"), F.col("whole.text").cast("string").alias("text"), ROW)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered rows whose number is not in ``gone``, as they came."""
    return rows.join(gone, ROW, "left_anti").select("whole.*")


#: A key that holds more than one of so many rows is sent to the rows; fewer keys than this can.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with ``table``, which has one row per key and the number of rows that hold it in ``rows``.

    Keys with many rows, fewer than ``HOT_SHARE`` of them, are broadcast, so that no task gets all rows of one; the others meet by a shuffle.
    """
    total = table.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * HOT_SHARE > total
    hot, cold = table.where(is_hot).drop("rows"), table.where(~is_hot).drop("rows")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier's decimal text, modulo ``modulus``; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with one row per document: rows without id or label are left out, disagreeing rows give the larger label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def label_sample(labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """At most ``per_class`` training identifiers of each class, those with the smallest hash, with the class's weight.

    Rows of the held-out fold are never taken. ``weight`` is how many labelled rows each sampled row stands for.
    The result has at most ``2 * per_class`` rows, which is what allows broadcasting it.
    """
    train = one_label(labels, label).where(id_fold(F.col("doc_id"), modulus) != held_out)
    totals = train.groupBy("label").agg(F.count("*").alias("rows"))
    rows = {r["label"]: r["rows"] for r in totals.collect()}  # two rows
    parts = [
        train.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        .withColumn("weight", F.lit(max(1.0, rows.get(value, 0) / per_class)))
        for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def most_frequent(df: DataFrame, count: Column, most: int) -> Column:
    """Whether a row's count lies in the highest levels that hold at most ``most`` rows together; a level spans a sixteenth of a doubling."""
    level = F.floor(F.log2(count.cast("double")) * 16)
    lowest, rows = None, 0
    for at in df.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():  # about a thousand levels at most
        rows += at["rows"]
        if rows > most:
            break
        lowest = at["level"]
    return level >= lowest if lowest is not None else F.lit(False)
