"""Merges keep every key once when a batch repeats keys, and the stated row wins."""

from pyspark.sql import functions as F

from shelfsight.operators import merge as mg



def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_overwrite_takes_the_last(spark):
    stored = table(spark, [(1, "old")], "k int, v string")
    batch = table(spark, [(1, "b", 2), (1, "c", 3), (1, "z", 1), (2, "n", 1), (2, "m", 2)], "k int, v string, seq int")
    once = mg.overwrite_upsert(stored, batch, ["k"], order=[F.col("seq")])
    assert sorted(map(tuple, once.collect())) == [(1, "c"), (2, "m")]
    assert sorted(map(tuple, mg.overwrite_upsert(once, batch, ["k"], order=[F.col("seq")]).collect())) == [(1, "c"), (2, "m")]


def test_insert_ignore_takes_the_first(spark):
    stored = table(spark, [(1, "old")], "k int, v string")
    batch = table(spark, [(1, "x", 1), (2, "b", 2), (2, "a", 3)], "k int, v string, seq int")
    assert sorted(map(tuple, mg.insert_select_ignore(stored, batch, ["k"], [F.col("seq")]).collect())) == [(1, "old"), (2, "b")]


def test_fill_takes_the_first_known(spark):
    stored = table(spark, [(1, None, 5)], "k int, a int, b int")
    batch = table(spark, [(1, None, 9, 1), (1, 3, 9, 2), (1, 4, 9, 3), (2, None, 7, 1), (2, 8, 6, 2), (3, 0, None, 1)], "k int, a int, b int, seq int")
    got = mg.fill_null_upsert(stored, batch, ["k"], ["a", "b"], order=[F.col("seq")])
    assert sorted(map(tuple, got.collect())) == [(1, 3, 5), (2, 8, 7)]


def test_patch_takes_the_last_supplied(spark):
    stored = table(spark, [(1, "old")], "k int, note string")
    patch = table(spark, [(1, "a", True, 1), (1, "b", True, 2), (1, "c", False, 3), (2, " ", True, 1), (2, None, None, 2)], "k int, note string, has_note boolean, seq int")
    assert sorted(map(tuple, mg.patch_upsert(stored, patch, ["k"], ["note"], order=[F.col("seq")]).collect())) == [(1, "b"), (2, None)]


def test_one_variant_takes_the_default_row(spark):
    existing = table(spark, [(1, "default", 1.0)], "release_id int, variant_key string, weight_oz double")
    incoming = table(spark, [(1, "unisex", 2.0), (1, "mens", 3.0), (1, "mens", 4.0)], "release_id int, variant_key string, weight_oz double")
    incoming = incoming.withColumn("seq", F.col("weight_oz"))
    assert sorted(map(tuple, mg.promote_variants(existing, incoming, [F.col("seq")]).collect())) == [(1, "mens", 4.0, "renamed"), (1, "unisex", 2.0, "inserted")]
