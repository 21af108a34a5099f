"""The two-key upsert against a plain loop over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import upsert


def plain(stored, incoming):
    table = [[("stored", i), url, (s, r, t) if t is not None else None] for i, url, s, r, t in sorted(stored)]
    out = {}
    for key, url, s, r, t in sorted(incoming):
        title = (s, r, t) if t is not None else None
        hit = next((row for row in table if url is not None and row[1] == url), None) or next((row for row in table if title is not None and row[2] == title), None)
        if hit is None:
            hit = [("new", key), url, title]
            table.append(hit)
        hit[1:] = [url, title]
        out[key] = (hit[0][1] if hit[0][0] == "stored" else None, hit[0][1] if hit[0][0] == "new" else None, "insert" if hit[0] == ("new", key) else "update")
    return out


SCHEMA = "source_url string, source_id int, release_id int, title string"


def decided(spark, stored, incoming):
    got = upsert.review_upsert_ids(spark.createDataFrame(incoming, "incoming_id int, " + SCHEMA), spark.createDataFrame(stored, "review_id int, " + SCHEMA)).collect()
    assert len(got) == len(incoming)
    return {r["incoming_id"]: (r["target_id"], r["same_as"], r["action"]) for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_random_batches(spark, seed):
    random.seed(seed)
    urls, titles, wide = [f"u{k}" for k in range(12 + 20 * seed)], ["a", "b", "c", None], 1 + seed

    def row():
        return random.choice([*urls, None]), random.randrange(wide), random.randrange(3), random.choice(titles)

    stored, taken = [], set()
    for k in range(25):
        url, *rest = row()
        if url not in taken or url is None:
            stored.append((100 + k, url, *rest))
            taken.add(url)
    incoming = [(k, *row()) for k in range(150)]
    assert decided(spark, stored, incoming) == plain(stored, incoming)


def test_a_moved_row_is_found_at_its_new_url(spark):
    stored = [(5, "old", 1, 1, "T1")]
    incoming = [(1, "new", 1, 1, "T1"), (2, "new", 1, 1, "T2"), (3, "old", 1, 1, "T9"), (4, "old", 1, 1, "T1"), (5, None, 1, 1, None), (6, None, 1, 1, None)]
    got = decided(spark, stored, incoming)
    assert got == plain(stored, incoming)
    assert got[2] == (5, None, "update") and got[3] == (None, 3, "insert") and got[5] == (None, 5, "insert") and got[6] == (None, 6, "insert")


def test_many_rows_of_one_title_need_no_replay(spark, monkeypatch):
    monkeypatch.setattr(upsert._Component, "take", None)  # would fail
    incoming = [(k, f"u{k % 50}", 1, 1, "T") for k in range(400)]
    assert decided(spark, [(900, "u3", 1, 1, "T"), (901, "u4", 1, 1, "T")], incoming) == plain([(900, "u3", 1, 1, "T"), (901, "u4", 1, 1, "T")], incoming)
    assert decided(spark, [], incoming) == plain([], incoming)
    assert decided(spark, [], []) == {}


def test_connected(spark):
    random.seed(3)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 200 + random.randrange(5)) for k in range(20)] + [(7, 7), (300, 301), (301, 300)]
    roots = {r["node"]: r["root"] for r in upsert.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert roots == {n: r for n, r in low.items()} and roots[40] == 0
    assert upsert.connected(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).collect() == []


def test_inputs_are_worked_out_once(spark):
    random.seed(8)
    seen = spark.sparkContext.accumulator(0)

    def counted(value):
        seen.add(1)
        return value

    counting = F.udf(counted, "string").asNondeterministic()
    stored = [(1000 + k, f"s{k}", 1, k % 9, "T") for k in range(60)]
    incoming = [(k, random.choice([f"s{random.randrange(60)}", f"n{k % 40}", None]), random.randrange(2), random.randrange(9), random.choice(["T", "S", None])) for k in range(200)]
    frames = [spark.createDataFrame(rows, f"{name} int, " + SCHEMA).withColumn("source_url", counting("source_url")) for rows, name in ((incoming, "incoming_id"), (stored, "review_id"))]
    got = upsert.review_upsert_ids(*frames).collect()
    assert {r["incoming_id"]: (r["target_id"], r["same_as"], r["action"]) for r in got} == plain(stored, incoming) and len(got) == 200
    assert seen.value == len(stored) + len(incoming)


def test_ids_that_swap_places_or_lack_are_other_titles(spark):
    stored = [(10, "a", None, 5, "T"), (11, "b", 5, None, "T"), (12, "c", 5, 5, "T")]
    incoming = [(1, "x", 5, None, "T"), (2, "y", None, 5, "T"), (3, "z", 5, 5, "T"), (4, "w", None, None, "T"), (12, None, 7, 7, None)]
    got = decided(spark, stored, incoming)
    assert [got[k][0] for k in (1, 2, 3, 4, 12)] == [11, 10, 12, None, None] and got[4][1] == 4 and got[12] == (None, 12, "insert")


@pytest.mark.parametrize("key_type", ["bigint", "string"])
def test_keys_beyond_a_double_and_of_text(spark, key_type):
    big = 2**53 + 1
    stored = [(big + 100, "u1", 1, 1, "T"), (big + 102, "u2", 2, 1, "S")]
    incoming = [(big, "u1", 2, 1, "S"), (big + 2, "u9", 2, 1, "S"), (big + 4, "u9", 3, 1, "R"), (big + 6, "u8", 4, 1, "Q"), (big + 8, "u8", 5, 1, "P")]
    frames = [spark.createDataFrame(rows, f"{name} bigint, " + SCHEMA).withColumn(name, F.col(name).cast(key_type)) for rows, name in ((incoming, "incoming_id"), (stored, "review_id"))]
    frame = upsert.review_upsert_ids(*frames)
    assert [frame.schema[c].dataType.simpleString() for c in ("incoming_id", "target_id", "same_as")] == [key_type] * 3
    number = lambda v: None if v is None else int(v)
    assert {int(r["incoming_id"]): (number(r["target_id"]), number(r["same_as"]), r["action"]) for r in frame.collect()} == plain(stored, incoming)
