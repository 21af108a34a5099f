import random

import pytest
from pyspark.sql import functions as F

from shelfsight.functions import text as t
from shelfsight.operators import dedupe as dd, matching as mt

WORDS = ["nike", "pegasus", "review", "run", "test", "long", "first", "shoe"]


def similar(a, b):
    x, y = set(a.split()), set(b.split())
    return bool(a and b) and (a == b or len(x & y) >= max(2, min(len(x), len(y)) - 1))


def greedy(batch, stored):
    """The rule as stated, one record after the other."""
    kept = {}
    taken = list(stored)
    for r in sorted(batch, key=lambda r: r[0]):
        duplicate = any(r[1] == s[1] and (r[2] == s[2] or similar(r[3], s[3])) for s in taken)
        kept[r[0]] = not duplicate
        if not duplicate:
            taken.append(r)
    return kept


def records(spark, rows):
    df = spark.createDataFrame(rows, "id int, block string, url string, title string").withColumn("ord", F.struct("id"))
    return dd.with_set_key(df, F.col("title"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suppression_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        title = " ".join(rng.sample(WORDS, rng.randint(0, 5)))
        if i % 3 == 0:
            title = "nike pegasus review"  # a third of all records in one group of copies
        rows.append((i, "hot" if i % 4 else "cold", f"u{rng.randint(0, 70)}", title))
    stored, batch = [r for r in rows if r[0] % 10 == 7], [r for r in rows if r[0] % 10 != 7]
    got = {r["id"]: r["kept"] for r in dd.suppress_duplicates(records(spark, batch), records(spark, stored), ["block"]).collect()}
    assert got == greedy(batch, stored)


def test_first_duplicate_of_long_and_odd_titles(spark):
    many = " ".join(f"w{i:02d}x" for i in range(70)).replace("0", "a").replace("1", "b")
    titles = ["", "x", "nike", "nike", "nike review", "review nike", "nike review long", many, many + " extra", "run shoe first", "run shoe second"]
    rows = [(i, "b", f"u{i}", title) for i, title in enumerate(titles)]
    got = {r["id"]: r["duplicate_of"] for r in dd.first_duplicates(records(spark, rows), ["block"]).collect()}
    prints = {i: spark.createDataFrame([(x,)], "c string").select(t.title_fingerprint(F.col("c")).alias("f")).collect()[0]["f"] for i, x in enumerate(titles)}
    for i in range(len(titles)):
        earlier = [j for j in range(i) if similar(prints[i], prints[j])]
        assert got[i] == (earlier[0] if earlier else None)


def test_matching_equals_containment(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["ride", "pride", "nike", "peg", "pegasus", "41", "zoom", "rider", "fly"]) for _ in range(rng.randint(1, 9)))) for i in range(150)] + [(999, "")]
    entities = [(1, "nike", ["ride"]), (2, "nike", ["peg 41"]), (3, "zoom", ["zoom nike fly", "absent words here"]), (4, "fly", ["pegasus 41", "pegasus41"]), (5, "ride", ["e n"]), (6, "x", ["nike"]), (7, "gasus", ["i"]), (8, "nike zoom", ["r"]), (9, "i", ["gas"]), (10, "", ["41"]), (11, "rid", ["absent"]), (12, "absent", ["rid"]), (13, "zoom", ["e", "peg 41"])]
    got = {(r["doc_id"], r["entity_id"]) for r in mt.match_documents(
        spark.createDataFrame(docs, "doc_id int, haystack string"), spark.createDataFrame(entities, "entity_id int, brand string, aliases array<string>")).collect()}
    assert got == {(i, e) for i, h in docs for e, brand, aliases in entities if brand in h and any(a in h for a in aliases)}


def test_thread_rule(spark):
    def keep(title, body, comments):
        rule = mt.is_thread_candidate(F.col("t"), F.col("b"), F.col("c"), F.lit("nike"), F.array(F.lit("pegasus 41")), F.lit("nike pegasus 41"))
        return spark.createDataFrame([(title, body, comments)], "t string, b string, c int").select(rule.alias("x")).collect()[0]["x"]

    assert keep("nike pegasus 41", "", 0)
    assert not keep("nike pegasus 41 sale", "", 20)
    assert not keep("pegasus 41 by nike", "no", 7)
    assert keep("pegasus 41 by nike", "no", 8)
    assert not keep("nike vaporfly", "review", 50)


def test_dashed_tokens_are_normalised_unless_asked_not_to(spark):
    df = spark.createDataFrame([("https://x.example/2024/best-trail-shoes.html",)], "u string")
    assert df.select(mt.is_non_review_link(F.col("u")).alias("x")).collect()[0]["x"]
    assert not df.select(mt.is_non_review_link(F.col("u"), reference_quirks=True).alias("x")).collect()[0]["x"]


def test_suppression_ends_with_null_urls_and_blocks(spark):
    from pyspark.sql import functions as F

    from shelfsight.operators.dedupe import first_duplicates, suppress_duplicates

    rows = [(1, "b", None, "x y"), (2, None, "u", "x y"), (3, "b", "u", "x y"), (4, None, None, None)]
    table = spark.createDataFrame(rows, "id long, block string, url string, set_key string").select(
        "block", "url", "set_key", F.struct(F.col("id").alias("at"), "id").alias("ord"))
    kept = {r["ord"]["id"]: r["kept"] for r in suppress_duplicates(table, table.where("false"), ["block"]).collect()}
    assert set(kept) == {1, 2, 3, 4} and kept[1] and kept[2] and kept[4]
    assert first_duplicates(table, ["block"]).count() == 4


def test_equal_orders_in_two_blocks_are_told_apart(spark):
    rows = [(7, "r1", "u1", "nike pegasus review"), (7, "r2", "u2", "hoka clifton test")]
    stored = [(1, "r2", "u9", "hoka clifton test")]
    got = {r["block"]: r["kept"] for r in dd.suppress_duplicates(records(spark, rows), records(spark, stored), ["block"]).collect()}
    assert got == {"r1": True, "r2": False}
    same = [(7, "r1", None, "nike pegasus review"), (7, "r1", None, "nike pegasus review"), (7, None, None, "nike pegasus review"), (7, None, None, "nike pegasus review")]
    got = [(r["block"], r["kept"]) for r in dd.suppress_duplicates(records(spark, same), records(spark, stored), ["block"]).collect()]
    assert sorted(got, key=repr) == sorted([("r1", True), ("r1", False), (None, True), (None, True)], key=repr)


def test_only_asked_keys_are_shuffled(spark, monkeypatch):
    """In slices or at once: the rows whose key is asked for, each once."""
    emitted = spark.createDataFrame([(i, i % 50) for i in range(200)] + [(7, None)], "doc_id int, key long")
    asked = spark.createDataFrame([(k,) for k in (3, 3, 9, 17, 44, 99, None)], "key long")
    want = sorted((k, i) for i in range(200) if (k := i % 50) in (3, 9, 17, 44))
    for limit in (100, 2):
        monkeypatch.setattr(mt, "SENT_KEYS", limit)
        assert sorted(map(tuple, mt._asked_only(emitted, asked, "key").select("key", "doc_id").collect())) == want


@pytest.mark.parametrize("size", [64 << 20, 0])
def test_matching_is_the_same_with_and_without_broadcasts(spark, monkeypatch, size):
    monkeypatch.setattr(mt, "BROADCAST_BYTES", size)
    monkeypatch.setattr(mt, "SENT_KEYS", 2)
    docs = spark.createDataFrame([(1, "nike peg 41"), (1, "nike peg 41"), (2, "ride zoom fly"), (3, None)], "doc_id int, haystack string")
    entities = spark.createDataFrame([(1, "nike", ["peg", "peg 41"]), (2, "zoom", ["zoom fly"]), (3, None, ["fly"]), (None, "ride", ["zoo"]), (5, "absent", ["ride"])],
                                     "entity_id int, brand string, aliases array<string>")
    got = sorted(map(tuple, mt.match_documents(docs, entities).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 2), (2, None)], key=repr)


def test_set_links_are_numbers_and_none_is_held_by_one_set_alone(spark):
    rows = [("b", i, f"u{i}", title) for i, title in enumerate(["red ring shoe", "red ring boot", "lone words here", "red ring shoe max"])]
    table = dd.with_set_key(spark.createDataFrame(rows, "block string, id long, url string, title string"), F.col("title"))
    sets = dd.known_sets(table, ["block"])
    links = dd.set_links(sets, ["block"])
    assert dict(links.dtypes) == {"set_id": "bigint", "link": "bigint"}
    held = links.distinct().groupBy("link").count()
    assert held.filter("count < 2").count() == 0
    lone = sets.filter("set_key LIKE '%lone%'")
    assert lone.count() == 1 and links.join(lone, "set_id").count() == 0
