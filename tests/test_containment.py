import random
import re

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import containment as ct, matching as mt
from shelfsight.plans import ingest_queries as iq
from shelfsight.sources.fixtures import Fixtures

DOCS = "doc_id int, haystack string"
ENTITIES = "entity_id int, brand string, aliases array<string>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def contained(docs, entities):
    return {(i, e) for i, h in docs if i is not None and h is not None for e, brand, aliases in entities
            if brand is not None and brand in h and any(a and a in h for a in aliases)}


def matched(spark, docs, entities):
    rows = [tuple(r) for r in mt.match_documents(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(entities, ENTITIES)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_texts_candidates_and_results_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"nike peg {i} zoom fly") for i in range(20)], DOCS)
    entities = spark.createDataFrame([(1, "nike", ["peg"]), (2, "zoom", ["zoom fly", "peg 3 zoom"]), (3, "fly", ["peg 7 zoom fly"])], ENTITIES)
    found = mt.match_documents(docs, entities)
    assert "Exchange" not in plan_of(found) and "Join" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted([(i, e) for i in range(20) for e in (1, 2)] + [(7, 3)])


@pytest.mark.parametrize("sent", [(4_000_000, 64 << 20), (7, 64 << 20), (4_000_000, 300)])
def test_matching_equals_containment_with_repeated_and_null_keys(spark, monkeypatch, sent):
    """Repeated documents with other texts, entities with several pairs, names and repeated ids in parts, words of odd lengths and double spaces."""
    monkeypatch.setattr(mt, "SENT_KEYS", sent[0])
    monkeypatch.setattr(mt, "BROADCAST_BYTES", sent[1])
    rng = random.Random(11)
    words = ["a", "of", "the", "then", "athe", "ride", "pride", "rider", "41", "4", "zoom", "é", ""]
    text = lambda least, most: " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))
    docs = [(rng.choice([None, *range(40)]), rng.choice([None] + [text(0, 12) for _ in range(9)])) for _ in range(120)]
    cut = lambda x: x[rng.randint(0, 2):len(x) - rng.randint(0, 2)]
    entities = [(rng.choice([None, *range(30)]), rng.choice([None, "", text(1, 1), cut(text(1, 3))]), [cut(text(1, 5)) for _ in range(rng.randint(0, 3))]) for _ in range(60)]
    want = contained(docs, entities)
    assert len(want) > 100
    assert matched(spark, docs, entities) == want


def test_forgotten_words_and_small_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ab", "b", "cab") for b in ("c", "ca", "b")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(8))) for i in range(60)]
    entities = [(i, rng.choice(words)[:2], [" ".join(rng.choice(words)[1:] for _ in range(i % 4 + 1))]) for i in range(80)]
    table = spark.createDataFrame(entities, ENTITIES).select("entity_id", "brand", F.explode("aliases").alias("alias")).distinct().toArrow()
    batches = spark.createDataFrame(docs, DOCS).toArrow().to_batches()
    found = []
    for remembered, chunk, rows in ((250_000, 1 << 20, 1 << 17), (3, 20, 2)):
        for name, value in (("REMEMBERED", remembered), ("CHUNK", chunk), ("ROWS", rows)):
            monkeypatch.setattr(ct, name, value)
        found.append([tuple(r.values()) for b in ct.Names(table).matched(iter(batches)) for r in b.to_pylist()])
    assert sorted(found[0]) == sorted(found[1]) == sorted(contained(docs, entities))


def test_entities_are_the_first_words_of_whole_texts(spark, tmp_path):
    texts = ["One two-three 4five six", "...A1b2c", "x y z", "", None, "İstanbul Kelvin\n\nno9 9 end", "  one  two,three  four", "a b c d", "1a2b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = "p_partkey long, p_brand string, p_name string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame([(k, "b", "n", "t", 1, 1.0) for k in range(60)], columns).write.parquet(f"{tmp_path}/part.parquet")
    got = {r["entity_id"]: (r["brand"], *r["aliases"]) for r in iq.entities(Fixtures(spark, str(tmp_path))).collect()}
    want = {}
    for k in range(60):
        w = re.findall("[a-z]+|[0-9]+", (texts[k % len(texts)] or "").lower())
        if len(w) >= 4:
            want[k] = (w[0], " ".join(w[2:3] if k % 50 == 0 else w[1:3] if k % 50 == 1 else w[1:4]))
    assert got == want
