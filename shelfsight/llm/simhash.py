"""SimHash near-duplicates: fingerprints of word shingles, linked through the anchors of a covering code.

The anchors are the pairs of code words of the binary Golay code of length 23 (perfect, covering radius 3) over the first
and second 23 bits of a fingerprint: 2**24 anchors. Two fingerprints that differ in at most t bits have a point half way
between them, and that point lies within the covering radius of one anchor. So every fingerprint is replicated to the anchors
within the covering radius plus half the threshold (rounded up), about ten of them at t = 2, and any linked pair meets at
one anchor, where the 64 bits are compared. Only distinct fingerprints are replicated, so copies cost nothing.

An anchor with more than ``dense`` fingerprints is not compared pair by pair: its members are replicated to the points
half a threshold around them instead, where at most 65 fingerprints (t <= 2) can meet, and all that meet at a point are tied
to the smallest. Members of one point differ in at most t bits, and linked pairs share one, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import ROW, WORD_PATTERN, join_counted, numbered, numbered_texts, without, written
from shelfsight.llm.components import components

#: Fixed values of the code: generator polynomial of the [23, 12, 7] Golay code, length, parity bits, covering radius.
GOLAY_POLYNOMIAL = 0b101011100011
GOLAY_BITS = 23
GOLAY_PARITY = 11
GOLAY_RADIUS = 3

SHINGLE_WORDS = 3
THRESHOLD = 2
DENSE = 256
#: What a row must share with the row that stays for it before it is dropped.
VERIFY_WORDS = 5
LEAST = 0.8
HASH_SEED = 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingles' hashes, as a signed 64-bit number; zero without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        line = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [line[a:b] for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1:].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, HASH_SEED) for s in shingles], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at:at + 8192].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, with_number: bool = False) -> DataFrame:
    """(doc_id, fp): one row per document, from its whole text; numbered rows keep their number if asked, with two digests of the text."""
    number = [ROW, "a1", "a2"] if with_number else []
    digests = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("a1"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("a2")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", *number]].assign(fp=[fingerprint(t, words) for t in batch["text"]])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *number, "fp"])
    own = [ROW, *digests] if with_number else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own).mapInPandas(scan, schema)


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit polynomial by the generator."""
    rest = values.astype(np.int64)
    for bit in range(GOLAY_BITS - 1, GOLAY_PARITY - 1, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY_POLYNOMIAL << (bit - GOLAY_PARITY)), rest)
    return rest


@lru_cache(maxsize=4)
def _patterns(extra: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per syndrome the error patterns of weight up to the radius plus ``extra``, and by how much each exceeds the radius."""
    masks, over = [], []
    for weight in range(GOLAY_RADIUS + extra + 1):
        for bits in combinations(range(GOLAY_BITS), weight):
            masks.append(sum(1 << b for b in bits))
            over.append(max(0, weight - GOLAY_RADIUS))
    masks, over = np.array(masks, dtype=np.int64), np.array(over)
    syndrome = _syndromes(masks)
    order = np.argsort(syndrome, kind="stable")
    cuts = np.searchsorted(syndrome[order], np.arange(1, 1 << GOLAY_PARITY))
    return np.split(masks[order], cuts), np.split(over[order], cuts)


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> list[np.ndarray]:
    """Anchor numbers of each fingerprint: code-word pairs within the covering radius plus half the threshold."""
    extra = (threshold + 1) // 2
    masks, over = _patterns(extra)
    low_mask = (1 << GOLAY_BITS) - 1
    first, second = fps & low_mask, (fps >> GOLAY_BITS) & low_mask
    out = []
    for x, y, sx, sy in zip(first.tolist(), second.tolist(), _syndromes(first).tolist(), _syndromes(second).tolist()):
        a, b = masks[sx] ^ x, masks[sy] ^ y
        allowed = over[sx][:, None] + over[sy][None, :] <= extra
        out.append(((a[:, None] << GOLAY_BITS) | b[None, :])[allowed])
    return out


def _replicas(distinct: DataFrame, threshold: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(dtype=np.int64)
            for at in range(0, len(fps), 2000):
                part = fps[at:at + 2000]
                found = anchors(part, threshold)
                sizes = [len(f) for f in found]
                yield pd.DataFrame({"anchor": np.concatenate(found), "fp": np.repeat(part, sizes)})

    return distinct.select("fp").mapInPandas(scan, "anchor long, fp long")


def _around(fp: str, radius: int):
    """All points within ``radius`` (1 or 2) bits of a fingerprint."""
    flips = [0] + [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(64), r)]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    return F.transform(F.array(*[F.lit(f).cast("long") for f in signed]), lambda m: F.col(fp).bitwiseXOR(m))


def links(distinct: DataFrame, threshold: int = THRESHOLD, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that have the same connected components as all pairs within ``threshold``.

    Every edge joins fingerprints within ``threshold`` bits. Ordinary anchors give every pair, dense ones a star per point.
    """
    if threshold not in (0, 2, 4):
        raise ValueError("an even threshold up to 4, so that a pair has an exact point half way")
    replicas = written(_replicas(distinct, threshold), "replicas")
    sizes = replicas.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    met = replicas.join(sizes, "anchor")
    few = met.where(F.col("n") <= dense).select("anchor", "fp")
    a, b = few.select("anchor", F.col("fp").alias("a")), few.select("anchor", F.col("fp").alias("b"))
    pairs = a.join(b, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")
    crowded = met.where(F.col("n") > dense).select("fp").distinct()
    points = crowded.select("fp", F.explode(_around("fp", (threshold + 1) // 2)).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(least, "point").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Documents with fingerprints within ``threshold`` bits are linked; component_id is the smallest doc_id that links reach.
    Null and word-less texts have fingerprint zero and link like any other. A repeated row comes out as often as it came in;
    null identifiers never name a component unless it has no other (then component_id is null). Empty input gives no rows.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "distinct")
    roots = written(components(links(distinct, threshold, dense)).withColumnRenamed("node", "fp"), "roots")
    linked = distinct.join(roots, "fp").select("fp", "root", "first_id")
    named = roots.join(linked.groupBy("root").agg(F.min("first_id").alias("linked_id")), "root").select("fp", "linked_id")
    classes = written(distinct.join(named, "fp", "left").select("fp", "rows", F.coalesce("linked_id", "first_id").alias("component_id")), "classes")
    return join_counted(prints, classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """The rows of ``texts`` with ``shingles``, the distinct 64-bit hashes of their word shingles (of all words where there are fewer), instead of text."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.regexp_extract_all(lower, F.lit(f"({WORD_PATTERN})"), 1)
    count = F.greatest(F.size("tokens") - (words - 1), F.lit(1))
    hashed = F.transform(F.sequence(F.lit(1), count), lambda k: F.xxhash64(F.array_join(F.slice("tokens", k, words), " ")))
    return texts.withColumn("tokens", tokens).withColumn("shingles", F.array_distinct(hashed)).drop("text", "tokens")


def verified(rows: DataFrame, near: DataFrame, words: int, least: float) -> DataFrame:
    """The rows of ``near`` whose texts share at least ``least`` of their word shingles with the text of the row that would stay for them.

    near: row_number, two digests of the text (a1, a2), and kept, k1, k2 of that row. Equal texts need no look; of the others each distinct pair is
    compared once, as two arrays of hashes.
    """
    equal = (F.col("a1") == F.col("k1")) & (F.col("a2") == F.col("k2"))
    pair = ["a1", "a2", "k1", "k2"]
    pairs = written(near.where(~equal).groupBy(*pair).agg(F.min(ROW).alias("one"), F.min("kept").alias("other")), "near-pairs")
    asked = written(pairs.select(F.col("one").alias(ROW)).unionByName(pairs.select(F.col("other").alias(ROW))).distinct(), "near-asked")
    sets = written(shingle_sets(numbered_texts(rows).join(asked, ROW), words), "near-shingles")
    both = pairs.join(sets.select(F.col(ROW).alias("one"), F.col("shingles").alias("a")), "one").join(sets.select(F.col(ROW).alias("other"), F.col("shingles").alias("b")), "other")
    shared = F.size(F.array_intersect("a", "b"))
    alike = written(both.where(shared >= F.lit(least) * (F.size("a") + F.size("b") - shared)).select(*pair), "near-alike")
    return near.where(equal).select(ROW).unionByName(near.where(~equal).join(alike, pair, "left_semi").select(ROW))


def keep_one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD, dense: int = DENSE, verify_words: int = VERIFY_WORDS, least: float = LEAST) -> DataFrame:
    """One row of each component, all columns as they came: that with the smallest doc_id (null ones last), of several rows the first.

    A row goes only if its text and that of the row that stays for it share at least ``least`` of their shingles of ``verify_words`` words; a row at the
    other end of a chain of links stays.
    """
    rows = numbered(docs)
    prints = written(fingerprints(numbered_texts(rows), words, with_number=True), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW, "a1", "a2")).alias("best")
    distinct = written(prints.groupBy("fp").agg(best, F.count("*").alias("rows")), "distinct")
    roots = components(links(distinct, threshold, dense)).withColumnRenamed("node", "fp")
    rooted = written(distinct.join(roots, "fp", "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"), "best"), "rooted")
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select("root", F.col(f"best.{ROW}").alias("kept"), F.col("best.a1").alias("k1"), F.col("best.a2").alias("k2"))
    of_print = written(rooted.select("fp", "rows", "root").join(kept, "root").drop("root"), "kept-of-prints")
    near = written(join_counted(prints, of_print, "fp").where(F.col(ROW) != F.col("kept")).select(ROW, "kept", "a1", "a2", "k1", "k2"), "near-rows")
    return without(rows, verified(rows, near, verify_words, least))
