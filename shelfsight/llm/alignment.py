"""Cross-tokenizer alignment over Arrow arrays.

Both tokenizers' ids of a slice of texts become list arrays. Flattening gives the tokens, parent indices their documents, and running sums of the tokens'
byte lengths less those at the document's begin give the offset at which every token ends. A hash join on (document, end) finds the offsets where tokens
of both end; these cut a text into groups, and every token of one side in a group is linked with every token of the other.

Counts of id pairs are gathered from the documents' distinct pairs, by group_by within tasks and by Spark across them. The counts of the most frequent
pairs (``MOST_PAIRS``) are sent to the documents, the others join them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.bpe import byte_alphabet
from shelfsight.llm.common import most_frequent, written

if TYPE_CHECKING:
    from tiktoken import Encoding

MARKER = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Characters of texts that are tokenised and aligned at a time; a longer text is tokenised in parts and aligned whole.
SLICE_CHARS = 1 << 20
#: Links that are spelled out at a time. A group with more is reduced to its distinct ids first.
HELD_LINKS = 1 << 22
#: Distinct pairs that a task counts before it hands them on.
HELD_PAIRS = 2_000_000
#: Pairs whose counts are sent to the documents at most (17 bytes each); the others are joined.
MOST_PAIRS = 1_000_000
#: Fixed value: how the byte-level file cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes differ between versions of Unicode lie outside of Latin and general punctuation; texts with such go through the file's own library.
UNSTABLE = re.compile(r"[^\x00-\u024f\u2000-\u206f]")
#: A space at which neither tokenizer's tokens can cross: what follows can be tokenised by itself, with the space that each puts before a text.
APART = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Sides:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, byte_file: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_file.decode("utf-8"))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        of_char = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = pa.array([b"".join(of_char.get(c, c.encode()) for c in t) for t in tokens], pa.large_binary())
        self.a_ranks = by_rank(json.loads(byte_file), of_char)
        pieces = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        spelled = [bytes.fromhex(m[1]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(MARKER, " ").encode() for p in pieces]
        self.b_bytes = pa.array(spelled, pa.large_binary())

    def a_ids(self, text: str) -> list[int]:
        if self.a_ranks is not None and not UNSTABLE.search(text):
            return self.a_ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space+text by A and of text by B, of every text."""
        parts = [part for text in texts for part in parted(text)]
        counts = np.cumsum([0, *(len(parted(text)) for text in texts)])
        a = [self.a_ids(" " + p) for p in parts]
        b = self.b.encode(parts, num_threads=1)
        if len(parts) > len(texts):
            a, b = ([[i for part in side[s:e] for i in part] for s, e in zip(counts, counts[1:])] for side in (a, b))
        return a, b


def by_rank(file: dict, of_char: dict[str, bytes]) -> Encoding | None:
    """The file's merges by rank, which encodes several times faster; none if the file's ids are not in the order of its merges."""
    from tiktoken import Encoding

    model = file["model"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    if any(model["vocab"].get(t) != len(of_char) + k for k, t in enumerate(merged)) or any(model["vocab"].get(c, len(of_char)) >= len(of_char) for c in of_char):
        return None
    if (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or not file["pre_tokenizer"].get("use_regex", True) or file["normalizer"]:
        return None
    ranks = {b"".join(map(of_char.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in of_char for c in t)}
    return Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def parted(text: str) -> list[str]:
    """A text, cut at spaces where it is very long; the space itself is left out, as both sides put one before each part."""
    if len(text) <= SLICE_CHARS:
        return [text]
    out, at = [], 0
    while len(text) - at > SLICE_CHARS and (cut := APART.search(text, at + SLICE_CHARS)):
        out.append(text[at:cut.start()])
        at = cut.end()
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def load(byte_file: bytes, piece_model: bytes) -> Sides:
    return Sides(byte_file, piece_model)


def tokens_of(lists: pa.ListArray, entries: pa.Array) -> pa.Table:
    """(doc, id, end) of every token: its document's place, its id, and the document and byte offset at which it ends, as one number."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ends = pc.cumulative_sum(pc.binary_length(entries.take(ids)).cast(pa.int64()))
    begins = np.concatenate(([0], ends.to_numpy()))[lists.offsets.to_numpy()[:-1]]
    end = pc.add(pc.shift_left(doc.cast(pa.int64()), pa.scalar(40, pa.int64())), pc.subtract(ends, pa.array(begins).take(doc)))
    return pa.table({"doc": doc, "id": ids, "end": end})


def same_bytes(lists: pa.ListArray, entries: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of a document's tokens are those of its text with a space before."""
    joined = entries.take(pc.list_flatten(lists))
    at = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset:joined.offset + len(joined) + 1][lists.offsets.to_numpy()]
    data = memoryview(joined.buffers()[2] or b"").cast("B")
    return np.array([e - s == len(t) + 1 and data[s:s + 1] == b" " and data[s + 1:e] == t for s, e, t in zip(at, at[1:], texts)], dtype=bool)


def groups_of(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin of A's tokens, begin of B's tokens) of each group, in order; the begins have the end of all as last entry."""
    sides = [t.select(["end"]).append_column(name, pa.array(np.arange(len(t)))) for t, name in ((a, "at_a"), (b, "at_b"))]
    cuts = sides[0].join(sides[1], keys="end", join_type="inner", use_threads=False).sort_by("at_a")
    at_a, at_b = (np.concatenate(([0], cuts[name].to_numpy() + 1)) for name in ("at_a", "at_b"))
    return cuts["end"].to_numpy() >> 40, at_a, at_b


def repeated(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of each k, counts[k] of them."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(first - starts, counts)


def link_counts(doc: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> pa.Table:
    """(doc, pair, times): how often a document links each pair of ids, the pair as ``a * width + b``."""
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    links = n_a * n_b
    large = links > HELD_LINKS
    tables = []

    def keep(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        tables.append(pa.table({"doc": docs, "pair": pairs, "times": times}).group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]))

    small = np.flatnonzero(~large)
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(links[small]) // HELD_LINKS)) + 1) if len(small) else []:
        # every token of A once for each token of B in its group
        per_token = np.repeat(n_b[part], n_a[part])
        left = np.repeat(a[repeated(at_a[part], n_a[part])], per_token).astype(np.int64)
        right = b[repeated(np.repeat(at_b[part], n_a[part]), per_token)]
        keep(np.repeat(doc[part], links[part]), left * width + right, np.ones(len(left), dtype=np.int64))
    for g in np.flatnonzero(large):
        (left, left_n), (right, right_n) = (np.unique(side[at[g]:at[g + 1]], return_counts=True) for side, at in ((a, at_a), (b, at_b)))
        step = max(1, HELD_LINKS // len(right))
        for s in range(0, len(left), step):
            pairs = (left[s:s + step, None].astype(np.int64) * width + right).ravel()
            keep(np.full(len(pairs), doc[g]), pairs, (left_n[s:s + step, None] * right_n).ravel().astype(np.int64))
    if not tables:
        return pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    table = pa.concat_tables(tables).rename_columns(["doc", "pair", "times"])
    if len(tables) > 1:
        table = table.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "pair", "times"])
    return table.sort_by("doc")


def spelled_groups(doc: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, a: pa.Array, b: pa.Array, n: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each of n documents with groups."""
    sides = [pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids.cast(pa.string())), ",") for at, ids in ((at_a, a), (at_b, b))]
    each = pc.binary_join_element_wise(*sides, "|")
    bounds = np.searchsorted(doc, np.arange(n + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each), ";").to_pylist()


def align_slice(sides: Sides, texts: list[str]) -> dict[str, np.ndarray | list]:
    """What ``align_texts`` returns for a slice of texts."""
    n = len(texts)
    out = {name: np.zeros(n, dtype=np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    out |= {"groups_sha256": [""] * n, "pairs": np.zeros(0, dtype=np.int64), "times": np.zeros(0, dtype=np.int64), "n_pairs": np.zeros(n, dtype=np.int64)}
    filled = [k for k, t in enumerate(texts) if t]
    if not filled:
        return out
    lists = [pa.array(ids, pa.list_(pa.int32())) for ids in sides.encode([texts[k] for k in filled])]
    data = [texts[k].encode("utf-8", "surrogatepass") for k in filled]
    usable = same_bytes(lists[0], sides.a_bytes, data) & same_bytes(lists[1], sides.b_bytes, data)
    kept = np.array(filled)[usable]
    if not len(kept):
        return out
    lists = [side.filter(pa.array(usable)) for side in lists]
    a, b = (tokens_of(side, entries) for side, entries in zip(lists, (sides.a_bytes, sides.b_bytes)))
    a_ids, b_ids = (t["id"].combine_chunks() for t in (a, b))
    doc, at_a, at_b = groups_of(a, b)
    first = np.searchsorted(doc, np.arange(len(kept)))
    out["n_a"][kept], out["n_b"][kept] = (pc.list_value_length(side).to_numpy() for side in lists)
    out["n_groups"][kept] = np.bincount(doc, minlength=len(kept))
    out["n_links"][kept] = np.add.reduceat(np.diff(at_a) * np.diff(at_b), first)
    for k, text in zip(kept.tolist(), spelled_groups(doc, at_a, at_b, a_ids, b_ids, len(kept))):
        out["groups_sha256"][k] = hashlib.sha256(text.encode()).hexdigest()
    links = link_counts(doc, at_a, at_b, a_ids.to_numpy(), b_ids.to_numpy(), len(sides.b_bytes))
    out["n_pairs"][kept] = np.bincount(links["doc"].to_numpy(), minlength=len(kept))
    out["pairs"], out["times"] = links["pair"].to_numpy(), links["times"].to_numpy()
    return out


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align_texts(docs: DataFrame, byte_path: str, piece_path: str) -> tuple[DataFrame, int]:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every document, written, and the number of B's entries.

    ``pairs`` are the distinct linked id pairs as ``a * entries of B + b``, ``times`` how many links each has.
    """
    files = docs.sparkSession.sparkContext.broadcast((open(byte_path, "rb").read(), open(piece_path, "rb").read()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = load(*files.value)
        for batch in batches:
            texts = batch.column("text")
            chars = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
            bounds = [0, *(np.flatnonzero(np.diff(chars // SLICE_CHARS)) + 1).tolist(), batch.num_rows]
            for s, e in zip(bounds, bounds[1:]):
                found = align_slice(sides, [t or "" for t in texts.slice(s, e - s).to_pylist()])
                offsets = pa.array(np.concatenate(([0], np.cumsum(found["n_pairs"]))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(s, e - s), batch.column("doc_id").slice(s, e - s), *(pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(found["groups_sha256"], pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(found[c])) for c in ("pairs", "times"))],
                    names=[part.split()[0] for part in ALIGNED.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(scan, ALIGNED), "aligned"), len(load(*files.value).b_bytes)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many documents link each id pair, and whether no other pair of its A id has more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        size = 0
        for batch in batches:
            pairs = pc.list_flatten(batch.column("pairs"))
            held.append(pa.table({"pair": pairs, "n": pa.array(np.ones(len(pairs), dtype=np.int64))}))
            size += len(pairs)
            if size > HELD_PAIRS:
                held = [merged()]
                size = len(held[0])
                if size > HELD_PAIRS // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from merged().to_batches()

    counts = aligned.select("pairs").mapInArrow(scan, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per entry of A at most
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document's whole text, one row per row.

    Null and empty texts, and texts that either side's token bytes do not give back, have zeros and an empty digest. Repeated rows and
    rows with null doc_id count as documents of their own. Other columns are not read. Both files are read on the driver; their size does
    not depend on the data.
    """
    context = docs.sparkSession.sparkContext
    aligned, width = align_texts(docs, byte_path, piece_path)
    counts = written(pair_counts(aligned, width), "pair-table")
    sent = most_frequent(counts, F.col("n"), MOST_PAIRS)
    table = counts.where(sent).orderBy("pair").toArrow()
    known = context.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column("pairs")).to_numpy()
            pairs, times = (pc.list_flatten(batch.column(c)).to_numpy() for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            sums = []
            for value in (times * hit * (best[at] if len(keys) else 0), times * hit * (n[at] if len(keys) else 0)):
                running = np.concatenate(([0], np.cumsum(value, dtype=np.int64)))
                sums.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
            left = np.concatenate(([0], np.cumsum(~hit)))[ends]
            others = pa.StructArray.from_arrays([pa.array(pairs[~hit], pa.int64()), pa.array(times[~hit], pa.int64())], names=["pair", "times"])
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *sums, pa.ListArray.from_arrays(pa.array(left, pa.int32()), others)],
                                             names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "others"])

    schema = ALIGNED.split(", pairs")[0] + ", n_best long, count_sum long, others array<struct<pair:long,times:long>>"
    partial = written(aligned.mapInArrow(scan, schema), "alignment-sums")
    rare = partial.select("row", F.explode("others").alias("o")).select("row", "o.pair", "o.times").join(counts.where(~sent), "pair")
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more"), F.sum(F.col("times") * F.col("n")).alias("sum_more"))
    more = lambda name, other: (F.col(name) + F.coalesce(other, F.lit(0))).alias(name)
    return partial.drop("others").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", F.col("best_more")), more("count_sum", F.col("sum_more")), "groups_sha256")
