"""Token counts of a piece model without token ids: pieces are counted once per distinct pre-token and summed per document.

A pre-token is a run of spaces with the non-space run that follows (or the spaces that end a text). No piece of the model has a
space marker after another character, so no merge crosses the start of a pre-token, and each can be encoded by itself: the marker
that the model puts before a text stands for the pre-token's first space. The model is checked for this when it is loaded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import written

MARKER = "▁"
RUN = re.compile(r" *[^ ]+| +$")
#: Pre-tokens whose counts are broadcast: so many of the most frequent ones, none longer than FREQUENT_CHARS (at most 64 MB).
FREQUENT = 250_000
FREQUENT_CHARS = 64
#: Distinct pre-tokens that a task holds before it hands on what it has counted.
HELD = 300_000


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space, in order."""
    if not text:
        return []
    text = text.replace(MARKER, " ")  # the model cannot tell them apart
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in RUN.findall(" " + text)]


@lru_cache(maxsize=2)
def load(content: bytes):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=content)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARKER in p.lstrip(MARKER)]
    if crossing or model.encode("a  b", out_type=str)[0][0] != MARKER:
        raise ValueError("the model's pieces cross spaces, or it does not keep them: pre-tokens would not be independent")
    return model


def piece_counts(content: bytes, keys: list[str]) -> list[int]:
    """Pieces of each pre-token; the empty one is a single space."""
    return [max(1, len(ids)) for ids in load(content).encode(keys, num_threads=1)]


def distinct_pre_tokens(docs: DataFrame) -> DataFrame:
    """(pre_token, freq) over all documents, summed in the tasks before the shuffle."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(pre_tokens(text or ""))
                if len(counts) >= HELD:
                    yield pd.DataFrame({"pre_token": list(counts), "freq": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"pre_token": list(counts), "freq": list(counts.values())})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(scan, "pre_token string, freq long")
    return found.groupBy("pre_token").agg(F.sum("freq").alias("freq"))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document's whole text, one row per row; null text is empty: no bytes, no tokens.

    Every distinct pre-token is encoded once. The counts of the most frequent ones are broadcast (a fixed number) and summed where the
    text is read; the others join as (row, pre-token, frequency), so no pre-token with many rows is ever shuffled by its key.
    ``path`` is the model file, read on the driver; its size does not depend on the data.
    """
    context = docs.sparkSession.sparkContext
    content = context.broadcast(open(path, "rb").read())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(pieces=piece_counts(content.value, batch["pre_token"].tolist()))

    table = written(distinct_pre_tokens(docs).mapInPandas(encode, "pre_token string, freq long, pieces int"), "pre-tokens")
    frequent = table.where(F.length("pre_token") <= FREQUENT_CHARS).orderBy(F.desc("freq"), "pre_token").limit(FREQUENT)
    known = context.broadcast({r["pre_token"]: r["pieces"] for r in frequent.select("pre_token", "pieces").toLocalIterator()})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = known.value
        for batch in batches:
            bytes_, sums, rare = [], [], []
            for text in batch["text"]:
                text = text or ""
                total, other = 0, []
                for key, n in Counter(pre_tokens(text)).items():
                    pieces = counts.get(key)
                    if pieces is None:
                        other.append({"pre_token": key, "n": n})
                    else:
                        total += n * pieces
                bytes_.append(len(text.encode("utf-8", "surrogatepass")))
                sums.append(total)
                rare.append(other)
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "n_bytes": bytes_, "known": sums, "rare": rare})

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partial = written(rows.mapInPandas(
        scan, "row long, doc_id long, n_bytes long, known long, rare array<struct<pre_token:string,n:long>>"), "token-sums")
    rare = partial.select("row", F.explode("rare").alias("r")).select("row", "r.pre_token", "r.n")
    joined = rare.join(table.select("pre_token", "pieces"), "pre_token")
    others = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("others"))
    total = (F.col("known") + F.coalesce("others", F.lit(0))).alias("n_tokens")
    return partial.select("row", "doc_id", "n_bytes", "known").join(others, "row", "left").select("doc_id", "n_bytes", total).withColumn(
        "over_limit", F.col("n_tokens") > limit)
