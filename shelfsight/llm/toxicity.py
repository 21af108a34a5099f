"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model over the characters of words: the probability of a character after up to four others. Discounted counts
of the longest context back off to numbers of distinct characters met before the shorter ones, down to single characters, whose counts both classes
share. Contexts are also drawn towards the next shorter one by a fixed number of pseudo-counts (``SHARED``), so that rare expressions come out of
common parts and prove little. A word's evidence is the difference of its toxic and ordinary log-likelihoods, a text's the sum over its words divided
by their number, over the whole text and over its most toxic words. A logistic fit turns these into a probability; it sees every training document
through the model of the other half of the training documents.

The counts come from every labelled training document and none is left out. They become two numbers per character sequence, in Spark tables: the
difference of the longest counted sequence and that of a context's back-off weight. The most frequent sequences (``MOST_GRAMS``) are sent to the texts; words
that need others meet them by a join, with the same result. Texts are read once for the counts and once for the scores. Only the logistic fit
sees a bounded sample (``PER_CLASS`` documents of each class).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import id_fold, label_sample, most_frequent, one_label, written

#: Documents of each class that the logistic fit of the features sees.
PER_CLASS = 4000
#: Longest sequence: a character and its context.
ORDER = 5
DISCOUNT = 0.75
#: Pseudo-counts by which every context is drawn towards the next shorter one.
SHARED = 30.0
#: Sequences that are sent to the tasks at most (32 bytes each); the others are joined.
MOST_GRAMS = 1_200_000
#: Bits of the filter that spares the join words without a joined sequence (8 MB at any size; it passes every sequence, and more others as it fills).
FILTER_BITS = 26
#: Training labels up to this number (about 40 MB in memory) are sent to the texts; more meet them by a shuffle of the texts, with the same result.
SENT_LABELS = 1_000_000
#: Distinct words that a task holds before it hands their counts on, and whose evidence it remembers.
HELD_WORDS = 300_000
#: Texts and new words that are looked up at a time.
SLICE_ROWS, SLICE_WORDS = 256, 20_000
TOP_WORDS = 3
#: Differences beyond this one mark a word as toxic; their excess is averaged over the text.
MARKED = 1.0
PREDICTED = 0.3
#: Longer runs are cut, so that a word is bounded.
WORD = re.compile(r"\w{1,64}")
BEGIN, END = "\x02", "\x03"
#: Models of the other half of the training documents, for documents of half 0 and 1, and of all.
VIEWS = 3
FEATURES = 5


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


# --- counting ----------------------------------------------------------------------------------------------------------------------------------


def word_counts(chosen: DataFrame) -> DataFrame:
    """(word, n00, n01, n10, n11): counts of every training word by label and half, summed within tasks first."""

    def table(counts: dict[int, Counter]) -> pd.DataFrame:
        words = list(set().union(*counts.values()))
        return pd.DataFrame({"word": words, **{f"n{g >> 1}{g & 1}": list(map(counts[g].__getitem__, words)) for g in range(4)}})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {g: Counter() for g in range(4)}
        for batch in batches:
            for text, label, half in zip(batch["text"], batch["label"], batch["half"]):
                counts[int(label) * 2 + int(half)].update(words_of(text))
                if sum(map(len, counts.values())) > HELD_WORDS:
                    yield table(counts)
                    counts = {g: Counter() for g in range(4)}
        if any(counts.values()):
            yield table(counts)

    names = [f"n{g >> 1}{g & 1}" for g in range(4)]
    found = chosen.select("text", "label", "half").mapInPandas(scan, "word string, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def per_view(name: str) -> list[str]:
    return [f"{name}{c}_{v}" for c in (0, 1) for v in range(VIEWS)]


def top_grams(words: DataFrame) -> DataFrame:
    """(gram, n, k0_0 ... k1_2): every character of every word with its longest context, counted for each class and view."""
    marked = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    ends = F.sequence(F.lit(2), F.length(marked))
    grams = F.transform(ends, lambda i: marked.substr(F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))
    seen = {f"k{c}_{v}": F.col(f"n{c}1") if v == 0 else F.col(f"n{c}0") if v == 1 else F.col(f"n{c}0") + F.col(f"n{c}1") for c in (0, 1) for v in range(VIEWS)}
    spread = words.select(F.explode(grams).alias("gram"), *[x.cast("double").alias(name) for name, x in seen.items()])
    return spread.groupBy("gram").agg(F.sum(F.col("k0_2") + F.col("k1_2")).alias("n"), *[F.sum(name).alias(name) for name in per_view("k")])


def levels(top: DataFrame) -> dict[int, DataFrame]:
    """The counts of every length: occurrences of the longest and of those that begin a word, else distinct characters met before."""
    out = {ORDER: top.where(F.length("gram") == ORDER)}
    for length in range(ORDER - 1, 0, -1):
        shorter = out[length + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(
            F.sum("n").alias("n"), *[F.sum((F.col(name) > 0).cast("double")).alias(name) for name in per_view("k")])
        out[length] = written(shorter.unionByName(top.where(F.length("gram") == length)), f"grams-{length}")
    return out


def kneser_ney(top: DataFrame) -> tuple[DataFrame, list[float]]:
    """(gram, n, r0, r1, r2, b0, b1, b2) of every counted sequence and context, and b of the empty context.

    r is the log ratio of the classes' probabilities of the last character after the others (null for what is only a context), b that of the
    back-off weights of the sequence as a context.
    """
    counts = levels(top)
    parts, low = [], None
    context_stats = [a for name in per_view("") for a in (F.sum(f"k{name}").alias(f"t{name}"), F.sum((F.col(f"k{name}") > 0).cast("double")).alias(f"u{name}"))]

    def weight(name: str) -> Column:
        """What a context leaves to the shorter one."""
        return (DISCOUNT * F.col(f"u{name}") + SHARED) / (F.col(f"t{name}") + SHARED)

    def log_ratio(v: int, value) -> Column:
        return F.log(value(f"1_{v}")) - F.log(value(f"0_{v}"))

    root = counts[1].agg(*context_stats, F.count("*").alias("types")).first()
    for length in range(1, ORDER + 1):
        table = counts[length].withColumn("context", F.col("gram").substr(F.lit(1), F.lit(length - 1)))
        if length == 1:
            both = [float(root[f"t0_{v}"] or 0) + float(root[f"t1_{v}"] or 0) for v in range(VIEWS)]
            table = table.withColumns({name: F.lit(float(root[name] or 0)) for name in (*per_view("t"), *per_view("u"))})
            shared = {v: (F.col(f"k0_{v}") + F.col(f"k1_{v}") + 0.5) / (both[v] + 0.5 * (root["types"] + 1)) for v in range(VIEWS)}
            table = table.withColumns({f"low{c}_{v}": shared[v] for c in (0, 1) for v in range(VIEWS)})
        else:
            contexts = table.groupBy("context").agg(*context_stats)
            parts.append(contexts.select(F.col("context").alias("gram"), F.lit(0.0).alias("n"), *[F.lit(None).cast("float").alias(f"r{v}") for v in range(VIEWS)],
                                         *[log_ratio(v, weight).cast("float").alias(f"b{v}") for v in range(VIEWS)]))
            suffix = low.select(F.col("gram").alias("suffix"), *[F.col(f"p{name}").alias(f"low{name}") for name in per_view("")])
            table = table.join(contexts, "context").withColumn("suffix", F.expr("substring(gram, 2)")).join(suffix, "suffix")
        p = {f"p{name}": F.greatest(F.col(f"k{name}") - DISCOUNT, F.lit(0.0)) / (F.col(f"t{name}") + SHARED) + weight(name) * F.col(f"low{name}") for name in per_view("")}
        low = written(table.select("gram", "n", *[x.alias(name) for name, x in p.items()]), f"probabilities-{length}")
        parts.append(low.select("gram", "n", *[log_ratio(v, lambda name: F.col(f"p{name}")).cast("float").alias(f"r{v}") for v in range(VIEWS)],
                                *[F.lit(0.0).cast("float").alias(f"b{v}") for v in range(VIEWS)]))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # a sequence comes as itself and as a context: its own row has b = 0, the context's row no r
    entries = union.groupBy("gram").agg(F.max("n").alias("n"), *[F.max(f"r{v}").alias(f"r{v}") for v in range(VIEWS)], *[F.sum(f"b{v}").cast("float").alias(f"b{v}") for v in range(VIEWS)])
    value = lambda name: (DISCOUNT * float(root[f"u{name}"] or 0) + SHARED) / (float(root[f"t{name}"] or 0) + SHARED)
    return written(entries, "kneser-ney"), [float(np.log(value(f"1_{v}")) - np.log(value(f"0_{v}"))) for v in range(VIEWS)]


# --- scoring -----------------------------------------------------------------------------------------------------------------------------------


def extended(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit numbers of sequences with one more character before them."""
    mixed = (keys ^ (codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_keys(grams: list[str]) -> np.ndarray:
    """Numbers of sequences of any lengths."""
    out, lengths = np.zeros(len(grams), dtype=np.uint64), np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        codes = code_points("".join(map(grams.__getitem__, at.tolist()))).reshape(len(at), length)
        keys = np.zeros(len(at), dtype=np.uint64)
        for k in range(length - 1, -1, -1):
            keys = extended(keys, codes[:, k])
        out[at] = keys
    return out


class Entries:
    """r and b of sequences by their numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        # numbers are spread evenly: their first bits lead to a few neighbours
        self.shift = np.uint64(64 - max(4, len(keys).bit_length()))
        heads = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(self.keys, heads), len(self.keys)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether there is an entry)."""
        head = (keys >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        hit = np.zeros(len(keys), dtype=bool)
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.keys[at[left]] == keys[left]
            hit[left[same]] = True
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return np.where(hit, at, 0), hit


class Filter:
    """Two bits per sequence; one without both has no entry."""

    def __init__(self, words: np.ndarray, masks: np.ndarray):
        self.masks = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
        self.masks[words] = masks

    @staticmethod
    def bits(keys: np.ndarray) -> np.ndarray:
        return np.stack([(keys >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1) for shift in (0, 30)]).astype(np.int64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        first, second = ((self.masks[bit >> 6] >> (bit & 63)) & 1 == 1 for bit in self.bits(keys))
        return first & second


def evidence(words: list[str], view: int, entries: Entries, root: list[float], possible: Filter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood difference of every word, whether it may need sequences that ``entries`` lacks)."""
    text = "".join(f"{BEGIN}{w}{END}" for w in words)
    codes = code_points(text)
    starts = np.flatnonzero(codes == ord(BEGIN))
    depth = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))  # characters before, in the word
    total, pending = np.full(len(codes), root[view]), np.zeros(len(codes), dtype=bool)
    keys, before = np.zeros(len(codes), dtype=np.uint64), None
    for length in range(1, ORDER + 1):
        # sequences of this length that end at each place; a place nearer to the word's begin keeps what it has
        fits = depth >= length - 1
        at = np.flatnonzero(fits)
        keys = np.where(fits, extended(keys, codes[np.maximum(np.arange(len(codes)) - (length - 1), 0)]), keys)
        place, hit = entries.find(keys[at])
        r, b = np.full(len(codes), np.nan), np.zeros(len(codes))
        if len(entries.keys):
            r[at] = np.where(hit, entries.values[place, view], np.nan)
            b[at] = np.where(hit, entries.values[place, VIEWS + view], 0.0)
        if possible is not None:
            pending[at] |= ~hit & possible.passes(keys[at])
        back_off = np.roll(before, 1) if before is not None else np.zeros(len(codes))  # of the context, one place before
        longer = total + back_off if length > 1 else total
        total = np.where(fits, np.where(np.isnan(r), longer, r), total)
        before = b
    total[starts] = 0.0  # the begin itself is not predicted
    return np.add.reduceat(total, starts), np.logical_or.reduceat(pending, starts)


def features(ratios: np.ndarray, counts: np.ndarray) -> tuple[float, float, list[float], int]:
    """(sum, excess, highest, number) of the words of a text; parts of a text add up."""
    top = ratios if len(ratios) <= TOP_WORDS else np.partition(ratios, -TOP_WORDS)[-TOP_WORDS:]
    highest = np.sort(np.repeat(ratios[ratios >= top.min()], np.minimum(counts[ratios >= top.min()], TOP_WORDS)))[::-1][:TOP_WORDS] if len(ratios) else ratios
    return float(ratios @ counts), float(np.maximum(ratios - MARKED, 0) @ counts), highest.tolist(), int(counts.sum())


def word_evidence(wanted: DataFrame, entries: DataFrame, root: list[float]) -> DataFrame:
    """(view, word, r) of words that need sequences beyond the ones that are sent; each distinct word meets its sequences once."""
    marked = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.length(marked)), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(i, F.lit(ORDER))), lambda length: marked.substr(i - length + 1, length))))
    names = [f"r{v}" for v in range(VIEWS)] + [f"b{v}" for v in range(VIEWS)]
    needed = wanted.select("view", "word").distinct().withColumn("gram", F.explode(F.array_distinct(windows)))
    met = needed.join(entries.select("gram", *names), "gram").groupBy("view", "word").agg(F.collect_list(F.struct("gram", *names)).alias("found"))  # at most ORDER x 66

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for view, word, found in zip(batch["view"], batch["word"], batch["found"]):
                values = np.array([[np.nan if f[n] is None else f[n] for n in names] for f in found], dtype=float)
                out.append(float(evidence([word], int(view), Entries(gram_keys([f["gram"] for f in found]), values), root)[0][0]))
            yield pd.DataFrame({"view": batch["view"], "word": batch["word"], "r": out})

    return met.mapInPandas(finish, "view int, word string, r double")


def text_features(texts: DataFrame, entries: DataFrame, root: list[float]) -> DataFrame:
    """The columns of ``texts`` but text and view, with features: zeros for a text without words. ``texts`` has text and view."""
    context = texts.sparkSession.sparkContext
    names = [f"r{v}" for v in range(VIEWS)] + [f"b{v}" for v in range(VIEWS)]
    sent = most_frequent(entries, F.col("n") + 1, MOST_GRAMS)
    table = entries.where(sent).select("gram", *names).toArrow()
    frequent = Entries(gram_keys(table["gram"].to_pylist()), np.column_stack([table[n].to_numpy().astype(np.float32) for n in names]))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Filter.bits(gram_keys(batch.column("gram").to_pylist())).ravel())], names=["bit"])

    masks = entries.where(~sent).select("gram").mapInArrow(bits, "bit long").groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow()  # at most 2^FILTER_BITS bits
    known = context.broadcast((frequent, Filter(masks["word"].to_numpy(), masks["mask"].to_numpy())))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, possible = known.value
        memory: dict[int, dict[str, float | None]] = {}
        for batch in (whole.iloc[at:at + SLICE_ROWS] for whole in batches for at in range(0, len(whole), SLICE_ROWS)):
            held = [Counter(words_of(text)) for text in batch["text"]]
            for view in set(batch["view"]):
                own = memory.setdefault(int(view), {})
                asked = set().union(*(h for h, v in zip(held, batch["view"]) if v == view))
                if len(own) + len(asked) > HELD_WORDS:
                    own.clear()
                fresh = [w for w in asked if w not in own]
                for at in range(0, len(fresh), SLICE_WORDS):
                    part = fresh[at:at + SLICE_WORDS]
                    ratios, pending = evidence(part, int(view), frequent, root, possible)
                    own.update(zip(part, [None if p else r for r, p in zip(ratios.tolist(), pending.tolist())]))
            parts, missing = [], []
            for counts, view in zip(held, batch["view"]):
                ratios = list(map(memory[int(view)].__getitem__, counts))
                n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                left = [{"word": w, "n": k} for (w, k), r in zip(counts.items(), ratios) if r is None] if None in ratios else []
                settled = np.array([np.nan if r is None else r for r in ratios], dtype=float)
                here = ~np.isnan(settled)
                parts.append(features(settled[here], n[here])[:3] + (int(n.sum()),))
                missing.append(left)
            yield batch.drop(columns=["text"]).assign(sum=[p[0] for p in parts], excess=[p[1] for p in parts], highest=[p[2] for p in parts], words=[p[3] for p in parts], missing=missing)

    kept = texts.withColumn("row", F.monotonically_increasing_id())
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes if n != "text") + ", sum double, excess double, highest array<double>, words long, missing array<struct<word:string,n:long>>"
    partial = written(kept.mapInPandas(read, schema), "partial-evidence")
    rare = partial.select("row", "view", F.explode("missing").alias("m")).select("row", "view", "m.word", "m.n")
    met = rare.join(word_evidence(rare, entries, root), ["view", "word"]).groupBy("row").agg(
        F.sum(F.col("r") * F.col("n")).alias("sum_more"), F.sum(F.greatest(F.col("r") - MARKED, F.lit(0.0)) * F.col("n")).alias("excess_more"),
        F.flatten(F.collect_list(F.array_repeat("r", F.least("n", F.lit(TOP_WORDS)).cast("int")))).alias("highest_more"))
    everything = partial.drop("missing").join(met, "row", "left")
    highest = F.slice(F.sort_array(F.concat("highest", F.coalesce("highest_more", F.array().cast("array<double>"))), False), 1, TOP_WORDS)
    n = F.greatest("words", F.lit(1))
    best = F.aggregate(highest, F.lit(0.0), lambda a, r: a + r) / TOP_WORDS
    values = [(F.col("sum") + F.coalesce("sum_more", F.lit(0.0))) / n, (F.col("excess") + F.coalesce("excess_more", F.lit(0.0))) / n, F.coalesce(F.get(highest, F.lit(0)), F.lit(0.0)), best, F.log(n)]
    return everything.select(*[c for c in texts.columns if c not in ("text", "view")], F.array(*[v.cast("double") for v in values]).alias("features"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last) of a weighted logistic fit by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    penalty = ridge * np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty, z.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def half_of(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), F.col(doc_id).cast("long")), F.lit(2)).cast("int")


def scored(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, digest, score): the digest is a 64-bit number of the text, which alone decides the score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    sample = written(label_sample(labels, "toxic", modulus, held_out, per_class), "label-sample")
    seen = docs.join(F.broadcast(sample), "doc_id").select("text", half_of("doc_id").alias("view"), "doc_id", "digest", "label", "weight")
    weights = {r["label"]: r["weight"] for r in seen.groupBy("label").agg(F.sum("weight").alias("weight")).collect()}  # two rows
    share = weights.get(1, 0.0) / sum(weights.values()) if weights else 0.0
    if not 0 < share < 1:
        return docs.select("doc_id", "digest", F.lit(float(share)).alias("score"))
    train = written(one_label(labels, "toxic").where(id_fold(F.col("doc_id"), modulus) != held_out), "labels")
    chosen = docs.join(F.broadcast(train) if train.count() <= SENT_LABELS else train, "doc_id").select("text", "label", half_of("doc_id").alias("half"))
    entries, root = kneser_ney(written(top_grams(word_counts(chosen)), f"grams-{ORDER}"))
    every = docs.select("text", F.lit(2).alias("view"), "doc_id", "digest", F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("weight"))
    found = written(text_features(every.unionByName(seen), entries, root), "evidence")
    table = found.where("label is not null").orderBy("doc_id", "features").toArrow().to_pandas()  # at most 2 x per_class documents
    mean, scale, beta = logistic(np.array(table["features"].tolist(), dtype=float).reshape(len(table), FEATURES), table["label"].to_numpy(dtype=float), table["weight"].to_numpy(dtype=float))
    line = F.lit(float(beta[-1]))
    for i in range(FEATURES):
        line = line + (F.col("features")[i] - float(mean[i])) / float(scale[i]) * float(beta[i])
    score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(500.0)), F.lit(-500.0))))
    return found.where("label is null").select("doc_id", "digest", score.alias("score"))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; score is the probability of being toxic.

    Null text is empty text; texts without words get the score of no evidence. Repeated rows are scored each; rows with null doc_id or
    label train nothing. Labels of the held-out fold are never read. With no labelled document of a class every score is that class's share.
    Other columns are not read.
    """
    return scored(docs, labels, modulus, held_out, per_class).select(
        "doc_id", (id_fold(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", F.when(F.col("score") >= PREDICTED, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they came, whatever their names.

    Rows that share an identifier are judged each by their text; a row without an identifier too. Rows alike in both go or stay together.
    """
    gone = scored(docs, labels, modulus, held_out, per_class).where(F.col("score") >= PREDICTED).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    same = F.col("whole.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce(F.col("whole.text").cast("string"), F.lit(""))) == F.col("gone_digest"))
    return inner.join(gone, same, "left_anti").select("whole.*")
