"""Classifiers by held-out accuracy, tokenisation against the libraries, preference pairs against a plain rendering, the pipeline end to end."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from shelfsight.llm import bpe, preference, quality, token_counts, toxicity
from shelfsight.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [None, "", " ", "  a  b ", "▁x ▁", "a\x00b\x1cc\x85d　e", "<|endoftext|>Hi<|startoftext|> THERE's<|endoftext|", "ΑΣ ΣΑΣ İ", "é ́x", "word " * 5000 + "\n" * 50,
             "x" * 4000, "ab" * 3000 + "é" * 900, "<s> </s> <unk> <0x0A>", "\U0001f600\U0001f468‍\U0001f469 1234 ٤٥", "don't I'LL we've", "loﬁ Å"]


def held_out(rows, labels, column):
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    chosen = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    ones, zeros = [s for s, y in chosen if y], [s for s, y in chosen if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


@pytest.mark.parametrize("name, column, least", [("op1_toxicity", "toxic", 0.8), ("op7_quality_classifier", "quality", 0.95)])
def test_held_out(spark, name, column, least):
    rows = QUERIES[name](spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert held_out(rows, spark.read.parquet(f"{MIDDLE}/labels.parquet"), column) >= least


@pytest.mark.parametrize("classify", [toxicity.classify, quality.classify])
def test_classifier_edges(spark, classify):
    texts = [(1, "good calm words here"), (2, "vile vile scum"), (3, None), (4, ""), (None, "scum"), (2, "vile vile scum"), (5, "long " * 30_000)]
    docs = spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, 0, 0), (None, 1, 1), (9, None, None), (1, 1, 0)], none.schema)
    for labels in (none, some):
        rows = classify(docs, labels).collect()
        assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert classify(docs.where("doc_id < 0"), some).collect() == []


def test_toxic_words_are_found(spark):
    random.seed(4)
    plain = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(400):
        words, bad = random.choices(plain, k=60), k % 5 == 0
        if bad:
            for _ in range(4):
                words[random.randrange(60)] = random.choice(["scumbag", "scummy", "vileness"])
        rows.append((k, " ".join(words), "x"))
        labels.append((k, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, half string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, marks).collect()}
    assert np.mean([got[k] == int(k % 5 == 0) for k in got]) >= 0.97


def texts_table(spark):
    return spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))


def test_bpe_equals_library(spark):
    library = Tokenizer.from_file(WORD_FILE)
    table = texts_table(spark)
    text = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    rows = bpe.encode(table, WORD_FILE).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    plain = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(table, WORD_FILE), WORD_FILE, plain=True).collect()}
    assert all(plain[i] == library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in text.items())


def test_streaming_is_stable():
    merges = bpe.load(open(WORD_FILE, encoding="utf-8").read())
    library = Tokenizer.from_file(WORD_FILE)
    random.seed(8)
    pieces = [t for t in merges.vocab if t.isascii() and t.isalpha()]
    for _ in range(30):
        word = "".join(random.choices(pieces, k=300))
        stream, step = bpe.Transducer(merges), random.choice([1, 7, 300])
        data = word.lower().encode()
        out = []
        for at in range(0, len(data), step):
            out += stream.feed(data[at:at + step])
            assert len(stream.pending) <= stream.window + step
        assert out + stream.finish() == library.encode(word, add_special_tokens=False).ids
    machine = bpe.Decoder(merges)
    ids = library.encode("naïve café \U0001f600!", add_special_tokens=False).ids
    assert "".join([*map(machine.feed, ids), machine.finish()]) == "naïve café \U0001f600! "


@pytest.mark.parametrize("frequent", [250_000, 5])
def test_token_counts(spark, frequent, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    table = texts_table(spark)
    text = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    rows = token_counts.count_tokens(table, PIECE_FILE).collect()
    assert len(rows) == len(text)
    for r in rows:
        n = len(model.encode(text[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 4096)
    assert token_counts.count_tokens(table.where("doc_id < 0"), PIECE_FILE).collect() == []


def test_preference_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|>"), (1, 2, "user", "and?"), (1, 3, "assistant", "no"), (2, 5, "user", "q"), (2, None, "system", None), (2, 9, "assistant", "late"),
             (3, 0, "user", "alone"), (None, 0, "user", "x"), (7, 0, "assistant", "same"), (8, 0, "assistant", "same")] + [(9, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(600)]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, chunk int")
    rows = sorted(preference.format_pairs(*preference.exchanged_replies(table)).collect(), key=lambda r: (r["pair_id"], r["chunk"]))
    got = {(r["pair_id"], r["chunk"]): r for r in rows}
    assert sorted(got) == [(1, 0), (2, 0), (7, 0), (8, 0), (9, 0), (9, 1), (9, 2)]
    one = got[1, 0]
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes <| im_end|><|im_end|>\n<|im_start|>user\nand?<|im_end|>\n"
    assert one["chosen"] == "<|im_start|>assistant\nno<|im_end|>\n" and one["rejected"] == "<|im_start|>assistant\nlate<|im_end|>\n"
    assert [one["chosen"][s["start"]:s["end"]] for s in one["chosen_loss"]] == ["no<|im_end|>\n"]
    assert [one["rejected"][s["start"]:s["end"]] for s in one["rejected_loss"]] == ["late<|im_end|>\n"]
    assert got[2, 0]["prompt"].startswith("<|im_start|>system\n<|im_end|>\n<|im_start|>user\nq") and got[2, 0]["rejected_loss"]
    assert (got[7, 0]["shared_turns"], got[7, 0]["chosen"], got[7, 0]["rejected"], got[7, 0]["chosen_loss"]) == (1, "", "", [])
    whole = "".join(r["prompt"] + r["chosen"] for r in rows if r["pair_id"] == 9)
    assert whole == "".join(f"<|im_start|>{'user' if k % 2 == 0 else 'assistant'}\nt{k}<|im_end|>\n" for k in range(600))
    assert preference.format_pairs(*preference.exchanged_replies(table.where("conv_id < 0"))).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, current = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SMALL)
        assert current.columns == columns, name
    rows = corpus_pipeline.run(spark, SMALL).collect()
    library = Tokenizer.from_file(WORD_FILE)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows and len(rows) == current.count()
    for r in rows:
        assert r["ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).collect() == []


def test_toxicity_keeps_every_entry(spark, monkeypatch):
    """Rare sequences give the same score however few entries are sent to the tasks."""
    random.seed(6)
    plain, rows, labels = [f"w{k}" for k in range(200)], [], []
    for k in range(300):
        words, bad = random.choices(plain, k=40), k % 6 == 0
        if bad:
            words[10:12] = [f"vile{k // 12}", f"w{k // 12}"]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows + [(900, "zyx unseen w1"), (901, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, marks).collect()}
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 5)
    few = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, marks).collect()}
    assert few == pytest.approx(whole, abs=1e-9)
    assert np.mean([whole[k] >= 0.3 for k in range(300) if k % 6 == 0]) >= 0.9


def plain_kneser_ney(words, view):
    """Log-likelihood difference of a word by the definition, from (word, label, half) of every training word."""
    order, d, shared = toxicity.ORDER, toxicity.DISCOUNT, toxicity.SHARED
    halves = {0: (1,), 1: (0,), 2: (0, 1)}[view]
    counts = [[Counter() for _ in range(order + 1)] for _ in (0, 1)]
    for c in (0, 1):
        for word, label, half in words:
            s = f"{toxicity.BEGIN}{word}{toxicity.END}"
            if label == c and half in halves:
                for i in range(1, len(s)):
                    g = s[max(0, i - order + 1):i + 1]
                    counts[c][len(g)][g] += 1
        for n in range(order - 1, 0, -1):
            for g in counts[c][n + 1]:
                counts[c][n][g[1:]] += 1
    types = len({g for w, _, _ in words for g in w + toxicity.END}) + 1
    both = sum(sum(counts[c][1].values()) for c in (0, 1))

    def p(c, g):
        low = p(c, g[1:]) if len(g) > 1 else (counts[0][1][g] + counts[1][1][g] + 0.5) / (both + 0.5 * types)
        same = [n for h, n in counts[c][len(g)].items() if h[:-1] == g[:-1]]
        return (max(counts[c][len(g)][g] - d, 0) + (d * len(same) + shared) * low) / (sum(same) + shared)

    def difference(word):
        s = f"{toxicity.BEGIN}{word}{toxicity.END}"
        grams = [s[max(0, i - order + 1):i + 1] for i in range(1, len(s))]
        return sum(math.log(p(1, g)) - math.log(p(0, g)) for g in grams)

    return difference


def test_kneser_ney_by_the_definition(spark):
    texts = [(1, "good calm good day", 0, 0), (2, "scum scummy day", 1, 0), (3, "scum vile goods", 1, 1), (4, "calm days and calmer", 0, 1), (5, "day", 0, 0), (6, "vile viler", 1, 0)]
    chosen = spark.createDataFrame([(t, y, h) for _, t, y, h in texts], "text string, label int, half int")
    entries, root = toxicity.kneser_ney(toxicity.top_grams(toxicity.word_counts(chosen)))
    rows = entries.collect()
    table = toxicity.Entries(toxicity.gram_keys([r["gram"] for r in rows]), np.array([[np.nan if r[f"r{v}"] is None else r[f"r{v}"] for v in range(3)] + [r[f"b{v}"] for v in range(3)] for r in rows]))
    counted = [(w, y, h) for _, t, y, h in texts for w in t.split()]
    asked = ["scum", "good", "calmest", "zzz", "a", "scummiest", "dayday", "vile", "é"]
    for view in range(3):
        want = list(map(plain_kneser_ney(counted, view), asked))
        assert toxicity.evidence(asked, view, table, root)[0].tolist() == pytest.approx(want, abs=1e-5)
        assert want[0] > want[1]


def test_features_add_up():
    random.seed(2)
    for _ in range(50):
        r, n = np.array([random.choice([-1.0, 0.5, 2.0, 3.0, 7.5]) + random.random() for _ in range(random.randrange(9))]), None
        n = np.array([random.randrange(1, 5) for _ in r], dtype=np.int64)
        total, excess, highest, count = toxicity.features(r, n)
        spread = sorted((x for x, k in zip(r, n) for _ in range(k)), reverse=True)
        assert highest == spread[:3] and count == len(spread) and total == pytest.approx(sum(spread)) and excess == pytest.approx(sum(max(x - 1, 0) for x in spread))


def test_toxic_rows_go_by_their_text(spark):
    """Null and repeated identifiers, odd column names; a clean row with the identifier of a toxic one stays."""
    train = [(k, "vile scum here" if k % 2 else "calm good words", int(k % 2)) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in train], "doc_id long, quality int, toxic int")
    extra = [(None, "vile scum here"), (None, "calm good words"), (1, "calm good words"), (2, "vile scum here"), (2, "vile scum here")]
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t, _ in train] + [(*e, "x", "y", "z") for e in extra], "doc_id long, text string, `a.b` string, digest string, score string")
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(k, t) for k, t, y in train if not y] + [(None, "calm good words"), (1, "calm good words")])
