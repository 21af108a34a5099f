"""Token alignment against a plain loop over texts, tokens and links."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfsight.llm import alignment
from shelfsight.llm.bpe import byte_alphabet
from shelfsight.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a  b\n\nc   d", "▁x", "x ▁", "naïve café \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> <s></s><unk>", "a\x00b\x1cc\x85d　e", "ﬁ ① Å ́x",
       "don't I'LL we've 1234567", "x" * 3000, "ab" * 900 + "é" * 300, "token " * 400, "0x" + "deadbeef" * 50, "\n", "\r\n\tx", "日本語のテキスト。 中文", "a b", "a b"]


def plain(texts):
    a_side, b_side = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_side.encode_special_tokens = True
    of_char = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
    rows, where = [], defaultdict(int)
    for text in texts:
        data = b" " + (text or "").encode()
        sides = []
        for ids, spell in ((a_side.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: b"".join(of_char[c] for c in a_side.id_to_token(i))),
                           (b_side.encode(text or ""), lambda i: bytes.fromhex(m[1]) if (m := re.fullmatch("<0x(..)>", b_side.id_to_piece(i))) else b_side.id_to_piece(i).replace("▁", " ").encode())):
            at, ends, joined = 0, [], b""
            for i in ids:
                joined += spell(i)
                ends.append(len(joined))
            sides.append((ids, ends, joined == data))
        (a, a_ends, a_ok), (b, b_ends, b_ok) = sides
        if not text or not a_ok or not b_ok:
            rows.append(None)
            continue
        cuts, groups, s, t = sorted(set(a_ends) & set(b_ends)), [], 0, 0
        for cut in cuts:
            e, f = a_ends.index(cut) + 1, b_ends.index(cut) + 1
            groups.append((a[s:e], b[t:f]))
            s, t = e, f
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        for pair in links:
            where[pair] += 1
        rows.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in where.items():
        best[x] = max(best[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(m for p, m in links.items() if where[p] == best[p[0]]), sum(m * where[p] for p, m in links.items()),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_given_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_tokenizer_alignment"](spark, SMALL).collect()}
    assert got == {i: want for (i, _), want in zip(texts, plain([t for _, t in texts]))}


@pytest.mark.parametrize("sent, links, chars, held", [(1_000_000, 1 << 22, 1 << 20, 2_000_000), (5, 64, 200, 10), (0, 1, 7, 1)])
def test_odd_texts(spark, monkeypatch, sent, links, chars, held):
    """Whatever is sent, spelled out or tokenised at a time: the same rows; names clash, ids are null, rows repeat."""
    for name, value in (("MOST_PAIRS", sent), ("HELD_LINKS", links), ("HELD_PAIRS", held), ("SLICE_CHARS", chars)):
        monkeypatch.setattr(alignment, name, value)
    docs = spark.createDataFrame([(None if k == 4 else k, t, "r", 1, "p", "b") for k, t in enumerate(ODD)], "doc_id long, text string, row string, n_a int, pair string, best string")
    rows = alignment.align(docs, *FILES).collect()
    want = Counter((None if k == 4 else k, *w) for k, w in enumerate(plain(ODD)))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in rows) == want
    assert alignment.align(docs.where("false"), *FILES).collect() == []


def test_long_texts_are_tokenised_in_parts(monkeypatch):
    text = "one two  three\nfour five ▁ six seven,eight 日本 nine " * 40
    sides = alignment.load(*(open(f, "rb").read() for f in FILES))
    whole = sides.encode([text, "a b", text])
    monkeypatch.setattr(alignment, "SLICE_CHARS", 30)
    assert len(alignment.parted(text)) > 20 and sides.encode([text, "a b", text]) == whole


def test_ranks_equal_the_library():
    """Every character that goes by ranks, in several surroundings."""
    sides = alignment.load(*(open(f, "rb").read() for f in FILES))
    assert sides.a_ranks is not None
    for c in [*range(0x250), *range(0x2000, 0x2070)]:
        c = chr(c)
        for text in (f" a{c}b", f" {c}", f" 1{c}2 {c}{c} x{c} {c}y  {c}", f" '{c}.{c}\n{c} <|endoftext|>"):
            assert not alignment.UNSTABLE.search(text)
            assert sides.a_ids(text) == sides.a.encode(text, add_special_tokens=False).ids
