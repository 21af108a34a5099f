"""Byte-pair encoding and decoding of whole texts with a fixed merge list, in constant memory.

``Merges.lookahead`` is the number of symbols to the right of a token that can decide whether it comes about, computed from the
merge list alone. Streaming therefore merges a bounded window and emits every token that ends at least that far from its end: such a
token is stable, whatever follows. A boundary of the final tokens is crossed by no merge, so the rest of the window can be merged
again from there. Decoding is a state machine from tokens to text that holds back the bytes of an unfinished character.

Behaviour of the tokenizer file: special tokens are cut out of the raw text, the rest is brought to NFC, white space runs become one space,
letters are lower-cased one by one, pieces are matched by one pattern, and a piece's UTF-8 bytes are its symbols, the last
with the word end.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the file's pre-tokenizer.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s+")
#: Code points that str.split() takes for white space and the pattern does not.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")

BLOCK_CHARS = 1 << 16
LONG_PIECE = 64
REMEMBERED = 150_000
PACKING = [f"<{n}I" for n in range(64)]
FLUSH_WORDS = 150_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Vocabulary and ranked merges of one tokenizer file."""

    def __init__(self, content: str):
        file = json.loads(content)
        model = file["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.alphabet = byte_alphabet()
        self.plain_id = [self.vocab[c] for c in self.alphabet]
        self.end_id = [self.vocab[c + self.suffix] for c in self.alphabet]
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.result = [self.vocab[a + b] for a, b in pairs]
        self.width = {i: self._length(t) for t, i in self.vocab.items()}
        self.lookahead = self._lookahead(pairs)
        self.window = max(2 * self.lookahead, 128)
        order = np.argsort(keys := np.array(list(self.rank), dtype=np.int64))
        self.sorted_keys, self.sorted_ranks = keys[order], order
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _length(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Longest chain of contests, in symbols.

        Whether (A, B) merges can depend on what follows B only if an earlier merge (B, C) takes B away; that merge depends on
        its C having come about and on an earlier merge (C, D), and so on. ``taken[B]`` is the furthest symbol, counted from B's end, that
        the earlier merges which start with B depend on, ``made[T]`` the same for T having come about.
        """
        taken: dict[str, int] = {}
        made: dict[str, int] = {}
        furthest = 0
        for left, right in pairs:
            contested = taken.get(right, 0)
            whole = max(made.get(right, 0), contested, made.get(left, 0) - self._length(right), 0)
            made[left + right] = max(made.get(left + right, 0), whole)
            taken[left] = max(taken.get(left, 0), self._length(right) + max(made.get(right, 0), contested))
            furthest = max(furthest, taken[left], whole)
        return furthest

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merges in rank order, leftmost first, to a list that it may change."""
        rank, none = self.rank.get, len(self.result)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at:at + 2] = [self.result[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | ids[at], none)
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 32 | ids[at + 1], none)
        return ids

    def ids(self, piece: str) -> list[int]:
        """Token ids of one piece; one that does not fit the window goes through it."""
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= self.window:
            return self.merge([*map(self.plain_id.__getitem__, data[:-1]), self.end_id[data[-1]]])
        stream = Transducer(self)
        return [i for at in range(0, len(data), 256) for i in stream.feed(data[at:at + 256])] + stream.finish()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.sorted_ranks[at], len(self.result))

    def ids_of_many(self, pieces: list[str]) -> dict[str, list[int]]:
        """``ids`` of many pieces; short ones of one length take their merges in lockstep, one merge a step."""
        done: dict[str, list[int]] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if len(data) > LONG_PIECE:
                done[piece] = self.ids(piece)
            else:
                by_length.setdefault(len(data), []).append((piece, data))
        plain, end, none = np.array(self.plain_id), np.array(self.end_id), len(self.result)
        result = np.array(self.result)
        for length, group in by_length.items():
            data = np.frombuffer(b"".join(d for _, d in group), dtype=np.uint8).reshape(-1, length)
            table = plain[data]
            table[:, -1] = end[data[:, -1]]
            rows, width = np.arange(len(group)), length
            while width > 1 and len(rows):
                # all rows that are still merging have the same number of symbols left
                ranks = self._ranks(table[:, :-1], table[:, 1:]) if width == length else ranks
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                stop = best == none
                if stop.any():
                    for row, left in zip(rows[stop].tolist(), table[stop].tolist()):
                        done[group[row][0]] = left
                    rows, table, ranks, at, best = rows[~stop], table[~stop], ranks[~stop], at[~stop], best[~stop]
                    if not len(rows):
                        break
                columns, line = np.arange(width - 1), np.arange(len(rows))
                table = np.take_along_axis(table, columns[None, :] + (columns[None, :] > at[:, None]), axis=1)
                table[line, at] = result[best]
                width -= 1
                if width > 1:
                    ranks = np.take_along_axis(ranks, columns[None, :-1] + (columns[None, :-1] >= at[:, None]), axis=1)
                    before, after = at > 0, at < width - 1
                    ranks[line[before], at[before] - 1] = self._ranks(table[line[before], at[before] - 1], table[line[before], at[before]])
                    ranks[line[after], at[after]] = self._ranks(table[line[after], at[after]], table[line[after], at[after] + 1])
            for row, left in zip(rows.tolist(), table.tolist()):
                done[group[row][0]] = left
        return done

    def entries(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Of each word: its ids as bytes, and its token strings joined by spaces. A bounded number is remembered between calls."""
        known = self.known
        fresh = {w: pieces(w) for w in words if w not in known}
        ids = self.ids_of_many(list({p for found in fresh.values() for p in found}))
        if len(known) + len(fresh) > REMEMBERED:
            kept = {w: known[w] for w in words if w in known}
            known.clear()
            known.update(kept)
        out = known
        if len(known) + len(fresh) > REMEMBERED:
            out = dict(known)
        token = self.token.__getitem__
        for word, found in fresh.items():
            own = ids[found[0]] if len(found) == 1 else [i for p in found for i in ids[p]]
            out[word] = struct.pack(PACKING[len(own)] if len(own) < len(PACKING) else f"<{len(own)}I", *own), " ".join(map(token, own)).encode()
        return out


class Transducer:
    """Emits the tokens of one piece as soon as they are stable; holds one window of symbols beyond what one feed brings."""

    def __init__(self, merges: Merges):
        self.merges, self.pending, self.last = merges, [], b""
        self.window = merges.window

    def feed(self, data: bytes) -> list[int]:
        data = self.last + data
        self.last = data[-1:]  # the last byte may turn out to end the piece
        self.pending += map(self.merges.plain_id.__getitem__, data[:-1])
        out = []
        while len(self.pending) > self.window:
            at = 0
            for token in self.merges.merge(self.pending[: self.window]):
                if at + self.merges.width[token] > self.window - self.merges.lookahead:
                    break
                at += self.merges.width[token]
                out.append(token)
            if not at:
                self.window *= 2  # a token longer than the stable part of the window
            self.pending = self.pending[at:]
        return out

    def finish(self) -> list[int]:
        return self.merges.merge([*self.pending, self.merges.end_id[self.last[0]]]) if self.last else []


class Decoder:
    """Tokens to text, one at a time. ``plain`` joins the token strings by spaces, as for a file that names no decoder;
    otherwise bytes become characters as soon as they are whole, a word end becomes a space, malformed bytes U+FFFD."""

    def __init__(self, merges: Merges, plain: bool = False):
        self.merges, self.plain, self.first = merges, plain, True
        self.byte = {c: b for b, c in enumerate(merges.alphabet)}
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        token = self.merges.token[token_id]
        if self.plain:
            lead, self.first = "" if self.first else " ", False
            return lead + token
        if token in self.merges.special:
            return self.text.decode(b"", True) + token
        ends = bool(self.merges.suffix) and token.endswith(self.merges.suffix)
        data = bytes(self.byte[c] for c in (token.removesuffix(self.merges.suffix) if ends else token))
        return self.text.decode(data, ends) + (" " if ends else "")

    def finish(self) -> str:
        return "" if self.plain else self.text.decode(b"", True)


@lru_cache(maxsize=2)
def load(content: str) -> Merges:
    return Merges(content)


def _blocks(text: str) -> Iterator[str]:
    """Cuts a text before white space, which no piece contains, so that blocks can be taken one by one."""
    at = 0
    while at < len(text):
        if len(text) - at <= BLOCK_CHARS:
            yield text[at:]
            return
        space = SPACE.search(text, at + BLOCK_CHARS)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def words_of(block: str) -> list[str]:
    """White-space delimited words in NFC and lower case; no piece reaches across white space."""
    flat = unicodedata.normalize("NFC", block)
    # case mapping has no context here: a capital sigma becomes the ordinary small one wherever it stands
    flat = flat.replace("\u03a3", "\u03c3").lower()
    return flat.split() if not ODD_SPACE.search(flat) else SPACE.split(flat)


def pieces(word: str) -> list[str]:
    if word.isalpha():
        return [word]
    if word[:-1].isalpha() and word[-1] in ".,":
        return [word[:-1], word[-1]]
    if not word.isascii() and any(c > "\u0530" and unicodedata.category(c) == "Cn" for c in word):  # letters of later Unicode versions
        shadow = "".join("!" if unicodedata.category(c) == "Cn" else c for c in word)
        return [word[m.start():m.end()] for m in PIECE.finditer(shadow)]
    return PIECE.findall(word)


def parts_of(merges: Merges, text: str) -> Iterator[str | list[str]]:
    """Special tokens as they stand, and the words of what is between them, block by block."""
    for part in merges.cut.split(text) if merges.cut and "<" in text else [text]:
        if part in merges.special:
            yield part
        else:
            yield from map(words_of, _blocks(part))


class Digests:
    """Ids of one document, as they come: their number, digests, and the ids themselves if wanted."""

    def __init__(self, with_ids: bool):
        self.ids_hash, self.text_hash, self.count, self.ids = hashlib.sha256(), hashlib.sha256(), 0, [] if with_ids else None

    def add(self, ids: bytes, tokens: bytes) -> None:
        if ids:
            self.ids_hash.update(ids)
            self.text_hash.update(b" " + tokens if self.count else tokens)
            self.count += len(ids) // 4
            if self.ids is not None:
                self.ids.append(ids)


def encode_batch(merges: Merges, texts: list[str], with_ids: bool) -> list[Digests]:
    """Encodes texts, looking up the words of about ``FLUSH_WORDS`` at a time."""
    out = [Digests(with_ids) for _ in texts]
    waiting: list[tuple[Digests, str | list[str]]] = []
    held = 0

    def flush() -> None:
        entries = merges.entries({w for _, part in waiting if isinstance(part, list) for w in part})
        for digests, part in waiting:
            if isinstance(part, str):
                digests.add(struct.pack("<I", merges.special[part]), part.encode())
            else:
                found = list(map(entries.__getitem__, part))
                digests.add(b"".join([e[0] for e in found]), b" ".join([e[1] for e in found if e[1]]))
        waiting.clear()

    for digests, text in zip(out, texts):
        for part in parts_of(merges, text):
            waiting.append((digests, part))
            held += len(part)
            if held >= FLUSH_WORDS:
                flush()
                held = 0
    flush()
    return out


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every document's whole text, one row per row.

    Null text is empty text and has no tokens; so have texts of white space only. ``path`` is the tokenizer file; it is read on the
    driver and sent to the tasks (its size does not depend on the data). The decoded digest is of what ``decode`` gives for the ids.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(content.value)
        gc.disable()  # millions of small tuples and no cycles among them
        try:
            yield from encoded(merges, batches)
        finally:
            gc.enable()  # the worker goes on to other tasks

    def encoded(merges: Merges, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                done = encode_batch(merges, [text or "" for text in part.column("text").to_pylist()], with_ids)
                counts = [d.count for d in done]
                columns = [
                    part.column("doc_id"), pa.array(counts, pa.int64()), pa.array([d.ids_hash.hexdigest() for d in done], pa.string()),
                    pa.array([d.text_hash.hexdigest() for d in done], pa.string())]
                if with_ids:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join([b"".join(d.ids) for d in done]), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def decode(encoded: DataFrame, path: str, plain: bool = False) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are no tokens. See ``Decoder`` for ``plain``."""
    content = encoded.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(content.value)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                machine = Decoder(merges, plain)
                texts.append("".join([*(machine.feed(i) for i in ids.as_py() or []), machine.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(scan, "doc_id long, text string")
