"""Secret scans by a trigram inverted index.

Each rule is a regular expression. ``trigram_query`` derives from it which trigrams a text must hold to match at all, as nested alls and anys. An index
shard covers the texts of one batch: for every trigram that some rule asks for, the ordered list of the texts that hold it. A rule's query
intersects and unites these lists, and only the texts that remain are searched with the expression itself. A rule from which no trigram
follows is searched for in every text. Shards live where their texts are read, so no text is shuffled or written and a lost task is simply run again.

Trigrams are bytes with A-Z in lower case; a character beyond ASCII or a case-insensitive one only widens the set of texts to verify.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character classes up to this size are spelled out, and so many strings are followed side by side.
WIDE, MANY = 8, 64
#: Bytes that are indexed at a time.
BLOCK = 1 << 22
SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (ASCII rules for case and classes) whose ``group`` has at least ``least`` characters; others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # runs are found whole, so this is every run of that length
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
)


@dataclass(frozen=True)
class All:
    """Every one of ``parts``; without any, nothing is asked."""

    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


Query = bytes | All | Any
ANYTHING = All(())


def every(parts: list[Query]) -> Query:
    flat = [p for part in parts for p in (part.parts if isinstance(part, All) else (part,))]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else All(tuple(flat))


def either(parts: list[Query]) -> Query:
    """One of the parts; a part that asks for nothing or for no more than another makes that other needless."""
    asked = [set(p.parts) if isinstance(p, All) else {p} for p in dict.fromkeys(parts)]
    kept = [every(list(dict.fromkeys(p.parts if isinstance(p, All) else (p,)))) for p, own in zip(dict.fromkeys(parts), asked) if not any(o < own for o in asked)]
    if not kept or ANYTHING in kept:
        return ANYTHING
    return kept[0] if len(kept) == 1 else Any(tuple(kept))


def of_strings(strings: set[bytes]) -> Query:
    """What a text must hold that holds one of the strings."""
    return either([every([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def spelled(items: list) -> set[bytes] | None:
    """The characters of a class in lower case, if it is a short list of ASCII ones."""
    found: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes = range(value, value + 1)
        elif kind is op.RANGE:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        if codes.stop > 128 or len(codes) > 2 * WIDE:
            return None
        found |= {bytes([c]).lower() for c in codes}
    return found if len(found) <= WIDE else None


def analyse(tree) -> tuple[set[bytes] | None, Query]:
    """(all strings that the expression can match, where they are few; what a text must hold besides)."""
    run: set[bytes] = {b""}
    needs: list[Query] = []
    whole = True

    def close() -> None:
        nonlocal run, whole
        needs.append(of_strings(run))
        run, whole = {b""}, False

    for kind, value in tree:
        strings, need = None, ANYTHING
        if kind is op.LITERAL:
            strings = spelled([(kind, value)])
        elif kind is op.IN:
            strings = spelled(value)
        elif kind is op.SUBPATTERN:
            strings, need = analyse(value[-1])
        elif kind is op.BRANCH:
            parts = [analyse(part) for part in value[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            need = either([n if s is None else of_strings(s) for s, n in parts])
            strings = strings if strings is not None and len(strings) <= MANY else None
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, part = value
            inner, inner_need = analyse(part)
            if least == 0 and most == 1 and inner is not None:
                strings = inner | {b""}
            elif least > 0:
                need = inner_need if inner is None else of_strings(inner)
                if inner is not None and least == most and len(inner) ** least <= MANY:
                    strings = {b""}
                    for _ in range(least):
                        strings = {a + b for a in strings for b in inner}
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            strings = {b""}
        if strings is None:
            close()
            needs.append(need)
        else:
            if len(run) * len(strings) > MANY:
                close()
            run = {a + b for a in run for b in strings}
    if whole:
        return run, ANYTHING
    needs.append(of_strings(run))
    return None, every(needs)


def trigram_query(pattern: str) -> Query:
    """What a text must hold to match; ``ANYTHING`` where no trigram follows."""
    strings, need = analyse(parser.parse(pattern, re.ASCII))
    return need if strings is None else of_strings(strings)


def trigrams_of(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query.parts))


class Shard:
    """Inverted index of a batch of texts over the trigrams that are asked for."""

    fold = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)

    def __init__(self, wanted: list[bytes], data: np.ndarray, ends: np.ndarray):
        """``data`` are the texts' bytes one after another, ``ends`` where each text begins, and the end."""
        codes = np.array([t[0] << 16 | t[1] << 8 | t[2] for t in wanted], dtype=np.int64)
        number = np.zeros(1 << 24, dtype=np.uint16)
        number[codes] = np.arange(1, len(wanted) + 1)
        held = [np.zeros(0, dtype=np.int64)]
        for start in range(int(ends[0]), int(ends[-1]) - 2, BLOCK):
            part = self.fold[data[start:min(start + BLOCK + 2, int(ends[-1]))]].astype(np.int32)
            found = number[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(found)
            text = np.searchsorted(ends, at + start, side="right") - 1
            inside = at + start + 3 <= ends[text + 1]
            held.append(np.unique((found[at[inside]].astype(np.int64) - 1) << 32 | text[inside]))
        pairs = np.unique(np.concatenate(held))
        bounds = np.searchsorted(pairs >> 32, np.arange(len(wanted) + 1))
        self.postings = {t: pairs[bounds[k]:bounds[k + 1]] & 0xFFFFFFFF for k, t in enumerate(wanted)}
        self.every = np.arange(len(ends) - 1)

    def texts(self, query: Query) -> np.ndarray:
        """The texts that the query leaves, in order; rarest lists are intersected first."""
        if isinstance(query, bytes):
            return self.postings[query]
        lists = sorted(map(self.texts, query.parts), key=len)
        if isinstance(query, Any):
            return np.unique(np.concatenate(lists))
        left = lists[0] if lists else self.every
        for other in lists[1:]:
            left = np.intersect1d(left, other, assume_unique=True)
        return left


class Scanner:
    """Rules with their expressions and queries."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.expressions = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = sorted(set().union(*map(trigrams_of, self.queries)))

    def candidates(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        """For each rule the texts to verify."""
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        shard = Shard(self.wanted, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), ends)
        return [shard.texts(q) for q in self.queries]

    def spans(self, texts: pa.LargeStringArray) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of every text, in order; code points, end exclusive."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for k, (rule, expression, places) in enumerate(zip(self.rules, self.expressions, self.candidates(texts))):
            for at in places.tolist():
                for m in expression.finditer(texts[at].as_py()):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[at].append((m.start(), k, m.end()))
        return [sorted(found) for found in out]


def find(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, spans): what each rule finds in every whole text, one row per row; spans are ordered by start, then in the order of the rules.

    Matches of one rule are leftmost and do not overlap; a match that is too short is dropped, and the search goes on behind it. Null text is
    empty text and has no spans. Repeated rows and null doc_id are searched each. Other columns are not read.
    """
    kinds = [r.kind for r in rules]
    if len(set(kinds)) < len(kinds):
        raise ValueError("every rule needs a kind of its own")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            found = scanner.spans(texts)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64))), pa.int32())
            flat = [s for f in found for s in f]
            spans = pa.StructArray.from_arrays(
                [pa.array([kinds[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())],
                names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, spans)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(doc_id, n_<kind> of each base rule, base_sha256, spans) of what ``find`` gives."""
    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    base_spans = of([r.kind for r in base])
    counts = [F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select("doc_id", *counts, F.sha2(joined(base_spans).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
