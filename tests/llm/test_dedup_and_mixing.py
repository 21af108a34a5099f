"""Exact and near dedup, vectors, mixing and URL filter against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfsight.llm import exact_dedup, mixing, simhash, urls, vectors
from shelfsight.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, rows long, anchor long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7, 8) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    random.seed(5)
    words = ["of", "the", "an", "river", "stone", "light", "über", "Été", "x" * 300]
    rows = [(k, " ".join(random.choices(words, k=random.choice([0, 1, 2, 5, 40]))), random.choice(["a", "b", "ü", None])) for k in range(160)]
    rows += [(200 + k, rows[k][1].replace(" ", "\n\t"), "a") for k in range(40)]
    base = " ".join(f"w{k}" for k in range(300))
    rows += [(300 + k, base.replace(f"w{7 * k} ", f"v{k} "), "hot") for k in range(40)]
    return rows + [(500, None, "a"), (501, "", None), (502, " \t\n", "b"), (503, "word " * 60_000, "b"), rows[3], (None, rows[4][1], "a")]


def content(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.lpad((F.length(c) % 7).cast("string"), 4, "0")])
def test_exact_dedup(spark, corpus, digest):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in
                 exact_dedup.deduplicate(docs(spark, corpus), digest=digest, files_per_batch=1).collect())
    groups = {}
    for i, t, _ in corpus:
        groups.setdefault(content(t), []).append((-len(t or ""), i is not None, i or 0, i))
    want = sorted((i is not None, i or 0, min(g := groups[content(t)], key=lambda x: x[:3])[3], len(g), min(g, key=lambda x: x[:3])[3] == i) for i, t, _ in corpus)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_exact_dedup_stage_and_digest(spark, corpus):
    table = docs(spark, corpus)
    kept = exact_dedup.drop_copies(table)
    assert kept.columns == table.columns
    assert {content(r["text"]) for r in kept.collect()} == {content(t) for _, t, _ in corpus}
    row = exact_dedup.deduplicate(docs(spark, [(1, "a b", "s")])).first()
    assert row["digest"] == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup.deduplicate(docs(spark, [])).collect() == []
    assert exact_dedup.drop_copies(docs(spark, [])).collect() == []


def print_of(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, threshold):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= threshold:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in prints}


@pytest.mark.parametrize("dense", [256, 1])
def test_simhash(spark, corpus, dense):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, corpus), dense=dense).collect()}
    prints = {(i, t): print_of(t) for i, t, _ in corpus}
    roots = linked(set(prints.values()), 2)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    assert got == {(i, f"{p:016x}", least[roots[p]]) for (i, _), p in prints.items()}
    assert len({c for _, _, c in got}) < len(got)


def test_simhash_meets_every_pair_and_empty(spark):
    random.seed(2)
    for _ in range(300):
        x = random.getrandbits(63)
        y = x ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63))
        a, b = simhash.anchors(np.array([x, y], dtype=np.int64))
        assert set(a.tolist()) & set(b.tolist())
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    assert simhash.keep_one_of_each(docs(spark, [(1, "a b c d", "s"), (2, "A b c d", "s"), (3, "z y x w", "s")])).count() == 2


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 100)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, 101, 102, 200], 100)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def filled(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total, over = sum(weight[s] for s in free), set()
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in free:
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                over.add(s)
        free -= over
    return target


def test_mixing(spark, corpus):
    rows = mixing.mix(docs(spark, corpus)).collect()
    sizes, longest = {}, {}
    for _, t, s in corpus:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s], longest[s] = sizes.get(s, 0) + n, max(longest.get(s, 0), n)
    target = filled(sizes)
    source = {i: s for i, _, s in corpus if i is not None}
    taken = {}
    for r in rows:
        s = source.get(r["doc_id"], "a")
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(rows) == len(corpus)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s]
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs(spark, corpus).repartition(7)).collect()))
    mixed = mixing.mixed_documents(docs(spark, corpus))
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, None)])).collect()] == [0]


def test_targets_with_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "e": 300, None: 60}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(filled(sizes))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base[:60] + 0.08 * rng.normal(size=(60, 16))
    hot = np.repeat(base[:1], 150, axis=0)
    v = np.concatenate([base, near, hot, 1e200 * base[5:6], 1e-200 * base[6:7]])
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, [1.0, 2.0], 0), (1005, [2.0, 4.0], 0), (1006, [], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in vectors.near_duplicates(table, tile_rows=64).collect()}
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    reach = close.copy()
    for _ in range(10):
        reach = reach @ reach
    for k in range(len(v)):
        first = int(np.argmax(reach[k]))
        assert got[k] == (int(close[k].sum()) - 1, first, first == k)
    assert got[1004] == (1, 1004, True) and got[1005] == (1, 1004, False)
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003, 1006))
    assert vectors.near_duplicates(table.where("vec_id < 0")).collect() == []


def test_urls(spark):
    pages = [(k, f"http://Bad.Example.com/spam/{k}.html?x", "h") for k in range(60)] + [(100 + k, f"http://bad.example.com/news/{k}#t", "h") for k in range(60)]
    pages += [(300, None, ""), (301, "no scheme", ""), (302, "http://a.net", ""), (303, "https://x.example.net/en/5", ""), (304, "http://net/x", ""), (305, "ftp://org/fr/", ""),
              (306, "http://myorg/fr/1", ""), (307, "http://EXAMPLE.com/de/http://b.net/", ""), (None, "http://q.org/" + "a/" * 400, "")]
    labels = [(k, 0, 0) for k in range(60)] + [(100 + k, 1, 0) for k in range(60)] + [(None, 0, 1), (5, None, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, template string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urls.judge(table, marks).collect()}
    assert len(got) == len(pages)
    assert {got[k]["verdict"] for k in range(60)} == {"block"} and {got[100 + k]["verdict"] for k in range(60)} == {"allow"}
    assert got[0]["host"] == "bad.example.com" and got[0]["path"] == "/spam/0.html" and got[100]["path"] == "/news/0"
    assert {k: (got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(300, 308)} == {
        300: ("", "", None), 301: ("", "", None), 302: ("a.net", "", None), 303: ("x.example.net", "/en/5", "example.net/en/"), 304: ("net", "/x", "net/"),
        305: ("org", "/fr/", "org/fr/"), 306: ("myorg", "/fr/1", None), 307: ("example.com", "/de/http://b.net/", "example.com/de/")}
    assert urls.judge(table.where("page_id < 0"), marks).collect() == []
    assert {r["verdict"] for r in urls.judge(table.where("page_id < 300"), marks.where("doc_id < 0")).collect()} == {"allow"}


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.lit("same")])
def test_stages_keep_one_row_of_each_group(spark, digest):
    one, two, three = ("a b c d e f", "p q r s t u", "k l m n o z")
    rows = [(1, one, "s"), (1, one, "s"), (1, one, "s"), (None, two, "s"), (None, two, "s"), (5, three, "s"), (5, one, "s"), (7, None, "s"), (7, None, "s"), (None, "", "s")]
    want = [(1, one), (None, two), (5, three)]
    key = lambda table: sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=repr)
    got = key(exact_dedup.drop_copies(docs(spark, rows), digest=digest))
    assert len(got) == 4 and {content(t) for _, t in got} == {content(t) for _, t in want} | {""}
    assert all(pair in got for pair in want if pair[1] != one) and (1, one) in got
    assert key(simhash.keep_one_of_each(docs(spark, rows))) == sorted([*want, (7, None)], key=repr)
    spaced = [(3, "x y", "s"), (3, "x   y", "s"), (3, "x   y", "s")]
    assert key(exact_dedup.drop_copies(docs(spark, spaced), digest=digest)) == [(3, "x   y")]


def test_urls_of_a_host_with_many_sections(spark):
    name = lambda n: chr(97 + n // 26) + chr(97 + n % 26)
    pages = [(s * 100 + k, f"http://wide.example/sec{name(s)}/{k}") for s in range(100) for k in range(40)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i // 100 != 7), 0) for i, _ in pages], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(table, marks).collect()}
    assert got == {i: "block" if i // 100 == 7 else "allow" for i, _ in pages}


ODD_NAMES = "doc_id long, text string, source string, `a.b` string, row_number string, whole string, hash string, fp string, digest string, __row string"


def test_stages_take_any_column_names(spark):
    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "p q r s t u v", "t"), (None, None, None), (4, "p q r s t u v w", "t")]
    table = spark.createDataFrame([(*r, *"1234567") for r in rows], ODD_NAMES)
    for stage in (exact_dedup.drop_copies, simhash.keep_one_of_each, mixing.mixed_documents):
        out = stage(table)
        assert out.columns == table.columns and all(r[3:] == tuple("1234567") for r in map(tuple, out.collect()))
    assert {r["doc_id"] for r in exact_dedup.drop_copies(table).collect()} == {1, 3, 4, None}


def test_near_duplicates_are_verified(spark):
    """Rows go only if five-word shingles agree by 0.8; one far from the row that stays is kept though links lead there."""
    random.seed(9)
    words = [f"w{k}" for k in range(3000)]
    base = random.choices(words, k=400)
    one = base[:200] + ["changed"] + base[201:]
    far = random.choices(words, k=400)
    rows = [(1, " ".join(base), "s"), (2, " ".join(one), "s"), (3, " ".join(base).upper(), "s"), (4, " ".join(far), "s")]
    table = simhash.numbered(docs(spark, rows))
    at = {r["whole"]["doc_id"]: r["row_number"] for r in table.collect()}
    near = spark.createDataFrame([(at[k], at[1], k, k, 1, 1) for k in (2, 3, 4)], "row_number long, kept long, a1 long, a2 long, k1 long, k2 long")
    assert {r["row_number"] for r in simhash.verified(table, near, 5, 0.8).collect()} == {at[2], at[3]}
    assert simhash.verified(table, near, 5, 0.999).collect()[0]["row_number"] == at[3]
    sets = {r["row_number"]: set(r["shingles"]) for r in simhash.shingle_sets(simhash.numbered_texts(table), 5).collect()}
    assert sets[at[1]] == sets[at[3]] and len(sets[at[1]]) == 396 and len(sets[at[1]] & sets[at[2]]) == 391


def test_hot_fingerprints_give_the_same_rows(spark, monkeypatch):
    from shelfsight.llm import common

    rows = [(k, "same text of some words" if k % 2 else f"text {k // 6} of other words", "s") for k in range(60)]
    want = sorted(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect()))
    for share in (1, 3, 10**6):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        assert sorted(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect())) == want


def plain_templates(shapes, z=2.58, least=5):
    """{(host, shape): template} of {(host, shape): (known, bad)}, by recursion over the tree."""
    out = {}

    def information(bad, known, share):
        return sum(n * (math.log(n / known) - math.log(p)) for n, p in ((bad, share), (known - bad, 1 - share)) if n) if known else 0.0

    def grow(host, members, level, template):
        ended = [s for s in members if len(s) <= level]
        for s in ended:
            out[host, s] = template
        members = [s for s in members if len(s) > level]
        segments = {s[level] for s in members}
        total_known, total_bad = (sum(shapes[host, s][k] for s in members) for k in (0, 1))
        groups = {}
        for segment in segments:
            known, bad = (sum(shapes[host, s][k] for s in members if s[level] == segment) for k in (0, 1))
            differs = 0 < total_bad < total_known and least <= known < total_known and (
                information(bad, known, total_bad / total_known) + information(total_bad - bad, total_known - known, total_bad / total_known) > z * z / 2 + math.log(len(segments)))
            groups.setdefault(segment if differs or len(segments) == 1 else "*", []).extend(s for s in members if s[level] == segment)
        for name, part in groups.items():
            grow(host, part, level + 1, f"{template}/{name}")

    for host in {h for h, _ in shapes}:
        grow(host, [s for h, s in shapes if h == host], 0, "")
    return out


def test_templates_by_recursion(spark):
    random.seed(7)
    shapes = {}
    for host in ("a", "b"):
        for _ in range(150):
            depth = random.choice([1, 2, 2, 3, 3, 4, 12])
            shape = tuple([random.choice("pqr"), random.choice("uvwxyz"), *random.choices("klm", k=12)][:depth])
            known = random.choice([0, 1, 3, 40])
            rate = 0.9 if shape[0] == "p" else 0.5 if len(shape) > 1 and shape[1] == "u" else 0.05
            shapes[host, shape] = (known, sum(random.random() < rate for _ in range(known)))
    table = spark.createDataFrame([(h, list(s), n, n, b) for (h, s), (n, b) in shapes.items()], "host string, shape array<string>, pages long, known long, bad long")
    got = {(r["host"], tuple(r["shape"])): r["template"] for r in urls.templates(table).collect()}
    assert got == plain_templates(shapes)
    assert len({t for (h, _), t in got.items() if h == "a"}) > 3 and any(len(t.split("/")) > 8 for t in got.values())


def test_single_labelled_pages_make_no_templates(spark):
    """A section with 90 good and 10 bad slugs is one template, not a repetition of its labels."""
    pages = [(k, f"http://h.example/bad/{'abcdefghij'[k % 10]}") for k in range(300)] + [(1000 + k, f"http://h.example/good/s{chr(97 + k // 26)}{chr(97 + k % 26)}") for k in range(100)]
    marks = [(k, 0, 1) for k in range(300)] + [(1000 + k, int(k % 10 > 0), 0) for k in range(100)]
    rows = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    good = {(r["template"], round(r["purity"], 2)) for r in rows if r["page_id"] >= 1000}
    assert len(good) == 1 and next(iter(good))[0] == "/good/*" and 0.8 < next(iter(good))[1] < 0.92
    assert {r["verdict"] for r in rows if r["page_id"] < 1000} == {"block"} and {r["verdict"] for r in rows if r["page_id"] >= 1000} == {"allow"}
