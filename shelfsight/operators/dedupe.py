"""Near-duplicate titles inside a block, and order-greedy suppression of duplicates.

Two records of a block are duplicates when they share a url, or their title token sets overlap in
at least max(2, smaller size - 1) tokens. Pairs of records are never formed. Records are folded to
token sets, and sets are linked by shared keys:

* sets of one size m are similar exactly when they share an (m-1)-subset, so each set emits its m
  subsets as keys (the set itself for m = 2);
* for sets of different sizes the smaller misses at most one token, so two of its three rarest tokens
  are in the larger: each set emits a key for every two of its tokens, and those probes find the candidate
  set pairs, which are verified and become keys. A larger set beyond the size limit emits its tokens
  one by one and is found through one of the smaller's two rarest.

Everything a record must know about its neighbours is then a minimum per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfsight.functions import text as t
from shelfsight.session import cut_lineage

SUBSET_SIZE_LIMIT = 64  # longer titles are linked through probes of single tokens instead, at any size


def with_set_key(records: DataFrame, title: Column) -> DataFrame:
    """Adds fingerprint and set_key (sorted tokens; a single-token title only equals itself)."""
    fingerprint = t.title_fingerprint(title)
    tokens = F.array_sort(t.token_set(fingerprint))
    return records.withColumn("fingerprint", fingerprint).withColumn(
        "set_key", F.when(F.col("fingerprint") != "", F.array_join(tokens, " ")))


def known_sets(records: DataFrame, block: Sequence[str]) -> DataFrame:
    """(block, set_key, set_id): every token set of a block under a number of its own, so that links, rounds and shuffles carry longs. A null block has none."""
    sets = records.select(*block, "set_key").dropna().distinct()
    return cut_lineage(sets.withColumn("set_id", F.monotonically_increasing_id()))


def _pair_keys(marks: Column) -> Column:
    """A key for every two of the marks, whatever their order."""
    ordered = F.array_sort(marks)
    return F.flatten(F.transform(ordered, lambda x, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda y: F.xxhash64(x, y))))


def set_links(sets: DataFrame, block: Sequence[str]) -> DataFrame:
    """(set_id, link): different sets are similar exactly when they share a link; a link that one set alone would hold is left out."""
    tokens = F.split("set_key", " ")
    sized = sets.withColumn("tokens", tokens).withColumn("size", F.size("tokens"))
    small = F.col("size") <= SUBSET_SIZE_LIMIT
    subsets = F.transform("tokens", lambda x: F.xxhash64(*block, F.col("size"), F.array_join(F.array_remove("tokens", x), " ")))
    held = Window.partitionBy("link")
    same_size = sized.filter((F.col("size") >= 3) & small).select("set_id", F.explode(subsets).alias("link"))
    same_size = same_size.withColumn("_sets", F.count("*").over(held)).filter("_sets > 1").drop("_sets")

    marked = sized.filter("size >= 2").select("set_id", "size", F.transform("tokens", lambda x: F.xxhash64(*block, x)).alias("marks"))
    indexed = marked.select("set_id", "size", F.explode("marks").alias("mark"))
    spread = indexed.groupBy("mark").agg(F.count("*").alias("sets"))
    ranked = indexed.join(spread, "mark").groupBy("set_id", "size").agg(F.array_sort(F.collect_list(F.struct("sets", "mark"))).alias("rare"))
    rarest = F.transform(F.slice("rare", 1, 3), lambda r: r["mark"])
    probes = ranked.select(F.col("set_id").alias("small_id"), F.col("size").alias("small_size"),
                           F.explode(F.concat(F.slice(rarest, 1, 2), _pair_keys(rarest))).alias("key"))
    keys = marked.select("set_id", "size", F.explode(F.when(small, _pair_keys(F.col("marks"))).otherwise(F.col("marks"))).alias("key"))
    longer = (F.col("size") > F.col("small_size")) | (
        (F.col("size") == F.col("small_size")) & (F.col("size") > SUBSET_SIZE_LIMIT) & (F.col("set_id") > F.col("small_id")))
    pairs = keys.join(probes.hint("merge"), "key").filter(longer).select("small_id", "set_id").distinct()
    ends = sized.select("set_id", "tokens", "size")
    small_ends = ends.select(F.col("set_id").alias("small_id"), F.col("tokens").alias("small_tokens"), F.col("size").alias("small_size"))
    shared = F.size(F.array_intersect("small_tokens", "tokens"))
    similar = pairs.join(small_ends, "small_id").join(ends, "set_id").filter(t.overlap_is_similar(shared, F.col("small_size"), F.col("size")))
    edges = similar.select(F.xxhash64(F.lit(-1), "small_id", "set_id").alias("link"), F.explode(F.array("small_id", "set_id")).alias("set_id"))
    return same_size.unionByName(edges)


def _nearest(nodes: DataFrame, links: DataFrame, url: Sequence[str]) -> DataFrame:
    """Adds `nearest`, the first node (by `ord`) among a node's url group and similar sets, itself included.

    A null url or set equals no other: such a node has no url group, or nothing at all, but itself.
    """
    per_set = nodes.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("ord").alias("m"))
    per_link = links.join(per_set, "set_id").groupBy("link").agg(F.min("m").alias("m"))
    by_set = links.join(per_link, "link").select("set_id", "m").unionByName(per_set).groupBy("set_id").agg(F.min("m").alias("_set_min"))
    by_url = nodes.groupBy(*url).agg(F.min("ord").alias("_url_min"))
    return (
        nodes.join(by_set, "set_id", "left").join(by_url, list(url), "left")
        .withColumn("nearest", F.least("_set_min", "_url_min", "ord")).drop("_set_min", "_url_min")
    )


def first_duplicates(records: DataFrame, block: Sequence[str]) -> DataFrame:
    """Adds duplicate_of: the earliest record similar to this one, null when it is itself the earliest.

    records: block columns, url, set_key, and `ord`, a struct that starts with the order and ends with the id.
    """
    block = list(block)
    sets = known_sets(records, block)
    near = _nearest(records.join(sets, [*block, "set_key"], "left"), cut_lineage(set_links(sets, block)), [*block, "url"])
    duplicate = F.when(F.col("nearest") < F.col("ord"), F.col("nearest.id"))
    return near.select(*records.columns, duplicate.alias("duplicate_of"))


def suppress_duplicates(batch: DataFrame, stored: DataFrame, block: Sequence[str]) -> DataFrame:
    """Adds `kept`: a record is kept unless a stored or an earlier kept record of its block duplicates it.

    Earlier is by `ord`, then by the batch's own order. Similarity is not transitive, so the greedy order matters: in each round the records that are
    first among all their undecided neighbours are kept and their neighbours dropped. A round is a
    handful of grouped minima over the links of the sets that are still undecided; lineage is cut by a reliable checkpoint so that a lost executor
    never replays earlier rounds. Every round decides the first record of each group, so there are as many as the longest chain
    of records that wait for each other. Rounds know a record by its place in the order, its set and the first place of its url: three longs.
    """
    block = list(block)
    sets = known_sets(stored.select(*block, "set_key").unionByName(batch.select(*block, "set_key")), block)
    links = cut_lineage(set_links(sets, block))
    arrived = batch.withColumn("_arrival", F.monotonically_increasing_id()).orderBy("ord", "_arrival").drop("_arrival")
    rows = cut_lineage(arrived.withColumn("_row", F.monotonically_increasing_id()))  # no two are equal, in any block
    urls = cut_lineage(rows.select(*block, "url", "_row").dropna().groupBy(*block, "url").agg(F.min("_row").alias("url_id")))
    columns = ["set_id", "url_id", "ord"]

    def without_neighbours(kept_sets: DataFrame, kept_urls: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
        """Rows without a kept record in their url group, their set or a similar one; null urls and sets match nothing."""
        hit_links = links.join(kept_sets, "set_id", "left_semi").select("link")
        hit_sets = links.join(hit_links, "link", "left_semi").select("set_id").unionByName(kept_sets.select("set_id")).distinct()
        return rows.join(kept_urls, "url_id", "left_anti").join(hit_sets, "set_id", "left_anti").select(*columns)

    numbered = rows.join(sets, [*block, "set_key"], "left").join(urls, [*block, "url"], "left").withColumn("ord", F.col("_row")).select(*columns)
    stored_sets = sets.join(stored.select(*block, "set_key"), [*block, "set_key"], "left_semi")
    stored_urls = urls.join(stored.select(*block, "url"), [*block, "url"], "left_semi")
    undecided = cut_lineage(without_neighbours(stored_sets, stored_urls, numbered, links))
    kept = []
    while not undecided.isEmpty():
        links = cut_lineage(links.join(undecided.select("set_id"), "set_id", "left_semi"))
        first = cut_lineage(_nearest(undecided, links, ["url_id"]).filter("nearest = ord").select(*columns))
        kept.append(first.select("ord"))
        undecided = cut_lineage(without_neighbours(first.filter("set_id IS NOT NULL"), first.filter("url_id IS NOT NULL"), undecided, links).join(
            first.select("ord"), "ord", "left_anti").select(*columns))
    if not kept:
        return rows.drop("_row").withColumn("kept", F.lit(False))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    marked = every.select(F.col("ord").alias("_row"), F.lit(True).alias("_kept"))
    return rows.join(marked, "_row", "left").select(*batch.columns, F.coalesce("_kept", F.lit(False)).alias("kept"))
