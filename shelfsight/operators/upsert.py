"""Upsert over two unique keys, row by row in arrival order, as Spark jobs.

A review is found by its url, else by (source, release, title), and an update moves the stored row to the new url and title, so a later row of the batch can
meet it there. Rows that share no key, directly or over others, never see each other. Where one title key stands alone, the
outcome is a handful of grouped minima, however many rows it has. Rows whose title keys are tied by a url are replayed in arrival order, those of a release together, and
those of releases that share urls: one task holds such a group's keys and streams its rows. A coarser group gives the same result; that urls seldom
cross releases makes the search for groups short.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfsight.session import cut_lineage

TITLED = ("source_id", "release_id", "title")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b): root is the smallest node that can be reached.

    Every round ties each node to the smallest one in reach of its neighbours and follows the ties once, so that rounds grow with the logarithm of the
    longest chain. A round is checkpointed; a lost executor costs that round.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    mark = None
    while True:
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not row[0] or tuple(row) == mark:
            break
        mark = tuple(row)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        tied = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = tied.groupBy("a").agg(F.min("b").alias("low"))
        lower = tied.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        edges = cut_lineage(lower.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _node(own: Column) -> Column:
    """Title key, else url, else the row itself, as 128 bits: two hashes of different start. Hashes skip nulls, so a key says which ids it lacks."""
    def half(start: str) -> Column:
        titled = F.xxhash64(F.lit(start + "title"), *TITLED, F.col("source_id").isNull(), F.col("release_id").isNull())
        return F.when(F.col("title").isNotNull(), titled).when(F.col("source_url").isNotNull(), F.xxhash64(F.lit(start + "url"), "source_url")).otherwise(
            F.xxhash64(F.lit(start + "row"), "_stored", own))

    return F.struct(half("").alias("a"), half("+").alias("b"))


class _Component:
    """Stored and inserted rows of one component with the keys they have now."""

    def __init__(self) -> None:
        self.names: list[tuple] = []  # (stored id, key of the row that inserted it)
        self.keys: list[tuple] = []  # (url, title key) as of now
        self.by_url: dict[str, int] = {}
        self.by_title: dict[str, list[int]] = {}

    def _first_titled(self, title: str) -> int | None:
        rows = self.by_title.get(title, [])
        while rows and self.keys[rows[0]][1] != title:
            heappop(rows)  # it has another title by now
        return rows[0] if rows else None

    def add(self, name: tuple, url: str | None, title: str | None) -> int:
        self.names.append(name)
        self.keys.append((None, None))
        self.move(len(self.names) - 1, url, title)
        return len(self.names) - 1

    def move(self, row: int, url: str | None, title: str | None) -> None:
        old_url, old_title = self.keys[row]
        if old_url is not None and self.by_url.get(old_url) == row:
            del self.by_url[old_url]
        self.keys[row] = (url, title)
        if url is not None:
            self.by_url.setdefault(url, row)
        if title is not None and title != old_title:
            heappush(self.by_title.setdefault(title, []), row)

    def take(self, key, url: str | None, title: str | None) -> tuple:
        row = self.by_url.get(url) if url is not None else None
        if row is None and title is not None:
            row = self._first_titled(title)
        if row is None:
            row = self.add((None, key), url, title)
        else:
            self.move(row, url, title)
        return self.names[row]


def _values(column: pa.Array) -> list:
    """Python values, null as None; the common types without a scalar object each."""
    if pa.types.is_integer(column.type) or pa.types.is_string(column.type):
        return column.to_pandas(integer_object_nulls=True).tolist()
    return column.to_pylist()


def _replay(rows: DataFrame, key: str) -> DataFrame:
    """(key, target_id, same_as) of the incoming rows of every component; rows: root, _stored, _review, key, source_url, the title key."""
    read = ("root", "_stored", key, "_review", "source_url", *TITLED)
    types = dict(rows.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, component = object(), _Component()
        for batch in batches:
            turns, found = [], []
            for at, stored, turn, name, url, source, release, title in zip(*(_values(batch.column(c)) for c in read)):
                if at != root:
                    root, component = at, _Component()
                title_key = None if title is None else (source, release, title)
                if stored:
                    component.add((name, None), url, title_key)
                else:
                    turns.append(turn)
                    found.append(component.take(turn, url, title_key))
            key_type, id_type = batch.column(key).type, batch.column("_review").type
            yield pa.RecordBatch.from_pydict({key: pa.array(turns, key_type), "target_id": pa.array([name for name, _ in found], id_type), "same_as": pa.array([made for _, made in found], key_type)})

    spark = rows.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # a few a core: one more than cores would take twice as long
    ordered = rows.select(*read).repartition(tasks, "root").sortWithinPartitions("root", F.col("_stored").desc(), "_review", key)
    return ordered.mapInArrow(scan, f"{key} {types[key]}, target_id {types['_review']}, same_as {types[key]}")


def review_upsert_ids(incoming: DataFrame, stored: DataFrame, key: str = "incoming_id") -> DataFrame:
    """Target per incoming review, taken one by one in the order of ``key`` (unique): by url, else the first by (source, release, title).

    A review that finds none is the insert; one that finds a stored review updates it (``target_id``), one that finds an inserted row updates that
    (``same_as`` names the insert; so it does for the insert itself). An update gives the row its url and title, and what it had before no longer finds
    it. A null url or title finds nothing. First means the smallest review_id, then the earliest insert.

    Both inputs are worked out once, into one checkpointed frame; all else reads that, and finds ties by numbers.
    """
    known = stored.select(F.col("review_id").alias("_review"), "source_url", *TITLED, F.lit(True).alias("_stored"))
    rows = incoming.withColumn("_stored", F.lit(False)).unionByName(known, allowMissingColumns=True)
    own = F.coalesce(F.col(key).cast("string"), F.col("_review").cast("string"))
    rows = cut_lineage(rows.withColumn("_node", _node(own)).select("*", F.col("_node.a").alias("_a"), F.col("_node.b").alias("_b"), F.xxhash64("source_url").alias("_url")).drop("_node"))
    node, url = ["_a", "_b"], ["_url", "source_url"]  # urls begin alike: their number goes first where they are sorted

    group = F.when(F.col("title").isNotNull(), F.xxhash64(F.lit("release"), "release_id")).otherwise(F.col("_a"))
    pairs = rows.filter("source_url IS NOT NULL").select("_url", *node, group.alias("group"))
    span = pairs.groupBy("_url").agg(F.min("_a").alias("low"), F.max("_a").alias("top"), F.min("group").alias("first")).filter("low < top").select("_url", "first")
    tied = cut_lineage(pairs.join(span, "_url").select(*node, "group", "first").distinct())
    joined = connected(tied.select(F.col("first").alias("a"), F.col("group").alias("b"))).withColumnRenamed("node", "group")
    roots = tied.groupBy(*node).agg(F.min("group").alias("group"))  # a node has one
    if not joined.isEmpty():  # urls seldom cross releases: the tied rows then need no look-up of their group
        roots = roots.join(joined, "group", "left").withColumn("group", F.coalesce("root", "group"))
    roots = roots.select(*node, F.col("group").alias("root"))

    by_url = rows.filter("_stored AND source_url IS NOT NULL").groupBy(*url).agg(F.min("_review").alias("_by_url"))
    by_node = rows.groupBy(*node).agg(F.min(key).alias("_first"), F.min("_review").alias("_known"))
    new = rows.filter("NOT _stored").drop("_review")
    alone = new.join(roots, node, "left_anti").join(by_node, node).join(by_url, url, "left").withColumn("target_id", F.coalesce("_by_url", "_known"))
    alone = alone.withColumn("same_as", F.when(F.col("target_id").isNull(), F.col("_first")))

    replayed = _replay(rows.join(roots, node), key)
    columns = [*incoming.columns, "target_id", "same_as"]
    decided = alone.select(*columns).unionByName(new.join(replayed, key).select(*columns))
    return decided.withColumn("action", F.when(F.col("same_as") == F.col(key), "insert").otherwise("update"))
