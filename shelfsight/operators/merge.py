"""Sinks and merges: every conflict rule is a DataFrame operator returning the new table state.

All rules are key equi-joins, so they work on any storage; a table format with MERGE can
run the same rule as one statement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfsight.functions import text as t


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; ranking is limited inside each partition before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def resolve_keys(batch: DataFrame, known: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) rows of a batch by natural key."""
    keys = list(keys)
    return batch.join(known, keys), batch.join(known, keys, "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows to append: first of each new key; stored keys win."""
    return keep_first(batch, keys, order).join(target.select(*keys), list(keys), "left_anti")


def keep_last(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last row per key by ``order``, the arrival order; combines map-side."""
    others = [c for c in batch.columns if c not in keys]
    if not others:
        return batch.distinct()
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return last.select(*keys, "_last.*")


def insert_select_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Target plus the batch rows whose key it lacks; of a repeated key the first row by ``order``. Batch columns that the target lacks are dropped."""
    batch = keep_first(batch, keys, order).select(*[c for c in batch.columns if c in target.columns])
    return target.unionByName(batch.join(target.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def _paired(target: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    left = target.select(*keys, F.struct(*columns).alias("_t"))
    right = batch.select(*keys, F.struct(*[c for c in batch.columns if c not in keys]).alias("_s"))
    return left.join(right, list(keys), "full_outer")


def overwrite_upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column], forced: dict[str, Column] | None = None) -> DataFrame:
    """Incoming row replaces the stored one column by column, of a repeated key the last by `order`; `forced` columns are set on every touched row."""
    batch = keep_last(batch, keys, order)
    columns = [c for c in target.columns if c not in keys]
    incoming = set(batch.columns)
    hit = F.col("_s").isNotNull()
    out = []
    for c in columns:
        new = (forced or {}).get(c, F.col(f"_s.{c}") if c in incoming else F.col(f"_t.{c}"))
        out.append(F.when(hit, new).otherwise(F.col(f"_t.{c}")).alias(c))
    return _paired(target, batch, keys, columns).select(*keys, *out)


def fill_null_upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[Column],
                     defaults: dict[str, Column] | None = None) -> DataFrame:
    """Stored values stay, gaps take the first known incoming value by `order`; a batch row empty (null or 0) in every column is skipped."""
    useful = t.any_of([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0 for c in columns])
    others = [c for c in target.columns if c not in keys]
    batch = batch.filter(useful)
    for name, value in (defaults or {}).items():
        batch = batch.withColumn(name, value)
    turn = F.struct(*order)
    batch = batch.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), turn)).alias(c) for c in batch.columns if c not in keys])
    fills = {c: F.coalesce(F.col(f"_t.{c}"), F.col(f"_s.{c}")) if c in batch.columns else F.col(f"_t.{c}") for c in others}
    return _paired(target, batch, keys, others).select(*keys, *[v.alias(c) for c, v in fills.items()])


def patch_upsert(target: DataFrame, patch: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[Column],
                 insert_defaults: dict[str, Column] | None = None) -> DataFrame:
    """Patch holds <column> and has_<column>: supplied overwrites (blank to null), the last one of a repeated key by `order`; missing keeps."""
    turn = F.struct(*order)
    patch = patch.groupBy(*keys).agg(*[out for c in columns for out in (
        F.max_by(c, F.when(F.col(f"has_{c}"), turn)).alias(c), F.coalesce(F.bool_or(f"has_{c}"), F.lit(False)).alias(f"has_{c}"))])
    others = [c for c in target.columns if c not in keys]
    out = []
    for c in others:
        stored = F.col(f"_t.{c}")
        if c in columns:
            stored = F.when(F.coalesce(F.col(f"_s.has_{c}"), F.lit(False)), t.blank_to_null(F.col(f"_s.{c}")).cast(target.schema[c].dataType)).otherwise(stored)
        elif insert_defaults and c in insert_defaults:
            stored = F.when(F.col("_t").isNull(), insert_defaults[c]).otherwise(stored)
        out.append(stored.alias(c))
    return _paired(target, patch, keys, others).select(*keys, *out)


def promote_variants(existing: DataFrame, incoming: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Variant upsert where a mens or unisex row (mens if both come) takes over the release's old `default` row; the last row of a repeated key by `order` counts.

    Result column `action` tells what happened: kept, updated, renamed, inserted.
    """
    columns = [c for c in existing.columns if c not in ("release_id", "variant_key")]
    incoming = keep_last(incoming, ["release_id", "variant_key"], order)
    promotes = F.col("variant_key").isin("mens", "unisex")
    takers = incoming.filter(promotes).groupBy("release_id").agg(F.min("variant_key").alias("_taker"))
    has_own = existing.select("release_id", "variant_key", F.lit(True).alias("_own"))
    has_default = existing.filter("variant_key = 'default'").select("release_id", F.lit(True).alias("_default"))
    new = (
        incoming.join(has_own, ["release_id", "variant_key"], "left").join(has_default, "release_id", "left").join(takers, "release_id", "left")
        .withColumn("action", F.when(F.col("_own"), "updated").when(F.col("_default") & (F.col("variant_key") == F.col("_taker")), "renamed").otherwise("inserted"))
        .select("release_id", "variant_key", *columns, "action")
    )
    kept = (
        existing.join(incoming.select("release_id", "variant_key"), ["release_id", "variant_key"], "left_anti")
        .join(takers, "release_id", "left")
        .filter((F.col("variant_key") != "default") | F.col("_taker").isNull())
        .select("release_id", "variant_key", *columns, F.lit("kept").alias("action"))
    )
    return kept.unionByName(new)


def single_primary(variants: DataFrame, requested: Column) -> DataFrame:
    """Exactly one primary per release: the requested one, else the present one, else the first key."""
    order = F.struct((~F.coalesce(requested, F.lit(False))).alias("a"), (~F.col("is_primary")).alias("b"), "variant_key")
    chosen = variants.groupBy("release_id").agg(F.min_by("variant_key", order).alias("_chosen"))
    return variants.join(chosen, "release_id").withColumn("is_primary", F.col("variant_key") == F.col("_chosen")).drop("_chosen")


def delete_variants(variants: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining with one primary, refused): a release never loses its last variant."""
    marked = variants.join(doomed.select("release_id", "variant_key", F.lit(True).alias("_doomed")), ["release_id", "variant_key"], "left")
    safe = marked.groupBy("release_id").agg((F.count("*") > F.count("_doomed")).alias("_safe"))
    judged = marked.join(safe, "release_id")
    remaining = judged.filter(F.col("_doomed").isNull() | ~F.col("_safe")).drop("_doomed", "_safe")
    refused = judged.filter(F.col("_doomed") & ~F.col("_safe")).select("release_id", "variant_key")
    return single_primary(remaining, F.lit(False)), refused


def shadow_specs(specs: DataFrame, variants: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-to-one specs follow the primary variant."""
    primary = variants.filter("is_primary").select("release_id", *columns)
    return overwrite_upsert(specs, primary, ["release_id"], [F.lit(0)])  # one primary each


def get_or_create_authors(records: DataFrame, authors: DataFrame, keys: Sequence[str] = ("source_id", "display_name")) -> tuple[DataFrame, DataFrame]:
    """(records with author_id, new author rows); ids of new authors are hashes of their key."""
    keys = list(keys)
    wanted = records.select(*keys).filter(F.coalesce(F.col("display_name"), F.lit("")) != "").distinct()
    known = authors.groupBy(*keys).agg(F.min("author_id").alias("author_id"))
    created = wanted.join(known, keys, "left_anti").withColumn(
        "author_id", F.concat(F.lit("a-"), F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 16)))
    everyone = known.unionByName(created)
    return records.join(everyone, keys, "left"), created


def latest_run_state(ledger: DataFrame) -> DataFrame:
    """Current state of every run from an append-only ledger of (run_id, seq, state columns)."""
    fields = [c for c in ledger.columns if c not in ("run_id", "seq")]
    latest = ledger.groupBy("run_id").agg(F.max_by(F.struct(*fields), F.col("seq")).alias("_s"))
    return latest.select("run_id", "_s.*")


def guarded_delete(doomed: DataFrame, children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(deletable, refused): parents with children stay."""
    used = children.select(key)
    return doomed.join(used, key, "left_anti"), doomed.join(used, key, "left_semi")


def cascade_delete(doomed: dict[str, DataFrame], tables: dict[str, tuple[DataFrame, Sequence[str]]],
                   references: Sequence[tuple[str, str, str, str]]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(surviving, gone) rows of every table when the ``doomed`` rows of some are deleted.

    tables: name to (rows, own key columns). references: (child table, child column, parent table, parent column) of every foreign key that
    cascades; several may lead to one table, and a null child column refers to nothing. A table is worked out after all its parents, so
    each is filtered once. References must not form a cycle.
    """
    gone: dict[str, DataFrame] = {}
    left = list(tables)
    while left:
        ready = [name for name in left if all(parent in gone for child, _, parent, _ in references if child == name)]
        if not ready:
            raise ValueError(f"references form a cycle: {sorted(left)}")
        for name in ready:
            rows, keys = tables[name]
            hits = [doomed[name].select(*keys)] if name in doomed else []
            for child, column, parent, parent_column in references:
                if child == name:
                    hits.append(rows.join(gone[parent].select(F.col(parent_column).alias(column)).distinct(), column, "left_semi").select(*keys))
            every = hits[0] if hits else rows.limit(0).select(*keys)
            for more in hits[1:]:
                every = every.unionByName(more)
            gone[name] = rows.join(every.distinct(), list(keys), "left_semi")
            left.remove(name)
    return {name: (rows.join(gone[name].select(*keys), list(keys), "left_anti"), gone[name]) for name, (rows, keys) in tables.items()}


def set_status(rows: DataFrame, ids: DataFrame, key: str, status: str) -> DataFrame:
    """Bulk status change for a list of ids."""
    hits = ids.select(key, F.lit(True).alias("_hit")).distinct()
    return rows.join(hits, key, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def expand_variants(base: DataFrame, unisex: DataFrame, mens: DataFrame, womens: DataFrame) -> DataFrame:
    """Seed variants: unisex override, else mens by key set, else as given; women rows are added."""
    marked = base.join(unisex.select("release_id", F.col("source_label").alias("_label"), F.lit(True).alias("_unisex")), "release_id", "left").join(
        mens.select("release_id", F.lit(True).alias("_mens")), "release_id", "left")
    by = lambda uni, men, old: F.when(F.col("_unisex"), uni).when(F.col("_mens"), men).otherwise(old)
    keyed = marked.withColumns({
        "source_label": F.when(F.col("_unisex"), F.col("_label")).otherwise(F.col("source_label")),
        "variant_key": by("unisex", "mens", F.col("variant_key")),
        "display_label": by("Unisex", "Men", F.col("display_label")),
        "audience": by("unisex", "mens", F.col("audience")),
        "is_primary": by(True, True, F.col("is_primary")),
    }).drop("_label", "_unisex", "_mens")
    return keyed.unionByName(womens, allowMissingColumns=True)


def rewrite_review_urls(reviews: DataFrame, sites: DataFrame, dates: DataFrame, prefix: str, folder: str = "/seed-reviews/") -> DataFrame:
    """Placeholder urls move to their source's site; publication dates may be overridden by (release, source)."""
    joined = reviews.join(sites.select("source_id", "site_url"), "source_id", "left").join(
        dates.select("release_id", "source_id", F.col("published_at").alias("_date")), ["release_id", "source_id"], "left")
    slug = F.expr(f"substring(source_url, {len(prefix) + 1})")
    moved = F.concat(F.regexp_replace("site_url", "/$", ""), F.lit(folder), slug)
    return joined.withColumns({
        "source_url": F.when(F.col("source_url").startswith(prefix) & F.col("site_url").isNotNull(), moved).otherwise(F.col("source_url")),
        "published_at": F.coalesce("_date", "published_at"),
    }).drop("_date", "site_url")
