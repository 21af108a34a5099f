"""Side-by-side comparison of release sets, keyed by `set_id` so that many sets run in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfsight.functions import text as t
from shelfsight.operators import scoring
from shelfsight.operators.catalog import plain_number
from shelfsight.session import cut_lineage

MAX_SET = 4
PENDING = "Pending"


def option_labels(cards: DataFrame) -> DataFrame:
    year = F.col("release_year").cast("string")
    return cards.select(
        "release_id", F.concat_ws(" ", "brand", "release").alias("label"),
        F.concat_ws(" · ", "category", F.coalesce(year, F.lit("Year TBD")), F.when(F.col("is_plated"), "Plated").otherwise("Non-plated")).alias("detail"),
        F.concat_ws(" ", "brand", "model", "release", year).alias("search_label"),
    )


def facet_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns with their counts, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def dependent_facets(rows: DataFrame, facets: dict[str, Column], selected: dict[str, Sequence[str]]) -> DataFrame:
    """(facet, value, n, is_selected): values of every facet among the rows that pass the selections of all other facets, in one pass.

    A row knows how many selections it fails; for a facet it counts when none of these is another's. Facets without a selection fail nothing; a null
    value is a value of its own, which no selection names.
    """
    misses = {name: (~F.coalesce(value.isin(*selected[name]), F.lit(False))).cast("int") if selected.get(name) else F.lit(0) for name, value in facets.items()}
    total = sum(misses.values(), F.lit(0))
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"), (total - misses[name] == 0).alias("counts"), (misses[name] == 0).alias("passes"))
                      for name, value in facets.items()])
    met = rows.select(F.explode(F.filter(pairs, lambda p: p["counts"])).alias("f"))
    return met.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"), F.bool_or("f.passes").alias("is_selected")).withColumn(
        "is_selected", F.col("is_selected") & F.col("facet").isin(*[n for n in facets if selected.get(n)]))


def bounded_sets(members: DataFrame, limit: int = MAX_SET) -> DataFrame:
    """First `limit` releases of each requested set (the size limit is part of the feature)."""
    order = Window.partitionBy("set_id").orderBy("position", "release_id")
    return members.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def comparison_rows(members: DataFrame, cards: DataFrame, chosen: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """Cards of each set's members with the chosen variant's specs, coverage and pinned takeaways."""
    rows = bounded_sets(members).select("set_id", "release_id").join(cards, "release_id")
    if chosen is not None:
        fields = ("weight_oz", "heel_mm", "forefoot_mm", "drop_mm")
        picked = chosen.select("release_id", "variant_key", *[F.col(f).cast(cards.schema[f].dataType).alias(f"_v_{f}") for f in fields])
        rows = rows.join(picked, "release_id", "left").withColumns({f: F.coalesce(f"_v_{f}", f) for f in fields}).drop(*[f"_v_{f}" for f in fields])
    empty = F.array().cast("array<string>")
    if notes is not None:
        rows = rows.join(notes.select("release_id", "pinned_takeaways"), "release_id", "left").withColumn(
            "takeaways", F.coalesce("pinned_takeaways", empty)).drop("pinned_takeaways")
    else:
        rows = rows.withColumn("takeaways", empty)
    s = F.col("summary")
    return rows.withColumns({
        "name": F.concat_ws(" ", "brand", "release"),
        "coverage": scoring.comparison_coverage(F.col("review_count"), F.col("source_count")),
        "has_signal": F.coalesce((s["source_count"] >= 2) | (s["review_count"] >= 2) | (F.size(s["evidence"]) >= 2), F.lit(False)),
        "pros": F.coalesce(s["pros"], empty),
    })


def set_order() -> list[str]:
    return ["brand", "model", "release_id"]


def _ordered(fields: Sequence[Column], value: Column, keep: Column | None = None) -> Column:
    """Values of a set (at most four rows) in a given order."""
    item = F.struct(*[f.alias(f"o{i}") for i, f in enumerate(fields)], value.alias("value"))
    rows = F.collect_list(F.when(keep, item) if keep is not None else item)
    return F.transform(F.array_sort(rows), lambda x: x["value"])


def _in_set_order() -> list[Column]:
    return [F.col(c) for c in set_order()]


def overview(rows: DataFrame) -> DataFrame:
    """Lightest and best-scored member per set, first in set order on ties."""
    weight_key = F.struct("weight_oz", *set_order())
    score_key = F.struct((-F.col("review_score")).alias("s"), *set_order())
    return rows.groupBy("set_id").agg(
        _ordered(_in_set_order(), F.col("name")).alias("names"),
        F.min_by(F.when(F.col("weight_oz").isNotNull(), F.col("name")), F.when(F.col("weight_oz").isNotNull(), weight_key)).alias("lightest"),
        F.min_by(F.when(F.col("review_score").isNotNull(), F.col("name")), F.when(F.col("review_score").isNotNull(), score_key)).alias("best_scored"),
        F.count("*").alias("members"),
    ).withColumn("overview", F.when(F.col("members") >= 2, F.concat_ws(
        " ", F.concat(F.array_join("names", ", "), F.lit(" serve different buying priorities.")),
        F.concat(F.col("lightest"), F.lit(" is the lightest option in this set.")),
        F.concat(F.col("best_scored"), F.lit(" currently has the strongest review signal.")))))


THIN_CAUTION = ("Review evidence is still thin for at least one of these shoes, so comparison guidance is limited "
                "to harder spec differences.")
DEVELOPING_CAUTION = ("The review-derived comparison signal is still developing, so shared themes are suppressed "
                      "until more evidence is indexed.")


def confidence_gate(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy("set_id").agg(
        F.count("*").alias("members"), F.count_if("has_signal").alias("signal_rows"), F.sum("evidence_count").alias("evidence"))
    thin = F.col("signal_rows") < 2
    return counted.withColumns({
        "allow_themes": ~thin, "allow_shared": ~thin & (F.col("evidence") >= 6),
        "caution": F.when(F.col("members") < 2, None).when(thin, THIN_CAUTION).when(F.col("evidence") < 6, DEVELOPING_CAUTION),
    })


def money(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, PENDING).otherwise(F.concat(F.lit("$"), plain_number(c.cast("decimal(12,2)"))))


def differences(rows: DataFrame, gate: DataFrame, limit: int = 4) -> DataFrame:
    """Price, weight, construction and takeaway insights per set, in that order."""
    name, price, weight = F.col("name"), F.col("price_usd"), F.col("weight_oz")
    theme = F.coalesce(F.get("takeaways", F.lit(0)), F.get("pros", F.lit(0)))
    themed = F.when(theme != "", F.concat(name, F.lit(": "), theme))
    ounces = F.concat(name, F.lit(": "), plain_number(weight.cast("decimal(6,1)")), F.lit(" oz"))
    plate = F.when(F.col("is_plated"), "Plated").otherwise("Non-plated")
    by = _in_set_order()
    grouped = rows.join(gate.select("set_id", "allow_themes"), "set_id").groupBy("set_id").agg(
        _ordered([price, *by], F.struct(name.alias("name"), F.concat(name, F.lit(": "), money(price)).alias("text")), price.isNotNull()).alias("prices"),
        _ordered([weight, *by], F.struct(name.alias("name"), ounces.alias("text")), weight.isNotNull()).alias("weights"),
        (F.max("price_usd") - F.min("price_usd")).alias("price_gap"), (F.max("weight_oz") - F.min("weight_oz")).alias("weight_gap"),
        _ordered(by, name, F.col("is_plated")).alias("plated"), _ordered(by, name, ~F.col("is_plated")).alias("non_plated"),
        _ordered(by, F.concat(name, F.lit(": "), plate)).alias("plates"),
        _ordered(by, themed, themed.isNotNull() & F.col("allow_themes")).alias("leaders"), F.count("*").alias("members"),
    )

    def ends(c: str) -> tuple[Column, Column]:
        return F.element_at(c, 1)["name"], F.element_at(c, -1)["name"]

    def texts(c: str) -> Column:
        return F.transform(c, lambda x: x["text"])

    def insight(condition: Column, title: str, summary: Column, evidence: Column) -> Column:
        return F.when(condition & (F.col("members") >= 2), F.struct(F.lit(title).alias("title"), summary.alias("summary"), evidence.alias("evidence")))

    cheap, dear = ends("prices")
    light, heavy = ends("weights")
    items = F.array(
        insight((F.size("prices") >= 2) & (F.col("price_gap") >= 20), "Price spread",
                F.concat(cheap, F.lit(" is the cheaper option, while "), dear, F.lit(" sits at the top of the price range.")), texts("prices")),
        insight((F.size("weights") >= 2) & (F.round("weight_gap", 6) >= 0.5), "Weight",
                F.concat(light, F.lit(" is meaningfully lighter than "), heavy, F.lit(".")), texts("weights")),
        insight((F.size("plated") > 0) & (F.size("non_plated") > 0), "Ride construction",
                F.concat(F.array_join("plated", ", "), F.lit(" bring plated geometry into the mix, while "),
                         F.array_join("non_plated", ", "), F.lit(" stay non-plated.")), F.col("plates")),
        insight(F.size("leaders") >= 2, "Review takeaway", F.array_join("leaders", " "), F.col("leaders")),
    )
    return grouped.select("set_id", F.slice(F.array_compact(items), 1, limit).alias("insights"))


def chooser_guidance(rows: DataFrame, limit: int = 3) -> DataFrame:
    """One sentence for the first three members with review signal."""
    plated_cue = (F.when(F.col("is_plated"), "Better fit for runners prioritizing a plated feel.")
                  .otherwise("Safer fit for runners avoiding plated ride dynamics."))
    best_for = F.get("summary.best_for", F.lit(0))
    cue = F.coalesce(F.nullif(best_for, F.lit("")), F.nullif(F.col("usage_summary"), F.lit("")), plated_cue)
    order = Window.partitionBy("set_id").orderBy(*set_order())
    return (
        rows.filter("has_signal").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        .select("set_id", "rank", "release_id", F.concat(F.lit("Choose "), F.col("name"), F.lit(" if "), t.lower_first(cue)).alias("guidance"))
    )


def shared_signals(rows: DataFrame, gate: DataFrame, limit: int = 4) -> DataFrame:
    """Signals whose first word occurs in some signal of every member of the set.

    A set has at most four members with a handful of signals each, so the word test runs
    inside the set's own row instead of joining signals with each other.
    """
    signals = F.concat("pros", "takeaways")
    normal = F.transform(signals, t.normalize_search_text)
    grouped = rows.join(gate.filter("allow_shared").select("set_id"), "set_id").groupBy("set_id").agg(
        _ordered(_in_set_order(), F.struct(signals.alias("signals"), normal.alias("normal"))).alias("members"))
    candidates = F.flatten(F.transform("members", lambda m: F.zip_with(
        m["signals"], m["normal"], lambda a, b: F.struct(a.alias("text"), b.alias("norm")))))

    def everywhere(c: Column) -> Column:
        word = F.get(F.split(c["norm"], " "), F.lit(0))
        return F.forall("members", lambda m: F.exists(m["normal"], lambda v: v.contains(word)))

    shared = F.array_distinct(F.transform(F.filter(candidates, everywhere), lambda c: c["text"]))
    return grouped.select("set_id", F.slice(shared, 1, limit).alias("shared_signals"))


def narrative(rows: DataFrame) -> DataFrame:
    """Overview, guidance, differences, shared signals and caution per set; empty for single members.

    The rows feed five roll-ups, so they are computed once and kept in a checkpoint.
    """
    rows = cut_lineage(rows)
    gate = confidence_gate(rows)
    guidance = chooser_guidance(rows).groupBy("set_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "guidance"))), lambda g: g["guidance"]).alias("guidance"))
    empty = F.array().cast("array<string>")
    several = F.col("members") >= 2
    return (
        gate.join(overview(rows).select("set_id", "overview"), "set_id")
        .join(guidance, "set_id", "left").join(differences(rows, gate), "set_id", "left").join(shared_signals(rows, gate), "set_id", "left")
        .select("set_id", "overview", "caution",
                F.when(several, F.coalesce("guidance", empty)).otherwise(empty).alias("guidance"), "insights",
                F.when(several, F.coalesce("shared_signals", empty)).otherwise(empty).alias("shared_signals"))
    )


MATRIX_LABELS = ("Category", "Usage", "Price", "Weight", "Heel stack", "Forefoot stack", "Drop", "Plate", "Review score", "Rating signal",
                 "Sentiment signal", "Editorial read", "Community read", "Source alignment", "Buyer signal", "AI summary", "Top takeaways")


def comparison_matrix(rows: DataFrame) -> DataFrame:
    """Seventeen labelled attributes per set, one value per member in set order."""
    def measure(c: str, suffix: str) -> Column:
        number = F.col(c)
        return F.when(F.coalesce(number.cast("double"), F.lit(0.0)) == 0, PENDING).otherwise(
            F.concat(plain_number(number.cast("decimal(12,1)")), F.lit(suffix)))

    def or_pending(c: Column) -> Column:
        return F.coalesce(c, F.lit(PENDING))

    s = F.col("summary")
    values = (
        F.col("category"), or_pending(F.col("usage_summary")), money(F.col("price_usd")), measure("weight_oz", " oz"), measure("heel_mm", " mm"),
        measure("forefoot_mm", " mm"), measure("drop_mm", " mm"), F.when(F.col("is_plated"), "Plated").otherwise("Non-plated"),
        measure("review_score", "/100"), measure("rating_score", "/100"), measure("sentiment_score", "/100"), F.lit(PENDING), F.lit(PENDING),
        F.col("source_alignment"), or_pending(s["buyer_signal"]), or_pending(s["overview"]),
        F.when(F.size("takeaways") > 0, F.array_join("takeaways", " • ")).otherwise(PENDING),
    )
    slot = F.row_number().over(Window.partitionBy("set_id").orderBy(*set_order()))
    pairs = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), v.alias("value"))
                      for i, (label, v) in enumerate(zip(MATRIX_LABELS, values, strict=True))])
    long = rows.withColumn("slot", slot).select("set_id", "slot", F.explode(pairs).alias("p")).select("set_id", "slot", "p.*")
    return long.groupBy("set_id", "line", "label").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"value_{i}") for i in range(1, MAX_SET + 1)])
