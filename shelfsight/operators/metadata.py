"""Typed, lenient reads of metadata documents, override overlay, merging and bounded histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfsight.functions import lexicons as lx, text as t

# --- fixed values: document keys -------------------------------------------------
SUMMARY_KEY = "aiReviewSummary"
OVERRIDE_KEY = "editorialAiReviewSummaryOverride"
EDITORIAL_KEY = "editorialReviewSummary"
HISTORY_KEY = "aiReviewSummaryHistory"
HISTORY_LIMIT = 20
OVERRIDE_HISTORY_LIMIT = 10
EVIDENCE_LIMIT = 6


# Typed reads are written as SQL text: one expression each, however many fields a document has.
# `v` is the name of a VARIANT column or lambda variable.

def _quoted(values: Sequence[str]) -> str:
    return ", ".join(f"'{x}'" for x in values)


def kind_sql(v: str, path: str) -> str:
    return f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))"


def string_sql(v: str, path: str) -> str:
    """The value only if the document holds a string there; numbers are not coerced."""
    return f"CASE WHEN {kind_sql(v, path)} = 'STRING' THEN try_variant_get({v}, '{path}', 'string') END"


def trimmed_sql(text: str) -> str:
    return f"trim(BOTH '{t.WS_CHARS}' FROM {text})"


def enum_sql(v: str, path: str, domain: Sequence[str]) -> str:
    return f"get(filter(array({string_sql(v, path)}), x -> x IN ({_quoted(domain)})), 0)"


def number_sql(v: str, path: str) -> str:
    k = kind_sql(v, path)
    return f"CASE WHEN {k} IN ('BIGINT', 'DOUBLE') OR {k} LIKE 'DECIMAL%' THEN try_variant_get({v}, '{path}', 'double') END"


def count_sql(v: str, path: str) -> str:
    return f"CAST(coalesce({number_sql(v, path)}, 0) AS BIGINT)"


def truth_sql(v: str, path: str) -> str:
    """Truthiness of any JSON value: null, false, 0 and the empty string are false."""
    k = kind_sql(v, path)
    return (f"coalesce(CASE WHEN {k} = 'BOOLEAN' THEN try_variant_get({v}, '{path}', 'boolean') "
            f"WHEN {k} = 'STRING' THEN try_variant_get({v}, '{path}', 'string') <> '' WHEN {k} = 'VOID' THEN false "
            f"WHEN {k} IN ('BIGINT', 'DOUBLE') OR {k} LIKE 'DECIMAL%' THEN try_variant_get({v}, '{path}', 'double') <> 0 "
            f"WHEN {k} IS NOT NULL THEN true END, false)")


def strings_sql(v: str, path: str) -> str:
    """String items of a list; anything else in it is dropped, and a non-list is empty."""
    items = f"filter(try_variant_get({v}, '{path}', 'array<variant>'), e -> schema_of_variant(e) = 'STRING')"
    return f"coalesce(transform({items}, e -> try_variant_get(e, '$', 'string')), array())"


def list_sql(v: str, path: str, limit: int) -> str:
    return f"slice(filter(transform({strings_sql(v, path)}, e -> {trimmed_sql('e')}), e -> e <> ''), 1, {limit})"


def evidence_sql(v: str, path: str, limit: int = EVIDENCE_LIMIT) -> str:
    typed = (f"transform(try_variant_get({v}, '{path}', 'array<variant>'), e -> named_struct('source_name', {string_sql('e', '$.sourceName')}, "
             f"'source_type', {enum_sql('e', '$.sourceType', lx.SOURCE_TYPES)}, 'title', {string_sql('e', '$.title')}, "
             f"'excerpt', {trimmed_sql(string_sql('e', '$.excerpt'))}))")
    kept = f"filter({typed}, r -> r.source_name <> '' AND r.source_type IS NOT NULL AND r.excerpt <> '')"
    empty = "CAST(array() AS array<struct<source_name:string,source_type:string,title:string,excerpt:string>>)"
    return f"slice(coalesce({kept}, {empty}), 1, {limit})"


def _record(fields: dict[str, str], condition: str) -> Column:
    """Struct of fields, null as a whole unless the condition over `r` holds."""
    struct = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return F.expr(f"get(filter(array(named_struct({struct})), r -> {condition}), 0)")


def read_string(v: str, path: str) -> Column:
    return F.expr(string_sql(v, path))


def read_enum(v: str, path: str, domain: Sequence[str]) -> Column:
    return F.expr(enum_sql(v, path, domain))


def read_number(v: str, path: str) -> Column:
    return F.expr(number_sql(v, path))


def read_count(v: str, path: str) -> Column:
    return F.expr(count_sql(v, path))


def read_string_list(v: str, path: str, limit: int) -> Column:
    return F.expr(list_sql(v, path, limit))


def read_highlights(v: str, limit: int = 3) -> Column:
    """Strings kept as they are, only the count is bounded."""
    return F.expr(f"slice({strings_sql(v, '$.highlights')}, 1, {limit})")


def read_evidence(v: str, path: str) -> Column:
    return F.expr(evidence_sql(v, path))


REQUIRED_FIELDS = ("overview", "overall_sentiment", "confidence", "generated_at", "provider")


def stored_summary(v: str, names: Sequence[str] | None = None) -> Column:
    """The generated summary, or null as a whole when a required field is missing; with names, these and the required fields alone."""
    p = f"$.{SUMMARY_KEY}"
    overview = f"coalesce({string_sql(v, p + '.overview')}, '')"
    lists = {"pros": "pros", "cons": "cons", "best_for": "bestFor", "watch_outs": "watchOuts",
             "consensus_points": "consensusPoints", "debates": "debates"}
    fields = {
        "overview": trimmed_sql(overview),
        "overall_sentiment": enum_sql(v, f"{p}.overallSentiment", lx.SENTIMENTS),
        "confidence": enum_sql(v, f"{p}.confidence", lx.CONFIDENCES),
        "editorial_sentiment": enum_sql(v, f"{p}.editorialSentiment", lx.SENTIMENTS),
        "community_sentiment": enum_sql(v, f"{p}.communitySentiment", lx.SENTIMENTS),
        "source_alignment": f"coalesce({enum_sql(v, p + '.sourceAlignment', lx.ALIGNMENTS)}, 'mixed')",
        "buyer_signal": string_sql(v, f"{p}.buyerSignal"),
        **{name: list_sql(v, f"{p}.{key}", 4) for name, key in lists.items()},
        "review_count": count_sql(v, f"{p}.reviewCount"),
        "source_count": count_sql(v, f"{p}.sourceCount"),
        "generated_at": string_sql(v, f"{p}.generatedAt"),
        "model": string_sql(v, f"{p}.model"),
        "provider": enum_sql(v, f"{p}.provider", lx.SUMMARY_PROVIDERS),
        "evidence": evidence_sql(v, f"{p}.evidence"),
        "is_override": "false",
    }
    if names is not None:
        fields = {name: sql for name, sql in fields.items() if name in {*names, *REQUIRED_FIELDS, "is_override"}}
    return _record(fields, "r.overview <> '' AND r.overall_sentiment IS NOT NULL AND r.confidence IS NOT NULL "
                           "AND r.generated_at <> '' AND r.provider IS NOT NULL")


def summary_override(v: str) -> Column:
    p = f"$.{OVERRIDE_KEY}"
    fields = {
        "is_enabled": truth_sql(v, f"{p}.isEnabled"),
        "overview": string_sql(v, f"{p}.overview"),
        "overall_sentiment": enum_sql(v, f"{p}.overallSentiment", lx.SENTIMENTS),
        "confidence": enum_sql(v, f"{p}.confidence", lx.CONFIDENCES),
        "pros": list_sql(v, f"{p}.pros", 4), "cons": list_sql(v, f"{p}.cons", 4),
        "best_for": list_sql(v, f"{p}.bestFor", 4), "watch_outs": list_sql(v, f"{p}.watchOuts", 4),
        "updated_at": string_sql(v, f"{p}.updatedAt"),
    }
    return _record(fields, "r.is_enabled OR r.updated_at <> ''")


def editorial_notes(v: str) -> Column:
    p = f"$.{EDITORIAL_KEY}"
    return F.expr(f"named_struct('summary_note', {string_sql(v, p + '.summaryNote')}, "
                  f"'pinned_takeaways', {list_sql(v, p + '.pinnedTakeaways', 5)}, 'ignored_themes', {list_sql(v, p + '.ignoredThemes', 8)})")


def summary_history(v: str) -> Column:
    fields = {
        "timestamp": string_sql("e", "$.timestamp"), "event_type": enum_sql("e", "$.eventType", lx.HISTORY_EVENTS),
        "provider": enum_sql("e", "$.provider", lx.HISTORY_PROVIDERS), "overview": string_sql("e", "$.overview"),
        "overall_sentiment": enum_sql("e", "$.overallSentiment", lx.SENTIMENTS), "confidence": enum_sql("e", "$.confidence", lx.CONFIDENCES),
        "review_count": count_sql("e", "$.reviewCount"), "source_count": count_sql("e", "$.sourceCount"),
        "evidence_count": count_sql("e", "$.evidenceCount"),
    }
    struct = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    typed = f"transform(try_variant_get({v}, '$.{HISTORY_KEY}', 'array<variant>'), e -> named_struct({struct}))"
    return F.expr(f"slice(filter({typed}, r -> r.timestamp <> '' AND r.event_type IS NOT NULL), 1, {HISTORY_LIMIT})")


def overlay_override(stored: str, override: str, only: Sequence[str] | None = None) -> Column:
    """Editorial values win where given; lists replace only when not empty. With only, the summary has just these fields."""
    names = ("overview", "overall_sentiment", "confidence", "editorial_sentiment", "community_sentiment", "source_alignment", "buyer_signal",
             "pros", "cons", "best_for", "watch_outs", "consensus_points", "debates", "review_count", "source_count", "generated_at", "model",
             "provider", "evidence")
    values = {n: f"{stored}.{n}" for n in names}
    for n in ("overview", "overall_sentiment", "confidence"):
        values[n] = f"coalesce({override}.{n}, {stored}.{n})"
    for n in ("pros", "cons", "best_for", "watch_outs"):
        values[n] = f"if(size({override}.{n}) > 0, {override}.{n}, {stored}.{n})"
    if only is not None:
        values = {n: x for n, x in values.items() if n in only}
        plain = ", ".join(f"'{n}', {stored}.{n}" for n in values)
        stored_part = f"CASE WHEN {stored} IS NOT NULL THEN named_struct({plain}, 'is_override', false) END"
    else:
        stored_part = stored
    merged = ", ".join(f"'{n}', {x}" for n, x in values.items())
    return F.expr(f"CASE WHEN {override}.is_enabled AND {stored} IS NOT NULL THEN named_struct({merged}, 'is_override', true) ELSE {stored_part} END")


def _once(**columns: Column) -> Column:
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def read_release_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Adds stored, override, notes and summary (the overlaid one); drops the raw document.

    The typed records pass through a one-row generator: filters on them then stay above it,
    where pushing them down would copy the whole parsing expression into every predicate.
    """
    parsed = df.withColumn("_v", F.try_parse_json(F.col(column)))
    kept = [c for c in df.columns if c != column]
    typed = parsed.select(*kept, _once(stored=stored_summary("_v"), override=summary_override("_v"), notes=editorial_notes("_v")))
    return typed.select("*", _once(summary=overlay_override("stored", "override")))


def read_release_summary(df: DataFrame, names: Sequence[str], column: str = "metadata") -> DataFrame:
    """Adds the overlaid summary with the named fields alone, for readers of no other; drops the raw document."""
    parsed = df.withColumn("_v", F.try_parse_json(F.col(column)))
    kept = [c for c in df.columns if c != column]
    typed = parsed.select(*kept, _once(stored=stored_summary("_v", names), override=summary_override("_v")))
    return typed.select(*kept, _once(summary=overlay_override("stored", "override", names)))


def read_release_notes(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Adds notes alone, for readers of no other record: the fields of the summaries are not read; drops the raw document."""
    parsed = df.withColumn("_v", F.try_parse_json(F.col(column)))
    return parsed.select(*[c for c in df.columns if c != column], _once(notes=editorial_notes("_v")))


def summary_status(df: DataFrame) -> DataFrame:
    """Display fields of the summary state per release."""
    stored, summary = F.col("stored"), F.col("summary")
    return df.select(
        "release_id",
        (stored.isNotNull() | F.col("override").isNotNull()).alias("has_any_summary"),
        F.when(summary.isNull(), "missing").when(summary["is_override"], "override").otherwise("generated").alias("summary_state"),
        stored["generated_at"].alias("generated_at"),
        summary["overview"].alias("preview"),
        F.coalesce(stored["source_count"], F.lit(0)).alias("source_count"),
        F.coalesce(stored["review_count"], F.lit(0)).alias("review_count"),
        F.coalesce(F.size(stored["evidence"]), F.lit(0)).cast("bigint").alias("evidence_count"),
        F.coalesce(F.col("override.is_enabled"), F.lit(False)).alias("override_enabled"),
    )


def merge_metadata(document: Column, patch: dict[str, tuple[Column, Column]]) -> Column:
    """JSON text with top-level keys patched: key -> (is supplied, new JSON text or null to delete)."""
    def patched(entries: Column, key: str, supplied: Column, value: Column) -> Column:
        without = F.map_filter(entries, lambda k, _v: k != key)
        replaced = F.map_concat(without, F.create_map(F.lit(key), F.parse_json(value)))
        return F.when(~supplied, entries).when(value.isNull(), without).otherwise(replaced)

    entries = F.coalesce(F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>"),
                         F.create_map().cast("map<string,variant>"))
    for key, (supplied, value) in patch.items():
        entries = patched(entries, key, supplied, value)
    return F.to_json(entries)


def prepend_history(history: Column, entry: Column, limit: int = HISTORY_LIMIT) -> Column:
    return F.slice(F.concat(F.array(entry), history), 1, limit)


def append_history(history: Column, entry: Column, limit: int = OVERRIDE_HISTORY_LIMIT) -> Column:
    grown = F.concat(history, F.array(entry))
    return F.slice(grown, F.greatest(F.size(grown) - limit, F.lit(0)) + 1, F.lit(limit))
