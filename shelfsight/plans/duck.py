"""DuckDB counterparts used by the correctness check: fixture views and text snippets."""

from __future__ import annotations

import re

from shelfsight.functions import lexicons as lx
from shelfsight.sources.fixtures import REVIEW_AS_OF, RUN_AS_OF

WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
AS_OF = f"TIMESTAMP '{REVIEW_AS_OF}'"
RUN_NOW = f"TIMESTAMP '{RUN_AS_OF}'"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def norm(x: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(lower("
        f"{x}), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    )


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace({trim_ws(f'lower({x})')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def capitalize(x: str) -> str:
    return f"(upper({x}[1:1]) || {x}[2:])"


def humanize(x: str) -> str:
    return f"list_aggregate(list_transform(string_split({x}, '-'), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ')"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def count_hits(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {quoted(w)}) AS INTEGER)" for w in words) + ")"


def labels(x: str, patterns) -> str:
    """List of matching labels in declared order."""
    cases = ", ".join(f"CASE WHEN {contains_any(x, words)} THEN {quoted(label)} END" for label, words in patterns)
    return f"list_filter([{cases}], lambda v: v IS NOT NULL)"


def joined(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, {quoted(sep)})"


def half_up(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def e4(x: str) -> str:
    """Ten-thousandths to a two-decimal double, half up."""
    return f"(floor(({x} + 50) / 100.0) / 100.0)::DOUBLE"


def source_weight(x: str) -> str:
    return f"(CASE {x} WHEN 'editorial' THEN 10000 WHEN 'reddit' THEN 7000 ELSE 5500 END)"


def freshness(published: str, as_of: str = AS_OF) -> str:
    age = f"(epoch_us({as_of}) - epoch_us({published}))"
    day = 86_400_000_000
    return (
        f"(CASE WHEN {published} IS NULL THEN 65 WHEN {age} <= {120 * day} THEN 100 "
        f"WHEN {age} <= {365 * day} THEN 85 WHEN {age} <= {730 * day} THEN 70 ELSE 55 END)"
    )


def weight(source_type: str, published: str) -> str:
    return f"CAST({source_weight(source_type)} * {freshness(published)} // 100 AS BIGINT)"


def iso_date(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def iso_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def pick(expr: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    return f"(CASE {expr} {whens} END)"


_hits = ", ".join(
    f"CASE WHEN CAST(floor(l_quantity) AS INTEGER) % {i + 2} = 0 THEN {quoted(label)} END"
    for i, (label, _) in enumerate(lx.HIGHLIGHT_PATTERNS)
)


def _json_part(*pieces: str) -> str:
    return "(" + " || ".join(pieces) + ")"


def _metadata_sql() -> str:
    q = quoted
    k = "p_partkey"
    text = f"CAST({k} AS VARCHAR)"
    evidence = _json_part(
        q('[{"sourceName":"S'), text, q('","sourceType":"editorial","title":"T","excerpt":" e1 "},'),
        q('{"sourceName":"R","sourceType":"reddit","title":null,"excerpt":"e2"}'),
        f"CASE WHEN {k} % 2 = 0 THEN " + q(',{"sourceName":"U","sourceType":"user","excerpt":"e3"}') + " ELSE '' END",
        f"CASE WHEN {k} % 3 = 0 THEN " + q(',{"sourceName":"X","sourceType":"paper","excerpt":"no"},7,{"sourceName":"Y","sourceType":"user","excerpt":"  "}') + " ELSE '' END",
        q("]"),
    )
    summary = _json_part(
        q('"aiReviewSummary":{"overview":"'),
        f"CASE WHEN {k} % 37 = 0 THEN '  ' ELSE ' Overview ' || {text} || ' ' END",
        q('","overallSentiment":"'),
        f"CASE WHEN {k} % 23 = 0 THEN 'great' ELSE {pick(f'{k} % 4', ['positive', 'mixed', 'negative', 'positive'])} END",
        q('","confidence":"'), pick(f"{k} % 3", ["high", "medium", "low"]),
        q('","editorialSentiment":'), f"CASE {k} % 5 WHEN 1 THEN '\"positive\"' WHEN 2 THEN '\"mixed\"' ELSE 'null' END",
        q(',"communitySentiment":'), f"CASE {k} % 6 WHEN 1 THEN '\"negative\"' WHEN 2 THEN '\"odd\"' ELSE 'null' END",
        q(',"sourceAlignment":"'), pick(f"{k} % 4", ["aligned", "mixed", "divergent", "unsure"]),
        q('","buyerSignal":'), f"CASE WHEN {k} % 7 = 0 THEN '5' ELSE '\"Signal ' || {text} || '\"' END",
        q(',"pros":["'), pick(f"{k} % 3", ["Smooth ride", "Smooth foam", "Light upper"]), q('",3," ","Grip '),
        pick(f"{k} % 5", ["wet", "dry", "trail", "road", "track"]), q(' "]'),
        q(',"cons":["Price is high"],"bestFor":['),
        f"CASE WHEN {k} % 4 <> 0 THEN '\"Tempo ' || {pick(f'{k} % 7', list('abcdefg'))} || '\"' ELSE '' END", q("]"),
        q(',"watchOuts":"none","consensusPoints":["c1","c2","c3","c4","c5"],"debates":[]'),
        q(',"reviewCount":'), f"CASE WHEN {k} % 29 = 0 THEN '\"9\"' ELSE CAST({k} % 9 AS VARCHAR) END",
        q(',"sourceCount":'), f"CAST({k} % 5 AS VARCHAR)",
        q(',"generatedAt":"2001-11-0'), f"CAST(1 + {k} % 9 AS VARCHAR)",
        q('T10:00:00.000Z","model":null,"provider":"heuristic","evidence":'), evidence, q("}"),
    )
    override = _json_part(
        q(',"editorialAiReviewSummaryOverride":{"isEnabled":'), f"CASE WHEN {k} % 8 = 0 THEN 'true' ELSE 'false' END",
        q(',"overview":'), f"CASE WHEN {k} % 16 = 0 THEN '\"Edited overview\"' ELSE 'null' END",
        q(',"overallSentiment":"negative","pros":["Edited pro"],"cons":[],"updatedAt":"2001-11-20T00:00:00.000Z"}'),
    )
    editorial = _json_part(
        q(',"editorialReviewSummary":{"summaryNote":"Note '), text, q('","pinnedTakeaways":['),
        f"CASE WHEN {k} % 10 = 0 THEN '\"Pinned take\"' ELSE '' END",
        q('],"ignoredThemes":["'), pick(f"{k} % 3", ["Fit", "Ride", "Value"]), q('"]}'),
    )
    document = _json_part(
        q("{"), summary, f"CASE WHEN {k} % 4 = 0 THEN {override} ELSE '' END",
        f"CASE WHEN {k} % 9 = 0 THEN {editorial} ELSE '' END", q("}"),
    )
    return (
        f"SELECT {k} AS release_id, CASE WHEN {k} % 11 = 0 THEN NULL WHEN {k} % 13 = 0 THEN '{{broken' "
        f"WHEN {k} % 19 = 0 THEN '[1]' ELSE {document} END AS metadata FROM part"
    )


def jstr(path: str, doc: str = "doc") -> str:
    """Typed read: the string at a path, null for any other JSON type."""
    return f"(CASE WHEN json_type({doc}, '{path}') = 'VARCHAR' THEN json_extract_string({doc}, '{path}') END)"


def jnum(path: str, doc: str = "doc") -> str:
    return f"(CASE WHEN json_type({doc}, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string({doc}, '{path}') AS BIGINT) ELSE 0 END)"


def jenum(path: str, domain, doc: str = "doc") -> str:
    read = jstr(path, doc)
    return f"(CASE WHEN {read} IN ({', '.join(quoted(d) for d in domain)}) THEN {read} END)"


def jlist(path: str, limit: int, doc: str = "doc") -> str:
    items = f"CASE WHEN json_type({doc}, '{path}') = 'ARRAY' THEN json_extract({doc}, '{path}[*]') ELSE [] END"
    strings = f"list_filter({items}, lambda e: json_type(e) = 'VARCHAR')"
    texts = f"list_transform({strings}, lambda e: {trim_ws('json_extract_string(e, chr(36))')})"
    return f"(list_filter({texts}, lambda t: t <> '')[1:{limit}])"


_S = "$.aiReviewSummary"
_O = "$.editorialAiReviewSummaryOverride"
_N = "$.editorialReviewSummary"

VIEWS: dict[str, str] = {
    "v_release": """SELECT p_partkey AS release_id, p_brand AS brand, p_name AS family, p_brand || ':' || p_name AS family_id,
        p_name || ' v' || CAST(p_partkey AS VARCHAR) AS version_name,
        CASE WHEN p_partkey % 50 <> 0 THEN CAST(2015 + p_partkey % 11 AS INTEGER) END AS release_year,
        CASE WHEN p_partkey % 40 <> 0 THEN CAST(p_retailprice AS DECIMAL(8,2)) END AS msrp_usd,
        p_partkey % 3 <> 0 AS is_current, p_partkey % 4 = 0 AS is_plated,
        CASE WHEN p_partkey % 17 <> 0 THEN p_type END AS foam,
        CASE WHEN p_partkey % 6 <> 0 THEN 'Daily ' || lower(p_type) || ' use' END AS usage_summary FROM part""",
    "v_family": """SELECT p_brand || ':' || p_name AS family_id, lower(min(p_type)) || '-trainer' AS category,
        CASE min(p_partkey) % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'trail' WHEN 2 THEN 'track' ELSE 'mixed' END AS terrain,
        CASE WHEN min(p_partkey) % 3 = 0 THEN 'stability' ELSE 'neutral' END AS stability
        FROM part GROUP BY p_brand, p_name""",
    "v_spec": """SELECT p_partkey AS release_id,
        CASE WHEN p_partkey % 13 <> 0 THEN CAST((60 + p_partkey % 60) / 10.0 AS DECIMAL(4,1)) END AS weight_oz,
        CASE WHEN p_partkey % 11 <> 0 THEN CAST(20 + p_size % 25 AS INTEGER) END AS heel_mm,
        CASE WHEN p_partkey % 11 <> 0 THEN CAST(20 + p_size % 25 - p_partkey % 13 AS INTEGER) END AS forefoot_mm,
        CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 13 AS INTEGER) END AS drop_mm,
        CASE WHEN p_partkey % 5 = 0 THEN 'Fit note ' || CAST(p_partkey AS VARCHAR) END AS fit_notes,
        CASE WHEN p_partkey % 7 = 0 THEN 'Source note ' || CAST(p_partkey AS VARCHAR) END AS source_notes FROM part""",
    "v_variant": """SELECT release_id, 'default' AS variant_key, 'Default' AS display_label, 'unknown' AS audience, true AS is_primary,
          weight_oz, heel_mm, forefoot_mm, drop_mm, fit_notes, source_notes FROM v_spec
        UNION ALL SELECT release_id, 'mens', 'Men', 'mens', false, weight_oz, heel_mm, forefoot_mm, drop_mm, fit_notes, source_notes
          FROM v_spec WHERE release_id % 2 = 0
        UNION ALL SELECT release_id, 'womens', 'Women', 'womens', false, CAST(weight_oz - 1.5 AS DECIMAL(4,1)), heel_mm, forefoot_mm,
          drop_mm, fit_notes, source_notes FROM v_spec WHERE release_id % 4 < 2""",
    "v_source": """SELECT s_suppkey AS source_id, s_name AS source_name,
        CASE s_suppkey % 3 WHEN 0 THEN 'editorial' WHEN 1 THEN 'reddit' ELSE 'user' END AS source_type FROM supplier""",
    "v_author": """SELECT c_custkey AS author_id,
        CASE WHEN c_custkey % 9 = 0 THEN ' supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE c_name END AS display_name FROM customer""",
    "v_review": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id,
        l_partkey AS release_id, l_suppkey AS source_id,
        CASE WHEN l_discount <> 0.05::DOUBLE THEN CAST(floor(l_quantity * 2) AS INTEGER) END AS score,
        CASE WHEN l_tax = 0 THEN NULL WHEN l_discount >= 0.07::DOUBLE THEN 'positive'
             WHEN l_discount <= 0.02::DOUBLE THEN 'negative' ELSE 'mixed' END AS sentiment,
        CASE WHEN l_returnflag || l_linestatus = 'AF' THEN 'approved' WHEN l_returnflag || l_linestatus = 'AO' THEN 'rejected'
             WHEN l_returnflag = 'N' THEN 'pending' ELSE 'flagged' END AS status,
        CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS published_at,
        TIMESTAMP '2002-01-01' + to_days(CAST(l_orderkey % 5 AS INTEGER)) AS created_at,
        list_filter([{_hits}], lambda v: v IS NOT NULL)[1:3] AS highlights,
        'https://s' || l_suppkey || '.example.com/r/' || l_orderkey || '-' || l_linenumber AS source_url,
        CASE WHEN l_orderkey % 4 <> 0 THEN 'importer-' || (l_orderkey % 5) END AS importer,
        l_orderkey * 7 + l_linenumber AS doc_slot, l_orderkey FROM lineitem""",
    "v_document": """SELECT doc_id, lang, source, string_split(text, chr(10))[1] AS title,
        CASE WHEN doc_id % 5 <> 0 THEN text END AS excerpt, text AS body FROM documents""",
    "v_run": """SELECT event_id AS run_id, user_id % 6 AS crawl_source_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS release_id,
        ts AS created_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'partial' WHEN 'click' THEN 'succeeded'
        WHEN 'view' THEN 'running' ELSE 'queued' END AS status, CAST(floor(value) AS BIGINT) AS value FROM events""",
    "v_crawl_source": """SELECT * FROM (VALUES (0, 0, 'importer-0', 'hourly', true), (1, 1, 'importer-1', ' Daily ', true),
        (2, 2, 'importer-2', 'weekly', true), (3, 3, 'importer-3', 'manual', true), (4, 4, 'importer-4', 'twice-daily', true),
        (5, 5, 'importer-5', NULL, false)) t(crawl_source_id, source_id, importer_key, cadence_label, is_active)""",
    "v_metadata": _metadata_sql(),
    "v_doc": """SELECT release_id, CASE WHEN json_valid(metadata) THEN CAST(metadata AS JSON) END AS doc FROM v_metadata""",
    "v_stored": f"""SELECT *, (s_overview <> '' AND s_sentiment IS NOT NULL AND s_confidence IS NOT NULL
          AND s_generated_at IS NOT NULL AND s_provider IS NOT NULL) IS TRUE AS is_valid FROM (
        SELECT release_id, doc, {trim_ws(f"coalesce({jstr(_S + '.overview')}, '')")} AS s_overview,
        {jenum(_S + '.overallSentiment', lx.SENTIMENTS)} AS s_sentiment, {jenum(_S + '.confidence', lx.CONFIDENCES)} AS s_confidence,
        {jenum(_S + '.editorialSentiment', lx.SENTIMENTS)} AS s_editorial, {jenum(_S + '.communitySentiment', lx.SENTIMENTS)} AS s_community,
        coalesce({jenum(_S + '.sourceAlignment', lx.ALIGNMENTS)}, 'mixed') AS s_alignment, {jstr(_S + '.buyerSignal')} AS s_buyer,
        {jlist(_S + '.pros', 4)} AS s_pros, {jlist(_S + '.cons', 4)} AS s_cons, {jlist(_S + '.bestFor', 4)} AS s_best_for,
        {jlist(_S + '.watchOuts', 4)} AS s_watch_outs, {jlist(_S + '.consensusPoints', 4)} AS s_consensus, {jlist(_S + '.debates', 4)} AS s_debates,
        {jnum(_S + '.reviewCount')} AS s_review_count, {jnum(_S + '.sourceCount')} AS s_source_count,
        {jstr(_S + '.generatedAt')} AS s_generated_at, {jenum(_S + '.provider', lx.SUMMARY_PROVIDERS)} AS s_provider,
        (CASE WHEN json_type(doc, '{_S}.evidence') = 'ARRAY' THEN len(list_filter(json_extract(doc, '{_S}.evidence[*]'), lambda e:
          json_type(e, '$.sourceName') = 'VARCHAR' AND json_extract_string(e, '$.sourceName') <> ''
          AND json_extract_string(e, '$.sourceType') IN ('editorial', 'reddit', 'user')
          AND json_type(e, '$.excerpt') = 'VARCHAR' AND trim(json_extract_string(e, '$.excerpt')) <> '')[1:6]) ELSE 0 END) AS s_evidence,
        coalesce(json_extract_string(doc, '{_O}.isEnabled') = 'true', false) AS o_enabled, {jstr(_O + '.overview')} AS o_overview,
        {jenum(_O + '.overallSentiment', lx.SENTIMENTS)} AS o_sentiment, {jenum(_O + '.confidence', lx.CONFIDENCES)} AS o_confidence,
        {jlist(_O + '.pros', 4)} AS o_pros, {jlist(_O + '.cons', 4)} AS o_cons, {jstr(_O + '.updatedAt')} AS o_updated_at,
        {jstr(_N + '.summaryNote')} AS n_note, {jlist(_N + '.pinnedTakeaways', 5)} AS n_pinned, {jlist(_N + '.ignoredThemes', 8)} AS n_ignored
        FROM v_doc)""",
    "v_summary": """SELECT release_id, is_valid AS has_summary,
        CASE WHEN is_valid THEN CASE WHEN o_enabled THEN coalesce(o_overview, s_overview) ELSE s_overview END END AS overview,
        CASE WHEN is_valid THEN CASE WHEN o_enabled THEN coalesce(o_sentiment, s_sentiment) ELSE s_sentiment END END AS overall_sentiment,
        CASE WHEN is_valid THEN CASE WHEN o_enabled THEN coalesce(o_confidence, s_confidence) ELSE s_confidence END END AS confidence,
        CASE WHEN is_valid THEN s_editorial END AS editorial_sentiment, CASE WHEN is_valid THEN s_community END AS community_sentiment,
        CASE WHEN is_valid THEN s_alignment END AS source_alignment, CASE WHEN is_valid THEN s_buyer END AS buyer_signal,
        CASE WHEN is_valid THEN CASE WHEN o_enabled AND len(o_pros) > 0 THEN o_pros ELSE s_pros END END AS pros,
        CASE WHEN is_valid THEN CASE WHEN o_enabled AND len(o_cons) > 0 THEN o_cons ELSE s_cons END END AS cons,
        CASE WHEN is_valid THEN s_best_for END AS best_for, CASE WHEN is_valid THEN s_watch_outs END AS watch_outs,
        CASE WHEN is_valid THEN s_consensus END AS consensus_points, CASE WHEN is_valid THEN s_debates END AS debates,
        CASE WHEN is_valid THEN s_review_count END AS review_count, CASE WHEN is_valid THEN s_source_count END AS source_count,
        CASE WHEN is_valid THEN s_generated_at END AS generated_at, CASE WHEN is_valid THEN s_provider END AS provider,
        CASE WHEN is_valid THEN s_evidence END AS evidence_count, CASE WHEN is_valid THEN o_enabled END AS is_override,
        n_note AS summary_note, n_pinned AS pinned_takeaways, n_ignored AS ignored_themes FROM v_stored""",
    "v_stats": """SELECT release_id, count(*) AS review_count, avg(score) AS average_score FROM v_review WHERE status = 'approved' GROUP BY release_id""",
}


def with_views(sql: str) -> str:
    """Prefix a query with the fixture views it names, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
