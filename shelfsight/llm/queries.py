"""The queries of the training-data operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import alignment, bpe, exact_dedup, mixing, preference, quality, secrets, simhash, token_counts, toxicity, urls, vectors, whitening
from shelfsight.llm.common import read_table
from shelfsight.session import ensure_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return plan(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return plan

    return register


@query("op3_exact_dedup", """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content FROM documents
), g AS (
  SELECT doc_id, content, sha256(content) AS text_sha256, count(*) OVER (PARTITION BY content) AS group_size,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = exact_dedup.deduplicate(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op4_mix_sources", """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), p AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM c
), t AS (
  SELECT source, source_size, least(cap, w * max(CASE WHEN cap / w >= lvl THEN lvl END) OVER ()) AS target FROM p
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), o AS (
  SELECT d.*, r.source_size, r.target, r.passes, r.target - r.passes * r.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (passes + CASE WHEN rest > 0 AND (before + size <= rest OR (before <= rest AND (rest - before) * 2 >= size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), urls.RULES)


@query("op5_preference_format", """
WITH t AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(pos) FILTER (role = 'assistant') AS at, arg_max(text, pos) FILTER (role = 'assistant') AS reply FROM t GROUP BY conv_id
), pair AS (
  SELECT a.conv_id, a.at, coalesce(b.reply, '') AS other FROM last a LEFT JOIN last b ON b.conv_id = a.conv_id + 1 WHERE a.at IS NOT NULL
), both_sides AS (
  SELECT t.conv_id, t.pos, t.role, t.text AS c, CASE WHEN t.pos = p.at THEN p.other ELSE t.text END AS r FROM t JOIN pair p USING (conv_id)
), cut AS (
  SELECT conv_id, coalesce(min(pos) FILTER (c <> r), max(pos) + 1) AS shared FROM both_sides GROUP BY conv_id
), rendered AS (
  SELECT conv_id, pos, shared, role, '<|im_start|>' || role || chr(10) AS head,
         replace(replace(c, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS cb,
         replace(replace(r, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS rb
  FROM both_sides JOIN cut USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(cb)) OVER w, 0) AS cs, coalesce(sum(length(head) + length(rb)) OVER w, 0) AS rs
  FROM rendered WINDOW w AS (PARTITION BY conv_id, pos >= shared ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id AS pair_id, 0::BIGINT AS chunk, any_value(shared)::BIGINT AS shared_turns,
       coalesce(string_agg(head || cb, '' ORDER BY pos) FILTER (pos < shared), '') AS prompt,
       coalesce(string_agg(head || cb, '' ORDER BY pos) FILTER (pos >= shared), '') AS chosen,
       coalesce(string_agg(head || rb, '' ORDER BY pos) FILTER (pos >= shared), '') AS rejected,
       coalesce(string_agg((cs + length(head))::BIGINT || ':' || (cs + length(head) + length(cb))::BIGINT, ',' ORDER BY pos) FILTER (pos >= shared AND role = 'assistant'), '') AS chosen_loss,
       coalesce(string_agg((rs + length(head))::BIGINT || ':' || (rs + length(head) + length(rb))::BIGINT, ',' ORDER BY pos) FILTER (pos >= shared AND role = 'assistant'), '') AS rejected_loss
FROM placed GROUP BY conv_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each conversation that has a reply: as it is, and with its last reply exchanged for that of the next conversation."""
    turns = read_table(spark, sf_dir, "conversations")
    chosen, rejected = preference.exchanged_replies(turns)
    rows = preference.format_pairs(chosen, rejected)
    spans = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(name)
    return rows.select("pair_id", "chunk", "shared_turns", "prompt", "chosen", "rejected", spans("chosen_loss"), spans("rejected_loss"))


@query("op10_embedding_near_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT a AS origin, a AS node FROM links UNION SELECT r.origin, l.b FROM reach r JOIN links l ON l.a = r.node
), comp AS (
  SELECT origin, min(node) AS component_id FROM reach GROUP BY origin
), deg AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN comp ON origin = vec_id LEFT JOIN deg ON a = vec_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def secret_sql() -> str:
    """Matches and what lies between them give the offsets; a rule's matches come from its expression, longer ones only."""
    kinds = []
    for k, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(f"""
  SELECT r, {k} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS f, regexp_extract_all(t, '{pattern}', {rule.group}) AS m,
         string_split_regex(t, '{pattern}') AS g, {rule.least} AS least FROM d WHERE regexp_matches(t, '{pattern}')""")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), found AS ({" UNION ALL ".join(kinds)}
), one AS (
  SELECT r, k, kind, m[i] AS measured, least, length(f[i]) AS width,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM found)
), kept AS (
  SELECT r, k, start, kind || ':' || start::BIGINT || ':' || (start + width)::BIGINT AS span FROM one WHERE length(measured) >= least
), by_row AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_row USING (r)
"""


@query("op13_secret_scan", secret_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.find(read_table(spark, sf_dir, "documents")))
