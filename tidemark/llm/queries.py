"""Queries opN_<name> and pipeline, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import format_chat
from .decontaminate import score_contamination
from .html_extract import extract_main_text
from .near_dedup import near_dedup
from .quality_classifier import score_quality
from .quality_rules import quality_rules
from .sentencepiece_scan import encode
from .shared import table
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_bins import token_digest

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).drop("ids")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_bins": op6_token_bins,
    "op7_html_extract": op7_html_extract,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}

_WORDS8 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM doc WHERE len(w) >= 20)),
     later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
     lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
     kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM doc) a
              WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.p) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM doc LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op3_chat_format": r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, md5(coalesce(text, '')) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
x AS (SELECT DISTINCT conv_id, turn, id, l, pos FROM (SELECT conv_id, turn, id, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM m)),
y AS (SELECT conv_id, turn, id, pos, length(regexp_extract(l, '^[ \t]*>(?:[ \t]*>)*[ \t]?')) - length(replace(regexp_extract(l, '^[ \t]*>(?:[ \t]*>)*[ \t]?'), '>', '')) AS level, regexp_replace(l, '^[ \t]*>(?:[ \t]*>)*[ \t]?', '') AS body FROM x),
z AS (SELECT *, level = 0 AND NOT (coalesce(lead(level) OVER (PARTITION BY conv_id, turn, id ORDER BY pos), 0) > 0 AND regexp_matches(body, '(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$')) AS own,
             md5(lower(trim(regexp_replace(body, '\s+', ' ', 'g')))) AS h, trim(regexp_replace(body, '\s+', ' ', 'g')) <> '' AS said FROM y),
own_text AS (SELECT conv_id, turn, id, bool_and(own) AS plain, regexp_replace(regexp_replace(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE own), '\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM z GROUP BY conv_id, turn, id),
q AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, id, level ORDER BY pos) AS island FROM z WHERE level > 0 AND said AND conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT DISTINCT conv_id, turn, h FROM z WHERE own AND said AND conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT h, min((conv_id, turn)) AS first FROM o GROUP BY h),
hit AS (SELECT q.conv_id, q.turn, q.id, q.level, q.island, (SELECT max(o.turn) FROM o WHERE o.conv_id = q.conv_id AND o.h = q.h AND o.turn < q.turn) AS here, f.first FROM q LEFT JOIN f ON f.h = q.h),
vote AS (SELECT conv_id, turn, id, level, island, CASE WHEN here IS NOT NULL THEN conv_id WHEN first[1] <> conv_id THEN first[1] END AS to_conv, CASE WHEN here IS NOT NULL THEN here WHEN first[1] <> conv_id THEN first[2] END AS to_turn, count(*) AS n FROM hit GROUP BY ALL),
passage AS (SELECT conv_id, turn, id, level, island, sum(n) AS lines, max((n, to_conv = conv_id, to_turn, to_conv)) FILTER (WHERE to_turn IS NOT NULL) AS b FROM vote GROUP BY ALL),
counts AS (SELECT conv_id, turn, id, sum(lines) AS n_quoted, sum(coalesce(b[1], 0)) AS n_linked FROM passage GROUP BY ALL),
best AS (SELECT conv_id, turn, id, max((n, to_conv = conv_id, to_turn, to_conv)) AS b FROM (SELECT conv_id, turn, id, b[4] AS to_conv, b[3] AS to_turn, sum(b[1]) AS n FROM passage WHERE level = 1 AND b IS NOT NULL GROUP BY ALL) GROUP BY ALL),
parent AS (SELECT conv_id, turn, min((b[4], b[3])) AS p FROM best GROUP BY ALL),
chain AS (SELECT conv_id, turn, p, 1 AS d, CAST(p[1] <> conv_id AS BIGINT) AS hops FROM parent UNION ALL SELECT c.conv_id, c.turn, n.p, c.d + 1, c.hops + CAST(n.p[1] <> c.p[1] AS BIGINT) FROM chain c JOIN parent n ON n.conv_id = c.p[1] AND n.turn = c.p[2] WHERE c.d < 1000),
root AS (SELECT conv_id, turn, arg_max(p, d) AS r, arg_max(hops, d) AS hops FROM chain GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, CASE WHEN plain THEN m.text ELSE t END AS text, CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
       b[4] AS parent_conv, b[3] AS parent_turn, coalesce(r[1], m.conv_id) AS root_conv, coalesce(r[2], m.turn) AS root_turn, coalesce(root.hops, 0) AS hops,
       rank() OVER (ORDER BY coalesce(r[1], m.conv_id) NULLS FIRST, coalesce(r[2], m.turn) NULLS FIRST, coalesce(root.hops, 0), m.turn NULLS FIRST, m.conv_id NULLS FIRST) - 1 AS position,
       '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || coalesce(CASE WHEN plain THEN m.text ELSE t END, '') || '<|end|>' || chr(10) AS formatted
FROM m LEFT JOIN own_text USING (conv_id, turn, id) LEFT JOIN counts USING (conv_id, turn, id) LEFT JOIN best USING (conv_id, turn, id) LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
""",
    "op8_decontamination": rf"""
WITH item AS (SELECT item_id, {_WORDS8} AS w FROM benchmark WHERE text IS NOT NULL),
     win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i + 1, i + least(13, len(w))), ' ') AS t
             FROM (SELECT item_id, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
     doc AS (SELECT doc_id, coalesce({_WORDS8}, []) AS w FROM documents),
     seen AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS t
              FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
     hit AS (SELECT seen.doc_id, seen.i, seen.n, win.item_id FROM seen JOIN win ON seen.n = win.n AND seen.t = win.t),
     spot AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
     ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
             FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN spot USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
}
