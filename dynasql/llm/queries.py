"""Named queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_packing import op1_packing, packing_conversations
from .op02_revisits import op2_revisits
from .op03_lm_score import op3_lm_score
from .op04_toxicity import op4_toxicity
from .op05_secrets import op5_secrets
from .op06_lines import op6_lines
from .op07_mixing import op7_mixing
from .op08_ann import op8_ann
from .op09_simhash import op9_simhash
from .op10_quality import op10_quality, quality_ablation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_revisits": op2_revisits,
    "op3_lm_score": op3_lm_score,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_lines": op6_lines,
    "op7_mixing": op7_mixing,
    "op8_ann": op8_ann,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "packing_conversations": packing_conversations,
    "quality_ablation": quality_ablation,
}

ORACLES: dict[str, str] = {
    "op10_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1),
marked AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(marked.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN marked USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
               + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
               + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
               + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
               + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END
               + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 32 ELSE 0 END)::INTEGER AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
""",
    "op2_revisits": r"""
WITH caps AS (
  SELECT 2 * page_id AS record_id, url, page_id % 97 AS ts, 0 AS late, substr(md5(coalesce(html, '')), 1, 16) AS etag,
         md5(coalesce(html, '')) AS digest, page_id FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, url, 40 + page_id % 61, 1,
         CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'other'
              ELSE substr(md5(coalesce(html, '')), 1, 16) END,
         CASE WHEN page_id % 11 <> 0 THEN md5(coalesce(html, '')) END, page_id FROM pages),
parts AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM caps),
cut AS (SELECT *,
    regexp_replace(lower(regexp_extract(bare, '^(?:[A-Za-z]+://)?([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(bare, '^(?:[A-Za-z]+://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS query FROM parts),
rec AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url FROM cut),
seen AS (SELECT *, last_value(CASE WHEN late = 0 THEN {'id': record_id, 'etag': etag, 'digest': digest} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, late, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM rec),
said AS (SELECT *, CASE WHEN canonical_url IS NULL THEN 'no_url' WHEN r IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN etag = r.etag THEN 'resolved' ELSE 'changed' END
    WHEN digest IS NOT NULL THEN CASE WHEN digest = r.digest THEN 'resolved' ELSE 'changed' END
    ELSE 'no_validator' END AS reason FROM seen WHERE late = 1)
SELECT record_id, canonical_url, CASE WHEN reason = 'resolved' THEN r.id END AS response_id, reason,
       CASE WHEN reason = 'resolved' THEN 'age=' || page_id || ';content-type=text/html;etag=' || r.etag END AS headers FROM said
""",
}
