"""Query of the source divergence audit over `documents`, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plover.llm.divergence import source_divergence
from plover.session import table


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
    FROM documents),
used AS MATERIALIZED (SELECT row_no, lang, source, unnest(found) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM used GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
every AS (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM used JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
p AS MATERIALIZED (
    SELECT e.lang, e.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * s.v) AS p
    FROM every e JOIN kept k USING (lang) JOIN sizes s USING (lang)
    LEFT JOIN totals t ON t.lang = e.lang AND t.source = e.source LEFT JOIN counts c ON c.lang = e.lang AND c.source = e.source AND c.term = k.term),
whole AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY lang, term),
q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (whole.c + 2)) // (n + 2 * v) AS q
    FROM whole JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
summed AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
    FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM best QUALIFY rank <= 10
"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {"op12_source_divergence": SQL}
