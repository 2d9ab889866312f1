"""Query of the vector codes over `embeddings`, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plover.llm.vector_codes import Coding, vector_codes
from plover.session import table


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _sql(how: Coding) -> str:
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))"
    steps = []
    for r in range(how.rounds + 1):
        steps.append(f"""
met{r} AS MATERIALIZED (SELECT vec_id, part, min({{'d': {distance}, 'e': entry}}) AS m, any_value(x) AS x FROM parts JOIN book{r} USING (part) GROUP BY vec_id, part),
sums{r} AS (SELECT part, m.e AS entry, k, sum(x[k]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM met{r}) GROUP BY part, entry, k),
means{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS c FROM sums{r} GROUP BY part, entry),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m ON b.part = m.part AND b.entry = m.entry),""")
    last = how.rounds
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({how.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // {how.parts} + 1 : (p + 1) * len(v) // {how.parts}] AS x FROM kept, range({how.parts}) AS t(p)),
book0 AS (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts
    QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {how.entries}),
{"".join(steps)}
codes AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM met{last} GROUP BY vec_id),
hashed AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, k)) AS h FROM (SELECT part, entry, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS k FROM book{last}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN kept USING (vec_id), hashed
"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _sql(Coding())}
