"""Oracle SQL of the mixing query."""

from kvitok.llm.mixing import RATE_STEP, SEED


def mixing_sql(docs: str = "documents", columns: str = "d.*") -> str:
    """Rows of ``mix_sources`` without weights over the view ``docs``."""
    return f"""
WITH n AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / n::DOUBLE) AS rate FROM n),
p AS (SELECT source, rate, greatest(1, ceil(rate / {RATE_STEP}))::BIGINT AS parts FROM r),
t AS (SELECT source, parts, unnest(generate_series(0, 200)) AS k, rate / parts AS rate FROM p),
c AS (SELECT source, parts, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM t),
e AS (SELECT source, parts, unnest(generate_series(0, parts - 1)) AS part FROM p),
u AS (
    SELECT d.doc_id, e.source, e.part, e.parts,
        ('0x' || substr(md5('{SEED}:' || coalesce(e.source, 'None') || CASE WHEN part = 0 THEN '' ELSE '.' || part END || ':' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / (1::BIGINT << 48) AS u
    FROM {docs} d JOIN e ON d.source IS NOT DISTINCT FROM e.source
),
counts AS (SELECT u.doc_id, u.source, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.below <= u.u) AS n FROM u),
total AS (SELECT doc_id, source, sum(n)::BIGINT AS n FROM counts GROUP BY doc_id, source)
SELECT {columns}, unnest(generate_series(0, t.n - 1)) AS copy
FROM {docs} d JOIN total t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.source IS NOT DISTINCT FROM t.source
"""


OP8_SQL = mixing_sql()
