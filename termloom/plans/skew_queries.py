"""Problem 1: per-key results when a few keys hold most rows."""

from __future__ import annotations

from termloom.operators.skewed import heavy_keys, key_profile
from termloom.session import table

QUERIES = {
    "p1_found": lambda spark, d: heavy_keys(table(spark, d, "xrefs")),
    "p1_key_profile": lambda spark, d: key_profile(table(spark, d, "xrefs")),
}

_SIDES = """
 sides AS (SELECT 'source' AS side, source AS k, target AS o, lower(trim(stratum)) AS st FROM xrefs
           UNION ALL SELECT 'target', target, source, lower(trim(stratum)) FROM xrefs)
"""

SQL = {
    "p1_found": f"""
WITH {_SIDES}
SELECT side, CAST(k AS BIGINT) AS a_number FROM sides WHERE k IS NOT NULL
GROUP BY side, k HAVING count(*) * 100 >= (SELECT count(*) FROM xrefs)
""",
    "p1_key_profile": f"""
WITH {_SIDES}
SELECT side, CAST(k AS BIGINT) AS a_number, count(*) AS mentions, count(DISTINCT o) AS partners,
 count(*) FILTER (st = 's1') AS s1, count(*) FILTER (st = 's2') AS s2, count(*) FILTER (st = 's3') AS s3, count(*) FILTER (st = 's4') AS s4,
 count(*) FILTER (st IS NULL OR st NOT IN ('s1', 's2', 's3', 's4')) AS other
FROM sides WHERE k IS NOT NULL GROUP BY side, k
""",
}
