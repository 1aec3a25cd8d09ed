"""Eligibility, stratified splits, negatives and their counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import graph, splits
from termloom.operators.hashrank import with_hash_rank
from termloom.plans.graph_queries import DEAD, EDGES, KEYS, NODES
from termloom.session import materialize, table


def _t(s, d):
    return table(s, d, "xrefs"), table(s, d, "corpus"), table(s, d, "seq_meta")


def _eligible(s, d):
    return splits.eligible_pairs(*_t(s, d))


def _built(s, d):
    return splits.build_splits(*_t(s, d), fewer=True)  # the smallest test data have too few free pairs


def _manifest(s, d):
    """(section, item, value) of the manifest of the built splits."""
    m = splits.manifest(materialize(_built(s, d), "built"), splits.funnel(*_t(s, d)))
    rows = [("run", k, str(v)) for k, v in m.items() if not isinstance(v, (dict, list)) and v is not None]
    rows += [("funnel", k, str(v)) for k, v in m["funnel"].items()]
    rows += [("count", f"{r['split']}/{r['stratum']}/{r['label']}", str(r["n"])) for r in m["counts"]]
    rows += [(f"content of {k}", i, str(x)) for k, v in m["content"].items() for i, x in v.items()]
    return s.createDataFrame(rows, "section string, item string, value string")


def _negatives(s, d):
    xrefs, corpus, meta = _t(s, d)
    known = materialize(graph.pair_table(xrefs), "known")
    n = splits.NEGATIVES * splits.eligible_pairs(xrefs, corpus, meta, known).count()
    return splits.draw_negatives(n, splits.living_nodes(corpus, meta), known, fewer=True).select("u", "v")


def _train_sample(s, d):
    """200 distinct positive training pairs of the stored splits by seeded hash, in the order of their ids."""
    pos = (
        table(s, d, "splits")
        .filter("split = 'train' and label = 1 and u is not null and v is not null")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    return with_hash_rank(pos.withColumn("g", F.lit(0)), "g", ["u", "v"], 42).filter("rn <= 200").select("u", "v")


QUERIES = {
    "eligible_pairs": _eligible,
    "headline_pairs": lambda s, d: splits.headline_pairs(_eligible(s, d), table(s, d, "corpus")),
    "split_funnel": lambda s, d: splits.funnel(*_t(s, d)),
    "split_draw": lambda s, d: splits.draw_splits(_eligible(s, d)),
    "negatives": _negatives,
    "split_build": _built,
    "split_build_counts": lambda s, d: _built(s, d).groupBy("split", "stratum", "label").agg(F.count("*").alias("n")),
    "split_content_hash": lambda s, d: splits.content_hash(materialize(_built(s, d), "built"), ["split"]),
    "split_manifest": _manifest,
    "stored_split_counts": lambda s, d: table(s, d, "splits")
    .cube("split", "stratum", "label")
    .agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")),
    "train_sample": _train_sample,
}

ELIGIBLE = f"""
 {EDGES}, {KEYS}, {DEAD},
 sizes AS (SELECT a_number AS id, max(len(terms)) AS n FROM corpus WHERE len(terms) > 0 GROUP BY 1),
 flagged AS (SELECT u, v, r, CASE r WHEN 0 THEN 's1' WHEN 1 THEN 's2' WHEN 2 THEN 's4' WHEN 3 THEN 's3' END AS stratum, a.n IS NOT NULL AND b.n IS NOT NULL AS in_terms,
   u IN (SELECT id FROM dead) OR v IN (SELECT id FROM dead) AS dead, CAST(coalesce(least(a.n, b.n) < 8, false) AS INT) AS lt8_any
   FROM und LEFT JOIN sizes a ON a.id = u LEFT JOIN sizes b ON b.id = v),
 elig AS (SELECT u, v, stratum, lt8_any FROM flagged WHERE in_terms AND NOT dead AND stratum IS NOT NULL)
"""
DRAWN = f"""
 {ELIGIBLE},
 ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || u || '|' || v), u, v) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM elig),
 drawn AS (SELECT u, v, stratum, lt8_any, CASE WHEN rn <= n * 10 // 100 THEN 'test' WHEN rn <= n * 10 // 100 + n * 9 // 100 THEN 'val' ELSE 'train' END AS split FROM ranked)
"""
# the first round of attempts suffices on the test data
NEG = f"""
 {DRAWN}, {NODES},
 idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nodes WHERE id NOT IN (SELECT id FROM dead)),
 att AS (SELECT unnest(range(greatest(1024, 10 * (SELECT count(*) FROM elig)))) AS k),
 ends AS (SELECT CAST('0x' || substr(md5('42|u|' || k), 1, 15) AS BIGINT) % (SELECT count(*) FROM idx) AS iu, CAST('0x' || substr(md5('42|v|' || k), 1, 15) AS BIGINT) % (SELECT count(*) FROM idx) AS iv FROM att),
 cand AS (SELECT DISTINCT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v FROM ends JOIN idx a ON a.i = iu JOIN idx b ON b.i = iv WHERE abs(a.id - b.id) > 20),
 free AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM und WHERE und.u = cand.u AND und.v = cand.v)),
 neg AS (SELECT u, v, row_number() OVER (ORDER BY md5('42|' || u || '|' || v), u, v) AS rn FROM free QUALIFY rn <= 5 * (SELECT count(*) FROM elig)),
 built AS (SELECT u, v, stratum, 1 AS label, lt8_any, split FROM drawn
   UNION ALL SELECT u, v, 'neg', 0, 0, CASE WHEN rn <= 5 * (SELECT count(*) FROM drawn WHERE split = 'train') THEN 'train' WHEN rn <= 5 * (SELECT count(*) FROM drawn WHERE split <> 'test') THEN 'val' ELSE 'test' END FROM neg)
"""

HASH = """
 text AS (SELECT split, concat_ws('|', coalesce(CAST(label AS VARCHAR), '~'), coalesce(CAST(lt8_any AS VARCHAR), '~'), coalesce(stratum, '~'), coalesce(CAST(u AS VARCHAR), '~'), coalesce(CAST(v AS VARCHAR), '~')) AS t FROM built),
 hashed AS (SELECT split, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS HUGEINT)) % 9223372036854775808 AS BIGINT) AS hash FROM text GROUP BY split)
"""
FUNNEL = {
    "pairs": "(SELECT count(*) FROM flagged)",
    "not_in_terms": "(SELECT count(*) FROM flagged WHERE NOT in_terms)",
    "touching_dead": "(SELECT count(*) FROM flagged WHERE in_terms AND dead)",
    "unlabelled": "(SELECT count(*) FROM flagged WHERE in_terms AND NOT dead AND stratum IS NULL)",
    "eligible": "(SELECT count(*) FROM elig)",
    "short": "(SELECT count(*) FROM elig WHERE lt8_any = 1)",
    "nodes": "(SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM dead))",
}

SQL = {
    "headline_pairs": f"WITH {ELIGIBLE}, h AS (SELECT a_number FROM corpus WHERE contains(lower(name), 'allocated')) SELECT u, v, stratum FROM elig WHERE stratum IN ('s1', 's2') AND lt8_any = 0 AND u NOT IN (SELECT a_number FROM h) AND v NOT IN (SELECT a_number FROM h)",
    "eligible_pairs": f"WITH {ELIGIBLE} SELECT * FROM elig",
    "split_funnel": f"""
WITH {ELIGIBLE}, {NODES}
SELECT count(*) AS pairs, count(*) FILTER (NOT in_terms) AS not_in_terms, count(*) FILTER (in_terms AND dead) AS touching_dead, count(*) FILTER (in_terms AND NOT dead AND stratum IS NULL) AS unlabelled,
 (SELECT count(*) FROM elig) AS eligible, (SELECT count(*) FROM elig WHERE lt8_any = 1) AS short, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM dead)) AS nodes FROM flagged
""",
    "split_draw": f"WITH {DRAWN} SELECT * FROM drawn",
    "negatives": f"WITH {NEG} SELECT u, v FROM neg",
    "split_build": f"WITH {NEG} SELECT * FROM built",
    "split_build_counts": f"WITH {NEG} SELECT split, stratum, label, count(*) AS n FROM built GROUP BY ALL",
    "split_content_hash": f"WITH {NEG}, {HASH} SELECT * FROM hashed",
    "split_manifest": f"""
WITH {NEG}, {HASH}
SELECT 'run' AS section, x[1] AS item, x[2] AS value FROM (SELECT UNNEST([['seed', '42'], ['test_share', '0.10'], ['val_share', '0.09'], ['negatives_per_positive', '5'], ['min_gap', '20']]) AS x)
UNION ALL SELECT 'count', split || '/' || stratum || '/' || label, CAST(count(*) AS VARCHAR) FROM built GROUP BY split, stratum, label
UNION ALL SELECT 'content of ' || split, 'rows', CAST(rows AS VARCHAR) FROM hashed
UNION ALL SELECT 'content of ' || split, 'hash', CAST(hash AS VARCHAR) FROM hashed
UNION ALL {' UNION ALL '.join(f"SELECT 'funnel', '{k}', CAST({v} AS VARCHAR)" for k, v in FUNNEL.items())}
""",
    "stored_split_counts": "SELECT split, stratum, label, count(*) AS n, CAST(grouping_id(split, stratum, label) AS INT) AS level FROM splits GROUP BY CUBE (split, stratum, label)",
    "train_sample": "WITH p AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM splits WHERE split = 'train' AND label = 1 AND u IS NOT NULL AND v IS NOT NULL) SELECT u, v FROM p QUALIFY row_number() OVER (ORDER BY md5('42|' || u || '|' || v), u, v) <= 200",
}
