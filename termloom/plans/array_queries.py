"""Features of sequences and of pairs of sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import arrays
from termloom.operators import retrieval
from termloom.plans.graph_queries import TERMS
from termloom.plans.split_queries import _train_sample
from termloom.session import materialize, spread, table

NAMES = arrays.feature_names()


def _seqs(s, d):
    return retrieval.sequences(table(s, d, "corpus"))


def _features(s, d):
    f = arrays.sequence_features()
    rows = spread(_seqs(s, d)).select(F.col("id").alias("a_number"), f(F.col("seq")).alias("f"))
    return rows.select("a_number", *((F.round(F.get("f", F.lit(i)), 5) + 0.0).alias(n) for i, n in enumerate(NAMES)))


def _with_terms(s, d, pairs):
    seqs = spread(_seqs(s, d))  # Spark may broadcast the pairs and stream the sequences
    for c in ("u", "v"):
        pairs = pairs.join(seqs.select(F.col("id").alias(c), F.col("seq").alias("s" + c)), c)
    return pairs


def _distinct(rows, *cols):
    """Distinct rows in a partition for each core: what follows is heavier by row than the rows are by size."""
    conf = rows.sparkSession
    n = max(conf.sparkContext.defaultParallelism, int(conf.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(*cols).repartition(n, "u", "v").distinct()


def _positives(s, d):
    """The distinct labelled pairs of the stored splits that are positive, with their terms."""
    return _with_terms(
        s, d, _distinct(table(s, d, "splits").filter("label = 1 and u is not null and v is not null"), "u", "v")
    )


def _all_pairs(s, d):
    """The distinct pairs of the stored splits, of any label, with their terms."""
    return _with_terms(s, d, _distinct(table(s, d, "splits").filter("u is not null and v is not null"), "u", "v"))


def _all_features(s, d):
    """All four features of every distinct pair, negatives included."""
    return (
        _all_pairs(s, d)
        .select("u", "v", arrays.pair_features(F.col("su"), F.col("sv")).alias("f"))
        .select(
            "u",
            "v",
            *(
                F.round(f"f.{c}", 9).alias(c)
                for c in ("term_set_jaccard", "ngram3_jaccard", "exact_subseq", "affine_match")
            )
        )
    )


def _smoke(s, d):
    pairs = _with_terms(s, d, _train_sample(s, d)).select(
        arrays.pair_features(F.col("su"), F.col("sv")).alias("f")
    ).select("f.*")
    return pairs.agg(
        F.count("*").alias("pairs"),
        *(F.round(F.avg(c), 4).alias(c) for c in ("term_set_jaccard", "ngram3_jaccard", "exact_subseq", "affine_match"))
    )


def _smoke_strata(s, d):
    train = table(s, d, "splits").filter("split = 'train' and label = 1 and u is not null and v is not null")
    rows = _distinct(train, "u", "v", F.lower(F.trim("stratum")).alias("stratum"))
    rows = _with_terms(s, d, rows).select(
        "stratum",
        arrays.jaccard(F.col("su"), F.col("sv")).alias("j"),
        arrays.ngram_jaccard(F.col("su"), F.col("sv")).alias("g"),
        arrays.subsequence_match(F.col("su"), F.col("sv")).cast("double").alias("e")
    )
    return rows.rollup("stratum").agg(
        F.count("*").alias("pairs"),
        F.round(F.avg("j"), 6).alias("term_set_jaccard"),
        F.round(F.avg("g"), 6).alias("ngram3_jaccard"),
        F.round(F.avg("e"), 6).alias("exact_subseq"),
        F.grouping("stratum").cast("int").alias("total")
    )


def _smoke_affine(s, d):
    """The mean affine match of each stratum over all training positives, and over all of them (total = 1)."""
    train = table(s, d, "splits").filter("split = 'train' and label = 1 and u is not null and v is not null")
    rows = _distinct(train, "u", "v", F.lower(F.trim("stratum")).alias("stratum"))
    rows = _with_terms(s, d, rows).select(
        "stratum", arrays.pair_features(F.col("su"), F.col("sv")).alias("f")
    ).select("stratum", "f.affine_match")
    return rows.rollup("stratum").agg(
        F.count("*").alias("pairs"),
        F.round(F.avg("affine_match"), 6).alias("affine_match"),
        F.grouping("stratum").cast("int").alias("total")
    )


QUERIES = {
    "seq_features": _features,
    "set_jaccard": lambda s, d: _positives(s, d).select(
        "u", "v", F.round(arrays.jaccard(F.col("su"), F.col("sv")), 9).alias("jaccard")
    ),
    "ngram_jaccard": lambda s, d: _positives(s, d).select(
        "u", "v", F.round(arrays.ngram_jaccard(F.col("su"), F.col("sv")), 9).alias("jaccard")
    ),
    "exact_subseq": lambda s, d: _positives(s, d).select(
        "u", "v", arrays.subsequence_match(F.col("su"), F.col("sv")).alias("hit")
    ),
    "affine_pairs": lambda s, d: _all_pairs(s, d)
    .select("u", "v", arrays.affine_match(F.col("su"), F.col("sv")).alias("m"))
    .select("u", "v", "m.*")
    .filter("s is not null"),
    "pair_features": _all_features,
    "smoke_aggregates": _smoke,
    "smoke_by_stratum": _smoke_strata,
    "smoke_affine_by_stratum": _smoke_affine,
    "pair_score_auc": lambda s, d: retrieval.boosted_trees_report(
        materialize(retrieval.scored_pairs(table(s, d, "splits"), table(s, d, "corpus")), "scored")
    ),
}

_USED = f"""
 {TERMS},
 num AS (SELECT id, i, CAST(t AS HUGEINT) AS x, CAST(t AS DOUBLE) AS f FROM term WHERE i < 32),
 size AS (SELECT id, count(*) AS total FROM term GROUP BY id),
 nxt AS (SELECT id, i, x, f, sign(f) * ln(1 + abs(f)) AS sl, lead(x) OVER w AS y, lead(f) OVER w AS g FROM num WINDOW w AS (PARTITION BY id ORDER BY i)),
 d1 AS (SELECT id, i, CAST(y - x AS HUGEINT) AS d FROM nxt WHERE y IS NOT NULL),
 d2 AS (SELECT id, CAST(e - d AS HUGEINT) AS d FROM (SELECT id, d, lead(d) OVER (PARTITION BY id ORDER BY i) AS e FROM d1) WHERE e IS NOT NULL),
 a1 AS (SELECT id, avg(sign(d) * ln(1 + abs(CAST(d AS DOUBLE)))) AS m, stddev_pop(sign(d) * ln(1 + abs(CAST(d AS DOUBLE)))) AS s FROM d1 GROUP BY id),
 a2 AS (SELECT id, avg(sign(d) * ln(1 + abs(CAST(d AS DOUBLE)))) AS m, stddev_pop(sign(d) * ln(1 + abs(CAST(d AS DOUBLE)))) AS s FROM d2 GROUP BY id),
 gr AS (SELECT id, regr_slope(ln(abs(f)), i) AS b, regr_intercept(ln(abs(f)), i) AS c, sqrt(greatest(regr_syy(ln(abs(f)), i) - regr_slope(ln(abs(f)), i) * regr_sxy(ln(abs(f)), i), 0) / count(*)) AS e FROM num WHERE f <> 0 GROUP BY id HAVING count(*) >= 2),
 lr AS (SELECT id, quantile_cont(ln(abs(g)) - ln(abs(f)), 0.5) AS m, stddev_pop(ln(abs(g)) - ln(abs(f))) AS s FROM nxt WHERE f <> 0 AND g <> 0 GROUP BY id),
 base AS (SELECT id, count(*) AS n, {', '.join(f'coalesce(max(sl) FILTER (i = {i}), 0) AS slog_{i}' for i in range(32))},
   {', '.join(f'count(*) FILTER (((x % {m}) + {m}) % {m} = {r}) / count(*) AS mod{m}_{r}' for m in arrays.MODULI for r in range(m))},
   count(*) FILTER (x < 0) / count(*) AS frac_neg, count(*) FILTER (x = 0) / count(*) AS frac_zero, count(*) FILTER (x % 2 = 0) / count(*) AS frac_even,
   count(*) FILTER ((x < 0 AND y > 0) OR (x > 0 AND y < 0)) / greatest(count(*) - 1, 1) AS sign_alt, count(*) FILTER (abs(x % 2) <> abs(y % 2)) / greatest(count(*) - 1, 1) AS parity_alt, count(*) FILTER (y >= x) / greatest(count(*) - 1, 1) AS frac_nondec
   FROM nxt GROUP BY id)
"""
_AS = {
    "n_terms": "least(total, 348)",
    "n_used": "n",
    "growth_slope": "gr.b",
    "growth_intercept": "gr.c",
    "growth_rms": "gr.e",
    "diff1_mean": "a1.m",
    "diff1_std": "a1.s",
    "diff2_mean": "a2.m",
    "diff2_std": "a2.s",
    "logratio_med": "lr.m",
    "logratio_std": "lr.s"
}
_PAIRS = f"""
 {TERMS},
 seq AS (SELECT id, list(t ORDER BY i) AS q FROM term GROUP BY id),
 pos AS (SELECT DISTINCT u, v FROM splits WHERE label = 1 AND u IS NOT NULL AND v IS NOT NULL),
 pr AS (SELECT u, v, a.q AS p, b.q AS q FROM pos JOIN seq a ON a.id = u JOIN seq b ON b.id = v)
"""
_J = "len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)"
_GRAMS = (
    "(CASE WHEN len({x}) >= 3 THEN list_transform(range(1, len({x}) - 1), lambda k: array_to_string(list_slice({x}, k, k + 2), ',')) ELSE [] END)"
)
_SUB = """CASE WHEN least(len(p), len(q)) < 8 THEN false ELSE len(list_filter(range(0, greatest(len(p), len(q)) - 7), lambda k:
 list_slice(CASE WHEN len(p) <= len(q) THEN q ELSE p END, k + 1, k + least(len(p), len(q))) = list_slice(CASE WHEN len(p) <= len(q) THEN p ELSE q END, 1, least(least(len(p), len(q)), greatest(len(p), len(q)) - k)))) > 0 END"""


# terms modulo a prime of 61 bits, from their digits: products of two residues fit HUGEINT, and unequal numbers agree with a chance below 1e-17
PRIME = 2**61 - 1
RESIDUES = f"""
 digits AS (SELECT id, i, t LIKE '-%' AS minus, lpad(ltrim(t, '-'), CAST(ceil(len(ltrim(t, '-')) / 15) * 15 AS INT), '0') AS g FROM term),
 reduced AS (SELECT id, i, minus, list_reduce(list_transform(range(0, len(g) // 15), lambda j: CAST(substr(g, CAST(j * 15 + 1 AS INT), 15) AS HUGEINT)), lambda x, y: (x * 1000000000000000 + y) % {PRIME}) % {PRIME} AS r FROM digits),
 residues AS (SELECT id, list(CASE WHEN minus AND r > 0 THEN {PRIME} - r ELSE r END ORDER BY i) AS r FROM reduced GROUP BY id)
"""
# of pairs pr(u, v, p, q) of residues: matched(u, v, s)
AFFINE = f"""
 shifted AS (SELECT u, v, s, CASE WHEN s > 0 THEN list_slice(p, s + 1, len(p)) ELSE p END AS p, CASE WHEN s < 0 THEN list_slice(q, 1 - s, len(q)) ELSE q END AS q FROM (SELECT *, unnest(range(-8, 9)) AS s FROM pr)),
 sized AS (SELECT u, v, s, list_slice(p, 1, least(len(p), len(q))) AS p, list_slice(q, 1, least(len(p), len(q))) AS q FROM shifted WHERE least(len(p), len(q)) >= 8),
 first AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: p[i] <> p[1])[1] AS k FROM sized),
 matched AS (SELECT u, v, s, k FROM first WHERE CASE WHEN k IS NULL THEN len(list_distinct(q)) = 1
   ELSE q[k] <> q[1] AND len(list_filter(range(1, len(p) + 1), lambda i: (((q[i] - q[1] + {PRIME}) % {PRIME}) * ((p[k] - p[1] + {PRIME}) % {PRIME}) - ((q[k] - q[1] + {PRIME}) % {PRIME}) * ((p[i] - p[1] + {PRIME}) % {PRIME})) % {PRIME} <> 0)) = 0 END)
"""


def _jac(x: str, y: str) -> str:
    return f"coalesce({_J.format(a=x, b=y)}, 0)"


def _features_of(pairs: str) -> str:
    """CTEs with feat(u, v, term_set_jaccard, ngram3_jaccard, exact_subseq, affine_match) of the pairs of a query."""
    return f"""
 {TERMS}, {RESIDUES},
 seq AS (SELECT id, list(t ORDER BY i) AS q FROM term GROUP BY id),
 asked AS ({pairs}),
 st AS (SELECT u, v, a.q AS p, b.q AS q FROM asked JOIN seq a ON a.id = u JOIN seq b ON b.id = v),
 g AS (SELECT *, {_GRAMS.format(x='p')} AS a, {_GRAMS.format(x='q')} AS b FROM st),
 pr AS (SELECT u, v, a.r AS p, b.r AS q FROM asked JOIN residues a ON a.id = u JOIN residues b ON b.id = v), {AFFINE},
 feat AS (SELECT u, v, {_jac('p', 'q')} AS term_set_jaccard, {_jac('a', 'b')} AS ngram3_jaccard, CASE WHEN {_SUB} THEN 1.0 ELSE 0.0 END AS exact_subseq, CASE WHEN (u, v) IN (SELECT (u, v) FROM matched) THEN 1.0 ELSE 0.0 END AS affine_match FROM g)
"""


_FEATURES = ("term_set_jaccard", "ngram3_jaccard", "exact_subseq", "affine_match")
_STORED = "SELECT DISTINCT u, v FROM splits WHERE u IS NOT NULL AND v IS NOT NULL"
_TRAIN = f"{_STORED} AND split = 'train' AND label = 1"

SQL = {
    "pair_features": f"WITH {_features_of(_STORED)} SELECT u, v, {', '.join(f'round(CAST({c} AS DOUBLE), 9) AS {c}' for c in _FEATURES)} FROM feat",
    # the four terms that fix c and d must fit HUGEINT, and so must their products
    "affine_pairs": f"""
WITH {_features_of(_STORED)},
 least_ AS (SELECT u, v, min(s) AS s, arg_min(k, s) AS k FROM matched GROUP BY u, v),
 ends AS (SELECT u, v, s, CAST(p[greatest(s, 0) + 1] AS HUGEINT) AS x0, CAST(q[greatest(-s, 0) + 1] AS HUGEINT) AS y0, CAST(p[greatest(s, 0) + k] AS HUGEINT) AS x1, CAST(q[greatest(-s, 0) + k] AS HUGEINT) AS y1 FROM least_ JOIN st USING (u, v)),
 whole AS (SELECT u, v, s, CASE WHEN x1 IS NULL THEN 0 ELSE (y1 - y0) * sign(x1 - x0) END AS cn, coalesce(abs(x1 - x0), 1) AS cd, CASE WHEN x1 IS NULL THEN y0 ELSE (y0 * (x1 - x0) - (y1 - y0) * x0) * sign(x1 - x0) END AS dn FROM ends)
SELECT u, v, CAST(cn // gcd(cn, cd) AS VARCHAR) AS c_num, CAST(cd // gcd(cn, cd) AS VARCHAR) AS c_den, CAST(dn // gcd(dn, cd) AS VARCHAR) AS d_num, CAST(cd // gcd(dn, cd) AS VARCHAR) AS d_den, CAST(s AS INT) AS s FROM whole
""",
    "smoke_aggregates": f"""
WITH {_features_of("SELECT u, v FROM (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM splits WHERE split = 'train' AND label = 1) QUALIFY row_number() OVER (ORDER BY md5('42|' || u || '|' || v), u, v) <= 200")}
SELECT count(*) AS pairs, {', '.join(f'round(avg(CAST({c} AS DOUBLE)), 4) AS {c}' for c in _FEATURES)} FROM feat
""",
    "smoke_affine_by_stratum": f"""
WITH {_features_of(_TRAIN)}, rows_ AS (SELECT DISTINCT u, v, lower(trim(stratum)) AS stratum FROM splits WHERE split = 'train' AND label = 1)
SELECT stratum, count(*) AS pairs, round(avg(CAST(affine_match AS DOUBLE)), 6) AS affine_match, CAST(grouping(stratum) AS INT) AS total FROM feat JOIN rows_ USING (u, v) GROUP BY ROLLUP (stratum)
""",
    "seq_features": f"WITH {_USED} SELECT base.id AS a_number, {', '.join(f'round(CAST(coalesce({_AS.get(n, n)}, 0) AS DOUBLE), 5) + 0.0 AS {n}' for n in NAMES)} FROM base JOIN size ON size.id = base.id LEFT JOIN gr ON gr.id = base.id LEFT JOIN a1 ON a1.id = base.id LEFT JOIN a2 ON a2.id = base.id LEFT JOIN lr ON lr.id = base.id",
    "set_jaccard": f"WITH {_PAIRS} SELECT u, v, round({_jac('p', 'q')}, 9) AS jaccard FROM pr",
    "ngram_jaccard": f"WITH {_PAIRS}, g AS (SELECT u, v, {_GRAMS.format(x='p')} AS a, {_GRAMS.format(x='q')} AS b FROM pr) SELECT u, v, round({_jac('a', 'b')}, 9) AS jaccard FROM g",
    "exact_subseq": f"WITH {_PAIRS} SELECT u, v, {_SUB} AS hit FROM pr",
    "smoke_by_stratum": f"""
WITH {_PAIRS.replace("SELECT DISTINCT u, v FROM splits WHERE label = 1", "SELECT DISTINCT u, v, lower(trim(stratum)) AS stratum FROM splits WHERE split = 'train' AND label = 1").replace("SELECT u, v, a.q AS p", "SELECT u, v, stratum, a.q AS p")},
 g AS (SELECT *, {_GRAMS.format(x='p')} AS a, {_GRAMS.format(x='q')} AS b FROM pr)
SELECT stratum, count(*) AS pairs, round(avg({_jac('p', 'q')}), 6) AS term_set_jaccard, round(avg({_jac('a', 'b')}), 6) AS ngram3_jaccard, round(avg(CASE WHEN {_SUB} THEN 1.0 ELSE 0.0 END), 6) AS exact_subseq, CAST(grouping(stratum) AS INT) AS total
FROM g GROUP BY ROLLUP (stratum)
""",
}
