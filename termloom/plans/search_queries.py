"""Retrieval by shared grams, its measures, vector search, transforms, and counts over a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.arrays import affine_match
from termloom.operators import battery, exclude, retrieval
from termloom.plans.array_queries import AFFINE, PRIME, RESIDUES
from termloom.plans.graph_queries import KNOWN, TERMS
from termloom.session import materialize, spread, table
from termloom.streaming.mentions import stream_counts


def _seqs(s, d):
    return retrieval.sequences(table(s, d, "corpus"))


def _ranked(s, d, k):
    seqs = materialize(_seqs(s, d), "seqs")
    asked = seqs.filter(F.pmod("id", F.lit(100)) == 0)
    return retrieval.top_k(retrieval.shared_gram_candidates(asked, seqs), k)


def _baseline(s, d):
    seqs = materialize(_seqs(s, d), "seqs")
    return retrieval.classical_baseline(seqs.filter(F.pmod("id", F.lit(100)) == 0), seqs, gramless=True)


def _novel_links(s, d):
    """Transform links of which the two sequences aren't related by a mention or a program call."""
    links = battery.transform_links(_seqs(s, d)).withColumnsRenamed({"q": "u", "id": "v"})
    return exclude.without_known(links, exclude.known_pairs(table(s, d, "relations"), table(s, d, "xrefs")))


def _held(s, d):
    """Positive test pairs with an end whose id is divisible by 100: (u, v, stratum, lt8_any)."""
    held = (
        table(s, d, "splits")
        .filter("split = 'test' and label = 1 and u is not null and v is not null")
        .filter("pmod(u, 100) = 0 or pmod(v, 100) = 0")
    )
    return held.groupBy(
        "u", "v", F.coalesce(F.lower(F.trim("stratum")), F.lit("(none)")).alias("stratum")
    ).agg(F.max("lt8_any").alias("lt8_any"))


def _ranks(s, d):
    """Ranks of the partners in these pairs from both ends, among all candidates of each."""
    held, seqs = materialize(_held(s, d), "held"), materialize(_seqs(s, d), "seqs")
    asked = seqs.join(held.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi")
    ranked = retrieval.top_k(retrieval.shared_gram_candidates(asked, seqs), None)
    return materialize(retrieval.report_parts(retrieval.hit_ranks(held, ranked)), "ranks")


def _checked(rows):
    return rows.select("id", "transform", F.size("terms").alias("n"), battery.residue_sum("terms").alias("check_sum"))


def _linear(s, d):
    """The transforms that are sums of terms, as their length and a check value."""
    other = ["euler", "inverse_euler", "complement", "complement_gaps"]
    return _checked(battery.transformed(spread(_seqs(s, d))).filter(~F.col("transform").isin(other)))


def _euler(s, d):
    """Both Euler transforms in the same form."""
    return _checked(
        battery.transformed(spread(_seqs(s, d))).filter(F.col("transform").isin("euler", "inverse_euler"))
    )


def _affine_shifts(s, d):
    """The ten best candidates of each query by shared 3-grams, those that are affine to it, with the shift."""
    seqs = materialize(_seqs(s, d), "seqs")
    pairs = retrieval.top_k(
        retrieval.shared_gram_candidates(seqs.filter(F.pmod("id", F.lit(100)) == 0), seqs), 10
    ).select("q", "id")
    both = pairs.join(
        seqs.withColumnsRenamed({"id": "q", "seq": "a"}), "q"
    ).join(seqs.withColumnRenamed("seq", "b"), "id")
    return both.select("q", "id", affine_match(F.col("a"), F.col("b"))["s"].alias("s")).filter("s is not null")


QUERIES = {
    "affine_shifts": _affine_shifts,
    "gram_top10": lambda s, d: _ranked(s, d, 10).select(
        "q", "id", "shared", F.round("jaccard", 9).alias("jaccard"), "rank"
    ),
    "retrieval_report": lambda s, d: retrieval.retrieval_report(_ranks(s, d)),
    "retrieval_ci": lambda s, d: retrieval.bootstrap_ci(_ranks(s, d)),
    "nearest_vectors": lambda s, d: retrieval.nearest_vectors(table(s, d, "embeddings")).select(
        "q", "vec_id", F.round("similarity", 6).alias("similarity"), "rank"
    ),
    "transforms": lambda s, d: battery.transformed(spread(_seqs(s, d))).select(
        "id", "transform", F.size("terms").alias("n"), F.md5(F.array_join("terms", ",").cast("binary")).alias("content")
    ),
    "linear_transforms": _linear,
    "euler_transforms": _euler,
    "classical_baseline": _baseline,
    "novel_links": _novel_links,
    "transform_links": lambda s, d: battery.transform_links(_seqs(s, d)),
    "stream_daily_mentions": lambda s, d: stream_counts(s, f"{d}/xrefs.parquet"),
}

_GRAM_OF = f"""
 {TERMS},
 g AS (SELECT DISTINCT id, t || ',' || t2 || ',' || t3 AS g FROM (SELECT id, t, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM term WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE t3 IS NOT NULL),
 n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
 hit AS (SELECT a.id AS q, b.id AS id, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id WHERE {{asked}} GROUP BY 1, 2),
 sc AS (SELECT q, hit.id, shared, shared / (x.n + y.n - shared) AS jaccard FROM hit JOIN n x ON x.id = q JOIN n y ON y.id = hit.id),
 rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY jaccard DESC, id) AS INT) AS rank FROM sc)
"""

_GRAM = _GRAM_OF.format(asked="a.id % 100 = 0")

# places count from 1
_LINEAR = f"""
 {TERMS}, {RESIDUES},
 x AS (SELECT id, i + 1 AS i, CASE WHEN minus AND r > 0 THEN {PRIME} - r ELSE r END AS x FROM reduced),
 d1 AS (SELECT id, i, (lead(x) OVER w - x + {PRIME}) % {PRIME} AS x FROM x WINDOW w AS (PARTITION BY id ORDER BY i) QUALIFY lead(x) OVER w IS NOT NULL),
 d2 AS (SELECT id, i, (lead(x) OVER w - x + {PRIME}) % {PRIME} AS x FROM d1 WINDOW w AS (PARTITION BY id ORDER BY i) QUALIFY lead(x) OVER w IS NOT NULL),
 top AS (SELECT max(i) AS m FROM x),
 xs AS (SELECT id, i, x, count(*) OVER (PARTITION BY id) AS z FROM x),
 pascal(n, c) AS (SELECT 0, [CAST(1 AS HUGEINT)] UNION ALL SELECT n + 1, [CAST(1 AS HUGEINT)] || list_transform(range(1, len(c)), lambda k: (c[k] + c[k + 1]) % {PRIME}) || [CAST(1 AS HUGEINT)] FROM pascal WHERE n < (SELECT m FROM top)),
 choose AS (SELECT n, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS c FROM pascal),
 nat AS (SELECT CAST(unnest(range(1, (SELECT m FROM top) + 1)) AS BIGINT) AS n),
 prime AS (SELECT n AS p FROM nat a WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM nat b WHERE b.n > 1 AND b.n < a.n AND a.n % b.n = 0)),
 mu AS (SELECT n, CASE WHEN EXISTS (SELECT 1 FROM prime WHERE n % (p * p) = 0) THEN 0 WHEN (SELECT count(*) FROM prime WHERE n % p = 0) % 2 = 0 THEN 1 ELSE -1 END AS mu FROM nat),
 divisor AS (SELECT a.n, b.n AS i, mu FROM nat a JOIN nat b ON a.n % b.n = 0 JOIN mu ON mu.n = a.n // b.n),
 every_ AS (SELECT id, 'identity' AS transform, i, x FROM x UNION ALL SELECT id, 'negation', i, ({PRIME} - x) % {PRIME} FROM x
  UNION ALL SELECT id, 'diff1', i, x FROM d1 UNION ALL SELECT id, 'diff2', i, x FROM d2 UNION ALL SELECT id, 'partial_sums', i, sum(x) OVER (PARTITION BY id ORDER BY i) % {PRIME} FROM x
  UNION ALL SELECT id, CASE i % 2 WHEN 1 THEN 'even' ELSE 'odd' END, (i + 1) // 2, x FROM x UNION ALL SELECT id, 'third_' || ((i - 1) % 3), (i - 1) // 3 + 1, x FROM x
  UNION ALL SELECT id, 'binomial', n + 1, sum(c * x % {PRIME}) % {PRIME} FROM xs JOIN choose USING (i) WHERE n < z GROUP BY id, n
  UNION ALL SELECT id, 'inverse_binomial', n + 1, sum(c * (CASE WHEN (n + 1 - i) % 2 = 0 THEN x ELSE {PRIME} - x END) % {PRIME}) % {PRIME} FROM xs JOIN choose USING (i) WHERE n < z GROUP BY id, n
  UNION ALL SELECT id, 'moebius', n, (sum(mu * x) % {PRIME} + {PRIME}) % {PRIME} FROM xs JOIN divisor USING (i) WHERE n <= z GROUP BY id, n
  UNION ALL SELECT id, 'inverse_moebius', n, sum(x) % {PRIME} FROM xs JOIN divisor USING (i) WHERE n <= z GROUP BY id, n)
"""

# all transforms of some sequences, of complements as many terms as can meet another sequence: shifted(q, transform, i, x, n);
# division by a number is by its inverse, its power PRIME - 2
_ALL = _LINEAR.replace("AS x FROM reduced)", "AS x FROM reduced WHERE {only})") + f"""
 , power AS (SELECT n, CAST({PRIME} - 2 AS HUGEINT) AS e, CAST(n AS HUGEINT) AS b, CAST(1 AS HUGEINT) AS v FROM nat UNION ALL SELECT n, e // 2, b * b % {PRIME}, CASE WHEN e % 2 = 1 THEN v * b % {PRIME} ELSE v END FROM power WHERE e > 0),
 inverse AS (SELECT n, v FROM power WHERE e = 0),
 listed AS (SELECT id, list(CAST(x AS HUGEINT) ORDER BY i) AS a, count(*) AS z FROM x GROUP BY id),
 sums AS (SELECT id, list(c ORDER BY n) AS c FROM (SELECT id, n, sum(i * x % {PRIME}) % {PRIME} AS c FROM xs JOIN divisor USING (i) WHERE n <= z GROUP BY id, n) GROUP BY id),
 euler AS (SELECT id, 0 AS m, [CAST(1 AS HUGEINT)] AS b FROM listed UNION ALL
  SELECT id, m + 1, b || [CAST(list_sum(list_transform(range(1, m + 2), lambda j: c[j] * b[m + 2 - j] % {PRIME})) % {PRIME} * v % {PRIME} AS HUGEINT)] FROM euler JOIN sums USING (id) JOIN listed USING (id) JOIN inverse ON n = m + 1 WHERE m < z),
 parts AS (SELECT id, 1 AS m, [a[1]] AS c FROM listed UNION ALL
  SELECT id, m + 1, c || [CAST(((m + 1) * a[m + 1] + {PRIME} - list_sum(list_transform(range(1, m + 1), lambda j: c[j] * a[m + 1 - j] % {PRIME})) % {PRIME}) % {PRIME} AS HUGEINT)] FROM parts JOIN listed USING (id) WHERE m < z),
 part AS (SELECT id, unnest(range(1, m + 1)) AS i, unnest(c) AS x FROM parts JOIN listed USING (id) WHERE m = z),
 own AS (SELECT id, i, t, lead(t) OVER (PARTITION BY id ORDER BY i) AS t2 FROM term WHERE {{only}}),
 rising AS (SELECT id, max(CASE WHEN t2 IS NULL THEN t END) AS last_ FROM own GROUP BY id HAVING count(*) > 1 AND bool_and(t NOT LIKE '-%' AND (t2 IS NULL OR len(t2) > len(t) OR (len(t2) = len(t) AND t2 > t)))),
 longest AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM term GROUP BY id)),
 missing AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY v) AS i FROM rising, (SELECT unnest(range(0, 2 * (SELECT n FROM longest) + 9)) AS v)
  WHERE (len(last_) > 9 OR v < TRY_CAST(last_ AS BIGINT)) AND NOT EXISTS (SELECT 1 FROM own WHERE own.id = rising.id AND own.t = CAST(v AS VARCHAR))),
 whole_ AS (SELECT id, transform, i, CAST(x AS HUGEINT) AS x FROM every_
  UNION ALL SELECT id, 'euler', unnest(range(1, m + 1)), unnest(list_slice(b, 2, m + 1)) FROM euler JOIN listed USING (id) WHERE m = z
  UNION ALL SELECT id, 'inverse_euler', n, (sum(mu * x) % {PRIME} + {PRIME}) % {PRIME} * any_value(inverse.v) % {PRIME} FROM part JOIN divisor USING (i) JOIN inverse USING (n) JOIN listed USING (id) WHERE n <= z GROUP BY id, n
  UNION ALL SELECT id, 'complement', i, v FROM missing WHERE i <= (SELECT n FROM longest) + 8),
 shifted_ AS (SELECT id AS q, transform, i, x, count(*) OVER (PARTITION BY id, transform) AS n FROM whole_)
"""

# links as of :func:`transform_links`: equal ones, and affine ones with the constants, whose terms and products must fit HUGEINT
_LINKS = _ALL.replace("{only}", "id % 100 = 0") + f"""
 , there AS (SELECT id, i + 1 AS i, CASE WHEN minus AND r > 0 THEN {PRIME} - r ELSE r END AS x, count(*) OVER (PARTITION BY id) AS n FROM reduced),
 meets AS (SELECT a.q, a.transform, b.id, a.i - b.i AS s, least(a.n - greatest(a.i - b.i, 0), b.n - greatest(b.i - a.i, 0)) AS m, count(*) AS same, count(DISTINCT a.x) AS kinds
  FROM shifted_ a JOIN there b ON a.x = b.x AND abs(a.i - b.i) <= 8 AND a.q <> b.id GROUP BY ALL HAVING count(*) >= 8),
 equal AS (SELECT q, transform, id, arg_min(s, 2 * abs(s) + CAST(s > 0 AS INT)) AS s FROM meets WHERE same = m AND kinds > 1 GROUP BY q, transform, id),
 pr AS (SELECT a.id AS u, b.id AS v, a.r AS p, b.r AS q FROM residues a JOIN residues b ON a.id <> b.id WHERE a.id % 100 = 0), {AFFINE},
 least_ AS (SELECT u, v, arg_min(s, 2 * abs(s) + CAST(s > 0 AS INT)) AS s, arg_min(k, 2 * abs(s) + CAST(s > 0 AS INT)) AS k FROM matched WHERE k IS NOT NULL GROUP BY u, v),
 texts AS (SELECT id, list(t ORDER BY i) AS t FROM term GROUP BY id),
 ends AS (SELECT u, v, s, CAST(a.t[greatest(s, 0) + 1] AS HUGEINT) AS x0, CAST(b.t[greatest(-s, 0) + 1] AS HUGEINT) AS y0, CAST(a.t[greatest(s, 0) + k] AS HUGEINT) AS x1, CAST(b.t[greatest(-s, 0) + k] AS HUGEINT) AS y1
  FROM least_ JOIN texts a ON a.id = u JOIN texts b ON b.id = v),
 fractions AS (SELECT u, v, s, (y1 - y0) * sign(x1 - x0) AS cn, abs(x1 - x0) AS cd, (y0 * (x1 - x0) - (y1 - y0) * x0) * sign(x1 - x0) AS dn FROM ends),
 links AS (SELECT q, transform, id, CAST(s AS INT) AS s, CAST(NULL AS VARCHAR) AS c_num, CAST(NULL AS VARCHAR) AS c_den, CAST(NULL AS VARCHAR) AS d_num, CAST(NULL AS VARCHAR) AS d_den FROM equal UNION ALL
  SELECT u, 'affine', v, CAST(s AS INT), CAST(cn // gcd(cn, cd) AS VARCHAR), CAST(cd // gcd(cn, cd) AS VARCHAR), CAST(dn // gcd(dn, cd) AS VARCHAR), CAST(cd // gcd(dn, cd) AS VARCHAR) FROM fractions)
"""

SQL = {
    "euler_transforms": f"WITH RECURSIVE {_ALL.replace('{only}', 'true')} SELECT q AS id, transform, CAST(any_value(n) AS INT) AS n, CAST(sum(x * i % {PRIME}) % {PRIME} AS BIGINT) AS check_sum FROM shifted_ WHERE transform IN ('euler', 'inverse_euler') GROUP BY q, transform",
    "transform_links": f"WITH RECURSIVE {_LINKS} SELECT q, transform, id, s, c_num, c_den, d_num, d_den FROM links",
    "novel_links": f"WITH RECURSIVE {_LINKS}, {KNOWN} SELECT q AS u, transform, id AS v, s, c_num, c_den, d_num, d_den FROM links WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.u = least(q, id) AND k.v = greatest(q, id))",
    "linear_transforms": f"WITH RECURSIVE {_LINEAR} SELECT id, transform, CAST(count(*) AS INT) AS n, CAST(sum(x * i % {PRIME}) % {PRIME} AS BIGINT) AS check_sum FROM every_ GROUP BY id, transform",
    "affine_shifts": f"""
WITH {_GRAM}, {RESIDUES}, pr AS (SELECT q AS u, rk.id AS v, a.r AS p, b.r AS q FROM rk JOIN residues a ON a.id = rk.q JOIN residues b ON b.id = rk.id WHERE rank <= 10), {AFFINE}
SELECT u AS q, v AS id, CAST(min(s) AS INT) AS s FROM matched GROUP BY u, v
""",
    "gram_top10": f"WITH {_GRAM} SELECT q, id, shared, round(jaccard, 9) AS jaccard, rank FROM rk WHERE rank <= 10",
    "retrieval_report": f"""
WITH held AS (SELECT u, v, coalesce(lower(trim(stratum)), '(none)') AS stratum, max(lt8_any) AS lt8 FROM splits WHERE split = 'test' AND label = 1 AND u IS NOT NULL AND v IS NOT NULL AND (u % 100 = 0 OR v % 100 = 0) GROUP BY ALL),
 {_GRAM_OF.format(asked="a.id IN (SELECT u FROM held UNION SELECT v FROM held)")},
 r AS (SELECT held.*, least(a.rank, b.rank) AS rank FROM held LEFT JOIN rk a ON a.q = u AND a.id = v LEFT JOIN rk b ON b.q = v AND b.id = u),
 parts AS (SELECT u, v, stratum, rank FROM r UNION SELECT u, v, '(all)', rank FROM r UNION SELECT u, v, '(short)', rank FROM r WHERE lt8 = 1)
SELECT stratum, count(*) AS pairs, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(CASE WHEN rank <= 100 THEN 1.0 ELSE 0.0 END), 6) AS recall_100,
 round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr, count(*) < 100 AS underpowered FROM parts GROUP BY stratum
""",
    "nearest_vectors": """
WITH s AS (SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT q, vec_id, round(c, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 10
""",
    "stream_daily_mentions": "SELECT CAST(date_trunc('day', seen_at) AS TIMESTAMP) AS day, coalesce(lower(trim(stratum)), '(none)') AS stratum, count(*) AS mentions, count(*) FILTER (source = target) AS self_mentions FROM xrefs WHERE seen_at IS NOT NULL GROUP BY ALL",
}
