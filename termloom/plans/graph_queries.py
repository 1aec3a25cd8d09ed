"""Edges, degrees, strata counts and catalog joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.terms import clean_terms
from termloom.operators import catalog, exclude, graph
from termloom.operators.splits import dead_ids
from termloom.operators.stratify import names_of
from termloom.session import table


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


def _degree_rows(spark, d):
    xrefs, corpus = _t(spark, d, "xrefs", "corpus")
    return graph.degrees(xrefs, graph.universe(corpus))


def _isolated(spark, d):
    return _degree_rows(spark, d).agg(F.count("*").alias("nodes"), F.count_if(F.col("und_deg") == 0).alias("isolated"))


def _touching(spark, d):
    xrefs, meta = _t(spark, d, "xrefs", "seq_meta")
    edges = graph.directed_edges(xrefs).select(F.col("source").alias("u"), F.col("target").alias("v"))
    return graph.touching(edges, dead_ids(meta))


def catalog_rows(spark, d):
    """The corpus joined from its terms, names and references."""
    corpus = table(spark, d, "corpus")
    terms = corpus.filter(F.size("terms") > 0).select("a_number", clean_terms(F.col("terms")).alias("terms"))
    names = names_of(corpus)
    refs = corpus.select(
        "a_number",
        F.array_sort(
            F.array_distinct(F.filter("xrefs", lambda x: x.isNotNull() & (x != F.col("a_number"))))
        ).alias("xrefs")
    )
    return catalog.full_catalog(terms, names, refs)


def _full_catalog(spark, d):
    return catalog_rows(spark, d).select(
        "a_number",
        F.size("terms").alias("n_terms"),
        F.array_join("terms", ",").alias("terms"),
        "name",
        F.array_join("xrefs", ",").alias("xrefs"),
        "dead"
    )


def _sets(spark, d):
    corpus, xrefs, meta = _t(spark, d, "corpus", "xrefs", "seq_meta")
    have = graph.universe(corpus)
    named = names_of(corpus).select(F.col("a_number").alias("id"))
    seen = xrefs.select(F.explode(F.array("source", "target")).alias("id")).filter("id is not null").distinct()
    dead = dead_ids(meta)
    parts = {
        "with_terms": have,
        "names_only": named.join(have, "id", "left_anti"),
        "mentioned_only": seen.subtract(have),
        "dead_with_terms": dead.intersect(have),
        "alive": have.join(dead, "id", "left_anti"),
        "all_ids": have.union(named).union(seen).distinct()
    }
    out = None
    for k, p in parts.items():
        p = p.agg(F.lit(k).alias("part"), F.count("*").alias("n"))
        out = p if out is None else out.unionByName(p)
    return out


QUERIES = {
    "pair_table": lambda s, d: graph.pair_table(table(s, d, "xrefs")),
    "directed_edges": lambda s, d: graph.directed_edges(table(s, d, "xrefs")).select(
        "source", "target", graph.stratum_of(F.col("rank")).alias("stratum"), "mentions"
    ),
    "link_type_counts": lambda s, d: table(s, d, "xrefs").groupBy("link_type").agg(F.count("*").alias("n")),
    "mention_counts": lambda s, d: graph.mention_counts(table(s, d, "xrefs")),
    "stratum_counts": lambda s, d: graph.stratum_counts(table(s, d, "xrefs"), graph.universe(table(s, d, "corpus"))),
    "degrees": _degree_rows,
    "degree_summary": lambda s, d: graph.distribution(_degree_rows(s, d), ["out_deg", "in_deg", "und_deg"]),
    "isolated_nodes": _isolated,
    "universe_pairs": lambda s, d: graph.within(
        graph.pair_table(table(s, d, "xrefs")), graph.universe(table(s, d, "corpus"))
    ),
    "edges_touching_dead": _touching,
    "id_set_sizes": _sets,
    "full_catalog": _full_catalog,
    "direct_references": lambda s, d: catalog.direct_references(table(s, d, "xrefs")),
    "term_lengths": lambda s, d: table(s, d, "corpus")
    .filter(F.size("terms") > 0)
    .select("a_number", F.size("terms").alias("n")),
    "term_subset": lambda s, d: catalog.term_subset(
        table(s, d, "corpus"), table(s, d, "relations").select(F.col("program").alias("a_number"))
    ).select("a_number", F.array_join(clean_terms(F.col("terms")), ",").alias("terms")),
    "keyword_counts": lambda s, d: catalog.keyword_counts(table(s, d, "seq_meta")),
    "length_stats": lambda s, d: catalog.length_stats(table(s, d, "corpus")),
    "name_flags": lambda s, d: catalog.name_flags(table(s, d, "corpus")),
    "program_coverage": lambda s, d: catalog.coverage(
        table(s, d, "relations").select(F.col("program").alias("id")), graph.universe(table(s, d, "corpus"))
    ),
    "relation_sizes": lambda s, d: exclude.relation_sizes(table(s, d, "relations")),
    "known_pairs": lambda s, d: exclude.known_pairs(table(s, d, "relations"), table(s, d, "xrefs")),
    "novel_negatives": lambda s, d: exclude.without_known(
        table(s, d, "splits").filter("label = 0").select("u", "v", "split").distinct(),
        exclude.known_pairs(table(s, d, "relations"), table(s, d, "xrefs"))
    ),
}

RANK = "CASE lower(trim(stratum)) WHEN 's1' THEN 0 WHEN 's2' THEN 1 WHEN 's4' THEN 2 WHEN 's3' THEN 3 END"
LABEL = "CASE r WHEN 0 THEN 's1' WHEN 1 THEN 's2' WHEN 2 THEN 's4' WHEN 3 THEN 's3' END"
EDGES = f"""
 m AS (SELECT source, target, {RANK} AS r FROM xrefs WHERE source <> target),
 ded AS (SELECT source, target, min(r) AS r, count(*) AS n FROM m GROUP BY source, target),
 und AS (SELECT least(source, target) AS u, greatest(source, target) AS v, min(r) AS r, count(*) AS dirs FROM ded GROUP BY 1, 2)
"""
NODES = " nodes AS (SELECT DISTINCT a_number AS id FROM corpus WHERE len(terms) > 0)"
TERMS = r"""
 raw AS (SELECT a_number AS id, generate_subscripts(terms, 1) AS i, unnest(terms) AS t FROM corpus),
 cut AS (SELECT id, i, regexp_extract(t, '^\s*([+-]?)0*([0-9]+)\s*$', 1) AS s, regexp_extract(t, '^\s*([+-]?)0*([0-9]+)\s*$', 2) AS g FROM raw WHERE regexp_matches(t, '^\s*[+-]?[0-9]+\s*$')),
 term AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i, CASE WHEN s = '-' AND g <> '0' THEN '-' || g ELSE g END AS t FROM cut)
"""
KEYS = (
    " keys AS (SELECT a_number AS id, trim(unnest(string_split(coalesce(keywords, ''), ','))) AS k FROM seq_meta WHERE a_number IS NOT NULL)"
)
DEAD = " dead AS (SELECT DISTINCT id FROM keys WHERE k = 'dead')"
DEGREES = f"""
 {EDGES}, {NODES},
 ends AS (SELECT source AS id, 0 AS c FROM ded UNION ALL SELECT target, 1 FROM ded
          UNION ALL SELECT unnest([u, v]), 2 FROM und WHERE u IN (SELECT id FROM nodes) AND v IN (SELECT id FROM nodes)),
 deg AS (SELECT CAST(nodes.id AS BIGINT) AS id, count(*) FILTER (c = 0) AS out_deg, count(*) FILTER (c = 1) AS in_deg, count(*) FILTER (c = 2) AS und_deg FROM nodes LEFT JOIN ends USING (id) GROUP BY nodes.id)
"""
KNOWN = (
    " known AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT program AS a, calls AS b FROM relations UNION ALL SELECT source, target FROM xrefs) WHERE a <> b)"
)

SQL = {
    "pair_table": f"WITH {EDGES} SELECT u, v, {LABEL} AS stratum FROM und",
    "directed_edges": f"WITH {EDGES} SELECT source, target, {LABEL} AS stratum, n AS mentions FROM ded",
    "link_type_counts": "SELECT link_type, count(*) AS n FROM xrefs GROUP BY link_type",
    "mention_counts": f"""
WITH {EDGES}
SELECT count(*) AS stored, count(*) FILTER (source = target) AS self_mentions, count(*) FILTER (source IS NULL OR target IS NULL) AS open_ended, count(*) FILTER (source <> target) AS usable,
 (SELECT count(*) FROM ded) AS directed, (SELECT count(*) FROM und) AS undirected, (SELECT count(*) FROM und WHERE dirs = 2) AS symmetric, (SELECT count(*) FROM und WHERE dirs = 1) AS asymmetric FROM xrefs
""",
    "stratum_counts": f"""
WITH {EDGES}, {NODES}
SELECT 'directed' AS scope, coalesce({LABEL}, '(none)') AS stratum, count(*) AS n FROM ded GROUP BY 2
UNION ALL SELECT 'undirected', coalesce({LABEL}, '(none)'), count(*) FROM und GROUP BY 2
UNION ALL SELECT 'within', coalesce({LABEL}, '(none)'), count(*) FROM und WHERE u IN (SELECT id FROM nodes) AND v IN (SELECT id FROM nodes) GROUP BY 2
""",
    "degrees": f"WITH {DEGREES} SELECT id, out_deg, in_deg, und_deg FROM deg",
    "degree_summary": f"""
WITH {DEGREES}, k AS (SELECT 'out_deg' AS kind, out_deg AS x FROM deg UNION ALL SELECT 'in_deg', in_deg FROM deg UNION ALL SELECT 'und_deg', und_deg FROM deg)
SELECT kind, count(*) AS n, round(avg(x), 3) AS mean, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.99) AS p99, max(x) AS max FROM k GROUP BY kind
""",
    "isolated_nodes": f"WITH {DEGREES} SELECT count(*) AS nodes, count(*) FILTER (und_deg = 0) AS isolated FROM deg",
    "universe_pairs": f"WITH {EDGES}, {NODES} SELECT u, v, {LABEL} AS stratum FROM und WHERE u IN (SELECT id FROM nodes) AND v IN (SELECT id FROM nodes)",
    "edges_touching_dead": f"WITH {EDGES}, {KEYS}, {DEAD} SELECT source AS u, target AS v FROM ded WHERE source IN (SELECT id FROM dead) OR target IN (SELECT id FROM dead)",
    "id_set_sizes": f"""
WITH {NODES}, {KEYS}, {DEAD}, named AS (SELECT DISTINCT a_number AS id FROM corpus WHERE name IS NOT NULL),
 seen AS (SELECT source AS id FROM xrefs WHERE source IS NOT NULL UNION SELECT target FROM xrefs WHERE target IS NOT NULL)
SELECT 'with_terms' AS part, count(*) AS n FROM nodes
UNION ALL SELECT 'names_only', count(*) FROM (SELECT id FROM named EXCEPT SELECT id FROM nodes)
UNION ALL SELECT 'mentioned_only', count(*) FROM (SELECT id FROM seen EXCEPT SELECT id FROM nodes)
UNION ALL SELECT 'dead_with_terms', count(*) FROM (SELECT id FROM dead INTERSECT SELECT id FROM nodes)
UNION ALL SELECT 'alive', count(*) FROM (SELECT id FROM nodes EXCEPT SELECT id FROM dead)
UNION ALL SELECT 'all_ids', count(*) FROM (SELECT id FROM nodes UNION SELECT id FROM named UNION SELECT id FROM seen)
""",
    "full_catalog": f"""
WITH {TERMS},
 tt AS (SELECT id, string_agg(t, ',' ORDER BY i) AS terms, count(*) AS n FROM term GROUP BY id),
 ids AS (SELECT a_number AS id, min(name) AS name FROM corpus WHERE a_number IS NOT NULL AND (len(terms) > 0 OR name IS NOT NULL) GROUP BY a_number),
 x AS (SELECT id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS xrefs FROM (SELECT DISTINCT a_number AS id, unnest(xrefs) AS x FROM corpus) WHERE x <> id GROUP BY id)
SELECT id AS a_number, CAST(coalesce(n, 0) AS INT) AS n_terms, coalesce(terms, '') AS terms, coalesce(name, '') AS name, coalesce(xrefs, '') AS xrefs, n IS NULL AS dead FROM ids LEFT JOIN tt USING (id) LEFT JOIN x USING (id)
""",
    "direct_references": "SELECT DISTINCT source, target FROM xrefs WHERE source <> target",
    "term_lengths": "SELECT a_number, CAST(len(terms) AS INT) AS n FROM corpus WHERE len(terms) > 0",
    "term_subset": f"WITH {TERMS} SELECT a_number, coalesce((SELECT string_agg(t, ',' ORDER BY i) FROM term WHERE term.id = a_number), '') AS terms FROM corpus WHERE a_number IN (SELECT program FROM relations)",
    "keyword_counts": f"WITH {KEYS}, w AS (SELECT unnest(['dead', 'dup', 'dupe', 'cons', 'base', 'fini', 'sign', 'nonn']) AS keyword) SELECT keyword, count(DISTINCT id) AS n FROM w LEFT JOIN keys ON k = keyword GROUP BY keyword",
    "length_stats": f"WITH {TERMS}, l AS (SELECT count(*) AS l FROM term GROUP BY id) SELECT count(*) AS n, CAST(min(l) AS INT) AS shortest, quantile_cont(l, 0.5) AS median, round(avg(l), 2) AS mean, CAST(max(l) AS INT) AS longest, count(*) FILTER (l < 8) AS below_8 FROM l",
    "name_flags": "SELECT count(*) FILTER (NOT coalesce(len(terms) > 0, false) AND contains(lower(name), 'allocated')) AS allocated, count(*) FILTER (len(terms) > 0 AND contains(lower(name), 'duplicate of')) AS duplicates FROM corpus",
    "program_coverage": f"WITH {NODES}, c AS (SELECT count(*) AS nodes, count(*) FILTER (id IN (SELECT program FROM relations)) AS covered FROM nodes) SELECT nodes, covered, round(covered / nodes, 4) AS share FROM c",
    "relation_sizes": "SELECT count(DISTINCT program) AS programs, count(*) AS relations, (SELECT count(*) FROM (SELECT DISTINCT least(program, calls), greatest(program, calls) FROM relations WHERE program <> calls)) AS pairs FROM relations WHERE program IS NOT NULL AND calls IS NOT NULL",
    "known_pairs": f"WITH {KNOWN} SELECT u, v FROM known",
    "novel_negatives": f"WITH {KNOWN} SELECT DISTINCT u, v, split FROM splits s WHERE label = 0 AND u IS NOT NULL AND v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.u = least(s.u, s.v) AND k.v = greatest(s.u, s.v))",
}
