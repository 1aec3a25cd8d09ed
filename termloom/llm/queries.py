"""The queries of problems 2 to 8 and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.llm import components, leakage, mixing, passages, pieces, sets, spans
from termloom.session import materialize, table


def _p3(spark, d):
    return sets.similar_records(table(spark, d, "corpus"), table(spark, d, "submissions"))


def p3_found(spark, d):
    members, _, pairs = _p3(spark, d)
    return sets.record_pairs(members, pairs)


def p3_class_pairs(spark, d):
    _, classes, pairs = _p3(spark, d)
    rid = classes.select("cid", "rid")
    return (
        pairs.join(rid.withColumnsRenamed({"cid": "cid_1", "rid": "r1"}), "cid_1")
        .join(rid.withColumnsRenamed({"cid": "cid_2", "rid": "r2"}), "cid_2")
        .select(F.least("r1", "r2").alias("class_1"), F.greatest("r1", "r2").alias("class_2"), "overlap")
    )


def _p7(spark, d):
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p4_report(spark, d):
    splits, corpus = table(spark, d, "splits"), table(spark, d, "corpus")
    return leakage.overlap_report(splits, materialize(leakage.cross_split_overlaps(splits, corpus), "overlaps"))


QUERIES = {
    "p2_found": lambda spark, d: spans.run_pairs(table(spark, d, "corpus")),
    "p2_coverage": lambda spark, d: spans.coverage(table(spark, d, "corpus")).drop("runs"),
    "p2_runs": lambda spark, d: spans.record_runs(table(spark, d, "corpus")),
    "p2_classes": lambda spark, d: spans.record_classes(table(spark, d, "corpus")),
    "p2_records": lambda spark, d: spans.all_coverage(table(spark, d, "corpus")),
    "p3_found": p3_found,
    "p3_links": lambda spark, d: sets.links_per_record(*_p3(spark, d)),
    "p3_class_pairs": p3_class_pairs,
    "p4_found": lambda spark, d: leakage.cross_split_overlaps(
        table(spark, d, "splits"), table(spark, d, "corpus")
    ).select("split", "u", "v"),
    "p4_report": p4_report,
    "p5_found": lambda spark, d: components.tied_sequences(table(spark, d, "xrefs")),
    "p6_found": lambda spark, d: passages.leaked_items(
        table(spark, d, "documents"), table(spark, d, "eval_items")
    ).select("item_id", "doc_id"),
    "p6_leak_report": lambda spark, d: passages.leak_report(
        table(spark, d, "documents"), table(spark, d, "eval_items")
    ),
    "p7_found": lambda spark, d: _p7(spark, d).fitted().filter("below_target").select("source"),
    "p7_mix_report": lambda spark, d: _p7(spark, d).report(),
    "p7_mix_documents": lambda spark, d: _p7(spark, d).documents(),
    "p8_found": lambda spark, d: pieces.long_pieces(table(spark, d, "documents"))
    .filter("piece = 0")
    .select("doc_id")
    .distinct(),
    "p8_pieces": lambda spark, d: pieces.long_pieces(table(spark, d, "documents")),
}

# the clean terms of a record, in order: (id, i, t)
_TERMS = r"""
 raw AS (SELECT CAST(a_number AS BIGINT) AS id, 0 AS k, generate_subscripts(terms, 1) AS i, unnest(terms) AS t FROM corpus {more}),
 cut AS (SELECT id, k, i, regexp_extract(t, '^\s*([+-]?)0*([0-9]+)\s*$', 1) AS s, regexp_extract(t, '^\s*([+-]?)0*([0-9]+)\s*$', 2) AS g FROM raw WHERE regexp_matches(t, '^\s*[+-]?[0-9]+\s*$')),
 term AS (SELECT id, k, i, CASE WHEN s = '-' AND g <> '0' THEN '-' || g ELSE g END AS t FROM cut)
"""
_BOTH = (
    " UNION ALL SELECT sub_id, 1, generate_subscripts(terms, 1), unnest(terms) FROM (SELECT DISTINCT sub_id, terms FROM submissions)"
)

_NEAR = """
 tset AS (SELECT DISTINCT id, t FROM term),
 sz AS (SELECT id, count(*) AS n FROM tset GROUP BY id HAVING count(*) >= 8),
 big AS (SELECT id, t, n FROM tset JOIN sz USING (id)),
 near AS (SELECT a.id AS id_1, b.id AS id_2, count(*) AS overlap FROM big a JOIN big b ON a.t = b.t AND a.id < b.id
          GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 10 >= 6 * (a.n + b.n - count(*)))
"""

_SEQ = """
 seq AS (SELECT id, list(t ORDER BY i) AS s FROM term GROUP BY id HAVING count(*) >= 12),
 gram AS (SELECT id, p, list_slice(s, p, p + 11) AS g FROM (SELECT id, s, unnest(range(1, len(s) - 10)) AS p FROM seq))
"""

_HELD = """
 ends AS (SELECT DISTINCT lower(trim(split)) AS split, CAST(least(u, v) AS BIGINT) AS u, CAST(greatest(u, v) AS BIGINT) AS v FROM splits WHERE u IS NOT NULL AND v IS NOT NULL),
 train AS (SELECT u, v FROM ends WHERE split = 'train'),
 held AS (SELECT * FROM ends WHERE split IN ('val', 'test')),
 around AS (SELECT id_1 AS a, id_2 AS b FROM near UNION SELECT id_2, id_1 FROM near UNION SELECT u, u FROM held UNION SELECT v, v FROM held),
 hit AS (SELECT DISTINCT h.split, h.u, h.v FROM held h JOIN around x ON x.a = h.u JOIN around y ON y.a = h.v
         JOIN train t ON (t.u = x.b AND t.v = y.b) OR (t.u = y.b AND t.v = x.b))
"""

# maximal runs between the first records of the classes, smaller first
_RUNS = """
 class AS (SELECT id, s, len(s) AS n, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM seq),
 rep AS (SELECT gram.* FROM gram JOIN class USING (id) WHERE id = class_id),
 hit AS (SELECT a.id AS a, b.id AS b, a.p, b.p - a.p AS d FROM rep a JOIN rep b ON a.g = b.g AND a.id < b.id),
 isle AS (SELECT *, p - row_number() OVER (PARTITION BY a, b, d ORDER BY p) AS k FROM hit),
 run AS (SELECT a, b, min(p) - 1 AS s1, min(p) - 1 + d AS s2, count(*) + 11 AS n FROM isle GROUP BY a, b, d, k)
"""

# texts in one form: full-width letters and digits, ligatures and invisible characters are those that the tables hold
_WIDE, _NARROW = ("".join(chr(c + up) for c in range(0x21, 0x7F)).replace("'", "''") for up in (0xFEE0, 0))
_INVISIBLE = r"\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}"

# the first words i of an item's runs of 15 words that stand in a document between word boundaries: (item_id, doc_id, i)
_LEAKS = rf"""
 _whole AS (SELECT 'd' AS kind, CAST(doc_id AS BIGINT) AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT DISTINCT 'i', CAST(item_id AS BIGINT), text FROM eval_items),
 _plain AS (SELECT kind, id, replace(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g'), '&nbsp;', ' ') AS x FROM _whole WHERE text IS NOT NULL),
 _form AS (SELECT kind, id, nfc_normalize(replace(replace(replace(replace(lower(translate(regexp_replace(x, '[{_INVISIBLE}]', '', 'g'), '{_WIDE}²³¹', '{_NARROW}231')), 'ß', 'ss'), 'ﬃ', 'ffi'), 'ﬁ', 'fi'), 'ﬂ', 'fl')) AS x FROM _plain),
 _list AS (SELECT kind, id, regexp_extract_all(x, '[\p{{L}}\p{{N}}]+') AS w FROM _form),
 _word AS (SELECT kind, id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM _list),
 _place AS (SELECT kind, id, i, CAST(sum(length(t)) OVER (PARTITION BY kind, id ORDER BY i) AS BIGINT) AS e, length(t) AS n,
            left(string_agg(t, '') OVER (PARTITION BY kind, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING), 15) AS h FROM _word),
 pattern AS (SELECT DISTINCT id AS item_id, i, array_to_string(list_slice(w, i, i + 14), '') AS p FROM (SELECT id, w, unnest(range(1, len(w) - 13)) AS i FROM _list WHERE kind = 'i')),
 stream AS (SELECT id AS doc_id, array_to_string(w, '') AS s FROM _list WHERE kind = 'd'),
 head AS (SELECT id AS doc_id, e - n AS b, h FROM _place WHERE kind = 'd'),
 hit AS (SELECT item_id, doc_id, i, b, length(p) AS n FROM pattern JOIN head ON h = left(p, 15) JOIN stream USING (doc_id) WHERE substr(s, b + 1, length(p)) = p),
 held AS (SELECT DISTINCT item_id, hit.doc_id, hit.i FROM hit JOIN _place ON kind = 'd' AND _place.id = hit.doc_id AND e = hit.b + hit.n)
"""

SQL = {
    "p2_runs": f"WITH {_TERMS.format(more='')}, {_SEQ}, {_RUNS} SELECT a AS class_1, b AS class_2, CAST(s1 AS INT) AS start_1, CAST(s2 AS INT) AS start_2, CAST(n AS INT) AS len FROM run",
    "p2_classes": f"WITH {_TERMS.format(more='')}, {_SEQ} SELECT id AS a_number, min(id) OVER (PARTITION BY s) AS class_id FROM seq",
    # texts are far from the limit: those above it have over 26,000 bytes, the others less than 7,000
    "p8_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 4 * 4096",
    "p2_found": f"""
WITH {_TERMS.format(more='')}, {_SEQ}
SELECT DISTINCT a.id AS a_number_1, b.id AS a_number_2 FROM gram a JOIN gram b ON a.g = b.g AND a.id < b.id
""",
    "p2_coverage": f"""
WITH {_TERMS.format(more='')}, {_SEQ},
 class AS (SELECT id, s, len(s) AS n, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM seq),
 link AS (SELECT DISTINCT a.id, a.p, b.id AS o FROM gram a JOIN gram b ON a.g = b.g AND a.id <> b.id),
 par AS (SELECT id, count(DISTINCT o) AS partners FROM link GROUP BY id),
 cov AS (SELECT id, count(DISTINCT q) AS covered FROM (SELECT id, unnest(range(p, p + 12)) AS q FROM (SELECT DISTINCT id, p FROM link)) GROUP BY id)
SELECT id AS a_number, class_id, n AS n_terms, copies, coalesce(partners, 0) AS partners, coalesce(covered, 0) AS covered
FROM class LEFT JOIN par USING (id) LEFT JOIN cov USING (id)
""",
    "p2_records": f"""
WITH {_TERMS.format(more='')}, {_SEQ}, {_RUNS},
 link AS (SELECT DISTINCT a.id, a.p, b.id AS o FROM gram a JOIN gram b ON a.g = b.g AND a.id <> b.id),
 par AS (SELECT id, count(DISTINCT o) AS partners FROM link GROUP BY id),
 cov AS (SELECT id, count(DISTINCT q) AS covered FROM (SELECT id, unnest(range(p, p + 12)) AS q FROM (SELECT DISTINCT id, p FROM link)) GROUP BY id),
 places AS (SELECT class_id, count(*) AS runs FROM (SELECT a AS class_id, s1, n FROM run UNION SELECT b, s2, n FROM run) GROUP BY class_id),
 sizes AS (SELECT corpus.a_number AS id, count(t) AS n FROM corpus LEFT JOIN term ON term.id = corpus.a_number WHERE corpus.a_number IS NOT NULL GROUP BY ALL)
SELECT sizes.id AS a_number, class_id, CAST(sizes.n AS INT) AS n_terms, coalesce(copies, 0) AS copies, coalesce(partners, 0) AS partners, coalesce(runs, 0) AS runs, CAST(coalesce(covered, 0) AS INT) AS covered
FROM sizes LEFT JOIN class USING (id) LEFT JOIN par USING (id) LEFT JOIN cov USING (id) LEFT JOIN places USING (class_id)
""",
    "p3_found": f"WITH {_TERMS.format(more=_BOTH)}, {_NEAR} SELECT id_1, id_2 FROM near",
    "p3_links": f"""
WITH {_TERMS.format(more=_BOTH)}, {_NEAR},
 sets AS (SELECT id, n, list(t ORDER BY t) AS s FROM big GROUP BY id, n),
 class AS (SELECT id, n, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM sets),
 lk AS (SELECT id, count(*) AS links FROM (SELECT id_1 AS id FROM near UNION ALL SELECT id_2 FROM near) GROUP BY id)
SELECT id, class_id, n, copies, coalesce(links, 0) AS links FROM class LEFT JOIN lk USING (id)
""",
    "p3_class_pairs": f"""
WITH {_TERMS.format(more=_BOTH)}, {_NEAR},
 sets AS (SELECT id, list(t ORDER BY t) AS s FROM big GROUP BY id),
 class AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM sets)
SELECT id_1 AS class_1, id_2 AS class_2, overlap FROM near JOIN class a ON a.id = id_1 AND a.class_id = id_1 JOIN class b ON b.id = id_2 AND b.class_id = id_2
""",
    "p4_found": f"WITH {_TERMS.format(more='')}, {_NEAR}, {_HELD} SELECT split, u, v FROM hit",
    "p4_report": f"""
WITH {_TERMS.format(more='')}, {_NEAR}, {_HELD},
 marked AS (SELECT h.*, EXISTS (SELECT 1 FROM train t WHERE t.u = h.u AND t.v = h.v) AS exact FROM hit h),
 strata AS (SELECT DISTINCT lower(trim(split)) AS split, CAST(least(u, v) AS BIGINT) AS u, CAST(greatest(u, v) AS BIGINT) AS v, coalesce(lower(trim(stratum)), '(none)') AS stratum
            FROM splits WHERE u IS NOT NULL AND v IS NOT NULL AND lower(trim(split)) IN ('val', 'test'))
SELECT split, stratum, count(*) AS pairs, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT exact) AS near FROM strata LEFT JOIN marked USING (split, u, v) GROUP BY split, stratum
""",
    "p5_found": """
WITH RECURSIVE e AS (SELECT DISTINCT CAST(source AS BIGINT) AS a, CAST(target AS BIGINT) AS b FROM xrefs WHERE lower(trim(stratum)) = 's1' AND source <> target),
 tie AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT a AS id, a AS r FROM tie UNION SELECT tie.b, reach.r FROM reach JOIN tie ON tie.a = reach.id WHERE reach.r < tie.b)
SELECT min(r) AS group_id, id AS a_number FROM (SELECT id, r FROM reach UNION SELECT a, a FROM tie) GROUP BY id
""",
    "p6_found": f"WITH {_LEAKS} SELECT DISTINCT item_id, doc_id FROM held",
    "p6_leak_report": f"""
WITH {_LEAKS},
 words AS (SELECT item_id, doc_id, count(DISTINCT k) AS n FROM (SELECT item_id, doc_id, unnest(range(i, i + 15)) AS k FROM held) GROUP BY ALL),
 per AS (SELECT item_id, count(*) AS documents, max(n) AS most_words FROM words GROUP BY item_id)
SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, split, kind, coalesce(documents, 0) AS documents, CAST(coalesce(most_words, 0) AS INT) AS most_words FROM eval_items LEFT JOIN per USING (item_id)
""",
    # sizes in bytes: every usual tokenizer gives the same sources, and so do bytes
    "p7_found": r"""
WITH t AS (SELECT source, regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS k, target_share, max_repeats FROM mix_targets),
 d AS (SELECT regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS k, sum(strlen(text)) AS n FROM documents GROUP BY 1)
SELECT source FROM t LEFT JOIN d USING (k) WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(strlen(text)) FROM documents)
""",
}
