"""Extraction from cross-reference lines, line types, and strata by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import ids, text
from termloom.operators import audit, graph, stratify
from termloom.session import table

LINE = ["source", "raw_text"]


def _lines(s, d):
    return table(s, d, "xrefs").filter("source is not null and raw_text is not null").select(*LINE).distinct()


def _mentions(s, d):
    return (
        table(s, d, "xrefs")
        .filter("source is not null and raw_text is not null")
        .select("source", "target", "raw_text", "paren")
        .distinct()
    )


def _strata(version):
    def run(s, d):
        corpus, meta = table(s, d, "corpus"), table(s, d, "seq_meta")
        rule = stratify.stratum_v1 if version else stratify.stratum_v0
        return rule(_mentions(s, d).filter("target is not null and source <> target"), stratify.names_of(corpus), meta)

    return run


def _confusion(s, d):
    given = (
        table(s, d, "xrefs")
        .filter("source <> target")
        .select("source", "target", "raw_text", "paren", F.lower(F.trim("stratum")).alias("given"))
        .filter("given is not null and raw_text is not null")
    )
    corpus, meta = table(s, d, "corpus"), table(s, d, "seq_meta")
    rated = stratify.stratum_v1(given, stratify.names_of(corpus), meta)
    return audit.confusion(rated, "given", "stratum_v1", ["s1", "s2", "s3", "s4"])


def _precision(s, d):
    corpus, meta, xrefs = table(s, d, "corpus"), table(s, d, "seq_meta"), table(s, d, "xrefs")
    sample = audit.audit_sample(xrefs, graph.universe(corpus), stratify.names_of(corpus))
    rated = stratify.stratum_v1(
        sample.drop("hand_label"), stratify.names_of(corpus), meta
    ).withColumn("hand_label", F.col("stratum_v1"))
    return audit.precision_report(rated)


def _split_precision(s, d):
    """The strongest stratum of each pair of xrefs, judged by the labels that the stored splits have for the pair."""
    stored = table(s, d, "splits").filter("label = 1").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("stratum").alias("hand_label")
    ).distinct()
    return audit.precision_report(
        graph.pair_table(table(s, d, "xrefs")).filter("stratum is not null").join(stored, ["u", "v"])
    )


def _names(s, d):
    return stratify.names_of(table(s, d, "corpus"))


QUERIES = {
    "mention_extract": lambda s, d: stratify.line_mentions(_lines(s, d))
    .groupBy("source", "target", "paren")
    .agg(F.count("*").alias("n")),
    "targets_per_line": lambda s, d: _lines(s, d).select(
        "source",
        "raw_text",
        F.size(F.filter(text.mentions(F.col("raw_text")), lambda m: m["target"] != F.col("source"))).alias("n")
    ),
    "line_types": lambda s, d: _lines(s, d)
    .groupBy(text.line_type(F.col("raw_text")).alias("line_type"))
    .agg(F.count("*").alias("n")),
    "strip_parens": lambda s, d: _lines(s, d)
    .select("raw_text", text.strip_parens(F.col("raw_text")).alias("bare"))
    .distinct(),
    "sentences": lambda s, d: _lines(s, d)
    .select("raw_text", F.posexplode(text.sentences(F.col("raw_text"))).alias("i", "sentence"))
    .distinct(),
    "line_cues": lambda s, d: _lines(s, d)
    .select("source", "raw_text", text.line_cues(F.col("source"), F.col("raw_text")).alias("c"))
    .select(
        "source",
        "raw_text",
        F.array_join(F.array_sort("c.s1"), ",").alias("s1"),
        F.array_join(F.array_sort("c.s2"), ",").alias("s2")
    ),
    "duplicate_names": lambda s, d: stratify.duplicate_of(_names(s, d)),
    "name_references": lambda s, d: stratify.name_references(_names(s, d)),
    "constants_v0": lambda s, d: stratify.constant_like(_names(s, d), table(s, d, "seq_meta"), 0),
    "constants_v1": lambda s, d: stratify.constant_like(_names(s, d), table(s, d, "seq_meta"), 1),
    "stratum_v0": _strata(0),
    "stratum_v1": _strata(1),
    "id_round_trip": lambda s, d: table(s, d, "corpus")
    .select("a_number", ids.format_id(F.col("a_number")).alias("label"))
    .withColumn("parsed", ids.parse_id(F.concat(F.lit(" "), F.col("label")))),
    "audit_sample": lambda s, d: audit.audit_sample(
        table(s, d, "xrefs"), graph.universe(table(s, d, "corpus")), _names(s, d)
    ),
    "audit_precision": _precision,
    "split_precision": _split_precision,
    "confusion": _confusion,
}

_LINES = " lines AS (SELECT DISTINCT source, raw_text FROM xrefs WHERE source IS NOT NULL AND raw_text IS NOT NULL)"
# a parenthesis that names an identifier is bracketed first, which stands for the lookahead
_M = r"""
 found AS (SELECT source, raw_text, unnest(regexp_extract_all(x, 'A\d{6,7}(?:\s*\([^()]{1,120}\))?')) AS m FROM (SELECT *, regexp_replace(raw_text, '\(([^()]*A\d{6}[^()]*)\)', '[\1]', 'g') AS x FROM lines)),
 ment AS (SELECT source, raw_text, CAST(regexp_extract(m, 'A(\d{6,7})', 1) AS INT) AS target, coalesce(regexp_extract(m, '\(([^()]*)\)', 1), '') AS paren FROM found)
"""


def _bare(x: str) -> str:
    for _ in range(3):
        x = rf"regexp_replace({x}, '\([^()]*\)', ' ', 'g')"
    return x


def _all(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, 'A(\d{{6,7}})', 1), lambda y: CAST(y AS INT))"


def _has(x: str, p: str) -> str:
    return f"regexp_matches({x}, '{p}', 'i')"


_TYPE = (
    f"CASE WHEN {_has('raw_text', text.S1_CUE)} THEN 'duplicate' WHEN {_has('raw_text', text.S2_CUE_V0)} THEN 'transform' WHEN {_has('raw_text', '^cf' + chr(92) + 'b')} THEN 'Cf.' WHEN {_has('raw_text', '^see also' + chr(92) + 'b')} THEN 'See also' ELSE 'other' END"
)
_SENT = (
    rf" sent AS (SELECT source, raw_text, unnest(list_filter(string_split(regexp_replace(raw_text, '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentence FROM lines)"
)
_NAMES = (
    " names AS (SELECT a_number AS id, min(name) AS name FROM corpus WHERE a_number IS NOT NULL AND name IS NOT NULL GROUP BY 1)"
)
_DUP = (
    f" dup AS (SELECT id, CAST(regexp_extract(name, '{text.DUPLICATE_NAME}', 1, 'i') AS INT) AS ref FROM names WHERE regexp_matches(name, '{text.DUPLICATE_NAME}', 'i'))"
)
_REF = (
    f" nref AS (SELECT DISTINCT id AS holder, CAST(unnest(regexp_extract_all(name, '{text.NAME_TRANSFORM}', 1, 'i')) AS INT) AS ref FROM names)"
)
_KW = (
    " kw AS (SELECT a_number AS id, list_transform(string_split(coalesce(keywords, ''), ','), lambda k: trim(k)) AS k FROM seq_meta WHERE a_number IS NOT NULL)"
)
_C0 = (
    f" c0 AS (SELECT id FROM names WHERE {_has('name', text.CONSTANT_NAME_V0)} UNION SELECT id FROM kw WHERE list_contains(k, 'cons'))"
)
_C1 = (
    f" c1 AS (SELECT id FROM names WHERE {_has('name', text.CONSTANT_NAME_V1)} UNION SELECT id FROM kw WHERE list_contains(k, 'cons') AND NOT list_contains(k, 'core'))"
)
_CUES = f"""
 bare AS (SELECT source, raw_text, {_bare('sentence')} AS b FROM sent),
 part AS (SELECT source, raw_text, b, {_all('b')} AS ids FROM bare),
 s1 AS (SELECT source, raw_text, unnest(list_transform(regexp_extract_all({_bare('raw_text')}, '{text.S1_DIRECT}', 1, 'i'), lambda y: CAST(y AS INT))) AS t FROM lines WHERE {_has('raw_text', text.S1_CUE)}
        UNION SELECT source, raw_text, unnest(ids) FROM part WHERE {_has('raw_text', text.S1_CUE)} AND {_has('b', text.S1_CLUSTER)}),
 s2 AS (SELECT DISTINCT source, raw_text, list_filter(list_distinct(ids), lambda y: y <> source)[1] AS t FROM part
        WHERE {_has('raw_text', text.S2_CUE_V1)} AND {_has('b', text.S2_CUE_V1)} AND len(list_filter(list_distinct(ids), lambda y: y <> source)) = 1)
"""
_MENT = (
    " mm AS (SELECT DISTINCT source, target, raw_text, paren FROM xrefs WHERE raw_text IS NOT NULL AND source <> target)"
)
_DUPED = (
    "EXISTS (SELECT 1 FROM dup WHERE (dup.id = mm.source AND dup.ref = mm.target) OR (dup.id = mm.target AND dup.ref = mm.source))"
)
_V1 = f"""
 {_LINES}, {_SENT}, {_CUES}, {_NAMES}, {_DUP}, {_REF}, {_KW}, {_C1},
 v1 AS (SELECT mm.*, CASE WHEN {_DUPED} OR {_has("coalesce(paren, '')", text.S1_CUE)} OR EXISTS (SELECT 1 FROM s1 WHERE s1.source = mm.source AND s1.raw_text = mm.raw_text AND s1.t = mm.target) THEN 's1'
  WHEN {_has("coalesce(paren, '')", text.S2_CUE_V1)} OR EXISTS (SELECT 1 FROM nref WHERE (holder = mm.source AND ref = mm.target) OR (holder = mm.target AND ref = mm.source)) THEN 's2'
  WHEN mm.source IN (SELECT id FROM c1) OR mm.target IN (SELECT id FROM c1) THEN 's4'
  WHEN EXISTS (SELECT 1 FROM s2 WHERE s2.source = mm.source AND s2.raw_text = mm.raw_text AND s2.t = mm.target) THEN 's2' ELSE 's3' END AS stratum_v1 FROM mm)
"""
_RANK = "CASE lower(trim(stratum)) WHEN 's1' THEN 0 WHEN 's2' THEN 1 WHEN 's4' THEN 2 WHEN 's3' THEN 3 END"
_SAMPLE = f"""
 {_NAMES}, nodes AS (SELECT DISTINCT a_number AS id FROM corpus WHERE len(terms) > 0),
 cand AS (SELECT *, {_RANK} AS r, least(source, target) AS u, greatest(source, target) AS v FROM xrefs WHERE source <> target AND {_RANK} IS NOT NULL AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
 rep AS (SELECT *, lower(trim(stratum)) AS st FROM cand QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY r, source, y_line_idx NULLS FIRST, sync_id NULLS FIRST, raw_text NULLS FIRST, paren NULLS FIRST, link_type NULLS FIRST) = 1),
 picked AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY st ORDER BY md5('42|' || u || '|' || v), u, v) <= 25)
"""

SQL = {
    "mention_extract": f"WITH {_LINES}, {_M} SELECT source, target, paren, count(*) AS n FROM ment WHERE source <> target GROUP BY ALL",
    "targets_per_line": f"WITH {_LINES}, {_M} SELECT source, raw_text, CAST((SELECT count(*) FROM ment WHERE ment.source = lines.source AND ment.raw_text = lines.raw_text AND target <> lines.source) AS INT) AS n FROM lines",
    "line_types": f"WITH {_LINES} SELECT {_TYPE} AS line_type, count(*) AS n FROM lines GROUP BY 1",
    "strip_parens": f"WITH {_LINES} SELECT DISTINCT raw_text, {_bare('raw_text')} AS bare FROM lines",
    "sentences": r"WITH l AS (SELECT DISTINCT raw_text, list_filter(string_split(regexp_replace(raw_text, '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS s FROM xrefs WHERE source IS NOT NULL AND raw_text IS NOT NULL) SELECT raw_text, CAST(generate_subscripts(s, 1) - 1 AS INT) AS i, unnest(s) AS sentence FROM l",
    "line_cues": f"WITH {_LINES}, {_SENT}, {_CUES} SELECT source, raw_text, coalesce((SELECT string_agg(DISTINCT CAST(t AS VARCHAR), ',' ORDER BY t) FROM (SELECT DISTINCT source, raw_text, t FROM s1) s1 WHERE s1.source = lines.source AND s1.raw_text = lines.raw_text), '') AS s1, coalesce((SELECT string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FROM s2 WHERE s2.source = lines.source AND s2.raw_text = lines.raw_text), '') AS s2 FROM lines".replace("string_agg(DISTINCT CAST", "string_agg(CAST"),
    "duplicate_names": f"WITH {_NAMES}, {_DUP} SELECT id AS a_number, ref FROM dup",
    "name_references": f"WITH {_NAMES}, {_REF} SELECT holder, ref FROM nref",
    "constants_v0": f"WITH {_NAMES}, {_KW}, {_C0} SELECT id FROM c0",
    "constants_v1": f"WITH {_NAMES}, {_KW}, {_C1} SELECT id FROM c1",
    "stratum_v0": f"""
WITH {_MENT}, {_LINES}, {_M}, {_NAMES}, {_DUP}, {_KW}, {_C0},
 lt AS (SELECT source, raw_text, {_TYPE} AS lt, (SELECT count(*) FROM ment WHERE ment.source = lines.source AND ment.raw_text = lines.raw_text AND target <> lines.source) AS n FROM lines)
SELECT mm.*, CASE WHEN lt = 'duplicate' OR {_has("coalesce(paren, '')", text.S1_CUE)} OR {_DUPED} THEN 's1' WHEN {_has("coalesce(paren, '')", text.S2_CUE_V0)} THEN 's2'
 WHEN mm.source IN (SELECT id FROM c0) OR mm.target IN (SELECT id FROM c0) THEN 's4' WHEN lt = 'transform' AND n <= 3 THEN 's2' ELSE 's3' END AS stratum_v0
FROM mm JOIN lt ON lt.source = mm.source AND lt.raw_text = mm.raw_text
""",
    "stratum_v1": f"WITH {_MENT}, {_V1} SELECT * FROM v1",
    "id_round_trip": "SELECT a_number, 'A' || lpad(CAST(a_number AS VARCHAR), CAST(greatest(6, length(CAST(a_number AS VARCHAR))) AS INT), '0') AS label, a_number AS parsed FROM corpus",
    "audit_sample": f"WITH {_SAMPLE} SELECT u, v, source, target, st AS stratum, link_type, paren, raw_text, coalesce(a.name, '') AS name_source, coalesce(b.name, '') AS name_target, '' AS hand_label FROM picked LEFT JOIN names a ON a.id = source LEFT JOIN names b ON b.id = target",
    "audit_precision": f"""
WITH {_SAMPLE}, mm AS (SELECT source, target, raw_text, paren, st FROM picked), {_V1.replace(_NAMES + ',', '')}
SELECT st AS stratum, CAST(count(*) FILTER (stratum_v1 = st) AS BIGINT) AS correct, count(*) AS n, round(count(*) FILTER (stratum_v1 = st) / count(*), 4) AS precision FROM v1 GROUP BY st
""",
    "split_precision": f"""
WITH p AS (SELECT least(source, target) AS u, greatest(source, target) AS v, min({_RANK}) AS r FROM xrefs WHERE source <> target GROUP BY 1, 2 HAVING min({_RANK}) IS NOT NULL),
 h AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v, stratum AS hand FROM splits WHERE label = 1),
 j AS (SELECT ['s1', 's2', 's4', 's3'][r + 1] AS stratum, lower(trim(hand)) AS hand FROM p JOIN h USING (u, v) WHERE trim(hand) <> '')
SELECT stratum, count(*) FILTER (hand = stratum) AS correct, count(*) AS n, round(count(*) FILTER (hand = stratum) / count(*), 4) AS precision FROM j GROUP BY stratum
""",
    "confusion": f"""
WITH mm AS (SELECT source, target, raw_text, paren, lower(trim(stratum)) AS given FROM xrefs WHERE source <> target AND stratum IS NOT NULL AND raw_text IS NOT NULL), {_V1}
SELECT given, count(*) FILTER (stratum_v1 = 's1') AS s1, count(*) FILTER (stratum_v1 = 's2') AS s2, count(*) FILTER (stratum_v1 = 's3') AS s3, count(*) FILTER (stratum_v1 = 's4') AS s4 FROM v1 GROUP BY given
""",
}
