"""Scans and round trips: entries rebuilt from mentions, texts parsed back, and the statistics document."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.ids import format_id
from termloom.operators import stats
from termloom.plans import graph_queries, split_queries
from termloom.plans.text_queries import _M as MENTIONS
from termloom.plans.text_queries import _TYPE as LINE_TYPE
from termloom.session import table
from termloom.sources import dumps


def _entries(s, d):
    """One entry text for each sequence and sync of xrefs: at most as many distinct lines as y_line_idx can count."""
    lines = (
        table(s, d, "xrefs")
        .filter("source is not null and raw_text is not null")
        .select("source", "sync_id", "y_line_idx", "raw_text")
        .distinct()
    )
    line = F.concat(F.lit("%Y "), format_id(F.col("source")), F.lit(" "), "raw_text")
    texts = lines.groupBy("source", "sync_id").agg(
        F.array_sort(F.collect_list(F.struct("y_line_idx", line.alias("l")))).alias("x")
    )
    body = F.array_join(F.transform("x", lambda e: e["l"]), "\n")
    # a %K line for each distinct list of keywords that seq_meta has of the sequence
    stored = table(s, d, "seq_meta").filter("keywords is not null").select(
        F.col("a_number").alias("source"), "keywords"
    ).distinct()
    keys = stored.groupBy("source").agg(F.array_sort(F.collect_list("keywords")).alias("k"))
    name = format_id(F.col("source"))
    meta = F.array_join(F.transform("k", lambda k: F.concat(F.lit("\n%K "), name, F.lit(" "), k)), "")
    text = F.concat(F.lit("%I "), name, F.lit("\n"), body, F.coalesce(meta, F.lit("")))
    return texts.join(keys, "source", "left").select(F.col("source").alias("a_number"), text.alias("text"))


def _stats(s, d):
    return stats.statistics_table(
        stats.statistics(*(table(s, d, t) for t in ("corpus", "xrefs", "seq_meta", "relations"))), s
    )


def _calls(s, d):
    """Calls of programs, from one assembly text for each stored relation."""
    rel = table(s, d, "relations").filter("program is not null and calls is not null")
    return dumps.program_calls(
        rel.select("program", F.format_string("; seq $1,999\n  seq $1,%06d\n", "calls").alias("text"))
    )


QUERIES = {
    "entry_mentions": lambda s, d: dumps.entry_mentions(_entries(s, d))
    .groupBy("source", "target", "y_line_idx", "link_type", "paren", "raw_text")
    .agg(F.count("*").alias("n")),
    "entry_meta": lambda s, d: dumps.entry_meta(_entries(s, d)),
    "entry_references": lambda s, d: dumps.entry_references(_entries(s, d))
    .select("a_number", F.explode("xrefs").alias("ref"))
    .distinct(),
    "program_calls": _calls,
    "json_mentions": lambda s, d: dumps.json_mentions(
        table(s, d, "xrefs")
        .filter("source is not null")
        .select(F.col("source").alias("a_number"), F.to_json(F.struct("raw_text", "link_type")).alias("json_text"))
    ),
    "statistics": _stats,
}

# the line's place among all lines of its entry
_LINES = """
 l AS (SELECT DISTINCT source, sync_id, y_line_idx, raw_text FROM xrefs WHERE source IS NOT NULL AND raw_text IS NOT NULL),
 lines AS (SELECT source, sync_id, CAST(row_number() OVER (PARTITION BY source, sync_id ORDER BY y_line_idx NULLS FIRST, raw_text) - 1 AS SMALLINT) AS y_line_idx, trim(raw_text) AS raw_text FROM l)
"""
_L = (
    "SELECT DISTINCT source, sync_id, y_line_idx, raw_text FROM xrefs WHERE source IS NOT NULL AND raw_text IS NOT NULL"
)



def _part(section: str, sql: str, order: str = "") -> str:
    """The rows of a query as (section, item, value), numbered in an order."""
    place = f"row_number() OVER ({'ORDER BY ' + order if order else ''}) - 1"
    rows = f"SELECT {place} AS _i, COLUMNS(*) FROM ({sql})"
    texts = f"SELECT CAST(_i AS VARCHAR) AS _i, CAST(COLUMNS(* EXCLUDE (_i)) AS VARCHAR) FROM ({rows})"
    return (
        f"SELECT '{section}' AS section, lpad(_i, 3, '0') || '.' || item AS item, value FROM (UNPIVOT ({texts}) ON COLUMNS(* EXCLUDE (_i)) INTO NAME item VALUE value)"
    )


_G = graph_queries.SQL
_NODE_COUNTS = f"""
WITH {graph_queries.DEGREES}, {graph_queries.KEYS}, {graph_queries.DEAD}
SELECT count(*) AS with_terms, count(*) FILTER (und_deg = 0) AS isolated, (SELECT count(*) FROM dead) AS dead, (SELECT count(*) FROM ded WHERE source IN (SELECT id FROM dead) OR target IN (SELECT id FROM dead)) AS edges_touching_dead FROM deg
"""
_STATISTICS = " UNION ALL ".join([
    _part("mentions", _G["mention_counts"]),
    _part("link types", _G["link_type_counts"], "n DESC, link_type NULLS FIRST"),
    _part("strata", _G["stratum_counts"], "scope, stratum"),
    _part("degrees", _G["degree_summary"], "kind"),
    _part("nodes", _NODE_COUNTS),
    _part("lengths", _G["length_stats"]),
    _part("names", _G["name_flags"]),
    _part("keywords", _G["keyword_counts"], "keyword"),
    _part("relations", _G["relation_sizes"]),
    _part("program coverage", _G["program_coverage"]),
    _part("funnel", split_queries.SQL["split_funnel"]),
])

SQL = {
    "statistics": _STATISTICS,
    "entry_mentions": f"""
WITH {_LINES}, {MENTIONS.replace("SELECT source, raw_text,", "SELECT source, y_line_idx, raw_text,")}
SELECT source, target, y_line_idx, {LINE_TYPE} AS link_type, paren, raw_text, count(*) AS n FROM ment WHERE source <> target GROUP BY ALL
""",
    "entry_meta": f"""
WITH l AS ({_L}), k AS (SELECT a_number, string_agg(trim(keywords), ',' ORDER BY keywords) AS keywords FROM (SELECT DISTINCT a_number, keywords FROM seq_meta WHERE keywords IS NOT NULL) GROUP BY a_number)
SELECT source AS a_number, coalesce(any_value(keywords), '') AS keywords, CAST(count(*) AS SMALLINT) AS n_y_lines FROM l LEFT JOIN k ON a_number = source GROUP BY source, sync_id
""",
    "entry_references": f"WITH l AS ({_L}), r AS (SELECT DISTINCT source AS a_number, CAST(unnest(regexp_extract_all(raw_text, 'A([0-9]{{6,7}})', 1)) AS INT) AS ref FROM l) SELECT * FROM r WHERE a_number <> ref",
    "program_calls": "SELECT program, calls FROM relations WHERE program IS NOT NULL AND calls IS NOT NULL",
    "json_mentions": "SELECT DISTINCT source AS a_number, CAST(unnest(regexp_extract_all(raw_text, 'A([0-9]{6,7})', 1)) AS INT) AS ref FROM xrefs WHERE source IS NOT NULL",
}
