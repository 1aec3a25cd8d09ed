"""Round trips of the given tables through every sink and scan, over files in the shared folder."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from termloom.functions.ids import format_id
from termloom.operators import audit, catalog, graph, stratify
from termloom.plans import graph_queries, text_queries
from termloom.session import scratch, table
from termloom.sources import dumps, sinks


def _terms_file(s, d):
    """Corpus written as lines of a term list, stored spellings and all, and scanned."""
    at = scratch(s, "terms")
    terms = F.array_join(F.coalesce(F.col("terms"), F.array().cast("array<string>")), ",", "")
    lines = table(s, d, "corpus").filter("a_number is not null").select(
        F.concat(format_id(F.col("a_number")), F.lit(" ,"), terms, F.lit(",")).alias("value")
    )
    lines.write.option("compression", "gzip").text(at)
    return dumps.read_terms(s, at + "/*.gz").select(
        "a_number", F.size("terms").alias("n"), F.array_join("terms", ",").alias("terms")
    )


def _names_file(s, d):
    at = scratch(s, "names")
    table(s, d, "corpus").filter("a_number is not null and name is not null").select(
        F.concat(format_id(F.col("a_number")), F.lit(" "), "name").alias("value")
    ).write.text(at)
    return dumps.read_names(s, at)


def _json_lines(s, d):
    at = scratch(s, "corpus-json")
    sinks.write_json_lines(graph_queries.catalog_rows(s, d), at)
    return s.read.schema("a_number int, terms array<string>, name string, xrefs array<int>, dead boolean").json(at).select(
        "a_number",
        F.size("terms").alias("n_terms"),
        F.array_join("terms", ",").alias("terms"),
        "name",
        F.array_join("xrefs", ",").alias("xrefs"),
        "dead"
    )


def _audit_files(s, d):
    """The audit sample as blind CSV and key, its rows in seeded order, read again and joined."""
    at = scratch(s, "audit")
    sample = audit.audit_sample(
        table(s, d, "xrefs"), graph.universe(table(s, d, "corpus")), stratify.names_of(table(s, d, "corpus"))
    )
    sinks.write_blind_audit(sample, at)
    back = dumps.read_audit(s, f"{at}/blind", f"{at}/key")
    texts = ("paren", "raw_text", "name_source", "name_target", "hand_label")
    return back.select(
        "u", "v", "source", "target", "stratum", "link_type", *(F.coalesce(c, F.lit("")).alias(c) for c in texts)
    )


def _kept_table(s, d):
    """A table that is there already is kept, unless it is forced; partitions by a column come back."""
    at = scratch(s, "table")
    xrefs = table(s, d, "xrefs").filter("source is not null").select(
        "source", "target", "y_line_idx", F.coalesce("link_type", F.lit("none")).alias("link_type")
    )
    sinks.write_table(xrefs.limit(0), at, partition_by=["link_type"])
    sinks.write_table(xrefs, at, force=True, partition_by=["link_type"])
    sinks.write_table(xrefs.limit(1), at, partition_by=["link_type"])
    return (
        s.read.schema(xrefs.schema)  # without rows there is no file that tells it
        .parquet(at)
        .select("source", "target", "y_line_idx", "link_type")
        .groupBy("source", "target", "y_line_idx", "link_type")
        .agg(F.count("*").alias("n"))
    )


def _id_list(s, d):
    at = scratch(s, "ids")
    sinks.write_id_list(table(s, d, "relations").select(F.col("program").alias("id")).filter("id is not null"), at)
    return s.read.text(at).select(F.col("value").alias("label"))


def _report(s, d):
    """Mention counts as a JSON report, read again; the gate lets the reader on once the report is there."""
    at = scratch(s, "report") + "/report.json"
    sinks.write_report(s, at, {"mentions": graph.mention_counts(table(s, d, "xrefs")).first().asDict()})
    sinks.write_report(s, at, {}, force=False)
    sinks.require(s, at)
    kind = (
        "mentions struct<stored bigint, self_mentions bigint, open_ended bigint, usable bigint, directed bigint, undirected bigint, symmetric bigint, asymmetric bigint>"
    )
    return s.read.schema(kind).json(at, multiLine=True).select("mentions.*")


def _markdown(s, d):
    """Counts of keywords as a Markdown report, line by line."""
    at = scratch(s, "markdown") + "/report.md"
    rows = [r.asDict() for r in catalog.keyword_counts(table(s, d, "seq_meta")).orderBy("keyword").collect()]
    sinks.write_text(s, at, sinks.markdown({"keywords": rows}, "Statistics"))
    return s.read.text(at).filter("value <> ''").select(F.col("value").alias("line"))


def _log(s, d):
    """Two entries of a log, without their stamps."""
    at = scratch(s, "log")
    for name in ("corpus", "xrefs"):
        sinks.append_log(s, at, f"{name} {table(s, d, name).count()}")
    return s.read.text(at).select(F.regexp_replace("value", r"^\S+ ", "").alias("line"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a batch as one compressed tar, its members named by their ids."""
    for b in batches:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = text.encode("utf-8")
                info = tarfile.TarInfo(f"seq/{name[:4]}/{name}.seq")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["content"])


def _archives(s, d):
    """Entries with the names of corpus, packed into tars by task and taken out again."""
    rows = table(s, d, "corpus").filter("a_number is not null").select(
        format_id(F.col("a_number")).alias("name"), F.concat(F.lit("%N "), F.coalesce("name", F.lit("-"))).alias("text")
    )
    return dumps.archive_members(rows.mapInArrow(_packed, "content binary"))


def _bfiles(s, d):
    """A listing of a tree in which every sequence has a folder and those of even id a b-file."""
    ids = table(s, d, "corpus").filter("a_number is not null")
    even = F.col("a_number") % 2 == 0
    path = F.concat(
        F.lit("files/"),
        format_id(F.col("a_number")),
        F.lit("/"),
        F.when(even, "b").otherwise("a"),
        F.format_string("%06d", "a_number"),
        F.lit(".txt")
    )
    return dumps.listed_ids(
        ids.select(path.alias("path")).unionByName(ids.select(F.concat(path, F.lit(".bak")).alias("path")))
    )


QUERIES = {
    "term_file_scan": _terms_file,
    "name_file_scan": _names_file,
    "json_lines_round_trip": _json_lines,
    "audit_round_trip": _audit_files,
    "table_round_trip": _kept_table,
    "id_list_round_trip": _id_list,
    "report_round_trip": _report,
    "markdown_report": _markdown,
    "log_round_trip": _log,
    "archive_scan": _archives,
    "bfile_listing": _bfiles,
}

_LABEL = "'A' || lpad(CAST({x} AS VARCHAR), CAST(greatest(6, length(CAST({x} AS VARCHAR))) AS INT), '0')"

SQL = {
    "term_file_scan": f"WITH {graph_queries.TERMS} SELECT a_number, CAST((SELECT count(*) FROM term WHERE term.id = a_number) AS INT) AS n, coalesce((SELECT string_agg(t, ',' ORDER BY i) FROM term WHERE term.id = a_number), '') AS terms FROM corpus WHERE a_number IS NOT NULL",
    "name_file_scan": "SELECT a_number, trim(name) AS name FROM corpus WHERE a_number IS NOT NULL AND name IS NOT NULL",
    "json_lines_round_trip": graph_queries.SQL["full_catalog"],
    "audit_round_trip": f"WITH {text_queries._SAMPLE} SELECT u, v, source, target, st AS stratum, link_type, coalesce(paren, '') AS paren, raw_text, coalesce(a.name, '') AS name_source, coalesce(b.name, '') AS name_target, '' AS hand_label FROM picked LEFT JOIN names a ON a.id = source LEFT JOIN names b ON b.id = target",
    "table_round_trip": "SELECT source, target, y_line_idx, coalesce(link_type, 'none') AS link_type, count(*) AS n FROM xrefs WHERE source IS NOT NULL GROUP BY ALL",
    "id_list_round_trip": f"SELECT DISTINCT {_LABEL.format(x='program')} AS label FROM relations WHERE program IS NOT NULL",
    "report_round_trip": graph_queries.SQL["mention_counts"],
    "markdown_report": f"""
WITH c AS ({graph_queries.SQL["keyword_counts"]})
SELECT '# Statistics' AS line UNION ALL SELECT '## keywords' UNION ALL SELECT '| keyword | n |' UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || keyword || ' | ' || n || ' |' FROM c
""",
    "log_round_trip": "SELECT 'corpus ' || count(*) AS line FROM corpus UNION ALL SELECT 'xrefs ' || count(*) FROM xrefs",
    "archive_scan": "SELECT a_number, '%N ' || coalesce(name, '-') AS text FROM corpus WHERE a_number IS NOT NULL",
    "bfile_listing": "SELECT DISTINCT a_number AS id FROM corpus WHERE a_number % 2 = 0",
}
