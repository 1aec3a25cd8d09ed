"""Scans of dumps: term and name lists, entry texts in folders or archives, programs, JSON documents, audit files.

Compressed text isn't splittable, so a scan of few files is spread over the cluster right after it; land dumps once as
Parquet and read that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.ids import all_ids, parse_id
from termloom.functions.terms import clean_terms
from termloom.sources import schemas


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    # one partition for each compressed file otherwise
    return (
        lines.repartition(spark.sparkContext.defaultParallelism)
        if path.rstrip("*").endswith((".gz", ".bz2", ".zst"))
        else lines
    )


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(a_number INT, terms ARRAY<STRING>) of lines such as ``A000045 ,0,1,1,2,``; other lines are skipped.

    The terms are all that follows the first blank, with blanks around them or none. Terms that are no whole number are
    dropped; a line without terms gives an empty array.
    """
    lines = _lines(spark, path).filter(F.col("value").startswith("A"))
    first = F.instr("value", " ")
    body = F.when(first > 0, F.split(F.substring(F.col("value"), first + 1, F.length("value")), ","))
    return lines.select(
        parse_id(F.substring_index("value", " ", 1)).alias("a_number"), clean_terms(body).alias("terms")
    ).filter("a_number is not null")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(a_number, n): numbers of terms only."""
    return read_terms(spark, path).select("a_number", F.size("terms").alias("n"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(a_number INT, name STRING) of lines such as ``A000045 Fibonacci numbers``; other lines are skipped."""
    return _lines(spark, path).select(
        F.regexp_extract("value", r"^A([0-9]{6,7}) (.*)$", 1).try_cast("int").alias("a_number"),
        F.trim(F.regexp_extract("value", r"^A([0-9]{6,7}) (.*)$", 2)).alias("name")
    ).filter("a_number is not null")


def read_entries(spark: SparkSession, folder: str, pattern: str = "*.seq") -> DataFrame:
    """(a_number INT, text STRING): one row for each entry file below a folder, its id from its name; invalid bytes become U+FFFD."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return files.select(
        F.regexp_extract("path", r"A([0-9]{6,7})\.[^/]*$", 1).try_cast("int").alias("a_number"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    ).filter("a_number is not null")


def read_archives(spark: SparkSession, path: str, suffix: str = ".seq") -> DataFrame:
    """The same from tar archives of at most 2 GB each, compressed or not: one task goes through an archive, member by member."""
    return archive_members(spark.read.format("binaryFile").load(path).select("content"), suffix)


def archive_members(archives: DataFrame, suffix: str = ".seq") -> DataFrame:
    """(a_number INT, text STRING): the entries in archives ``(content BINARY)``; members of other names are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import re
        import tarfile

        for b in batches:
            for content in b.column(0):
                ids, texts = [], []
                with tarfile.open(fileobj=io.BytesIO(content.as_buffer()), mode="r|*") as tar:
                    for m in tar:
                        found = re.search(r"A(\d{6,7})\.[^/]*$", m.name)
                        if m.isfile() and m.name.endswith(suffix) and found:
                            ids.append(int(found[1]))
                            texts.append(tar.extractfile(m).read().decode("utf-8", "replace"))
                        if len(ids) == 1000:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids, pa.int32()), pa.array(texts, pa.string())], ["a_number", "text"]
                            )
                            ids, texts = [], []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int32()), pa.array(texts, pa.string())], ["a_number", "text"]
                )

    return archives.select("content").mapInArrow(run, "a_number int, text string")


def _tagged(tag: str) -> Column:
    """The bodies of the lines of an entry's text with a tag, in order, as an array: ``%Y A000045 Cf. A000032.`` has tag Y and the body after the id."""
    lines = F.split("text", r"\R|[\x1c-\x1e]")
    return F.transform(
        F.filter(lines, lambda x: x.rlike(rf"^%{tag}(\s|$)")),
        lambda x: F.trim(F.regexp_replace(x, rf"^%{tag}(?:\s+A[0-9]{{6,7}})?\s*", ""))
    )


def entry_mentions(entries: DataFrame) -> DataFrame:
    """The mention table of entries ``(a_number, text)``: source, target, y_line_idx, link_type, paren, raw_text; self-mentions dropped.

    y_line_idx counts all %Y lines of an entry from 0. An entry is one row, so nothing is shuffled; lines are classified before their
    mentions are taken apart.
    """
    y = entries.select(F.col("a_number").alias("source"), F.posexplode(_tagged("Y")).alias("i", "raw_text"))
    rows = y.select(
        "source",
        F.col("i").cast("smallint").alias("y_line_idx"),
        T.line_type(F.col("raw_text")).alias("link_type"),
        "raw_text",
        F.explode(T.mentions(F.col("raw_text"))).alias("m")
    )
    return rows.select(
        "source", "m.target", "y_line_idx", "link_type", "m.paren", "raw_text"
    ).filter("source <> target")


def entry_meta(entries: DataFrame) -> DataFrame:
    """(a_number, keywords, n_y_lines) of each entry: %K lines joined by commas in their order ('' if none), and the number of %Y lines."""
    return entries.select(
        "a_number",
        F.coalesce(F.array_join(_tagged("K"), ","), F.lit("")).alias("keywords"),
        F.greatest(F.size(_tagged("Y")), F.lit(0)).cast("smallint").alias("n_y_lines")
    )


def entry_references(entries: DataFrame) -> DataFrame:
    """(a_number, xrefs): the sorted distinct sequences that the %Y lines of an entry name, but itself; entries without any are left out."""
    named = F.array_sort(
        F.array_distinct(
            F.filter(F.flatten(F.transform(_tagged("Y"), lambda x: all_ids(x))), lambda t: t != F.col("a_number"))
        )
    )
    return entries.select("a_number", named.alias("xrefs")).filter(F.size("xrefs") > 0)


def listed_ids(paths: DataFrame) -> DataFrame:
    """(id): sequences that have a b-file in a listing ``(path)`` of a tree."""
    return paths.select(
        F.regexp_extract("path", r"/b([0-9]+)\.txt$", 1).try_cast("int").alias("id")
    ).filter("id is not null").distinct()


def program_calls(programs: DataFrame) -> DataFrame:
    """(program, calls): the sequences that assembly texts ``(program, text)`` call by ``seq $n,id``, comments aside."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^\s*seq\s+\$\d+\s*,\s*(\d+)"), 1)
    return programs.select(
        "program", F.explode(F.transform(found, lambda x: x.try_cast("int"))).alias("calls")
    ).filter("calls is not null")


def read_programs(spark: SparkSession, folder: str) -> DataFrame:
    """(program, text): every .asm file below a folder whose stem is a whole number."""
    files = spark.read.text(
        folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.asm"
    ).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(
        F.regexp_extract("path", r"([0-9]+)\.asm$", 1).try_cast("int").alias("program"), F.col("value").alias("text")
    ).filter(F.col("path").rlike(r"(^|[/A])[0-9]+\.asm$") & F.col("program").isNotNull())


def json_mentions(documents: DataFrame) -> DataFrame:
    """(a_number, ref): each other sequence named anywhere in landed JSON ``(a_number, json_text)``, once."""
    refs = F.transform(
        F.array_distinct(F.regexp_extract_all("json_text", F.lit("A([0-9]{6,7})"), 1)), lambda x: x.cast("int")
    )
    return documents.select("a_number", F.explode(refs).alias("ref")).distinct()


def read_json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(a_number, json_text): landed JSON files A######.json below a folder; fetching them is left to other tools."""
    files = spark.read.text(
        folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json"
    ).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(
        F.regexp_extract("path", r"A([0-9]{6,7})\.json$", 1).try_cast("int").alias("a_number"),
        F.col("value").alias("json_text")
    ).filter("a_number is not null")


def read_audit(spark: SparkSession, labelled: str, key: str) -> DataFrame:
    """Labelled blind rows joined with their key on (u, v)."""
    read = lambda path, schema: spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True)
    return read(labelled, schemas.AUDIT).join(read(key, schemas.AUDIT_KEY), ["u", "v"], "left")
