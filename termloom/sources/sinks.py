"""Writers: tables, ordered JSON lines, CSV for audits, id lists, and small JSON and Markdown reports."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.ids import format_id


def write_table(df: DataFrame, path: str, force: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet; what is there already is kept unless ``force``."""
    df.write.mode("overwrite" if force else "ignore").partitionBy(*(partition_by or [])).parquet(path)


def write_json_lines(df: DataFrame, path: str, order: str = "a_number", force: bool = False) -> None:
    """JSON lines in the order of a column, over as many files as Spark cuts the range into."""
    df.orderBy(order).write.mode("overwrite" if force else "ignore").json(path)


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    rows = df.write.mode("overwrite" if force else "ignore").option("escape", '"')
    rows.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)


def write_blind_audit(sample: DataFrame, path: str, force: bool = False) -> None:
    """The sample without labels at path/blind, and its key at path/key."""
    from termloom.operators.audit import blind

    rows, key = blind(sample)
    write_csv(rows, f"{path}/blind", force)
    write_csv(key, f"{path}/key", force)


def write_id_list(ids: DataFrame, path: str, force: bool = False) -> None:
    """Sorted identifiers, one a line."""
    ids.select("id").distinct().orderBy("id").select(format_id(F.col("id"))).write.mode(
        "overwrite" if force else "ignore"
    ).text(path)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str, force: bool = True) -> bool:
    """One small text, a report or a manifest, to any file system Spark reaches; False if it was there and stays."""
    fs, p = _file(spark, path)
    if fs.exists(p) and not force:
        return False
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def write_report(spark: SparkSession, path: str, report: dict, force: bool = True) -> bool:
    return write_text(spark, path, json.dumps(report, indent=2, sort_keys=True, default=str) + "\n", force)


def append_log(spark: SparkSession, path: str, line: str) -> None:
    """Append a stamped line to a log table of text files; concurrent writers don't clash."""
    stamp = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
    spark.range(1).select(F.lit(f"{stamp} {line}").alias("value")).coalesce(1).write.mode("append").text(path)


def require(spark: SparkSession, path: str) -> None:
    """Raise unless a file or folder, such as a lock, is there."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"{path} must be there first")


def markdown(report: dict, title: str) -> str:
    """A report of nested dictionaries as headings and tables."""
    lines = [f"# {title}", ""]
    for section, body in report.items():
        lines += [f"## {section}", ""]
        rows = (
            body
            if isinstance(body, list)
            else [{"name": k, "value": v} for k, v in body.items()]
            if isinstance(body, dict)
            else [{"value": body}]
        )
        if rows:
            cols = list(rows[0])
            lines += ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
            lines += ["| " + " | ".join(str(r.get(c, "")) for c in cols) + " |" for r in rows]
        lines.append("")
    return "\n".join(lines)
