"""Strata of mentions by ordered rules over names, keywords, lines and parentheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T


def names_of(corpus: DataFrame) -> DataFrame:
    """(a_number, name): one non-null name for each sequence."""
    return corpus.filter(
        "a_number is not null and name is not null"
    ).groupBy("a_number").agg(F.min("name").alias("name"))


def duplicate_of(names: DataFrame) -> DataFrame:
    """(a_number, ref): the first sequence that a name calls itself a duplicate of."""
    ref = F.regexp_extract("name", "(?iU)" + T.DUPLICATE_NAME, 1)
    return names.select("a_number", F.when(ref != "", ref).cast("int").alias("ref")).filter("ref is not null")


def name_references(names: DataFrame) -> DataFrame:
    """(holder, ref): every sequence that a name is a transform of."""
    found = F.regexp_extract_all("name", F.lit("(?iU)" + T.NAME_TRANSFORM), 1)
    return names.select(
        F.col("a_number").alias("holder"),
        F.explode(F.transform(F.array_distinct(found), lambda x: x.cast("int"))).alias("ref")
    ).distinct()


def constant_like(names: DataFrame, meta: DataFrame, version: int = 1) -> DataFrame:
    """(id): sequences whose name or keywords say that they expand a constant.

    Version 0: keyword cons. Version 1: cons without core, and more forms of names. Keywords are whole tokens of any stored row.
    """
    k = T.keyword_list(F.col("keywords"))
    marked = F.array_contains(k, "cons") if version == 0 else F.array_contains(k, "cons") & ~F.array_contains(k, "core")
    named = names.filter(T.has(F.col("name"), T.CONSTANT_NAME_V0 if version == 0 else T.CONSTANT_NAME_V1))
    return named.select(F.col("a_number").alias("id")).union(
        meta.filter(marked).select("a_number")
    ).filter("id is not null").distinct()


def _flag(df: DataFrame, nodes: DataFrame, column: str, flag: str) -> DataFrame:
    return df.join(nodes.select(F.col("id").alias(column), F.lit(True).alias(flag)), column, "left")


def _name_flags(edges: DataFrame, names: DataFrame, meta: DataFrame, version: int) -> DataFrame:
    """Directed edges with dup, ref and const: what the names and keywords of the two ends say. Computed once per edge, not per mention."""
    dup = duplicate_of(names).select(F.col("a_number").alias("x"), F.col("ref").alias("y"))
    dup = dup.unionByName(dup.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    out = edges.join(
        dup.select(F.col("x").alias("source"), F.col("y").alias("target"), F.lit(True).alias("dup")),
        ["source", "target"],
        "left"
    )
    if version == 1:
        ref = name_references(names).select(F.col("holder").alias("x"), F.col("ref").alias("y"))
        ref = ref.unionByName(ref.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
        out = out.join(
            ref.select(F.col("x").alias("source"), F.col("y").alias("target"), F.lit(True).alias("ref")),
            ["source", "target"],
            "left"
        )
    const = constant_like(names, meta, version)
    out = _flag(_flag(out, const, "source", "_cs"), const, "target", "_ct")
    return out.withColumn("const", F.coalesce("_cs", "_ct")).drop("_cs", "_ct")


def _yes(flag: Column | str) -> Column:
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))


def stratum_v0(mentions: DataFrame, names: DataFrame, meta: DataFrame) -> DataFrame:
    """``mentions(source, target, raw_text, paren)`` with stratum_v0, by the draft rules. A null paren is none.

    The targets of a line are counted with repeats and without the source itself.
    """
    n_line = F.size(F.filter(T.mentions(F.col("raw_text")), lambda m: m["target"] != F.col("source")))
    lines = mentions.select("source", "raw_text").distinct().withColumns(
        {"_type": T.line_type(F.col("raw_text")), "_n": n_line}
    )
    edges = _name_flags(mentions.select("source", "target").distinct(), names, meta, 0)
    paren = F.coalesce("paren", F.lit(""))
    rule = (
        F.when(_yes(F.col("_type") == "duplicate") | T.has(paren, T.S1_CUE) | _yes("dup"), "s1")
        .when(T.has(paren, T.S2_CUE_V0), "s2")
        .when(_yes("const"), "s4")
        .when(_yes((F.col("_type") == "transform") & (F.col("_n") <= 3)), "s2")
        .otherwise("s3")
    )
    return _joined(mentions, lines, edges).withColumn("stratum_v0", rule).drop("_type", "_n", "dup", "const")


def _joined(mentions: DataFrame, lines: DataFrame, edges: DataFrame) -> DataFrame:
    null_safe = lambda a, b, keys: a.join(
        b.withColumnsRenamed({k: "_" + k for k in keys}), [a[k].eqNullSafe(F.col("_" + k)) for k in keys], "left"
    ).drop(*("_" + k for k in keys))
    return null_safe(null_safe(mentions, lines, ["source", "raw_text"]), edges, ["source", "target"])


def stratum_v1(mentions: DataFrame, names: DataFrame, meta: DataFrame) -> DataFrame:
    """``mentions(source, target, raw_text, paren)`` with stratum_v1: the first rule of eight that holds.

    The cues of a line are found once per distinct line, what names say once per distinct edge.
    """
    lines = mentions.select("source", "raw_text").distinct().withColumn(
        "_cues", T.line_cues(F.col("source"), F.col("raw_text"))
    )
    edges = _name_flags(mentions.select("source", "target").distinct(), names, meta, 1)
    paren = F.coalesce("paren", F.lit(""))
    rule = (
        F.when(_yes("dup") | T.has(paren, T.S1_CUE) | _yes(F.array_contains("_cues.s1", F.col("target"))), "s1")
        .when(T.has(paren, T.S2_CUE_V1) | _yes("ref"), "s2")
        .when(_yes("const"), "s4")
        .when(_yes(F.array_contains("_cues.s2", F.col("target"))), "s2")
        .otherwise("s3")
    )
    return _joined(mentions, lines, edges).withColumn("stratum_v1", rule).drop("_cues", "dup", "ref", "const")


def line_mentions(lines: DataFrame) -> DataFrame:
    """Entry lines ``(source, raw_text)`` to their mentions (source, raw_text, pos, target, paren), self-mentions dropped."""
    return (
        lines.select("source", "raw_text", F.posexplode(T.mentions(F.col("raw_text"))).alias("pos", "m"))
        .select("source", "raw_text", "pos", "m.target", "m.paren")
        .filter(~F.coalesce(F.col("target") == F.col("source"), F.lit(False)))
    )
