"""All pairs of records whose sets of terms overlap, by a prefix-filtered join.

Two sets are similar if they have at least the share t of all tokens that are in either of them in common (Jaccard).
Tokens are ordered by rarity over all records. Similar sets share a token among the first ``n - ceil(t * n) + 1`` tokens
of each, so only those prefixes are indexed and joined. Sizes, positions, and a sketch of 128 bits that holds the parity
of the tokens hashed to each bit (no two sets differ in fewer tokens than bits) prune the candidates without losing a
pair, and the exact overlap of the whole sets decides.

Records with the same set form one class, and only classes are compared: a group of copies, however large, costs one
representative. Tokens found in one class only are dropped before the join, as they can match nothing.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.terms import clean_terms
from termloom.llm.copies import spelled_pairs
from termloom.session import block_pairs, mark, materialize, release_since

#: At most this many tokens are called frequent: each holds more than 1/FREQUENT of all token occurrences.
FREQUENT = 2000
#: Postings of a token above which its join is split into tiles.
BLOCK = 2000


def set_classes(records: DataFrame, id_col: str, terms_col: str, min_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, classes): ``members(id, cid, rid, copies)`` and ``classes(cid, rid, toks, n, copies)``; toks is one text, joined by commas.

    A record is in if it has at least ``min_size`` distinct whole-number terms. ``cid`` numbers the classes, ``rid`` is the smallest
    id of one. Null ids are left out; repeated rows count once; a record stored with several term lists is in each list's class.
    """
    toks = F.array_sort(F.array_distinct(clean_terms(F.col(terms_col))))
    rows = records.select(
        F.col(id_col).cast("bigint").alias("id"), toks.alias("t")
    ).filter(F.col("id").isNotNull() & (F.size("t") >= min_size))
    rows = rows.select("id", F.size("t").alias("n"), F.array_join("t", ",").alias("toks"))
    rows = materialize(rows.withColumn("key", F.unhex(F.sha2("toks", 256))), "sets")
    ids = rows.select("id", "key").distinct()
    # numbered once and written, so a number stays with its class
    reps = materialize(
        ids.groupBy("key")
        .agg(F.min("id").alias("rid"), F.count("*").alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "reps"
    )
    # reps is unique in key, so AQE can split a hot key of ids
    members = materialize(ids.join(reps, "key").select("id", "cid", "rid", "copies"), "members")
    classes = (
        rows.join(reps.withColumnRenamed("rid", "id"), ["key", "id"])
        .groupBy("key", "id")
        .agg(
            F.first("cid").alias("cid"),
            F.first("toks").alias("toks"),
            F.first("n").alias("n"),
            F.first("copies").alias("copies")
        )
    )
    return members, classes.select("cid", F.col("id").alias("rid"), "toks", "n", "copies")


def _ceil(share: Fraction, n: Column) -> Column:
    return ((n * share.numerator + (share.denominator - 1)) / share.denominator).cast("int")


def _frequencies(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rare, frequent): tables (h, df) of the tokens of at least two classes; ``frequent`` has at most FREQUENT rows."""
    df = materialize(tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "df")
    total = df.agg(F.sum("df")).first()[0] or 0
    cut = total / FREQUENT
    return df.filter(F.col("df") <= cut), df.filter(F.col("df") > cut)


def similar_classes(classes: DataFrame, threshold: float = 0.6, block: int = BLOCK) -> DataFrame:
    """(cid_1, cid_2, n_1, n_2, overlap): pairs of ``classes(cid, toks, n)`` that have at least ``threshold`` of the tokens in either in common.

    With boolean columns ``is_index`` and ``is_probe`` in ``classes``, pairs are directed: 1 is an index class and 2 a
    probe class. Without them every unordered pair comes once.
    """
    t = Fraction(str(threshold))
    directed = "is_index" in classes.columns
    if not hasattr(classes, "_termloom_path"):  # it is read several times
        classes = materialize(classes, "classes")
    if not directed:
        classes = classes.withColumns({"is_index": F.lit(True), "is_probe": F.lit(True)})
    tokens = classes.select("cid", F.explode(F.transform(F.split("toks", ","), lambda x: F.xxhash64(x))).alias("h"))
    rare, frequent = _frequencies(tokens)
    frequent = F.broadcast(frequent)
    ranked = tokens.join(frequent, "h", "left_anti").join(rare, "h").unionByName(tokens.join(frequent, "h"))
    bit = F.expr("shiftleft(1L, cast(pmod(h, 64) AS INT))")
    high = F.pmod(F.shiftright("h", 6), F.lit(2)) == 1
    sketch = (
        F.bit_xor(F.when(~high, bit).otherwise(0)).alias("s"), F.bit_xor(F.when(high, bit).otherwise(0)).alias("t")
    )
    lists = ranked.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("l"), *sketch)
    lists = lists.join(classes.select("cid", "n", "is_index", "is_probe"), "cid")
    # tokens of this class only come first in the order and match nothing: m is the number of the others
    keep = F.greatest(F.lit(0), F.size("l") - _ceil(t, F.col("n")) + 1)
    prefix = lists.select(
        "cid",
        "n",
        "is_index",
        "is_probe",
        "s",
        "t",
        F.size("l").alias("m"),
        F.posexplode(F.slice("l", F.lit(1), keep)).alias("i", "x")
    )
    postings = materialize(
        prefix.select(F.col("x.h").alias("h"), "cid", "n", "m", "i", "s", "t", "is_index", "is_probe"), "prefix"
    )

    a, b, on = block_pairs(
        postings.filter("is_index") if directed else postings,
        postings.filter("is_probe") if directed else postings,
        "h",
        "cid",
        block
    )
    a, b = (
        d.select(*on, *(F.col(c).alias(f"{c}_{k}") for c in ("_b", "cid", "n", "m", "i", "s", "t")))
        for d, k in ((a, 1), (b, 2))
    )
    enough = lambda overlap: overlap * (t.numerator + t.denominator) >= (F.col("n_1") + F.col("n_2")) * t.numerator
    rest = F.least(F.col("m_1") - F.col("i_1"), F.col("m_2") - F.col("i_2")) - 1
    differ = F.bit_count(F.col("s_1").bitwiseXOR(F.col("s_2"))) + F.bit_count(F.col("t_1").bitwiseXOR(F.col("t_2")))
    hit = (F.col("cid_1") != F.col("cid_2")) if directed else (F.col("cid_1") < F.col("cid_2"))
    hit &= (F.col("_bi") == F.col("_bj")) | (F.col("_b_1") != F.col("_b_2"))
    hit &= F.least("n_1", "n_2") * t.denominator >= F.greatest("n_1", "n_2") * t.numerator  # sizes
    # positions: at most so many tokens are shared before and after this one
    hit &= enough(F.least("i_1", "i_2") + 1 + rest)
    hit &= enough((F.col("m_1") + F.col("m_2") - differ) / 2)  # sketches
    # the order of tokens is one, so the last shared one is the last of either prefix
    last = F.count("*") + F.least(F.max("m_1") - F.max("i_1"), F.max("m_2") - F.max("i_2")) - 1
    hits = a.join(b, on).filter(hit).groupBy("cid_1", "cid_2", "n_1", "n_2").agg(last.alias("most"))
    pairs = hits.filter(enough(F.col("most"))).select("cid_1", "cid_2")

    side = lambda s: classes.select(
        F.col("cid").alias(f"cid_{s}"), F.col("toks").alias(f"toks_{s}"), F.col("n").alias(f"n_{s}")
    )
    full = pairs.join(side(1), "cid_1").join(side(2), "cid_2").withColumn(
        "overlap", F.size(F.array_intersect(F.split("toks_1", ","), F.split("toks_2", ",")))
    )
    return full.filter(enough(F.col("overlap"))).select("cid_1", "cid_2", "n_1", "n_2", "overlap")


def similar_records(
    corpus: DataFrame, submissions: DataFrame, threshold: float = 0.6, min_size: int = 8
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, class pairs) of the records of both tables together."""
    records = corpus.select(F.col("a_number").cast("bigint").alias("id"), "terms").unionByName(
        submissions.select(F.col("sub_id").cast("bigint").alias("id"), "terms")
    )
    members, classes = set_classes(records, "id", "terms", min_size)
    classes = materialize(classes, "classes")
    point = mark()
    pairs = materialize(similar_classes(classes, threshold), "pairs")
    release_since(point, pairs)
    return members, classes, pairs


def links_per_record(members: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, n, copies, links): one row per record with its class and the number of records similar to it.

    Counts are summed per class, so no group of copies is spelled out.
    """
    size = classes.select("cid", "copies")
    both = pairs.select(F.col("cid_1").alias("cid"), F.col("cid_2").alias("other")).unionByName(
        pairs.select(F.col("cid_2").alias("cid"), F.col("cid_1").alias("other"))
    )
    linked = both.join(
        size.withColumnsRenamed({"cid": "other", "copies": "m"}), "other"
    ).groupBy("cid").agg(F.sum("m").alias("m"))
    per_class = classes.select("cid", "n", "copies").join(linked, "cid", "left").select(
        "cid", "n", "copies", (F.col("copies") - 1 + F.coalesce("m", F.lit(0))).alias("links")
    )
    return members.drop("copies").join(per_class, "cid").select(
        "id", F.col("rid").alias("class_id"), "n", "copies", "links"
    )


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_1, id_2): every pair of similar records, smaller id first, from the class pairs and the classes themselves."""
    return spelled_pairs(members, pairs)
