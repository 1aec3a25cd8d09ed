"""Long runs of consecutive terms that stand in more than one record: seed and extend.

Every window of ``least`` terms keeps its smallest k-gram hash as an anchor (winnowing), so two records that share a run
of that length share an anchor at the same place of the run. Records are joined on anchors, each hit gives a diagonal,
and matches are extended both ways along it to maximal runs, term by term.

Records with the same sequence form one class, and only classes are joined; hot anchors are joined in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions.terms import clean_terms
from termloom.llm.copies import spelled_pairs
from termloom.session import block_pairs, materialize

GRAM = 8
BLOCK = 2000


def sequence_classes(corpus: DataFrame, least: int = 12) -> tuple[DataFrame, DataFrame]:
    """(members, classes): ``members(id, cid, rid, copies)``, ``classes(cid, rid, seq, n, copies)`` of records with ``least`` terms or more; seq is one text, joined by commas.

    Terms that are no whole numbers are dropped first, so a run goes on across them. Null ids are left out. ``cid`` numbers the
    classes, ``rid`` is the smallest id of one; a record stored with several sequences is in each sequence's class.
    """
    rows = corpus.select(
        F.col("a_number").cast("bigint").alias("id"), clean_terms(F.col("terms")).alias("t")
    ).filter(F.col("id").isNotNull() & (F.size("t") >= least))
    rows = rows.select("id", F.size("t").alias("n"), F.array_join("t", ",").alias("seq"))
    rows = materialize(rows.withColumn("key", F.unhex(F.sha2("seq", 256))), "seqs")
    ids = rows.select("id", "key").distinct()
    # numbered once and written, so a number stays with its class
    reps = materialize(
        ids.groupBy("key")
        .agg(F.min("id").alias("rid"), F.count("*").alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "reps"
    )
    members = materialize(ids.join(reps, "key").select("id", "cid", "rid", "copies"), "members")
    classes = (
        rows.join(reps.withColumnRenamed("rid", "id"), ["key", "id"])
        .groupBy("key", "id")
        .agg(
            F.first("cid").alias("cid"),
            F.first("seq").alias("seq"),
            F.first("n").alias("n"),
            F.first("copies").alias("copies")
        )
    )
    return members, materialize(classes.select("cid", F.col("id").alias("rid"), "seq", "n", "copies"), "classes")


def _anchors(gram: int, window: int):
    """(cid, hs ARRAY<BIGINT>) to (h, cid, pos): the winnowed grams of each record; a whole batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.asarray(pc.list_value_length(b.column(1)))
            flat = b.column(1).flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            m = len(flat) - gram + 1
            g = np.zeros(m, dtype=np.uint64)
            for i in range(gram):  # a polynomial over 2**64, then mixed so that small hashes are spread
                g = g * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + m]
            g ^= g >> np.uint64(31)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(29)
            starts = m - window + 1
            if starts < 1:
                continue
            # windows of grams that lie inside one record; among equal hashes the rightmost is taken
            inside = row[:starts] == row[gram + window - 2 : gram + window - 2 + starts]
            best, at = g[:starts].copy(), np.arange(starts)
            for i in range(1, window):
                less = g[i : i + starts] <= best
                best[less] = g[i : i + starts][less]
                at[less] = np.flatnonzero(less) + i
            at = np.unique(at[inside])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g[at].view(np.int64)),
                    pa.array(b.column(0).to_numpy()[row[at]]),
                    pa.array(pos[at].astype(np.int32))
                ],
                ["h", "cid", "pos"]
            )

    return run


def _extend(least: int):
    """Pairs with the diagonals of their seeds to maximal runs of ``least`` terms or more; one pair at a time is taken apart."""
    names = ("cid_1", "cid_2", "seq_1", "seq_2", "diags")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in names)):
                one, two, x, y, diags = (v.as_py() for v in row)
                # terms become the numbers of a dictionary of the pair, so the comparison is exact and of machine words
                codes: dict[str, int] = {}
                a, b = (
                    np.array([codes.setdefault(t, len(codes)) for t in s.split(",")], dtype=np.int64) for s in (x, y)
                )
                for d in diags:  # position in 1 less position in 2
                    i, j = max(d, 0), max(-d, 0)
                    m = min(len(a) - i, len(b) - j)
                    same = np.concatenate(([False], a[i : i + m] == b[j : j + m], [False])).astype(np.int8)
                    edge = np.diff(same)
                    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    out += [(one, two, i + s, j + s, e - s) for s, e in zip(lo.tolist(), hi.tolist()) if e - s >= least]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], ["cid_1", "cid_2", "start_1", "start_2", "len"]
            )

    return run


def shared_runs(classes: DataFrame, least: int = 12, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(cid_1, cid_2, start_1, start_2, len): maximal runs of at least ``least`` equal terms between different classes, cid_1 < cid_2."""
    gram = min(gram, least)
    hs = classes.select("cid", F.transform(F.split("seq", ","), lambda x: F.xxhash64(x)).alias("hs"))
    postings = materialize(hs.mapInArrow(_anchors(gram, least - gram + 1), "h bigint, cid bigint, pos int"), "anchors")
    a, b, on = block_pairs(postings, postings, "h", "cid", block)
    a, b = (d.select(*on, *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "pos", "_b"))) for d, s in ((a, 1), (b, 2)))
    hits = a.join(b, on).filter("cid_1 < cid_2 and (_bi = _bj or _b_1 <> _b_2)")
    # at most n_1 + n_2 diagonals a pair
    seeds = hits.groupBy("cid_1", "cid_2").agg(F.collect_set(F.col("pos_1") - F.col("pos_2")).alias("diags"))
    side = lambda s: classes.select(F.col("cid").alias(f"cid_{s}"), F.col("seq").alias(f"seq_{s}"))
    return seeds.join(side(1), "cid_1").join(side(2), "cid_2").mapInArrow(
        _extend(least), "cid_1 bigint, cid_2 bigint, start_1 int, start_2 int, len int"
    )


def _both(runs: DataFrame) -> DataFrame:
    turn = lambda a, b: runs.select(
        F.col(f"cid_{a}").alias("cid"), F.col(f"cid_{b}").alias("other"), F.col(f"start_{a}").alias("s"), "len"
    )
    return turn(1, 2).unionByName(turn(2, 1))


def coverage(corpus: DataFrame, least: int = 12) -> DataFrame:
    """For each record of ``least`` terms or more: class_id, n_terms, copies (of its whole sequence, itself included), partners
    (other records that share a run), runs (distinct maximal runs with other classes, by place) and covered (terms inside a shared run).

    A record with a copy is covered whole. One row per record; partners of a class are counted, not listed.
    """
    members, classes = sequence_classes(corpus, least)
    both = materialize(_both(shared_runs(classes, least)), "runs")
    partners = both.select("cid", "other").distinct().join(
        classes.select(F.col("cid").alias("other"), "copies"), "other"
    ).groupBy("cid").agg(F.sum("copies").alias("p"))
    # distinct places first: a record has few, however many partners it has
    places = both.select("cid", "s", (F.col("s") + F.col("len")).alias("e")).distinct()
    before = F.max("e").over(W.partitionBy("cid").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
    fresh = places.withColumn("b", F.coalesce(before, F.lit(0))).select(
        "cid", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "b")).alias("fresh")
    )
    covered = fresh.groupBy("cid").agg(F.sum("fresh").alias("c"), F.count("*").alias("runs"))
    per_class = classes.select("cid", "n", "copies").join(partners, "cid", "left").join(covered, "cid", "left")
    cov = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("c", F.lit(0)))
    per_class = per_class.select(
        "cid",
        F.col("n").alias("n_terms"),
        "copies",
        (F.coalesce("p", F.lit(0)) + F.col("copies") - 1).alias("partners"),
        F.coalesce("runs", F.lit(0)).alias("runs"),
        cov.cast("int").alias("covered")
    )
    return members.drop("copies").join(per_class, "cid").select(
        F.col("id").alias("a_number"),
        F.col("rid").alias("class_id"),
        "n_terms",
        "copies",
        "partners",
        "runs",
        "covered"
    )


def _ordered(one: str, two: str, *with_: str) -> list:
    """Two columns, smaller first, and two more that go with them."""
    up = F.col(one) <= F.col(two)
    turned = {one: two, two: one, with_[0]: with_[1], with_[1]: with_[0]}
    return [F.when(up, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in turned.items()]


def record_runs(corpus: DataFrame, least: int = 12) -> DataFrame:
    """(class_1, class_2, start_1, start_2, len): maximal shared runs between classes, by their smallest ids, the smaller first.

    Starts count from 0. The records of a class are in :func:`record_classes`.
    """
    _, classes = sequence_classes(corpus, least)
    rid = lambda s: classes.select(F.col("cid").alias(f"cid_{s}"), F.col("rid").alias(f"class_{s}"))
    return shared_runs(classes, least).join(rid(1), "cid_1").join(rid(2), "cid_2").select(
        *_ordered("class_1", "class_2", "start_1", "start_2"), "len"
    )


def record_classes(corpus: DataFrame, least: int = 12) -> DataFrame:
    """(a_number, class_id): the class of each record of ``least`` terms or more."""
    return sequence_classes(corpus, least)[0].select(F.col("id").alias("a_number"), F.col("rid").alias("class_id"))


def all_coverage(corpus: DataFrame, least: int = 12) -> DataFrame:
    """:func:`coverage` with a row for every record: those of fewer than ``least`` terms have no class and count 0."""
    rows = materialize(coverage(corpus, least), "coverage")
    short = (
        corpus.filter("a_number is not null")
        .groupBy(F.col("a_number").cast("bigint").alias("a_number"))
        .agg(F.max(F.size(clean_terms(F.col("terms")))).alias("n_terms"))
        .join(rows, "a_number", "left_anti")
    )
    return rows.unionByName(
        short.select(
            "a_number",
            "n_terms",
            F.lit(None).cast("bigint").alias("class_id"),
            *(F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in ("copies", "partners", "runs", "covered"))
        )
    )


def run_pairs(corpus: DataFrame, least: int = 12) -> DataFrame:
    """(a_number_1, a_number_2): all pairs of records with a shared run of ``least`` terms, smaller first."""
    members, classes = sequence_classes(corpus, least)
    linked = materialize(shared_runs(classes, least).select("cid_1", "cid_2").distinct(), "linked")
    return spelled_pairs(members, linked).select(F.col("id_1").alias("a_number_1"), F.col("id_2").alias("a_number_2"))
