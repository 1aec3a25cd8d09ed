"""Transforms of whole sequences, exact for terms of any size, and pairs of sequences that a transform ties."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.session import materialize, spread

#: Complements of more terms are given by their gaps, as they can have any number of terms.
LISTED = 10_000

#: Sequences whose transforms are held at once.
CHUNK = 200

#: Names of all transforms. Index origins: binomial counts from 0, Euler and Moebius from 1; Moebius sums mu(n/d) a(d).
TRANSFORMS = (
    "identity",
    "negation",
    "diff1",
    "partial_sums",
    "diff2",
    "even",
    "odd",
    "third_0",
    "third_1",
    "third_2",
    "binomial",
    "inverse_binomial",
    "euler",
    "inverse_euler",
    "moebius",
    "inverse_moebius",
    "complement"
)


def _divisors(n: int) -> tuple[list[list[int]], list[int]]:
    """The divisors of 0..n, and the Moebius function of 0..n."""
    divisors: list[list[int]] = [[] for _ in range(n + 1)]
    for d in range(1, n + 1):
        for m in range(d, n + 1, d):
            divisors[m].append(d)
    mu = [0, 1] + [0] * n
    for m in range(2, n + 1):
        mu[m] = -sum(mu[d] for d in divisors[m] if d < m)
    return divisors, mu


def _transforms(a: list[int], tables: tuple | None = None, first: int | None = None) -> Iterator[tuple[str, list]]:
    """All transforms of the whole of a; of the complement only the ``first`` terms, if that is given."""
    from itertools import accumulate
    from operator import add, mul, sub

    n = len(a)
    divisors, mu = tables or _divisors(n)
    diff = list(map(sub, a[1:], a))
    yield "identity", a
    yield "negation", [-x for x in a]
    yield "diff1", diff
    yield "partial_sums", list(accumulate(a))
    yield "diff2", list(map(sub, diff[1:], diff))
    yield "even", a[0::2]
    yield "odd", a[1::2]
    for phi in range(3):
        yield f"third_{phi}", a[phi::3]
    # the first terms of (1 + shift)^i a, and of (shift - 1)^i a
    for name, op in (("binomial", add), ("inverse_binomial", sub)):
        row, out = a, []
        while row:
            out.append(row[0])
            row = list(map(op, row[1:], row))
        yield name, out
    # with c(m) = sum over d | m of d a(d), the Euler transform b solves m b(m) = c(m) + sum c(i) b(m - i)
    c = [0] + [sum(d * a[d - 1] for d in divisors[m]) for m in range(1, n + 1)]
    b = [1]
    for m in range(1, n + 1):
        b.append((c[m] + sum(map(mul, c[1:m], b[m - 1 : 0 : -1]))) // m)
    yield "euler", b[1:]
    c = [0]
    for m in range(1, n + 1):
        c.append(m * a[m - 1] - sum(map(mul, c[1:m], a[m - 2 :: -1] if m > 1 else ())))
    yield "inverse_euler", [sum(mu[m // d] * c[d] for d in divisors[m]) // m for m in range(1, n + 1)]
    yield "moebius", [sum(mu[m // d] * a[d - 1] for d in divisors[m] if mu[m // d]) for m in range(1, n + 1)]
    yield "inverse_moebius", [sum(a[d - 1] for d in divisors[m]) for m in range(1, n + 1)]
    yield from _complement(a, first)


def _complement(a: list[int], first: int | None = None) -> Iterator[tuple[str, list]]:
    """The complement of a strictly rising sequence of whole numbers >= 0, whatever its span."""
    from itertools import chain, islice

    n = len(a)
    if n > 1 and a[0] >= 0 and all(x < y for x, y in zip(a, a[1:])):
        gaps = [(lo, hi) for lo, hi in zip([0, *(x + 1 for x in a)], a) if lo < hi]
        if first is not None or a[-1] - n < LISTED:
            yield "complement", list(islice(chain.from_iterable(range(*g) for g in gaps), first))
        else:
            yield "complement_gaps", [f"{lo}..{hi - 1}" for lo, hi in gaps]


def transformed(seqs: DataFrame, first: int | None = None, complements: bool = False) -> DataFrame:
    """(id, transform, terms ARRAY<STRING>): each whole ``(id, seq)`` under every transform that applies and leaves terms.

    A complement of more than ``LISTED`` terms comes as ``complement_gaps``, its ranges lo..hi from the smallest on; no stored
    sequence is as long. With ``first``, every complement is a list of that many terms at most. With ``complements``, there
    are no others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys

        # Euler transforms of large terms have more digits than Python reads or writes by default
        sys.set_int_max_str_digits(0)
        each = lambda a, tables: _complement(a, first) if complements else _transforms(a, tables, first)
        for whole in batches:
            tables = None if complements else _divisors(max(map(len, whole["seq"]), default=0))
            for k in range(0, len(whole), CHUNK):
                pdf = whole.iloc[k : k + CHUNK]
                rows = [
                    (i, name, [str(x) for x in t])
                    for i, s in zip(pdf["id"], pdf["seq"])
                    for name, t in each([int(x) for x in s], tables)
                    if t
                ]
                yield pd.DataFrame(rows, columns=["id", "transform", "terms"])

    return (
        seqs.select(F.col("id").cast("bigint").alias("id"), "seq")
        .filter("seq is not null")
        .mapInPandas(run, "id bigint, transform string, terms array<string>")
    )


@F.pandas_udf(T.LongType())
def residue_sum(terms: pd.Series) -> pd.Series:
    """The sum of all terms, each times its place from 1, modulo 2**61 - 1: a check value that any engine can repeat."""
    import sys

    sys.set_int_max_str_digits(0)
    return terms.map(lambda t: sum(i * int(x) for i, x in enumerate(t, 1)) % (2**61 - 1))


def _varied_starts(shift: int, least: int):
    """(..., terms as text) to (..., at, key): a key for each start 0..``shift`` that leaves ``least`` terms, not all of them the same.

    The key is of the first ``least`` terms, or of as many as it takes to the first one that differs. Two overlaps that are
    equal, and have a term that differs from their first, agree in the key, whatever follows. Keys with ~ are of the differences to
    the first term in lowest terms and with the first of them positive, and agree if the overlaps are affine to each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys
        from math import gcd

        sys.set_int_max_str_digits(0)
        for pdf in batches:
            ref = [c for c in pdf.columns if c != "terms"]
            rows = []
            for *own, text in pdf[[*ref, "terms"]].itertuples(index=False):
                a = text.split(",")
                for at in range(min(shift, len(a) - least) + 1):
                    k = next((i for i in range(at + 1, len(a)) if a[i] != a[at]), 0)
                    if k:
                        run_ = a[at : max(at + least, k + 1)]
                        rows.append((*own, at, "=" + ",".join(run_)))
                        d = [int(x) - int(run_[0]) for x in run_]
                        g = gcd(*d) * (1 if d[k - at] > 0 else -1)
                        rows.append((*own, at, "~" + ",".join(str(x // g) for x in d)))
            yield pd.DataFrame(rows, columns=[*ref, "at", "key"])

    return run


def varied_starts(rows: DataFrame, terms: str, shift: int = 8, least: int = 8) -> DataFrame:
    """The columns of ``rows`` but ``terms``, with at, affine (whether the key is one for affine relations) and h, the key's hash."""
    rest = [c for c in rows.columns if c != terms]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    keyed = rows.select(*rest, F.array_join(terms, ",").alias("terms")).mapInPandas(
        _varied_starts(shift, least), f"{kinds}, at int, key string"
    )
    return keyed.select(*rest, "at", F.col("key").startswith("~").alias("affine"), F.xxhash64("key").alias("h"))


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the candidate shifts the smallest at which the whole overlap agrees; the constants of affine relations."""
    import sys
    from fractions import Fraction

    sys.set_int_max_str_digits(0)

    def one(kind: str, shifts, a: list[str], b: list[str]) -> tuple | None:
        for s in sorted(shifts, key=lambda s: (abs(s), s)):
            p, q = a[max(s, 0) :], b[max(-s, 0) :]
            m = min(len(p), len(q))
            if kind != "affine":
                if p[:m] == q[:m]:
                    return s, None, None, None, None
                continue
            p, q = [int(x) for x in p[:m]], [int(x) for x in q[:m]]
            k = next((i for i in range(m) if p[i] != p[0]), 0)
            dp, dq = p[k] - p[0], q[k] - q[0]
            if dp and dq and all((y - q[0]) * dp == dq * (x - p[0]) for x, y in zip(p, q)):
                c = Fraction(dq, dp)
                d = q[0] - c * p[0]
                return s, str(c.numerator), str(c.denominator), str(d.numerator), str(d.denominator)
        return None

    for pdf in batches:
        rows = [
            (q, t, i, *got)
            for q, t, i, shifts, a, b in pdf[["q", "transform", "id", "shifts", "a", "b"]].itertuples(index=False)
            if (got := one(t, shifts, a.split(","), b.split(",")))
        ]
        yield pd.DataFrame(
            rows, columns=["q", "transform", "id", "s", "c_num", "c_den", "d_num", "d_den"]
        ).astype({"s": "int32"})


def transform_links(seqs: DataFrame, every: int = 100, least: int = 8, shift: int = 8) -> DataFrame:
    """(q, transform, id, s, c_num, c_den, d_num, d_den): sequences b that equal a transform t of a query, b[i] = t[i + s], in all
    terms of their overlap, which are at least ``least``, at an offset of at most ``shift``.

    Queries are the sequences whose id is divisible by ``every``; all sequences are searched. For the transform ``affine`` it
    is b[i] = c * q[i + s] + d with a rational c other than 0; the constants are null for all others. The offset of smallest size
    is given, the negative one if two are as small. Candidates share a key of :func:`varied_starts`; the whole overlap of each
    is compared. Overlaps of one repeated number tie nothing.
    """
    sized = seqs.filter(F.size("seq") >= least)
    longest = sized.agg(F.max(F.size("seq"))).first()[0] or 0
    # of a complement, no term beyond the longest sequence and the shift meets another one
    asked = transformed(seqs.filter(F.pmod("id", F.lit(every)) == 0), longest + shift).filter(F.size("terms") >= least)
    asked = materialize(asked.withColumnRenamed("id", "q"), "asked")
    left = (
        varied_starts(asked, "terms", shift, least)
        .filter("not affine or transform = 'identity'")
        .withColumn("transform", F.when(F.col("affine"), "affine").otherwise(F.col("transform")))
    )
    right = varied_starts(
        spread(sized.select(F.col("id").cast("bigint").alias("id"), "seq")), "seq", shift, least
    ).withColumnRenamed("at", "at2")
    hits = left.join(right, ["h", "affine"]).filter("q <> id and (at = 0 or at2 = 0)")
    pairs = hits.groupBy("q", "transform", "id").agg(F.collect_set(F.col("at") - F.col("at2")).alias("shifts"))
    a = asked.select("q", "transform", F.array_join("terms", ",").alias("a"))
    a = a.unionByName(a.filter("transform = 'identity'").withColumn("transform", F.lit("affine")))
    b = sized.select(F.col("id").cast("bigint").alias("id"), F.array_join("seq", ",").alias("b"))
    return pairs.join(a, ["q", "transform"]).join(b, "id").mapInPandas(
        _verified,
        "q bigint, transform string, id bigint, s int, c_num string, c_den string, d_num string, d_den string"
    )
