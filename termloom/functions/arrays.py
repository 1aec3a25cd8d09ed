"""Term arrays as columns: pair features by array functions, sequence features by one exact Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 32
#: Lengths and residues of the feature vector.
MAX_TERMS, MODULI = 348, (2, 3, 5, 7)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays, null arrays count as empty."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(a.cast("array<string>"), empty), F.coalesce(b.cast("array<string>"), empty)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngrams(terms: Column, n: int = 3) -> Column:
    """All runs of n neighbouring terms as strings, joined by commas; empty if there are fewer terms."""
    m = F.size(terms) - n + 1
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.array_join(F.slice(terms, i, n), ",")
    )
    return F.when(m >= 1, grams).otherwise(F.array().cast("array<string>"))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    return jaccard(ngrams(a, n), ngrams(b, n))


def subsequence_match(a: Column, b: Column, least: int = 8) -> Column:
    """Whether the shorter array (a, if they are as long) stands in the longer one, or begins with at least the ``least`` last terms of it.

    False if the shorter has fewer than ``least`` terms.
    """
    first = F.size(a) <= F.size(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    m, n = F.size(short), F.size(long)
    starts = F.sequence(F.lit(0), F.greatest(n - least, F.lit(0)))
    # slices are built only where the first terms agree
    hit = F.exists(
        starts,
        lambda s: (F.get(long, s) == F.get(short, F.lit(0)))
        & (F.slice(long, s + 1, F.least(m, n - s)) == F.slice(short, F.lit(1), F.least(m, n - s)))
    )
    return F.when(m >= least, hit).otherwise(False)


#: c and d as exact fractions, and the shift.
AFFINE = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("c_num", "c_den", "d_num", "d_den")),
        T.StructField("s", T.IntegerType())
    ]
)


def _affine(x: list[int], y: list[int]) -> tuple | None:
    """(s, c numerator and denominator as they stand, first terms of the overlap) of the first affine shift, or None."""
    for s in range(-8, 9):
        p, q = (x[s:], y) if s >= 0 else (x, y[-s:])
        m = min(len(p), len(q))
        if m < 8:
            continue
        p0, q0 = p[0], q[0]
        k = next((i for i in range(1, m) if p[i] != p0), 0)
        if not k:
            if all(v == q0 for v in q[:m]):
                return s, 0, 1, p0, q0
            continue
        dp, dq = p[k] - p0, q[k] - q0
        if dq and all((q[i] - q0) * dp == dq * (p[i] - p0) for i in range(m)):
            return s, dq, dp, p0, q0
    return None


@F.pandas_udf(AFFINE)
def affine_match(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The first shift s in -8..8 with b[i] = c * a[i + s] + d exactly over an overlap of at least 8 terms; all null if there is none.

    A constant a matches only a constant b, with c = 0; c = 0 matches nothing else. Fractions are exact, whatever the size of the terms.
    """
    import sys
    from fractions import Fraction

    sys.set_int_max_str_digits(0)

    def one(x, y) -> tuple:
        got = None if x is None or y is None else _affine([int(t) for t in x], [int(t) for t in y])
        if got is None:
            return (None,) * 5
        s, dq, dp, p0, q0 = got
        c = Fraction(dq, dp)
        d = q0 - c * p0
        return str(c.numerator), str(c.denominator), str(d.numerator), str(d.denominator), s

    out = pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=["c_num", "c_den", "d_num", "d_den", "s"])
    return out.astype({"s": "Int32"})


FEATURES = ("term_set_jaccard", "ngram3_jaccard", "exact_subseq", "affine_match")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in FEATURES]))
def pair_features(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """STRUCT<term_set_jaccard, ngram3_jaccard, exact_subseq, affine_match: DOUBLE> of two arrays of clean terms; null counts as empty.

    The same as ``jaccard``, ``ngram_jaccard``, ``subsequence_match`` and ``affine_match`` one by one. The last needs both arrays
    in Python, and there all four are cheaper than array functions, which build each gram by itself.
    """
    import sys

    sys.set_int_max_str_digits(0)
    part = lambda x, y: len(x & y) / len(x | y) if x or y else 0.0

    def one(x: list[str], y: list[str]) -> tuple:
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        m, n = len(short), len(long)
        sub = m >= 8 and any(long[i] == short[0] and long[i : i + m] == short[: n - i] for i in range(n - 7))
        grams = (set(zip(t, t[1:], t[2:])) for t in (x, y))
        return (
            part(set(x), set(y)),
            part(*grams),
            float(sub),
            float(_affine(list(map(int, x)), list(map(int, y))) is not None)
        )

    rows = [one([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b)]
    return pd.DataFrame(rows, columns=FEATURES)


def feature_names(k: int = K) -> list[str]:
    # fixed values: the names and their order
    residues = [f"mod{m}_{r}" for m in MODULI for r in range(m)]
    return (
        [f"slog_{i}" for i in range(k)]
        + [
            "n_terms",
            "n_used",
            "growth_slope",
            "growth_intercept",
            "growth_rms",
            "diff1_mean",
            "diff1_std",
            "diff2_mean",
            "diff2_std",
            *residues,
            "frac_neg",
            "frac_zero",
            "frac_even",
            "sign_alt",
            "parity_alt",
            "logratio_med",
            "logratio_std",
            "frac_nondec"
        ]
    )


def sequence_features(k: int = K):
    """A Column function: clean terms to ARRAY<DOUBLE> in the order of ``feature_names``; absent parts are 0, no terms give zeros.

    Sums, differences and residues are taken on whole numbers of any size; logarithms of numbers beyond doubles are finite.
    """
    width = len(feature_names(k))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(terms: pd.Series) -> pd.Series:
        import math

        import numpy as np

        def slog(x: int) -> float:
            y = math.log1p(abs(x)) if abs(x) < 1 << 1000 else math.log(abs(x))
            return -y if x < 0 else y

        def one(raw) -> list[float]:
            if raw is None or not len(raw):
                return [0.0] * width
            a = [int(t) for t in raw[:k]]
            n = len(a)
            out = [slog(x) for x in a] + [0.0] * (k - n) + [float(min(len(raw), MAX_TERMS)), float(n)]
            at = np.array([i for i, x in enumerate(a) if x], dtype=float)
            logs = np.array([math.log(abs(x)) for x in a if x])
            fit = [0.0] * 3
            if len(at) >= 2:
                dx = at - at.mean()
                slope = float((dx * (logs - logs.mean())).sum() / (dx * dx).sum())
                icept = float(logs.mean() - slope * at.mean())
                fit = [slope, icept, float(np.sqrt(np.mean((logs - slope * at - icept) ** 2)))]
            out += fit
            step = [y - x for x, y in zip(a, a[1:])]
            for diffs in (step, [y - x for x, y in zip(step, step[1:])]):
                s = np.array([slog(x) for x in diffs])
                out += [float(s.mean()), float(s.std())] if len(s) else [0.0, 0.0]
            for m in MODULI:
                seen = [x % m for x in a]
                out += [seen.count(r) / n for r in range(m)]
            out += [sum(x < 0 for x in a) / n, sum(x == 0 for x in a) / n, sum(x % 2 == 0 for x in a) / n]
            pairs, gaps = list(zip(a, a[1:])), max(n - 1, 1)
            out += [sum(x < 0 < y or y < 0 < x for x, y in pairs) / gaps, sum((x - y) % 2 for x, y in pairs) / gaps]
            ratios = np.array([math.log(abs(y)) - math.log(abs(x)) for x, y in pairs if x and y])
            out += [float(np.median(ratios)), float(ratios.std())] if len(ratios) else [0.0, 0.0]
            return [*out, sum(y >= x for x, y in pairs) / gaps]

        return pd.Series([one(t) for t in terms])

    return features
