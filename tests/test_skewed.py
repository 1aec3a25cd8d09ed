import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.operators import skewed

SCHEMA = "source int, target int, stratum string, rank int, key int, cat string"


def rows(n=3000):
    rng = random.Random(1)
    one = lambda: 7 if rng.random() < 0.4 else rng.choice([None, 2**31 - 1, -(2**31), rng.randrange(-9000, 9000)])
    out = [(one(), one(), rng.choice(["s1", " S2", "s3 ", "S4", None, "", "other"]), 1, 2, "x") for _ in range(n)]
    return out + out[:50]


def brute(data):
    n, partners, strata = Counter(), defaultdict(set), defaultdict(Counter)
    for s, t, st, *_ in data:
        st = (st or "").strip().lower()
        for side, k, o in (("source", s, t), ("target", t, s)):
            if k is not None:
                n[side, k] += 1
                strata[side, k][st if st in skewed.STRATA else "other"] += 1
                if o is not None:
                    partners[side, k].add(o)
    return {(*k, c, len(partners[k]), *(strata[k][s] for s in (*skewed.STRATA, "other"))) for k, c in n.items()}


def test_profile_with_hot_keys_nulls_and_repeats(table):
    data = rows()
    got = [tuple(r) for r in skewed.key_profile(table(SCHEMA, data).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


@pytest.mark.parametrize("width,max_keys", [(1, 10), (7, 3), (4096, 100)])
def test_blocks_and_dictionaries_of_any_size(table, width, max_keys):
    data = [(i % 37 - 5, i % 3) for i in range(1000)]
    got = skewed.dense_counts(
        table("k int, c int", data).repartition(3), F.col("k"), F.col("c"), 3, width=width, max_keys=max_keys
    )
    want = Counter(data)
    assert {r["key"]: r["counts"] for r in got.collect()} == {
        k: [want[k, c] for c in range(3)] for k in {k for k, _ in data}
    }


def test_sums_of_many_splits_in_two_levels(table, monkeypatch):
    monkeypatch.setattr(skewed, "FAN", 2)
    data = [(5 if i % 2 else i % 90, i % 2) for i in range(2000)]  # one key has half of the rows
    got = skewed.dense_counts(table("k int, c int", data).repartition(9), F.col("k"), F.col("c"), 2, width=16)
    want = Counter(data)
    assert {r["key"]: r["counts"] for r in got.collect()} == {
        k: [want[k, c] for c in range(2)] for k in {k for k, _ in data}
    }


def test_weights_are_summed(table):
    got = skewed.dense_counts(
        table("k int, w bigint", [(1, 5), (1, 2**40), (2, 0)]), F.col("k"), F.lit(0), 1, F.col("w")
    )
    assert {r["key"]: r["counts"][0] for r in got.collect()} == {1: 2**40 + 5}


def test_heavy_keys_count_rows_without_a_key(table):
    data = [(1, None, "s1", 0, 0, "")] * 7 + [(i, 3, "s1", 0, 0, "") for i in range(100, 793)]
    got = {tuple(r) for r in skewed.heavy_keys(table(SCHEMA, data)).collect()}
    assert got == {("source", 1), ("target", 3)}  # 7 of 700 rows is one percent exactly


def test_nothing(table):
    assert skewed.key_profile(table(SCHEMA)).count() == 0 and skewed.heavy_keys(table(SCHEMA)).count() == 0
    assert skewed.heavy_keys(table(SCHEMA, [(None, None, None, None, None, None)])).count() == 0
