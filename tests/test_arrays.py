import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from termloom.functions import arrays
from termloom.functions.terms import clean_terms, exact_longs
from termloom.operators import battery, retrieval

FIB = [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610]
NAT, POW2, ALT = list(range(1, 17)), [2**i for i in range(16)], [i if i % 2 else -i for i in range(1, 17)]


def strs(a):
    return None if a is None else [str(x) for x in a]


@pytest.fixture
def feats(table):
    def run(a):
        f = (
            table("t array<string>", [(strs(a),)])
            .select(arrays.sequence_features()(F.col("t")).alias("f"))
            .first()["f"]
        )
        return dict(zip(arrays.feature_names(), f, strict=True))

    return run


def test_sequence_features(feats):
    assert len(arrays.feature_names()) == 66 == len(set(arrays.feature_names()))
    assert (
        all(math.isfinite(x) for x in feats(FIB).values())
        and set(feats([]).values()) == {0.0} == set(feats(None).values())
    )
    assert all(math.isfinite(x) for x in feats([5]).values())
    assert abs(feats(POW2)["growth_slope"] - math.log(2)) < 1e-9 and feats(POW2)["growth_rms"] < 1e-9
    even = feats([2 * i for i in range(1, 9)])
    assert even["mod2_0"] == even["frac_even"] == 1
    assert feats(ALT)["sign_alt"] == 1 and feats(ALT)["frac_neg"] == 0.5 and feats(ALT)["parity_alt"] == 1
    three = feats([3 * i for i in range(9)])
    assert (three["mod3_0"], three["mod3_1"]) == (1, 0) and feats([-7])["mod3_2"] == 1
    huge = feats([10**400, -(10**401), 10**500])
    assert all(math.isfinite(x) for x in huge.values()) and abs(huge["slog_0"] - 400 * math.log(10)) < 1e-6
    assert feats(list(range(400)))["n_terms"] == 348 and feats(list(range(400)))["n_used"] == 32


def one(table, a, b, f):
    r = (
        table("a array<string>, b array<string>", [(strs(a), strs(b))])
        .select(f(F.col("a"), F.col("b")).alias("x"))
        .first()["x"]
    )
    return r


def test_jaccards(table):
    assert one(table, FIB, FIB, arrays.jaccard) == one(table, FIB, FIB, arrays.ngram_jaccard) == 1
    assert one(table, [1, 2], [3], arrays.jaccard) == one(table, [], [], arrays.jaccard) == one(
        table, [1, 2], [1, 2], arrays.ngram_jaccard
    ) == 0
    assert one(table, None, [1], arrays.jaccard) == 0 and one(table, [1, 1, 2], [2, 3], arrays.jaccard) == 1 / 3


def test_subsequences(table):
    sub = lambda a, b: one(table, a, b, arrays.subsequence_match)
    assert sub(FIB[2:], FIB) and sub(FIB, FIB[2:]) and not sub(NAT, POW2) and not sub(FIB[:7], FIB)
    assert not sub(list(range(1, 17)), list(range(2, 18))) and sub(list(range(2, 18)), list(range(1, 17)))
    rng = random.Random(2)
    for _ in range(25):
        a, b = ([rng.randrange(2) for _ in range(rng.randrange(14))] for _ in range(2))
        s, l = (a, b) if len(a) <= len(b) else (b, a)
        want = len(s) >= 8 and any(l[i : i + len(s)] == s[: len(l) - i] for i in range(len(l) - 7))
        assert sub(a, b) == want


def affine(a, b):
    for s in range(-8, 9):
        p, q = (a[s:], b) if s >= 0 else (a, b[-s:])
        m = min(len(p), len(q))
        if m < 8:
            continue
        p, q = p[:m], q[:m]
        if len(set(p)) == 1:
            if len(set(q)) == 1:
                return Fraction(0), Fraction(q[0]), s
            continue
        k = next(i for i in range(m) if p[i] != p[0])
        c = Fraction(q[k] - q[0], p[k] - p[0])
        d = q[0] - c * p[0]
        if c and all(c * x + d == y for x, y in zip(p, q)):
            return c, d, s
    return None


def test_affine_matches(table):
    rng = random.Random(5)
    big = [rng.randrange(-(10**40), 10**40) for _ in range(20)]
    cases = [
        (FIB, [2 * x for x in FIB]),
        (FIB, [3 * x - 1 for x in FIB[2:]]),
        (NAT, POW2),
        (NAT, list(range(2, 18))),
        ([4] * 9, [7] * 9),
        ([4] * 9, NAT),
        (NAT, [4] * 16),
        (big, [7 * x + 10**41 for x in big[3:]]),
        ([2 * x for x in big], big),
        (FIB[:7], FIB[:7]),
        ([], FIB)
    ]
    for _ in range(20):
        a = [rng.randrange(-3, 4) for _ in range(12)]
        s = rng.randrange(4)
        cases.append(
            (a, [rng.choice([1, -2]) * x + 5 for x in a[s:]] if rng.random() < 0.5 else [-3 * x + 1 for x in a[s:]])
        )
    rows = (
        table("i int, a array<string>, b array<string>", [(i, strs(a), strs(b)) for i, (a, b) in enumerate(cases)])
        .select("i", arrays.affine_match(F.col("a"), F.col("b")).alias("m"))
        .collect()
    )
    for r in rows:
        m, want = r["m"], affine(*cases[r["i"]])
        got = (
            None
            if m is None
            or m["s"] is None
            else (Fraction(int(m["c_num"]), int(m["c_den"])), Fraction(int(m["d_num"]), int(m["d_den"])), m["s"])
        )
        assert got == want, cases[r["i"]]
    assert affine(*cases[0]) == (2, 0, 0) and affine(*cases[1]) == (3, -1, 2)


def test_terms(table):
    raw = [" 007", "+5", "-0", "-03", "\t12 ", "1.0", "", " ", None, "?", "--1", "9" * 50, "１"]
    got = (
        table("t array<string>", [(raw,), (None,), ([],)])
        .select(clean_terms(F.col("t")).alias("c"), exact_longs(clean_terms(F.col("t"))).alias("l"))
        .collect()
    )
    assert (
        got[0]["c"] == ["7", "5", "0", "-3", "12", "9" * 50]
        and got[0]["l"] is None
        and got[1]["c"] == [] == got[2]["c"]
    )


def test_transforms_invert_each_other():
    rng = random.Random(3)
    a = [rng.randrange(-9, 9) for _ in range(16)]
    t = dict(battery._transforms(a))
    assert dict(battery._transforms(t["binomial"]))["inverse_binomial"] == a == dict(
        battery._transforms(t["inverse_binomial"])
    )["binomial"]
    assert (
        dict(battery._transforms(t["euler"]))["inverse_euler"] == a
        and dict(battery._transforms(t["moebius"]))["inverse_moebius"] == a
    )
    assert dict(battery._transforms(t["partial_sums"]))["diff1"] == a[1:] and t["third_1"] == a[1::3]
    assert dict(battery._transforms([1] * 6))["euler"] == [1, 2, 3, 5, 7, 11]  # partitions
    assert dict(battery._transforms([0, 2, 3, 7]))["complement"] == [1, 4, 5, 6] and "complement" not in t
    assert set(t) | {"complement"} == set(battery.TRANSFORMS) and list(battery._transforms([]))[0] == ("identity", [])


def test_classical_baseline(table):
    rng = random.Random(4)
    sq = [i * i for i in range(1, 25)]
    seqs = [
        (100, sq),
        (1, [y - x for x, y in zip(sq, sq[1:])]),
        (2, sq[3:]),
        (3, [-x for x in sq]),
        (4, sq[:4] + [rng.randrange(999) for _ in range(20)]),
        (5, [5, 6]),
        (6, [7 * x + 1 for x in sq])
    ]
    df = table("id int, seq array<string>", [(i, strs(s)) for i, s in seqs])
    rows = {r["id"]: r for r in retrieval.classical_baseline(df.filter("id = 100"), df).collect()}
    assert (
        rows.keys() == {1, 2, 3, 4}
        and all(rows[i]["matched"] for i in (1, 2, 3))
        and not rows[4]["matched"]
        and rows[4]["rank"] == 4
    )
    assert (rows[1]["transform"], rows[3]["transform"], rows[3]["rank"]) == ("diff1", "negation", 2)


def test_transform_links(table):
    sq = [i * i for i in range(1, 25)]
    seqs = [
        (100, strs(sq)),
        (1, strs([y - x for x, y in zip(sq, sq[1:])])),
        (2, strs(sq[3:])),
        (3, strs([-x for x in sq])),
        (4, ["5"] * 20),
        (200, ["5"] * 20),
        (5, None),
        (6, ["1"])
    ]
    got = {
        (r["q"], r["transform"], r["id"], r["s"])
        for r in battery.transform_links(table("id int, seq array<string>", seqs)).collect()
    }
    assert (
        {(100, "diff1", 1, 0), (100, "identity", 2, 3), (100, "negation", 3, 0)} <= got
        and not any(q == 200 for q, *_ in got)
    )


def test_smoke_aggregates_against_plain_python(spark):
    import hashlib
    import re

    from termloom.plans import registry
    from termloom.session import table as load

    d = "/root/testdata/sf0.001"
    seqs = {}
    for r in load(spark, d, "corpus").collect():
        t = [int(x) for x in r["terms"] or [] if x is not None and re.fullmatch(r"\s*[+-]?[0-9]+\s*", x)]
        if t:
            seqs[r["a_number"]] = t
    pairs = {
        tuple(sorted((r["u"], r["v"])))
        for r in load(spark, d, "splits").collect()
        if r["split"] == "train"
        and r["label"] == 1
        and None not in (r["u"], r["v"])
    }
    picked = sorted(pairs, key=lambda p: (hashlib.md5(f"42|{p[0]}|{p[1]}".encode()).hexdigest(), p))[:200]
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    rows = []
    for u, v in picked:
        if u in seqs and v in seqs:
            a, b = seqs[u], seqs[v]
            s, l = (a, b) if len(a) <= len(b) else (b, a)
            hit = len(s) >= 8 and any(l[i : i + len(s)] == s[: len(l) - i] for i in range(len(l) - 7))
            rows.append((jac(set(a), set(b)), jac(grams(a), grams(b)), float(hit), float(affine(a, b) is not None)))
    got = registry.QUERIES["smoke_aggregates"](spark, d).first()
    assert got["pairs"] == len(rows) > 20
    for c, name in enumerate(("term_set_jaccard", "ngram3_jaccard", "exact_subseq", "affine_match")):
        assert abs(got[name] - sum(r[c] for r in rows) / len(rows)) < 1e-4


def test_trees_judge_held_out_pairs(table):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append(
            (
                i,
                i + 1,
                ["train", "train", "val", "test"][(i // 2) % 4],
                y,
                min(1.0, max(0.0, 0.25 + 0.5 * y + rng.gauss(0, 0.1))),
                rng.random(),
                0.0,
                0.0
            )
        )
    out = {
        r["split"]: r["auc"]
        for r in retrieval.boosted_trees_report(
            table(
                "u int, v int, split string, label int, term_set_jaccard double, ngram3_jaccard double, exact_subseq double, affine_match double",
                rows
            )
        ).collect()
    }
    assert out.keys() == {"train", "val", "test"} and all(a > 0.9 for a in out.values())
    assert retrieval.boosted_trees_report(
        table(
            "u int, v int, split string, label int, term_set_jaccard double, ngram3_jaccard double, exact_subseq double, affine_match double",
            rows[:1]
        )
    ).first()["auc"] is None


def test_transforms_take_whole_sequences(table):
    rng = random.Random(8)
    a = [10**60 + rng.randrange(10**60) for _ in range(340)]  # Euler terms of more than 4,300 digits
    wide = [3, 5, 10**40]
    df = table("id int, seq array<string>", [(1, strs(a)), (2, strs(wide)), (3, ["1", "20000", "20001"])])
    rows = {(r["id"], r["transform"]): r["terms"] for r in battery.transformed(df).collect()}
    for name, n in (
        ("identity", 340),
        ("diff1", 339),
        ("third_0", 114),
        ("odd", 170),
        ("binomial", 340),
        ("euler", 340),
        ("moebius", 340)
    ):
        assert len(rows[1, name]) == n
    assert rows[1, "negation"] == strs([-x for x in a]) and rows[1, "even"] == strs(a[::2])
    assert rows[2, "complement_gaps"] == ["0..2", "4..4", f"6..{10**40 - 1}"] and (3, "complement") not in rows
    cut = {(r["id"], r["transform"]): r["terms"] for r in battery.transformed(df, 5).collect()}
    assert cut[2, "complement"] == ["0", "1", "2", "4", "6"] and cut[3, "complement"] == ["0", "2", "3", "4", "5"]


def test_links_hold_over_whole_overlaps(table):
    rng = random.Random(9)
    a = [rng.randrange(-50, 50) for _ in range(30)]
    zeros = [0] * 12 + [1, 5, 2, 9, 4]
    part = a[:20] + [999] + a[21:]  # parts from a after 20 terms
    long = [rng.randrange(99) for _ in range(120)]
    seqs = {
        100: a,
        1: part,
        2: [3 * x - 7 for x in a[4:]],
        200: zeros,
        3: zeros,
        4: zeros[3:],
        5: [0] * 12 + [1, 5, 2, 9, 5],
        300: long,
        6: long[:100] + [-1],
        7: [-x for x in long],
        400: [4, 6, 10**30],
        8: [0, 1, 2, 3, 5, *range(7, 40)]
    }
    for i in range(20):
        b = [rng.randrange(2) for _ in range(rng.randrange(8, 14))]
        seqs |= {
            500 + 100 * i: b, 10 + i: [rng.choice([1, -1, 2]) * x + rng.randrange(2) for x in b[rng.randrange(3) :]]
        }
    df = table("id int, seq array<string>", [(i, strs(x)) for i, x in seqs.items()])
    want = {}
    for q in [q for q in seqs if q % 100 == 0]:
        ts = dict(battery._transforms(seqs[q], None, 200)) | {"affine": seqs[q]}
        for name, t in ts.items():
            for i, b in seqs.items():
                for s in sorted(range(-8, 9), key=lambda s: (abs(s), s)):
                    x, y = t[max(s, 0) :], b[max(-s, 0) :]
                    m = min(len(x), len(y))
                    x, y = x[:m], y[:m]
                    if i == q or m < 8 or len(set(x)) == 1 or len(set(y)) == 1:
                        continue
                    k = next(j for j in range(m) if x[j] != x[0])
                    c = Fraction(y[k] - y[0], x[k] - x[0])
                    if x == y if name != "affine" else c and all(c * (v - x[0]) == w - y[0] for v, w in zip(x, y)):
                        want[q, name, i] = (s, c if name == "affine" else None)
                        break
    got = {
        (r["q"], r["transform"], r["id"]): (
            r["s"], None if r["c_num"] is None else Fraction(int(r["c_num"]), int(r["c_den"]))
        )
        for r in battery.transform_links(df).collect()
    }
    assert got == want
    assert (
        got[100, "affine", 2] == (4, 3)
        and got[200, "identity", 3] == (0, None)
        and got[200, "identity", 4] == (3, None)
        and got[300, "negation", 7] == (0, None)
    )
    assert (
        got[400, "complement", 8] == (0, None)
        and not got.keys()
        & {(100, "identity", 1), (200, "identity", 5), (300, "identity", 6)}
    )


def test_baseline_finds_every_match(table):
    rng = random.Random(11)
    long = [rng.randrange(9) for _ in range(340)]
    sq = [i * i for i in range(1, 25)]
    seqs = {
        100: long,
        200: sq,
        300: [7] * 10,
        400: [10, 20, 30, 10**30],
        1: long[200:208],
        2: [7 * x + 1 for x in sq],
        3: [4] * 9,
        4: [*range(1000, 1020)],
        5: [17, 18, 19, 21, 22, 23, 24, 25, 26],
        6: [17, 18, 19, 20, 21, 22, 23, 24, 25]
    }
    seqs |= {1001 + i: rng.sample(long[:40], 25) for i in range(99)}  # many that share small grams
    df = table("id int, seq array<string>", [(i, strs(x)) for i, x in seqs.items()])
    asked = battery.transformed(df.filter("id % 100 = 0")).withColumnRenamed("id", "q")
    got = {(r["q"], r["transform"], r["id"]) for r in retrieval.matches(df.filter("id % 100 = 0"), df, asked).collect()}

    def sub(a, b):
        s, l = (a, b) if len(a) <= len(b) else (b, a)
        return len(s) >= 8 and any(l[i : i + len(s)] == s[: len(l) - i] for i in range(len(l) - 7))

    want = set()
    for q in (100, 200, 300, 400):
        for name, t in battery._transforms(seqs[q]):
            want |= {
                (q, name, i)
                for i, b in seqs.items()
                if i != q
                and name != "complement_gaps"
                and (sub(t, b) or affine(t, b))
            }
    assert {x for x in got if x[1] != "complement_gaps"} == want
    gaps = asked.filter("transform = 'complement_gaps' and q = 400")
    assert {r["id"] for r in retrieval._in_gaps(gaps, df).collect()} == {4, 5}
    head = dict(battery._transforms(seqs[400], None, 400))["complement"]
    assert (
        {i for q, t, i in got if t == "complement_gaps" and q == 400} == {4, 5}
        | {i for i, b in seqs.items() if i != 400 and affine(head, b)}
    )
    rows = {
        (r["q"], r["id"]): r
        for r in retrieval.classical_baseline(df.filter("id % 100 = 0"), df, gramless=True).collect()
    }
    assert (
        rows[100, 1]["matched"]
        and rows[200, 2]["matched"]
        and rows[300, 3]["matched"]
        and rows[200, 2]["ngram_jaccard"] == 0
    )


def test_constant_starts_of_a_long_list_take_linear_time(table):
    import time

    rows = [(1, [str(i) for i in range(60_000)]), (2, ["3"] * 60_000), (3, ["1", "2", *["7"] * 9, "8"]), (4, ["5"] * 7)]
    df = table("id int, seq array<string>", rows)
    began = time.time()
    got = {(r["id"], r["at"], r["n"], r["lead"]) for r in retrieval._constant_starts(df, "seq").collect()}
    assert got == {(2, i, 60_000 - i, 60_000 - i) for i in range(9)} | {(3, 2, 10, 9), (3, 3, 9, 8)}
    assert time.time() - began < 20  # minutes if every term gets a copy of the list


def test_hot_grams_do_not_spell_out_all_pairs(table):
    rng = random.Random(21)
    tail = lambda n: [rng.randrange(10**6) for _ in range(n)]
    seqs = {i: [0, 1, 2, *tail(rng.randrange(9, 40))] for i in range(1, 120)}
    seqs |= {i: [0, 1, 2, 3, *tail(rng.randrange(9, 40))] for i in range(120, 160)}
    seqs |= {i: [rng.randrange(3) for _ in range(rng.randrange(3, 30))] for i in range(160, 200)}
    seqs |= {i: [0, 1, 2] for i in range(205, 235)} | {300: [0, 1, 2, 3, *tail(20)], 400: [7] * 9 + [0, 1, 2], 500: [0, 1, 2]}
    seqs |= {236: [7] * 9, 237: seqs[100][:], 238: [-x for x in seqs[100]], 239: [2 * x for x in seqs[300]]}
    df = table("id int, seq array<string>", [(i, strs(x)) for i, x in seqs.items()])
    asked = df.filter("id % 100 = 0")

    def sub(a, b):
        s, l = (a, b) if len(a) <= len(b) else (b, a)
        return len(s) >= 8 and any(l[i : i + len(s)] == s[: len(l) - i] for i in range(len(l) - 7))

    part = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    grams = lambda t: set(zip(t, t[1:], t[2:]))
    head = lambda a: dict(battery._transforms(a, None, 60)).get("complement", [])
    every = {
        q: [
            (b, i, name, t == "gaps", [] if t == "gaps" else t, head(seqs[q]) if t == "gaps" else t)
            for name, t in ((n, "gaps" if n == "complement_gaps" else t) for n, t in battery._transforms(seqs[q]) if t)
            for i, b in seqs.items()
            if i != q
        ]
        for q in seqs
        if q % 100 == 0
    }

    def best(q, gramless):
        of, any_ = {}, {}
        for b, i, name, gaps, t, first in every[q]:
            m = affine(first, b) is not None or not gaps and sub(t, b)
            j = 0.0 if gaps else part(grams(t), grams(b))
            any_[i] = max(any_.get(i, 0), j)
            if m or j:
                of.setdefault(i, []).append((m, j, part(set(t), set(b)), name))
        rows = [(i, *max(x)) for i, x in of.items() if gramless or any_[i]]
        return sorted(rows, key=lambda r: (-r[1], -r[2], -r[3], r[0]))[:10]

    for gramless in (True, False):
        want = [
            (q, i, name, m, round(j, 12), round(s, 12), k)
            for q in every
            for k, (i, m, j, s, name) in enumerate(best(q, gramless), 1)
        ]
        for block in (15, 2000):
            got = retrieval.classical_baseline(asked, df, gramless=gramless, block=block).collect()
            assert sorted(
                (r["q"], r["id"], r["transform"], r["matched"], round(r["ngram_jaccard"], 12), round(r["set_jaccard"], 12), r["rank"])
                for r in got
            ) == sorted(want)
    seqs_ = df.select(F.col("id").cast("bigint").alias("id"), "seq")
    lists = battery.transformed(asked).withColumnRenamed("id", "q")
    none = lists.select("q", "transform", F.col("q").alias("id")).limit(0)
    few, all_ = (retrieval._gram_scores(lists, seqs_, none, 10, True, b).count() for b in (15, 2000))
    assert few < all_ / 2


@pytest.fixture
def stored(table, tmp_path):
    """A folder with five sequences, and splits of two positives and two negatives."""
    seqs = [(1, strs(FIB)), (2, strs([2 * x + 1 for x in FIB])), (3, strs(FIB[2:])), (4, strs(POW2)), (5, None)]
    table("a_number int, terms array<string>", seqs).write.parquet(f"{tmp_path}/corpus.parquet")
    rows = [
        (1, 2, " S2", 1, "train"),
        (1, 2, "s2", 1, "train"),
        (1, 4, "s2", 1, "train"),
        (1, 3, "neg", 0, "train"),
        (2, 3, "neg", 0, "test"),
        (1, 5, "s3", 1, "train"),
        (1, None, "s3", 1, "train"),
        (3, 4, "s3", 1, "train")
    ]
    table("u int, v int, stratum string, label int, split string", rows).write.parquet(f"{tmp_path}/splits.parquet")
    return str(tmp_path)


def test_pair_features_of_negatives(spark, stored):
    from termloom.plans import registry

    of = {1: FIB, 2: [2 * x + 1 for x in FIB], 3: FIB[2:], 4: POW2}
    rows = {(r["u"], r["v"]): r for r in registry.QUERIES["pair_features"](spark, stored).collect()}
    assert rows.keys() == {(1, 2), (1, 4), (1, 3), (2, 3), (3, 4)}
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    for (u, v), r in rows.items():
        for name, f in (("term_set_jaccard", set), ("ngram3_jaccard", grams)):
            a, b = f(of[u]), f(of[v])
            assert abs(r[name] - len(a & b) / len(a | b)) < 1e-8
        assert r["exact_subseq"] == ((u, v) == (1, 3)) and r["affine_match"] == (affine(of[u], of[v]) is not None)
    assert {
        (r["u"], r["v"]) for r in registry.QUERIES["affine_pairs"](spark, stored).collect()
    } == {(1, 2), (1, 3), (2, 3)}


def test_smoke_affine_by_stratum(spark, stored):
    from termloom.plans import registry

    got = {
        (r["stratum"], r["total"]): (r["pairs"], r["affine_match"])
        for r in registry.QUERIES["smoke_affine_by_stratum"](spark, stored).collect()
    }
    of = {1: FIB, 2: [2 * x + 1 for x in FIB], 3: FIB[2:], 4: POW2}
    hits = {
        s: [affine(of[u], of[v]) is not None for u, v in pairs]
        for s, pairs in {"s2": [(1, 2), (1, 4)], "s3": [(3, 4)]}.items()
    }
    want = (
        {(s, 0): (len(h), sum(h) / len(h)) for s, h in hits.items()}
        | {(None, 1): (3, round(sum(map(sum, hits.values())) / 3, 6))}
    )
    assert got == want and got["s2", 0] == (2, 0.5)


def test_constant_starts_meet_by_magnitude(table):
    """Whole constants, constants of another number, constant heads of many lengths, and starts of 8 and of 7 terms."""
    heads = (7, 8, 9, 15, 16, 17, 31, 32, 33, 64)
    seqs = {100: [5] * 16, 200: [1] * 33 + [2], 300: [3, 4] + [0] * 12, 400: [7] * 8 + [1, 2]}
    seqs |= {i: [i] * n for i, n in enumerate(heads, 1)} | {i: [9] * n + [3, 1] for i, n in enumerate(heads, 21)}
    seqs |= {50: [2] + [6] * 20, 51: [], 52: [8]}
    df = table("id bigint, seq array<string>", [(i, strs(x)) for i, x in seqs.items()])
    asked = df.filter("id % 100 = 0").select("id", F.lit("identity").alias("transform"), F.col("seq").alias("terms"))
    one = retrieval._constant_starts(asked.withColumnRenamed("id", "q"), "terms")
    two = retrieval._constant_starts(df, "seq").withColumnsRenamed({"at": "at2", "n": "n2", "lead": "lead2"})
    got = {(r["q"], r["id"]) for r in retrieval._both_constant(one, two, 8).select("q", "id").distinct().collect()}
    want = set()
    for q in (100, 200, 300, 400):
        for i, b in seqs.items():
            for s in range(-8, 9):
                x, y = seqs[q][max(s, 0) :], b[max(-s, 0) :]
                m = min(len(x), len(y))
                if i != q and m >= 8 and len(set(x[:m])) == 1 and len(set(y[:m])) == 1:
                    want.add((q, i))
    assert got == want and len(want) > 20
